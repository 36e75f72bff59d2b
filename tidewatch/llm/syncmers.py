"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is read as pieces (words; longer ones in pieces of 24 characters). Of every run of ``K`` pieces (a k-mer) the
inner runs of two pieces are hashed, and the k-mer is an anchor if the least of them is its first or its last. That
depends on nothing outside the k-mer, so a passage keeps its anchors wherever it stands and whatever surrounds it. The
fingerprint of a document holds every anchor, each with the place of its first occurrence: 32 bits of hash and 30 of place as
sixteen hexadecimal digits.

``likeness`` of two fingerprints is the share of all their hashes that both hold at matching places. The shifts of shared
anchors are compared with their median, so that anchors shared by chance at random places do not count. Equal fingerprints
have likeness 1, an empty one and another 0.

Without ``every``, :func:`anchors` gives a sketch: the anchors whose hash is below ``LIMIT`` (one in ``ONE_IN``, so it grows
with the text) and in any case the ``LEAST`` smallest; ``likeness`` then makes the same choice from both together, up to
which both are complete. :func:`edited` takes every anchor.

A missing text is empty; an empty text has an empty fingerprint; a text of fewer than ``K`` pieces, or of which no k-mer is
an anchor, has one anchor, the hash of all its pieces. Equal texts have equal fingerprints. Rows without an id come last in
descending order; rows with the same id follow each other by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import tables
from tidewatch.llm.tables import let

K = 4
LEAST = 48
ONE_IN = 16
LIMIT = 2 ** 32 // ONE_IN
#: Bits of a place; a string has fewer pieces than they count.
PLACE = 30
#: Pieces by which the shift of a shared anchor may differ from the median shift.
SLACK = 8
_PIECE = "[^\\x20\\x09-\\x0D]{1,24}"


def anchors(text: Column, every: bool = False) -> Column:
    """Every anchor of a text, or those of its sketch, as ascending numbers: 32 bits of hash, ``PLACE`` bits of place."""
    low = F.lit(0xFFFFFFFF)

    def packed(h: Column, place: Column) -> Column:
        return F.shiftleft(h.bitwiseAND(low), PLACE).bitwiseOR(place.cast("long"))

    def chosen(inner: Column) -> Column:
        def mark(g: Column, i: Column) -> Column:
            others = [F.get(inner, i + j) for j in range(1, K - 1)]
            return F.when(F.least(g, others[-1]) <= (F.least(*others[:-1]) if K > 4 else others[0]), packed(F.xxhash64(g, *others), i)).otherwise(F.lit(-1).cast("long"))

        places = F.transform(F.slice(inner, 1, F.greatest(F.size(inner) - (K - 2), F.lit(0))), mark)
        ordered = F.sort_array(F.filter(places, lambda x: x >= 0))
        first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, PLACE) != F.shiftright(F.get(s, F.greatest(i - 1, F.lit(0))), PLACE)))
        found = let(ordered, first)
        return found if every else F.filter(found, lambda x, i: (i < LEAST) | (F.shiftright(x, PLACE) < LIMIT))

    def of(pieces: Column) -> Column:
        hashed = F.transform(pieces, lambda p: F.xxhash64(p))
        pairs = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        whole = F.array(packed(F.xxhash64(F.concat_ws(" ", pieces)), F.lit(0)))
        return (F.when(F.size(pieces) == 0, F.array().cast("array<long>")).when(F.size(pieces) < K, whole)
                .otherwise(let(let(hashed, lambda h: let(pairs(h), chosen)), lambda c: F.when(F.size(c) == 0, whole).otherwise(c))))

    return let(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), of)


def as_text(kept: Column) -> Column:
    """Anchors as a string of hexadecimal digits."""
    return F.array_join(F.transform(kept, lambda a: F.lower(F.lpad(F.hex(a), 16, "0"))), "")


def likeness(a: Column, b: Column, every: bool = False) -> Column:
    """Share of common anchors at matching places, from 0 to 1, of two columns of :func:`anchors` with the same ``every``.

    Both lists are sorted into one, where a shared hash stands next to itself: n log n steps for n anchors.
    """
    places = F.lit(2 ** PLACE - 1)
    hashed = lambda n: F.shiftright(n, PLACE + 1)

    def sided(v: Column, side: int) -> Column:
        return F.transform(v, lambda n: F.shiftleft(F.shiftright(n, PLACE), PLACE + 1).bitwiseOR(F.lit(side << PLACE)).bitwiseOR(n.bitwiseAND(places)))

    def chosen(m: Column) -> Column:
        distinct = F.filter(m, lambda x, i: (i == 0) | (hashed(x) != hashed(F.get(m, F.greatest(i - 1, F.lit(0))))))
        last = F.coalesce(hashed(F.get(distinct, F.lit(LEAST - 1))), F.lit(2 ** 32))
        return let(F.greatest(last, F.lit(LIMIT - 1)), lambda bound: F.filter(m, lambda n: hashed(n) <= bound))

    def compared(m: Column) -> Column:
        gap = lambda x, i: F.when(hashed(F.get(m, i + 1)) == hashed(x), F.get(m, i + 1).bitwiseAND(places) - x.bitwiseAND(places))
        shifts = F.array_sort(F.filter(F.transform(m, gap), lambda g: g.isNotNull()))
        near = lambda s: F.size(F.filter(s, lambda x: F.abs(x - F.get(s, F.floor(F.size(s) / 2).cast("int"))) <= SLACK)).cast("double") / (F.size(m) - F.size(s))
        return let(shifts, near)

    both = F.sort_array(F.concat(sided(a, 0), sided(b, 1)))
    merged = both if every else let(both, chosen)
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(let(merged, compared))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the row after it by descending ``doc_id`` (after the last: of the first).

    Ids are cut into ranges at approximate quantiles; every range is ordered by one window, and the first row of each range
    also visits the range above it as a guest, so texts are shuffled once and no window sees the whole table.
    """
    spark = docs.sparkSession
    n = tables.partitions(spark)
    bounds = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))          # fewer than the shuffle's partitions
    at = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<long>"), lambda b: b < F.col("doc_id")))
    ranged = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(at))
    tops = ranged.groupBy("_range").agg(F.max("doc_id").alias("_top"))              # one row per range
    order = Window.orderBy("_range")
    above = tops.select(F.col("_range").alias("_from"), "_top", F.coalesce(F.lead("_range").over(order), F.first("_range").over(order)).alias("_guest_of"))
    seen = ranged.join(F.broadcast(above), F.col("_range") == F.col("_from"))
    visits = F.when(F.col("doc_id").eqNullSafe(F.col("_top")), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g")), F.struct(F.col("_guest_of").alias("r"), F.lit(True).alias("g"))))
    both = seen.withColumn("_v", F.explode(F.coalesce(visits, F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g"))))))
    inside = Window.partitionBy(F.col("_v.r")).orderBy(F.col("_v.g"), F.col("doc_id").desc_nulls_last(), F.col("text"))
    ahead = both.select("*", *(F.lead(c).over(inside).alias(f"next_{c}") for c in columns))
    return ahead.where(~F.col("_v.g")).drop("_range", "_from", "_top", "_guest_of", "_v")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its text with the second half replaced by the next document's start, and the
    likeness of the document to that text and to the next document.

    Every anchor counts. They take about as much room as the text, so texts alone are shuffled and the next document's
    anchors are found once more beside it."""
    pairs = with_next(tables.texts(docs), ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    made = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    ready = pairs.select("doc_id", n.cast("long").alias("n_chars"), *(anchors(F.col(c), True).alias(a) for c, a in (("text", "anchors"), ("next_text", "next_anchors"))), made.alias("edited"))
    marked = ready.select("*", anchors(F.col("edited"), True).alias("edited_anchors"))
    return marked.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("anchors")).alias("fingerprint"), as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
                         likeness(F.col("anchors"), F.col("edited_anchors"), True).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors"), True).alias("near_next"))
