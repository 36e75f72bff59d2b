"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every rule rejects documents beyond a cutoff of one measure. Which cutoffs are in force is decided on labelled documents
that nothing else was fitted to: for each stratum, rule and cutoff of a fixed list, an exact binomial test of "it rejects
at least ``RISK`` of the good documents" is made from the good labelled documents of the stratum. The hypotheses of all
strata, rules and cutoffs together go through Holm's step-down correction at level ``LEVEL``; of the cutoffs whose
hypothesis falls, a rule uses the strictest in each stratum. So with probability ``1 - LEVEL`` no stratum loses more than
``RISK`` of its good documents to any rule, nor more than ``RISK`` times the number of rules in all. A stratum with too
few labels for any proof has no rules beyond the base ones.

A missing text has no words. A document without a stratum forms the stratum of missing values. Labels without a quality
or an id are left out; of several labels for one id the worst counts. Rows that share an id are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import tables
from tidewatch.llm.tables import let

RISK = 0.01
LEVEL = 0.05
#: Rule -> (measure, direction, cutoffs from mild to strict). A document beyond the cutoff in that direction goes.
RULES: dict[str, tuple[str, str, list[float]]] = {
    "symbols": ("symbol_share", "above", [0.5, 0.3, 0.2, 0.15, 0.1, 0.05]),
    "repeats": ("repeat_share", "above", [0.18, 0.15, 0.12, 0.1, 0.05]),
    "lines": ("dup_line_share", "above", [0.6, 0.5, 0.4, 0.3, 0.2]),
    "long_words": ("mean_word", "above", [20.0, 15.0, 12.0, 10.0, 9.0]),
    "short_words": ("mean_word", "below", [1.5, 2.0, 2.5, 3.0, 3.5]),
}
#: Strata up to which the table of cutoffs is broadcast; beyond, it is joined by shuffle.
BROADCAST_STRATA = 10_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that the text holds at least twice (windows compared by 64-bit hash)."""
    def covered(windows: Column) -> Column:
        def from_sorted(order: Column) -> Column:
            same = lambda a, b: F.get(order, a)["h"] == F.get(order, b)["h"]
            again = F.filter(order, lambda s, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            places = F.array_sort(F.transform(again, lambda s: s["p"]))
            start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.sort_array(pairs), from_sorted))

    def windows(hashes: Column) -> Column:
        return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0))),
                           lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, width))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), covered)))


def measure(text: Column) -> Column:
    """All counts of a text, one evaluation of its words, as a struct."""
    def counted(words: Column) -> Column:
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w))
        return F.struct(F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), repeated_words(words).cast("long").alias("n_repeat_words"))

    def lined(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return F.struct(
        let(F.regexp_extract_all(whole, F.lit(tables.WORD), F.lit(0)), counted).alias("w"), let(lines, lined).alias("l"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))


def measured(docs: DataFrame, name: str = "_m") -> DataFrame:
    """``docs`` with the struct ``name`` of counts and of ``base_failed``. Stage the result: it is read twice."""
    raw = docs.withColumn(name, measure(F.col("text")))
    m = F.col(name)
    words, repeats = m["w"]["n_words"], m["w"]["n_repeat_words"]
    return raw.withColumn(name, F.struct(
        words.alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"),
        repeats.alias("n_repeat_words"), m["l"]["n_lines"].alias("n_lines"), ((words < 10) | (100 * repeats > 20 * words)).alias("base_failed")))


def _measures(m: Column) -> dict[str, Column]:
    share = lambda a, b: a.cast("double") / F.nullif(b, F.lit(0).cast("long"))
    return {"symbol_share": share(m["n_symbols"], m["word_chars"]), "repeat_share": share(m["n_repeat_words"], m["n_words"]),
            "dup_line_share": share(m["n_dup_lines"], m["n_lines"]), "mean_word": share(m["word_chars"], m["n_words"])}


def beyond(value: Column, direction: str, cutoff: Column) -> Column:
    """Whether the rule rejects; unknown values and cutoffs never do."""
    return F.coalesce(value > cutoff if direction == "above" else value < cutoff, F.lit(False))


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(X <= k) of a binomial with ``n`` trials of probability ``risk``, for k below its mean, else 1.

    The largest term comes from log-gamma (Stirling's series, shifted by 8), smaller ones by their ratios, until they are
    below double precision: some tens of standard deviations, so the work grows with the square root of ``n``.
    """
    def log_gamma(x: Column) -> Column:
        y = x + 8.0
        series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
        shift = F.lit(0.0)
        for i in range(8):
            shift = shift + F.ln(x + float(i))
        return series - shift

    kd, nd = k.cast("double"), n.cast("double")
    log_top = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * F.log(F.lit(risk)) + (nd - kd) * F.log(F.lit(1 - risk))
    steps = F.least(k, (F.sqrt(nd) * 40 + 200).cast("long"))
    lower = F.when(steps > 0, F.transform(F.sequence(F.lit(0).cast("long"), steps - 1), lambda j: k - j)).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    def add(a: Column, i: Column) -> Column:
        term = a["term"] * i.cast("double") / (nd - i + 1) * F.lit((1 - risk) / risk)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))
    total = F.aggregate(lower, start, add, lambda a: a["total"])
    return F.when(kd >= nd * risk, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * total))


def tested(measured_docs: DataFrame, labels: DataFrame, stratum: str = "lang", name: str = "_m", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``stratum, rule, cutoff, n_good, n_lost, p_value, proven`` for every hypothesis."""
    good = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id"))
            .agg(F.min("quality").alias("_quality")).where("_quality = 1").select("_id"))
    small = measured_docs.select(F.col("doc_id").alias("_id"), F.col(stratum).alias("stratum"), F.col(name).alias("_m"))
    values = _measures(F.col("_m"))
    # The holdout: good labelled documents that the base rules leave. Texts are not part of this join.
    held = small.join(good, "_id").where(~F.col("_m")["base_failed"]).select("stratum", *(v.alias(k) for k, v in values.items()))
    lost = [F.sum(beyond(F.col(m), d, F.lit(c)).cast("long")).alias(f"{rule}|{c}") for rule, (m, d, cuts) in RULES.items() for c in cuts]
    counted = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *lost)
    tests = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"`{rule}|{c}`").alias("n_lost"))
                      for rule, (_, _, cuts) in RULES.items() for c in cuts))
    rows = (counted.select("stratum", "n_good", F.explode(tests).alias("t")).select("stratum", "t.rule", "t.cutoff", "n_good", "t.n_lost")
            .withColumn("p_value", binomial_tail(F.col("n_lost"), F.col("n_good"), risk)))
    # One row per stratum, rule and cutoff: a short table, so one window over all of it is the step-down order.
    order = Window.orderBy("p_value", "stratum", "rule", "cutoff")
    ranked = rows.select("*", F.row_number().over(order).alias("_rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_tests"))
    falls = F.col("p_value") <= F.lit(level) / (F.col("_tests") - F.col("_rank") + 1)
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("proven", F.min(falls.cast("int")).over(up_to) == 1).drop("_rank", "_tests")


def cutoffs(tests: DataFrame) -> DataFrame:
    """``stratum`` and the strictest proven cutoff of each rule (missing where none is proven)."""
    proven = tests.where("proven")
    pick = {"above": F.min, "below": F.max}
    return proven.groupBy("stratum").agg(*(pick[d](F.when(F.col("rule") == rule, F.col("cutoff"))).alias(rule) for rule, (_, d, _) in RULES.items()))


def judged(measured_docs: DataFrame, limits: DataFrame, stratum: str = "lang", name: str = "_m") -> DataFrame:
    """``measured_docs`` with ``_kept``. ``limits`` is a written table of :func:`cutoffs`."""
    limits = limits.select(F.struct(*limits.columns).alias("_limits"))
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    values = _measures(F.col(name))
    rejected = F.lit(False)
    for rule, (m, direction, _) in RULES.items():
        rejected = rejected | beyond(values[m], direction, F.col("_limits")[rule])
    joined = measured_docs.join(limits, F.col(stratum).eqNullSafe(F.col("_limits")["stratum"]), "left")
    return joined.withColumn("_kept", ~(F.col(name)["base_failed"] | rejected)).drop("_limits")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document."""
    small = tables.staged_small(measured(docs.select("doc_id", "text", stratum)).drop("text"), "rule-counts")
    limits = tables.staged_small(cutoffs(tested(small, labels, stratum)), "rule-cutoffs")
    m = F.col("_m")
    return judged(small, limits, stratum).select(F.col("doc_id").cast("long").alias("doc_id"), *(m[c].alias(c) for c in COUNTS), m["base_failed"].alias("base_failed"), F.col("_kept").alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. A missing stratum column counts as missing values.

    Texts are measured twice, once for the cutoffs and once for the verdicts, so that no copy of them is written.
    """
    group = F.col(f"`{stratum}`") if stratum in docs.columns else F.lit(None).cast("string")
    every = docs.select(tables.whole_row(docs), "doc_id", "text", group.alias(stratum))     # so that no column name can clash
    small = tables.staged_small(measured(every.drop("_whole")).drop("text"), "rule-counts")
    limits = tables.staged_small(cutoffs(tested(small, labels, stratum)), "rule-cutoffs")
    return judged(measured(every), limits, stratum).where("_kept").select("_whole.*")
