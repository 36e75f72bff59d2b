"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import attribution, blocks, codes, contamination, gam, packing, periods, pieces, rules, simhash, substrings, syncmers, token_store, tokens, windows
from tidewatch.llm.tables import WORD, let, table
from tidewatch.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Folder of the public tokenizers; the installed package's own by default.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "")


def tokenizer_file(name: str) -> str:
    """A tokenizer's file: below ``TOKENIZER_DIR`` if set, else where the package has it."""
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_token_store")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` into the token store and back."""
    path, file = scratch_path(spark, "token-store"), tokenizer_file("word_bpe_49k.json")
    token_store.write_store(table(spark, sf_dir, "documents"), path, file, end_id=2)
    return token_store.read_store(spark, path, tokens.encoder(file).width).drop("ids")


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` packed along the curve."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=1, keep_ids=False)


@query("op8_window_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(ws, p, p + 49), ' ')) AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p + o AS pos FROM (SELECT doc_id, p FROM win JOIN firsts USING (k) WHERE m < doc_id), range(0, 50) t(o)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT e.doc_id, count(g.pos) AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN e.word END, ' ' ORDER BY e.pos), '') AS t
         FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, windows of 50 words."""
    stored = blocks.write_blocks(table(spark, sf_dir, "documents"), "window-blocks")
    return windows.removed(stored).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _rule_sql() -> str:
    """The rules in DuckDB: the same counts, exact binomial tails, step-down order and cutoffs."""
    tests = ", ".join(f"('{rule}', '{m}', '{d}', {c}::DOUBLE)" for rule, (m, d, cuts) in rules.RULES.items() for c in cuts)
    rejected = " OR ".join(f"coalesce({m} {'>' if d == 'above' else '<'} {rule}, false)" for rule, (m, d, _) in rules.RULES.items())
    picked = ", ".join(f"{'min' if d == 'above' else 'max'}(cutoff) FILTER (rule = '{rule}') AS {rule}" for rule, (_, d, _) in rules.RULES.items())
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT r, p, array_to_string(list_slice(ws, p, p + 4), ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
reps AS (SELECT r, count(DISTINCT p + o) AS n FROM twice, range(0, 5) x(o) GROUP BY r),
c AS (SELECT w.r, doc_id, lang, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(reps.n, 0) AS n_repeat_words
      FROM w LEFT JOIN reps USING (r)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / nullif(word_chars, 0)::DOUBLE AS symbol_share, n_repeat_words / nullif(n_words, 0)::DOUBLE AS repeat_share,
        n_dup_lines / nullif(n_lines, 0)::DOUBLE AS dup_line_share, word_chars / nullif(n_words, 0)::DOUBLE AS mean_word FROM c),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT m.* FROM m JOIN good USING (doc_id) WHERE NOT base_failed),
tests(rule, measure, direction, cutoff) AS (VALUES {tests}),
counted AS (SELECT lang AS stratum, rule, direction, cutoff, count(*) AS n, count(*) FILTER (CASE WHEN direction = 'above' THEN v > cutoff ELSE v < cutoff END) AS k
            FROM (SELECT lang, rule, direction, cutoff, CASE measure WHEN 'symbol_share' THEN symbol_share WHEN 'repeat_share' THEN repeat_share
                    WHEN 'dup_line_share' THEN dup_line_share ELSE mean_word END AS v FROM held, tests) GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k >= n * {rules.RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
            exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rules.RISK}) + (n - i) * ln({1 - rules.RISK})))) END AS p FROM counted),
ranked AS (SELECT *, row_number() OVER (ORDER BY p, stratum, rule, cutoff) AS j, count(*) OVER () AS total FROM tails),
proven AS (SELECT * FROM (SELECT *, min(CASE WHEN p <= {rules.LEVEL} / (total - j + 1) THEN 1 ELSE 0 END) OVER (ORDER BY j) AS ok FROM ranked) WHERE ok = 1),
limits AS (SELECT stratum, {picked} FROM proven GROUP BY stratum)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT (base_failed OR {rejected}) AS kept
FROM m LEFT JOIN limits ON m.lang IS NOT DISTINCT FROM limits.stratum"""


@query("op2_quality_rules", _rule_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` under the rules, cutoffs proven on whole ``labels``."""
    return rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: From this score on a document is predicted to be good.
GOOD = 0.3


@query("op6_quality_gam")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text of ``documents``; a fifth of the labels is held out."""
    docs = table(spark, sf_dir, "documents")
    score = gam.scorer(gam.train(docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", gam.held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0).cast("int"))


@query("op3_simhash_pivots")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: 64-bit fingerprints of three-word shingles, linked at three bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.EXACT)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query("op7_syncmers")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` and their edited texts."""
    return syncmers.edited(table(spark, sf_dir, "documents"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, strings of 100 bytes."""
    return substrings.removed(table(spark, sf_dir, "documents")).drop("spans")


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of whole ``documents``; a token across a border counts for the line with most of it."""
    return attribution.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), rule="most")


@query("op10_piece_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` to SentencePiece ids and back."""
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")).drop("ids")


@query("op12_contamination", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(list_slice(ws, p, p + least(10, len(ws)) - 1), ' ') AS k
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
dw AS (SELECT r, m, p, array_to_string(list_slice(ws, p, p + m - 1), ' ') AS k
       FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(ws) >= m)),
met AS (SELECT r, p, m, item_id FROM dw JOIN iw USING (m, k)),
hit AS (SELECT r, count(DISTINCT p + o) AS n_hit FROM (SELECT DISTINCT r, p, m FROM met), range(0, 10) x(o) WHERE o < m GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (item_id IS NOT NULL)) AS ids FROM met GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against all windows of ten words of whole ``benchmark``."""
    found = contamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def _code_sql() -> str:
    """Integer k-means per part in DuckDB: distance and index in one number, so that ties go to the lower index."""
    steps = []
    for k in range(codes.ROUNDS + 1):
        steps.append(f"""a{k} AS (SELECT r, p, min(list_sum(list_transform(range(1, w + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j]))) * {codes.ENTRIES} + e) AS m FROM parts JOIN b{k} USING (p) GROUP BY r, p)""")
        if k < codes.ROUNDS:
            steps.append(f"""b{k + 1} AS (SELECT p, e, coalesce(n.c, b{k}.c) AS c FROM b{k} LEFT JOIN (SELECT p, e, list(f ORDER BY j) AS c FROM (
  SELECT p, m % {codes.ENTRIES} AS e, j, CAST(floor(sum(x[j]) / count(*)::DOUBLE) AS BIGINT) AS f FROM (SELECT p, x, m, unnest(range(1, w + 1)) AS j FROM parts JOIN a{k} USING (r, p)) GROUP BY ALL) GROUP BY p, e) n USING (p, e))""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, len(v) // {codes.PARTS} AS w, list_slice(v, p * (len(v) // {codes.PARTS}) + 1, (p + 1) * (len(v) // {codes.PARTS})) AS x FROM kept, range({codes.PARTS}) t(p)),
b0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {codes.ENTRIES}),
{', '.join(steps)},
done AS (SELECT r, string_agg(printf('%02x', m % {codes.ENTRIES}), '' ORDER BY p) AS code, CAST(sum(m // {codes.ENTRIES}) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{codes.ROUNDS}) AS codebooks_sha256
FROM kept JOIN done USING (r)"""


@query("op13_vector_codes", _code_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of whole ``embeddings``: 16 parts, 64 entries, two rounds."""
    return codes.coded_rows(table(spark, sf_dir, "embeddings"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, by a checksum of the id, go on with copies of one stretch of their words."""
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(digest / 10)

    def repeated(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " "))

    made = let(F.regexp_extract_all("text", F.lit(f"({WORD})")), repeated)
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (digest % 10 == 0), made).otherwise(F.col("text")).alias("text"))


@query("op11_word_runs", r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, xor(4294967295, list_reduce(
      list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
      lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM documents),
p AS (SELECT r, doc_id, ws, len(ws) AS n, h // 10 AS g, h % 10 = 0 AND len(ws) > 0 AS made FROM t),
w AS (SELECT r, doc_id, n, CASE WHEN made THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE ws END AS ws FROM p),
e AS (SELECT r, n, unnest(ws) AS word, unnest(range(0, n)) AS i FROM w WHERE n >= 24),
same AS (SELECT a.r, b.i - a.i AS q, a.i FROM e a JOIN e b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same) GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT r, s, l, min(q) AS q FROM stretch GROUP BY r, s, l),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY l / q::DOUBLE DESC, s, q) AS k FROM runs) WHERE k = 1),
lines AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT r, array_to_string(list_transform(list_filter(range(0, n), lambda i: NOT list_contains(out, i)), lambda i: ws[i + 1]), ' ') AS t FROM w JOIN (SELECT r, list(i) AS out FROM gone GROUP BY r) USING (r))
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, array_to_string(ws, ' '))) AS collapsed_sha256
FROM w LEFT JOIN top USING (r) LEFT JOIN lines USING (r) LEFT JOIN kept USING (r)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in whole ``documents``, a tenth of which are made periodic."""
    return periods.find(_with_periods(table(spark, sf_dir, "documents"))).drop("n_words", "runs")
