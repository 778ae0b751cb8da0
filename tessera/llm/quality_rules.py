"""Quality rules with host verdicts, in DataFrame expressions only.

Each document is measured (words, symbols, repeated lines, repeated 5-word windows) and checked
against a few rules. Failures are counted by host, each host's rate is shrunk towards the corpus
with a beta prior fitted to the hosts by moments, and a host whose shrunk rate passes the limit for
any rule is rejected: the verdict goes back to its documents.

Defined cases: a null text is the empty text (no words, so it fails the base rules); a null host is
a host of its own; repeated rows are measured and returned one by one; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.

Scale: the measuring is one narrow pass; its few numbers per document are checkpointed, so that
the text is read once. Failures reduce map-side to one row per task and host, and the verdict join
has one row per host on its small side (AQE splits a hot host on the other side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength (alpha + beta), in documents.
STRENGTH = (2.0, 1.0e6)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A 5-word window is known by a 64-bit hash whose low bits give way to its place, so that one
    sort of longs brings equal windows together: n log n per document. Windows that have an equal
    there are sorted again by the whole hash, which alone says what is equal.
    """
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    a = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host"),
                    F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"),
                    F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
                    (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    lines.alias("lines"))
    b = a.select("doc_id", "host", "word_chars", "n_symbols",
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    window = ", ".join(f"get(h, i + {k})" for k in range(WINDOW))
    c = b.withColumn("bits", F.length(F.bin(F.col("n").cast("long")))).withColumn("s", F.expr(
        f"sort_array(if(n >= {WINDOW}, transform(sequence(0, n - {WINDOW}), i -> "
        f"shiftleft(shiftright(xxhash64({window}), bits), bits) | cast(i as bigint)), cast(array() as array<bigint>)))"))
    whole = ", ".join(f"get(h, cast(x & (shiftleft(1L, bits) - 1L) as int) + {k})" for k in range(WINDOW))
    v = c.withColumn("v", F.expr(
        "sort_array(transform(filter(s, (x, k) -> shiftright(x, bits) = shiftright(get(s, k - 1), bits) "
        "or shiftright(x, bits) = shiftright(get(s, k + 1), bits)), "
        f"x -> struct(xxhash64({whole}) as g, x & (shiftleft(1L, bits) - 1L) as i)))"))
    d = v.withColumn("at", F.expr(
        "sort_array(transform(filter(v, (x, k) -> x.g = get(v, k - 1).g or x.g = get(v, k + 1).g), x -> x.i))"))
    repeat = F.expr(f"aggregate(transform(at, (x, k) -> least({WINDOW}L, coalesce(get(at, k + 1) - x, {WINDOW}L))), "
                    "0L, (acc, x) -> acc + x)")
    return d.select("doc_id", "host", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines",
                    "n_dup_lines", repeat.alias("n_repeat_words"))


def rule_flags() -> dict[str, Column]:
    """Rule name -> boolean column (true: fails), in integers so that every engine agrees."""
    n, c = F.col("n_words"), F.col("word_chars")
    return {"short": n < 10,
            "repeats": F.col("n_repeat_words") * 100 > n * 20,
            "symbols": F.col("n_symbols") * 10 > n,
            "dup_lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
            "word_length": (c < n * 2) | (c > n * 15)}


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_rejected, host_worst_rate from the measured documents.

    Per rule, with p the corpus rate and v the variance of the raw rates over hosts, the prior is
    Beta(p s, (1 - p) s), s = p (1 - p) / v - 1 within STRENGTH; the shrunk rate of a host with k
    failures in n documents is (k + p s) / (n + s).
    """
    flags = rule_flags()
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(flags[r].cast("long")).alias(r) for r in RULES])
    rates = hosts.select("host", "n", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("k")) for r in RULES])).alias("x")).select("host", "n", "x.rule", "x.k")
    p, v = F.sum("k") / F.sum("n"), F.var_pop(F.col("k") / F.col("n"))
    prior = rates.groupBy("rule").agg(p.alias("p"), v.alias("v")).select(
        "rule", "p", F.when(F.col("v") > 0, F.least(F.lit(STRENGTH[1]), F.greatest(
            F.lit(STRENGTH[0]), F.col("p") * (1 - F.col("p")) / F.when(F.col("v") > 0, F.col("v")) - 1))).otherwise(F.lit(STRENGTH[1])).alias("s"))
    shrunk = (F.col("k") + F.col("p") * F.col("s")) / (F.col("n") + F.col("s"))
    worst = rates.join(F.broadcast(prior), "rule").groupBy("host").agg(F.max(shrunk).alias("host_worst_rate"))  # prior: one row a rule
    return worst.select("host", "host_worst_rate", (F.col("host_worst_rate") > max_rate).alias("host_rejected"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Measures, rule flags, base and host verdicts: one row per row of ``docs``."""
    m = checkpoint(measure(docs, id_col, text_col, host_col))
    v = host_verdicts(m, max_rate).withColumnRenamed("host", "vhost")
    flags = rule_flags()
    joined = m.join(v, m["host"].eqNullSafe(v["vhost"]), "left").drop("vhost")
    return joined.select("*", *[flags[r].alias(f"fails_{r}") for r in RULES],
                         (flags["short"] | flags["repeats"]).alias("base_failed"))


def digest(result: DataFrame) -> DataFrame:
    """The columns of the query ``op9_quality_rules``."""
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~rejected).alias("kept"))


#: DuckDB: the same measures, rules, prior and verdicts.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) ELSE [] END) AS i, w FROM w),
gg AS (SELECT rid, i, list_slice(w, i, i + 4) AS gram FROM g),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM gg) WHERE c > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nx - i, 5))) AS n_repeat_words
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM rep) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.rid, doc_id, host, CAST(len(w.w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (rid) JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 10 AS r1, n_repeat_words * 100 > n_words * 20 AS r2, n_symbols * 10 > n_words AS r3,
        n_dup_lines * 10 > n_lines * 3 AS r4, (word_chars < n_words * 2 OR word_chars > n_words * 15) AS r5 FROM m),
hosts AS (SELECT host, count(*) AS n, [sum(r1::INT), sum(r2::INT), sum(r3::INT), sum(r4::INT), sum(r5::INT)] AS ks FROM f GROUP BY host),
rates AS (SELECT host, n, unnest(range(1, 6)) AS rule, unnest(ks) AS k FROM hosts),
prior AS (SELECT rule, sum(k)::DOUBLE / sum(n) AS p, var_pop(k::DOUBLE / n) AS v FROM rates GROUP BY rule),
strength AS (SELECT rule, p, CASE WHEN v > 0 THEN least(1e6, greatest(2.0, p * (1 - p) / v - 1)) ELSE 1e6 END AS s FROM prior),
verdict AS (SELECT host, max((k + p * s) / (n + s)) > 0.5 AS rejected FROM rates JOIN strength USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r1 OR r2) AS base_failed,
       NOT (r1 OR r2) AND NOT rejected AS kept
FROM f JOIN verdict ON f.host IS NOT DISTINCT FROM verdict.host
"""
