"""Quality rules of documents and of their hosts, in SQL functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.storage import cut, written
from tracelake.llm.common import WORD, free, let, table

#: Rules by which a host is judged: name -> condition on the measures.
HOST_RULES = {
    "base": "n_words < 10 or 100 * n_repeat_words > 20 * n_words",
    "symbols": "n_words > 0 and 10 * n_symbols > 3 * n_words",
    "lines": "n_lines > 1 and 10 * n_dup_lines > 3 * n_lines",
}
#: A host is rejected if, for some rule, its shrunk failure rate is surely (by SURE deviations of the posterior) more than
#: FAR deviations of the prior over the mean of all hosts; this limit is LEAST at least and MOST at most.
SURE, FAR, LEAST, MOST = 2.0, 3.0, 0.25, 0.5
#: Rejected hosts up to this many (some 10 MB) are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def repeat_words(words: Column, window: int = 5) -> Column:
    """How many words lie in a run of ``window`` words that the array holds twice or more.

    Runs are compared by a 64-bit hash. Sorted by (hash, place), equal runs are neighbours; the places that remain, in
    order, cover min(window, gap to the next) words each."""

    def covered(runs: Column) -> Column:
        size = F.size(runs)
        twice = F.transform(
            runs,
            lambda x, i: F.when(
                ((i > 0) & (F.get(runs, i - 1)["h"] == x["h"])) | ((i < size - 1) & (F.get(runs, i + 1)["h"] == x["h"])), x["p"]
            ),
        )
        return let(F.array_sort(F.filter(twice, lambda p: p.isNotNull())), gaps)

    def gaps(at: Column) -> Column:
        each = F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda p: F.struct(F.xxhash64(F.slice(w, p, window)).alias("h"), p.alias("p")))
        return let(F.array_sort(each), covered)

    return let(words, lambda w: F.when(F.size(w) > window, runs(w)).otherwise(F.lit(0).cast("long")))


def measures(docs: DataFrame, text: str = "text", name: str = "__m") -> DataFrame:
    """``docs`` with a struct ``name``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text has no words and no lines. Every row has its own measures, repeated rows too; an empty table gives an empty
    one. No column of ``docs`` is touched; one that has the name is replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    space = " \t\n\x0b\x0c\r"
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, space, "") != "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("again")))
    each = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("unlike")))
    bare = F.translate(t, space, "")
    w, x, b = free([*docs.columns, name], "__w", "__x", "__b")
    made = docs.withColumn(w, counts).withColumn(x, each).withColumn(b, F.length(bare).cast("long"))
    fields = [
        F.col(f"{w}.n").alias("n_words"), F.col(f"{w}.again").alias("n_repeat_words"), F.col(b).alias("word_chars"),
        (F.col(b) - F.length(F.translate(bare, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.col(f"{x}.n").alias("n_lines"), (F.col(f"{x}.n") - F.col(f"{x}.unlike")).alias("n_dup_lines"),
    ]
    return made.withColumn(name, F.struct(*fields)).drop(w, x, b)


def host_verdicts(fails: DataFrame) -> DataFrame:
    """``host, rejected``: for each host and rule the failure rate is drawn to that of all hosts by a beta prior, whose
    mean and strength are fitted to the hosts' rates by moments; a host far out of the prior (see SURE) is rejected.

    ``fails`` has columns host and f_<rule> (booleans). Rows are pre-summed in each task, so a hot host is no hot task; only
    the prior, one row, comes to the driver. A null host is a host of its own. If hosts do not differ more than chance
    allows, the prior is as strong as all rows together, and none is rejected but for a rate over MOST."""
    names = [f"f_{r}" for r in HOST_RULES]
    by = cut(fails.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(c) for c in names]))
    total = by.agg(
        F.sum("n").alias("n"), F.count("*").alias("hosts"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mean_n"),
        *[(F.sum(c) / F.sum("n")).alias(f"m_{c}") for c in names],
        *[F.sum(F.col(c) * F.col(c) / F.col("n")).alias(f"q_{c}") for c in names],
    ).first()
    rejected = F.lit(False)
    for c in names if total["n"] else []:
        n, m = total["n"], total[f"m_{c}"]
        # variance between hosts by moments: what their rates vary more than chance lets them
        between = (total[f"q_{c}"] - n * m * m - (total["hosts"] - 1) * m * (1 - m)) / (n - total["mean_n"]) if n > total["mean_n"] else 0.0
        strength = max(m * (1 - m) / between - 1, 0.0) if between > 0 else float(n)
        limit = min(max(m + FAR * (m * (1 - m) / (strength + 1)) ** 0.5, LEAST), MOST)
        rate = (F.col(c) + F.lit(strength * m)) / (F.col("n") + F.lit(strength))
        rejected = rejected | (rate - F.lit(SURE) * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(strength + 1))) > F.lit(limit))
    return by.select("host", rejected.alias("rejected"))


def _rules(m: str = "__m") -> dict[str, Column]:
    return {r: F.expr(re.sub(r"\bn_", f"{m}.n_", c)) for r, c in HOST_RULES.items()}


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that base rules and host verdicts keep, all columns as they were.

    Texts are measured once: rows go with their rules' outcome to a table in the shared folder, of which the hosts' rates
    read two columns. Rejected hosts are few, and sent to all tasks if their count says so, so that no text is shuffled.
    Null and empty texts have no words and go; null hosts are a host; repeated rows are rows like others; an empty table
    gives an empty one. Helper columns have names that no column has."""
    m, f = free(docs.columns, "__m", "__f")
    rules = F.struct(*[c.alias(f"f_{r}") for r, c in _rules(m).items()])
    judged = written(measures(docs, text, m).withColumn(f, rules).drop(m))
    bad = host_verdicts(judged.select(F.col(host).alias("host"), f"{f}.*")).filter("rejected")
    h = free(docs.columns, "__host")[0]
    names, few = bad.select(F.col("host").alias(h)), bad.count() <= BROADCAST_ROWS
    kept = judged.filter(~F.col(f"{f}.f_base"))
    return kept.join(F.broadcast(names) if few else names, F.col(host).eqNullSafe(F.col(h)), "left_anti").drop(f)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document (null texts: zero words, so base_failed)."""
    m = cut(measures(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "__m"))
    bad = host_verdicts(m.select(F.col("source").alias("host"), *[c.alias(f"f_{r}") for r, c in _rules().items()])).filter("rejected")
    met = m.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, F.col("source").eqNullSafe(F.col("host")), "left")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = _rules()["base"]
    return met.select("doc_id", *[F.col(f"__m.{c}") for c in names], base.alias("base_failed"), (~base & F.col("rejected").isNull()).alias("kept"))


_M = {
    "n_words": "len(w)",
    "word_chars": "coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)",
    "n_symbols": "length(t) - length(translate(t, '#*$%&|<>', ''))",
    "n_lines": "len(l)",
    "n_dup_lines": "len(l) - len(list_distinct(l))",
}
OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
a AS (SELECT row_number() OVER () AS r, doc_id, source, t, regexp_extract_all(t, '{WORD}') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM a),
g AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS five FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM g WHERE five IS NOT NULL),
q AS (SELECT r, sum(least(5, coalesce(nx - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM c WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, source, {", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _M.items())}, CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words FROM a LEFT JOIN q USING (r)),
f AS (SELECT *, {", ".join(f"({v}) AS f_{k}" for k, v in HOST_RULES.items())} FROM m),
h AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (f_{k}) AS x_{k}" for k in HOST_RULES)} FROM f GROUP BY source),
s AS (SELECT sum(n) AS nn, count(*) AS hh, sum(n * n) / sum(n) AS ss, {", ".join(f"sum(x_{k}) / sum(n) AS m_{k}, sum(x_{k} * x_{k} / n) AS q_{k}" for k in HOST_RULES)} FROM h),
b AS (SELECT *, {", ".join(f"(q_{k} - nn * m_{k} * m_{k} - (hh - 1) * m_{k} * (1 - m_{k})) / nullif(nn - ss, 0) AS b_{k}" for k in HOST_RULES)} FROM s),
k AS (SELECT *, {", ".join(f"coalesce(CASE WHEN b_{k} > 0 THEN greatest(m_{k} * (1 - m_{k}) / b_{k} - 1, 0) ELSE nn END, nn) AS k_{k}" for k in HOST_RULES)} FROM b),
o AS (SELECT source, {", ".join(f"(x_{k} + k_{k} * m_{k}) / (n + k_{k}) AS r_{k}, n + k_{k} + 1 AS e_{k}, least(greatest(m_{k} + {FAR} * sqrt(m_{k} * (1 - m_{k}) / (k_{k} + 1)), {LEAST}), {MOST}) AS l_{k}" for k in HOST_RULES)} FROM h, k),
v AS (SELECT source, {" OR ".join(f"r_{k} - {SURE} * sqrt(r_{k} * (1 - r_{k}) / e_{k}) > l_{k}" for k in HOST_RULES)} AS rejected FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base AS base_failed, NOT f_base AND NOT rejected AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
