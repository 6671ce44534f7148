"""Mixing sources to target weights: raking of token totals to marginals, then sampling by calibrated probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.storage import cut
from tracelake.llm.common import WORD, free, table, unit_hash

#: Topics by what a text holds; the first that fits. The rest is "prose".
TOPICS = {"legal": r"(?i)licen[cs]e|copyright", "symbols": r"[#*$%&|<>]{3}", "web": r"https?://|www\.|@[a-z]+\.[a-z]"}
#: Exponent by which natural shares become targets (1: as they are; 0: all equal), rounds of raking, and the share of tokens that stays.
TEMPER, ROUNDS, KEEP = 0.7, 50, 0.8
#: Cells that the driver rakes at most (about 100 MB); more are raked by Spark.
DRIVER_CELLS = 1_000_000
#: Cells that are sent to all tasks at most (some 20 MB); more are joined by a shuffle.
BROADCAST_CELLS = 200_000
#: Raking ends before its last round if no factor moves by more than this share.
STILL = 1e-13
_DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(list(TOPICS.items())):
        out = F.when(F.regexp_like(F.coalesce(text, F.lit("")), F.lit(pattern)), name).otherwise(out)
    return out


def targets_of(cells: DataFrame, temper: float) -> list[DataFrame]:
    """Target shares by dimension: natural token shares to the power of ``temper``."""
    out = []
    for d in _DIMENSIONS:
        shares = cells.groupBy(d).agg(F.sum("tokens").alias("t")).filter("t > 0").withColumn("w", F.pow(F.col("t").cast("double"), F.lit(temper)))
        whole = shares.agg(F.sum("w")).first()[0] or 1.0
        out.append(shares.select(F.col(d).alias(f"{d}_"), (F.col("w") / F.lit(whole)).alias("goal")))
    return out


def rake(tokens: np.ndarray, codes: np.ndarray, goals: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Iterative proportional fitting: factors of cells such that, for each dimension in turn, the shares of ``tokens`` times
    factor by the codes of that dimension are its goals."""
    fitted = tokens / max(tokens.sum(), 1e-300)
    for _ in range(rounds):
        before = fitted
        for d, goal in enumerate(goals):
            now = np.bincount(codes[:, d], fitted, len(goal))
            fitted = fitted * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[codes[:, d]]
        if (np.abs(fitted - before) <= STILL * before).all():
            break
    return np.divide(fitted, tokens / max(tokens.sum(), 1e-300), out=np.zeros(len(tokens)), where=tokens > 0)


def calibrate(tokens: np.ndarray, factor: np.ndarray, keep: float) -> np.ndarray:
    """Probabilities min(1, c * factor) with c such that the expected tokens are ``keep`` of all (or all that factors allow)."""
    order = np.argsort(-factor, kind="stable")
    t, r = tokens[order].astype(float), factor[order]
    budget, sure, rest = keep * t.sum(), 0.0, float((t * r).sum())
    c = 0.0
    for k in range(len(t) + 1):
        c = (budget - sure) / rest if rest > 1e-12 else np.inf
        if k == len(t) or r[k] <= 0 or c * r[k] <= 1:
            break
        sure += t[k]
        rest -= t[k] * r[k]
    p = np.zeros(len(tokens))
    p[factor > 0] = np.minimum(1.0, c * factor[factor > 0])
    return np.round(p, 9)


def rake_cells(cells: DataFrame, temper: float = TEMPER, keep: float = KEEP, rounds: int = ROUNDS, targets: dict[str, dict] | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """cells (source, lang, topic, tokens; distinct) with ``probability``. A table with a row for each cell, not document:
    up to ``driver_cells`` rows the driver rakes it, beyond that Spark does, with the same result."""
    cells = cut(cells)
    spark = cells.sparkSession
    if targets is None:
        goals = targets_of(cells, temper)
    else:
        goals = []
        for d in _DIMENSIONS:
            whole = sum(targets[d].values())
            goals.append(spark.createDataFrame([(k, v / whole) for k, v in targets[d].items()], f"{d}_ string, goal double"))
    if cells.count() <= driver_cells:
        pdf = cells.toPandas()
        codes, want = np.zeros((len(pdf), 3), dtype=np.int64), []
        for k, (d, g) in enumerate(zip(_DIMENSIONS, goals)):
            of = {(r[0],): r[1] for r in g.collect()}  # fewer rows than cells
            names: dict = {}
            codes[:, k] = [names.setdefault((None if v is None or v != v else v,), len(names)) for v in pdf[d]]
            want.append(np.array([of.get(n, 0.0) for n in names]))
        tokens = pdf["tokens"].to_numpy(dtype=float)
        pdf["probability"] = calibrate(tokens, rake(tokens, codes, want, rounds), keep) if len(pdf) else []
        rows = [tuple(None if x is None or x != x else x for x in r) for r in pdf.itertuples(index=False)]
        return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, probability double")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    t = cells.withColumn("fitted", F.col("tokens") / F.lit(float(total)))
    for k in range(rounds):
        for d, g in zip(_DIMENSIONS, goals):
            now = t.groupBy(F.col(d).alias("d_")).agg(F.sum("fitted").alias("now"))
            step = now.join(g, F.col("d_").eqNullSafe(F.col(f"{d}_")), "left").select("d_", F.when(F.col("now") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("now")).otherwise(0.0).alias("by"))
            t = t.join(step, F.col(d).eqNullSafe(F.col("d_"))).withColumn("fitted", F.col("fitted") * F.col("by")).drop("d_", "by")
        t = cut(t)
    t = cut(t.withColumn("factor", F.when(F.col("tokens") > 0, F.col("fitted") * F.lit(float(total)) / F.col("tokens")).otherwise(0.0)))
    c, sure = 0.0, 0.0
    for _ in range(200):  # what is sure to stay grows until nothing else would
        s = t.agg(F.sum(F.when(F.col("factor") * F.lit(c) > 1, F.col("tokens"))).alias("sure"), F.sum(F.when(F.col("factor") * F.lit(c) <= 1, F.col("tokens") * F.col("factor"))).alias("rest")).first()
        new = (keep * total - (s["sure"] or 0)) / s["rest"] if (s["rest"] or 0) > 1e-12 else float("inf")
        if new == c or new == float("inf"):
            c = new
            break
        c = new
    p = F.when(F.col("factor") > 0, F.least(F.lit(1.0), F.lit(c) * F.col("factor"))).otherwise(0.0) if c != float("inf") else F.when(F.col("factor") > 0, 1.0).otherwise(0.0)
    return t.select(*_DIMENSIONS, "tokens", F.round(p, 9).alias("probability"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, name: str = "__mix", **how) -> DataFrame:
    """``docs`` with a struct ``name``: tokens (words), topic, probability and sampled.

    A row is sampled if the hash of its key, a number in [0, 1), is under the probability of its cell: the same rows in every
    run, whatever the partitions. A null key is hashed as its text is. Rows without tokens (null, empty texts) belong to
    cells like others and have their probability; null sources, languages are values; repeated rows have one fate; an
    empty table gives an empty one. A column that has the name is replaced, no other is touched. Cells are summed in each
    task before they are shuffled, and sent to all tasks if their count is under BROADCAST_CELLS: no text is shuffled then."""
    topic = topic_of(F.col(text)) if topic is None else topic
    tokens = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    draw = unit_hash(F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))), "mix")
    own = F.struct(tokens.alias("tokens"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), topic.alias("topic"), draw.alias("draw"))
    got = rake_cells(docs.select(own.alias("m")).select("m.tokens", *[f"m.{d}" for d in _DIMENSIONS]).groupBy(*_DIMENSIONS).agg(F.sum("tokens").alias("tokens")), **how)
    cell = free([*docs.columns, name], "__cell")[0]
    got = got.select(F.struct(*[F.col(d).alias(d) for d in _DIMENSIONS], "probability").alias(cell))
    rest = [c for c in docs.columns if c.lower() != name.lower()]
    marked = docs.select(*[F.col(f"`{c}`") for c in rest], own.alias(name))
    on = F.lit(True)
    for d in _DIMENSIONS:
        on = on & F.col(f"{name}.{d}").eqNullSafe(F.col(f"{cell}.{d}"))
    met = marked.join(F.broadcast(got) if got.count() <= BROADCAST_CELLS else got, on)
    p = F.col(f"{cell}.probability")
    out = F.struct(f"{name}.tokens", f"{name}.topic", p.alias("probability"), (F.col(f"{name}.draw") < p).alias("sampled"))
    return met.select(*[F.col(f"`{c}`") for c in rest], out.alias(name))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, sampling probability and decision of every document, raked to tempered shares of source, language and topic."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).select("doc_id", "source", "lang", "__mix.*")


def _sql() -> str:
    case = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPICS.items())
    out = [
        f"d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, text FROM documents), c AS (SELECT doc_id, source, lang, CASE {case} ELSE 'prose' END AS topic, len(regexp_extract_all(t, '{WORD}')) AS tokens, t FROM d)",
        "s0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(tokens) / sum(sum(tokens)) OVER () AS f FROM c GROUP BY ALL)",
    ]
    for d in _DIMENSIONS:
        out.append(f"g_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens), {TEMPER}) / sum(pow(sum(tokens), {TEMPER})) OVER () AS goal FROM s0 GROUP BY {d} HAVING sum(tokens) > 0)")
    k = 0
    for _ in range(ROUNDS):
        for d in _DIMENSIONS:
            out.append(f"s{k + 1} AS MATERIALIZED (SELECT s.source, s.lang, s.topic, s.tokens, s.f * coalesce(g.goal, 0) / nullif(sum(s.f) OVER (PARTITION BY s.{d}), 0) AS f FROM s{k} s LEFT JOIN g_{d} g ON s.{d} IS NOT DISTINCT FROM g.{d})")
            k += 1
    out += [
        f"r AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN coalesce(f, 0) / (tokens / sum(tokens) OVER ()) ELSE 0 END AS r FROM s{k})",
        f"o AS MATERIALIZED (SELECT *, {KEEP} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget, sum(tokens * r) OVER (ORDER BY r DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r)",
        "x AS (SELECT max(budget / rest) FILTER (rest > 1e-12 AND budget / rest * r <= 1) AS c FROM o)",
        "p AS (SELECT source, lang, topic, round(CASE WHEN r > 0 THEN least(1.0, (SELECT c FROM x) * r) ELSE 0 END, 9) AS probability FROM r)",
    ]
    draw = "(CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), md5(t))), 1, 8) AS BIGINT) / 4294967296.0)"
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, c.source, c.lang, CAST(tokens AS BIGINT) AS tokens, c.topic, probability, {draw} < probability AS sampled FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source AND c.lang IS NOT DISTINCT FROM p.lang AND c.topic = p.topic"


OP3_SQL = _sql()
