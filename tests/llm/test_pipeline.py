"""The pipeline: contracts of its stages, planted cases, and registered queries against their SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tracelake.functions.storage import cut
from tracelake.llm import quality

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)) else str(v)


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op")])
def test_query_against_its_sql(spark, con, name):
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = con.execute(sql).df()
    rows = lambda d: sorted((tuple(plain(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False)), key=str)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


def planted(spark):
    r = random.Random(7)
    words = [f"w{i}x" for i in range(3000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(60)
    rows = [(i, "\n".join(text(r.randint(20, 60)) for _ in range(4)), "en", f"s{i % 4}") for i in range(80)]
    rows += [(100 + i, rows[0][1], "en", "s0") for i in range(5)]  # exact copies
    near = text(400).split()
    for i in range(4):  # near copies on one line
        w = list(near)
        w[r.randrange(len(w))] = f"other{i}"
        rows.append((200 + i, " ".join(w), "en", "s1"))
    rows += [(300 + i, text(40) + "\n" + passage + "\n" + text(40), "de", "s2") for i in range(6)]
    rows += [(400, "too short", "en", "s0"), (401, "a b c d e " * 50, "en", "s0"), (402, None, "en", "s0"), (403, "", "en", "s0")]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long"), passage


def test_stages_do_their_work(spark):
    docs, passage = planted(spark)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = cut(docs)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    rules, lines, unique, mixed = seen
    assert not {400, 401, 402, 403} & set(rules) and len(rules) == 80 + 5 + 4 + 6
    assert set(lines) == set(rules) and sum(passage in t for t in lines.values()) == 1
    assert sum(1 for i in range(100, 105) if i in unique) + (0 in unique) <= 2  # emptied copies are one group
    assert sum(i in unique for i in range(200, 204)) == 1
    assert set(range(1, 80)) <= set(unique) and {300 + i for i in range(6)} <= set(unique)
    assert set(mixed) <= set(unique) and len(mixed) > 0.75 * len(unique)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert set(pieces.doc_id) == set(mixed)
    for _, g in pieces.groupby("doc_id"):
        assert g.length.sum() == g.doc_tokens.iloc[0]


def test_run_and_empty_input(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_names_of_helpers_may_clash(spark):
    docs, _ = planted(spark)
    odd = docs.withColumns({n: F.lit(i) for i, n in enumerate(("__m", "__f", "__host", "__id", "__h", "__gone", "__removed", "__keep", "__mix", "__cell", "__w", "__x", "__b", "rejected", "host", "draw"))})
    for name, stage in corpus_pipeline.STAGES:
        plain_, more = stage(spark, docs, DATA), stage(spark, odd, DATA)
        if name != "packing":
            assert more.columns == odd.columns, name
        assert sorted(map(str, more.select("doc_id").collect())) == sorted(map(str, plain_.select("doc_id").collect())), name


def test_hosts_fall_by_the_posterior(spark):
    r = random.Random(3)
    good = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(60))
    rows = [(h * 1000 + i, "bad" if r.random() < (0.45 if h == 0 else 0.08) else good(), f"h{h}") for h in range(25) for i in range(120)]
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {x["source"] for x in kept} == {f"h{h}" for h in range(1, 25)}
    assert len(kept) == sum(t != "bad" and s != "h0" for _, t, s in rows)
    even = [(i, "bad" if i % 12 == 0 else good(), f"h{i % 20}") for i in range(2000)]  # no host differs by more than chance
    assert len({x["source"] for x in quality.keep_good(spark.createDataFrame(even, "doc_id long, text string, source string")).collect()}) == 20
