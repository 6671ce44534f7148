"""SimHash groups and fuzzy line deduplication against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tracelake.llm import blocks, linededup, simhash
from tracelake.operators.components import connected_components

DOCS = "doc_id long, text string, fp string, root int"  # clashing names on purpose


def brute_fp(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(keys, linked):
    low = list(range(len(keys)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(keys)):
        out.setdefault(find(i), []).append(i)
    return [g for g in out.values()]


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (400, 350, 90, 40, 3, 2, 1)]
    out = base + [None, "", " \t\n", "É" * 5000, base[0].upper(), base[1] + "  \n", base[0]]
    for _ in range(30):
        w = base[0].split()
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    return out


def test_groups_match_brute_force(spark):
    rows = [(i * 3 % 101, t, "x", 1) for i, t in enumerate(texts())] + [(None, "a b c d", "y", 2), (0, texts()[0], "x", 1)]
    got = {(r["id"], r["fp"] & (2**64 - 1), r["component"]) for r in simhash.groups(spark.createDataFrame(rows, DOCS)).collect()}
    fp = [brute_fp(t, 3) for _, t, *_ in rows]
    want = set()
    for g in brute_groups(rows, lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3):
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        want |= {(rows[i][0], fp[i], min(ids, default=None)) for i in g}
    assert got == want
    assert len({c for *_, c in want}) < len(rows) - 20  # the near copies did link


def test_empty_and_keep_one(spark):
    assert simhash.groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f g", "p", 1), (1, "a b c d e f g", "p", 1), (2, "A B c d e f g", "q", 2), (None, "a b c d e f g", "r", 3), (5, "zz", "s", 4)]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "fp", "root"]
    assert sorted((r["doc_id"] or 0, r["fp"]) for r in kept.collect()) == [(0, "r"), (1, "p"), (5, "s")]


@pytest.mark.parametrize("n,tile", [(1000, 2048), (1000, 16), (1 << 20, 64)])
def test_links_lose_none(spark, n, tile):
    r = random.Random(n + tile)
    near = [r.getrandbits(64) for _ in range(40)]
    for _ in range(250):  # chains: the far ends differ in many bits
        x = near[-1]
        for _ in range(r.randint(1, 4)):
            x ^= 1 << r.randrange(64)
        near.append(x)
    near = sorted(set(near))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in near], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(blocks.links(df, n, 3, tile=tile)).collect()}
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    for g in brute_groups(near, lambda i, j: (near[i] ^ near[j]).bit_count() <= 3):
        ids = [sign(near[i]) for i in g]
        assert {roots.get(i, i) for i in ids} == {min(ids)}


def test_components_of_a_long_path_and_a_hub(spark):
    e = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_edit_distance():
    def brute(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d = d, [i]
            for j, y in enumerate(b, 1):
                d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
        return d[-1]

    r = random.Random(1)
    for _ in range(600):
        a = [r.choice("abc") for _ in range(r.randint(0, 14))]
        b = [r.choice("abc") for _ in range(r.randint(0, 14))]
        for k in range(0, 15, 3):
            assert linededup.distance_within(a, b, k) == (brute(a, b) <= k)
    assert linededup.distance_within("x" * 30000, "x" * 15000 + "y" + "x" * 15000, 1)


def test_lines_match_brute_force(spark):
    r = random.Random(2)
    words = [f"wo{i}rd" for i in range(80)]
    passages = [" ".join(r.choice(words) for _ in range(n)) for n in (60, 55, 30, 8, 5, 3)]
    rows = []
    for i in range(40):
        lines = [r.choice(passages) if r.random() < 0.6 else " ".join(r.choice(words) for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 5))]
        if r.random() < 0.4:
            lines[0] = lines[0].upper() + "!"
        if r.random() < 0.4 and len(lines[-1].split()) > 20:
            lines[-1] = lines[-1].replace("wo1", "wo2", 1)
        rows.append((i, "\n".join(lines), "x", i))
    rows += [(100, None, "n", 0), (101, "", "e", 0), (None, passages[0], "k", 0), (39, rows[39][1], "x", 39), (102, "\n" + "long line " * 20000, "l", 0)]
    got = {(r["doc_id"], r["root"], r["text"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    h = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    seen, lines = set(), []
    for d, t, *_ in rows:
        if (d, t) not in seen and t is not None:
            seen.add((d, t))
            lines += [((d is not None, d or 0, sign(h(t)), k), linededup.normal(x)) for k, x in enumerate(t.split("\n")) if len(linededup.normal(x)) >= 5 or len(b" ".join(linededup.normal(x)).decode()) >= 8]
    same = linededup.alike(0.8)
    gone = set()
    for g in brute_groups(lines, lambda i, j: lines[i][1] == lines[j][1] or min(len(lines[k][1]) for k in (i, j)) >= 5 and same(*(b" ".join(lines[k][1]).decode() for k in (i, j)))):
        gone |= {lines[i][0] for i in g} - {min(lines[i][0] for i in g)}
    want = set()
    for d, t, _, root in rows:
        keep = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d is not None, d or 0, sign(h(t)), k) not in gone)
        want.add((d, root, keep))
    assert got == want and gone
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_one_reaches_similarity(spark):
    r = random.Random(9)
    words = [f"v{i}" for i in range(4000)]
    rows, sets = [], []
    for g in range(40):  # copies of 0.7 to 0.99 similarity, each of its own base
        base = [r.choice(words) for _ in range(r.choice((60, 200, 600)))]
        rows.append((2 * g, " ".join(base)))
        for at in r.sample(range(0, len(base), 6), max(1, len(base) * (g % 8) // 200)):
            base[at] = f"new{g}x{at}"
        rows.append((2 * g + 1, " ".join(base)))
    rows += [(900, ""), (901, None), (902, "one two"), (903, "one  two")]
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    far = lambda a, b: len(a & b) < 0.8 * len(a | b)
    want = {rows[g[0]][0] for g in brute_groups(rows, lambda i, j: not far(sets[i], sets[j]))}
    got = {d["doc_id"] for d in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 45 < len(want) < 80


def test_lines_by_edit_similarity_alone(spark):
    r = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    lines = []
    for n in (5, 6, 8, 9) * 12:  # of these no link may be lost
        base = [r.choice(words) for _ in range(n)]
        lines.append(base)
        for _ in range(3):
            w = list(base)
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice(([], [r.choice(words)], [w[at], r.choice(words)]))
            lines.append(w)
    lines = [w for w in lines if len(w) >= 5]
    r.shuffle(lines)
    rows = [(i, " ".join(w)) for i, w in enumerate(lines)]
    same = linededup.alike(0.8)
    want = {g[0] for g in brute_groups(rows, lambda i, j: same(rows[i][1], rows[j][1]))}
    got = {d["doc_id"] for d in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if d["text"]}
    assert got == want and len(want) < 0.5 * len(rows)


@pytest.mark.parametrize("share,least", [(0.2, 0.9), (0.15, 0.96), (0.1, 0.99)])
def test_recall_of_line_pairs(spark, share, least):
    """Each pair stands alone; brute force by edit similarity says which are pairs at all."""
    r = random.Random(int(100 * share))
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    rows, near = [], 0
    same = linededup.alike(0.8)
    for k in range(600):
        base = [r.choice(words) for _ in range(r.choice((10, 15, 20, 30, 50, 80, 150)))]
        w = list(base)
        for at in r.sample(range(len(base)), max(1, int(share * len(base)))):
            w[at] = r.choice(words)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(w))]
        near += same(rows[-1][1], rows[-2][1])
    left = sum(bool(d["text"]) for d in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert near == 600 and len(rows) - left >= least * near


def test_line_sketches():
    texts = [linededup.folded(t) for t in ("One two\n\n  three,four 77\n \n\u65e5\u672c x", "", "\t", "end.")]
    owner, number, n, size, e = linededup.words_of(texts)
    assert owner.tolist() == [0, 0, 0, 3] and number.tolist() == [0, 2, 4, 0] and n.tolist() == [2, 3, 2, 1] and size.tolist() == [6, 11, 7, 3]
    assert e.tolist() == [xxhash.xxh64_intdigest(w) for w in "one two three four 00 \u65e5\u672c x end".encode().split()]
    a, b = linededup.sums(np.array([1, 2, 2, 1, 1, 2], dtype=np.uint64), np.array([2, 2, 2]))
    assert a[0] == a[2] != a[1] and b[0] == b[2] != b[1]


def test_short_and_unspaced_lines(spark):
    long = "\u6211\u5011\u5728\u9019\u88e1" * 60
    rows = [(1, f"Subscribe to news\n{long}\n}}\nshort"), (2, f"subscribe to NEWS!\n{long}\n}}\nshort"), (3, "Subscribe to views")]
    got = {d["doc_id"]: d["text"] for d in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "}\nshort", 3: rows[2][1]}


def test_keys_that_lines_share():
    r = random.Random(3)
    rows = [([r.randint(0, 60) if r.random() < 0.8 else 7 for _ in range(r.randint(0, 4))], r.randint(0, 30) if r.random() < 0.5 else 1000 + i) for i in range(900)]
    flat = {(k, s) for ks, s in rows for k in ks}
    flat |= {(10_000 + i, i) for i in range(50)}  # keys of one line alone
    rows += [([10_000 + i], i) for i in range(50)]
    want = {(k, s) for k, s in flat if len({y for x, y in flat if x == k}) > 1}
    for size, parts in ((1, 3), (7, 1), (100, 4), (2000, 2)):
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + size]], pa.list_(pa.int64())), pa.array([s for _, s in rows[i : i + size]], pa.int64())], names=["keys", "short"]) for i in range(0, len(rows), size)]
        packed = sorted(((p, v) for b in linededup._packed(parts)(iter(batches)) for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), key=lambda x: x[0])
        out = pa.RecordBatch.from_arrays([pa.array([p for p, _ in packed], pa.int64()), pa.array([v for _, v in packed], pa.binary())], names=["part", "pairs"])
        got = {(k, s) for b in linededup._shared(parts)(iter([out])) for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        assert got == want, (size, parts)


def test_driver_gets_the_map_of_lines_in_stretches(spark, monkeypatch):
    kind, sent = type(spark.range(0)), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: sent.append(collect(df)) or sent[-1])
    rows = spark.range(50_000).selectExpr("xxhash64(id) AS h", "cast(id % 300 AS int) AS line")
    bits, marks = linededup._bit_map(rows, 50_000)
    assert len(sent) == 1 and len(sent[0]) <= len(marks) // 1000  # not a row for each word
    h, line = (np.array(c) for c in zip(*collect(rows)))
    want = np.zeros(1 << bits, dtype=bool)
    want[linededup._place(h, line, bits)] = True
    assert marks.dtype == np.uint64 and np.array_equal(np.unpackbits(marks.view(np.uint8), bitorder="little"), want)
    bits, marks = linededup._bit_map(rows.limit(0), 0)
    assert len(marks) << 6 == 1 << bits and not marks.any()


@pytest.mark.parametrize("together", [1 << 15, 7])
def test_hashes_of_words_are_xxh64(monkeypatch, together):
    monkeypatch.setattr(linededup, "HASHED", together)
    r = np.random.default_rng(5)
    size = np.concatenate([np.repeat(np.arange(70), 3), r.integers(0, 12, 400), [5000, 0, 1, 33]])
    data, off = r.integers(0, 256, size.sum(), dtype=np.uint8), np.concatenate([[0], np.cumsum(size)])
    want = [xxhash.xxh64_intdigest(data[a:b].tobytes()) for a, b in zip(off, off[1:])]
    assert linededup.hashes(data, off).tolist() == want and linededup.hashes(data, off[9:]).tolist() == want[9:]
    assert linededup.hashes(data[:0], off[:1]).tolist() == []
