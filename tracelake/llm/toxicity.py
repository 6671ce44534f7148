"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import table, tidied

_TOKEN = re.compile(r"[^\W\d_]+")
#: Labelled documents that training takes of each class at most (those of smallest hash, from all of the table), and bytes of
#: their texts (the last may go over it).
SAMPLE, BYTES = 1500, 32 << 20
#: Tokens on either side of a toxic one that the chain is trained on, and tokens that it is trained on at most: half for windows
#: around toxic tokens, which are as many as they are unless this says otherwise, the rest for windows anywhere else.
REACH, TOKENS = 12, 240_000
_KNOWN, _AT_ONCE = 300_000, 400_000


def stems(word: str) -> list[str]:
    """A lower-cased word's beginnings of four to eight letters, and the word itself (marked, as no stem of others)."""
    return [word[:n] for n in range(4, min(8, len(word)) + 1)] + [f"={word}"]


def features(word: str) -> list[str]:
    w = word.lower()
    return [*stems(w), f"p={w[:3]}", f"s={w[-3:]}", f"n={min(len(w), 8)}"]


def toxic_lexicon(words: list[list[str]], toxic: list[bool], precision: float = 0.8, risk: float = 0.01) -> dict[str, int]:
    """The words and stems that label a toxic document's tokens, with the number of documents that speak for them: those that
    toxic documents use and others all but never do, more surely than chance explains among all that were tried (a
    binomial tail bound).

    What counts is not a word's occurrences but the documents that use it in a context (the words on either side) that no
    document before them has: neither the copies of a document nor one long text makes a word of its own a sign of
    toxicity."""
    share = sum(map(bool, toxic)) / max(1, len(toxic))
    inside, outside = Counter(), Counter()
    for ws, y in zip(words, toxic):
        if y:
            inside.update({u for w in {w.lower() for w in ws} for u in stems(w)})
    tried = {u for u, n in inside.items() if n >= 3}
    for ws, y in zip(words, toxic):
        if not y:
            outside.update({u for w in {w.lower() for w in ws} for u in stems(w) if u in tried})
    tried = {u for u in tried if inside[u] >= precision * (inside[u] + outside[u])}
    contexts: set[int] = set()
    clean, bad = Counter(), Counter()
    for ws, y in zip(words, toxic):
        low, new = [w.lower() for w in ws], set()
        for k, w in enumerate(low):
            for u in stems(w):
                if u in tried:
                    c = hash((low[k - 1] if k else "", w, u, low[k + 1] if k + 1 < len(low) else ""))
                    if c not in contexts:
                        contexts.add(c)
                        new.add(u)
        (bad if y else clean).update(new)
    out, need = {}, math.log(max(1, len(tried)) / risk)
    for u, k in bad.items():
        n = k + clean[u]
        q = min(k / n, 1 - 1e-12)
        if k >= 3 and k >= precision * n and q > share:
            surprise = n * (q * math.log(q / share) + (1 - q) * math.log((1 - q) / (1 - share)))
            if surprise >= need:
                out[u] = k
    return out


def chain(e: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of every token by forward-backward over sequences laid end to end. e: a token's log-odds; first: where a
    sequence begins.

    A token's step is a 2 x 2 matrix, one of equal rows where a sequence begins, so all sequences are one product. It is
    taken in about sqrt(n) blocks side by side: exact, and no slower for one long text than for many short ones."""
    n = len(e)
    if not n:
        return np.zeros(0)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    odds = np.ones(blocks * size)
    odds[:n] = np.exp(np.clip(e, -50, 50))
    begin = np.zeros(blocks * size, dtype=bool)
    begin[:n] = first
    w, b = odds.reshape(blocks, size), begin.reshape(blocks, size)
    t, s = np.exp(trans), np.exp(start)
    # m[y, z]: from y to z
    m = np.empty((size, 2, 2, blocks))
    for y in range(2):
        for z in range(2):
            m[:, y, z] = (np.where(b, s[z], t[y, z]) * (w if z else 1.0)).T
    whole = np.zeros((2, 2, blocks))
    whole[0, 0] = whole[1, 1] = 1
    for k in range(size):
        whole = np.einsum("xyb,yzb->xzb", whole, m[k])
        whole /= whole.sum(axis=(0, 1))
    f, enter = np.array([0.5, 0.5]), np.empty((2, blocks))
    for k in range(blocks):
        enter[:, k] = f
        f = f @ whole[:, :, k]
        f /= f.sum()
    g, leave = np.array([0.5, 0.5]), np.empty((2, blocks))
    for k in range(blocks - 1, -1, -1):
        leave[:, k] = g
        g = whole[:, :, k] @ g
        g /= g.sum()
    forward = np.empty((size, 2, blocks))
    f = enter
    for k in range(size):
        f = np.einsum("yb,yzb->zb", f, m[k])
        f = f / f.sum(axis=0)
        forward[k] = f
    out, g = np.empty((size, blocks)), leave
    for k in range(size - 1, -1, -1):
        p = forward[k] * g
        out[k] = p[1] / p.sum(axis=0)
        g = np.einsum("yzb,zb->yb", m[k], g)
        g = g / g.sum(axis=0)
    return out.T.reshape(-1)[:n]


class Model:
    """weights: a feature's log-odds; start, trans: scores of labels and of their pairs; doc: weights of a document's score."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, trans: np.ndarray, doc: np.ndarray) -> None:
        self.weights, self.start, self.trans, self.doc = weights, start, trans, doc

    def marginals(self, texts: list[str], known: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of all tokens of the texts, and how many each has. known: a cache of words' log-odds."""
        weights, out, counts = self.weights, [], []
        for t in texts:
            words = _TOKEN.findall(t)
            counts.append(len(words))
            try:
                out += map(known.__getitem__, words)
            except KeyError:
                del out[sum(counts[:-1]) :]
                for w in set(words):
                    if w not in known:
                        known[w] = sum(weights.get(f, 0.0) for f in features(w))
                out += map(known.__getitem__, words)
        counts = np.array(counts, dtype=np.int64)
        first = np.zeros(len(out), dtype=bool)
        at = np.cumsum(counts) - counts
        first[at[counts > 0]] = True
        return chain(np.array(out, dtype=np.float64), first, self.start, self.trans), counts

    @staticmethod
    def summary(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each document: 1, the log-odds of its most toxic token, and the log of its expected number of toxic tokens."""
        out = np.tile([1.0, -12.0, 0.0], (len(counts), 1))
        full = counts > 0
        at = (np.cumsum(counts) - counts)[full]
        if len(p):
            top = np.clip(np.maximum.reduceat(p, at), 6e-6, 1 - 6e-6)
            out[full, 1] = np.log(top / (1 - top))
            out[full, 2] = np.log1p(np.add.reduceat(np.where(p > 0.01, p, 0.0), at))
        return out

    def scores(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(p, counts) @ self.doc, -35, 35)))


def _crf(windows: list[tuple[list[str], list[int]]], rounds: int = 80, rate: float = 0.3, ridge: float = 1e-4) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Fits a chain by the gradient of its log-likelihood (Adam, all windows at once, weights decayed)."""
    names: dict[str, int] = {}
    rows, cols, labels, first = array("i"), array("i"), [], []
    for words, ys in windows:
        for k, (w, y) in enumerate(zip(words, ys)):
            for f in features(w):
                rows.append(len(labels))
                cols.append(names.setdefault(f, len(names)))
            labels.append(y)
            first.append(k == 0)
    rows, cols, y, first = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64), np.array(labels), np.array(first)
    n = len(y)
    pair = ~first
    pair[0] = False
    theta = np.zeros(len(names) + 6)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros(6)
    np.add.at(seen, y[first], 1)
    np.add.at(seen, 2 + 2 * y[np.flatnonzero(pair) - 1] + y[pair], 1)
    for k in range(1, rounds + 1):
        w, start, trans = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        e = np.bincount(rows, w[cols], n)
        p = chain(e, first, start, trans)
        # marginals of neighbouring pairs, from those of tokens: forward messages by the chain rule of a first-order field
        q = _pairs(e, first, start, trans)
        wants = np.zeros(6)
        wants[0], wants[1] = (1 - p[first]).sum(), p[first].sum()
        wants[2:] = q[pair].sum(axis=0)
        grad = np.concatenate([np.bincount(cols, (y - p)[rows], len(w)), seen - wants]) / n * 100 - ridge * theta * 100
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta += rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-6)
    return {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-9}, theta[-6:-4], theta[-4:].reshape(2, 2)


def _pairs(e: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(label before, label) of each token, as four columns, by plain forward-backward over equally long strides."""
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(e)))
    order = np.argsort(-counts, kind="stable")
    at, counts = at[order], counts[order]
    f, g, out = np.zeros((len(e), 2)), np.ones((len(e), 2)), np.zeros((len(e), 4))
    t, s, odds = np.exp(trans), np.exp(start), np.stack([np.ones(len(e)), np.exp(np.clip(e, -50, 50))], axis=1)
    for k in range(int(counts[0])):
        live = at[: int(np.searchsorted(-counts, -k))] + k
        f[live] = (s if k == 0 else f[live - 1] @ t) * odds[live]
        f[live] /= f[live].sum(axis=1)[:, None]
    for k in range(int(counts[0]) - 1, 0, -1):
        live = at[: int(np.searchsorted(-counts, -k))] + k
        back = odds[live] * g[live]
        joint = f[live - 1][:, :, None] * t[None] * back[:, None, :]
        out[live] = (joint / joint.sum(axis=(1, 2))[:, None, None]).reshape(-1, 4)
        g[live - 1] = back @ t.T
        g[live - 1] /= g[live - 1].sum(axis=1)[:, None]
    return out


def _windows(words: list[list[str]], labels: list[list[int]], reach: int, tokens: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """What the chain is trained on: the surroundings of all labelled tokens, where they meet in one window, and windows
    without such a token, drawn evenly from all places of all documents. Of either no more than its half of ``tokens``
    (what the first leaves, the second has), in random order."""
    rng = np.random.default_rng(seed)
    hot: list[tuple[int, int, int]] = []
    for d, ys in enumerate(labels):
        end = -reach - 1
        for k in np.flatnonzero(ys).tolist():
            if k - reach <= end:
                hot[-1] = (d, hot[-1][1], k + reach)
            else:
                hot.append((d, max(0, k - reach), k + reach))
            end = k + reach
    out, left = [], tokens // 2
    for i in rng.permutation(len(hot)).tolist():
        d, lo, hi = hot[i]
        if left <= 0:
            break
        out.append((words[d][lo:hi], labels[d][lo:hi]))
        left -= hi - lo
    left = max(left, 0) + tokens - tokens // 2
    cells = [(d, lo) for d, ys in enumerate(labels) for lo in range(0, len(ys), 2 * reach) if not any(ys[lo : lo + 2 * reach])]
    for i in rng.permutation(len(cells)).tolist():
        d, lo = cells[i]
        if left <= 0:
            break
        out.append((words[d][lo : lo + 2 * reach], labels[d][lo : lo + 2 * reach]))
        left -= 2 * reach
    return out


def fit(texts: list[str], toxic: list[bool], weight: tuple[float, float] = (1.0, 1.0), seed: int = 7, reach: int = REACH, tokens: int = TOKENS) -> Model:
    """Trains on documents: words by which the toxic ones differ label their tokens, a chain learns these labels, and a
    logistic regression turns a document's marginals into its score. weight: what a clean and a toxic document count.

    Without documents of both classes every score is the share of toxic ones (one half if there are none at all)."""
    words = [list(map(sys.intern, _TOKEN.findall(t or ""))) for t in texts]  # equal words share their memory
    if not any(toxic) or all(toxic):
        share = sum(map(bool, toxic)) / len(toxic) if toxic else 0.5
        return Model({}, np.zeros(2), np.zeros((2, 2)), np.array([math.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0]))
    lexicon = toxic_lexicon(words, toxic)
    windows = _windows(words, [[int(y and not lexicon.keys().isdisjoint(stems(w.lower()))) for w in ws] for ws, y in zip(words, toxic)], reach, tokens, seed)
    model = Model(*_crf(windows), np.zeros(3))
    del words, windows
    known: dict[str, float] = {}
    x = np.concatenate([model.summary(*model.marginals([t or "" for t in texts[at : at + 200]], known)) for at in range(0, len(texts), 200)])
    y = np.array(toxic, dtype=float)
    c = np.where(y > 0, weight[1], weight[0])
    beta, ridge = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2]) * c.sum() / 100
    for _ in range(50):  # Newton
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (c * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (c * (y - q)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
    model.doc = beta
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, size: int = BYTES) -> Model:
    """Fits on labelled documents whose crc32(doc_id as text) mod ``folds`` is not 0: at most ``sample`` of each class, those
    of smallest hash among all, as long as their texts have ``size`` bytes in all. Rows without a label, a key or a text
    do not count; a key with both labels is toxic; of rows that repeat a key the least text counts. Empty tables give
    the model of ``fit`` without documents."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    order = F.xxhash64("doc_id", F.lit(11))
    picked = known.filter("toxic = 0").orderBy(order).limit(sample).union(known.filter("toxic = 1").orderBy(order).limit(sample))
    picked = picked.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"), order.alias("o"))
    have = docs.select("doc_id", "text").filter("text is not null")
    sizes = have.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).groupBy("id", "y", "o").agg(F.max(F.octet_length("text")).alias("n")).collect()  # 2 * sample rows at most
    taken, left = [], {0: size, 1: size}
    for r in sorted(sizes, key=lambda r: (r["o"], r["id"])):
        if left[r["y"]] > 0:
            taken.append((r["id"], r["y"]))
            left[r["y"]] -= r["n"]
    if not taken:
        return fit([], [])
    chosen = docs.sparkSession.createDataFrame(taken, picked.select("id", "y").schema)
    rows = have.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("id", "y").agg(F.min("text").alias("text")).collect()  # bounded by sample and size
    rows.sort(key=lambda r: r["id"])
    toxic = [r["y"] == 1 for r in rows]
    weight = tuple(total.get(v, 0) / max(1, sum(y == bool(v) for y in toxic)) for v in (0, 1))
    return fit([r["text"] for r in rows], toxic, weight)


_SPAN = "array<struct<start:int,end:int,word:string,p:double>>"


def _tag(model: Model, least: float):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.string()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            lo = size = 0
            for hi in range(b.num_rows):
                size += 40 + len(b.column(1)[hi].as_py() or "")
                if size < 6 * _AT_ONCE and hi < b.num_rows - 1:
                    continue
                texts = [t or "" for t in b.column(1).slice(lo, hi + 1 - lo).to_pylist()]
                p, counts = model.marginals(texts, known)
                scores, spans, at = model.scores(p, counts), [], 0
                for t, n in zip(texts, counts.tolist()):
                    hot = np.flatnonzero(p[at : at + n] >= least)
                    found: list[dict] = []
                    if len(hot):
                        tokens = list(_TOKEN.finditer(t))
                        found = [{"start": tokens[k].start(), "end": tokens[k].end(), "word": tokens[k][0], "p": float(p[at + k])} for k in hot.tolist()]
                    spans.append(found)
                    at += n
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi + 1 - lo), pa.array(scores), pa.array(spans, span)], names=["id", "score", "spans"])
                lo, size = hi + 1, 0
                if len(known) > _KNOWN:
                    known.clear()

    return tidied(run)


def tag(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """id, score and spans (start, end, word, marginal) of every row of ``docs``. A null or empty text has no spans and the
    score of a document without toxic tokens. Null and repeated keys are rows like others; an empty table gives none; other
    columns of ``docs`` are not looked at. The model is a few MB, whatever the corpus."""
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_tag(model, least), f"id {kind}, score double, spans {_SPAN}")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out fifth are never looked at."""
    docs = table(spark, sf_dir, "documents")
    got = tag(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return got.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
