"""SimHash near-duplicate groups: fingerprints, a pigeonhole block join, verified Hamming distances, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.storage import cut
from tracelake.llm.blocks import links
from tracelake.llm.common import free, table, tidied
from tracelake.operators.components import connected_components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CHUNK = 1 << 14
#: MinHash keys of a shingle set, and the permutations that each key mixes.
BANDS, ROWS = 32, 4
#: Bits in which SimHash fingerprints of sets of similarity 0.8 may differ: some 10 do, with a deviation of 3.
RADIUS = 26
_PERMUTE = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of ``counts`` hashes of ``h``; a bit is 1 if it is set in over half of its run.
    Works in chunks, so a very long run needs no more memory than a short one."""
    ones = np.zeros((len(counts), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + _CHUNK]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    bits = (2 * ones > np.asarray(counts)[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 (seed 42) of each shingle of the lower-cased text; of the whole word sequence if it is shorter."""
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split() cuts at exactly the six characters
    if not parts:
        return []
    norm, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(norm, 42)]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(norm[s:e], 42) for s, e in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())]


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, h, counts = [], [], []

            def close() -> None:
                if counts:
                    out.append(majority(np.array(h, dtype=np.uint64), np.array(counts)))
                    h.clear()
                    counts.clear()

            for t in b.column(1):
                got = shingle_hashes(t.as_py() or "", words)
                h += got
                counts.append(len(got))
                if len(h) > _CHUNK:
                    close()
            close()
            fp = np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return tidied(run)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Columns id (the key) and fp (64 bits as a long), a row for each row of ``docs``. A null text has no words; a text
    without words has fingerprint 0."""
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_fingerprints(words), f"id {kind}, fp bigint")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """``id, fp, component`` for each row: component is the smallest key that links reach from it, its own included.

    Two rows link if their fingerprints differ in ``distance`` bits or fewer. Equal fingerprints (copies, repeated rows,
    empty texts) are one node, so a large group of copies costs one row of the join; groups of near copies are compared
    in tiles. Null keys get a component too (null only where the whole group has null keys). Empty tables give none."""
    marked = cut(fingerprints(docs, key, text, words))
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("low")))
    ties = links(nodes.select("fp"), nodes.count(), distance)
    roots = cut(connected_components(ties))
    low = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = low.groupBy("root").agg(F.min("low").alias("component"))
    label = low.select("fp", "root").join(named, "root").select("fp", "component")
    return marked.join(label, "fp").select("id", "fp", "component")


def alike(similarity: float):
    """Whether two sets of hashes (sorted, distinct, as bytes) have this Jaccard similarity or more."""

    def verify(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
        if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
            return False
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        return shared >= similarity * (len(both) - shared) - 1e-9

    return verify


def _set(text: str, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))


def _band_keys(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each run of ``h``: each key mixes the least of ROWS permutations of the run."""
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(starts), 1))
    for k, m in enumerate(_PERMUTE):
        out[:, k // ROWS] = (out[:, k // ROWS] ^ np.minimum.reduceat(h * m, starts)) * _MIX
    return out


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums, fps, bands, sets, held = [], [], [], [], 0

            def close() -> None:
                if not sets:
                    return
                counts = np.array([len(s) for s in sets])
                h, full = np.concatenate(sets), counts > 0
                fps.append(majority(h, counts) if len(h) else np.zeros(len(sets), dtype=np.uint64))
                keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
                if full.any():
                    keys[full] = _band_keys(h, (np.cumsum(counts) - counts)[full])
                bands.append(keys)
                sets.clear()

            for t in b.column(2):
                sets.append(_set(t.as_py() or "", words))
                sums.append(xxhash.xxh128_digest(sets[-1].tobytes()))
                held += len(sets[-1])
                if held > _CHUNK:
                    close()
                    held = 0
            close()
            fp = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, dtype=np.int64)
            keys = np.concatenate(bands).view(np.int64).reshape(-1) if bands else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.binary()), pa.array(fp), lists], names=["id", "h", "sum", "fp", "bands"])

    return tidied(run)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([_set(t.as_py() or "", words).tobytes() for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sets], names=["sum", "fp", "part", "shingles"])

    return tidied(run)


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, distance: int = RADIUS) -> DataFrame:
    """``id, component`` for each row: component is the smallest key that links reach from it, its own included.

    Two rows link if the sets of their shingles have Jaccard similarity ``similarity`` or more. Candidates share a band of
    MinHash keys (a pair of similarity 0.8 shares none with a chance of 5e-8) and differ in ``distance`` bits of SimHash
    at most (at 0.8, about 10 differ). Candidates' components are few and small; in each, sets are
    compared in tiles, so a set travels once and not once for each band. Rows of equal sets are one node."""
    kind = dict(docs.dtypes)[key]
    base = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    marked = cut(base.mapInArrow(_sketches(words), f"id {kind}, h bigint, sum binary, fp bigint, bands array<bigint>"))
    nodes = cut(marked.groupBy("sum").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("id", "h")).alias("low")))
    n = nodes.count()
    near = cut(connected_components(links(nodes.select("fp", "sum", "bands"), n, distance, node="sum", buckets="bands")))
    wanted = nodes.join(near.withColumnRenamed("node", "sum"), "sum").select("sum", "fp", F.array(F.xxhash64("root")).alias("part"), F.col("low.id").alias("wid"), F.col("low.h").alias("wh"))
    texts = base.join(wanted.hint("shuffle_hash"), F.expr("id <=> wid and h <=> wh")).select("sum", "fp", "part", "text")
    sets = cut(texts.mapInArrow(_sets(words), "sum binary, fp bigint, part array<bigint>, shingles binary").dropDuplicates(["sum"]))
    ties = links(sets, n, distance, node="sum", tile=256, verify=alike(similarity), payload="shingles", buckets="part")
    roots = cut(connected_components(ties))
    low = nodes.select("sum", "low.id").join(roots.withColumnRenamed("node", "sum"), "sum", "left").withColumn("root", F.coalesce("root", "sum"))
    named = low.groupBy("root").agg(F.min("id").alias("component"))
    label = low.select("sum", "root").join(named, "root").select("sum", "component")
    return marked.select("id", "sum").join(label, "sum").select("id", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were: of each of the ``similar_groups`` the one of the smallest
    key. Of rows that repeat that key one stays. Rows with a null key always stay, as nothing names them as a copy; they
    count in no group. An empty table gives an empty one."""
    own, name = docs.filter(F.col(key).isNotNull()), free(docs.columns, "__keep")[0]
    keep = similar_groups(own, key, text, words, similarity).select(F.col("component").alias(name)).distinct()
    return own.join(keep, F.col(key) == F.col(name)).drop(name).dropDuplicates([key]).union(docs.filter(F.col(key).isNull()))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the whole table ``documents`` by 3-word SimHash within 3 bits."""
    got = groups(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
