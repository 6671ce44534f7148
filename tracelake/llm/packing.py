"""Packing of documents into fixed windows by deficit round-robin over source queues."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.storage import cut
from tracelake.llm.common import table, tidied
from tracelake.llm.tokens import crc32
from tracelake.llm.tokens import encoder as encoder_of

#: Bytes of text that make a shard, packed by one task.
SHARD_BYTES = 16 << 20


def _tokenise(vocabulary: str, kind: str, end: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, row = encoder_of(vocabulary, kind, end), TaskContext.get().partitionId() * 7919
        for b in batches:
            for lo, hi, ids, n in encoder.groups(b.column(1)):
                # dealt in turn, not by a key: no repeated key or hot source fills a shard
                shard = (row + np.arange(hi - lo)) % shards
                row += hi - lo
                ends = np.concatenate([[0], np.cumsum(n)]) * encoder.kind.itemsize
                held = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(shard), pa.array(n), held], names=["doc_id", "source", "shard", "n", "ids"])

    return tidied(run)


def fill(queues: dict, shares: dict, carried: dict, length: int) -> Iterator[tuple]:
    """(source, item, start, taken, sequence, offset) of each piece. queues: of (item, tokens) by source.

    A source's deficit is its share of all tokens dealt out so far, less what it got (carried: from the shards before).
    The queue with the largest deficit is served next, a document at a time, up to the window's end; what a window leaves
    owing, the next one makes good. A queue that is empty is out; the others fill the windows."""
    names = [s for s, q in queues.items() if q]
    left = {s: deque(queues[s]) for s in names}
    share = np.array([shares.get(s, 0.0) for s in names])
    deficit = np.array([carried.get(s, 0.0) for s in names])
    open_, sequence, offset = np.ones(len(names), dtype=bool), 0, 0
    done = {s: 0 for s in names}
    while open_.any():
        k = int(np.argmax(np.where(open_, deficit, -np.inf)))
        s = names[k]
        item, size = left[s][0]
        took = min(size - done[s], length - offset)
        yield s, item, done[s], took, sequence, offset
        deficit += share * took
        deficit[k] -= took
        done[s] += took
        offset += took
        if done[s] == size:
            left[s].popleft()
            done[s] = 0
            open_[k] = bool(left[s])
        if offset == length:
            sequence, offset = sequence + 1, 0


_PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _pack(length: int, kind: str):
    def run(docs: pa.Table, plan: pa.Table) -> pa.Table:
        order = docs.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        queues: dict = {}
        sources, sizes = order["source"].to_pylist(), order["n"].to_pylist()
        for i, s in enumerate(sources):
            queues.setdefault(s, []).append((i, sizes[i]))
        names = plan["queue"].to_pylist()
        shares, carried = dict(zip(names, plan["share"].to_pylist())), dict(zip(names, plan["carried"].to_pylist()))
        base = (docs["shard"][0].as_py() if docs.num_rows else 0) << 32
        rows = list(fill({s: queues[s] for s in sorted(queues, key=str)}, shares, carried, length))
        ids = order["ids"].combine_chunks() if docs.num_rows else []
        crc = []
        for _, i, start, took, *_ in rows:
            crc.append(crc32(np.frombuffer(ids[i].as_buffer(), dtype=kind)[start : start + took]))
        at = pa.array([r[1] for r in rows], pa.int64())
        return pa.table(
            {
                "doc_id": order["doc_id"].take(at), "start": pa.array([r[2] for r in rows], pa.int64()), "length": pa.array([r[3] for r in rows], pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": order["n"].take(at), "sequence_id": pa.array([base + r[4] for r in rows], pa.int64()),
                "offset": pa.array([r[5] for r in rows], pa.int64()), "source": pa.array([r[0] for r in rows], pa.string()),
            }
        )

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: int = 2048, vocabulary: str = "byte_bpe_50k.json", kind: str = "byte",
         end: int = 1, targets: dict[str | None, float] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of all documents in windows of ``length`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, source.

    Rows are dealt to shards in turn, so that each has all sources. In a shard, queues of the sources fill windows by
    ``fill`` to ``targets`` (shares by source; by default the tokens each source has, so that all queues last to the
    end). Deficits go on from shard to shard: a shard starts with the sum of what all before it leave, known from token
    counts by source alone, so that shards are packed at the same time. Every window but a shard's last is full.
    Every row is packed, repeated rows too; a null text is an empty one, of its end id alone; null sources and keys
    are values like others. An empty table gives none."""
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    size = base.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    key_type = dict(docs.dtypes)[key]
    ids = cut(base.mapInArrow(_tokenise(vocabulary, kind, end, shards), f"doc_id {key_type}, source string, shard long, n long, ids binary"))
    by = cut(ids.groupBy("shard", "source").agg(F.sum("n").alias("n")))  # a row for each shard and source
    total = by.groupBy("source").agg(F.sum("n").alias("all"))
    if targets is None:
        whole = total.agg(F.sum("all")).first()[0] or 1
        share = total.select("source", (F.col("all") / F.lit(whole)).alias("share"))
    else:
        whole = sum(targets.values()) or 1.0
        rows = [(s, v / whole) for s, v in targets.items()]
        share = total.select("source").join(docs.sparkSession.createDataFrame(rows, "s string, share double"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce("share", F.lit(0.0)).alias("share"))
    dealt = by.groupBy("shard").agg(F.sum("n").alias("dealt"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    reached = dealt.withColumn("dealt_before", F.coalesce(F.sum("dealt").over(before), F.lit(0)))
    own = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard of a source
    got = by.withColumn("got", F.coalesce(F.sum("n").over(own), F.lit(0))).select("shard", "source", "got")
    plan = (
        got.join(share.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).join(reached.select("shard", "dealt_before"), "shard")
        .select(F.col("shard").alias("plan_shard"), F.col("source").alias("queue"), F.col("share").alias("share"), (F.col("share") * F.col("dealt_before") - F.col("got")).alias("carried"))
    )
    width = "<u2" if ids_fit(vocabulary, end) else "<u4"
    return ids.groupBy("shard").cogroup(plan.groupBy("plan_shard")).applyInArrow(_pack(length, width), _PIECES.format(key_type))


def ids_fit(vocabulary: str, end: int) -> bool:
    """Whether 16 bits hold every id."""
    return encoder_of(vocabulary, "word", end).kind.itemsize == 2


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in windows of 2048 tokens, mixed in the proportion of the sources' tokens."""
    return pack(table(spark, sf_dir, "documents"))
