"""Token files: one id array for all documents of a file, with Elias-Fano encoded document boundaries.

File format, little-endian: ids (16 or 32 bits each, one document after the other); the Elias-Fano sequence of the
n + 1 boundaries; that of the keys, less the smallest; then a footer of eight 64-bit numbers (n, null keys, smallest
key, bytes an id, places and sizes of the two sequences) and the magic bytes.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.storage import cut, shared_dir
from tracelake.llm.common import table, tidied
from tracelake.llm.tokens import crc32
from tracelake.llm.tokens import encoder as encoder_of

_MAGIC, _FOOTER = b"EFTOKEN1", "<8q"
#: Words of the bit map in a block of the select directory.
BLOCK = 8
#: Bytes of text that go to a file.
FILE_BYTES = 64 << 20


class EliasFano:
    """A sorted sequence of n numbers below 2**63 in about 2 + log2(u / n) bits each: the low bits side by side, the high
    parts in unary in a bit map. ``select`` finds the i-th one by a search in a directory (ones before each block of the
    map, 32 bits for 512) and popcounts of one block: never more, however far ones stand apart."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0))
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        # the map has at most 3 n bits
        high = np.zeros(-(-(int(places[-1]) + 1 if n else 0) // (64 * BLOCK)) * 64 * BLOCK, dtype=np.uint8)
        high[places] = 1
        ones = high.reshape(-1, 64 * BLOCK).sum(axis=1, dtype=np.int64)
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little"), np.packbits(high, bitorder="little").view("<u8"), (np.cumsum(ones) - ones).astype("<u4"))

    def select(self, i: int) -> int:
        """The place of the i-th one (from 0) in the bit map."""
        block = int(np.searchsorted(self.ranks, i, side="right")) - 1
        word, rest = block * BLOCK, i - int(self.ranks[block])
        x = int(self.high[word])
        while rest >= (ones := x.bit_count()):
            rest -= ones
            word += 1
            x = int(self.high[word])
        for _ in range(rest):
            x &= x - 1
        return word * 64 + (x & -x).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, low = i * self.low_bits, 0
        if self.low_bits:
            first, last = at // 8, (at + self.low_bits + 7) // 8
            low = int.from_bytes(self.low[first:last].tobytes(), "little") >> (at % 8) & ((1 << self.low_bits) - 1)
        return (self.select(i) - i) << self.low_bits | low

    def to_bytes(self) -> bytes:
        return struct.pack("<5q", self.n, self.low_bits, self.low.nbytes, self.high.nbytes, self.ranks.nbytes) + self.low.tobytes() + self.high.tobytes() + self.ranks.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<5q", data)
        at = 40
        low = np.frombuffer(data, np.uint8, a, at)
        return cls(n, low_bits, low, np.frombuffer(data, "<u8", b // 8, at + a), np.frombuffer(data, "<u4", c // 4, at + a + b))


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class TokenFile:
    """Reads one file: ``len``, key, start and ids of any document by two selects and one ranged read."""

    def __init__(self, uri: str) -> None:
        fs, path = _open(uri)
        self._file = fs.open_input_file(path)
        size = self._file.size()
        foot = self._file.read_at(struct.calcsize(_FOOTER) + len(_MAGIC), size - struct.calcsize(_FOOTER) - len(_MAGIC))
        if foot[-len(_MAGIC) :] != _MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.n, self.nulls, self.least, width, at, a, kt, k = struct.unpack(_FOOTER, foot[: struct.calcsize(_FOOTER)])
        self.kind = np.dtype(f"<u{width}")
        self.bounds = EliasFano.from_bytes(self._file.read_at(a, at))
        self.keys = EliasFano.from_bytes(self._file.read_at(k, kt))

    def __len__(self) -> int:
        return self.n

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.keys[i - self.nulls] + self.least

    def span(self, i: int) -> tuple[int, int]:
        return self.bounds[i], self.bounds[i + 1]

    def ids(self, i: int) -> np.ndarray:
        return self.read(*self.span(i))

    def read(self, lo: int, hi: int) -> np.ndarray:
        w = self.kind.itemsize
        return np.frombuffer(self._file.read_at((hi - lo) * w, lo * w), self.kind)

    def close(self) -> None:
        self._file.close()


def _write(folder: str, vocabulary: str, kind: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder, out, lengths, keys, nulls = None, None, [], [], 0
        # a name of its own for each attempt: only the manifest of the attempt that Spark counts names a file
        uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.eft"
        for b in batches:
            if out is None and b.num_rows:
                encoder = encoder_of(vocabulary, kind, end)
                fs, path = _open(uri)
                out = fs.open_output_stream(path)
            for lo, hi, ids, n in encoder.groups(b.column(1)) if out else ():
                out.write(ids.tobytes())
                lengths += n.tolist()
                own = b.column(0).slice(lo, hi - lo)
                nulls += own.null_count
                keys += own.drop_null().to_pylist()
        if out is None:
            return
        bounds = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))])
        least, place = keys[0] if keys else 0, int(bounds[-1]) * encoder.kind.itemsize
        a, k = EliasFano.encode(bounds).to_bytes(), EliasFano.encode(np.array([x - least for x in keys], dtype=np.uint64)).to_bytes()
        out.write(a + k + struct.pack(_FOOTER, len(lengths), nulls, least, encoder.kind.itemsize, place, len(a), place + len(a), len(k)) + _MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "uri": [uri], "docs": [len(lengths)], "tokens": [int(bounds[-1])]})

    return tidied(run)


def write_tokens(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", kind: str = "word", end: int = 2,
                 file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of all documents to ``folder`` in ascending order of key and returns the manifest, a table with a row for
    each file: part (their order), uri, docs, tokens, and before (tokens of all files before it).

    Texts are dealt to files by ranges of (key, row), so that a key that repeats very often still fills several files;
    null keys come first. A null text is an empty one; repeated rows are documents like others; an empty table gives no
    file. Keys are integers (any other type is an error); other columns of ``docs`` are not looked at."""
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"keys of token files are integers, not {dict(docs.dtypes)[key]}")
    base = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    size = docs.agg(F.sum(F.octet_length(text) + 8)).first()[0] or 0
    parts = base.repartitionByRange(max(1, -(-size // file_bytes)), F.col("k").asc_nulls_first(), "row").sortWithinPartitions(F.col("k").asc_nulls_first(), "row")
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    made = cut(parts.select("k", "text").mapInArrow(_write(folder, vocabulary, kind, end), "part long, uri string, docs long, tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return cut(made.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            f = TokenFile(uri)
            spans, at = [], 0
            for i in range(f.n):
                spans.append(f.span(i) if not spans else (spans[-1][1], f.bounds[i + 1]))
                if spans[-1][1] - spans[0][0] < 1 << 22 and i < f.n - 1:
                    continue
                first = spans[0][0]
                ids = f.read(first, spans[-1][1])
                rows = [(f.key(at + k), before + lo, hi - lo, crc32(ids[lo - first : hi - first])) for k, (lo, hi) in enumerate(spans)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                spans, at = [], i + 1
            f.close()


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start (in the order of all files), n_tokens and ids_crc32 of each document, from the files: places by select,
    ids some MB at a time."""
    files = manifest.select("uri", "before").repartition(max(1, min(manifest.count(), 10_000)))
    return files.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all of ``documents`` as token files and returns what reading them back gives. The files go afterwards."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    out = cut(read_digests(write_tokens(table(spark, sf_dir, "documents"), folder)))
    fs, path = _open(folder)
    fs.delete_dir(path)
    return out
