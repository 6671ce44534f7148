"""Fuzzy line deduplication across documents: sketches of normalised lines, joins on blocks of these, edit similarity.

SimHash blocks alone do not find lines of similarity 0.8: these differ in some 13 of 64 bits, and blocks that 13 bits leave
intact have four bits. So blocks are keys that edits leave intact: for short lines the line without one of its words, for
others least hashes of four neighbouring words. Fingerprints (parities of words, and SimHash) then say which of those
that share a block are compared by their words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.storage import cut, drop, sweep, written
from tracelake.llm.blocks import links
from tracelake.llm.common import free, table, tidied
from tracelake.llm.simhash import majority
from tracelake.operators.components import connected_components

#: Least-hash keys of a line; neighbouring words that one is made of, in lines of up to LONG words and in longer ones; and bits in
#: which SimHash fingerprints of lines of edit similarity 0.8 may differ: some 13 do, with a deviation of 3.2.
BANDS, RUNS, LONG, RADIUS = 8, (3, 4), 20, 24
#: Words from which a line is compared by similarity, and characters from which one of fewer words is compared for equality.
MIN_WORDS, MIN_CHARS = 5, 8
#: Columns of parity bits, 64 in each.
PARITY = [f"p{k}" for k in range(4)]
#: The same for lines that are compared, of words whose repetitions are told apart.
EXACT = [f"q{k}" for k in range(8)]
#: Bytes of keys that are sorted at once, and lines of a batch that make a key one of many.
PART_BYTES, MANY = 16 << 20, 16
#: Bytes of lines of a group that are compared at once.
TILE_BYTES = 2 << 20
#: Bits of a stretch of the map of wanted lines, as a power of two: what a task makes of it as one row.
STRETCH = 16
#: Bytes of text that are sketched at a time, and sums of lines that a task remembers.
AT_ONCE, SEEN = 4 << 20, 200_000
_SALT = np.random.default_rng(13).integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: ASCII digits become 0 and ASCII punctuation a space; the line feed stays.
_FOLD = bytes.maketrans(bytes(range(49, 58)) + (p := bytes(c for c in range(128) if not chr(c).isalnum() and c != 10)), b"0" * 9 + b" " * len(p))


def folded(text: str) -> bytes:
    """A text as its lines are compared: lower case, every digit a 0, no punctuation; white space is any."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD)


def normal(line: str) -> list[bytes]:
    """The words of a line as they are compared."""
    return folded(line).split(b"\n")[0].split()


def distance_within(a: list, b: list, most: int) -> bool:
    """Whether ``a`` becomes ``b`` in ``most`` edits of items or fewer (Levenshtein): bit-parallel over arbitrarily long
    integers (Myers, Hyyro), after what both share at their ends is cut off."""
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) == len(b) and sum(map(ne, a, b)) <= most:  # as many replacements
        return True
    n, lo, hi = min(len(a), len(b)), 0, 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if min(len(a), len(b)) <= 1:  # nothing, or one item that may be found in the other
        return max(len(a), len(b)) - (bool(a) and bool(b) and (a[0] in b if len(a) == 1 else b[0] in a)) <= most
    if len(a) < len(b):
        a, b = b, a
    places: dict = {}
    for k, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << k
    full, top, score = (1 << len(b)) - 1, 1 << (len(b) - 1), len(b)
    up, down, left = full, 0, len(a)
    for c in a:
        eq = places.get(c, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        hp, hn = down | ~(d | up), up & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        left -= 1
        if score - left > most:
            return False
        hp = hp << 1 | 1
        up, down = (hn << 1 | ~(d | hp)) & full, hp & d & full
    return score <= most


def alike(similarity: float):
    """Whether 1 - word edits / words of the longer is ``similarity`` at least."""

    def verify(a: str, b: str) -> bool:
        x, y = a.split(" "), b.split(" ")
        most = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
        if max(len(x), len(y)) > 200 and max(len(x), len(y)) - (Counter(x) & Counter(y)).total() > most:
            return False  # as many words at least are not shared; of long lines this costs far less to know
        return distance_within(x, y, most)

    return verify


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def allowed(n, similarity: float):
    """Word edits that a pair of lines may have, the longer of n words."""
    return np.floor((1 - similarity) * n + 1e-9).astype(np.int64)


#: The primes of XXH64, and words that are hashed at once.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
HASHED = 1 << 15


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint64(k) | x >> np.uint64(64 - k)


def hashes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the words that lie in the bytes ``data`` from off[i] to off[i + 1]. Its steps for what is shorter than 32
    bytes are taken by many words at once, which costs a fifth of telling words apart and hashing each different one."""
    padded = np.zeros(len(data) + 32, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 25, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    out = np.empty(len(off) - 1, dtype=np.uint64)
    for lo in range(0, len(out), HASHED):
        ends = off[lo : lo + HASHED + 1]
        at, size = ends[:-1], np.diff(ends)
        h = size.astype(np.uint64) + _P5
        for k in (0, 8, 16):
            own = np.flatnonzero(size >= k + 8)
            h[own] = _turned(h[own] ^ _turned(eight[at[own] + k] * _P2, 31) * _P1, 27) * _P1 + _P4
        tail = eight[at + (size & 24)]  # of words of 32 bytes or more any place in them
        own = np.flatnonzero(size & 4)
        h[own] = _turned(h[own] ^ (tail[own] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        tail[own] >>= np.uint64(32)
        for k in range(3):
            own = np.flatnonzero((size & 3) > k)
            h[own] = _turned(h[own] ^ (tail[own] >> np.uint64(8 * k) & np.uint64(255)) * _P5, 11) * _P1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(size >= 32).tolist():
            h[i] = xxhash.xxh64_intdigest(data[ends[i] : ends[i + 1]])
        out[lo : lo + HASHED] = h
    return out


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of folded texts: the text and number of each line that has words, its words and the bytes of these, and the hashes
    of all words. Arrow cuts the texts."""
    lines = pc.split_pattern(pa.array(texts, pa.large_binary()).view(pa.large_string()), "\n")
    starts = lines.offsets.to_numpy()
    each = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lines.flatten()))
    counts = pc.list_value_length(each).to_numpy()
    words = each.flatten().view(pa.large_binary())
    per = np.diff(starts)
    owner, number = np.repeat(np.arange(len(texts)), per), np.arange(len(counts)) - np.repeat(starts[:-1] - starts[0], per)
    begin = np.cumsum(counts) - counts
    off = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    h = hashes(np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8), off)
    size = off[begin + counts] - off[begin]
    full = size > 0  # a line of white space alone has one word, an empty one
    if not full.all():
        h = h[np.repeat(full, counts)]
    return owner[full], number[full], counts[full].astype(np.int64), size[full], h


def _add(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(v, starts) if len(starts) else v[:0]


def sums(e: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each line, given as runs of words' hashes: equal for equal sequences of words."""
    starts = np.cumsum(counts) - counts
    place = (np.arange(len(e)) - np.repeat(starts, counts)).astype(np.uint64)
    a = _mix(e + place * np.uint64(0x9E3779B97F4A7C15))
    return _add(a, starts), _add(_mix(a ^ e * np.uint64(0xD6E8FEB86659FD93)), starts) ^ counts.astype(np.uint64)


def _parity(e: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Parity bits of lines, given as runs of words' hashes, and whether a line may repeat many of its words."""
    starts = np.cumsum(counts) - counts
    if not len(counts):
        return [e] * len(PARITY), np.zeros(0, dtype=bool)
    m = _mix(e)
    place, bit = m >> np.uint64(62), np.uint64(1) << (m >> np.uint64(56) & np.uint64(63))
    own = [np.where(place == k, bit, np.uint64(0)) for k in range(len(PARITY))]
    used = sum(np.bitwise_count(np.bitwise_or.reduceat(x, starts)).astype(np.int64) for x in own[:2])  # of half the classes
    return [np.bitwise_xor.reduceat(x, starts) for x in own], (counts > 400) | (used < 0.65 * 128 * -np.expm1(-counts / 256))


def _numbered(e: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``e``, where in the lines ``which`` an element's second, third occurrence is an element of its own."""
    if not which.any():
        return e
    mine = np.repeat(which, counts)
    x, owner = e[mine], np.repeat(np.arange(int(which.sum())), counts[which])
    order = np.lexsort((x, owner))
    s, at = x[order], np.arange(len(x))
    fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])])
    times = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    x[order] = np.where(times > 0, _mix(s + times * np.uint64(0x9E3779B97F4A7C15)), s)
    out = e.copy()
    out[mine] = x
    return out


def bucket_keys(e: np.ndarray, counts: np.ndarray, similarity: float, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which lines, given as runs of words' hashes, meet, and how many each line has. ``repeats``: lines in which
    pairs of words that repeat are told apart.

    Lines that may differ in one word have a key for each of their words, the line without it, and one of the whole: none
    of their pairs is lost. Lines that may have partners with two edits or more have BANDS least hashes of their runs of
    three (up to LONG words) or four words, lines about LONG words both. At similarity 0.8, with edits spread at random, a
    pair shares 0.26 of its runs of four and with a chance of 0.91 a key; at 0.85, 0.35 and 0.97; at 0.9, 0.49 and 0.995."""
    starts = np.cumsum(counts) - counts
    least = int(next(m for m in range(1, 1 << 20) if allowed(np.array([m]), similarity)[0] >= 2)) if similarity < 1 else 1 << 40
    short = (allowed(counts + 1, similarity) >= 1) & (counts < least)
    kinds = [(counts >= max(2, least - 2)) & (counts <= LONG), (counts >= max(2, least - 2)) & (counts >= similarity * LONG)]
    size = np.where(short, counts + 1, 0) + sum(np.where(kind, BANDS, 0) for kind in kinds)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint64)
    for n in np.unique(counts[short]).tolist():
        own = np.flatnonzero(short & (counts == n))
        w = e[starts[own][:, None] + np.arange(n)]
        for gone in range(n + 1):
            k = np.full(len(own), 0x5851F42D4C957F2D, dtype=np.uint64)
            for c in range(n):
                if c != gone:
                    k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + w[:, c])
            out[at[own] + gone] = k
    place = at + np.where(short, counts + 1, 0)
    for kind, run in zip(kinds, RUNS):
        own = np.flatnonzero(kind)
        if not len(own):
            continue
        w, n = (e, counts) if len(own) == len(counts) else (e[np.repeat(kind, counts)], counts[own])
        first = np.cumsum(n) - n
        g = w * np.uint64(0x9E3779B97F4A7C15) + np.uint64(run)
        for k in range(1, run):
            g ^= g >> np.uint64(29)
            g = g * np.uint64(0xBF58476D1CE4E5B9) + np.append(w[k:], w[:k])
        g = _numbered(_mix(g), n, repeats[own])
        # a line's last words begin no run; where a line has fewer words than a run, its first word does
        behind = np.repeat(first + n, n) - np.arange(len(w))
        none = np.flatnonzero((behind < run) & (behind != np.repeat(n, n)))
        for k, salt in enumerate(_SALT):
            x = g * salt
            x[none] = np.uint64(0xFFFFFFFFFFFFFFFF)
            out[place[own] + k] = _mix(np.minimum.reduceat(x, first) + np.uint64(k))
        place = place + np.where(kind, BANDS, 0)
    return out, size


_SKETCH = "id {}, h bigint, line int, sum binary, short bigint, n int, " + ", ".join(f"{p} bigint" for p in PARITY) + ", keyed boolean, keys array<bigint>"


def _sketched(min_words: int, min_chars: int, similarity: float):
    def made(ids: pa.Array, hs: pa.Array, texts: list[bytes], seen: set[int]) -> pa.RecordBatch:
        owner, number, n, size, e = words_of(texts)
        keep = n >= min_words
        for i in np.flatnonzero(~keep & (size + n > min_chars)).tolist():
            line = b" ".join(texts[owner[i]].split(b"\n")[number[i]].split())
            keep[i] = len(line.decode("utf-8", "replace")) >= min_chars
        e, owner, number, n = e[np.repeat(keep, n)], owner[keep], number[keep], n[keep]
        a, b = sums(e, n)
        par, again = _parity(e, n)
        # of equal lines one in a task has keys: a line that is everywhere is not dealt out more often than there are tasks
        news, short = np.zeros(len(n), dtype=bool), a.tolist()
        for i in np.flatnonzero(n >= min_words).tolist():
            if short[i] not in seen:
                seen.add(short[i])
                news[i] = True
        if len(seen) > SEEN:
            seen.clear()
        keys, size = bucket_keys(e[np.repeat(news, n)], n[news], similarity, again[news])
        each = np.zeros(len(n), dtype=np.int64)
        each[news] = size
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), pa.array(keys.view(np.int64)))
        both = np.stack([a, b], axis=1).astype("<u8")
        sum_ = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * 16).astype(np.int32)), pa.py_buffer(both)])
        at = pa.array(owner)
        cols = [ids.take(at), hs.take(at), pa.array(number.astype(np.int32)), sum_, pa.array(a.view(np.int64)), pa.array(n.astype(np.int32)), *[pa.array(v.view(np.int64)) for v in par], pa.array(each > 0), lists]
        return pa.RecordBatch.from_arrays(cols, names=["id", "h", "line", "sum", "short", "n", *PARITY, "keyed", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            lo, size, texts = 0, 0, []
            for i, t in enumerate(b.column(2)):
                texts.append(folded(t.as_py() or ""))
                size += len(texts[-1])
                if size > AT_ONCE or i == b.num_rows - 1:
                    yield made(b.column(0).slice(lo, len(texts)), b.column(1).slice(lo, len(texts)), texts, seen)
                    lo, size, texts = i + 1, 0, []

    return tidied(run)


_STEP = 2654435761


def _place(h, line, bits: int):
    """The bit of a line in a map of 2 ** ``bits``, in Spark or in NumPy."""
    if isinstance(h, np.ndarray):
        return (h ^ line * _STEP) & ((1 << bits) - 1)
    return h.bitwiseXOR(line.cast("long") * F.lit(_STEP)).bitwiseAND(F.lit((1 << bits) - 1))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits (part, place in it) as stretches of a bit map; a task holds the whole map at most."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        part, at = b.column(0).to_numpy(), b.column(1).to_numpy()
        for p in np.unique(part).tolist():
            own = at[part == p]
            np.bitwise_or.at(held.setdefault(p, np.zeros(1 << (STRETCH - 6), dtype=np.uint64)), own >> 6, np.uint64(1) << (own & 63).astype(np.uint64))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["part", "bits"])


def _bit_map(lines: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """A bit map of ``lines`` (h, line; n of them): 16 bits for each, 16 MB at most. Beyond that it lets more and more lines
    pass that are not wanted, which a join then drops. Tasks make stretches of it: a row for each of its words, on the
    driver, would take some 30 times the map's own size."""
    bits = min(27, max(STRETCH, (16 * n).bit_length()))
    at = _place(F.col("h"), F.col("line"), bits)
    dealt = lines.select(F.shiftright(at, STRETCH).alias("part"), at.bitwiseAND(F.lit((1 << STRETCH) - 1)).alias("at")).repartition("part")
    out = np.zeros((1 << (bits - STRETCH), 1 << (STRETCH - 6)), dtype=np.uint64)
    for part, stretch in dealt.mapInArrow(tidied(_marked), "part bigint, bits binary").collect():  # 2 ** 11 rows at most
        out[part] = np.frombuffer(stretch, dtype=np.uint64)
    return bits, out.reshape(-1)


def _texts(bits: int, wanted: np.ndarray):
    """The words of the lines whose bit is set."""
    names = ["id", "h", "line", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, h = b.column(2).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            many = np.array([0 if t is None else t.count("\n") + 1 for t in texts], dtype=np.int64)
            owner = np.repeat(np.arange(len(texts)), many)
            line = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            at = _place(h[owner], line, bits)
            hit = np.flatnonzero(wanted[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            out, last, cut_ = [], -1, []
            for i, k in zip(owner[hit].tolist(), line[hit].tolist()):
                if i != last:
                    cut_, last = folded(texts[i]).split(b"\n"), i
                out.append(b" ".join(cut_[k].split()).decode("utf-8", "replace"))
            own = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(line[hit].astype(np.int32)), pa.array(out, pa.string())], names=names)

    return tidied(run)


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the SimHash fingerprint, and parities in 512 classes, of words whose repetitions are told apart."""
    for b in batches:
        words = b.column(b.schema.get_field_index("words")).to_pylist()
        n = np.array([w.count(" ") + 1 for w in words], dtype=np.int64)
        e = words_of([" ".join(words).encode("utf-8", "replace")])[4] if words else np.zeros(0, dtype=np.uint64)
        m = _mix(_numbered(e, n, np.ones(len(n), dtype=bool)))
        place, bit = m >> np.uint64(61), np.uint64(1) << (m >> np.uint64(55) & np.uint64(63))
        starts = np.cumsum(n) - n
        par = [np.bitwise_xor.reduceat(np.where(place == k, bit, np.uint64(0)), starts) if len(n) else m for k in range(8)]
        fp = majority(m, n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64)), *[pa.array(v.view(np.int64)) for v in par]], names=[*b.schema.names, "fp", *EXACT])


_PAIR = np.dtype([("key", "<i8"), ("short", "<i8")])


def _packed(parts: int):
    """Keys and the lines that have them, as arrays of _PAIR, by part (a key's remainder). A key that MANY lines of a batch
    have is known to be shared: its rows go straight on, under a part of their own (from ``parts`` up), and only two of
    them to its part, where they say so to the rows of other batches. No part grows with a frequent key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in enumerate(batches):
            lists = b.column(0)
            per = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            rows = np.empty(int(per.sum()), dtype=_PAIR)
            rows["key"], rows["short"] = lists.flatten().to_numpy(), np.repeat(b.column(1).to_numpy(), per)
            order = np.argsort(rows["key"], kind="stable")
            rows = rows[order]
            start = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))[: len(rows)]
            size = np.diff(np.append(start, len(rows)))
            place = np.arange(len(rows)) - np.repeat(start, size)
            often = np.repeat(size >= MANY, size)
            out, names = [], []
            if often.any():
                out.append(rows[often].tobytes())
                names.append(parts + number % parts)
            rows = rows[~often | (place < 2)]
            part = (_mix(rows["key"].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: len(part)]
            for lo, hi in zip(first.tolist(), [*first.tolist()[1:], len(part)]):
                out.append(rows[lo:hi].tobytes())
                names.append(int(part[lo]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["part", "pairs"])

    return tidied(run)


def _shared(parts: int):
    """Of a part's pairs, those whose key different lines have. Batches come in order of part."""

    def met(held: list[bytes], straight: bool) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(held), dtype=_PAIR)
        k, s = rows["key"], rows["short"]
        if not straight:
            order = np.lexsort((s, k))
            k, s = k[order], s[order]
            once = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))[: len(k)]
            k, s = k[once], s[once]
            same = k[1:] == k[:-1]
            keep = (np.append(False, same) | np.append(same, False))[: len(k)]
            k, s = k[keep], s[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(k)), pa.array(np.ascontiguousarray(s))], names=["key", "short"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            for part, pairs in zip(b.column(0).to_pylist(), b.column(1)):
                if held and (part != last or part >= parts):
                    yield met(held, last >= parts)
                    held = []
                last = part
                held.append(pairs.as_py())
        if held:
            yield met(held, last >= parts)

    return tidied(run)


def within(similarity: float, parity: list[str]):
    """Columns and a test for links: pairs whose edits may be few enough, by their lengths and by the parities of classes of
    words. It loses no pair: an edit changes two words at most, a word one parity."""

    def test(*v: np.ndarray) -> np.ndarray:
        *par, n = v[: len(parity) + 1]
        *par2, n2 = v[len(parity) + 1 :]
        apart, edits = np.abs(n.astype(np.int64) - n2), allowed(np.maximum(n, n2), similarity)
        odd = sum(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).astype(np.int64) for a, b in zip(par, par2))
        return (apart <= edits) & (odd <= 2 * edits - apart)

    return [*parity, "n"], test


def _ties(lines: DataFrame, base: DataFrame, similarity: float) -> DataFrame:
    """Links of nodes (sum) by edit similarity. Candidates share a key and pass ``within``; keys that one line has alone go
    first, as most do. The texts of lines that have candidates travel once, and are compared with those that candidates
    reach from them."""
    own = ["sum", *PARITY, "n"]
    keyed = lines.filter("keyed").select("keys", "short")
    parts = max(1, -(-keyed.count() * (BANDS + 2) * _PAIR.itemsize // PART_BYTES))
    dealt = keyed.mapInArrow(_packed(parts), "part bigint, pairs binary").repartition("part").sortWithinPartitions("part")
    met = cut(dealt.mapInArrow(_shared(parts), "key bigint, short bigint"))
    some = met.select("short").distinct().withColumnRenamed("short", "s")
    sketched = lines.filter("keyed").select("short", *own, "id", "h", "line")
    cards = cut(sketched.join(some.hint("shuffle_hash"), F.col("short") == F.col("s"), "left_semi").dropDuplicates(["sum"]))
    n = cards.count()
    rows = met.join(cards.hint("shuffle_hash"), "short").select(*own, F.array("key").alias("keys"), F.col("short").alias("fp"))
    # any fingerprints may meet here: the radius is that of texts, below
    parts = cut(connected_components(links(rows, n, 64, node="sum", buckets="keys", near=within(similarity, PARITY)))).withColumnRenamed("node", "sum")
    wanted = cut(cards.join(parts.hint("shuffle_hash"), "sum").select("sum", "n", F.xxhash64("root").alias("part"), F.col("id").alias("wid"), F.col("h").alias("wh"), F.col("line").alias("wline")))
    bits, marks = _bit_map(wanted.select(F.col("wh").alias("h"), F.col("wline").alias("line")), wanted.count())
    kind = dict(base.dtypes)["id"]
    texts = base.mapInArrow(_texts(bits, marks), f"id {kind}, h bigint, line int, words string")
    found = texts.join(wanted.hint("shuffle_hash"), F.expr("id <=> wid and h = wh and line = wline")).dropDuplicates(["sum"])
    compared = found.select("sum", "n", F.array("part").alias("part"), "words", (F.octet_length("words") + 64).alias("bytes"))
    spec = "sum binary, n int, part array<bigint>, words string, bytes int, fp bigint, " + ", ".join(f"{q} bigint" for q in EXACT)
    compared = cut(compared.mapInArrow(tidied(_told_apart), spec))
    return links(compared, n, RADIUS, node="sum", tile=TILE_BYTES, verify=alike(similarity), payload="words", buckets="part", near=within(similarity, EXACT), weight="bytes")


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, similarity: float = 0.8, min_chars: int = MIN_CHARS) -> DataFrame:
    """The lines to remove: ``id, h, lines``, a row for each document that loses some (h: XXH64 of its text; lines: their
    numbers from 0).

    Lines of ``min_words`` words or more are compared after normalisation. Two link if their edit similarity (by words) is
    ``similarity`` or more; in each connected group the line of the smallest (key, text hash, line number) stays. Shorter
    lines of ``min_chars`` characters or more after normalisation, which unspaced scripts have too, go if they are equal;
    others never go. Equal lines are one node. How many pairs are found at which similarity: see ``bucket_keys``. Null
    texts have no lines; null keys come first in that order; rows that repeat key and text are one document; keys may be
    of any type that Spark orders. An empty table gives none."""
    kind = dict(docs.dtypes)[key]
    base = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    lines = written(base.mapInArrow(_sketched(min_words, min_chars, similarity), _SKETCH.format(kind)), ("sum", "short", *PARITY, "keys.list.element"))
    roots = cut(connected_components(_ties(lines, base, similarity))).withColumnsRenamed({"node": "sum"})
    # the smallest key of each node, by sums in hash tables; which of that key's lines it is, is asked of few rows below
    low = [F.min("id").alias("id"), F.bool_or(F.col("id").isNull()).alias("void")]
    nodes = lines.groupBy("sum").agg(*low, F.count("*").alias("n"))
    # most lines are alone: they go before anything is grouped
    in_group = cut(nodes.join(roots.hint("shuffle_hash"), "sum", "left").filter("n > 1 or root is not null").withColumn("root", F.coalesce("root", "sum")))
    first = in_group.groupBy("root").agg(F.min("id").alias("low"), F.bool_or("void").alias("void"), F.sum("n").alias("n")).filter("n > 1")
    first = first.select("root", F.when(~F.col("void"), F.col("low")).alias("low"))
    group = in_group.select("sum", "root").join(first, "root")
    rows = cut(lines.select("sum", "id", "h", "line").join(group.hint("shuffle_hash"), "sum").select("root", "low", "id", "h", "line"))
    ours = rows.filter(F.col("id").eqNullSafe(F.col("low")))
    stay = ours.groupBy("root").agg(F.min(F.struct("h", "line")).alias("stay"))
    more = ours.join(stay, "root").filter(F.struct("h", "line") != F.col("stay"))
    gone = rows.filter(~F.col("id").eqNullSafe(F.col("low"))).select("id", "h", "line").union(more.select("id", "h", "line"))
    out = cut(gone.distinct().groupBy("id", "h").agg(F.array_sort(F.collect_list("line")).alias("lines")))
    drop(lines)
    return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "__removed", **how) -> DataFrame:
    """``docs`` with the lines of ``duplicates`` taken out of its text, and a column ``removed`` of how many these are; every
    row stays, with an empty text if all of its lines went, and all other columns stay as they were (a column n_chars is
    brought up to date; one that has the name ``removed`` is replaced). Nulls, repeated rows and empty tables: see
    ``duplicates``. Helper columns have names that no column has."""
    i, h, g = free([*docs.columns, removed], "__id", "__h", "__gone")
    gone = duplicates(docs, key, text, **how).withColumnsRenamed({"id": i, "h": h, "lines": g})
    sweep(docs.sparkSession)  # before all texts are shuffled once
    left = docs.join(gone.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(h)), "left")
    # the lambda sees the array of numbers as a plain column, so each line costs one search in it
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda _, at: ~F.array_contains(F.col(g), at)), "\n")
    out = left.withColumn(text, F.when(F.col(g).isNull(), F.col(text)).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(g).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")))
    rest = [c for c in docs.columns if c.lower() != removed.lower()]
    return out.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.size(g), F.lit(0)).cast("long").alias(removed))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without repeated lines: doc_id, text, n_lines (before) and n_removed, a row for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    return dedup_lines(docs, removed="n_removed")
