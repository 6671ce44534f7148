"""Token ids of whole texts by a given vocabulary file, by arrays of their parts and a cache of these."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts kept in each of two generations (the older goes when the newer is full, so that frequent parts stay), and bytes of
#: text encoded at a time: with these a worker's memory is bounded by them and the longest text.
KNOWN, AT_ONCE = 250_000, 8 << 20
#: Stands for the end id among parts; no text has such a part.
_END = "\x01a\x01"
_ENCODERS: dict[tuple, Encoder] = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(vocabulary: str, kind: str, end: int) -> Encoder:
    """The encoder of a vocabulary (a path, or a name among the public ones); a worker keeps it, and what it has learnt, from
    task to task."""
    key = vocabulary, kind, end
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary if "/" in vocabulary else public_path(vocabulary), kind, end)
    return _ENCODERS[key]


class Encoder:
    """Encodes texts exactly as ``tokenizers`` does, add_special_tokens=False, and appends ``end``.

    Both vocabularies cut a text into words, numbers, other signs and white space before anything else: a text's ids are
    those of these parts, one after the other. Arrow cuts the texts of a group and numbers their different parts; a
    part that was seen before needs no second encoding, and new words go to the tokenizer many in one string.

    This is done for texts of plain signs (``_PLAIN``), on whose classes all engines agree, with spaces and line feeds one at
    a time. The others are cut by ``re``, or go to the tokenizer whole: those with special tokens' strings, with separators
    that Python alone counts as white space, with numbers that are no digits and, as "word" vocabularies work on
    normal forms in lower case, texts that are not in normal form or whose lower case depends on the place."""

    _LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
    _PARTS = {
        "byte": re.compile(rf" ?[{_LATIN}]++(?![^\W\d_])| ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+").findall,
        "word": re.compile(rf"[{_LATIN}]++(?![^\W\d_])|[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:_|[^\s\w])+").findall,
    }
    _ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
    # signs of old standing: Latin, Greek, Cyrillic, Armenian's start, punctuation, kana, common ideographs, Hangul
    _PLAIN = "\n -~\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u0377\u0384-\u038a\u0391-\u03a1\u03a3-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u3001\u3002\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
    _NOT_PLAIN = rf"[^{_PLAIN}]|<\||  | \n|\n |\n\n|\n\z"
    #: Parts for Arrow's engine. Of white space, a "word" vocabulary's part takes along what follows it.
    _CUTS = {
        "byte": r" ?\pL+|'(?:s|t|re|ve|m|ll|d)| ?\pN+| ?[^\s\pL\pN]+|\s",
        "word": r"(?:\pL+|'(?:s|t|re|ve|m|ll|d)|\pN|[^\s\pL\pN]+)\s*",
    }

    def __init__(self, path: str, kind: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else "<u4")
        self.parts, self.cuts, self.end, self.spaced = self._PARTS[kind], self._CUTS[kind], np.array([end], self.kind).tobytes(), kind == "byte"
        self.known: dict[str, bytes | None] = {"": b"", _END: self.end}
        self.before: dict[str, bytes | None] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Words of letters stand side by side in one string without changing each other's ids. A part that may not be what
        the tokenizer makes it is None."""
        known, width = self.known, self.kind.itemsize
        side, rest = [], []
        for w in new:
            if w.isalpha() if not self.spaced else w[0] == " " and w[1:].isalpha():
                side.append(w)
            elif not self.spaced and w.isalpha() or w.isascii() or not any(c.isalnum() and not c.isalpha() and not c.isdecimal() for c in w):
                rest.append(w)
            else:
                known[w] = None
        strings = [side[at : at + 500] for at in range(0, len(side), 500)]
        for ws, e in zip(strings, self.tokenizer.encode_batch([("" if self.spaced else " ").join(ws) for ws in strings], add_special_tokens=False)):
            at = np.array(e.word_ids)
            cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]]) * width
            if len(cuts) - 1 == len(ws):
                data, cuts = np.array(e.ids, self.kind).tobytes(), cuts.tolist()
                known.update(zip(ws, map(data.__getitem__, map(slice, cuts, cuts[1:]))))
            else:
                rest += ws
        known.update(zip(rest, self._ids(rest)))

    def _cut(self, text: str) -> list[str] | None:
        """The parts of a text; None if only the tokenizer can tell."""
        if any(x in text for x in self._ODD):
            return None
        if not self.spaced:
            if not text.isascii() and ("\u03a3" in text or not unicodedata.is_normalized("NFC", text)):
                return None
            text = text.lower()
        return self.parts(text)

    def _of(self, words: list[str]) -> list[bytes | None]:
        """The ids of parts; None where only the tokenizer can tell."""
        known, before = self.known, self.before
        got = list(map(known.get, words))
        new = dict.fromkeys(w for w, ids in zip(words, got) if ids is None)
        if new:
            again = [w for w in new if w in before]
            known.update(zip(again, map(before.__getitem__, again)))
            self._learn([w for w in new if w not in known])
            got = list(map(known.__getitem__, words))
        return got

    def _alone(self, text: str) -> bytes:
        """The ids of one text, without the end id."""
        p = self._cut(text)
        got = [None] if p is None else self._of(p)
        return self._ids([text])[0] if None in got else b"".join(got)

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, self._NOT_PLAIN)
        if not self.spaced:
            lower = [t.lower() for t in texts.to_pylist()]
            strange = [not t.isascii() and ("\u03c3" in t or "\u03c2" in t or not unicodedata.is_normalized("NFC", t)) for t in lower]
            odd, plain = pc.or_(odd, pa.array(strange)), pa.array(lower, texts.type)
        else:
            plain = texts
        # every part behind a zero byte; the end id is the last part of each text
        marked = pc.replace_substring_regex(pc.if_else(odd, "", plain), self.cuts, "\x00\\0")
        each = pc.split_pattern(pc.binary_join_element_wise(marked, _END, "\x00"), "\x00")
        coded = each.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        which = coded.indices.to_numpy()
        of = self._of(words if self.spaced else list(map(str.rstrip, words)))
        hard = [i for i, x in enumerate(of) if x is None] if None in of else []
        starts = each.offsets.to_numpy()[:-1] - each.offsets[0].as_py()
        bad = odd.to_numpy(zero_copy_only=False)
        if hard:
            bad = bad | np.logical_or.reduceat(np.isin(which, hard), starts)
            of = [x or b"" for x in of]
        width = self.kind.itemsize
        size = np.fromiter(map(len, of), np.int32, len(of)) // width
        blob, first = np.frombuffer(b"".join(of), self.kind), np.cumsum(size, dtype=np.int32) - size
        n = size[which]
        before = np.cumsum(n, dtype=np.int64) - n
        place = np.arange(int(before[-1] + n[-1]) if len(n) else 0)
        place += np.repeat(first[which] - before, n)
        flat = blob[place]
        counts = np.add.reduceat(n, starts, dtype=np.int64)
        if bad.any():
            at, made = np.cumsum(counts) - counts, []
            for i in np.flatnonzero(bad).tolist():
                made.append(np.frombuffer(self._alone(texts[i].as_py()) + self.end, self.kind))
            out, last = [], 0
            for i, x in zip(np.flatnonzero(bad).tolist(), made):
                out += [flat[last : at[i]], x]
                last = int(at[i] + counts[i])
                counts[i] = len(x)
            flat = np.concatenate([*out, flat[last:]])
        if len(self.known) > KNOWN:
            self.known, self.before = {"": b"", _END: self.end}, self.known
        return flat, counts

    def groups(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The texts a few MB at a time: first, last + 1, the ids of these texts one after the other (little-endian, of
        ``kind``), and how many each has. A null text has the end id alone."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        lo = 0
        while lo < len(texts):
            # as many as fit, and one at least
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, side="right")))
            yield lo, hi, *self._group(texts.slice(lo, hi - lo))
            lo = hi

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as the bytes of unsigned little-endian integers of ``kind``; of a null text, the end id."""
        out = []
        for _, _, flat, counts in self.groups(pa.array(texts, pa.string())):
            out += [x.tobytes() for x in np.split(flat, np.cumsum(counts)[:-1])]
        return out


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
