"""Substring dedup over words with a compressed FM-index for each shard.

Shards hold the contexts that may repeat (see passages). A shard's index is the Burrows-Wheeler transform of its
distinct contexts, as words, in a wavelet matrix of packed bits with block counts, and a sample of the suffix positions.
The shard's documents are streamed against it: backward search, vectorised over all places, extends each match word by
word for as long as something else than the place itself matches, and counts the words (the place's matching statistic,
up to ``size``). Intervals of statistics that reach ``size`` are located through the sampled positions, and the least
document of one says whether the window starts in an earlier document. Such windows become intervals of words to remove.

Defined results: null text: no words; texts of fewer words than ``size`` lose none; equal texts of a later document lose
all; null doc_ids come after all others; rows of one doc_id never remove one another's words. Windows are judged on the
input. Other columns of docs are not passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .common import raw, slices
from .passages import KEY, Words, merged, repeated_spans, texts

SIZE = 13
SHARD_BYTES = 3 << 20
#: Distinct contexts of one anchor, each of about 100 bytes, that a shard gathers; beyond, the anchor is split.
HOT = 2_000
#: Windows searched at a time.
STEP = 100_000
U = np.uint64


class Wavelet:
    """Ranks of symbols in a sequence: one packed bit vector a level, with a count before each 64 bits."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.words, self.before, self.zeros = [], [], []
        s = symbols
        for level in reversed(range(self.levels)):
            bit = (s >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1])
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate([s[~bit], s[bit]])
        every = np.arange(int(top) + 1)
        self.start = np.zeros(len(every), np.int64)
        self.start = self._walk(every, np.zeros(len(every), np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            word = i >> 6
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & ((U(1) << (i & 63).astype(np.uint64)) - U(1)))
            i = np.where(c >> level & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands among the first i symbols."""
        return self._walk(c, i) - self.start[c]

    def symbol(self, i: np.ndarray) -> np.ndarray:
        """The symbol at place i."""
        out = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            word, at = i >> 6, (i & 63).astype(np.uint64)
            bits = self.words[k][word]
            one = (bits >> at & U(1)).astype(bool)
            ones = self.before[k][word] + np.bitwise_count(bits & ((U(1) << at) - U(1)))
            out = out << 1 | one
            i = np.where(one, self.zeros[k] + ones, i - ones)
        return out


class Index:
    """Compressed FM-index of a text of symbols: the transform in a wavelet matrix and one suffix position of ``EVERY``;
    the suffix array itself is not kept."""

    EVERY = 8

    def __init__(self, text: np.ndarray):
        text = np.append(text.astype(np.int64) + 1, 0)  # an end of its own, so that occurrences keep their order in walks
        n, rank, span, fresh = len(text), text, 1, np.zeros(1, np.int64)
        order = np.zeros(n, np.int64)
        while span == 1 or fresh[-1] < n - 1:  # until all suffixes are apart: walks through the text need the whole order
            after = np.zeros(n, np.int64)
            after[: n - span] = rank[span:] + 1
            key = rank * (int(after.max()) + 1) + after
            bits = max(1, n - 1).bit_length()
            if int(key.max()).bit_length() + bits <= 63:
                both = np.sort(key << bits | np.arange(n))
                order, ordered = both & ((1 << bits) - 1), both >> bits
            else:
                order = np.argsort(key, kind="stable")
                ordered = key[order]
            fresh = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            span *= 2
        self.size, top = n, int(text.max())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.wavelet = Wavelet(text[order - 1], top)
        # a suffix at a multiple of EVERY is marked; the marked ones' positions stand in suffix order
        marked = order % self.EVERY == 0
        packed = np.packbits(marked, bitorder="little")
        self.marks = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])[:-1]
        self.positions = order[marked].astype(np.int32 if n < 1 << 31 else np.int64)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that start with c and go on as those of [lo, hi)."""
        c = c + 1
        return self.first[c] + self.wavelet.rank(c, lo), self.first[c] + self.wavelet.rank(c, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: each walks back through the text to a marked one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            done = (self.marks[word] >> bit & U(1)).astype(bool)
            own, w = todo[done], word[done]
            out[own] = self.positions[self.before[w] + np.bitwise_count(self.marks[w] & ((U(1) << bit[done]) - U(1)))] + steps[own]
            todo, at = todo[~done], at[~done]
            c = self.wavelet.symbol(at)
            at = self.first[c] + self.wavelet.rank(c, at)
            steps[todo] += 1
        return out

    def statistics(self, stream: np.ndarray, starts: np.ndarray, copies: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a stream of symbols: for each place that ends ``size`` symbols from one of the starts,
        how many symbols up to it, at most size, also end somewhere else; a match is extended backward and ends where
        only the stream's own suffix is left. copies: how many copies of itself each start's text has. Also the interval
        of suffixes of each match of full length."""
        many = len(starts)
        length, lo, hi = np.zeros(many, np.int64), np.zeros(many, np.int64), np.full(many, self.size, np.int64)
        todo = np.arange(many)
        for k in reversed(range(size)):
            a, b = self.extend(stream[starts[todo] + k], lo[todo], hi[todo])
            on = (b - a > 1) | (copies[todo] > 1)
            todo = todo[on]
            length[todo] += 1
            lo[todo], hi[todo] = a[on], b[on]
        return length, lo, hi


def decide(size: int):
    def run(contexts, many, n, doc, base, top):
        lengths = many + size - 1
        data = np.frombuffer(b" ".join(contexts), np.uint8)
        starts, ends, _ = W.bounds(data, np.array([0, len(data)]), W.PLAIN)
        symbols = np.unique(W.hashes(data, starts, ends), return_inverse=True)[1] + 1  # 64 bits name a word
        begin = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(int(lengths.sum()) + len(contexts), np.int64)  # 0 ends a context
        inside = np.ones(len(text), bool)
        inside[begin + lengths] = False
        text[inside] = symbols
        index = Index(text)
        of = np.repeat(np.arange(len(contexts)), many)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        window = begin[of] + offset
        # the contexts' documents are streamed against the index, some places at a time
        found = [index.statistics(text, window[k : k + STEP], n[of[k : k + STEP]], size) for k in range(0, len(window), STEP)]
        length, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        full = np.flatnonzero(length >= size)
        least = np.full(len(of), np.iinfo(np.int64).max)
        if len(full):
            # the least document of each interval above the threshold, its suffixes located
            low, back = np.unique(lo[full], return_inverse=True)
            high = np.zeros(len(low), np.int64)
            high[back] = hi[full]
            sizes = high - low
            head = np.cumsum(sizes) - sizes
            suffixes = np.arange(sizes.sum()) - np.repeat(head, sizes) + np.repeat(low, sizes)
            docs = doc[np.searchsorted(begin, index.locate(suffixes), side="right") - 1]
            least[full] = np.minimum.reduceat(docs, head)[back]
        at = np.flatnonzero(least < top[of])  # some copy of the context is in a later document
        if not len(at):
            return (np.zeros(0, np.int64),) * 6
        x, y = at[1:], at[:-1]
        edge = np.concatenate([[True], (of[x] != of[y]) | (offset[x] != offset[y] + 1) | (least[x] != least[y])])
        first = at[edge]
        last = at[np.concatenate([np.flatnonzero(edge)[1:], [len(at)]]) - 1]
        return of[first], np.zeros(len(first), np.int64), offset[first], offset[last] + size, least[first], np.zeros(len(first), np.int64)

    return run


def _finish(size: int, outputs: tuple[str, ...]):
    kinds = {"kept": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept_sha256": pa.string()}

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                data, at = raw(batch.column(1).slice(a, b - a))
                body = data.tobytes()
                rows: list[list] = [[] for _ in range(2 + len(outputs))]
                for k, (doc, first, spans) in enumerate(zip(*[batch.column(c).slice(a, b - a).to_pylist() for c in (2, 3, 4)], strict=True)):
                    words = body[at[k] : at[k + 1]].split()  # bytes.split() parts at just these six characters
                    runs = [(0, len(words))] if doc > first and len(words) >= size else merged((s["a"], s["b"]) for s in spans or [])
                    parts, last = [], 0
                    for x, y in runs:
                        parts += words[last:x]
                        last = y
                    parts += words[last:]
                    kept = b" ".join(parts)
                    made = {"kept": kept, "spans": [{"start": x, "end": y} for x, y in runs]}
                    if "kept_sha256" in outputs:
                        made["kept_sha256"] = hashlib.sha256(kept).hexdigest()
                    for column, v in zip(rows, [len(words), len(words) - len(parts), *[made[c] for c in outputs]], strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a)] + [pa.array(v, pa.int64()) for v in rows[:2]] + [pa.array(v, kinds[c]) for v, c in zip(rows[2:], outputs, strict=True)], names=["doc_id", "n_words", "n_removed", *outputs])

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE, outputs: tuple[str, ...] = ("kept", "spans"), shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, and of outputs: kept binary, the words left joined by one space, spans
    array<struct<start,end>> in words, kept_sha256) of every row."""
    found = texts(docs)
    info = repeated_spans(found, Words(size), decide(size), lambda kind, from_doc, from_place, doc, place: from_doc < doc, False, shard_bytes, hot)
    whole = found.join(info, KEY).select("doc_id", "body", "doc", "first", "spans")
    sql = {"kept": "binary", "spans": "array<struct<start:long,end:long>>", "kept_sha256": "string"}
    return whole.mapInArrow(_finish(size, outputs), "doc_id long, n_words long, n_removed long" + "".join(f", {c} {sql[c]}" for c in outputs))
