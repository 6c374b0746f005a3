"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised (A-Z lowered, every run of other characters one space), cut into windows of
n words and put into one automaton, whose symbols are words: a distinct word of the benchmark is a number, every other
word is 0. Each text is normalised alike and scanned once; word places of matches are mapped to offsets of the original.

Scale: texts are never shuffled. The automaton has at most 2 n nodes for a word of the benchmark: 265 MB, measured, for
2 MB of random words, the most that a block holds (140 MB for 1 MB). The
benchmark is measured first; past ``block_bytes`` it is split by a hash of its item into blocks, each scanned as one
stated query set against all texts, with the texts' hits carried from block to block, so no automaton grows with it.

Defined results: a null or word-less text has no words and no hit; an item without words has no window; an item of
fewer than n words is one window; rows with equal item_id are one item; an item with null item_id still marks words
but is listed nowhere; repeated documents are judged each; other columns of documents pass through unless
they have the name of a result column, which then replaces them.
"""

from __future__ import annotations

import hashlib
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held, raw, ready, slices, text_bytes

#: Lowers A-Z, keeps 0-9, a-z and every byte from 0x80 on; all others become a space.
NORMAL = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
RESULT = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("spans", T.ArrayType(SPAN))]


def words_of(text: bytes) -> list[bytes]:
    # bytes.split() parts at ASCII white space, of which only the space is left
    return text.translate(NORMAL).split()


class Windows:
    """One automaton over the items' windows of n words, an item of fewer being one window. Its symbols are the two digits
    of a word's number, from ranges of their own, so that no state has many branches and matches begin at words."""

    DIGIT = 512
    NONE = (0, 0)  # a word that no item has

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.names = sorted({item for item, _ in items if item is not None})
        place = {item: k for k, item in enumerate(self.names)}
        self.words: dict[bytes, tuple[int, int]] = {}
        self.owners: list[tuple[int, ...]] = [()]  # the items of a window; windows that follow one another share an entry
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        #: Windows of fewer than n words, with their words: the place of a match does not tell their size.
        self.short: dict[tuple[int, ...], int] = {}
        self.n = n
        for item, text in items:
            ids: list[int] = []
            for w in words_of(text):
                if w not in self.words:
                    k = len(self.words)
                    self.words[w] = (self.DIGIT + 1 + k // self.DIGIT, 1 + k % self.DIGIT)
                ids += self.words[w]
            if 0 < len(ids) < 2 * n:
                self.short[tuple(ids)] = len(ids) // 2
            for k in range(max(1, len(ids) // 2 - n + 1) if ids else 0):
                window = tuple(ids[2 * k : 2 * (k + n)])
                before = self.found.get(window, -1)
                own = self.owners[max(0, before)]
                if item is not None and place[item] not in own:
                    own = (*own, place[item])
                if own != self.owners[-1] and own:
                    self.owners.append(own)
                at = len(self.owners) - 1 if own else 0
                if before < 0 or own != self.owners[before]:
                    self.found.add_word(window, at)
        self.lengths = sorted(set(self.short.values()))
        self.any = bool(self.words)
        if self.any:
            self.found.make_automaton()

    def size(self, ids: tuple[int, ...], end: int) -> int:
        """The words of the longest window that ends before a place; shorter ones lie in it."""
        if not self.short or end >= 2 * self.n and self.found.exists(ids[end - 2 * self.n : end]):
            return self.n
        return next(m for m in reversed(self.lengths) if 2 * m <= end and ids[end - 2 * m : end] in self.short)


def scan(text: bytes, found: Windows) -> tuple[int, list[tuple[int, int]], set]:
    """Words of the text, merged spans of hit words, ids of the items that occur."""
    words = words_of(text)
    if not words or not found.any:
        return len(words), [], set()
    ids = tuple(chain.from_iterable(map(found.words.get, words, repeat(found.NONE))))
    spans, owners, last = [], set(), -1
    for at, own in found.found.iter(ids):
        owners.update(found.owners[own])
        if at != last:
            last, end = at, (at + 1) // 2
            spans.append((end - found.size(ids, at + 1), end))
    return len(words), merged(spans), {found.names[k] for k in owners}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def original(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of words as code-point offsets of the text before normalisation."""
    if not spans:
        return []
    inside = np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in spans]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and spans (hit runs as offsets of the original)."""
    ready(docs)
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), text_bytes("text").alias("body"))
    size = items.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kept = [c for c in docs.columns if c.lower() not in {k for k, _ in RESULT}]
    own = [fresh(c, [*docs.columns, *(c for c, _ in RESULT)]) for c in ("_b", "_w", "_i")]
    out = docs.select(*kept, text_bytes(text).alias(own[0]))
    carried = [T.StructField(own[0], T.BinaryType()), T.StructField(own[1], T.ArrayType(T.LongType())), T.StructField(own[2], T.ArrayType(T.StringType()))]
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k)
        # bounded: a block has block_bytes of text on average, whatever the size of the benchmark
        held_items = sorted(((r["item"], bytes(r["body"])) for r in part.collect()), key=repr)
        shared, name = spark.sparkContext.broadcast(held_items), hashlib.sha256(repr(held_items).encode()).hexdigest()
        first, last = k == 0, k == blocks - 1
        fields = [out.schema[c] for c in kept] + ([T.StructField(c, t) for c, t in RESULT] if last else carried)
        out = out.mapInArrow(_scanner(shared, name, n, own, kept, first, last, T.StructType(fields)), T.StructType(fields))
    return out


def _scanner(shared, name, n, own, kept, first, last, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    to = to_arrow_schema(schema)

    def run(batches):
        found = held("automaton", (name, n), lambda: Windows(shared.value, n))  # known by the digest of its items
        for batch in batches:
            whole = batch.column(len(kept))
            for a, b in slices(whole):
                data, at = raw(whole.slice(a, b - a))
                texts = data.tobytes()
                rows: dict = {k: [] for k in ([c for c, _ in RESULT] if last else own[1:])}
                before = [None] * (b - a) if first else list(zip(*[batch.column(len(kept) + c)[a:b].to_pylist() for c in (1, 2)], strict=True))
                for i in range(b - a):
                    body = texts[at[i] : at[i + 1]]
                    count, spans, owners = scan(body, found)
                    if not first:
                        spans = merged(spans + list(zip(before[i][0][::2], before[i][0][1::2], strict=True)))
                        owners |= set(before[i][1])
                    if last:
                        hit = sum(y - x for x, y in spans)
                        for c, v in zip(rows, (count, hit, len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), hit > 0, original(body, spans)), strict=True):
                            rows[c].append(v)
                    else:
                        rows[own[1]].append([x for s in spans for x in s])
                        rows[own[2]].append(sorted(owners))
                part = batch.slice(a, b - a)
                columns = [part.column(k) for k in range(len(kept) + (not last))] + [pa.array(v, to.field(c).type) for c, v in rows.items()]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, to, strict=True)], schema=to)

    return run
