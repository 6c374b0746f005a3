"""Token counts by rank-synchronous merging of arrays.

Texts are normalised and parted into pre-tokens; the distinct pre-tokens of a batch lie one behind another in numpy
arrays of symbols. In each round every pre-token finds its pair of lowest rank and merges all its occurrences (from the
left, without overlap), all pre-tokens at once; when no pre-token has a pair with a rank, the symbols left are counted.
No tokenizer library encodes anything; it is only asked for normalisation and pre-tokens of texts that hold characters
beyond U+024F, where Unicode versions may differ, so that these stay exactly its own.

Scale: a projection over the scan, no shuffle; memory is a slice of text and a bounded memory of pre-tokens.

Defined results: a null text has 0 bytes and 0 tokens. Special tokens' strings inside a text count as one token, as is
the library's default. Repeated rows are counted each; columns named like a result are replaced.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, held, ready, slices, text_bytes, word_bpe_path

#: The pre-token pattern that the vocabulary file names.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Ranks:
    """Pair -> (rank, merged symbol), in an open table of numpy arrays."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        self.bits = max(10, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.zeros(size, np.int32)
        self.into = np.zeros(size, np.int32)
        self.most = 1
        for rank, (a, b, c) in enumerate(pairs):
            key = a << 32 | b
            at, step = self._home(key), 1
            while self.keys[at] not in (-1, key):
                at, step = (at + 1) % size, step + 1
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at], self.into[at] = key, rank, c
            self.most = max(self.most, step)

    def _home(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - self.bits)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs in the table, and which are there."""
        keys = a << 32 | b
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at] == keys
        todo = np.flatnonzero(~found & (self.keys[at] != -1))
        for _ in range(self.most):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[todo]] == keys[todo]
            found[todo[hit]] = True
            todo = todo[~hit & (self.keys[at[todo]] != -1)]
        return at, found


class Counter:
    """Counts tokens of the word-BPE vocabulary of a tokenizers file (byte letters, a word-end suffix)."""

    WORDS = 300_000

    def __init__(self, path: str):
        said = json.load(open(path, encoding="utf-8"))
        model, vocab = said["model"], said["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in said["added_tokens"]) or r"(?!)")
        letters = byte_letters()
        # symbols that begin a pre-token's inside, and those at its end
        self.inner = np.array([vocab.get(x, -1) for x in letters], np.int64)
        self.final = np.array([vocab.get(x + self.suffix, -1) for x in letters], np.int64)
        if (self.inner < 0).any() or (self.final < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        self.ranks = Ranks([(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])])
        self.back = {x: b for b, x in enumerate(letters)}
        self.known: dict[str | bytes, int] = {}
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre = whole.normalizer, whole.pre_tokenizer

    def pretokens(self, text: str) -> list[str] | list[bytes]:
        """Pre-tokens of a text without special tokens, as characters or as UTF-8."""
        if text.isascii() or max(text) < "ɐ":
            return self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        return [bytes(self.back[c] for c in x) for x, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols are left of each non-empty token."""
        return self._merge(np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens)), None)

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids left of tokens that lie one behind another, and how many of each. data: the bytes of all; sizes: of
        each, none empty."""
        done: list = []
        left = self._merge(data, sizes, done)
        if not done:
            return np.zeros(0, np.int64), left
        owner, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbols[np.argsort(owner, kind="stable")], left

    def _merge(self, data: np.ndarray, sizes: np.ndarray, done: list | None) -> np.ndarray:
        tokens = len(sizes)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(tokens), sizes)
        out = np.ones(tokens, np.int64)
        never = np.int32(2**31 - 1)
        while len(symbols):
            at, found = self.ranks.look(symbols[:-1], symbols[1:])
            found &= owner[:-1] == owner[1:]
            # the last symbol of all has no pair; pad so that each token has a minimum
            rank = np.append(np.where(found, self.ranks.ranks[at], never), never)
            firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, firsts)
            sizes = np.diff(np.append(firsts, len(symbols)))
            over = best == never
            out[owner[firsts[over]]] = sizes[over]
            chosen = np.flatnonzero((rank == np.repeat(best, sizes)) & (rank != never))
            # a pair that overlaps the merge before it (x x x) waits: of each run of neighbours every other one goes
            run = np.concatenate([[True], np.diff(chosen) > 1])[: len(chosen)]
            start = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - start) % 2 == 0]
            symbols[chosen] = self.ranks.into[at[chosen]]
            keep = np.repeat(~over, sizes)
            if done is not None and over.any():
                done.append((owner[~keep], symbols[~keep]))
            keep[chosen + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def count(self, texts: list[str]) -> list[int]:
        parts, totals = [], []
        for text in texts:
            extra = 0
            if "<|" in text:
                extra = len(self.special.findall(text))
                pieces = self.special.split(text) if extra else [text]
            else:
                pieces = [text]
            parts.append([t for piece in pieces if piece for t in self.pretokens(piece)])
            totals.append(extra)
        if len(self.known) > self.WORDS:
            self.known.clear()
        known = self.known
        new = list({t for own in parts for t in own if t not in known})
        if new:
            known.update(zip(new, self.merge([t if isinstance(t, bytes) else t.encode() for t in new]).tolist(), strict=True))
        return [extra + sum(map(known.__getitem__, own)) for extra, own in zip(totals, parts, strict=True)]


def counter(path: str) -> Counter:
    return held("counter", path, lambda: Counter(path))


def count_tokens(docs: DataFrame, limit: int = 2048, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    ready(docs)
    path = path or word_bpe_path()
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    to = to_arrow_schema(schema)

    def run(batches):
        c = counter(path)
        for batch in batches:
            for a, b in slices(batch.column(len(kept))):
                part = batch.slice(a, b - a)
                texts = part.column(len(kept))
                counts = c.count([t.decode("utf-8", "replace") for t in texts.to_pylist()])
                columns = [part.column(k) for k in range(len(kept))] + [pa.compute.binary_length(texts), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, to, strict=True)], schema=to)

    import pyarrow.compute  # noqa: F401  pa.compute is loaded on demand

    return docs.select(*kept, text_bytes(text).alias(fresh("_t", kept))).mapInArrow(run, schema)
