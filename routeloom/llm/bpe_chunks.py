"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts each text into chunks where the content says so, hence texts that share passages
share chunks; each distinct chunk a Python worker meets is encoded once (a bounded memory of chunks). Chunk ids are
then joined: a cut may fall inside a word, or a special token, so the words on both sides of the cut are encoded again
together. The join is accepted when the left word's ids are the end of the left chunk's and the right word's the start
of the right chunk's, both exactly; otherwise one more word is taken on either side, down to encoding both chunks anew.
White space ends every pre-token and special token of the word-BPE vocabulary, so an agreed join equals encoding the
whole text; a tokenizer for which this is not known has to be used with ``reuse=False``.

Scale: a projection over the scan, no shuffle; memory is bounded by chunk and word memories and one slice of text.

Defined results: a null text is an empty one: no ids, decoded to the empty string. Repeated rows are encoded each.
Columns of docs named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import os
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, held, ready, slices, text_bytes, word_bpe_path
from .token_counts import Counter
from .words import LOWER

MASK, LEAST, WINDOW, STEP = 0x3FF, 256, 32, 1 << 14
#: Of ASCII characters: 0 white space, 1 letters, 2 digits, 3 all others.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x20] = 0
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of the last WINDOW bytes: sums of doubling spans, no loop over bytes."""
    h = _GEAR[data]
    span = 1
    while span < WINDOW:
        h2 = h * np.uint32(0x01000193 ** span & 0xFFFFFFFF)
        h2[span:] += h[:-span]
        h, span = h2, span * 2
    return h ^ (h >> np.uint32(15))


def cuts(data: np.ndarray, least: int = LEAST, mask: int = MASK) -> list[int]:
    """Ends of the chunks: content-defined, at least ``least`` bytes apart, never inside a code point."""
    marks = np.flatnonzero((rolling(data) & np.uint32(mask)) == 0) + 1
    out, last = [], 0
    for m in marks.tolist():
        if m - last >= least and m < len(data) and (data[m] & 0xC0) != 0x80:
            out.append(m)
            last = m
    return [*out, len(data)]


class Encoder:
    """Encodes UTF-8 texts by reused chunks; ids are little-endian unsigned 32-bit numbers. Memories are emptied when full."""

    CHUNK_BYTES, WORDS = 12 << 20, 250_000

    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are held as little-endian 32-bit numbers")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.merger = Counter(path)
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.size = self.reused = self.met = 0

    def plain(self, texts: list[bytes]) -> list[bytes]:
        """ids of each text as the library gives them, nothing reused."""
        found = self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def pieces(self, texts: list[bytes]) -> list[bytes]:
        """ids of each text; words between white space that were met before are not encoded again."""
        parts = [t.split() for t in texts]
        new = {w for own in parts for w in own}.difference(self.words)
        if len(self.words) + len(new) > self.WORDS:
            self.words.clear()
            new = {w for own in parts for w in own}
        if new:
            self._learn(new)
        return [b"".join(map(self.words.__getitem__, own)) for own in parts]

    def _learn(self, new: set[bytes]) -> None:
        """Words up to U+024F are parted into pre-tokens and merged as arrays, all at once; the library encodes those
        beyond and those that may hold a special token."""
        ascii_, other, rest = [], [], []
        for w in new:
            if w.isascii() and b"'" not in w and b"<|" not in w:
                ascii_.append(w)
            elif b"<|" in w or max(w.decode("utf-8", "replace")) >= "ɐ":
                rest.append(w)
            else:
                other.append(w)
        # ASCII words without contractions: a pre-token ends where letters, single digits and other signs change
        data = LOWER[np.frombuffer(b" ".join(ascii_), np.uint8)]
        kind = _KIND[data]
        inside = kind > 0
        first = inside & (np.concatenate([[True], kind[1:] != kind[:-1]])[: len(kind)] | (kind == 2))
        of = np.cumsum(~inside)[first]
        place = np.flatnonzero(first[inside])
        self._keep(ascii_, data[inside], np.diff(np.append(place, int(inside.sum()))), of)
        parts = [[x.encode() for x in self.merger.pretokens(w.decode("utf-8", "replace"))] for w in other]
        flat = [x for own in parts for x in own]
        self._keep(other, np.frombuffer(b"".join(flat), np.uint8), np.fromiter(map(len, flat), np.int64, len(flat)), np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts))))
        self.words.update(zip(rest, self.plain(rest), strict=True))

    def _keep(self, words: list[bytes], data: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> None:
        """Encode pre-tokens; of: the word of each."""
        if not words:
            return
        ids, left = self.merger.encode(data, sizes)
        ends = (4 * np.cumsum(np.bincount(of, weights=left, minlength=len(words)).astype(np.int64))).tolist()
        body = ids.astype("<u4").tobytes()
        self.words.update(zip(words, [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """ids of each text, equal to encoding it whole."""
        parts: list[list[bytes]] = []
        need: dict[bytes, None] = {}
        for text in texts:
            own, last = [], 0
            for cut in cuts(np.frombuffer(text, np.uint8)) if text else []:
                # a chunk without two ends of words could not be joined, so it goes on to the next cut
                if cut == len(text) or len(text[last:cut].split(None, 2)) > 2:
                    own.append(text[last:cut])
                    last = cut
            self.met += len(own)
            for piece in own:
                if piece in self.chunks or piece in need:
                    self.reused += 1
                else:
                    need[piece] = None
            parts.append(own)
        ahead = []  # the words at the joins, so that they are learned at once with the chunks'
        for own in parts:
            for left, right in zip(own, own[1:], strict=False):
                tail, head = left[_back(left, len(left)) :], right[: _on(right, 0)]
                ahead += [tail, head, tail + head]
        for piece, found in zip(need, self.pieces([*need, *ahead]), strict=False):
            self.chunks[piece] = found
            self.size += len(piece) + len(found) + 200
        out = [self.joined(own, [self.chunks[x] for x in own]) for own in parts]
        if self.size > self.CHUNK_BYTES:
            self.chunks.clear()
            self.size = 0
        return out

    def joined(self, parts: list[bytes], ids: list[bytes]) -> bytes:
        if not parts:
            return b""
        done: list[bytes] = []
        text, found = parts[0], ids[0]
        for right, right_ids in zip(parts[1:], ids[1:], strict=True):
            agreed, text, found = self.repaired(text, found, right, right_ids)
            done.append(agreed)
        return b"".join([*done, found])

    def repaired(self, left: bytes, left_ids: bytes, right: bytes, right_ids: bytes) -> tuple[bytes, bytes, bytes]:
        """ids of the left text up to the last agreed place, then what stays open: its text and ids."""
        a, b = len(left), 0
        while True:
            a, b = _back(left, a), _on(right, b)  # one more word on either side
            if a == 0 or b == len(right):
                # no white space on one side: both stay open as one text, encoded anew
                return b"", left + right, self.pieces([left + right])[0]
            x, y, both = self.pieces([left[a:], right[:b], left[a:] + right[:b]])
            if left_ids.endswith(x) and right_ids.startswith(y):
                return left_ids[: len(left_ids) - len(x)] + both, right[b:], right_ids[len(y) :]


def _back(text: bytes, at: int) -> int:
    """Where the last word before ``at`` starts; white space before ``at`` is passed over."""
    at = len(text[:at].rstrip())
    found = max(text.rfind(c, 0, at) for c in _SPACES)
    return found + 1


def _on(text: bytes, at: int) -> int:
    """Where the first word from ``at`` on ends."""
    n = len(text)
    at = n - len(text[at:].lstrip())
    ends = [k for c in _SPACES if (k := text.find(c, at)) >= 0]
    return min(ends) if ends else n


_SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")


def encoder(path: str) -> Encoder:
    return held("encoder", path, lambda: Encoder(path))


def encode_decode(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None, outputs: tuple[str, ...] = ("ids", "decoded"), reuse: bool = True) -> DataFrame:
    """docs (or its columns ``keep``) with the ``outputs`` asked for: ids array<int>, decoded string, n_tokens long,
    ids_sha256 (ids as little-endian unsigned 32-bit) and decoded_sha256 strings."""
    ready(docs)
    path = path or word_bpe_path()
    kinds = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in outputs]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, kinds[c]) for c in outputs])
    decoding = any(c.startswith("decoded") for c in outputs)
    from pyspark.sql.pandas.types import to_arrow_schema

    to = to_arrow_schema(schema)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for a, b in slices(batch.column(len(kept))):
                part = batch.slice(a, b - a)
                texts = part.column(len(kept)).to_pylist()
                ids = enc.encode(texts) if reuse else enc.plain(texts)
                decoded = enc.tok.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False) if decoding else []
                made = {
                    "ids": lambda: [np.frombuffer(x, "<i4") for x in ids],
                    "decoded": lambda: decoded,
                    "n_tokens": lambda: [len(x) // 4 for x in ids],
                    "ids_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": lambda: [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
                }
                columns = [part.column(k) for k in range(len(kept))] + [pa.array(made[c](), to.field(c).type) for c in outputs]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, to, strict=True)], schema=to)

    return docs.select(*kept, text_bytes(text).alias(fresh("_t", kept))).mapInArrow(run, schema)
