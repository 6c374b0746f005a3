"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted by its
place (rotation, then product); a document's vector bundles (sums) its n-grams' vectors; a language's prototype bundles
the unit vectors of its labelled documents. The prediction is the prototype with the largest cosine.

Scale: texts are never shuffled. Learning reads at most about ``sample`` labelled documents of each language (chosen
by a hash of their key) and each task returns one integer vector a language; prototypes take 8 * dims bytes a language.
Sums are of integers, so the model does not depend on the order of tasks.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was
learned. Letters are Unicode letters, lowered; all else between letters counts as one space. Ties go to the language
first by name. Score is the cosine, 0 if negative. Rows with null lang are not learned from, nor rows with null doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_BYTES, fresh, held, ready, slices

DIMS, GRAM, SAMPLE = 1024, 3, 4000
_POINTS = 0x110000
_UNIT = 1 << 20


class Grams:
    """Vectors of n-grams, made when first met; a cache that is emptied when full."""

    LIMIT = 60_000

    def __init__(self, dims: int = DIMS, n: int = GRAM):
        self.dims, self.n, self.letters = dims, n, {}
        self.letter = np.fromiter((chr(i).isalpha() for i in range(_POINTS)), bool, _POINTS)
        self.clear()

    def clear(self) -> None:
        self.codes, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors, self.used = np.zeros((1024, self.dims), np.int8), 0

    def letter_vector(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[point] = np.random.default_rng(7_919 + point).choice(np.array([-1, 1], np.int8), self.dims)
        return self.letters[point]

    def gram_vector(self, code: int) -> np.ndarray:
        out = np.ones(self.dims, np.int8)
        for place in range(self.n):
            out = out * np.roll(self.letter_vector((code >> (21 * place)) & 0x1FFFFF), place)
        return out

    def look(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the sorted codes in self.vectors."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        new = codes[~known]
        if len(new):
            if self.used + len(new) > self.LIMIT:
                self.clear()
                new = codes
            if self.used + len(new) > len(self.vectors):
                grown = np.zeros((max(2 * len(self.vectors), self.used + len(new)), self.dims), np.int8)
                grown[: self.used] = self.vectors[: self.used]
                self.vectors = grown
            for k, code in enumerate(new):
                self.vectors[self.used + k] = self.gram_vector(int(code))
            merged = np.concatenate([self.codes, new])
            rows = np.concatenate([self.rows, np.arange(self.used, self.used + len(new))])
            order = np.argsort(merged, kind="stable")
            self.codes, self.rows, self.used = merged[order], rows[order], self.used + len(new)
            at = np.searchsorted(self.codes, codes)
        return self.rows[at]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Codes of the text's n-grams with their counts, or None without a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        good = self.letter[points]
        if not good.any():
            return None
        points = np.where(good, points, 32)
        keep = np.ones(len(points), bool)
        keep[1:] = good[1:] | good[:-1]
        points = np.concatenate([[32], points[keep], [32]])
        points = points[1:] if points[1] == 32 else points
        points = points[:-1] if points[-2] == 32 else points
        codes = points[self.n - 1 :].copy()
        for back in range(1, self.n):
            codes |= points[self.n - 1 - back : len(points) - back] << (21 * back)
        return np.unique(codes, return_counts=True)

    def vector(self, text: str) -> np.ndarray | None:
        """The text's bundle, or None without a letter."""
        found = self.counts(text)
        if found is None:
            return None
        codes, counts = found
        out = np.zeros(self.dims, np.float32)
        for k in range(0, len(codes), 2_000):
            rows = self.look(codes[k : k + 2_000])
            out += counts[k : k + 2_000].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return out


def grams(dims: int, n: int) -> Grams:
    return held("grams", (dims, n), lambda: Grams(dims, n))


def learn(labelled: DataFrame, dims: int = DIMS, n: int = GRAM, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Prototypes by language from (doc_id, text, lang) rows; about ``sample`` documents of each language at most."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return {}
    if len(sizes) > 2_000:
        raise ValueError(f"{len(sizes)} languages: prototypes would not be small; is lang a language?")
    share = F.coalesce(F.create_map(*[F.lit(x) for lang, size in sizes.items() for x in (lang, min(1.0, sample / size))])[F.col("lang")], F.lit(1.0))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1_000_000
    chosen = rows.where(draw < share).select("lang", F.col("text").cast("binary").alias("text"))

    def run(batches):
        g, sums = grams(dims, n), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b in slices(batch.column(1), SLICE_BYTES):
                for lang, text in zip(langs[a:b], batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    v = g.vector(text.decode("utf-8", "replace"))
                    if v is not None and (size := float(np.sqrt(np.dot(v, v)))):
                        sums.setdefault(lang, np.zeros(dims, np.int64))
                        sums[lang] += np.rint(v * (_UNIT / size)).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = chosen.mapInArrow(run, "lang string, v array<long>")
    total = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in total.collect():  # languages * dims rows
        out.setdefault(r["lang"], np.zeros(dims))[r["k"]] = r["x"]
    return {lang: out[lang] / max(np.linalg.norm(out[lang]), 1e-12) for lang in sorted(out)}


def identify(docs: DataFrame, labelled: DataFrame, dims: int = DIMS, n: int = GRAM, sample: int = SAMPLE) -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced), learned from ``labelled``."""
    ready(docs)
    model = learn(labelled, dims, n, sample)
    names = sorted(model)
    matrix = np.array([model[x] for x in names]).astype(np.float32).T if names else None
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    to = to_arrow_schema(schema)

    def said(g: Grams, text: bytes | None) -> tuple[str, float]:
        v = None if text is None or matrix is None else g.vector(text.decode("utf-8", "replace"))
        if v is None:
            return "und", 0.0
        cosines = (v @ matrix) / max(float(np.sqrt(np.dot(v, v))), 1e-12)
        k = int(np.argmax(cosines))
        return names[k], float(min(1.0, max(0.0, cosines[k])))

    def run(batches):
        g = grams(dims, n)
        for batch in batches:
            for a, b in slices(batch.column(len(kept)), SLICE_BYTES):
                part = batch.slice(a, b - a)
                found = [said(g, t) for t in part.column(len(kept)).to_pylist()]
                columns = [part.column(k) for k in range(len(kept))] + [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, to, strict=True)], schema=to)

    return docs.select(*kept, F.col("text").cast("binary").alias(fresh("_t", kept))).mapInArrow(run, schema)


def remainder(key: str = "doc_id") -> Column:
    """crc32 of the key as text, mod 4; -1 for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)), F.lit(-1))
