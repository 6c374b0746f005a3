"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to 8 dimensions in each of several tables and decoded to the nearest E8 lattice
point; each vector also probes the neighbouring cells nearest to it, so that two vectors meet where any of their cells
agree. In a cell all pairs are verified by cosine in double precision. A pair that meets in several cells counts in the
least one only, which both rows' cell lists tell, so pairs are never emitted: a cell gives each row its number of links
and a spanning forest of the links. The lists are not shipped: a task makes those of its linked rows again, in arithmetic
whose result depends on the row alone.

Scale: equal vectors are one class with a count; a class is shuffled to each of its cells, in the floats it is stored in. ``blocks`` lattice points
make up one cell's name; it grows with the logarithm of the number of classes, so cells keep their size, and the number
of tables grows with it, so that recall at the threshold does not fall (``TABLES_AT``). Beyond three blocks cells grow
instead. Cells of more than ``cell_rows`` rows are compared as pairs of salted blocks of rows, so no task holds a whole hot cell; nothing is
dropped.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing (0 links, a
component of their own); vectors of different length never link; labels and other columns play no part; rows with
null vec_id link with nothing, component_id null and kept true; rows of one vec_id are linked with one another and
each other's copies count as other vectors. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ready
from .components import components
from .minhash import spanning

COSINE, TABLES, PROBES, STEP = 0.9, 8, 2, 0.25
#: Tables by blocks. One table lets a pair of cosine 0.9 meet with a measured probability of 0.78, 0.43 and 0.19 at least
#: (16 to 384 dimensions), so that independent tables would all miss it with probability 6e-6 at each number of blocks;
#: measured misses: 0, 1 and 0 of 12,000 pairs.
TABLES_AT = {1: TABLES, 2: 22, 3: 58}
CELL_ROWS = 4096
#: Classes that one lattice point a cell's name serves well; more blocks beyond.
PER_BLOCK = 400_000


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


NEAR = neighbours()


def _d8(y: np.ndarray) -> np.ndarray:
    """The nearest points of D8: integers of even sum."""
    z = np.rint(y)
    odd = np.flatnonzero(z.sum(1) % 2 != 0)
    if len(odd):
        d = y[odd] - z[odd]
        k = np.argmax(np.abs(d), 1)
        z[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
    return z


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 points: of D8 and of D8 moved by a half."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def _name(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name of each row of lattice points."""
    h = np.full(len(points), salt, np.uint64)
    for k in range(points.shape[1]):
        h = (h ^ (2 * points[:, k]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


@lru_cache(maxsize=4)
def _projections(dim: int, tables: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(dim, tables * blocks * 8) random projections and their shifts."""
    out, shifts = [], []
    for t in range(tables):
        rng = np.random.default_rng([dim, t])
        for _ in range(blocks):
            out.append(np.linalg.qr(rng.standard_normal((dim, 8)))[0] if dim >= 8 else rng.standard_normal((dim, 8)) / np.sqrt(8))
            shifts.append(rng.uniform(0, 1, 8))
    return np.concatenate(out, 1), np.concatenate(shifts)


def _times(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x @ m, summed in one order: a row's result is the same to the last bit whatever rows come with it."""
    out = np.zeros((len(x), m.shape[1]))
    for k in range(m.shape[0]):
        out += x[:, k : k + 1] * m[k]
    return out


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, blocks: int = 1, step: float = STEP) -> np.ndarray:
    """Names of the cells of each unit vector: rows * (tables * (probes + 1) for each block's probes)."""
    dim = x.shape[1]
    g, shifts = _projections(dim, tables, blocks)
    # the spread of a projected unit vector is 1 / sqrt(dim) a coordinate, whatever dim
    every = _times(x, g) * (np.sqrt(dim) / 8) / step + shifts
    out = []
    for t in range(tables):
        homes, others = [], []
        for b in range(blocks):
            y = every[:, 8 * (t * blocks + b) :][:, :8]
            home = decode(y)
            others.append(np.argpartition(-_times(y - home, NEAR.T), min(probes, 239), axis=1)[:, :probes])
            homes.append(home)
        home = np.concatenate(homes, 1)
        out.append(_name(home, 1000 * dim + t))
        for p in range(probes):
            for b in range(blocks):  # one block moves to a neighbour at a time
                moved = home.copy()
                moved[:, 8 * b : 8 * b + 8] += NEAR[others[b][:, p]]
                out.append(_name(moved, 1000 * dim + t))
    return np.stack(out, 1)


def layout(classes: int) -> int:
    """The blocks of a cell's name for so many classes."""
    return min(max(TABLES_AT), 1 + int(max(0.0, np.ceil(np.log(max(1, classes) / PER_BLOCK) / np.log(40)))))


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    squares = np.zeros(len(x))
    for k in range(x.shape[1]):  # in one order, as in _times()
        squares += x[:, k] * x[:, k]
    return x / np.sqrt(squares)[:, None]


def _by_dim(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of a column of lists without nulls."""
    starts = column.offsets.to_numpy()
    size, values = np.diff(starts), column.values.to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        out.append((own, values[starts[own][:, None] + np.arange(d)]))
    return out


def _cells_of(tables: int, probes: int, blocks: int, step: float, kind: type | None):
    some = max(1, 24_000 // (tables * (1 + probes * blocks)))  # 1,000 rows at one block

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, some):
                part = batch.slice(lo, some)
                for own, vectors in _by_dim(part.column(0)):
                    names = cells(unit(vectors), tables, probes, blocks, step)
                    names.sort(axis=1)
                    keep = np.concatenate([np.ones((len(own), 1), bool), names[:, 1:] != names[:, :-1]], 1)
                    row, place = np.nonzero(keep)
                    cell = pa.array(names[row, place])
                    if kind is None:
                        yield pa.RecordBatch.from_arrays([cell], names=["cell"])
                        continue
                    take = pa.array(own[row])
                    bodies = pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())
                    yield pa.RecordBatch.from_arrays([cell, *[part.column(k).take(take) for k in (1, 2, 3, 4)], bodies.take(pa.array(row))], names=["cell", "k", "k2", "rep", "n", "body"])

    return run


def candidates(x: np.ndarray, side: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a cell that link with others of it, and the links among them. side: the block of each row, if only links
    across two blocks are asked for."""
    linked = x @ x.T >= cosine
    linked.reshape(-1)[:: len(x) + 1] = False
    if not linked.any():  # most cells
        return np.empty(0, np.int64), linked[:0, :0]
    if side is not None:
        linked &= side[:, None] != side[None, :]
    rows = np.flatnonzero(linked.any(1))
    return rows, linked[np.ix_(rows, rows)]


def first_met(linked: np.ndarray, names: np.ndarray, cell: int) -> np.ndarray:
    """The links of rows that meet in no lesser cell; names: the cells of each row."""
    owner, column = np.nonzero(names < cell)
    lesser, place = np.unique(names[owner, column], return_inverse=True)
    for lo in range(0, len(lesser), 2048):  # a block of lesser cells at a time
        dense = np.zeros((len(linked), min(2048, len(lesser) - lo)), np.float32)
        own = (place >= lo) & (place < lo + 2048)
        dense[owner[own], place[own] - lo] = 1
        linked = linked & (dense @ dense.T < 0.5)
    return linked


#: Linked rows of several cells whose own cells are made at once.
SOME_ROWS = 1000


def _bodies(column: pa.Array, kind: type) -> list | np.ndarray:
    """Unit vectors of a column of bodies, row by row; an array if all have one length."""
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size, data = np.diff(starts), np.frombuffer(column.buffers()[2], np.uint8)
    out = [None] * len(column)
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        if len(own) == len(column):
            return unit(data[starts[0] : starts[-1]].view(kind).reshape(len(column), -1))
        for i, v in zip(own, unit(data[starts[own][:, None] + np.arange(d)].view(kind)), strict=True):
            out[i] = v
    return out


def _compare(cosine: float, kind: type, tables: int, probes: int, blocks: int, step: float):
    def run(batches):
        waiting, held = [], 0

        def close(now, x, side, names):
            """One cell's rows, or those of two blocks of it."""
            nonlocal held
            found, linked = candidates(np.asarray(x), None if now[1] == now[2] else side, cosine)
            if len(found):
                waiting.append((now[0], np.asarray(x)[found], linked, [v[found] for v in names]))
                held += len(found)

        def flush():
            nonlocal held
            out = []
            for dim in {x.shape[1] for _, x, _, _ in waiting}:
                own = [w for w in waiting if w[1].shape[1] == dim]
                every = cells(np.concatenate([x for _, x, _, _ in own]), tables, probes, blocks, step)
                at = 0
                for cell, x, linked, (k, k2, rep, n) in own:
                    linked = first_met(linked, every[at : at + len(x)], cell)
                    at += len(x)
                    out += [(int(k[i]), int(k2[i]), int(c)) for i, c in enumerate(linked @ n) if c]
                    out += [(int(rep[a]), int(rep[b]), -1) for a, b in spanning(linked)]
            waiting.clear()
            held = 0
            return out

        now, open_ = None, []  # the cell that the last batch ended in, and its rows so far

        def end():
            if sum(len(part[1]) for part in open_) > 1:
                x, side, *names = zip(*open_, strict=True)
                close(now, np.concatenate([np.asarray(v) for v in x]), np.concatenate(side), [np.concatenate(v) for v in names])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, c, d, side, *names = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            x = _bodies(batch.column(8), kind)
            at = np.flatnonzero((cell[1:] != cell[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])) + 1
            starts, ends = [0, *at.tolist()], [*at.tolist(), batch.num_rows]
            for lo, hi in zip(starts, ends, strict=True):
                if lo and hi - lo == 1 and hi < batch.num_rows:
                    continue  # a cell of one row
                key = (int(cell[lo]), int(c[lo]), int(d[lo]))
                part = (x[lo:hi], side[lo:hi], *[v[lo:hi] for v in names])
                if lo and hi < batch.num_rows:
                    close(key, *part[:2], part[2:])
                elif key == now:
                    open_.append(part)
                else:
                    end()
                    now, open_ = key, [part]
                if held >= SOME_ROWS and (found := flush()):
                    yield _found(found)
        end()
        if found := flush():
            yield _found(found)

    return run


def _found(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["x", "y", "links"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, probes: int = PROBES, step: float = STEP, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding)."""
    ready(vectors)
    v = F.col("embedding")
    whole = F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v, F.when(whole & F.col("vec_id").isNotNull(), True).otherwise(False).alias("good"))
    rows = rows.select("vec_id", "embedding", "good", F.xxhash64("embedding").alias("k"), F.xxhash64(F.lit(7), "embedding").alias("k2"))
    real = rows.where("good")
    classes = cut(real.groupBy("k", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "vectors")
    if blocks is None:
        blocks = layout(classes.count())
    if tables is None:
        tables = TABLES_AT[blocks]
    given = classes.select("embedding", "k", "k2", "rep", "n")
    kind = np.float32 if rows.schema[1].dataType.elementType == T.FloatType() else np.float64  # bodies are shipped as they are stored
    sizes = classes.select("embedding").mapInArrow(_cells_of(tables, probes, blocks, step, None), "cell long").groupBy("cell").agg(F.count("*").alias("rows"))
    big = cut(sizes.where(F.col("rows") > cell_rows).withColumn("parts", F.ceil(F.col("rows") * 2 / cell_rows).cast("int")), "cells")
    placed = given.mapInArrow(_cells_of(tables, probes, blocks, step, kind), "cell long, k long, k2 long, rep long, n long, body binary")
    if big.isEmpty():
        dealt = placed.select("cell", F.lit(0).alias("c"), F.lit(0).alias("d"), F.lit(0).alias("side"), "k", "k2", "rep", "n", "body")
    else:
        parts = F.coalesce("parts", F.lit(1))
        dealt = placed.join(big.select("cell", "parts"), "cell", "left").withColumn("side", F.pmod(F.xxhash64("k2"), parts).cast("int"))
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1))).select("cell", F.least("side", "o").alias("c"), F.greatest("side", "o").alias("d"), "side", "k", "k2", "rep", "n", "body")
    found = dealt.repartition("cell", "c", "d").sortWithinPartitions("cell", "c", "d", "rep", "k").mapInArrow(_compare(cosine, kind, tables, probes, blocks, step), "x long, y long, links long")
    found = cut(found, "found")
    counts = found.where("links > 0").groupBy(F.col("x").alias("k"), F.col("y").alias("k2")).agg(F.sum("links").alias("links"))
    edges = found.where("links < 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    placed_ids = real.select("vec_id", "k", "k2").join(classes.select("k", "k2", "rep"), ["k", "k2"]).select("vec_id", "rep")
    same = placed_ids.groupBy("vec_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.collect_set("rep").alias("reps")).where("lo <> hi").select(F.col("lo").alias("a"), F.explode("reps").alias("b"))
    groups = components(edges.unionByName(same))
    by_class = classes.select("k", "k2", "rep", "n").join(counts, ["k", "k2"], "left").join(groups, F.col("rep") == F.col("node"), "left")
    by_class = by_class.select("k", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "k", "k2", "good").join(by_class, ["k", "k2"], "left")
    out = out.select("vec_id", F.when(F.col("good"), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(F.col("good"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
