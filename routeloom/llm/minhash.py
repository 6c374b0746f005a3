"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct n-word shingles. Equal sets are one class, joined by their digest and named by a
number of its own, so that two texts under one doc_id stay apart. Classes are put
into ``trees`` independent trees: a tree's root branches by the least token under its own hash; small nodes are compared
exhaustively on whole sets; larger ones branch again by further chosen minwise tokens (two a node, each kept by a linked
pair with probability 0.75 or more), and nodes that do not shrink are compared exhaustively after a number of levels.
A pair at the threshold is missed by one root with probability 0.25, by all with 0.25 ** trees = 2.4e-7. A branched node
keeps it with probability 1 - (1 - 0.75 q) ** 2, where q is that of its children: 0.94 after one level, 0.89 after any
number; every tree and level has hash functions of its own, so where all roots branch it is missed with probability
(1 - 0.75 * 0.89) ** trees = 6e-6. A node returns a spanning
forest of its confirmed links, never all its pairs, and components of these are components of all links found. Of nodes with the same classes one is
compared, where it is compared exhaustively; nodes that branch further all do.

Scale: texts are shuffled once, and only classes in nodes of two or more go on from there. Nodes of more than
``node_rows`` classes are branched by Spark, level by level, before any task gets them; what is still larger after
``levels`` is compared in pairs of salted blocks, so no task holds more than two blocks, and nothing is dropped. The
minima that branch come from the sets again, of classes in large nodes only, made where the texts are read: a filter of
fixed size tells which texts may be meant, and no text is shuffled for them.

Defined results: null or word-less text: empty set, linked with nothing; fewer than n words: the whole sequence is the
one shingle; rows with a null doc_id are linked with nothing, component_id null and kept true; rows that share a doc_id
count as linked with one another; repeated rows are returned each. Columns of docs are not passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import cut, raw, ready, slices, text_bytes
from .components import components

SHINGLE, PERCENT, TREES = 5, 75, 11
#: A node of so many rows is compared exhaustively at once, in blocks of about so many tokens.
LEAF_ROWS, LEAF_TOKENS = 2048, 4_000_000
NODE_ROWS, LEVELS = 4096, 8
#: Hash functions: of the roots; from BRANCHES on two for each tree and level; from INNER on those of compare().
BRANCHES, INNER = 64, 2048
U = np.uint64
_rng = np.random.default_rng(0xC0FFEE)
_MUL = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE):
    """The sorted set of shingle fingerprints of each text."""
    data = W.LOWER[data]
    starts, ends, at = W.bounds(data, offsets, W.PLAIN)
    h = W.hashes(data, starts, ends)
    every = W.windows(h, n)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield W.mix(np.array([np.sum(h[a:b] * W.PLACE[: b - a], dtype=np.uint64) + U(b - a)]))
        else:
            yield np.zeros(0, np.uint64)


def least(tokens: np.ndarray, which: int) -> int:
    """The least token of a set under one of the hash functions."""
    return int((tokens * _MUL[which] + _ADD[which]).min())


def chain(*parts: int) -> int:
    """A node's name from its parent's and the chosen token."""
    x = 0x1234567
    for p in parts:
        x = int(W.mix(np.array([(x * 0x9E3779B97F4A7C15 + p + 1) % (1 << 64)], np.uint64))[0])
    return x - (1 << 63)


def minima(tokens: np.ndarray, many: int, first: int = 0) -> np.ndarray:
    """The least token of a non-empty set under each of so many hash functions from the first on."""
    mul, add = _MUL[first : first + many, None], _ADD[first : first + many, None]
    best = np.full(many, 2**64 - 1, np.uint64)
    for k in range(0, len(tokens), 4096):
        part = tokens[k : k + 4096]
        best = np.minimum(best, (part[None, :] * mul + add).min(axis=1))
    return best.view(np.int64)


def chosen(node: int) -> list[int]:
    """Which two hash functions a node branches by; those of the roots and of branches before sets are shipped are left out."""
    x, many = node * 0x9E3779B97F4A7C15 >> 20, len(_MUL) - INNER
    return [INNER + x % many, INNER + (x + 1 + (x >> 16) % (many - 1)) % many]


def packed(tokens: np.ndarray) -> bytes:
    """The set as it is shipped: all 64 bits of its fingerprints."""
    return tokens.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def forest(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets, all pairs compared."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = int(sizes.sum()) - len(np.unique(np.concatenate(sets)))
        return [(0, 1)] if 100 * both >= percent * (int(sizes.sum()) - both) else []
    inter = np.zeros((n, n), np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64)
    for part in _token_blocks(sets, int(sizes.sum())):
        _add_shared(inter, part)
    linked = np.empty((n, n), bool)
    for lo in range(0, n, 512):
        both = inter[lo : lo + 512].astype(np.float64)
        linked[lo : lo + 512] = 100 * both >= percent * (sizes[lo : lo + 512, None] + sizes[None, :] - both)
    return spanning(linked)


def _token_blocks(sets: list[np.ndarray], total: int):
    """The sorted sets cut at the same tokens, so that a block has about LEAF_TOKENS tokens."""
    many = -(-total // LEAF_TOKENS)
    if many <= 1:
        yield sets
        return
    some = np.sort(np.concatenate([s[:: 1 + total // 65_536] for s in sets]))
    edges = np.unique(some[len(some) * np.arange(1, many) // many])
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    for k in range(len(edges) + 1):
        yield [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]


def _add_shared(inter: np.ndarray, sets: list[np.ndarray]) -> None:
    """Add the numbers of tokens that pairs of sets share."""
    n, sizes = len(sets), [len(s) for s in sets]
    tokens, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    keep = shared[place]
    place, owner = rank[place[keep]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    width = 2048
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [lo, lo + width])
        dense = np.zeros((n, min(width, int(place[b - 1]) - lo + 1)), np.float32)
        dense[owner[a:b], place[a:b] - lo] = 1
        inter += dense @ dense.T


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    out, free = [], np.ones(len(linked), bool)
    for first in range(len(linked)):
        if not free[first]:
            continue
        free[first] = False
        todo = [first]
        while todo:
            u = todo.pop()
            new = np.flatnonzero(linked[u] & free)
            free[new] = False
            out += [(u, v) for v in new.tolist()]
            todo += new.tolist()
    return out


def compare(ids: list[int], sets: list[np.ndarray], node: int, dense: bool, percent: int = PERCENT, level: int = 0) -> list[tuple[int, int]]:
    """Links among the rows of a node."""
    if len(ids) < 2:
        return []
    if dense or level >= LEVELS or len(ids) <= LEAF_ROWS:
        return [(ids[a], ids[b]) for a, b in forest(sets, percent)]
    out = []
    for f in chosen(node):
        groups: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            groups.setdefault(least(s, f), []).append(k)
        for value, own in groups.items():
            out += compare([ids[k] for k in own], [sets[k] for k in own], chain(node, f, value), False, percent, level + 1)
    return out


def _sketch(n: int, many: int):
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                data, at = raw(batch.column(1).slice(a, b - a))
                sizes, digests, keys = [], [], []
                for s in shingle_sets(data, at, n):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(minima(s, many) if len(s) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "minima"])

    return run


def _sets_of(n: int, make, names: list[str], kinds: list[pa.DataType]):
    """Rows made of (class, its set, its nodes) for docs whose set is the class's."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                data, at = raw(batch.column(1).slice(a, b - a))
                out: list[list] = [[] for _ in names]
                ids, digests, nodes = (batch.column(k).slice(a, b - a).to_pylist() for k in (0, 2, 3))
                for doc, digest, own, s in zip(ids, digests, nodes, shingle_sets(data, at, n), strict=True):
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:
                        for row in make(doc, s, own):
                            for column, v in zip(out, row, strict=True):
                                column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    return run


def _ship(doc, s, own):
    body = packed(s)
    for x in own:
        yield doc, x["node"], x["dense"], body


#: Bits of the filter that tells which classes may be in large nodes: 1 MB, whatever the tables.
MAYBE = 1 << 23
_BIT = f"pmod(xxhash64(rep), {MAYBE})"
#: What is known of a class beside its nodes: its number, a document that has it, and its digest.
CLASS = ["cls", "rep", "digest"]


def _branches(n: int, many: int, maybe):
    """(rep, digest, keys) of texts that the filter lets through: the minima that large nodes branch by. Sets are made
    where the texts are read, so that no text is shuffled for them."""

    def run(batches):
        bits = np.frombuffer(maybe.value, np.uint64)
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[place >> 6] >> (place & 63).astype(np.uint64) & U(1)).astype(bool)))
            for a, b in slices(batch.column(1)):
                digests, keys = [], []
                for s in shingle_sets(*raw(batch.column(1).slice(a, b - a)), n):
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(minima(s, many, BRANCHES) if len(s) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "digest", "keys"])

    return run


def _compare_nodes(percent: int):
    names, kinds = ["a", "b"], [pa.int64(), pa.int64()]

    def run(batches):
        now, ids, sets = None, [], []

        def close():
            if len(ids) < 2:
                return []
            order = {}
            for i, s in zip(ids, sets, strict=True):
                order.setdefault(i, s)
            return compare(list(order), list(order.values()), now[0], now[1], percent)

        for batch in batches:
            found = []
            for node, dense, doc, body in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if (node, dense) != now:
                    found += close()
                    now, ids, sets = (node, dense), [], []
                ids.append(doc)
                sets.append(unpacked(body))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
        if found := close():
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return run


def _shared(nodes: DataFrame, node_rows: int, last: bool) -> DataFrame:
    """(node, rows) of nodes with two classes or more; of nodes with the same classes, as trees often make, one, unless
    they are branched: here up to the last level, or in compare()."""
    members = [F.bit_xor(F.xxhash64(F.lit(k), "cls")).alias(f"m{k}") for k in range(2)]
    counts = nodes.groupBy("node").agg(F.count("*").alias("rows"), *members).where("rows > 1")
    whole = (F.col("rows") <= min(LEAF_ROWS, node_rows)) | ((F.col("rows") > node_rows) & F.lit(last))
    own = F.when(whole, F.lit(0)).otherwise(F.col("node")).alias("own")
    return counts.groupBy("rows", "m0", "m1", own).agg(F.min("node").alias("node")).select("node", "rows")


def links(docs: DataFrame, classes: DataFrame, n: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, node_rows: int = NODE_ROWS, levels: int = LEVELS) -> DataFrame:
    """(a, b): confirmed links among classes (cls, rep, digest, minima), spanning every component that the trees find."""
    text = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), text_bytes().alias("body"))
    names = classes.select(*CLASS)
    roots = classes.select("cls", F.posexplode(F.slice("minima", 1, trees)).alias("tree", "least"))
    rows = roots.select("cls", "tree", F.xxhash64("tree", "least").alias("node"))
    done: DataFrame | None = None
    keys: DataFrame | None = None
    for level in range(levels + 1):
        counts = cut(_shared(rows, node_rows, level == levels), "nodes")
        most = counts.agg(F.max("rows").alias("m")).first()["m"] or 0
        small = rows.join(counts.where(F.col("rows") <= node_rows).select("node"), "node").select("cls", "node", F.lit(False).alias("dense"))
        done = small if done is None else done.unionByName(small)
        if most <= node_rows:
            break
        big = rows.join(counts.where(F.col("rows") > node_rows), "node")
        if level == levels:
            # still large: salted blocks, each pair of blocks a node of its own
            k = F.ceil(F.col("rows") * 2 / node_rows)
            c = F.pmod(F.xxhash64("cls", "node"), k)
            pair = big.select("cls", "node", c.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("d"))
            done = done.unionByName(pair.select("cls", F.xxhash64("node", F.least("c", "d"), F.greatest("c", "d")).alias("node"), F.lit(True).alias("dense")))
            break
        if keys is None:
            hot = cut(big.select("cls").distinct().join(names, "cls"), "hot")
            bits = hot.select(F.expr(_BIT).alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
            found = np.zeros(MAYBE // 64, np.int64)
            for row in bits.collect():  # MAYBE / 64 rows at most, whatever the tables
                found[row["w"]] = row["b"]
            maybe = text.sparkSession.sparkContext.broadcast(found.tobytes())
            made = text.select("rep", "body", F.expr(_BIT).alias("p")).mapInArrow(_branches(n, 2 * trees * levels, maybe), "rep long, digest binary, keys array<long>")
            keys = cut(made.join(hot, ["rep", "digest"]).select("cls", "keys").dropDuplicates(["cls"]), "keys")
        # a node branches by the two hash functions of its tree and level
        at = [2 * (F.col("tree") * levels + level) + k for k in range(2)]
        child = F.explode(F.array(*[F.xxhash64("node", F.lit(k), F.element_at("keys", (p + 1).cast("int"))) for k, p in enumerate(at)]))
        rows = cut(big.join(keys, "cls").select("cls", "tree", child.alias("node")), "branch")
    flat = done.select("cls", F.struct("node", "dense").alias("x"))
    own = flat.groupBy("cls").agg(F.collect_list("x").alias("nodes")).join(names, "cls")
    shipped = text.join(own, "rep").select("cls", "body", "digest", "nodes").mapInArrow(_sets_of(n, _ship, ["cls", "node", "dense", "body"], [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]), "cls long, node long, dense boolean, body binary")
    dealt = shipped.select("node", "dense", "cls", "body").repartition("node").sortWithinPartitions("node", "dense", "cls")
    return dealt.mapInArrow(_compare_nodes(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, node_rows: int = NODE_ROWS, levels: int = LEVELS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text)."""
    ready(docs)
    if trees > BRANCHES or BRANCHES + 2 * trees * levels > INNER:
        raise ValueError(f"{BRANCHES} trees at most, and {(INNER - BRANCHES) // 2} trees times levels")
    sketch = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(_sketch(n, trees), "doc_id long, n_shingles long, digest binary, minima array<long>")
    sketch = cut(sketch, "sketch")
    real = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    # classes are numbered where they are written, so the numbers stay
    classes = real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("minima").alias("minima"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    found = links(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), classes, n, percent, trees, node_rows, levels)
    placed = real.select("doc_id", "digest").join(classes.select("digest", "cls"), "digest").select("doc_id", "cls")
    same = placed.groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.collect_set("cls").alias("own")).where("lo <> hi").select(F.col("lo").alias("a"), F.explode("own").alias("b"))
    groups = components(found.unionByName(same)).withColumnRenamed("node", "cls").withColumnRenamed("component", "root")
    linked = cut(groups.join(classes.select("cls", "digest", "rep"), "cls").select("digest", "root", "rep"), "linked")
    by_class = linked.join(linked.groupBy("root").agg(F.min("rep").alias("linked")), "root").select("digest", "linked")
    by_class = classes.select("digest", "rep").join(by_class, "digest", "left").select("digest", F.coalesce("linked", "rep").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
