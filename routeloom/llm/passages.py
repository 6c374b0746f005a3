"""Routing of repeated passages: the shared front of the suffix-array and the FM-index operators.

A passage of ``route`` symbols (bytes or words) repeats elsewhere only if its minimizer, the least fingerprint of its
``gram``-symbol grams, repeats with it. So every run of windows with one minimizer becomes an anchor; anchors found in
one text only are dropped; the others ship their context, the symbols their windows span, to the shard that the
fingerprint names. There the operator's own method decides on the content; fingerprints only route.

Scale: anchors are 25 bytes each and few (2 in ``route - gram + 2`` symbols); a text is shuffled once to the list of its
repeated anchors and once to its result. Exact copies of a text are one text here: their passages do not meet.

Hot anchors: those that a sample of the texts shows in very many are known to repeat and are spread over all tasks in
place of meeting in one. Equal contexts are aggregated before they are shuffled. An anchor with more than ``hot``
distinct contexts is split: its windows are dealt by where the anchor stands in them, in steps that get finer, and by
the symbols that all windows of a step have in common, so that equal windows still meet, and the last step brings only
equal windows together, which are one context. So no task gathers an anchor of a large share of all texts, every window
is decided by the same method, and ``hot`` changes no result. The sample is a hint for this only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import cut, raw, ready, slices, text_bytes

LAST = (1 << 63) - 1
KEY = ["t", "u"]
#: One text of so many is looked at for hot anchors; of these so many at most are spread, the most frequent ones.
SAMPLE, HINTS = 64, 100_000


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, doc_id, body, t, u): t and u name the text; doc orders documents, null ids last."""
    ready(docs)
    body = text_bytes(text)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return docs.select(order.alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("t"), F.xxhash64(F.lit(7), body).alias("u"))


def runs(values: np.ndarray, grams: int, firsts: np.ndarray, lasts: np.ndarray, size: int):
    """Runs of windows with one minimizer. values: fingerprints of all grams; grams: how many a window has; firsts and
    lasts: of each text, its first symbol and the one after its last. Gives arrays: anchor's place, first and last
    window start, text."""
    best = minimizers(values, grams)
    empty = np.zeros(0, np.int64)
    many = np.maximum(0, lasts - firsts - size + 1)
    if not len(best) or not many.sum():
        return empty, empty, empty, empty
    owner = np.repeat(np.arange(len(firsts)), many)
    starts = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(firsts, many)
    at = best[starts]
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([edge[1:], [len(at)]]) - 1
    return at[edge], starts[edge], starts[last], owner[edge]


def minimizers(values: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive values the place of the least (by its upper bits), the leftmost of equal ones."""
    n, bits = len(values), 22
    if n < w:
        return np.zeros(0, np.int64)
    if n >= 1 << bits or w < 16:
        return W.minimizers(values >> np.uint64(bits), w)
    marked = (values >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    full = -(-n // w) * w
    grid = np.full(full, 2**64 - 1, np.uint64)
    grid[:n] = marked
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - w + 1], ahead[w - 1 : n])
    return (least & np.uint64((1 << bits) - 1)).astype(np.int64)


def joined(h: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray):
    """Runs that follow one another under one fingerprint are one: text with a short period has an anchor in each
    period, and their contexts would overlap. The last array tells which are more than one."""
    if not len(h):
        return h, first, last, owner, np.zeros(0, bool)
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (first[1:] != last[:-1] + 1)])
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate([at, [len(h)]]))
    return h[at], first[at], last[at + size - 1], owner[at], size > 1


class Kind:
    """How a text becomes symbols. Windows of ``route`` symbols are routed; contexts go on to ``size`` symbols from their
    last window's start, or to the end of the text."""

    size: int
    route: int
    gram: int

    def split(self, context: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A context's symbols: where each starts and ends."""
        raise NotImplementedError

    def values(self, context: bytes) -> np.ndarray:
        """Fingerprints of all grams of a context."""
        raise NotImplementedError

    def anchors(self, data: np.ndarray, offsets: np.ndarray):
        """(fingerprint, first start, last start, text, whether met again within) arrays and a function place -> bytes
        of its context; starts count from the text's first symbol."""
        raise NotImplementedError

    def steps(self) -> list[int]:
        """How many places of the anchor a piece of a hot anchor's windows spans, level by level."""
        out, width = [], self.route - self.gram + 1
        while not out or out[-1] > 1:
            width = max(1, width // 8)
            out.append(width)
        return out


class Bytes(Kind):
    GRAM = 32

    def __init__(self, size: int, route: int | None = None):
        self.size, self.route = size, min(route or size, size)
        self.gram = min(self.GRAM, self.route)

    def split(self, context):
        at = np.arange(len(context))
        return at, at + 1

    def values(self, context):
        return self._grams(np.frombuffer(context, np.uint8))

    def _grams(self, data):
        n = len(data)
        values = W.BYTE[data]
        span = 1
        while span < self.gram:  # doubling sums; gram is a power of two, or size where less
            step = min(span, self.gram - span)
            if step < span:
                break
            values = values[:-span] * np.uint64(pow(0x9E3779B97F4A7C15, span, 1 << 64)) + values[span:] if len(values) > span else values[:0]
            span *= 2
        if span < self.gram and len(values) > self.gram - span:
            extra = self.gram - span
            values = values[:-extra] * np.uint64(0xD6E8FEB86659FD93) + values[extra:]
        return W.mix(values) if n >= self.gram else values[:0]

    def anchors(self, data, offsets):
        values = self._grams(data)
        at, first, last, owner = runs(values, self.route - self.gram + 1, offsets[:-1], offsets[1:], self.route)
        h, first, last, owner, more = joined(values[at], first, last, owner)
        body = data.tobytes()
        base, ends = offsets[owner], np.minimum(last + self.size, offsets[owner + 1])
        return h, first - base, last - base, owner, more, lambda k: body[first[k] : ends[k]]


class Words(Kind):
    GRAM = 5

    def __init__(self, size: int):
        self.size = self.route = size
        self.gram = min(self.GRAM, size)

    def split(self, context):
        data = np.frombuffer(context, np.uint8)
        return W.bounds(data, np.array([0, len(data)]), W.PLAIN)[:2]

    def values(self, context):
        data = np.frombuffer(context, np.uint8)
        return W.windows(W.hashes(data, *self.split(context)), self.gram)

    def anchors(self, data, offsets):
        starts, ends, at = W.bounds(data, offsets, W.PLAIN)
        h = W.hashes(data, starts, ends)
        values = W.windows(h, self.gram)
        place, first, last, owner = runs(values, self.route - self.gram + 1, at[:-1], at[1:], self.route)
        h64, first, last, owner, more = joined(values[place], first, last, owner)
        body, base = data.tobytes(), at[owner]
        return h64, first - base, last - base, owner, more, lambda k: b" ".join(body[starts[first[k]] : ends[last[k] + self.size - 1]].split())


def _emit(kind: Kind, inner: bool, hints: np.ndarray):
    """(h, t, sure, p) of the distinct anchors of each text. sure: the anchor is known to repeat, as one of the hints or,
    if inner, in the text itself; p deals the rows: by anchor, those of the hints by text."""

    def run(batches):
        for batch in batches:
            names = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(batch.column(0)):
                h, _, _, owner, more, _ = kind.anchors(*raw(batch.column(0).slice(a, b - a)))
                if not len(h):
                    continue
                h, t = h.view(np.int64), names[a:b][owner]
                order = np.lexsort((h, t))
                h, t, more = h[order], t[order], more[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
                at = np.flatnonzero(new)
                sure = (np.diff(np.concatenate([at, [len(h)]])) > 1) | np.logical_or.reduceat(more, at) if inner else np.zeros(len(at), bool)
                h, t = h[new], t[new]
                place = np.searchsorted(hints, h)
                hot = hints[np.minimum(place, len(hints) - 1)] == h if len(hints) else np.zeros(len(h), bool)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(t), pa.array(sure | hot), pa.array(np.where(hot, t, h))], names=["h", "t", "sure", "p"])

    return run


def _repeated(batches):
    """From rows sorted by h (and t) those whose h is in several texts, or sure to repeat."""
    held = None  # the first row of the last h, not yet given out, and whether that h is known to repeat
    known, last = False, None
    for batch in batches:
        h, t, sure = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(h):
            continue
        new = np.concatenate([[True], h[1:] != h[:-1]])
        at = np.flatnonzero(new)
        low, high = np.minimum.reduceat(t, at), np.maximum.reduceat(t, at)
        again = (low != high) | np.logical_or.reduceat(sure, at)
        out_h, out_t = [], []
        if last is not None and h[0] == last:
            again[0] |= known or bool((t[: at[1] if len(at) > 1 else len(t)] != held[1]).any())
            if again[0] and not known:
                out_h.append([held[0]])
                out_t.append([held[1]])
            carried = True
        else:
            carried = False
        mask = np.repeat(again, np.diff(np.concatenate([at, [len(h)]])))
        mask[1:] &= new[1:] | (t[1:] != t[:-1])  # copies of a text say the same
        out_h.append(h[mask])
        out_t.append(t[mask])
        if not (carried and len(at) == 1 and not again[0]):
            held = (h[-1], t[at[-1]])
        known, last = bool(again[-1]), h[-1]
        found = np.concatenate(out_h), np.concatenate(out_t)
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int64))], names=["h", "t"])


def _contexts(kind: Kind):
    def run(batches):
        for batch in batches:
            rest = [batch.column(k) for k in (1, 2)]
            for a, b in slices(batch.column(0)):
                h, first, last, owner, _, body = kind.anchors(*raw(batch.column(0).slice(a, b - a)))
                lists = batch.column(3).slice(a, b - a)
                sizes = np.diff(lists.offsets.to_numpy())
                wanted, of = lists.flatten().to_numpy(), np.repeat(np.arange(b - a), sizes)
                h = h.view(np.int64)
                # membership of (text, h) among the wanted ones
                pairs = np.concatenate([np.stack([of, wanted], 1), np.stack([owner, h], 1)])
                order = np.lexsort((np.arange(len(pairs)), pairs[:, 1], pairs[:, 0]))
                ordered = pairs[order]
                group = np.cumsum(np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)])) - 1 if len(pairs) else np.zeros(0, np.int64)
                has = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
                has[group[order < len(wanted)]] = True
                good = np.zeros(len(pairs), bool)
                good[order] = has[group] if len(group) else False
                take = np.flatnonzero(good[len(wanted) :])
                t, doc = (c.slice(a, b - a).to_numpy(zero_copy_only=False)[owner[take]] for c in rest)
                yield pa.RecordBatch.from_arrays([pa.array(h[take]), pa.array(t), pa.array(doc), pa.array(first[take]), pa.array((last - first + 1)[take]), pa.array([body(k) for k in take.tolist()], pa.binary())], names=["g", "t", "doc", "base", "many", "body"])

    return run


def _pieces(kind: Kind, step: int):
    """(g, c, c2, new_g, delta, many, body, n, doc, base, top): the contexts of hot anchors cut into pieces. A piece's
    windows have their anchor in one of ``step`` places; its name is made of the symbols that all such windows share."""
    names = ["g", "c", "c2", "new_g", "delta", "many", "body", "n", "doc", "base", "top"]
    kinds = [pa.int64()] * 6 + [pa.binary()] + [pa.int64()] * 4

    def named(g: int, q: int, part: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(part, digest_size=8, key=f"{g}/{q}".encode()).digest(), "little", signed=True)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for g, c, c2, many, body, n, doc, base, top in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                starts, ends = kind.split(body)
                best = minimizers(kind.values(body), kind.route - kind.gram + 1)[:many]
                q = (best - np.arange(many)) // step
                edge = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (q[1:] != q[:-1])]))
                for i, j in zip(edge.tolist(), [*edge[1:].tolist(), many], strict=True):
                    lo, hi = best[i] - q[i] * step, best[i] - (q[i] + 1) * step + kind.route  # shared by the piece's windows
                    whole = body[starts[i] : ends[min(j - 1 + kind.size, len(ends)) - 1]]
                    parts = [(body[starts[lo] : ends[hi]], whole)]
                    if step == 1 and kind.route < kind.size:  # equal windows of either length are one context then
                        short = body[starts[i] : ends[i + kind.route - 1]]
                        parts = [(short, short), (whole, whole)] if short != whole else [(short, short)]
                    for key, part in parts:
                        for column, v in zip(out, (g, c, c2, named(g, int(q[i]), key), i, j - i, part, n, doc, base + i, top), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    return run


RUNS = ["g", "c", "c2", "kind", "a", "b", "from_doc", "from_place"]


def _shards(decide, limit: int):
    """decide(contexts, many, n, doc, base, top) -> (context, kind, a, b, from_doc, from_place) arrays: runs of symbols,
    counted within the context, that are repeated, and where their first copy is. Contexts come in order of (doc, base),
    the place of their first copy; n: how many copies there are; top: the greatest document of one; many: windows."""

    def found(rows):
        order = sorted(range(len(rows[0])), key=lambda k: (rows[6][k], rows[7][k]))
        ids, rest = [np.array(x, np.int64)[order] for x in rows[:3]], [np.array(x, np.int64)[order] for x in (rows[3], *rows[5:])]
        at, *runs_ = decide([rows[4][k] for k in order], *rest)
        if not len(at):
            return None
        return pa.RecordBatch.from_arrays([pa.array(x) for x in [*(x[at] for x in ids), *(np.asarray(x, np.int64) for x in runs_)]], names=RUNS)

    def run(batches):
        rows: list[list] = [[] for _ in range(9)]
        size, last = 0, None
        for batch in batches:
            for row in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if row[0] != last and size > limit:
                    if (made := found(rows)) is not None:
                        yield made
                    rows, size = [[] for _ in range(9)], 0
                last = row[0]
                size += len(row[4])
                for column, v in zip(rows, row, strict=True):
                    column.append(v)
        if rows[0] and (made := found(rows)) is not None:
            yield made

    return run


ID = ["g", "c", "c2"]
CONTEXT = [*ID, "many", "body", "n", "doc", "base", "top"]


def _distinct(rows: DataFrame) -> DataFrame:
    """Equal contexts as one row with its first place; aggregated before the shuffle."""
    named = rows.withColumns({"c": F.xxhash64("many", "body"), "c2": F.xxhash64(F.lit(7), "many", "body")})
    least = F.min(F.struct("doc", "base")).alias("least")
    found = named.groupBy(*ID).agg(F.first("many").alias("many"), F.first("body").alias("body"), F.sum("n").alias("n"), least, F.max("top").alias("top"))
    return found.select(*ID, "many", "body", "n", "least.doc", "least.base", "top")


def _decided(contexts: DataFrame, kind: Kind, decide, limit: int, hot: int) -> DataFrame:
    """RUNS of all contexts; hot anchors are split first."""
    schema = ", ".join(f"{c} long" for c in RUNS)
    shard = lambda rows: rows.repartition("g").sortWithinPartitions("g").mapInArrow(_shards(decide, limit), schema)
    done, back = [], lambda runs_: runs_
    for step in [*kind.steps(), 0]:
        often = cut(contexts.groupBy("g").agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("g"), "often") if step else None
        if often is None or often.isEmpty():
            done.append(back(shard(contexts)))
            break
        done.append(back(shard(contexts.join(often, "g", "left_anti"))))
        made = "g long, c long, c2 long, new_g long, delta long, many long, body binary, n long, doc long, base long, top long"
        pieces = contexts.join(often, "g", "left_semi").select(*CONTEXT).mapInArrow(_pieces(kind, step), made)
        pieces = cut(pieces.withColumns({"new_c": F.xxhash64("many", "body"), "new_c2": F.xxhash64(F.lit(7), "many", "body")}), "pieces")
        contexts = cut(_distinct(pieces.select(F.col("new_g").alias("g"), "many", "body", "n", "doc", "base", "top")), "contexts")
        links = pieces.select(*[F.col(x).alias(f"old_{x}") for x in ID], F.col("new_g").alias("g"), F.col("new_c").alias("c"), F.col("new_c2").alias("c2"), "delta")
        back = _unsplit(links, back)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _unsplit(links: DataFrame, before):
    """Runs of pieces as runs of the contexts that they were cut from."""

    def back(runs_: DataFrame) -> DataFrame:
        moved = runs_.join(links, ID)
        return before(moved.select(*[F.col(f"old_{x}").alias(x) for x in ID], "kind", (F.col("a") + F.col("delta")).alias("a"), (F.col("b") + F.col("delta")).alias("b"), "from_doc", "from_place"))

    return back


def repeated_spans(found: DataFrame, kind: Kind, decide, rule, inner: bool, limit: int, hot: int) -> DataFrame:
    """found: texts(). Returns (t, u, first, last, copies, spans) of each text: its first and last document, how many rows
    have it, and the repeated runs of symbols (kind, a, b) that decide finds and rule keeps, null where none. Joined with
    found on KEY, it shares one shuffle. rule: (a run's columns, doc, place of the run) -> whether it counts there."""
    classes = cut(found.groupBy("t", "u").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("copies")), "classes")
    emitted = "h long, t long, sure boolean, p long"
    some = found.where(F.pmod("u", F.lit(SAMPLE)) == 0).select("body", "t").mapInArrow(_emit(kind, False, np.zeros(0, np.int64)), emitted)
    often = some.groupBy("h").agg(F.count_distinct("t").alias("texts")).where(F.col("texts") >= max(2, hot // SAMPLE)).orderBy(F.desc("texts"), "h").limit(HINTS)
    hints = np.sort(np.array([r["h"] for r in often.collect()], np.int64))  # a hint of bounded size
    anchors = found.select("body", "t").mapInArrow(_emit(kind, inner, hints), emitted)
    again = cut(anchors.repartition("p").sortWithinPartitions("h", "t").select("h", "t", "sure").mapInArrow(_repeated, "h long, t long"), "anchors")
    lists = again.groupBy("t").agg(F.collect_list("h").alias("hs"))  # of one text, at most its own anchors
    own = lists.join(classes, "t").select("t", "u", "first", "hs")
    # first is the least doc. All columns of the texts and KEY alone, so that Spark reuses this shuffle of them in the
    # caller's join with the result
    parts = found.join(own, KEY).where("doc <= first").select("body", "t", "doc", "hs", "doc_id")
    shipped = parts.mapInArrow(_contexts(kind), "g long, t long, doc long, base long, many long, body binary")
    shipped = cut(shipped.withColumns({"c": F.xxhash64("many", "body"), "c2": F.xxhash64(F.lit(7), "many", "body")}), "shipped")
    contexts = cut(_distinct(shipped.select("g", "many", "body", F.lit(1).cast("long").alias("n"), "doc", "base", F.col("doc").alias("top"))), "contexts")
    runs_ = _decided(contexts, kind, decide, limit, hot)
    met = shipped.select(*ID, "t", "doc", "base").join(runs_, ID)
    place = F.col("base") + F.col("a")
    met = met.where(rule(F.col("kind"), F.col("from_doc"), F.col("from_place"), F.col("doc"), place))
    spans = met.groupBy("t", F.col("doc").alias("first")).agg(F.collect_list(F.struct("kind", place.alias("a"), (F.col("base") + F.col("b")).alias("b"))).alias("spans"))
    return classes.join(spans, ["t", "first"], "left")


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans without overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
