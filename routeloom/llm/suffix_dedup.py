"""Substring dedup with longest-previous-factor (LPF) arrays.

Shards hold the contexts that may repeat (see passages), laid one behind another in text order. In a shard, starts are
put in suffix order by rank doubling, which goes on only for starts whose prefix still occurs more than once. The
previous and the next smaller position of a start in suffix order are the earlier starts that share most with it; the
longer of the two common prefixes is its longest previous factor. A start whose factor reaches ``size`` is a later copy
of its source, the start that its factor comes from. keep="first" removes what later copies cover; keep="none" what
sources cover, too. Lengths beyond ``size`` decide nothing more, so factors end there, and starts whose first ``passage``
bytes are unique, whose factors are shorter, have factor 0.

Passages: the same arrays tell which strings of at least ``passage`` bytes also occur in another document. Maximal runs
of these that hold more than ``passage_words`` white-space words are reported for every document that has them
(n_passages, n_passage_words), whether or not they are long enough to be removed.

Defined results: null text: no bytes; texts shorter than ``size``: nothing removed; equal whole texts are copies of one
another (position order: doc_id, null last, then place); rows with the same doc_id and text count as two copies, too.
Matches never cross texts. Spans are judged on the input. Rows with null doc_id are one document in the passages' sense.
Other columns of docs are not passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import raw, release, slices
from .passages import KEY, Bytes, merged, repeated_spans, texts

SIZE, PASSAGE, PASSAGE_WORDS = 400, 224, 50
SHARD_BYTES = 1 << 19
#: Distinct contexts of one anchor, each of about 600 bytes, that a shard gathers; beyond, the anchor is split.
HOT = 2_000
_FIRST = 4


def _whole(n: int) -> type:
    """The narrower type of numbers up to n: a shard is held in a dozen arrays at once."""
    return np.int32 if n < 1 << 31 else np.int64


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and which places in it are the first of their run of equal keys. keys are overwritten."""
    n = len(keys)
    kind, bits = _whole(n), max(1, n - 1).bit_length()
    if n and int(keys.max()).bit_length() + bits <= 63:
        keys <<= bits
        keys |= np.arange(n, dtype=kind)
        keys.sort()
        order = np.empty(n, kind)
        np.bitwise_and(keys, (1 << bits) - 1, out=order, casting="unsafe")
        keys >>= bits
    else:
        order = np.argsort(keys, kind="stable").astype(kind)
        keys = keys[order]
    new = np.ones(n, bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return order, new


def _again(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    out = np.empty(len(order), bool)
    out[order] = ~(new & np.append(new[1:], True)[: len(new)])
    return out


def _begins(new: np.ndarray) -> np.ndarray:
    """Of each place, where its run begins."""
    at = np.arange(len(new), dtype=_whole(len(new)))
    at *= new
    return np.maximum.accumulate(at, out=at)


def _levels(depths: list[int]) -> list[int]:
    """Doublings up to the greatest depth, by way of every depth."""
    out = [min(_FIRST, *depths)]
    while out[-1] < max(depths):
        out.append(min(2 * out[-1], *(d for d in depths if d > out[-1])))
    return out


def prefix_ranks(data: np.ndarray, rest: np.ndarray, depths: list[int], starts: np.ndarray) -> dict[int, np.ndarray]:
    """By level, each position's rank by so many first bytes (a suffix that ends before is as long as it is): where its
    run of equal ones starts in suffix order. rest: bytes up to the end of each position's context. The last two levels
    hold for the starts."""
    n, levels = len(data), _levels(depths)
    kind = _whole(n + 2 * max(depths))
    wanted = [np.ones(n, bool)] * len(levels)
    if len(levels) > 3:
        wanted[-1] = np.zeros(n, bool)
        wanted[-1][starts] = True
        step = levels[-1] - levels[-2]
        wanted[-2] = wanted[-1].copy()
        wanted[-2][step:] |= wanted[-1][: n - step]
    symbols = data.astype(np.int16) + np.int16(1)
    keys = np.zeros(n, np.int64)
    span = levels[0]
    for k in range(span):
        keys <<= 9
        keys[: n - k] |= np.where(rest[: n - k] > k, symbols[k:], np.int16(0))
    del symbols
    order, new = _sorted(keys)
    del keys
    rank = np.empty(n, kind)
    rank[order] = _begins(new)
    alive = np.flatnonzero(_again(order, new)).astype(kind)
    del order, new
    out = {span: rank}
    for to, own in zip(levels[1:], wanted[1:], strict=True):
        step, rank = to - span, rank.copy()
        alive = alive[own[alive]]
        if len(alive):
            first = rank[alive]
            keys = first.astype(np.int64)
            keys *= n + 1
            keys += np.where(rest[alive] > step, rank[np.minimum(alive + kind(step), kind(n - 1))] + kind(1), kind(0))
            order, new = _sorted(keys)
            del keys
            # runs of equal first parts are where they were; each part of one moves on by what stands before it there
            ordered = first[order]
            edge = np.ones(len(alive), bool)
            np.not_equal(ordered[1:], ordered[:-1], out=edge[1:])
            ordered += _begins(new)
            ordered -= _begins(edge)
            rank[alive[order]] = ordered
            alive = alive[_again(order, new)]
        span = to
        out[span] = rank
    return out


def common(data: np.ndarray, ranks: dict[int, np.ndarray], rest: np.ndarray, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """How many first bytes, up to size, the suffixes at starts x and y share: from the ranks, longest spans first."""
    n = len(rest)
    out = np.zeros(len(x), rest.dtype)
    most = np.minimum(np.minimum(rest[x], rest[y]), size)
    for span, values in [*sorted(ranks.items(), reverse=True), *[(1, data)] * (_FIRST - 1)]:
        same = values[np.minimum(x + out, rest.dtype.type(n - 1))] == values[np.minimum(y + out, rest.dtype.type(n - 1))]
        out += (same & (out + rest.dtype.type(span) <= most)) * rest.dtype.type(span)
    return out


def smaller_before(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The place of the nearest smaller value before each within its group (groups are runs), else -1: all places climb
    at once by what they know of each other."""
    at = np.arange(len(values)) - 1
    at[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(at)])] = -1
    todo = np.flatnonzero(at >= 0)
    todo = todo[values[at[todo]] > values[todo]]
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
        todo = todo[values[at[todo]] > values[todo]]
    return at


def factors(data: np.ndarray, rest: np.ndarray, starts: np.ndarray, size: int, floor: int):
    """(lpf, source, by floor): for each of the starts, in order of position, its longest previous factor up to ``size``
    (0 where below ``floor``), the start that it comes from (-1 without), and a number that starts with the same first
    ``floor`` bytes share."""
    ranks = prefix_ranks(data, rest, [floor, size], starts)
    deep, shallow = ranks[size][starts], ranks[floor][starts]
    lpf, source = np.zeros(len(starts), deep.dtype), np.full(len(starts), -1, deep.dtype)
    if not len(starts):
        return lpf, source, shallow
    sa, _ = _sorted(deep.astype(np.int64))  # ties by position
    # starts that share size bytes are a class, in order of position: the previous smaller one is the neighbour
    new = np.concatenate([[True], deep[sa[1:]] != deep[sa[:-1]]])
    head = np.flatnonzero(new)
    first = sa[head]
    later = np.flatnonzero(~new)
    whole = rest[starts[sa[later]]] >= size
    lpf[sa[later]] = np.where(whole, size, rest[starts[sa[later]]])
    source[sa[later]] = sa[later - 1]
    # the first of a class: the nearest classes on either side that begin earlier
    group = shallow[first]
    before = smaller_before(first, group)
    after = len(first) - 1 - smaller_before(first[::-1], group[::-1])[::-1]
    after[after == len(first)] = -1
    for other in (before, after):
        own = np.flatnonzero(other >= 0)
        length = common(data, ranks, rest, starts[first[own]], starts[first[other[own]]], size)
        better = length > lpf[first[own]]
        lpf[first[own[better]]] = length[better]
        source[first[own[better]]] = first[other[own[better]]]
    lpf[lpf < floor] = 0
    source[lpf < floor] = -1
    return lpf, source, shallow


def _roots(source: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The first of the chain of sources that each linked start is in; the start itself else."""
    root = np.where(linked, source, np.arange(len(source), dtype=source.dtype))
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def decide(size: int, keep: str, passage: int):
    def run(contexts, many, n, doc, base, top):
        lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
        data = np.frombuffer(b"".join(contexts), np.uint8)
        begin = np.cumsum(lengths) - lengths
        kind = _whole(len(data) + 2 * size)
        rest = np.repeat((begin + lengths).astype(kind), lengths)
        rest -= np.arange(len(data), dtype=kind)
        of = np.repeat(np.arange(len(contexts), dtype=kind), many)
        offset = np.arange(len(of), dtype=kind)
        offset -= np.repeat((np.cumsum(many) - many).astype(kind), many)
        starts = begin.astype(kind)[of] + offset  # windows; each start of a text is in one context
        lpf, source, same = factors(data, rest, starts, size, passage)
        if len(data) > 2 * SHARD_BYTES:  # what this took else stays with the worker
            release()
        long = rest[starts] >= size
        later = long & (lpf >= size)
        root = _roots(source, later)
        # a context's copies repeat with it, and its first copy is the one in the shard
        hit = later | (long & (n[of] > 1))
        if keep == "none":
            hit[root[later]] = True
            from_doc = diagonal = np.zeros(len(of), np.int64)  # every copy goes
        else:
            from_doc, diagonal = doc[of[root]], base[of[root]] + offset[root] - offset
        # passages: some start with the same bytes is in another document
        order = np.argsort(same, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]])[: len(order)])
        size_of = np.diff(np.append(head, len(order)))
        shared = np.zeros(len(of), bool)
        if len(order):
            low, high = np.minimum.reduceat(doc[of[order]], head), np.maximum.reduceat(top[of[order]], head)
            shared[order] = np.repeat(low != high, size_of)
        found = [_runs(hit, of, offset, size, 0, from_doc, diagonal), _runs(shared, of, offset, passage, 1, np.zeros_like(of), np.zeros_like(of))]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return run


def _runs(hit, of, offset, size, kind, from_doc, diagonal):
    """Runs of hit windows with one source: (context, kind, a, b, from_doc, from_place)."""
    at = np.flatnonzero(hit)
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    x, y = at[1:], at[:-1]
    edge = np.concatenate([[True], (of[x] != of[y]) | (offset[x] != offset[y] + 1) | (from_doc[x] != from_doc[y]) | (diagonal[x] != diagonal[y])])
    head = at[edge]
    last = at[np.concatenate([np.flatnonzero(edge)[1:], [len(at)]]) - 1]
    return of[head], np.full(len(head), kind), offset[head], offset[last] + size, from_doc[head], diagonal[head] + offset[head]


def _finish(size: int, keep: str, passage_words: int, outputs: tuple[str, ...]):
    kinds = {"kept": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept_sha256": pa.string()}
    names = ["n_bytes", "n_removed", "n_spans", "n_passages", "n_passage_words"]

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                data, at = raw(batch.column(1).slice(a, b - a))
                body = data.tobytes()
                rows: list[list] = [[] for _ in range(len(names) + len(outputs))]
                for k, (doc, first, last, copies, spans) in enumerate(zip(*[batch.column(c).slice(a, b - a).to_pylist() for c in (2, 3, 4, 5, 6)], strict=True)):
                    text = body[at[k] : at[k + 1]]
                    if copies > 1 and len(text) >= size and (keep == "none" or doc != first):
                        runs = [(0, len(text))]
                    else:
                        runs = merged((s["a"], s["b"]) for s in spans or [] if s["kind"] == 0)
                    shared = [(0, len(text))] if first != last else merged((s["a"], s["b"]) for s in spans or [] if s["kind"] == 1)
                    passages = [w for w in _words_in(text, shared) if w > passage_words]
                    parts, end = [], 0
                    for x, y in runs:
                        parts.append(text[end:x])
                        end = y
                    kept = b"".join([*parts, text[end:]])
                    made = {"kept": kept, "spans": [{"start": x, "end": y} for x, y in runs]}
                    if "kept_sha256" in outputs:
                        made["kept_sha256"] = hashlib.sha256(kept).hexdigest()
                    for column, v in zip(rows, [len(text), len(text) - len(kept), len(runs), len(passages), sum(passages), *[made[c] for c in outputs]], strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a)] + [pa.array(v, pa.int64()) for v in rows[: len(names)]] + [pa.array(v, kinds[c]) for v, c in zip(rows[len(names) :], outputs, strict=True)], names=["doc_id", *names, *outputs])

    return run


def _words_in(text: bytes, spans: list[tuple[int, int]]) -> list[int]:
    """How many whole words of the text each span holds."""
    if not spans:
        return []
    starts, ends, _ = W.bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)]), W.PLAIN)
    a, b = np.array(spans, np.int64).T
    return np.maximum(0, np.searchsorted(ends, b, side="right") - np.searchsorted(starts, a)).tolist()


def remove_repeats(docs: DataFrame, size: int = SIZE, keep: str = "first", outputs: tuple[str, ...] = ("kept", "spans"), passage: int = PASSAGE, passage_words: int = PASSAGE_WORDS, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_passages, n_passage_words, and of outputs: kept binary, spans
    array<struct<start,end>> in bytes, kept_sha256) of every row. With keep="first", rows of equal doc_id and equal text
    all stay. passage: at most size."""
    if keep not in ("first", "none"):
        raise ValueError(keep)
    found, passage = texts(docs), min(passage, size)
    later = lambda kind, from_doc, from_place, doc, place: (kind == 1) | (from_doc != doc) | (from_place != place)
    rule = (lambda *_: F.lit(True)) if keep == "none" else later
    info = repeated_spans(found, Bytes(size, passage), decide(size, keep, passage), rule, True, shard_bytes, hot)
    whole = found.join(info, KEY).select("doc_id", "body", "doc", "first", "last", "copies", "spans")
    sql = {"kept": "binary", "spans": "array<struct<start:long,end:long>>", "kept_sha256": "string"}
    return whole.mapInArrow(_finish(size, keep, passage_words, outputs), "doc_id long, n_bytes long, n_removed long, n_spans long, n_passages long, n_passage_words long" + "".join(f", {c} {sql[c]}" for c in outputs))
