"""Near-duplicates and passages against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from routeloom.llm import components, e8, fm_dedup, minhash, passages, suffix_dedup

WS = b" \t\n\v\f\r"


def words(text):
    return (text or "").encode().split()


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_expected(rows):
    sets = []
    for doc, text, *_ in rows:
        w = lowered(text)
        sets.append((doc, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    at = groups({d for d, _ in sets if d is not None}, links)
    return Counter((d, len(s), at.get(d) if s else d, True if d is None else d == (at[d] if s else d)) for d, s in sets)


@pytest.mark.parametrize("knobs", [{}, {"node_rows": 3, "levels": 1}, {"node_rows": 4, "levels": 3, "trees": 12}])
def test_minhash(docs, corpus, knobs):
    assert Counter(map(tuple, minhash.near_duplicates(docs, **knobs).collect())) == near_expected(corpus)


def test_minhash_empty(none):
    assert minhash.near_duplicates(none).collect() == []


def test_compare_branches_without_losing_links(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 285, replace=False), rng.integers(0, 1 << 62, 10, dtype=np.uint64)])) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 1 << 62, 50, dtype=np.uint64)) for _ in range(40)]
    whole = minhash.forest(sets)
    monkeypatch.setattr(minhash, "LEAF_ROWS", 8)
    found = minhash.compare(list(range(80)), sets, 17, False)
    assert groups(range(80), found) == groups(range(80), whole)
    for a, b in found:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)


def test_branches_of_trees_and_levels_are_independent(spark, monkeypatch):
    monkeypatch.setattr(minhash, "_shared", lambda nodes, *_: nodes.groupBy("node").count().withColumnRenamed("count", "rows").where("rows > 1"))
    rows = []
    for k in range(1500):  # two sets of seven words, six of them shared: similarity 0.75
        shared = " ".join(f"w{k}x{j}" for j in range(6))
        rows += [(k, f"{shared} a{k}"), (k + 1500, f"{shared} b{k}")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=1, node_rows=1, levels=4).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(k, k % 1500) for k in range(3000)}


def test_hash_functions_differ_by_use():
    for node in np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 2000).tolist():
        a, b = minhash.chosen(node)
        assert a != b and min(a, b) >= minhash.BRANCHES + 2 * minhash.TREES * minhash.LEVELS


def test_long_sets_are_compared_whole(monkeypatch):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 48, 700, dtype=np.uint64)) for _ in range(30)]
    for _ in range(60):
        s = sets[rng.integers(30)]
        sets.append(np.unique(np.concatenate([rng.choice(s, 605, replace=False), rng.integers(0, 1 << 48, 95, dtype=np.uint64)])))
    whole = minhash.forest(sets)
    monkeypatch.setattr(minhash, "LEAF_TOKENS", 1000)
    assert minhash.forest(sets) == whole and len(whole) > 40
    for k, (a, b) in enumerate(whole):  # two sets alone in a node
        assert minhash.compare([5, 9], [sets[a], sets[b]], 17 + k, False) == [(5, 9)]


@pytest.mark.parametrize("knobs", [{}, {"node_rows": 1, "levels": 3}])
def test_two_texts_of_one_doc_id_keep_their_own_links(spark, knobs):
    shared = {x: " ".join(f"{x}{j}" for j in range(18)) for x in "pq"}
    rows = [(5, f"{shared['p']} y"), (5, f"{shared['q']} y"), (7, f"{shared['p']} z"), (3, f"{shared['q']} z"), (9, "alone")] * 2
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **knobs).collect()
    assert Counter(map(tuple, found)) == near_expected(rows)
    assert {(r.doc_id, r.component_id) for r in found} == {(5, 3), (7, 3), (3, 3), (9, 9)}


def test_equal_nodes_that_branch_all_stay(spark):
    nodes = spark.createDataFrame([(rep, node) for node in (1, 2, 3) for rep in (10, 11, 12)], "cls long, node long")
    kept = lambda *knobs: sorted(r.node for r in minhash._shared(nodes, *knobs).collect())
    assert kept(2, False) == [1, 2, 3] and kept(3, False) == [1] and kept(2, True) == [1]


def test_pair_whose_nodes_all_branch(spark):
    rows = []
    for k in range(300):  # similarity 0.75
        shared = " ".join(f"w{k}x{j}" for j in range(6))
        rows += [(k, f"{shared} a{k}"), (k + 300, f"{shared} b{k}")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=1, node_rows=1, levels=3).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(k, k % 300) for k in range(600)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1500), (1500, 1200), (7000, 7000), (5, 5)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {found[k] for k in range(201)} == {0} and found[1500] == found[1200] == 1000 and 7000 not in found
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def bytes_expected(rows, size, keep):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, firsts = Counter(), {}
    texts = {i: (rows[i][1] or "").encode() for i in order}
    for i in order:
        for k in range(len(texts[i]) - size + 1):
            s = texts[i][k : k + size]
            seen[s] += 1
            firsts.setdefault(s, (rows[i][0], k))
    out = Counter()
    for i in order:
        t = texts[i]
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - size + 1):
            s = t[k : k + size]
            if seen[s] > 1 if keep == "none" else firsts[s] != (rows[i][0], k):
                gone[k : k + size] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out[rows[i][0], len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("size", "keep", "hot"), [(400, "none", 3), (60, "none", 9999), (7, "none", 2), (60, "first", 9999), (60, "first", 3), (60, "first", 0)])
def test_suffix_dedup(docs, corpus, size, keep, hot):
    found = suffix_dedup.remove_repeats(docs, size, keep, ("kept_sha256",), shard_bytes=5000, hot=hot).drop("n_passages", "n_passage_words")
    assert Counter(map(tuple, found.collect())) == bytes_expected(corpus, size, keep)


def passages_expected(rows, size, least):
    """(doc, runs of more than ``least`` words of which each ``size`` bytes are in another document, too, their words)."""
    where = defaultdict(set)
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    whole = defaultdict(set)
    for doc, t in texts:
        whole[t].add(doc)
        for k in range(len(t) - size + 1):
            where[t[k : k + size]].add(doc)
    out = Counter()
    for doc, t in texts:
        shared = np.zeros(len(t), bool)
        for k in range(len(t) - size + 1):
            if len(where[t[k : k + size]]) > 1:
                shared[k : k + size] = True
        if len(whole[t]) > 1:
            shared[:] = True
        inside = np.concatenate([[False], shared, [False]])
        runs = [(a, b) for a, b in zip(np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1]), strict=True)]
        found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        many = [sum(1 for x, y in found if a <= x and y <= b) for a, b in runs]
        out[doc, sum(n > least for n in many), sum(n for n in many if n > least)] += 1
    return out


@pytest.mark.parametrize(("size", "passage", "least", "hot"), [(400, 224, 50, 2000), (60, 30, 4, 2), (60, 60, 3, 0), (33, 32, 0, 1)])
def test_passages_in_other_documents(docs, corpus, size, passage, least, hot):
    found = suffix_dedup.remove_repeats(docs, size, "none", ("kept_sha256",), passage, least, shard_bytes=5000, hot=hot)
    assert Counter(tuple(r) for r in found.select("doc_id", "n_passages", "n_passage_words").collect()) == passages_expected(corpus, passage, least)
    rows = found.drop("n_passages", "n_passage_words").collect()
    assert Counter(map(tuple, rows)) == bytes_expected(corpus, size, "none")


@pytest.mark.parametrize("seed", range(6))
def test_longest_previous_factors(seed):
    rng = np.random.default_rng(seed)
    size, floor = [(12, 5), (40, 9), (7, 7), (100, 1), (16, 8), (3, 2)][seed]
    texts = [bytes(rng.integers(97, 97 + 2 + seed % 3, rng.integers(1, 60), dtype=np.uint8)) for _ in range(20)]
    texts += [texts[3] + texts[4], texts[5][2:] + b"zz", b"a" * 50]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    rest = np.repeat(ends, [len(t) for t in texts]) - np.arange(len(data))
    starts = np.flatnonzero(rest >= floor)
    lpf, source, same = suffix_dedup.factors(data, rest, starts, size, floor)
    text = lambda k: data[starts[k] : starts[k] + min(rest[starts[k]], size)].tobytes()
    shared = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    for k in range(len(starts)):
        best = max([shared(text(k), text(j)) for j in range(k)], default=0)
        assert lpf[k] == (best if best >= floor else 0)
        if lpf[k]:
            assert source[k] < k and shared(text(k), text(source[k])) == lpf[k]
    assert all((same[a] == same[b]) == (text(a)[:floor] == text(b)[:floor]) for a in range(0, len(starts), 7) for b in range(len(starts)))


def test_smaller_before():
    rng = np.random.default_rng(0)
    for n in (0, 1, 200):
        values, group = rng.permutation(n), np.sort(rng.integers(0, 6, n))
        got = suffix_dedup.smaller_before(values, group)
        assert got.tolist() == [max([j for j in range(i) if values[j] < values[i] and group[j] == group[i]], default=-1) for i in range(n)]


def test_suffix_dedup_outputs(spark, none):
    rows = [(1, "abcdefgh-1"), (2, "xx abcdefgh"), (3, "abcdefgh")]
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()}
    assert [bytes(found[k].kept) for k in (1, 2, 3)] == [b"abcdefgh-1", b"xx ", b""]
    assert [tuple(s) for s in found[2].spans] == [(3, 11)]
    assert suffix_dedup.remove_repeats(none).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(none, keep="last")


def words_expected(rows, size):
    inf = float("inf")
    at = lambda r: inf if r[0] is None else r[0]
    least = defaultdict(lambda: inf)
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            least[g] = min(least[g], at(r))
    out = Counter()
    for r in rows:
        w = words(r[1])
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < at(r):
                gone.update(range(k, k + size))
        out[r[0], len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("size", "hot"), [(13, 9999), (13, 3), (13, 0), (3, 9999), (3, 4), (1, 9999), (9, 1)])
def test_fm_dedup(docs, corpus, size, hot):
    found = fm_dedup.remove_repeats(docs, size, ("kept_sha256",), shard_bytes=4000, hot=hot)
    assert Counter(map(tuple, found.collect())) == words_expected(corpus, size)


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(1, 5, 400), [0]])
    index = fm_dedup.Index(text)
    patterns = rng.integers(1, 5, (50, 4))
    lo, hi = np.zeros(50, np.int64), np.full(50, index.size)
    for k in (3, 2, 1, 0):
        lo, hi = index.extend(patterns[:, k], lo, hi)
    for p, a, b in zip(patterns, lo, hi, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(398) if (text[k : k + 4] == p).all()]
    assert len(index.positions) == -(-index.size // index.EVERY) and not hasattr(index, "sa")


def test_fm_index_locates_every_suffix():
    rng = np.random.default_rng(0)
    for top in (1, 2, 6):
        text = np.concatenate([np.concatenate([rng.integers(1, top + 1, rng.integers(1, 12)), [0]]) for _ in range(9)])
        assert fm_dedup.Index(text).locate(np.arange(len(text) + 1)).tolist() == sorted(range(len(text) + 1), key=lambda k: text[k:].tolist())


def test_matching_statistics():
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(1, 4, 300), [0], rng.integers(1, 4, 100), [0]])
    size, starts = 6, np.concatenate([np.arange(295), np.arange(301, 396)])
    copies = np.where(starts > 300, 1, np.where(starts < 20, 2, 1))
    length, lo, hi = fm_dedup.Index(text).statistics(text, starts, copies, size)
    for s, c, n, a, b in zip(starts, copies, length, lo, hi, strict=True):
        ends = lambda m: sum((text[k : k + m] == text[s + size - m : s + size]).all() for k in range(len(text) - m + 1))  # noqa: E731, B023
        assert n == (size if c > 1 else next((m for m in range(size) if ends(m + 1) < 2), size))
        if n == size:
            assert b - a == ends(size)


def test_minimizers_agree():
    values = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    values[100:140] = values[100]
    for w in (1, 3, 16, 40):
        top = values >> np.uint64(22)
        assert passages.minimizers(values, w).tolist() == [k + int(np.argmin(top[k : k + w])) for k in range(500 - w + 1)]


def vectors():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((160, 16))
    rows = [v.tolist() for v in x]
    for k in range(60):
        rows.append((x[k % 20] + 0.2 * rng.standard_normal(16)).tolist())
    rows += [rows[0]] * 5 + [[3 * a for a in rows[1]], [1e-30 * a for a in rows[2]]]
    out = [(i, r, i % 3) for i, r in enumerate(rows)]
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    return out + [(900 + i, b, 0) for i, b in enumerate(bad)] + [(None, rows[0], 0), out[4], (7, rows[30], 1)]


@pytest.mark.parametrize("knobs", [{}, {"cell_rows": 6}, {"blocks": 2, "tables": 30}])
def test_e8(spark, knobs):
    rows = vectors()
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and not any(x is None or not np.isfinite(x) for x in v) and any(v)]
    unit = [(i, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())) for i, v in good]
    links, near = [], []
    for a, (i, u) in enumerate(unit):
        near.append(sum(1 for b, (_, v) in enumerate(unit) if a != b and len(u) == len(v) and u @ v >= 0.9))
        links += [(i, j) for j, v in unit[:a] if len(u) == len(v) and u @ v >= 0.9]
    at = groups({i for i, _ in unit}, links)
    expected = Counter((i, n, at[i], i == at[i]) for (i, _), n in zip(unit, near, strict=True))
    taken = [i for i, _ in good]
    for i, _, _ in rows:
        if i in taken:
            taken.remove(i)
        else:
            expected[i, 0, i, True] += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert Counter(map(tuple, e8.near_duplicates(df, **knobs).collect())) == expected
    assert e8.near_duplicates(df.limit(0)).collect() == []


def test_e8_decodes_to_the_nearest_point():
    rng = np.random.default_rng(0)
    y = rng.uniform(-2, 2, (200, 8))
    z = e8.decode(y)
    assert ((2 * z) == np.rint(2 * z)).all() and (np.rint(z.sum(1)) % 2 == 0).all()
    best = ((y - z) ** 2).sum(1)
    assert (((y[:, None] - z[:, None] - e8.NEAR[None]) ** 2).sum(2) >= best[:, None] - 1e-9).all() and len(e8.NEAR) == 240


def test_e8_recall_on_pairs_at_the_threshold():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((600, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(0.19) * z
    a, b = e8.cells(x), e8.cells(y)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) > 0.99


@pytest.mark.parametrize(("per_block", "blocks"), [(20, 2), (1, 3)])
def test_e8_larger_tables_lose_no_links(spark, monkeypatch, per_block, blocks):
    rng = np.random.default_rng(31)
    x = rng.standard_normal((150, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((150, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9001 * x + np.sqrt(1 - 0.9001**2) * z
    monkeypatch.setattr(e8, "PER_BLOCK", per_block)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    found = e8.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == {(k, 1, k % 150) for k in range(300)}
    assert e8.layout(300) == blocks


@pytest.mark.parametrize("blocks", [1, 2, 3])
@pytest.mark.parametrize("dim", [8, 64, 384])
def test_e8_recall_of_each_layout(blocks, dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((2000, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(0.19) * z
    a, b = (e8.cells(v, e8.TABLES_AT[blocks], blocks=blocks) for v in (x, y))
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) > 0.999
