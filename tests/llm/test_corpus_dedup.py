"""Dedup operators against brute force on small tables with hard rows."""
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from metrilake.llm import golomb, hyperminhash, projection
from metrilake.llm.common import components, forest

DDL = "doc_id long, text string, uid long, key string, grp int, fp string, n int"


def texts(seed=1):
    """Random prose with exact copies, copies in other white space, near copies, nulls, blanks and a very long text."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = [None, "", " ", "\t\n", "one", "one two three", "One  two\tTHREE", "x " * 5, None, ""]
    for _ in range(30):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([6, 30, 120, 400]))]
        out.append(" ".join(base))
        for _ in range(rnd.randrange(5)):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 6])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(rnd.choice([" ", "\n", "  "]).join(w))
    out.append(" ".join(rnd.choice(vocab) for _ in range(60_000)))
    out += [out[-1], out[-1] + " tail"]
    return out


def table(spark, rows):
    """doc_id and text beside columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 7, "k", 1, "f", 2) for i, t in rows], DDL).repartition(3)


def sets(text, width=5):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def classes(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("percent,block", [(85, 512), (80, 3)])
def test_near_duplicates_match_brute_force(spark, percent, block):
    rows = list(enumerate(texts()))
    got = hyperminhash.near_duplicates(table(spark, rows), percent=percent, block_docs=block, block_shingles=700 if block == 3 else 1 << 18).toPandas()
    s = {i: sets(t) for i, t in rows}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    want = classes(s, links)
    assert dict(zip(got.doc_id, got.component_id)) == want
    assert dict(zip(got.doc_id, got.n_shingles)) == {i: len(x) for i, x in s.items()}
    assert set(got[got.kept].doc_id) == set(want.values()) == set(got[got["first"]].doc_id)


def test_near_duplicates_of_repeated_and_keyless_rows(spark):
    t = "a b c d e f g h"
    got = hyperminhash.near_duplicates(table(spark, [(None, t), (5, t), (5, t), (None, "z z z z z z"), (None, None)])).toPandas()
    assert len(got) == 5 and got["first"].sum() == 3
    same = got[got.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
    assert set(same.component_id) == {5} and same.kept.sum() == 2
    assert hyperminhash.near_duplicates(table(spark, []).filter("false")).count() == 0


def test_sketch_estimates_jaccard():
    rnd = np.random.default_rng(3)
    for size in (1, 8, 150, 5000):
        pool = rnd.integers(0, 2 ** 63, size * 2).astype(np.uint64)
        a, b = np.unique(pool[:size]), np.unique(pool[size // 8:size + size // 8])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = hyperminhash.estimate([hyperminhash.sketch(a).tobytes()], [hyperminhash.sketch(b).tobytes()], np.array([len(a)]), np.array([len(b)]))[0, 0]
        assert abs(est - true) < 5 * (max(true * (1 - true), 0.01) / hyperminhash.K) ** 0.5
    assert hyperminhash.band_rows(0.85) == 7 and hyperminhash.band_rows(0.8) == 6


def test_common_sizes_in_pieces():
    rnd = np.random.default_rng(4)
    a = [np.unique(rnd.integers(0, 300, 60)).astype(np.uint64) for _ in range(9)]
    got = hyperminhash.common_sizes([x.tobytes() for x in a], [x.tobytes() for x in a[:4]], at_once=50)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in a[:4]] for x in a]


def test_components_of_paths_stars_and_pairs(spark):
    rnd = random.Random(5)
    path = list(range(1000, 1040))
    rnd.shuffle(path)
    edges = list(zip(path, path[1:])) + [(7, x) for x in range(8, 60)] + [(100, 101), (101, 100), (5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{x: 1000 for x in path}, **{x: 7 for x in range(7, 60)}, 100: 100, 101: 100}


def test_forest_connects_what_the_matrix_connects():
    rnd = np.random.default_rng(6)
    rows, cols = np.arange(20), np.arange(10, 35)
    m = rnd.random((20, 25)) < 0.04
    a, b = forest(m, rows, cols)
    want = classes(range(35), [(int(rows[i]), int(cols[j])) for i, j in zip(*np.nonzero(m))])
    assert classes(range(35), list(zip(a.tolist(), b.tolist()))) == want and len(a) < 35


def test_exact_duplicates_match_brute_force(spark):
    rows = list(enumerate(texts(2)))
    got = golomb.exact_duplicates(table(spark, rows)).toPandas()
    group = defaultdict(list)
    for i, t in rows:
        group[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in group.items() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.itertuples()} == want


def test_exact_duplicates_of_repeated_and_keyless_rows(spark):
    got = golomb.exact_duplicates(table(spark, [(4, "a"), (4, "a"), (None, "a"), (None, "b")])).toPandas()
    a = got[got.text_sha256 == hashlib.sha256(b"a").hexdigest()]
    assert len(got) == 4 and set(a.keep_id) == {4} and set(a.group_size) == {3} and a.kept.sum() == 1
    assert golomb.exact_duplicates(table(spark, []).filter("false")).count() == 0


def test_rice_code_round_trip():
    rnd = np.random.default_rng(7)
    for n, top in ((1, 2 ** 64 - 1), (2, 2), (1000, 2 ** 64 - 1), (5000, 6000), (3, 2 ** 63)):
        x = np.unique(rnd.integers(0, top, n, dtype=np.uint64, endpoint=True))
        assert (golomb.rice_decode(len(x), *golomb.rice_encode(x)) == x).all()
    x = np.unique(rnd.integers(0, 2 ** 64 - 1, 100_000, dtype=np.uint64))
    _, k, unary, rest = golomb.rice_encode(x)
    assert (len(unary) + len(rest)) * 8 / len(x) < np.log2(2 ** 64 / len(x)) + 2.2


def test_suspects_are_those_that_occur_again(spark):
    rnd = random.Random(8)
    rows = [((i % 4) << 33 | i, rnd.randrange(-300, 300) * 2 ** 54) for i in range(500)]
    got = {r.uid for r in golomb.suspects(spark.createDataFrame(rows, "uid long, fp long"), 5).collect()}
    n = defaultdict(int)
    for _, fp in rows:
        n[fp] += 1
    assert got == {u for u, fp in rows if n[fp] > 1}


def test_near_vectors_match_brute_force(spark):
    rnd = np.random.default_rng(9)
    base = rnd.standard_normal((60, 16))
    vecs = [*base, *(base[rnd.integers(0, 60, 80)] + 0.08 * rnd.standard_normal((80, 16))), *np.repeat(base[:2], 40, axis=0), 3 * base[5]]
    rows = [(i, [float(x) for x in v], i % 3 if i % 11 else None) for i, v in enumerate(vecs)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, [], 1), (1005, [1.0, 2.0], 1), (1006, [1e300] * 16, 2)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, payload string, uid int").repartition(3)
    got = projection.near_vectors(df, window=4).toPandas()
    u = {}
    for i, v, lab in rows:
        x = np.array([np.nan if a is None else a for a in v or []], float)
        if lab is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            x = x / np.abs(x).max()
            u[i] = (x / np.linalg.norm(x), lab)
    links = [(a, b) for a in u for b in u if a < b and u[a][1] == u[b][1] and len(u[a][0]) == len(u[b][0]) and u[a][0] @ u[b][0] >= 0.93]
    want = classes([r[0] for r in rows], links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert dict(zip(got.vec_id, got.component_id)) == want
    assert dict(zip(got.vec_id, got.n_links)) == {r[0]: n[r[0]] for r in rows}
    assert projection.near_vectors(df.filter("false")).count() == 0


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def isolated_pairs(rnd, n, dim, shared, pairs):
    """n vectors of a mutual cosine of about ``shared``, the last ``pairs`` of them at a cosine of 0.935 to the first ones."""
    axis = np.eye(dim)[0]
    x = unit_rows(np.sqrt(shared) * axis + np.sqrt(1 - shared) * unit_rows(rnd.standard_normal((n, dim)) * (1 - axis)))
    off = rnd.standard_normal((pairs, dim))
    off = unit_rows(off - (off * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    x[n - pairs:] = 0.935 * x[:pairs] + np.sqrt(1 - 0.935 ** 2) * off
    return x


@pytest.mark.parametrize("n,shared,window,left", [(1500, 0.8, 4, True), (1500, 0.8, 64, False), (3000, 0.0, 4, False), (400, 0.8, 256, False)])
def test_isolated_pairs_of_dense_and_spread_labels_are_found(spark, n, shared, window, left):
    """By the passes alone, but where rows stay too crowded for them; then by comparing those whole."""
    x = isolated_pairs(np.random.default_rng(4), n, 64, shared, 100)
    df = spark.createDataFrame([(i, [float(a) for a in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    thin = spark.createDataFrame([(1, i, v.tobytes()) for i, v in enumerate(x)], "grp long, uid long, payload binary")
    sim = x @ x.T
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(sim >= 0.93)) if a < b]
    assert len(links) >= 100
    edges, rest = projection.sorted_passes(thin, cosine=0.93, window=window, seed=5)
    rest = {r.uid for r in rest.collect()}
    assert bool(rest) == left
    found = classes(range(n), [(r.a, r.b) for r in edges.collect()])
    missed = [(a, b) for a, b in links if found[a] != found[b]]
    assert all(a in rest and b in rest for a, b in missed)
    got = projection.near_vectors(df, window=window).toPandas()
    assert dict(zip(got.vec_id, got.component_id)) == classes(range(n), links)


def test_nearness_is_a_bound_for_a_part_of_the_order():
    """Of any stretch of the order, no row is nearer than in the whole of it, and those far from its ends are as near."""
    rnd = np.random.default_rng(3)
    key = np.sort(rnd.integers(0, 1 << 62, 500) * 2 + 1)
    grp = np.zeros(500, np.int64)
    whole = projection.nearness(grp, key, 0.93, 4)
    for a, b in ((0, 500), (100, 300), (7, 12), (3, 4)):
        part = projection.nearness(grp[a:b], key[a:b], 0.93, 4)
        assert (part <= whole[a:b] + 1e-12).all()
        assert b - a < 60 or (part[20:-20] == whole[a:b][20:-20]).mean() > 0.9
    assert (projection.nearness(np.zeros(3), np.array([1, 2, 3]), 0.93, 8) < 1).all()


def test_prefix_depths_match_counts():
    rnd = np.random.default_rng(3)
    key = np.concatenate([rnd.integers(0, 1 << 63, 60), (np.int64(5) << 59) + rnd.integers(0, 1 << 20, 30), np.full(9, 77)])
    grp = np.repeat([1, 2], [50, 49])
    order = np.lexsort((key, grp))
    grp, key = grp[order], key[order]
    for window in (1, 4, 8):
        want = []
        for g, k in zip(grp, key):
            shared = [int(((grp == g) & (key >> (63 - d) == k >> (63 - d))).sum()) for d in range(64)]
            want.append(next((d for d in range(64) if shared[d] <= window + 1), 64))
        assert projection.prefix_depths(grp, key, window).tolist() == want
