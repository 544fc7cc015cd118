"""Hard negatives, source mixing and centroid clustering against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from llm_cases import LONG, cases, documents, split_words

from cloudinv.llm import centroids, mixing, negatives

VECTORS = "vec_id long, embedding array<float>, label int, score int, cluster string"


def vectors(n, dim, seed=1, grid=4):
    """Coarse components, so that scores tie often."""
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-grid, grid) / 256 for _ in range(dim)], rng.randrange(3), 1, "x") for i in range(n)]
    odd = [[math.nan] * dim, [None] * dim, [math.inf] * dim, None, [], [0.5] * (dim + 1), [0.5] * (dim + 1)]
    rows += [(n + i, v, 1, 1, "x") for i, v in enumerate(odd)]
    rows += [(None, [0.1] * dim, 1, 1, "x"), (n + 10, [0.1] * dim, None, 1, "x"), *rows[3:6], (0, [0.25] * dim, 2, 0, "y")]
    return rows


def floors(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# -- hard negatives --------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (64, 64, 64), (33, 65, 130), (3, 0, 4), (0, 4, 2)])
@pytest.mark.parametrize("most", [9, 2**31, 2**62])
def test_strassen_is_exact(shape, most):
    rng = random.Random(str(shape))
    m, d, n = shape
    a = np.array([[rng.randint(-most, most) for _ in range(d)] for _ in range(m)], object).reshape(m, d)
    b = np.array([[rng.randint(-9, 9) if most > 2**31 else rng.randint(-most, most) for _ in range(n)] for _ in range(d)], object).reshape(d, n)
    want = (a @ b) if d else np.zeros((m, n), object)
    assert (negatives.strassen(a, b, 4) == want).all()
    wrapped = negatives.strassen(a.astype(np.int64), b.astype(np.int64), 4)
    assert all((int(x) - int(y)) % 2**64 == 0 for x, y in zip(wrapped.flat, want.flat))


def test_scores_beyond_a_long_are_an_error():
    far = np.full((1, 4), 2**62)
    with pytest.raises(OverflowError):
        negatives.scores(far, far)
    opposite = np.array([[2**62, 2**62]])
    assert negatives.scores(opposite, np.array([[3, -3]])).tolist() == [[0]]


def test_heaps_merge():
    rng = np.random.default_rng(1)
    score, ids = rng.integers(0, 20, 200), rng.permutation(200)
    want = sorted(zip(-score, ids))[:7]
    parts = [negatives.Heap(7) for _ in range(4)]
    for i, part in enumerate(parts):
        part.push(score[i::4], ids[i::4])
    for part in parts[1:]:
        parts[0].merge(part)
    assert list(zip(-parts[0].score, parts[0].id)) == want


def plain_negatives(rows, every):
    good = [(i, floors(v, 256), y) for i, v, y, *_ in rows if i is not None and y is not None and sound(v)]
    out = []
    for i, v, y in good:
        if i % every:
            continue
        met = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in good if j != i and len(w) == len(v)]
        for p, j, _ in sorted(m for m in met if m[2] == y)[:5]:
            near = sorted(m for m in met if m[2] != y and 80 * -p <= 100 * -m[0] <= 100 * -p)[:5]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [16, 8192])
def test_negatives_against_plain_python(spark, size, monkeypatch):
    rows = vectors(150, 6)
    df = spark.createDataFrame(rows, VECTORS)
    got = negatives.mine(df, df.where("vec_id % 10 = 0"), size=size)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, 10)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame(vectors(20, 3), VECTORS)
    alike = some.where("label = 1")
    for both in ((empty, empty), (some, empty), (empty, some), (alike, alike)):
        assert negatives.mine(*both).count() == 0


def test_vectors_under_one_id_are_dealt_evenly(spark):
    rows = [(7, [0.5, i / 256], 1, 0, "") for i in range(400)] + [(i, [0.5, 0.25], i % 2, 0, "") for i in range(100, 300)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    good = df.selectExpr("vec_id", "cast(label as long) label", "cast(embedding as array<double>) embedding")
    blocks, n = negatives._blocks(good, 50, "test")
    sizes = [len(r.ids) // 8 for r in blocks.collect()]
    assert sum(sizes) == 600 and max(sizes) <= 50 and n == len(sizes) >= 12
    got = negatives.mine(df, df.where("vec_id % 100 = 0"), size=50)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, 100)


# -- mixing ----------------------------------------------------------------------------


def plain_targets(sizes):
    """Water rises evenly per weight until every source is full or the words are used up."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    targets, full = {}, set()
    while True:
        left = Fraction(3, 2) * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        targets = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[t] for t in open_) for s in names}
        above = {s for s in open_ if targets[s] > 2 * sizes[s]}
        if not above:
            return targets
        full |= above


def check_mix(rows, got):
    size = lambda t: len(split_words(t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], size(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    targets = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(targets[r.source]), rel=1e-12)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for source, words in taken.items():
        passes = {r.copies for r in got if r.source == source and r.size}
        assert max(passes, default=0) - min(passes, default=0) <= 1
    return taken, targets


def test_mix_of_odd_documents(spark):
    rows = [(*r[:3], ("a", "é", "B", None, "")[i % 5], 0) for i, r in enumerate(cases())]
    docs = documents(spark, rows).selectExpr("*", "1 as size", "2 as key", "3 as m", "4 as copy")
    check_mix(rows, mixing.mix(docs).collect())
    again = [tuple(r) for r in mixing.mix(docs.repartition(7)).collect()]
    assert sorted(again, key=repr) == sorted((tuple(r) for r in mixing.mix(docs).collect()), key=repr)
    assert mixing.mix(documents(spark, [])).count() == 0
    none = mixing.mix(documents(spark, [(1, None, None, "s", 0), (2, " ", None, "t", 0)])).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2


def test_budgets_are_met_exactly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN", 3)
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 40), None, rng.choice("aaaab") + str(i % 2), 0) for i in range(900)]
    rows += [(5, "same words here", None, "a0", 0)] * 400  # one id holds a third of a source
    monkeypatch.setattr(mixing, "COPIES", 64)
    taken, targets = check_mix(rows, mixing.mix(documents(spark, rows), room=50).collect())
    assert all(taken[s] == round(targets[s]) for s in targets)


def test_knapsack_against_all_sums():
    rng = random.Random(2)
    for _ in range(200):
        sizes = np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 4))))
        counts = np.array([rng.randint(0, 4) for _ in sizes])
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        budget = rng.randint(0, int(sizes @ counts) + 5)
        best = max(x for x in sums if x <= budget)
        picked = mixing.knapsack(sizes, counts, budget)
        assert (picked <= counts).all() and (picked >= 0).all() and picked @ sizes == best
        budget = min(budget, int(sizes @ counts))
        fitted = mixing.fit(sizes, counts, budget, room=rng.choice((1, 10, 1000)))
        assert (fitted <= counts).all() and (fitted >= 0).all() and abs(fitted @ sizes - budget) <= sizes.max()


def test_every_length_takes_its_share():
    sizes, counts = np.arange(1, 301), np.full(300, 1000)
    taken = mixing.fit(sizes, counts, int(sizes @ counts) // 3, room=500)
    assert taken @ sizes == int(sizes @ counts) // 3
    assert np.abs(taken[20:] - 333).max() <= 10


def test_word_counts(spark):
    texts = ["", "a", " a", "a ", "a b\tc\nd\x0be\x0cf\rg", "é ß 日 本", "  ", LONG, None, "x" * 300_000 + " y"]
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.size for r in mixing.sized(docs).collect()}
    assert got == {i: len(split_words(t or "")) for i, t in enumerate(texts)}


# -- centroids -------------------------------------------------------------------------


def plain_clusters(rows, clusters, rounds, dim):
    kept = [(i, floors(v, 1024)) for i, v, *_ in rows if sound(v) and len(v) == dim]
    order = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    points = [v for _, v in sorted(kept, key=order)[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        near = [min((far(v, p), c) for c, p in enumerate(points)) for _, v in kept]
        if n < rounds:
            for c in range(len(points)):
                own = [v for (_, v), (_, k) in zip(kept, near) if k == c]
                if own:
                    points[c] = [sum(x) // len(own) for x in zip(*own)]
    inertia = Counter()
    for d, c in near:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return [(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(kept, near)]


@pytest.mark.parametrize(("dim", "clusters", "grid"), [(4, 8, 4), (2, 8, 1), (6, 3, 2000), (3, 1, 9)])
def test_clusters_against_plain_python(spark, dim, clusters, grid):
    rows = vectors(200, dim, grid=grid)
    df = spark.createDataFrame(rows, VECTORS)
    got = centroids.cluster(df, clusters=clusters, dim=dim).drop("n_checked").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_clusters(rows, clusters, 10, dim), key=repr)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame(vectors(3, 64)[:3], VECTORS)
    assert sorted(r.distance for r in centroids.cluster(df).collect()) == [0, 0, 0]
    assert centroids.cluster(df.where("vec_id < 0")).count() == 0
    assert centroids.cluster(df, dim=5).count() == 0


def test_bounds_never_exceed_distances_and_rule_centroids_out():
    rng = np.random.default_rng(3)
    middles = rng.integers(-(2**12), 2**12, (8, 64))
    cells = (middles[rng.integers(0, 8, 4000)] + rng.integers(-60, 60, (4000, 64))).astype(np.int64)
    pivots = centroids.Pivots(centroids.spread(cells[:500], 6))
    cached = pivots.distances(cells)
    bounds = pivots.bounds(cached, middles)
    exact = np.stack([centroids.squares(cells, m) for m in middles], axis=1)
    assert (bounds <= exact).all()
    cluster, best, checked = centroids.assign(cells, cached, pivots, middles)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert checked.mean() < 3  # of 8


def test_large_components_are_exact():
    cells = np.array([[2**40, 0], [2**40 + 1, 5], [-(2**40), 7]])
    pivots = centroids.Pivots(centroids.spread(cells, 3))
    cluster, best, _ = centroids.assign(cells, pivots.distances(cells), pivots, cells[[2, 0]])
    assert cluster.tolist() == [1, 1, 0] and [int(b) for b in best] == [0, 26, 0]
