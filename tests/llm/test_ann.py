import numpy as np

from strataloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string, score string"


def brute(vectors, k=10):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], dtype=np.float64)
    out = {}
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - np.array(vectors[q], dtype=np.float64)) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def frame(spark, vectors, more=()):
    return spark.createDataFrame([(int(i), [float(v) for v in x], 0, "l", "s") for i, x in vectors.items()] + list(more), SCHEMA)


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    vectors = {i: np.float32(rng.normal(size=16)) for i in range(3000)}
    vectors |= {i: vectors[7] for i in range(3000, 3900)}  # one very common vector
    want = brute(vectors)
    got = {}
    for r in ann.k_nearest_neighbours(frame(spark, vectors), lambda c: c % 100 == 0, leaf_rows=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        assert all(abs(s - float(np.sqrt(((np.float64(vectors[v]) - np.float64(vectors[q])) ** 2).sum()))) < 1e-12 for _, v, s in found)
        hit += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hit >= 0.9 * 10 * len(want)


def test_few_candidates_and_unusable_vectors(spark):
    good = {0: [1.0, 0.0], 100: [0.0, 1.0], 5: [1.0, 1.0]}
    odd = [(200, None, 0, "l", "s"), (300, [0.0, 0.0], 0, "l", "s"), (400, [float("nan"), 1.0], 0, "l", "s"), (500, [None, 1.0], 0, "l", "s"), (600, [], 0, "l", "s"), (None, [1.0, 2.0], 0, "l", "s"), (700, [1.0, 2.0, 3.0], 0, "l", "s"), (800, [float("inf"), 1.0], 0, "l", "s")]
    got = ann.k_nearest_neighbours(frame(spark, good, odd), lambda c: c % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 5), (0, 2, 100), (100, 1, 5), (100, 2, 0)]


def test_ties_go_to_the_smaller_id(spark):
    vectors = {0: [1.0, 0.0]} | {i: [0.0, 1.0] for i in range(1, 30)}
    got = ann.k_nearest_neighbours(frame(spark, vectors), lambda c: c % 100 == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(i, i) for i in range(1, 11)]


def test_no_rows(spark):
    assert ann.k_nearest_neighbours(spark.createDataFrame([], SCHEMA), lambda c: c % 100 == 0).count() == 0


def test_walk_reaches_every_leaf():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8))
    tree = ann.Tree(x, 50)
    assert sorted(tree.order(x[0], tree.leaves)) == list(range(tree.leaves)) and tree.order(x[0], 1) == [tree.assign(x[:1])[0]]


def test_small_leaves_are_widened_until_they_hold_enough(spark):
    rng = np.random.default_rng(9)
    vectors = {i: np.float32(rng.normal(size=8)) for i in range(600)}
    again = [(100, [float(v) for v in vectors[100]], 0, "l", "s")] * 15  # rows of the query's own id are no candidates
    got = ann.k_nearest_neighbours(frame(spark, vectors, again), lambda c: c % 100 == 0, target=0.0, leaf_rows=8).collect()
    ranks = {}
    for r in got:
        ranks.setdefault(r.query_id, set()).add(r["rank"])
    assert ranks == {q: set(range(1, 11)) for q in range(0, 600, 100)}


def neighbours(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_repeated_query_rows_are_asked_once(spark):
    rng = np.random.default_rng(12)
    vectors = {i: np.float32(rng.normal(size=6)) for i in range(400)}
    row = lambda i, x: (i, [float(v) for v in x], 0, "l", "s")
    again = [row(100, vectors[100])] * 7 + [row(200, vectors[5])] * 2 + [row(5, vectors[5])] * 3  # id 200 has two vectors, and row 5 stands four times
    got = neighbours(ann.k_nearest_neighbours(frame(spark, vectors, again), lambda c: c % 100 == 0, leaf_rows=32, target=1.0, min_visits=99).collect())
    x = [(i, np.float64(v)) for i, v in vectors.items()] + [(i, np.float64(v)) for i, v, *_ in again]
    for q in (0, 100, 200, 300):
        own = min(tuple(v) for i, v in x if i == q)
        d = sorted((float(np.sqrt(((v - np.array(own)) ** 2).sum())), i) for i, v in x if i != q)[:10]
        assert [(i, r) for r, i, _ in got[q]] == [(i, r) for r, (_, i) in enumerate(d, 1)]
        assert np.allclose([s for *_, s in got[q]], [s for s, _ in d], atol=1e-12)


def test_every_length_has_its_own_index(spark):
    rng = np.random.default_rng(13)
    vectors = {i: np.float32(rng.normal(size=4 if i % 3 else 9)) for i in range(900)}
    got = neighbours(ann.k_nearest_neighbours(frame(spark, vectors), lambda c: c % 100 == 0, leaf_rows=32).collect())
    assert set(got) == set(range(0, 900, 100)) and all([r for r, *_ in x] == list(range(1, 11)) for x in got.values())
    assert all(len(vectors[v]) == len(vectors[q]) for q, x in got.items() for _, v, _ in x)


def test_many_leaves_reach_the_recall(spark):
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(60, 24))
    vectors = {i: np.float32(centres[i % 60] + 0.6 * rng.normal(size=24)) for i in range(6000)}
    want = brute(vectors)
    got = neighbours(ann.k_nearest_neighbours(frame(spark, vectors), lambda c: c % 100 == 0, leaf_rows=24).collect())
    hit = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)


def test_crowded_cells_have_trees_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 200)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(15)
    vectors = {i: np.float32(rng.normal(size=10)) for i in range(4000)}
    vectors |= {i: vectors[7] for i in range(4000, 4700)}
    want = brute(vectors)
    again = [(300, [float(v) for v in vectors[300]], 0, "l", "s")] * 500  # rows of one id fill leaves and blocks
    got = neighbours(ann.k_nearest_neighbours(frame(spark, vectors, again), lambda c: c % 100 == 0, leaf_rows=24, cells=6, sub_sample=300).collect())
    assert set(got) == set(want) and all([r for r, *_ in x] == list(range(1, 11)) for x in got.values())
    others = [q for q in want if not any(v == 300 for v, _ in want[q])]
    hit = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in others)
    assert len(others) > 30 and hit >= 0.9 * 10 * len(others)
    everything = neighbours(ann.k_nearest_neighbours(frame(spark, vectors), lambda c: c % 100 == 0, leaf_rows=24, cells=6, sub_sample=300, min_visits=10**6).collect())
    assert {q: [v for _, v, _ in x] for q, x in everything.items()} == {q: [v for v, _ in x] for q, x in want.items()}
