import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataloom.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance int, `__v` string"


def vectors(n=150, dims=64, seed=3):
    rnd = random.Random(seed)
    made = [(i, [float(np.float32(rnd.gauss(i % 5, 0.2 + (d % 7)))) for d in range(dims)]) for i in range(n)]
    made += [(7, made[7][1]), (7, made[8][1]), (None, made[9][1]), (None, [0.0] * dims), (900, None), (901, [1.0] * (dims - 1)), (902, [1.0] * (dims - 1) + [None]), (903, [float("nan")] + [1.0] * (dims - 1))]
    made += [(904, [float("inf")] * dims), (905, [3.0e38] + [-3.0e38] * (dims - 1)), (906, []), (907, [1.0] * (dims + 1))]
    return [(i, v, 1, "c", 2, "w") for i, v in made]


def brute(rows, dims=64, clusters=8, rounds=10, seed=3):
    limit = 1 << 27
    kept = [(i, [max(-limit, min(limit, math.floor(1024 * x))) for x in v], v) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "" if i is None else str(i)
    starts = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{name(r[0])}".encode()).hexdigest(), r[0] if r[0] is not None else -1, r[2]))
    cents = [r[1] for r in starts[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, c), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(cents)]
    found = [(i, *nearest(v)) for i, v, _ in kept]
    inertia = Counter()
    for _, d, k in found:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, d, k in found)


@pytest.mark.parametrize("options", [{}, {"clusters": 3, "rounds": 2, "seed": 9}, {"clusters": 400, "rounds": 1}])
def test_against_brute_force(spark, options):
    rows = [r for r in vectors() if r[0] != 905]
    got = clustering.clustered(spark.createDataFrame(rows, SCHEMA).repartition(5), **options)[0]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, **options)


def test_components_beyond_the_limit_count_as_the_limit(spark):
    rows = vectors(12)
    got = clustering.clustered(spark.createDataFrame(rows, SCHEMA))[0]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)
    assert any(r.vec_id == 905 for r in got.collect())


def test_few_and_no_vectors(spark):
    for rows in (vectors(12)[2:4], vectors(12)[15:21], []):
        got = clustering.clustered(spark.createDataFrame(rows, SCHEMA))[0]
        assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_partial_distances_lose_no_tie():
    rnd = np.random.default_rng(1)
    v, c = rnd.integers(-2, 3, (4000, 64)), rnd.integers(-2, 3, (20, 64))
    c[7] = c[2]
    v[:50] = c[7]
    far = np.square(v[:, None, :] - c[None]).sum(axis=2)
    for order in (np.arange(64), rnd.permutation(64)):
        for step in (1, 8, 64):
            who, d = clustering.nearest(v, c, order, step)
            assert (who == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()
    assert (far.argmin(axis=1)[:50] == 2).all()


def test_places_of_vectors_that_take_part():
    rows = [r[1] for r in vectors(10)]
    at, v = clustering.integers(pa.array(rows, pa.list_(pa.float64())))
    assert [len(rows[i]) for i in at] == [64] * len(at) and v.shape == (len(at), 64) and len(at) == 10 + 4 + 1


def test_query_reads_the_whole_table(spark, tmp_path):
    rows = [r for r in vectors(40) if r[0] != 905]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert Counter(tuple(r) for r in clustering.op12_centroid_clustering(spark, str(tmp_path)).collect()) == brute(rows)
