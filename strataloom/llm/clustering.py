"""Centroid clustering of integer vectors by partial-distance search.

Vectors of so many finite components become integers, floor(1024 * x). Centroids start as the vectors with the smallest hashes of their ids; a round assigns every vector to its nearest centroid and
replaces each centroid by the floored mean of its vectors. Only centroids and sums travel: every round reads the table as it lies, a task sends one row of sums for each cluster, and the
driver sees clusters x components sums. No vector is shuffled, kept in memory over rounds or written.

Nearest centroids are searched by partial distances: components are ordered by their variance over all vectors, largest first, and squared differences are summed a few components at a time;
a centroid is abandoned for all vectors whose sum is strictly above their best distance so far, and survivors finish all components. Sums only grow, so nothing that could win or tie
is lost, whatever the order is.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; integers beyond LIMIT in size count as LIMIT, so that squared distances fit a long;
fewer vectors than clusters give as many clusters as there are vectors; repeated rows are vectors of their own; a null id is hashed as an empty one; equal hashes are ordered by id, then components;
sums of distances over a long are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import table

DIMS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024.0
#: The largest size of an integer component: 64 squared differences of these stay within a long.
LIMIT = 1 << 27
#: Components that are summed between two looks at the best distance.
STEP = 8


def integers(column: pa.ListArray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that take part, and their integer components."""
    right = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)
    flat = column.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(flat).all(axis=1)
    return right[finite], np.clip(np.floor(flat[finite] * SCALE), -LIMIT, LIMIT).astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number) and the squared distance."""
    v, c = vectors[:, order], centroids[:, order]
    who = np.zeros(len(v), dtype=np.int32)
    best = np.square(v - c[0]).sum(axis=1)
    for k in range(1, len(c)):
        alive, so_far = np.arange(len(v)), np.zeros(len(v), dtype=np.int64)
        for at in range(0, v.shape[1], step):
            so_far = so_far + np.square(v[alive, at : at + step] - c[k, at : at + step]).sum(axis=1)
            stay = so_far <= best[alive]
            alive, so_far = alive[stay], so_far[stay]
        closer = so_far < best[alive]
        best[alive[closer]], who[alive[closer]] = so_far[closer], k
    return who, best


def taking_part(col: Column, dims: int = DIMS) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return col.isNotNull() & (F.size(col) == dims) & F.forall(col, number)


def first_centroids(rows: DataFrame, clusters: int, seed: int, dims: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id: so many rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))), 256)
    found = rows.where(taking_part(F.col("__v"), dims)).orderBy(digest, "__id", "__v").limit(clusters).collect()
    return integers(pa.array([r["__v"] for r in found], pa.list_(pa.float64())), dims)[1]


def spread_order(rows: DataFrame, dims: int) -> np.ndarray:
    """Components by their variance over all vectors, the largest first."""

    def run(batches):
        n, total, squares = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            v = integers(batch.column(0), dims)[1].astype(np.float64)
            n, total, squares = n + len(v), total + v.sum(axis=0), squares + np.square(v).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(total), pa.array(squares)], names=["d", "n", "total", "squares"])

    parts = rows.select("__v").mapInArrow(run, "d int, n long, total double, squares double")
    sums = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    spread = {r["d"]: r["squares"] / r["n"] - (r["total"] / r["n"]) ** 2 if r["n"] else 0.0 for r in sums.collect()}
    return np.array(sorted(range(dims), key=lambda d: (-spread.get(d, 0.0), d)))


def moved_centroids(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One round: each centroid is the floored mean of the vectors nearest to it; one without vectors stays."""
    clusters, dims = centroids.shape

    def run(batches):
        sums = np.zeros((clusters, dims + 1), dtype=np.int64)  # the last one counts
        for batch in batches:
            v = integers(batch.column(0), dims)[1]
            who = nearest(v, centroids, order)[0]
            for k in range(clusters):
                mine = v[who == k]
                sums[k, :dims] += mine.sum(axis=0)
                sums[k, dims] += len(mine)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(clusters, dtype=np.int32)), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["k", "sums"])

    parts = rows.select("__v").mapInArrow(run, "k int, sums array<long>").select("k", F.posexplode("sums").alias("d", "x"))
    total: dict = {(r["k"], r["d"]): int(r["x"]) for r in parts.groupBy("k", "d").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
    moved = centroids.copy()
    for k in range(clusters):
        n = total.get((k, dims), 0)
        if n:
            moved[k] = [total[k, d] // n for d in range(dims)]
    return moved


def inertias(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> list[int]:
    """The distances summed over each cluster."""
    clusters, dims = centroids.shape

    def run(batches):
        sums = [0] * clusters
        for batch in batches:
            who, d = nearest(integers(batch.column(0), dims)[1], centroids, order)
            for k in range(clusters):  # in two halves, as whole distances may sum to more than a long
                mine = d[who == k]
                sums[k] += (int((mine >> 32).sum()) << 32) + int((mine & 0xFFFFFFFF).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(clusters, dtype=np.int32)), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["k", "x"])

    parts = rows.select("__v").mapInArrow(run, "k int, x decimal(38,0)").groupBy("k").agg(F.sum("x").cast("decimal(38,0)").alias("x"))
    found = {r["k"]: int(r["x"]) for r in parts.collect()}
    return [found.get(k, 0) for k in range(clusters)]


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part, and the final centroids."""
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).cast("array<double>").alias("__v"))
    schema = f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(rows, clusters, seed, dims)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema), centroids
    order = spread_order(rows, dims)
    for _ in range(rounds):
        moved = moved_centroids(rows, centroids, order)
        if (moved == centroids).all():  # as any later round would leave them
            break
        centroids = moved
    final = centroids
    within = inertias(rows, final, order)
    as_long = lambda x: x if x < 1 << 63 else None
    own, over_all = pa.array([as_long(x) for x in within], pa.int64()), as_long(sum(within))
    digests = pa.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in final])

    def run(batches):
        for batch in batches:
            at, v = integers(batch.column(1), dims)
            who, d = nearest(v, final, order)
            k = pa.array(who)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), k, pa.array(d), own.take(k), pa.array([over_all] * len(at), pa.int64()), digests.take(k)], names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return rows.mapInArrow(run, schema), final


def op12_centroid_clustering(spark, sf_dir):
    return clustered(table(spark, sf_dir, "embeddings"))[0]


def _sql() -> str:
    whole = "least(greatest(floor(1024 * x::DOUBLE), -134217728), 134217728)::BIGINT"
    steps = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: {whole}) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256(concat('{SEED}:', vec_id)), vec_id NULLS FIRST, v) - 1)::INTEGER AS k, v AS c FROM v ORDER BY k LIMIT {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT rid, vec_id, v, k, d FROM (SELECT v.*, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i})
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT k, list(m ORDER BY p) AS c FROM (SELECT k, p, ((s - ((s % n) + n) % n) // n)::BIGINT AS m
  FROM (SELECT k, p, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY k, p)) GROUP BY k) n USING (k))"""
            )
    return (
        ",\n".join(steps)
        + f"""
SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(list_aggregate(c, 'string_agg', ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)"""
    )


SQL = _sql()
