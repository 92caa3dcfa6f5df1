"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The upper tree is fitted in numpy on a bounded sample (SAMPLE vectors, drawn by hash); every vector is then sent down to a cell, a leaf of it. A cell that
holds far more than LEAF_ROWS vectors gets a tree of its own, fitted where its rows are on some SUB_SAMPLE of them, so the leaves are as many as the vectors
need, though no tree has more than CELLS or SUB_LEAVES of them: up to a thousand million vectors a leaf holds about LEAF_ROWS. A query walks
a tree with a priority queue: the nearest bin that is still closed is opened next, and leaves are visited in the order in which they come up, first of cells, then within each cell.
Trees of cells are no driver's business: they are a table, and come to each task before the rows of their cell.

How many cells, and leaves of a cell: CALIBRATION queries are compared with every vector, which tells the leaf of each true neighbour, so
the recall of any number of visits is known from the place of these leaves in the query's order. Visits are widened from one on until that recall
reaches the target. A query whose leaves hold fewer than k rows besides its own goes on in its order until they do.

A leaf that holds more than BLOCK_ROWS (copies of one vector can't be told apart by any tree) is dealt over
blocks, row by row, and queries of a leaf over groups, so no task holds more than a block of vectors and a group of queries. Each gives its 10 nearest, and these
are ranked by query.

Distances are Euclidean, in double precision, on the original vectors; ties go to the smaller id.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id; a query's candidates are the
vectors of its own length, which have an index for each length; repeated rows are candidates of their own, but no row
of the query's own id is; a query id that repeats is asked once, with the vector of its rows that sorts first; fewer candidates than k are all returned; without vectors there are no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import bounded_sample, checkpointed, table

SAMPLE, BRANCHES, LEAF_ROWS, CELLS = 32_768, 16, 1024, 4096
#: A cell with over SPLIT leaves' rows gets a tree of SUB_LEAVES at most, from SUB_SAMPLE rows or so. Rows of a cell that go to one task.
SPLIT, SUB_LEAVES, SUB_SAMPLE, PART_ROWS = 4, 256, 4096, 1 << 16
CALIBRATION, TARGET, BLOCK_ROWS, GROUP_QUERIES = 64, 0.97, 4096, 2048


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2.0 * (x @ centres.T), axis=1)


class Tree:
    """nodes: (centres, children); a child is a node's number, or ~leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.nodes, self.leaves, rng = [], 0, np.random.default_rng(seed)

        def grow(x, want):
            k = min(BRANCHES, want, len(x))
            if k < 2:
                self.leaves += 1
                return ~(self.leaves - 1)
            centres = kmeans(x, k, rng)
            at = nearest(x, centres)
            if np.bincount(at).max() == len(x):  # copies of one vector
                self.leaves += 1
                return ~(self.leaves - 1)
            me = len(self.nodes)
            self.nodes.append(None)
            children = [grow(x[at == j], round(want * float((at == j).mean()))) for j in range(k)]
            self.nodes[me] = (centres, children)
            return me

        self.root = grow(sample, max(1, leaves))

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                centres, children = self.nodes[node]
                at = nearest(x[rows], centres)
                todo += [(c, rows[at == j]) for j, c in enumerate(children)]
        return out

    def order(self, q: np.ndarray, visits: int, sizes: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """The first leaves of the best-bin-first walk: so many, and on until they hold so many rows (sizes: the rows of each leaf)."""
        out, queue, n, held = [], [(0.0, 0, self.root)], 0, 0
        while queue and (len(out) < visits or held < rows):
            _, _, node = heapq.heappop(queue)
            if node < 0:
                out.append(~node)
                held += int(sizes[~node]) if sizes is not None else 0
                continue
            centres, children = self.nodes[node]
            d = ((centres - q) ** 2).sum(1)
            for j, c in enumerate(children):
                n += 1
                heapq.heappush(queue, (float(d[j]), n, c))
        return out


def stacked(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def k_nearest(q: np.ndarray, q_id: int, x: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest: exact ones for all that the rough squared distances can't rule out."""
    other = np.flatnonzero(ids != q_id)
    if len(other) > k:
        r = rough[other]
        other = other[r <= np.partition(r, k - 1)[k - 1] + 1e-6 * (1.0 + float(np.abs(r).max()))]
    d = distances(q, x[other])
    best = np.lexsort((ids[other], d))[:k]
    return ids[other][best], d[best]


def usable_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """__id, __v (array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("__id"), v.alias("__v")).where(F.col("__id").isNotNull() & F.col("__v").isNotNull() & (F.size("__v") > 0))
    finite = F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite).where(F.exists("__v", lambda x: x != 0))


RESULT = "query_id long, rank int, vec_id long, score double"


def k_nearest_neighbours(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: from the id column to a condition. options: see search_among."""
    vectors = usable_vectors(rows, id_col, vec_col)
    asked = vectors.where(is_query(F.col("__id"))).groupBy("__id").agg(F.min("__v").alias("__v"))
    lengths = [r["d"] for r in asked.groupBy(F.size("__v").alias("d")).count().orderBy("d").collect()]
    found = [search_among(vectors.where(F.size("__v") == d), asked.where(F.size("__v") == d), k, **options) for d in lengths]
    return reduce(DataFrame.union, found) if found else rows.sparkSession.createDataFrame([], RESULT)


def counts_of(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """The rows of each of n numbers: as many rows as the trees have leaves."""
    sizes = np.zeros(n, dtype=np.int64)
    for r in rows.groupBy(column).count().collect():
        sizes[r[column]] = r["count"]
    return sizes


def widened(depth: np.ndarray, least: int, most: int, target: float) -> int:
    """The number of visits, from least on, within which so large a part of the depths lies."""
    visits = least
    while visits < most and len(depth) and (depth <= visits).mean() < target:
        visits += max(1, visits // 8)
    return min(visits, most)


def trees_of_cells(placed: DataFrame, sizes: np.ndarray, leaf_rows: int, sub_sample: int) -> DataFrame:
    """cell, tree (pickled), leaves of every crowded cell. A tree is fitted on a share of the cell's rows that is sub_sample rows, more or less."""
    want = np.where(sizes > SPLIT * leaf_rows, np.minimum(SUB_LEAVES, -(-sizes // leaf_rows)), 0)
    share = np.where(want > 0, np.minimum(1.0, sub_sample / np.maximum(sizes, 1)), 0.0)

    def draw(batches):
        rng = np.random.default_rng([7, TaskContext.get().partitionId()])  # placed is written, so a task that runs again draws the same
        for batch in batches:
            cell = batch.column(2).to_numpy()
            yield batch.filter(pa.array(rng.random(len(cell)) < share[cell]))

    def fit(rows: pa.Table) -> pa.Table:
        cell = rows.column("cell")[0].as_py()
        x = stacked(rows.column("__v"))
        tree = Tree(x[np.lexsort(x.T)], int(min(want[cell], max(1, len(x) // 8))))
        return pa.table({"cell": pa.array([cell], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "leaves": pa.array([tree.leaves], pa.int32())})

    return checkpointed(placed.mapInArrow(draw, "__id long, __v array<double>, cell int").groupBy("cell").applyInArrow(fit, "cell int, tree binary, leaves int"))


def beside_trees(rows: DataFrame, trees: DataFrame, parts: np.ndarray, use, schema: str) -> DataFrame:
    """use(tree or None, cell, batch of rows) for the rows (cell, part, __id, __v, own) of each cell, each cell dealt over so many parts."""

    def run(batches):
        at, tree = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part = (batch.column(k).to_numpy() for k in (0, 1))
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(cell)]
            for start, end in zip(cuts, cuts[1:]):
                if (cell[start], part[start]) != at:
                    at, tree = (cell[start], part[start]), None
                if batch.column(2)[start].is_valid:  # a cell's tree comes before its rows
                    tree, start = pickle.loads(batch.column(2)[start].as_py()), start + 1
                if start < end:
                    yield from use(tree, int(at[0]), batch.slice(start, end - start))

    def copies(batches):
        for batch in batches:
            for cell, tree in zip(batch.column(0).to_pylist(), batch.column(1)):
                for at in range(int(parts[cell])):
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([at], pa.int32()), pa.array([tree.as_py()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.float64())), pa.nulls(1, pa.int64())], names=["cell", "part", "tree", "__id", "__v", "own"])

    first = trees.select("cell", "tree").mapInArrow(copies, "cell int, part int, tree binary, __id long, __v array<double>, own long")
    both = first.union(rows.select("cell", "part", F.lit(None).cast("binary").alias("tree"), "__id", "__v", "own"))
    return both.repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("tree").isNull()).mapInArrow(run, schema)


def search_among(vectors: DataFrame, queries: DataFrame, k: int, target: float = TARGET, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, min_visits: int = 1, cells: int = CELLS, sub_sample: int = SUB_SAMPLE) -> DataFrame:
    """The k nearest of vectors (__id, __v; of one length) to each of queries (__id, __v; distinct ids)."""
    result = "query_id long, vec_id long, score double"
    n, n_queries = vectors.count(), queries.count()
    drawn = stacked(bounded_sample(vectors, n, sample, F.xxhash64("__id", F.lit(3))).select("__v").toArrow().column(0))
    upper = Tree(drawn, min(cells, max(1, len(drawn) // 8), -(-n // leaf_rows)))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upper.assign(stacked(batch.column(1))))], names=["__id", "__v", "cell"])

    placed = checkpointed(vectors.mapInArrow(place, "__id long, __v array<double>, cell int"))
    cell_sizes = counts_of(placed, "cell", upper.leaves)
    crowded = cell_sizes > SPLIT * leaf_rows
    parts = np.maximum(1, -(-cell_sizes // PART_ROWS))
    trees = trees_of_cells(placed, cell_sizes, leaf_rows, sub_sample) if crowded.any() else None
    leaves_of = np.ones(upper.leaves, dtype=np.int64)
    for r in trees.select("cell", "leaves").collect() if trees is not None else ():  # CELLS at most
        leaves_of[r["cell"]] = r["leaves"]
    first = np.concatenate([[0], np.cumsum(leaves_of)])  # of each cell's leaves

    def of_quiet_cells(batches):
        for batch in batches:
            cell = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(first[cell].astype(np.int32))], names=["__id", "__v", "leaf"]).filter(pa.array(~crowded[cell]))

    def of_crowded_cells(batches):
        n_seen = 0
        for batch in batches:
            cell = batch.column(2).to_numpy()
            part = ((n_seen + np.arange(len(cell))) % parts[cell]).astype(np.int32)
            n_seen += len(cell)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(part), *batch.columns[:2], pa.nulls(len(cell), pa.int64())], names=["cell", "part", "__id", "__v", "own"]).filter(pa.array(crowded[cell]))

    def down(tree, cell, rows):
        at = tree.assign(stacked(rows.column(4))) if tree is not None else np.zeros(rows.num_rows, np.int32)
        yield pa.RecordBatch.from_arrays([rows.column(3), rows.column(4), pa.array((first[cell] + at).astype(np.int32))], names=["__id", "__v", "leaf"])

    in_leaves = "__id long, __v array<double>, leaf int"
    in_parts = "cell int, part int, __id long, __v array<double>, own long"
    leafed = placed.mapInArrow(of_quiet_cells, in_leaves)
    if trees is not None:
        leafed = checkpointed(leafed.union(beside_trees(placed.mapInArrow(of_crowded_cells, in_parts), trees, parts, down, in_leaves)))
    sizes = counts_of(leafed, "leaf", int(first[-1]))

    trial = bounded_sample(queries, n_queries, CALIBRATION, F.xxhash64("__id", F.lit(5))).toArrow()
    trial_ids, trial_v = trial.column(0).to_numpy(), stacked(trial.column(1))

    def exact(batches):
        best = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32))] * len(trial_ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, leaf = batch.column(0).to_numpy(), stacked(batch.column(1)), batch.column(2).to_numpy()
            norms, by_id = (x * x).sum(1), np.argsort(ids, kind="stable")
            for i, q in enumerate(trial_v):
                got, d = k_nearest(q, trial_ids[i], x, ids, norms - 2.0 * (x @ q), k)
                of = leaf[by_id[np.searchsorted(ids, got, sorter=by_id)]]
                all_ = tuple(np.concatenate(x) for x in zip(best[i], (got, d, of)))
                keep = np.lexsort((all_[0], all_[1]))[:k]
                best[i] = tuple(x[keep] for x in all_)
        for i, (ids, d, leaf) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids), pa.array(d), pa.array(leaf)], names=["q", "id", "d", "leaf"])

    truth = leafed.mapInArrow(exact, "q int, id long, d double, leaf int")
    truth = truth.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("r") <= k).select("q", "leaf").collect()
    truth = [(r["q"], int(np.searchsorted(first, r["leaf"], side="right")) - 1, r["leaf"]) for r in truth]  # CALIBRATION * k at most
    orders = [{cell: i for i, cell in enumerate(upper.order(q, upper.leaves), 1)} for q in trial_v]
    each = target if trees is None else 1 - (1 - target) / 2
    visits = widened(np.array([orders[q][cell] for q, cell, _ in truth]), min_visits, upper.leaves, each)
    sub_visits = 1
    if trees is not None:
        met = sorted({cell for _, cell, _ in truth if crowded[cell]})
        own_trees = {r["cell"]: pickle.loads(r["tree"]) for r in trees.where(F.col("cell").isin(met)).collect()} if met else {}  # CALIBRATION * k at most
        depth = [own_trees[cell].order(trial_v[q], own_trees[cell].leaves).index(leaf - first[cell]) + 1 for q, cell, leaf in truth if cell in own_trees]
        sub_visits = widened(np.array(depth), min_visits, int(leaves_of.max()), each)

    blocks = np.maximum(1, -(-sizes // BLOCK_ROWS))
    groups = int(max(1, -(-n_queries * visits * sub_visits // (int(first[-1]) * GROUP_QUERIES))))

    def route(batches):
        for batch in batches:
            ids, q, own = batch.column(0).to_numpy(), stacked(batch.column(1)) if batch.num_rows else [], batch.column(2).to_numpy()
            for i in range(batch.num_rows):
                cell = np.array([c for c in upper.order(q[i], visits, cell_sizes, k + int(own[i])) if cell_sizes[c]], dtype=np.int32)
                m = len(cell)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array((int(ids[i]) % parts[cell]).astype(np.int32)), pa.array(np.full(m, ids[i])), batch.column(1).take(pa.array([i] * m, pa.int32())), pa.array(np.full(m, own[i]))], names=["cell", "part", "__id", "__v", "own"])

    def visited(tree, cell, rows):
        ids, q, own = rows.column(3).to_numpy(), stacked(rows.column(4)), rows.column(5).to_numpy()
        of = sizes[first[cell] : first[cell + 1]]
        for i in range(rows.num_rows):
            leaves = tree.order(q[i], sub_visits, of, k + int(own[i])) if tree is not None else [0]
            keys = [(int(first[cell]) + leaf, b) for leaf in leaves for b in range(blocks[first[cell] + leaf]) if of[leaf]]
            m = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, ids[i])), rows.column(4).take(pa.array([i] * m, pa.int32())), pa.array([x for x, _ in keys], pa.int32()), pa.array([b for _, b in keys], pa.int32()), pa.array(np.full(m, int(ids[i]) * 0x9E3779B1 >> 12 & 0xFFFFF) % groups, pa.int32())], names=["__id", "__v", "leaf", "block", "group"])

    def visited_alone(batches):
        for batch in batches:
            cell = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield from visited(None, int(cell[i]), pa.RecordBatch.from_arrays([*row.columns[:2], pa.nulls(1, pa.binary()), *row.columns[2:]], names=["cell", "part", "tree", "__id", "__v", "own"]))

    def deal(batches):
        n_seen = 0
        for batch in batches:
            leaf = batch.column(2).to_numpy()
            block = ((n_seen + np.arange(len(leaf))) % blocks[leaf]).astype(np.int32)  # row by row: equal ids may fill a leaf
            n_seen += len(leaf)
            for g in range(groups):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(np.full(len(leaf), g, np.int32))], names=["__id", "__v", "leaf", "block", "group"])

    keyed = "__id long, __v array<double>, leaf int, block int, group int"

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            q_ids, q, ids, x = asked.column("__id").to_numpy(), stacked(asked.column("__v")), held.column("__id").to_numpy(), stacked(held.column("__v"))
            norms = (x * x).sum(1)
            for at in range(0, len(q), 256):
                rough = norms - 2.0 * (q[at : at + 256] @ x.T)
                for i, r in enumerate(rough, at):
                    got, d = k_nearest(q[i], q_ids[i], x, ids, r, k)
                    out.append((np.full(len(got), q_ids[i]), got, d))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    key = ["leaf", "block", "group"]
    own = vectors.join(queries.select("__id"), "__id").groupBy("__id").agg(F.count(F.lit(1)).alias("own"))  # no candidates for their query
    routed = queries.join(own, "__id").select("__id", "__v", "own").mapInArrow(route, in_parts)
    asked = routed.mapInArrow(visited_alone, keyed) if trees is None else beside_trees(routed, trees, parts, visited, keyed)
    held = leafed.mapInArrow(deal, keyed)
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(search, result)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark, sf_dir):
    return k_nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda c: c % 100 == 0)
