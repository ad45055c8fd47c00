"""Nearest neighbours by largest inner product: a hierarchical k-means tree, best bin first."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Children of a node, rounds of k-means, rows of the sample below which a node is a leaf; a
#: sample of any size gives about LEAVES leaves, so a query visits as many in every table.
BRANCHES, ROUNDS, LEAF_ROWS, LEAVES = 8, 8, 32, 64
#: Vectors and queries that meet in one task group at most, roughly.
GROUP_VECTORS, GROUP_QUERIES = 20_000, 4_000
SEED = 7


@dataclass
class Tree:
    """``centres[i]`` are the children of node i, ``below[i]`` their nodes (>= 0) or leaves (-1 - leaf).

    Vectors get one more coordinate, sqrt(norm^2 - |x|^2), queries a 0, so that distance falls
    as the inner product grows.  ``visits`` leaves are searched per query.
    """

    norm: float
    centres: list
    below: list[list[int]]
    leaves: int
    visits: int


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct (vec_id, v as doubles) without null ids and null, empty, zero or non-finite vectors."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).distinct()


def lifted(x, norm: float):
    import numpy as np

    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0.0))])


def distances(x, centres):
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def k_means(x, k: int, rng):
    """Centres of at most k clusters and each row's cluster; fewer if rows coincide."""
    import numpy as np

    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = distances(x, centres).argmin(axis=1)
        used = np.unique(near)
        centres = np.stack([x[near == c].mean(axis=0) for c in used])
    return centres, distances(x, centres).argmin(axis=1)


def grow(sample) -> Tree:
    """The tree of a sample, depth first, without recursion."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    norm = float(np.sqrt((sample * sample).sum(axis=1)).max())
    x = lifted(sample, norm)
    tree = Tree(norm, [], [], 0, 1)
    waiting = [(None, 0, np.arange(len(x)))]
    leaf_rows = max(LEAF_ROWS, 2 * len(x) // LEAVES)
    while waiting:
        parent, child, rows = waiting.pop()
        centres, near = k_means(x[rows], BRANCHES, rng) if len(rows) > leaf_rows or parent is None else (None, None)
        if centres is None or (len(centres) == 1 and parent is not None):
            tree.below[parent][child] = -1 - tree.leaves
            tree.leaves += 1
            continue
        node = len(tree.centres)
        if parent is not None:
            tree.below[parent][child] = node
        tree.centres.append(centres)
        tree.below.append([0] * len(centres))
        waiting += [(node, c, rows[near == c]) for c in range(len(centres))]
    return tree


def leaf_of(tree: Tree, x):
    """The leaf at the end of each vector's way down to the nearest child."""
    import numpy as np

    x = lifted(x, tree.norm)
    leaf = np.zeros(len(x), np.int64)
    waiting = [(0, np.arange(len(x)))] if len(x) else []
    while waiting:
        node, rows = waiting.pop()
        near = distances(x[rows], tree.centres[node]).argmin(axis=1)
        for c in np.unique(near):
            below = tree.below[node][c]
            if below < 0:
                leaf[rows[near == c]] = -1 - below
            else:
                waiting.append((below, rows[near == c]))
    return leaf


def best_bins(tree: Tree, query, sizes: dict[int, int], enough: int):
    """Leaves in best-bin-first order: at least ``visits``, and until ``enough`` vectors lie in them."""
    import numpy as np

    q = np.append(query, 0.0)[None, :]
    waiting = [(0.0, 0)]
    visited, held = 0, 0
    while waiting and (visited < tree.visits or held < enough):
        _, node = heapq.heappop(waiting)
        if node < 0:
            visited += 1
            held += sizes.get(-1 - node, 0)
            yield -1 - node
        else:
            for d, below in zip(distances(q, tree.centres[node])[0], tree.below[node]):
                heapq.heappush(waiting, (float(d), below))


def calibrate(tree: Tree, sample, k: int, recall: float, queries: int = 200) -> float:
    """Widens ``tree.visits`` until the sample's own queries find ``recall`` of their neighbours."""
    import numpy as np

    leaf = leaf_of(tree, sample)
    asked = np.random.default_rng(SEED).choice(len(sample), min(queries, len(sample)), replace=False)
    tree.visits, places = tree.leaves, []
    for q in asked:
        score = sample @ sample[q]
        score[q] = -np.inf
        true = np.argsort(-score)[: min(k, len(sample) - 1)]
        place = {b: i + 1 for i, b in enumerate(best_bins(tree, sample[q], {}, 0))}
        places += [place[b] for b in leaf[true]]
    places = np.sort(places) if places else np.array([1])
    tree.visits = int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))])
    return float((places <= tree.visits).mean())


def fit(rows: DataFrame, k: int, recall: float = 0.97, sample_rows: int = 20_000) -> Tree | None:
    """A tree fitted on the driver to about ``sample_rows`` vectors, chosen by a hash of their id."""
    import numpy as np

    n = rows.count()
    if not n:
        return None
    share = int(min(1.0, sample_rows / n) * (1 << 30))
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("tree")), F.lit(1 << 30)) < share).select("v").limit(2 * sample_rows)
    sample = np.array([r["v"] for r in chosen.collect()]) if share else np.zeros((0, 0))
    if not len(sample):
        sample = np.array([rows.select("v").first()["v"]])
    sample = sample[np.lexsort(sample.T)]
    tree = grow(sample)
    calibrate(tree, sample, k, recall)
    return tree


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97, id_col: str = "vec_id",
           vector_col: str = "embedding", sample_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other vectors among those found.

    Every vector is indexed and every query searched; scores are inner products in double
    precision.  Ties go to the smaller id.  A query with fewer than k candidates gets all.  A
    vec_id names a vector: a query never finds a row of its own id, repeated rows count once.  Null
    ids and null, empty, zero or non-finite vectors take no part; all vectors have one length.

    Equal vectors are searched as one, with their k + 1 smallest ids, and equal queries are asked
    once.  A (leaf, query) block beyond GROUP_VECTORS x GROUP_QUERIES is cut into a grid of groups, so
    no task holds a whole leaf.
    """
    import numpy as np

    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = saved(usable(vectors, id_col, vector_col), "vectors")
    asked = usable(queries, id_col, vector_col)
    tree = fit(rows, k, recall, sample_rows)
    if tree is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    first = Window.partitionBy("v").orderBy("vec_id")
    equal = rows.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= k + 1)
    equal = equal.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                leaf = leaf_of(tree, np.array(batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["v", "ids", "leaf"])

    data = saved(equal.mapInArrow(place, f"v array<double>, ids array<{kind}>, leaf bigint"), "leaves")
    sizes = {r["leaf"]: (r["n"], r["held"]) for r in data.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("held")).collect()}
    held = {leaf: s[1] for leaf, s in sizes.items()}

    def visit(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                bins = [list(best_bins(tree, np.array(q), held, k + 1)) for q in part.column(0).to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(bins)), [len(b) for b in bins]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), pa.array(np.concatenate(bins).astype(np.int64))], names=["v", "query", "leaf"])

    once = asked.groupBy("v").agg(F.min("vec_id").alias("query"))
    visits = saved(once.mapInArrow(visit, f"v array<double>, query {kind}, leaf bigint"), "visits")
    wanted = {r["leaf"]: r["n"] for r in visits.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    grid = [(leaf, -(-n // GROUP_VECTORS), -(-wanted.get(leaf, 0) // GROUP_QUERIES)) for leaf, (n, _) in sizes.items() if leaf in wanted]
    grid = spark.createDataFrame(grid, "leaf bigint, data_parts bigint, query_parts bigint")  # one line per leaf of the tree

    def dealt(side, own, other, key):
        side = side.join(grid, "leaf").withColumn("mine", F.pmod(F.xxhash64(key), F.col(own)))
        side = side.withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return side.withColumnRenamed("mine", own[0]).withColumnRenamed("theirs", other[0]).drop("data_parts", "query_parts")

    left = dealt(data, "data_parts", "query_parts", "v").select("leaf", "d", "q", "v", "ids")
    right = dealt(visits, "query_parts", "data_parts", "query").select("leaf", "d", "q", "v", "query")

    def nearest(vectors_table, queries_table):
        import pyarrow as pa

        names = pa.schema([("query", queries_table.schema.field("query").type), ("vec_id", queries_table.schema.field("query").type), ("score", pa.float64())])
        if not vectors_table.num_rows or not queries_table.num_rows:
            return names.empty_table()
        x, q = (np.array(t.column("v").to_pylist()) for t in (vectors_table, queries_table))
        ids = vectors_table.column("ids").to_pylist()
        out = []
        for lo in range(0, len(q), 256):
            scores = q[lo : lo + 256] @ x.T
            for query, row in zip(queries_table.column("query").slice(lo, 256).to_pylist(), scores):
                top = np.arange(len(row))
                if len(row) > k + 1:
                    top = np.flatnonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1])
                found = sorted((-row[t], i) for t in top for i in ids[t])[: k + 1]
                out += [(query, i, -s) for s, i in found]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), names.types)], schema=names)

    found = left.groupBy("leaf", "d", "q").cogroup(right.groupBy("leaf", "d", "q")).applyInArrow(nearest, f"query {kind}, vec_id {kind}, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = saved(found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at"), "found")
    # every query takes the list of the one that was asked for its vector
    names = asked.join(once.select("v", "query"), "v").select("query", F.col("vec_id").alias("query_id"))
    rows = names.join(found, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
