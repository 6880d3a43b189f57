"""Exact search for the vectors with the largest inner products, by cover trees of queries and data.

Components become integers, floor(256 * x), so that scores are exact. A cover tree of a bounded sample cuts the space into cells; every vector
goes to the cell with the nearest centre, and large cells are dealt into blocks by a hash, so that equal vectors fill several
tasks. A block is indexed by a cover tree of its own: levels of centres that are further apart than a radius that halves from level to
level, and nodes that know how far their vectors reach. Queries of a block form groups with such a tree as well.

A pair of nodes with centres c, d and reaches r, s holds no inner product above ``<c, d> + r |d| + s |c| + r s``. It is
pruned when that is below the worst k-th score of the queries in its query node. Groups first search their own block, which gives
k-th scores; with these they are held against the tree of cells, then against the trees of the blocks in the cells that are left. Nothing
is left out by a limit: what is not pruned is compared.

Defined cases: vectors that are null, or hold null or non-finite components (256-fold) take no part; only vectors of one length have an inner product,
empty ones have 0; equal rows are one row; a row is never found by a query with its id; rows with one id and different vectors are told apart
(each is a query); a row without an id is found, with a null ``vec_id`` after all others, but is no query; scores beyond 64
bits are the nearest number of 64 bits; a query without candidates gives no row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tunelake.session import cut_lineage

NEIGHBOURS, EVERY, SCALE = 5, 50, 256
#: Vectors of a block and queries of a group; vectors (and their bytes) that the tree of cells is built from, and cells.
BLOCK, GROUP = 2048, 64
SAMPLE, SAMPLE_BYTES, CELLS = 8192, 1 << 23, 1024
#: Centres of the tree of a block, and of a group of queries.
BLOCK_NODES, GROUP_NODES = 128, 8
_NO_ID = np.iinfo(np.int64).max
_EXACT, _LONG = 1 << 53, (1 << 63) - 1


def quantised(vector: F.Column) -> F.Column:
    """Components as whole numbers, packed as doubles; null where a vector takes no part."""

    @F.pandas_udf(BinaryType())
    def pack(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            numbers = None if value is None else np.array([np.nan if x is None else x for x in value] if value.dtype == object else value, dtype=np.float64)
            if numbers is not None:
                with np.errstate(over="ignore", invalid="ignore"):
                    numbers = np.floor(SCALE * numbers)
            out.append(numbers.tobytes() if numbers is not None and np.isfinite(numbers).all() else None)
        return pd.Series(out, dtype=object)

    return pack(vector)


def _matrix(packed: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), dims)


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of every point from the one centre, or from its own."""
    with np.errstate(over="ignore"):
        difference = points - centres
        return np.sqrt(np.einsum("ij,ij->i", difference, difference))


class CoverTree:
    """Levels of centres, each level holding those before it; the last level's nodes hold the points.

    Centres are taken farthest first. Those further than the level's radius from all before them belong to the
    level, and a centre's parent is the nearest centre of the level above. ``order`` lists the points by node.
    """

    def __init__(self, points: np.ndarray, most: int):
        count = len(points)
        nearest, owner = np.full(count, np.inf), np.zeros(count, dtype=np.int64)
        chosen, apart = [], []
        at = 0
        while len(chosen) < min(most, count):
            apart.append(nearest[at])
            distance = _distances(points, points[at])
            closer = distance < nearest
            nearest[closer], owner[closer] = distance[closer], len(chosen)
            chosen.append(at)
            at = int(nearest.argmax())
            if nearest[at] == 0:
                break
        self.centres = points[chosen]
        # Sizes of the levels: radii halve until the last centre is in.
        self.sizes, radius = [1], apart[1] if len(apart) > 1 else 0.0
        while self.sizes[-1] < len(chosen):
            radius /= 2
            size = max(self.sizes[-1] + 1, int(np.searchsorted(-np.array(apart), -radius, "left")))
            self.sizes.append(min(size, len(chosen)))
        self.order = np.argsort(owner, kind="stable")
        self.ends = np.cumsum(np.bincount(owner, minlength=len(chosen)))
        self.starts = np.r_[0, self.ends[:-1]]
        self.owner = owner
        # Parents, and how far the points under a node reach from its centre, from the last level up.
        self.parents, self.reach = [None] * len(self.sizes), [None] * len(self.sizes)
        under = owner
        for level in reversed(range(len(self.sizes))):
            size = self.sizes[level]
            far = np.zeros(size)
            np.maximum.at(far, under, _distances(points, self.centres[under]))
            self.reach[level] = far
            if level:
                above = self.centres[: self.sizes[level - 1]]
                parent = np.array([int(_distances(above, centre).argmin()) for centre in self.centres[:size]])
                self.parents[level] = parent
                under = parent[under]
        self.norms = _distances(self.centres, np.zeros(points.shape[1]))


def _bounds(queries: CoverTree, level: int, data: CoverTree, data_level: int, columns: np.ndarray) -> np.ndarray:
    """No inner product of a query node (row) with a data node (column) is above this."""
    size = queries.sizes[level]
    centre, reach, norm = queries.centres[:size], queries.reach[level][:, None], queries.norms[:size][:, None]
    far, length = data.reach[data_level][columns][None, :], data.norms[columns][None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        exact = centre @ data.centres[columns].T
        return exact + reach * length + far * norm + reach * far + 1e-9 * (norm + reach) * (length + far) + 1e-6


def _worst(queries: CoverTree, level: int, kth: np.ndarray) -> np.ndarray:
    """The worst k-th score under every query node of a level."""
    under = queries.owner
    for deeper in range(len(queries.sizes) - 1, level, -1):
        under = queries.parents[deeper][under]
    out = np.full(queries.sizes[level], np.inf)
    np.minimum.at(out, under, kth)
    return out


def surviving(queries: CoverTree, data: CoverTree, kth: np.ndarray) -> np.ndarray:
    """Leaf nodes of both trees that may hold what the queries still want: a matrix of booleans.

    Both trees are descended a level at a time; a pair of nodes is looked at only if their parents are left.
    """
    level = data_level = 0
    columns, alive = np.zeros(1, dtype=np.int64), np.ones((1, 1), dtype=bool)
    while True:
        # What is too large for a double is no number and stays.
        alive = alive & ~(_bounds(queries, level, data, data_level, columns) < _worst(queries, level, kth)[:, None])
        left = alive.any(axis=0)
        columns, alive = columns[left], alive[:, left]
        down, data_down = level + 1 < len(queries.sizes), data_level + 1 < len(data.sizes)
        if not len(columns) or not (down or data_down):
            break
        if down:
            level += 1
            alive = alive[queries.parents[level]]
        if data_down:
            data_level += 1
            where = np.full(data.sizes[data_level - 1], -1)
            where[columns] = np.arange(len(columns))
            parent = where[data.parents[data_level]]
            columns = np.flatnonzero(parent >= 0)
            alive = alive[:, parent[columns]]
    out = np.zeros((queries.sizes[-1], data.sizes[-1]), dtype=bool)
    if len(columns):
        out[:, columns] = alive
    return out


def _products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums are whole numbers they can hold, else in whole numbers, cut to 64 bits."""
    with np.errstate(over="ignore"):
        if np.abs(queries).sum(axis=1).max(initial=0) * np.abs(points).max(initial=0) < _EXACT:
            return queries @ points.T
    whole = [[int(x) for x in row] for row in points.tolist()]
    exact = [[sum(int(a) * b for a, b in zip(query, row)) for row in whole] for query in queries.tolist()]
    return np.array([[max(-_LONG - 1, min(_LONG, score)) for score in row] for row in exact], dtype=object)


class Block:
    """Vectors of a task with their tree."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.tree = CoverTree(points, BLOCK_NODES)
        self.ids, self.points = ids[self.tree.order], points[self.tree.order]

    def search(self, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list]]:
        """Query number, ids and scores of at most ``k`` vectors that are not below the query's k-th score."""
        tree = CoverTree(queries, GROUP_NODES)
        kth = kth.copy()
        best: list[tuple[np.ndarray, list]] = [(np.zeros(0, dtype=np.int64), []) for _ in ids]
        nodes = np.repeat(np.arange(self.tree.sizes[-1]), self.tree.ends - self.tree.starts)
        # The most promising leaf of every query leaf is searched first: better k-th scores prune more of the others.
        bounds = _bounds(tree, len(tree.sizes) - 1, self.tree, len(self.tree.sizes) - 1, np.arange(self.tree.sizes[-1]))
        first = np.zeros_like(bounds, dtype=bool)
        first[np.arange(len(bounds)), bounds.argmax(axis=1)] = True
        for turn in range(2):
            left = surviving(tree, self.tree, kth)
            left &= first if turn == 0 else ~first
            for leaf in np.flatnonzero(left.any(axis=1)):
                members = tree.order[tree.starts[leaf] : tree.ends[leaf]]
                chosen = np.flatnonzero(left[leaf][nodes])
                scores = _products(queries[members], self.points[chosen])
                for row, query in enumerate(members):
                    good = np.flatnonzero((scores[row] >= kth[query]) & (self.ids[chosen] != ids[query]))
                    found, values = self.ids[chosen[good]], scores[row][good]
                    if len(good) > k and values.dtype != object:
                        close = values >= np.partition(values, len(values) - k)[len(values) - k]
                        found, values = found[close], values[close]
                    old = best[query]
                    rows = sorted(zip([*values.tolist(), *old[1]], [*found.tolist(), *old[0].tolist()]), key=lambda pair: (-pair[0], pair[1]))[:k]
                    best[query] = (np.array([name for _, name in rows], dtype=np.int64), [score for score, _ in rows])
                    if len(rows) == k and abs(rows[-1][0]) < _EXACT:
                        kth[query] = max(kth[query], rows[-1][0])
        for query, (found, scores) in enumerate(best):
            if len(found):
                yield query, found, scores


def _groups(batches: Iterator[pd.DataFrame], keys: list[str], most: int) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows with equal keys, cut after ``most``; the rows come sorted."""
    held: list[pd.DataFrame] = []
    key, size = None, 0
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        cuts = [*np.flatnonzero(change).tolist(), len(batch)]
        for low, high in zip(cuts, cuts[1:]):
            mine = tuple(int(batch[name].iat[low]) for name in keys)
            if held and mine != key:
                yield key, pd.concat(held, ignore_index=True)
                held, size = [], 0
            key = mine
            while low < high:
                part = batch.iloc[low : min(high, low + most - size)]
                held.append(part)
                size, low = size + len(part), low + len(part)
                if size == most:
                    yield key, pd.concat(held, ignore_index=True)
                    held, size = [], 0
    if held:
        yield key, pd.concat(held, ignore_index=True)


_FOUND = "query_id long, mark long, vec_id long, score long"


def _searched(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Every query against the block it is sent to: up to ``k`` rows of each. A task holds one block and one group of queries."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, parts, block = None, [], None
        for (dims, cell, number, kind), part in _groups(batches, ["dims", "cell", "block", "kind"], GROUP):
            if place != (dims, cell, number):
                place, parts, block = (dims, cell, number), [], None
            if kind == 0:
                parts.append((part["vec_id"].to_numpy(), _matrix(part["v"], dims)))
                continue
            if not parts:
                continue
            if block is None:
                block = Block(np.concatenate([ids for ids, _ in parts]), np.concatenate([points for _, points in parts]))
            ids, marks = part["vec_id"].to_numpy(), part["mark"].to_numpy()
            found = list(block.search(ids, _matrix(part["v"], dims), part["kth"].to_numpy(), k))
            if found:
                counts = [len(scores) for _, _, scores in found]
                rows = np.repeat([query for query, _, _ in found], counts)
                scores = [int(score) for _, _, values in found for score in values]
                yield pd.DataFrame({"query_id": ids[rows], "mark": marks[rows], "vec_id": np.concatenate([names for _, names, _ in found]), "score": np.array(scores, dtype=np.int64)})

    named = ["dims", "cell", "block", "kind", "vec_id", "mark", "kth", "v"]
    both = data.withColumn("kind", F.lit(0)).withColumn("kth", F.lit(0.0)).select(named).unionByName(queries.withColumn("kind", F.lit(1)).select(named))
    dealt = both.repartition("dims", "cell", "block").sortWithinPartitions("dims", "cell", "block", "kind", "vec_id")
    return dealt.mapInPandas(search, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Cells:
    """The tree of cells, from a sample: every vector length that the sample holds has its own."""

    def __init__(self, sample: pd.DataFrame, total: int):
        self.trees: dict[int, CoverTree] = {}
        for dims, part in sample.groupby("dims"):
            share = max(1, min(CELLS, math.ceil(total * len(part) / len(sample) / (BLOCK / 2))))
            self.trees[int(dims)] = CoverTree(_matrix(part["v"], int(dims)), share)

    def place(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the cell of every vector and its distance from the centre; cell 0 takes lengths that no tree is for."""
        trees = {dims: tree.centres for dims, tree in self.trees.items()}

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dims, part in batch.groupby("dims"):
                    points = _matrix(part["v"], int(dims))
                    centres = trees.get(int(dims), np.zeros((1, int(dims))))
                    with np.errstate(over="ignore", invalid="ignore"):
                        cell = (np.einsum("ij,ij->i", centres, centres)[None, :] - 2 * (points @ centres.T)).argmin(axis=1)
                    yield part.assign(cell=cell, far=_distances(points, centres[cell]))

        return rows.mapInPandas(nearest, "vec_id long, dims int, mark long, v binary, cell int, far double")

    def known(self, dims: int, blocks: dict[tuple[int, int], int], reach: dict[tuple[int, int], float]) -> CoverTree | None:
        """The tree of a length, whose nodes reach as far as what was placed in the cells under them."""
        tree = self.trees.get(dims)
        if tree is None:
            return None
        under, far = np.arange(len(tree.centres)), np.array([reach.get((dims, n), 0.0) for n in range(len(tree.centres))])
        for level in reversed(range(len(tree.sizes))):
            out = np.zeros(tree.sizes[level])
            np.maximum.at(out, under, _distances(tree.centres, tree.centres[under]) + far)
            tree.reach[level] = out
            if level:
                under = tree.parents[level][under]
        return tree


def search(frame: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best of every row whose id is divisible by ``every``."""
    vector = F.col(vector_column).cast("array<double>")
    rows = frame.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("vec_id"), F.size(vector).alias("dims"), quantised(vector).alias("v"))
    rows = cut_lineage(rows.filter(F.col("v").isNotNull()).select("vec_id", "dims", F.xxhash64("v").alias("mark"), "v").dropDuplicates(["vec_id", "v"]))
    total, longest = rows.agg(F.count("*"), F.max("dims")).first()
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, longest or 1))))
    span = 1 << 30
    chosen = F.pmod(F.xxhash64("vec_id", "mark", F.lit("cells")), F.lit(span)) < (span if total <= size else int(span * size / total))
    cells = Cells(rows.filter(chosen).select("dims", "v").limit(2 * size).toPandas(), total)
    placed = cut_lineage(cells.place(rows))
    # One row per cell of a tree: as many as there are centres.
    named = F.col("dims").isin(list(cells.trees)) if cells.trees else F.lit(False)
    stats = placed.filter(named).groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("far").alias("reach")).collect()
    blocks = {(r["dims"], r["cell"]): -(-r["n"] // BLOCK) for r in stats}
    reach = {(r["dims"], r["cell"]): r["reach"] for r in stats}
    # Lengths outside the trees share one number of blocks; each of them has at most that many.
    others = 1 + total // BLOCK
    parts = placed.sparkSession.createDataFrame([(*key, n) for key, n in blocks.items()] or [(-1, -1, 1)], "dims int, cell int, blocks int")
    dealt = placed.join(F.broadcast(parts), ["dims", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(others)))
    data = cut_lineage(dealt.select("vec_id", "dims", "mark", "v", "cell", F.pmod(F.xxhash64("vec_id", "mark"), F.col("blocks")).cast("int").alias("block")))
    queries = data.filter((F.col("vec_id") % every == 0) & (F.col("vec_id") != _NO_ID)).withColumn("kth", F.lit(-math.inf))
    own = cut_lineage(_searched(data, queries, k))
    reached = own.groupBy("query_id", "mark").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
    reached = reached.select(F.col("query_id").alias("vec_id"), "mark", F.col("kth").cast("double").alias("reached"))
    asking = queries.join(reached, ["vec_id", "mark"], "left").select("vec_id", "dims", "mark", "v", "cell", "block", F.coalesce("reached", "kth").alias("kth"))
    # A score beyond 64 bits is no bound.
    asking = asking.withColumn("kth", F.when(F.abs("kth") < float(_EXACT), F.col("kth")).otherwise(F.lit(-math.inf)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, CoverTree | None] = {}
        for (dims, cell, number), part in _groups(batches, ["dims", "cell", "block"], GROUP):
            if dims not in known:
                known[dims] = cells.known(dims, blocks, reach)
            tree = known[dims]
            if tree is None:
                wanted = [(0, other) for other in range(others)]
            else:
                group = CoverTree(_matrix(part["v"], dims), GROUP_NODES)
                left = surviving(group, tree, part["kth"].to_numpy()).any(axis=0)
                wanted = [(int(c), other) for c in np.flatnonzero(left) for other in range(blocks.get((dims, int(c)), 0))]
            for target, other in wanted:
                if (target, other) != (cell, number):
                    yield part.assign(cell=target, block=other)

    grouped = asking.repartition("dims", "cell", "block").sortWithinPartitions("dims", "cell", "block", "vec_id")
    sent = grouped.mapInPandas(send, "vec_id long, dims int, mark long, v binary, cell int, block int, kth double")
    found = _best(own.unionByName(_searched(data, sent, k)), k)
    name = F.when(F.col("vec_id") != _NO_ID, F.col("vec_id"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), name.alias("vec_id"), "score")


#: The same rows in SQL, by comparing the queries with all rows.
SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q, whole d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
