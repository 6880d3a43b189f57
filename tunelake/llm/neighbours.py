"""Near-duplicate vectors by NN-descent.

Equal vectors are merged into one node first. A neighbour graph starts from leaves of random-projection trees
and is refined: for every node the vectors in its list, and of the nodes that list it, are compared with one
another, and better neighbours enter their lists. Lists in which every neighbour is over the threshold are
saturated and are enlarged. Edges over the threshold give components, and in every component all members
are compared once more, in tiles, so that no link inside it is missed however long a list would have to
be. An audit compares sampled vectors with all others and asks
for how many of those that have links all of them lie inside their component: among all vectors, and again among
those outside large components, which are sampled until enough linked ones are seen. As long as a figure is too low,
more trees are added; a recall that stays too low is an error, never a result.

Cosines are in double precision. Vectors of different lengths do not link.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; equal
vectors link with each other; rows with one id are counted each; a null id never names a component unless all its
ids are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tunelake.llm.graph import components
from tunelake.session import cut_lineage

THRESHOLD = 0.9
LIST, TREES, LEAF, ROUNDS = 10, 8, 128, 2
#: Sets of trees after which a recall that is still too low is an error.
ATTEMPTS = 16
TILE = 512
#: Vectors that the audit compares with all others, linked ones that it wants to see, and the recall it asks for.
AUDIT, RECALL = 256, 0.99
#: Members of a component that is not large, and bytes of the vectors that one audit compares at most.
SMALL, AUDIT_BYTES = 64, 1 << 24
_CODE_BITS = 48


def _unit(values: pd.Series) -> list[bytes]:
    out = []
    for value in values:
        vector = np.asarray(value, dtype=np.float64)
        # Divided by the largest component first, so that squares neither overflow nor vanish.
        vector = vector / np.abs(vector).max()
        out.append((vector / np.sqrt(vector @ vector)).tobytes())
    return out


@F.pandas_udf(BinaryType())
def unit_bytes(values: pd.Series) -> pd.Series:
    return pd.Series(_unit(values), dtype=object)


def _matrix(packed: pd.Series) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), -1)


def usable(vector: Column) -> Column:
    numbers = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))), F.lit(False))
    return F.coalesce(numbers & F.exists(vector, lambda v: v != 0), F.lit(False))


def nodes(vectors: DataFrame) -> DataFrame:
    """``node``, ``unit``, ``dims``, ``first`` (smallest id) and ``copies`` of every different unit vector."""
    merged = vectors.groupBy("unit", "dims").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    merged = cut_lineage(merged)
    salt = 0
    while True:
        # A hash that two vectors share would join them; another salt is taken until there is none.
        named = merged.withColumn("node", F.xxhash64(F.lit(salt), "unit"))
        seen = named.agg(F.count("*"), F.count_distinct("node")).first()
        if seen[0] == seen[1]:
            return cut_lineage(named)
        salt += 1


def _codes(base: DataFrame, trees: range, depth: int) -> DataFrame:
    """``tree``, ``code``: signs of random projections; the first ``depth`` bits name the leaf."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = 1 << np.arange(_CODE_BITS, dtype=np.int64)[::-1]
        for batch in batches:
            for dims, part in batch.groupby("dims"):
                matrix = _matrix(part["unit"])
                for tree in trees:
                    if (tree, dims) not in planes:
                        planes[tree, dims] = np.random.default_rng([tree, int(dims)]).normal(size=(int(dims), _CODE_BITS))
                    code = (matrix @ planes[tree, dims] > 0) @ weights
                    yield pd.DataFrame({"tree": tree, "dims": dims, "leaf": code >> (_CODE_BITS - depth), "code": code, "node": part["node"], "unit": part["unit"]})

    return base.mapInPandas(project, "tree int, dims int, leaf long, code long, node long, unit binary")


def _runs(batches: Iterator[pd.DataFrame], keys: list[str], most: int | None = None) -> Iterator[pd.DataFrame]:
    """Whole groups of sorted rows; groups above ``most`` rows come in parts."""
    held: pd.DataFrame | None = None
    for batch in batches:
        table = batch if held is None else pd.concat([held, batch], ignore_index=True)
        change = (table[keys] != table[keys].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(change)
        for low, high in zip(starts, starts[1:]):
            for at in range(low, high, most or high - low):
                yield table.iloc[at : min(high, at + (most or high - low))]
        held = table.iloc[starts[-1] :] if len(starts) else table
        while most and len(held) > 2 * most:
            yield held.iloc[:most]
            held = held.iloc[most:]
    if held is not None and len(held):
        for at in range(0, len(held), most or len(held)):
            yield held.iloc[at : at + (most or len(held))]


def _leaf_edges(base: DataFrame, trees: range, depth: int, size: int) -> DataFrame:
    """Best neighbours of every node in its leaf of each tree. Leaves are runs of sorted codes, so that dense
    regions fill several tasks and a task never holds more than a part of one."""

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _runs(batches, ["tree", "dims", "leaf"], 2 * LEAF):
            if len(part) < 2:
                continue
            matrix, names = _matrix(part["unit"]), part["node"].to_numpy()
            near = matrix @ matrix.T
            np.fill_diagonal(near, -2)
            take = min(size, len(part) - 1)
            best = np.argpartition(-near, take - 1, axis=1)[:, :take]
            yield pd.DataFrame({"src": np.repeat(names, take), "dst": names[best].ravel(), "sim": np.take_along_axis(near, best, axis=1).ravel()})

    coded = _codes(base, trees, depth).repartitionByRange("tree", "dims", "code", "node").sortWithinPartitions("tree", "dims", "code", "node")
    return coded.mapInPandas(inside, "src long, dst long, sim double")


def _lists(edges: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """The best neighbours of every node: as many as its list holds."""
    merged = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    if sizes is not None:
        merged = merged.join(sizes, "src", "left")
    room = F.coalesce(F.col("room"), F.lit(LIST)) if sizes is not None else F.lit(LIST)
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return merged.withColumn("room", room).withColumn("place", place).filter(F.col("place") <= F.col("room")).select("src", "dst", "sim", "room")


def _rooms(lists: DataFrame) -> DataFrame:
    """Room of every list: doubled where all neighbours are over the threshold."""
    state = lists.groupBy("src").agg(F.count("*").alias("n"), F.min("sim").alias("worst"), F.max("room").alias("room"))
    full = (F.col("n") >= F.col("room")) & (F.col("worst") >= THRESHOLD)
    return state.select("src", "worst", F.when(full, F.col("room") * 2).otherwise(F.col("room")).alias("room"), full.alias("full"))


def descend(base: DataFrame, lists: DataFrame) -> DataFrame:
    """One round: neighbours of neighbours are compared, and what improves a list enters it."""
    rooms = cut_lineage(_rooms(lists))
    # Reverse lists are as short as the forward ones; what they leave out is compared in components.
    back = F.row_number().over(W.partitionBy("dst").orderBy(F.desc("sim"), "src"))
    reverse = lists.withColumn("place", back).filter(F.col("place") <= LIST).select(F.col("dst").alias("hub"), F.col("src").alias("member"))
    forward = F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    ahead = lists.withColumn("place", forward).filter(F.col("place") <= LIST).select(F.col("src").alias("hub"), F.col("dst").alias("member"))
    around = ahead.unionByName(reverse).distinct()
    known = base.select(F.col("node").alias("member"), "unit").join(
        rooms.select(F.col("src").alias("member"), F.when(F.col("full"), F.lit(-1.0)).otherwise(F.col("worst")).alias("bar")), "member", "left"
    )
    dealt = around.join(known, "member").repartition("hub").sortWithinPartitions("hub", "member")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _runs(batches, ["hub"]):
            if len(part) < 2:
                continue
            matrix, names, bar = _matrix(part["unit"]), part["member"].to_numpy(), part["bar"].fillna(-1.0).to_numpy()
            near = matrix @ matrix.T
            np.fill_diagonal(near, -2)
            left, right = np.nonzero(near > bar[:, None])
            yield pd.DataFrame({"src": names[left], "dst": names[right], "sim": near[left, right]})

    better = dealt.mapInPandas(local, "src long, dst long, sim double")
    return cut_lineage(_lists(lists.select("src", "dst", "sim").unionByName(better), rooms.select("src", "room")))


def link_counts(base: DataFrame, placed: DataFrame) -> DataFrame:
    """``node``, ``links``: rows linked to each node inside its component, all pairs compared in tiles."""
    sizes = placed.groupBy("root").agg(F.count("*").alias("members"))
    sizes = cut_lineage(sizes.filter("members > 1"))
    rows = placed.join(sizes, "root").join(base.select("node", "unit", "copies"), "node")
    rows = rows.withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    rows = rows.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "unit", "copies")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _runs(batches, ["root", "low", "high"]):
            names, copies, own = part["node"].to_numpy(), part["copies"].to_numpy(), part["own"].to_numpy()
            matrix = _matrix(part["unit"])
            near = matrix @ matrix.T >= THRESHOLD
            np.fill_diagonal(near, False)
            if part["low"].iloc[0] != part["high"].iloc[0]:
                near &= own[:, None] != own[None, :]
            yield pd.DataFrame({"node": names, "links": near @ copies})

    dealt = rows.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "node")
    return dealt.mapInPandas(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _sample(rows: DataFrame, total: int, size: int) -> DataFrame:
    """About ``size`` of ``total`` rows by a hash of their node; a larger sample holds the smaller ones."""
    span = 1 << 30
    cut = span if total <= size else int(span * size / total)
    return rows.filter(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(span)) < cut).limit(2 * size)


def _compared(base: DataFrame, placed: DataFrame, chosen: DataFrame) -> pd.DataFrame:
    """``links`` and ``met`` of every chosen vector that has a link: rows linked to it, and those of its component."""
    chosen = base.join(chosen, "node").select("node", "dims", "root", "unit").toPandas()
    asked = {dims: (_matrix(part["unit"]), part["node"].to_numpy(), part["root"].to_numpy()) for dims, part in chosen.groupby("dims")}

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, whole in batch.groupby("dims"):
                # A slice at a time: the products of a large sample with a batch are held at once.
                for low in range(0, len(whole) if dims in asked else 0, 1024):
                    part = whole.iloc[low : low + 1024]
                    matrix, names, roots = asked[dims]
                    near = matrix @ _matrix(part["unit"]).T >= THRESHOLD
                    near &= names[:, None] != part["node"].to_numpy()[None, :]
                    same = roots[:, None] == part["root"].to_numpy()[None, :]
                    copies = part["copies"].to_numpy()
                    links = near @ copies
                    seen = links > 0
                    yield pd.DataFrame({"node": names[seen], "links": links[seen], "met": ((near & same) @ copies)[seen]})

    rows = base.join(placed.select("node", "root"), "node").select("node", "dims", "root", "unit", "copies")
    return rows.mapInPandas(compare, "node long, links long, met long").groupBy("node").agg(F.sum("links").alias("links"), F.sum("met").alias("met")).toPandas()


def audit(base: DataFrame, placed: DataFrame, total: int) -> dict[str, tuple[int, int]]:
    """What sampled vectors have and what of it is met: ``links`` with their copies, ``vectors`` that have links and
    all of them inside their component, and the same for ``small``, the vectors outside large components."""
    sizes = cut_lineage(placed.groupBy("root").agg(F.count("*").alias("members")).filter(F.col("members") > SMALL).select("root"))
    small = cut_lineage(placed.join(sizes, "root", "left_anti").select("node", "root"))
    few = small.count()

    def whole(found: pd.DataFrame) -> tuple[int, int]:
        return len(found), int((found["links"] == found["met"]).sum())

    found = _compared(base, placed, _sample(placed.select("node", "root"), total, AUDIT))
    out = {"links": (int(found["links"].sum()), int(found["met"].sum())), "vectors": whole(found), "small": (0, 0)}
    longest = base.agg(F.max("dims")).first()[0] or 1
    most, size = max(AUDIT, AUDIT_BYTES // (8 * longest)), 4 * AUDIT
    while few:
        size = min(size, most)
        out["small"] = whole(_compared(base, placed, _sample(small, few, size)))
        if out["small"][0] >= AUDIT or size >= min(few, most):
            break
        size *= 4
    return out


def near_duplicates(frame: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: links, component, and whether it is the one of its component that stays."""
    rows = frame.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    good = usable(F.col("vector"))
    unit = unit_bytes(F.when(good, F.col("vector")).otherwise(F.array(F.lit(1.0))))
    rows = cut_lineage(rows.select("vec_id", F.size("vector").alias("dims"), F.when(good, unit).alias("unit")))
    base = nodes(rows.filter(F.col("unit").isNotNull()))
    total = base.count()
    depth = max(0, min(_CODE_BITS, math.ceil(math.log2(max(1, total / LEAF)))))
    edges, linked, placed = None, None, base.select("node", F.col("node").alias("root"))
    for attempt in range(ATTEMPTS if total else 0):
        trees = range(attempt * TREES, (attempt + 1) * TREES)
        fresh = _leaf_edges(base, trees, depth, LIST // 2)
        lists = cut_lineage(_lists(fresh if edges is None else fresh.unionByName(edges), None))
        for _ in range(ROUNDS):
            lists = descend(base, lists)
        edges = lists.select("src", "dst", "sim")
        over = edges.filter(F.col("sim") >= THRESHOLD).select(F.col("src").alias("a"), F.col("dst").alias("b"))
        # Lists start anew with each set of trees; what was linked before stays linked.
        linked = components(over if linked is None else over.unionByName(linked))
        placed = cut_lineage(
            base.select("node").join(linked, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root"))
        )
        seen = audit(base, placed, total)
        if all(met >= RECALL * links for links, met in seen.values()):
            break
    else:
        if total:
            raise RuntimeError(f"after {ATTEMPTS} sets of trees the audit finds too little (there, met): {seen}")
    members = cut_lineage(base.select("node", "unit", "first", "copies").join(placed, "node"))
    roots = cut_lineage(members.groupBy("root").agg(F.min("first").alias("component_id")))
    facts = members.join(roots, "root").join(link_counts(base, placed), "node", "left")
    count = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    facts = cut_lineage(facts.select(F.col("unit").alias("key"), count, "component_id"))
    joined = rows.join(facts, F.col("unit") == F.col("key"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
