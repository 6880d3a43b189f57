"""Near copies among texts: SimHash finds candidates, the shingles themselves decide.

A text is the set of its five-word shingles (words as in ``simhash``; fewer words are one shingle). Texts with equal sets are one
node. Nodes are linked if the Jaccard similarity of their sets is at least ``LEAST``.

Every set has a fingerprint of 256 bits, four SimHashes of 64. At the similarity asked for, a pair differs in some 15 % of them. Nodes that agree
in all bits of a band meet in a bucket. A band has so many bits that a bucket holds about ``MEAN`` unrelated nodes, and there are
so many bands that a pair at the threshold misses all of them with a chance of ``MISSED``: both follow from the number of nodes.
In a bucket, distances are counted by ``simhash.close_pairs`` over bit planes with carry-save counters. Pairs are checked in rounds: of each node the
``NEAREST`` neighbours within ``RADIUS`` leave the task first, so that a group of copies costs a few pairs per member. Buckets in which a node has
more neighbours come again with ``WIDER`` times the number, now only for neighbours that no link has joined to the node so far, until no neighbour is left out.
From the second round on rows bring the parities of their sets, and pairs that these rule out never leave the task: texts around one original that are
not similar enough are many fingerprints within the radius of each other, but few pairs.
Buckets above ``BUCKET`` are cut by further bits in the first round, and what these cannot part gets a leader of the whole; from the second
round on such a bucket is compared as a whole, in tiles: members outside its largest group meet all others.
The bands grow in number with the nodes, so they are taken ``TOGETHER`` at a time: rows with a fingerprint are shuffled for these only, go when they are compared,
and leave the node and the bucket of what comes again.
So whatever meets in a band within the radius is joined or has been counted, unless sizes or parities of the sets rule the similarity out. A fixed number of bits remembers which
nodes are in a pair; their sets are read from the texts once more, and the similarity is counted.

Defined cases: null, empty and wordless texts have the empty set and are one node; rows without an id are in no group and stay; of several
rows with one id the texts decide, each for itself; of equal rows of one id one stays; an empty table gives no rows;
other columns are kept whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import BitFilter, bit_filter, documents, free_names
from tunelake.llm.graph import components
from tunelake.llm.simhash import SEED, close_pairs
from tunelake.session import cut_lineage, tidy_shuffles

SHINGLE, LEAST = 5, 0.8
WORDS64 = 4
BITS = 64 * WORDS64
#: Bits in which two fingerprints may differ to be candidates: 2.5 standard deviations beyond what is expected at ``LEAST``.
_SHARE = math.acos(2 * LEAST / (1 + LEAST)) / math.pi
RADIUS = round(BITS * _SHARE + 2.5 * math.sqrt(BITS * _SHARE * (1 - _SHARE)))
MEAN, BUCKET, MISSED, NEAREST = 64, 512, 0.01, 1
#: How many times more neighbours of a node are taken in each further round.
WIDER = 16
#: Bands whose rows are on disk at a time.
TOGETHER = 16
#: Bits of the parity of a set; sets differ in as many elements at least as parities in bits.
PARITY_BITS = 512
#: Different sets that are smaller cannot be similar enough: without the one shingle that differs, four of five are left.
SMALLEST = math.ceil(LEAST / (1 - LEAST) - 1e-9)
#: Rows of buckets that a task compares at once.
HELD = 4096
#: Bits of the filter of nodes in pairs: 16 MB at any size.
FILTER_BITS = 27
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = [0, *ends[: len(words) - SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    return np.unique(np.array([digest(line[start:stop], SEED) for start, stop in zip(starts, stops)], dtype=np.uint64))


def fingerprint(hashes: np.ndarray) -> bytes:
    """Majority bits of the hashes and of three further hashes of them."""
    out = b""
    for multiplier in _MULTIPLIERS:
        counts = np.zeros(64, dtype=np.int64)
        for low in range(0, len(hashes), 1 << 14):
            mixed = hashes[low : low + (1 << 14)] * np.uint64(multiplier)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(_MULTIPLIERS[1])
            mixed ^= mixed >> np.uint64(29)
            counts += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()
    return out


def parity(hashes: np.ndarray) -> bytes:
    """Whether the number of hashes is odd, for each value of their first bits."""
    places = (hashes >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=PARITY_BITS) % 2 == 1).tobytes()


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A few rows at a time, so that the sets of a batch are never held together."""
    for low in range(0, len(batch), 256):
        yield batch.iloc[low : low + 256]


def _key(hashes: np.ndarray) -> bytes:
    return hashlib.sha256(hashes.tobytes()).digest()[:16]


def fingerprinted(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (digest of the set), ``fp``, ``size`` and ``parity`` of every row with ``doc_id`` and ``text``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for batch in _slices(whole):
                sets = [shingles(text) for text in batch["text"]]
                found = {"doc_id": batch["doc_id"], "key": [_key(s) for s in sets], "fp": [fingerprint(s) for s in sets]}
                yield pd.DataFrame(found | {"size": np.array([len(s) for s in sets], dtype=np.int32), "parity": [parity(s) for s in sets]})

    return rows.mapInPandas(each, "doc_id long, key binary, fp binary, size int, parity binary")


def _named(frame: DataFrame) -> DataFrame:
    """``node``: a number of every different key. A number that two keys share would join them: another salt is taken until there is none."""
    salt = 0
    while True:
        named = frame.withColumn("node", F.xxhash64(F.lit(salt), "key"))
        seen = named.agg(F.count("*"), F.count_distinct("node")).first()
        if seen[0] == seen[1]:
            return cut_lineage(named)
        salt += 1


def bands(nodes: int) -> list[np.ndarray]:
    """Bits of every band for a number of nodes."""
    width = max(8, math.ceil(math.log2(max(1, nodes / MEAN))))
    meet = (1 - _SHARE) ** width
    count = math.ceil(math.log(MISSED) / math.log(1 - meet))
    draw = np.random.default_rng(7)
    out: list[np.ndarray] = []
    while len(out) < count:
        order = draw.permutation(BITS)
        out += [order[low : low + width] for low in range(0, BITS - width + 1, width)]
    return out[:count]


def _bits(packed: pd.Series) -> np.ndarray:
    """Fingerprints as rows of bits."""
    return np.unpackbits(np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1), axis=1, bitorder="little")


def _bucketed(nodes: DataFrame, chosen: list[np.ndarray], first: int) -> DataFrame:
    """``node, fp, size, bucket``: a row per band, numbered from ``first`` on, and node that can have a link."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = _bits(batch["fp"])
            for number, band in enumerate(chosen, first):
                packed = np.packbits(bits[:, band], axis=1)
                buckets = [xxhash.xxh64_intdigest(row.tobytes(), number) for row in packed]
                yield batch.assign(bucket=np.array(buckets, dtype=np.uint64).view(np.int64))

    large = nodes.filter(F.col("size") >= SMALLEST).select("node", "fp", "size")
    return large.mapInPandas(place, "node long, fp binary, size int, bucket long")


def _hot(rows: DataFrame) -> DataFrame:
    """``bucket, n`` of the buckets above ``BUCKET``."""
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    return cut_lineage(counts.filter(F.col("n") > BUCKET))


def _sized(rows: DataFrame) -> DataFrame:
    """Rows with the size ``n`` of their bucket if that is above ``BUCKET`` or the largest: there is always one, so the plan is the same for any input."""
    counts = cut_lineage(rows.groupBy("bucket").agg(F.count("*").alias("n")))
    largest = counts.orderBy(F.desc("n"), "bucket").limit(1)
    return rows.join(cut_lineage(counts.filter(F.col("n") > BUCKET).unionByName(largest).distinct()), "bucket", "left")


def _parted(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, fp, size, bucket``: rows ``node, bucket, n`` of buckets above ``BUCKET``, cut by bits, then into parts that share a leader: cheap, and not all pairs meet."""

    def deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = _bits(batch["fp"])
            buckets = []
            for row, bucket, n in zip(bits, batch["bucket"], batch["n"]):
                width = math.ceil(math.log2(n / BUCKET)) + 1
                own = np.random.default_rng(bucket % (1 << 64)).permutation(BITS)[:width]
                buckets.append(xxhash.xxh64_intdigest(row[own].tobytes(), bucket % (1 << 64)))
            yield batch[["node"]].assign(bucket=np.array(buckets, dtype=np.uint64).view(np.int64))

    told = nodes.select("node", "fp", "size")
    cut = cut_lineage(rows.join(told, "node").select("node", "fp", "bucket", "n").mapInPandas(deeper, "node long, bucket long"))
    second = _hot(cut)
    fine = cut.join(second, "bucket", "left_anti")
    tight = cut.join(second, "bucket")
    part = F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") * 2 / BUCKET).cast("long"))
    parts = tight.select("node", F.xxhash64("bucket", part).alias("bucket"))
    leaders = tight.groupBy("bucket").agg(F.min("node").alias("node"), F.first("n").alias("n"))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") * 2 / BUCKET).cast("long") - 1))
    leaders = leaders.select("node", "bucket", numbers.alias("part")).select("node", F.xxhash64("bucket", "part").alias("bucket"))
    return fine.select("node", "bucket").unionByName(parts).unionByName(leaders).join(told, "node")


def _tiled(rows: DataFrame) -> DataFrame:
    """``node, bucket, side``: rows ``node, bucket, root`` of large buckets in tiles, so that every two members with different roots meet.

    Members of the largest group of a bucket need not meet each other. In a bucket of two tiles ``side`` tells them apart; members of one side meet elsewhere.
    """
    counts = cut_lineage(rows.groupBy("bucket", "root").agg(F.count("*").alias("n")))
    top = counts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).filter(F.col("n") > F.col("top.n"))
    tiles = lambda n: F.ceil(n * 2 / BUCKET).cast("long")
    top = cut_lineage(top.select("bucket", F.col("top.root").alias("main"), tiles(F.col("top.n")).alias("mains"), tiles(F.col("n") - F.col("top.n")).alias("others")))
    inside = F.col("root") == F.col("main")
    number = F.xxhash64("node", "bucket")
    own = F.when(inside, F.pmod(number, "mains")).otherwise(F.col("mains") + F.pmod(number, "others"))
    meets = F.sequence(F.when(inside, F.col("mains")).otherwise(F.lit(0).cast("long")), F.col("mains") + F.col("others") - 1)
    tiled = rows.join(top, "bucket").select("node", "bucket", own.alias("own"), F.explode(meets).alias("other"))
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return tiled.select("node", pair.alias("bucket"), side.alias("side"))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in pieces that hold whole buckets; rows come sorted by bucket."""
    held: list[pd.DataFrame] = []
    for batch in (whole.iloc[low : low + HELD] for whole in batches for low in range(0, len(whole), HELD)):
        held.append(batch)
        if sum(map(len, held)) < HELD:
            continue
        table = pd.concat(held, ignore_index=True)
        whole = (table["bucket"] != table["bucket"].iloc[-1]).to_numpy()
        if whole.any():
            yield table[whole].reset_index(drop=True)
        held = [table[~whole]]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def _mixed(table: pd.DataFrame) -> pd.DataFrame:
    """The buckets that hold several roots."""
    bucket, root = table["bucket"].to_numpy(), table["root"].to_numpy()
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    several = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    return table[np.repeat(several, np.diff(np.r_[starts, len(bucket)]))].reset_index(drop=True)


def _words(packed: pd.Series, bits: int) -> np.ndarray:
    """Packed bits as rows of words."""
    return np.frombuffer(b"".join(packed), dtype="<u8").reshape(len(packed), bits // 64)


def _allowed(total: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether two sets can be similar enough, by their elements together and their parities."""
    # At most: what is not in both makes up the difference.
    both = (total - np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)) // 2
    return both >= LEAST * (total - both)


def candidates(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``a, b``: for every node the ``limit`` nearest fingerprints within the radius that it meets in a bucket, of those with another root and a size
    (and a parity, if rows have it) that allows a link; and ``node, bucket, side``: the rows of buckets in which a node has more. Rows are ``node, fp, size, bucket, side, root``."""
    bounded = "parity" in rows.columns

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in map(_mixed, _runs(batches)):
            if not len(table):
                continue
            values = _words(table["fp"], BITS)
            odd = _words(table["parity"], PARITY_BITS) if bounded else None
            bucket, side, root, size = (table[c].to_numpy() for c in ("bucket", "side", "root", "size"))
            left, right = close_pairs(values, bucket, RADIUS)
            fine = (root[left] != root[right]) & ((side[left] != side[right]) | (side[left] == 0))
            fine &= np.minimum(size[left], size[right]) >= LEAST * np.maximum(size[left], size[right])
            left, right = left[fine], right[fine]
            far, fine = np.zeros(len(left), dtype=np.int32), np.ones(len(left), dtype=bool)
            for low in range(0, len(left), 1 << 16):
                part = slice(low, low + (1 << 16))
                one, two = left[part], right[part]
                far[part] = np.bitwise_count(values[one] ^ values[two]).sum(axis=1)
                if bounded:
                    fine[part] = _allowed(size[one].astype(np.int64) + size[two], odd[one], odd[two])
            left, right, far = left[fine], right[fine], far[fine]
            own, other, far = np.r_[left, right], np.r_[right, left], np.r_[far, far]
            order = np.lexsort((other, far, own))
            own, other = own[order], other[order]
            first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, dtype=bool)
            heads = np.flatnonzero(first)
            place = np.arange(len(own)) - np.repeat(heads, np.diff(np.r_[heads, len(own)]))
            near = place < limit
            names = table["node"].to_numpy()
            a, b = names[own[near]], names[other[near]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "side": np.int32(0), "more": False}).drop_duplicates()
            more = np.isin(bucket, bucket[own[~near]])
            yield pd.DataFrame({"a": names[more], "b": bucket[more], "side": side[more], "more": True})

    # Sorted by node too: ties of distance are broken alike in any run.
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "node")
    found = cut_lineage(dealt.mapInPandas(compare, "a long, b long, side int, more boolean"))
    again = found.filter("more").select(F.col("a").alias("node"), F.col("b").alias("bucket"), "side")
    return found.filter("not more and a <> b").select("a", "b").distinct(), again


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes and parities do not rule the similarity out."""

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = (_words(batch[c], PARITY_BITS) for c in ("left", "right"))
            yield batch.loc[_allowed(batch["total"].to_numpy().astype(np.int64), left, right), ["a", "b"]]

    left = nodes.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("parity").alias("left"))
    right = nodes.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("parity").alias("right"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("size_a") + F.col("size_b")).alias("total"), "left", "right")
    return met.mapInPandas(bound, "a long, b long")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, hashes`` of the wanted nodes (``first_id, of, node``), from the texts of their first ids."""
    bits = rows.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("first_id").alias("mark")), "mark", FILTER_BITS, tidy=True))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = BitFilter(bits.value)
        for batch in batches:
            for part in _slices(batch[known.holds(batch["mark"].to_numpy())]):
                sets = [shingles(text) for text in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "key": [_key(s) for s in sets], "hashes": [s.tobytes() for s in sets]})

    marked = rows.select("doc_id", "text", F.xxhash64("doc_id").alias("mark"))
    found = marked.mapInPandas(read, "doc_id long, key binary, hashes binary")
    met = found.join(wanted, (F.col("doc_id") == F.col("first_id")) & (F.col("key") == F.col("of")))
    # A node has one id and one digest: by these the rows have just been joined.
    return cut_lineage(met.dropDuplicates(["doc_id", "key"]).select("node", "hashes"))


def _similar(pairs: DataFrame) -> DataFrame:
    """Pairs whose sets ``left`` and ``right`` are similar enough."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fine = []
            for left, right in zip(batch["left"], batch["right"]):
                one, two = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                fine.append(both >= LEAST * (len(one) + len(two) - both))
            yield batch.loc[fine, ["a", "b"]]

    return pairs.mapInPandas(count, "a long, b long")


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _first_round(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame | None]]:
    """Pairs; for every ``TOGETHER`` bands the rows that come again and, if there are any, the ``node, bucket`` of large buckets."""
    chosen, pairs, again, whole = bands(nodes.count()), [], [], []
    for first in range(0, len(chosen), TOGETHER):
        placed = _sized(_bucketed(nodes, chosen[first : first + TOGETHER], first))
        over = F.coalesce(F.col("n") > BUCKET, F.lit(False))
        small = placed.filter(~over).select("node", "fp", "size", "bucket", F.lit(0).alias("side"), F.col("node").alias("root"))
        near, more = candidates(small, NEAREST)
        pairs.append(near)
        again.append(more)
        large = cut_lineage(placed.filter(over).select("node", "bucket", "n"))
        hot = not large.isEmpty()
        whole.append(large.select("node", "bucket") if hot else None)
        if hot:
            # Parts of large buckets have done their work then: the whole buckets follow.
            parts = _parted(large, nodes).withColumn("side", F.lit(0)).withColumn("root", F.col("node"))
            pairs.append(candidates(parts, NEAREST)[0])
    return pairs, again, whole


def linked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a``, ``b``: every node that has a link, except the smallest of its component, with that smallest node."""
    found, again, whole = _first_round(nodes)
    limit, sets, tested, roots = NEAREST, None, None, None
    while True:
        pairs = _together(found).distinct()
        close = cut_lineage(_possible(pairs, nodes) if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        # The text of a node is read again where its first id stands, once; the digest tells whether a row is of the node.
        ends = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ends = ends if sets is None else ends.join(sets, "node", "left_anti")
        wanted = cut_lineage(nodes.join(ends, "node").select("first_id", F.col("key").alias("of"), "node"))
        if sets is None or not wanted.isEmpty():
            fresh = _sets(rows, wanted)
            sets = fresh if sets is None else sets.unionByName(fresh)
        left, right = (sets.select(F.col("node").alias(end), F.col("hashes").alias(name)) for end, name in (("a", "left"), ("b", "right")))
        links = cut_lineage(_similar(close.join(left, "a").join(right, "b")))
        # Stars of the rounds before stand for their links.
        if roots is None or not links.isEmpty():
            roots = components(links if roots is None else roots.unionByName(links))
        stars = roots.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = nodes.select("node", "fp", "size", "parity").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
        tested = close if tested is None else tested.unionByName(close)
        limit *= WIDER
        found, more = [], []
        for part, large in zip(again, whole):
            if large is not None:
                part = part.unionByName(_tiled(large.join(state.select("node", "root"), "node")))
            if not part.isEmpty():
                near, left_out = candidates(part.join(state, "node"), limit)
                found.append(near)
                more.append(left_out)
        if not found:
            return roots
        again, whole = more, [None] * len(more)


def groups(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, key, first``: every row with an id, and whether it is the first text of its group: the smallest id, then the smallest key."""
    rows = documents(frame, id_column, text_column).filter(F.col("doc_id").isNotNull())
    with tidy_shuffles(frame.sparkSession):
        marked = cut_lineage(fingerprinted(rows))
        nodes = _named(marked.groupBy("key").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("parity").alias("parity"), F.min("doc_id").alias("first_id")))
        roots = linked(rows, nodes)
        placed = nodes.join(roots, F.col("node") == F.col("a"), "left").select("key", "first_id", F.coalesce("b", "node").alias("root"))
        best = placed.groupBy("root").agg(F.min(F.struct("first_id", "key")).alias("best"))
        kept = cut_lineage(best.select(F.col("best.first_id").alias("kept_id"), F.col("best.key").alias("kept_key")))
    # An id and its text meet the one that stays: no group brings all its copies to one task.
    same = (F.col("doc_id") == F.col("kept_id")) & (F.col("key") == F.col("kept_key"))
    return marked.join(kept, same, "left").select("doc_id", "key", F.col("kept_id").isNotNull().alias("first"))


def one_of_each(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``frame`` that stay: the first of every group, and rows without an id.

    The texts are shuffled once, for the join with the ids that stay. Only of ids with several rows are the texts looked at again.
    """
    found = cut_lineage(groups(frame, id_column, text_column), tidy=True)
    stay, often, key = free_names(frame, "stay", "often", "key")
    ids = found.groupBy(F.col("doc_id").alias(stay)).agg((F.count("*") > 1).alias(often), F.max("first").alias("first"))
    keepers = cut_lineage(ids.filter("first").select(stay, often), tidy=True)
    # The ids that stay grow with the input: the same join at every size, never a broadcast.
    named = frame.join(keepers.hint("merge"), F.col(id_column).cast("long") == F.col(stay))
    kept = named.filter(~F.col(often)).select(*frame.columns).unionByName(frame.filter(F.col(id_column).isNull()))
    several = keepers.filter(often).select(stay)
    if several.isEmpty():
        return kept
    several = cut_lineage(found.filter("first").join(several, F.col("doc_id") == F.col(stay)).select(stay, F.col("key").alias(key)).distinct(), tidy=True)

    @F.pandas_udf("binary")
    def key_of(texts: pd.Series) -> pd.Series:
        return pd.Series([_key(shingles(text)) for text in texts], dtype=object)

    repeated = frame.join(several, F.col(id_column).cast("long") == F.col(stay)).filter(key_of(F.col(text_column).cast("string")) == F.col(key))
    return kept.unionByName(repeated.dropDuplicates([id_column, key]).select(*frame.columns))
