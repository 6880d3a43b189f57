"""SimHash near-duplicates by bit-sliced comparison.

A text is lower-cased in A-Z, cut into words at ASCII white space, and its shingles of four words are
hashed by XXH64 with seed 42. A bit of the fingerprint is one if more than half of the hashes have it.
Fingerprints that differ in at most ``RADIUS`` bits are linked.

Equal fingerprints are merged first. The others meet in buckets of the pigeonhole kind: 64 bits in five
blocks, of which one is equal in any linked pair. A bucket above ``BUCKET`` fingerprints is cut again by
five blocks of its remaining bits, and what is still larger is compared in pairs of tiles; no pair is
lost at any size. In a bucket, bit planes are stored vertically, 64 fingerprints to a word. Distances
to 64 fingerprints at once are counted plane by plane in carry-save counters, and blocks in which every
distance is over the radius are abandoned. Tasks return a spanning star per local component, not pairs.

Defined cases: null, empty or wordless texts have fingerprint zero, which links like any other; a text of
fewer than four words has one shingle; rows without an id join a component but never name it (if all its ids
are null the component id is null); equal rows get equal results; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import documents
from tunelake.llm.graph import components
from tunelake.session import cut_lineage

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints that one group holds at most; larger groups are cut further.
BUCKET = 512
_BITS = 64
#: Pairs of a query and a word of lanes that are compared at once.
_COMBOS = 1 << 15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(word) + 1 for word in words])
        starts = (ends - [len(word) + 1 for word in words])[: len(words) - SHINGLE + 1].tolist()
        stops = (ends[SHINGLE - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[start:stop], SEED) for start, stop in zip(starts, stops)]
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(_BITS, dtype=np.int64)
    for low in range(0, len(values), 1 << 14):
        part = values[low : low + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * counts > len(values), bitorder="little")
    return int(ones.view("<i8")[0])


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(text) for text in batch], dtype="int64")

    return of(text)


def _blocks(bits: list[int]) -> list[list[int]]:
    """Bits in ``RADIUS + 1`` runs of nearly equal length."""
    parts = RADIUS + 1
    cuts = [len(bits) * n // parts for n in range(parts + 1)]
    return [bits[low:high] for low, high in zip(cuts, cuts[1:])]


def _value(value: Column, bits: list[int]) -> Column:
    """The bits as a mask on the value: equal masked values are equal in these bits."""
    mask = sum(1 << bit for bit in bits)
    return value.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def buckets(values: DataFrame, limit: int = BUCKET) -> DataFrame:
    """``fp``, ``bucket``, ``side``: every linked pair of distinct values shares a bucket of at most about ``limit``.

    In a bucket of two tiles ``side`` tells them apart; members of one side are compared elsewhere.
    """
    every = list(range(_BITS))
    first = _blocks(every)
    keys = F.array(*[F.struct(F.lit(n).alias("block"), F.xxhash64(F.lit(n), _value(F.col("fp"), part)).alias("bucket")) for n, part in enumerate(first)])
    rows = cut_lineage(values.select("fp", F.explode(keys).alias("key")).select("fp", "key.block", "key.bucket"))
    hot = cut_lineage(rows.groupBy("bucket").count().filter(F.col("count") > limit))
    small = rows.join(hot, "bucket", "left_anti")
    large = rows.join(hot.select("bucket"), "bucket")
    deeper = None
    for number, part in enumerate(first):
        rest = [bit for bit in every if bit not in part]
        keys = F.array(*[F.xxhash64("bucket", F.lit(n), _value(F.col("fp"), sub)) for n, sub in enumerate(_blocks(rest))])
        cut = large.filter(F.col("block") == number).select("fp", F.explode(keys).alias("bucket"))
        deeper = cut if deeper is None else deeper.unionByName(cut)
    deeper = cut_lineage(deeper)
    counts = deeper.groupBy("bucket").agg(F.count("*").alias("n"))
    hot = cut_lineage(counts.filter(F.col("n") > limit))
    plain = deeper.join(hot, "bucket", "left_anti")
    # What no block can part goes into tiles; a value meets its own tile and all others, in pairs.
    tiles = F.ceil(F.col("n") / F.lit(limit / 2)).cast("int")
    tiled = deeper.join(hot, "bucket").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    tiled = tiled.select("fp", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    tiled = tiled.select("fp", pair.alias("bucket"), side.alias("side"))
    whole = small.select("fp", "bucket").unionByName(plain.select("fp", "bucket")).withColumn("side", F.lit(0))
    return whole.unionByName(tiled)


def close_pairs(values: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the radius that share a group; ``groups`` is sorted.

    A value is a number of 64 bits, or a row of several. Lanes of a word belong to one group. Queries are compared with every word of their group.
    """
    values = values.astype(np.uint64).reshape(len(values), -1)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    inside = np.arange(len(values)) - np.repeat(starts, sizes)
    word, lane = np.repeat(first_word, sizes) + inside // 64, (inside % 64).astype(np.uint64)
    planes = np.zeros((_BITS * values.shape[1], int(words.sum())), dtype=np.uint64)
    for bit in range(len(planes)):
        # Lanes of a word are different bits, so adding them sets them.
        np.add.at(planes[bit], word, ((values[:, bit // _BITS] >> np.uint64(bit % _BITS)) & np.uint64(1)) << lane)
    lanes = np.zeros(planes.shape[1], dtype=np.uint64)
    np.add.at(lanes, word, np.uint64(1) << lane)
    base = np.repeat(starts, words) + 64 * (np.arange(len(lanes)) - np.repeat(first_word, words))
    # A query needs only words at or after its own: earlier ones have asked for it already.
    own_last = np.repeat(first_word + words, sizes)
    spans = (own_last - word).astype(np.int64)
    left, right = [], []
    ends = np.cumsum(spans)
    low = 0
    while low < len(values):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _COMBOS, "right")))
        count = spans[low:high]
        query = np.repeat(np.arange(low, high), count)
        target = np.repeat(word[low:high], count) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        for q, lane_found in _within(values, query, target, planes, lanes, radius):
            other = base[lane_found[0]] + lane_found[1]
            ordered = other > q
            left.append(q[ordered])
            right.append(other[ordered])
        low = high
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _within(values, query, target, planes, lanes, radius):
    """Queries and lanes within the radius, by carry-save counting over bit planes."""
    levels = radius.bit_length()
    counters = [np.zeros(len(query), dtype=np.uint64) for _ in range(levels)]
    over = ~lanes[target]
    for bit in range(len(planes)):
        flip = (np.uint64(0) - ((values[query, bit // _BITS] >> np.uint64(bit % _BITS)) & np.uint64(1))).astype(np.uint64)
        carry = planes[bit][target] ^ flip
        for level in range(levels):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        over |= carry
        if bit % 8 == 7:
            dead = over | _above(counters, radius)
            alive = np.flatnonzero(dead != _ALL)
            if len(alive) == 0:
                return
            # Blocks of 64 lanes that are all beyond the radius are abandoned.
            if len(alive) < len(query):
                query, target, over = query[alive], target[alive], over[alive]
                counters = [counter[alive] for counter in counters]
    close = ~(over | _above(counters, radius))
    bits = np.unpackbits(close.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    yield query[row], (target[row], lane)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius: compared with its bits from the highest down."""
    above = np.zeros_like(counters[0])
    equal = np.full_like(counters[0], _ALL)
    for level in reversed(range(len(counters))):
        if radius >> level & 1:
            equal &= counters[level]
        else:
            above |= equal & counters[level]
            equal &= ~counters[level]
    return above


def local_stars(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Smallest position that each position reaches over the pairs."""
    root = np.arange(size)
    while len(left):
        least = np.minimum(root[left], root[right])
        fresh = root.copy()
        np.minimum.at(fresh, left, least)
        np.minimum.at(fresh, right, least)
        # The former roots learn of the smaller ones, then paths are halved.
        np.minimum.at(fresh, root[left], least)
        np.minimum.at(fresh, root[right], least)
        fresh = fresh[fresh]
        if np.array_equal(fresh, root):
            break
        root = fresh
    return root


def links(values: DataFrame, limit: int = BUCKET, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: links that connect exactly the values connected by all pairs within the radius."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []

        def star(table: pd.DataFrame) -> pd.DataFrame:
            fp, bucket, side = (table[c].to_numpy() for c in ("fp", "bucket", "side"))
            left, right = close_pairs(fp, bucket, radius)
            crossing = (side[left] != side[right]) | (side[left] == 0)
            root = local_stars(left[crossing], right[crossing], len(fp))
            moved = np.flatnonzero(root != np.arange(len(fp)))
            return pd.DataFrame({"a": fp[moved], "b": fp[root[moved]]})

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < 8192:
                continue
            table = pd.concat(held, ignore_index=True)
            last = table["bucket"].iloc[-1]
            whole = (table["bucket"] != last).to_numpy()
            if whole.any():
                yield star(table[whole].reset_index(drop=True))
            held = [table[~whole]]
        if held and sum(map(len, held)):
            yield star(pd.concat(held, ignore_index=True))

    dealt = buckets(values, limit).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(compare, "a long, b long")


def near_duplicates(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = BUCKET) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id that links reach."""
    rows = documents(frame, id_column, text_column)
    rows = cut_lineage(rows.select("doc_id", fingerprints(F.col("text")).alias("fp")))
    values = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = cut_lineage(components(links(values.select("fp"), limit)))
    placed = values.join(linked, F.col("fp") == F.col("a"), "left").select("fp", "first", F.coalesce("b", "fp").alias("root"))
    roots = cut_lineage(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    labels = cut_lineage(placed.join(roots, "root").select("fp", "component_id"))
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
