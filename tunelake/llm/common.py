"""Helpers that several operators of this package share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.session import cut_lineage


def documents(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash."""
    return frame.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    )


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True for the fold that nothing is learned from; a row without an id is in it."""
    remainder = F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))
    return F.coalesce(remainder == part, F.lit(True))


def thinned(frame: DataFrame, key: Column, total: int, rows: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of their key: the same rows in any run.

    The hash cuts before anything is moved, and the limit only guards against many equal keys.
    """
    if total <= rows:
        return frame
    span = 1 << 30
    cut = int(span * rows / total)
    return frame.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(span)) < cut).limit(2 * rows)


def free_names(frame: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with so many underscores before it that no column of the frame has it (in any case of letters)."""
    taken, out = {name.lower() for name in frame.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class BitFilter:
    """Numbers of 64 bits as a fixed number of bits: holds every number that is in it, and some that are not."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, dtype=np.uint8)
        self.shift = np.uint64(64 - (8 * len(bits)).bit_length() + 1)

    def holds(self, values: np.ndarray) -> np.ndarray:
        at = values.view(np.uint64) >> self.shift
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def bit_filter(numbers: DataFrame, column: str, bits: int, tidy: bool = False) -> bytes:
    """The well-mixed numbers of a column for ``BitFilter``: ``2 ** bits`` bits, whatever there are. ``tidy``: no shuffle file is left behind."""
    place = numbers.select((F.shiftrightunsigned(column, 64 - bits) + 1).alias("place"))
    pieces = place.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    pieces = cut_lineage(pieces, tidy=True) if tidy else pieces
    out = bytearray(1 << (bits - 3))
    for row in pieces.toLocalIterator():
        low = (row["bucket"] - 1) * len(row["bits"])
        out[low : low + len(row["bits"])] = row["bits"]
    return bytes(out)
