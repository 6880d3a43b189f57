"""Benchmark decontamination by pigeonhole edit matching.

Documents and test items are normalised (lower case, runs of white space as one space, none at the ends).
A document is contaminated by an item if some part of it is within the item's error budget, a share of the
item's length, in edit distance. An item of budget k is cut into k + 1 pieces. One of them must occur
exactly, so all pieces of all items are searched for at once (Aho-Corasick). A hit is verified by Myers'
bit-parallel distance, first on the piece and its neighbour, then on twice as many pieces: a group of m
pieces may have m - 1 errors, which is again the pigeonhole principle and rules out chance hits early.

Items are handed to the tasks in blocks of a fixed number of characters; every block reads all documents.

Defined cases: a null or empty text matches nothing; null and blank items match nothing; equal items are
reported each under its id; equal documents are reported each; of several matches of one item in a document
the best, then the first that ends, is reported; empty tables give no rows; other columns are not read, and
``contaminated`` over columns keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import documents

#: Errors per character of an item.
ERROR_SHARE = 0.1
#: Pieces are at least so long; a short item gets a smaller budget.
MIN_PIECE = 9
#: Characters of items per block.
BLOCK_CHARS = 4_000_000


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, share: float = ERROR_SHARE) -> int:
    """Errors allowed for an item: a share of its length, as long as pieces keep their least length."""
    return max(0, min(int(share * length), length // MIN_PIECE - 1))


def letters(pattern: str) -> dict[str, int]:
    """Bits of the places of every character."""
    found: dict[str, int] = {}
    for place, letter in enumerate(pattern):
        found[letter] = found.get(letter, 0) | 1 << place
    return found


def best_match(places: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Smallest edit distance between the pattern and any part of ``text``, and where the first such part ends."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    get = places.get
    for at, letter in enumerate(text, 1):
        equal = get(letter, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, end = score, at
    return best, end


class Items:
    """Test items with their pieces and one automaton over all of them."""

    def __init__(self, items: list[tuple[int, str]], share: float = ERROR_SHARE):
        import ahocorasick

        self.texts: list[str] = []
        self.ids: list[list[int]] = []
        numbers: dict[str, int] = {}
        for item_id, text in items:
            plain = normalise(text or "")
            if plain:
                number = numbers.setdefault(plain, len(numbers))
                if number == len(self.texts):
                    self.texts.append(plain)
                    self.ids.append([])
                self.ids[number].append(item_id)
        self.cuts: list[list[int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for number, plain in enumerate(self.texts):
            parts = budget(len(plain), share) + 1
            cuts = [len(plain) * n // parts for n in range(parts + 1)]
            self.cuts.append(cuts)
            for n in range(parts):
                pieces.setdefault(plain[cuts[n] : cuts[n + 1]], []).append((number, n))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()
        self.masks: dict[tuple[int, int, int], tuple[dict[str, int], int]] = {}

    def _pattern(self, number: int, low: int, high: int) -> tuple[dict[str, int], int]:
        key = (number, low, high)
        if key not in self.masks:
            cuts = self.cuts[number]
            part = self.texts[number][cuts[low] : cuts[high]]
            self.masks[key] = (letters(part), len(part))
        return self.masks[key]

    def _verify(self, number: int, piece: int, start: int, text: str) -> tuple[int, int] | None:
        """Distance and end of the whole item around a piece that starts at ``start``; None beyond the budget."""
        cuts = self.cuts[number]
        low, high = piece, piece + 1
        parts = len(cuts) - 1
        for above_low, above_high in _path(parts, piece):
            low, high = above_low, above_high
            errors = high - low - 1
            places, length = self._pattern(number, low, high)
            begin = max(0, start - (cuts[piece] - cuts[low]) - errors)
            finish = start + (cuts[high] - cuts[piece]) + errors
            distance, end = best_match(places, length, text[begin:finish])
            if distance > errors:
                return None
            if (low, high) == (0, parts):
                return distance, begin + end
        return 0, start + cuts[-1]

    def matches(self, text: str | None) -> dict[int, tuple[int, int]]:
        """Best (distance, end) of each item that the document holds; ends count in the normalised text."""
        found: dict[int, tuple[int, int]] = {}
        if not text or not self.texts:
            return found
        plain = normalise(text)
        tried: set[tuple[int, int]] = set()
        for last, (length, owners) in self.automaton.iter(plain):
            start = last - length + 1
            for number, piece in owners:
                # Pieces in one line tell of one and the same place.
                line = (number, start - self.cuts[number][piece])
                if line in tried:
                    continue
                seen = self._verify(number, piece, start, plain)
                if seen is not None:
                    tried.add(line)
                    if number not in found or seen < found[number]:
                        found[number] = seen
        return found


@lru_cache(maxsize=4096)
def _path(parts: int, piece: int) -> list[tuple[int, int]]:
    """Groups of pieces around one piece, from the smallest to all, halving the pieces."""
    low, high, groups = 0, parts, []
    while high - low > 1:
        groups.append((low, high))
        middle = (low + high) // 2
        low, high = (low, middle) if piece < middle else (middle, high)
    return groups[::-1]


def item_blocks(items: DataFrame, id_column: str = "item_id", text_column: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Test items block by block; the number of blocks follows from their characters."""
    rows = items.select(F.col(id_column).cast("long").alias("item_id"), F.col(text_column).cast("string").alias("item"))
    rows = rows.filter(F.col("item").isNotNull())
    chars = rows.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        yield sorted(((r["item_id"], r["item"]) for r in part.collect()), key=lambda r: (r[0] is None, r))


def find(frame: DataFrame, items: DataFrame, share: float = ERROR_SHARE, id_column: str = "doc_id", text_column: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per contaminated document and item: distance, budget, and where the match ends."""
    shape = "doc_id long, item_id long, distance int, budget int, match_end long"
    rows = documents(frame, id_column, text_column)
    found = None
    for block in item_blocks(items, block_chars=block_chars):
        part = rows.mapInPandas(_searcher(block, share), shape)
        found = part if found is None else found.unionByName(part)
    return found


def _searcher(block: list[tuple[int, str]], share: float):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Items(block, share)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for number, (distance, end) in known.matches(text).items():
                    allowed = len(known.cuts[number]) - 2
                    for item_id in known.ids[number]:
                        out.append((None if pd.isna(doc_id) else int(doc_id), item_id, distance, allowed, end))
            table = pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "budget", "match_end"])
            yield table.astype({"doc_id": "Int64", "item_id": "Int64", "distance": "int32", "budget": "int32", "match_end": "int64"})

    return search


def contaminated(text: Column, items: DataFrame, share: float = ERROR_SHARE, block_chars: int = BLOCK_CHARS) -> Column:
    """True for a text that holds any item."""
    answer = F.lit(False)
    for block in item_blocks(items, block_chars=block_chars):
        answer = answer | _holder(block, share)(text)
    return answer


def _holder(block: list[tuple[int, str]], share: float):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Items(block, share)
        for batch in batches:
            yield pd.Series([bool(known.matches(text)) for text in batch], dtype="boolean")

    return holds
