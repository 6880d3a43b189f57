"""Byte-level BPE: encode whole texts by a local rank file, and decode ids to raw bytes.

Texts are encoded by the tiktoken library. A long text is cut first where the pre-splitting pattern
always ends a match, so that no call sees more than a bounded piece unless one single match is longer.

Defined cases: a null text counts as empty and has no ids; an empty table gives an empty table; equal
rows are encoded alike, each for itself; columns other than the id and the text are ignored by the
functions over tables and kept by those over columns.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import documents

#: Characters after which the next safe boundary is taken.
PIECE_CHARS = 1 << 16
#: Texts, and characters of them, whose ids a task holds before it passes them on; one text may be longer.
HELD, HELD_CHARS = 256, 1 << 20

# A match of the pattern never continues over these places, and none looks back over them: white
# space after anything else, letters next to digits, other signs after letters or digits.
_BOUNDARY = regex.compile(
    r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and one number per line."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoder of a rank file, built once per worker process."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of a text that end at safe boundaries; their ids, joined, are those of the text."""
    start = 0
    while len(text) - start > piece_chars:
        found = _BOUNDARY.search(text, start + piece_chars)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(text: str | None, path: str, pattern: str, piece_chars: int = PIECE_CHARS) -> np.ndarray:
    encoder = encoding(path, pattern)
    parts = [encoder.encode_ordinary(part) for part in pieces(text or "", piece_chars)]
    return np.concatenate([np.asarray(part, dtype=np.uint32) for part in parts])


def decode_ids(ids, path: str) -> bytes:
    """Raw bytes of the ids; they need not be whole characters."""
    table = token_bytes(path)
    return b"".join([table[token] for token in ids])


def _parts(batch: pd.Series) -> Iterator[pd.Series]:
    """A few texts at a time, so that the ids of a batch are never held together."""
    low, chars = 0, 0
    for at, text in enumerate(batch):
        size = len(text or "")
        if at > low and (at - low >= HELD or chars + size > HELD_CHARS):
            yield batch.iloc[low:at]
            low, chars = at, 0
        chars += size
    yield batch.iloc[low:]


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text as array of int."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([encode_text(text, path, pattern).astype(np.int32) for text in batch], dtype=object)

    return ids(text)


def decoded(ids: Column, path: str) -> Column:
    """Bytes of the ids; null stays null."""

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if ids is None else decode_ids(ids.tolist(), path) for ids in batch], dtype=object)

    return raw(ids)


def ids_digest(ids) -> str:
    """SHA-256 of the ids as unsigned 32-bit little-endian numbers, in lowercase hex."""
    return hashlib.sha256(np.asarray(ids).astype("<u4").tobytes()).hexdigest()


def encode_documents(frame: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` of every whole text."""
    rows = documents(frame, id_column, text_column)
    return rows.select("doc_id", encoded(F.col("text"), path, pattern).alias("ids"))


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and their ``decoded`` bytes."""
    return tokens.select("doc_id", "ids", decoded(F.col("ids"), path).alias("decoded"))


def encoded_documents(frame: DataFrame, path: str, pattern: str, keep_ids: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (if they are to be kept), ``n_tokens`` and both digests of every text.

    Both directions run in one Python pass: each further one would start workers of its own, and ids
    and bytes would travel between them.
    """
    shape = "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string".split(", ")[0 if keep_ids else 1 :]
    names = [part.split()[0] for part in shape]

    @F.pandas_udf(", ".join(shape))
    def there_and_back(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch):
                rows = []
                for text in part:
                    ids = encode_text(text, path, pattern)
                    raw = decode_ids(ids.tolist(), path)
                    facts = (len(ids), ids_digest(ids), hashlib.sha256(raw).hexdigest())
                    rows.append((ids.astype(np.int32), *facts) if keep_ids else facts)
                yield pd.DataFrame(rows, columns=names)

    found = there_and_back(F.col("text"))
    return documents(frame, id_column, text_column).select("doc_id", found.alias("found")).select("doc_id", "found.*")


def round_trip(frame: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: number of ids, digest of the ids and of the bytes decoded from them."""
    return encoded_documents(frame, path, pattern, keep_ids=False)
