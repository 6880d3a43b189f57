import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from helpers import table
from tunelake.llm import tokens

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", " ", "a", "Hello  world's   123 tests\n\n  x", "ñandú ça 😀😀 é", "\t\n \r\n", "x" * 3000, "word 12, " * 4000, "don't" * 900, "     a", "a", "\x00�<|endoftext|>"]


def plain(text):
    encoder = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=tokens.read_ranks(PATH), special_tokens={})
    return encoder.encode_ordinary(text or "")


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 16])
def test_pieces_give_the_ids_of_the_whole(piece):
    for text in TEXTS:
        assert "".join(tokens.pieces(text or "", piece)) == (text or "")
        assert tokens.encode_text(text, PATH, PATTERN, piece).tolist() == plain(text)


def test_round_trip(spark):
    found = {r["doc_id"]: r for r in tokens.round_trip(table(spark, TEXTS), PATH, PATTERN).collect()}
    assert len(found) == len(TEXTS)
    for n, text in enumerate(TEXTS):
        ids = plain(text)
        assert found[n]["n_tokens"] == len(ids)
        assert found[n]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert found[n]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_and_decode_tables(spark):
    ids = tokens.encode_documents(table(spark, TEXTS), PATH, PATTERN)
    for row in tokens.decode_documents(ids, PATH).collect():
        assert bytes(row["decoded"]).decode() == (TEXTS[row["doc_id"]] or "")


def test_empty_table(spark):
    assert tokens.round_trip(table(spark, []), PATH, PATTERN).count() == 0


def test_few_ids_are_held_at_once():
    import pandas as pd

    texts = pd.Series(["ab"] * 600 + [None, "x" * (tokens.HELD_CHARS + 1), "y", ""] + ["z" * (tokens.HELD_CHARS // 2)] * 5, dtype=object)
    parts = list(tokens._parts(texts))
    assert pd.concat(parts).equals(texts) and all(0 < len(p) <= tokens.HELD for p in parts)
    assert all(len(p) == 1 or p.map(lambda t: len(t or "")).sum() <= tokens.HELD_CHARS for p in parts)
    assert [len(p) for p in tokens._parts(pd.Series([], dtype=object))] == [0]
