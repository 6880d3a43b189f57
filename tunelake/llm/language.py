"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths run over them; each filter keeps its maximum in a window;
a softmax over the pooled values gives the language. The network is trained in numpy on a bounded sample
of labelled texts and applied to windows of fixed length that cover the whole of every text. The score
of a text is the mean over its windows, weighted by their bytes.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no labelled text at all
every row is ``und``, with one label only that label is predicted with score 1; equal texts get equal
results; an empty table gives no rows; other columns are not read, and ``language`` over columns
keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import documents, held_out, thinned

WINDOW = 512
#: At most about this many labelled texts are read for training, whatever the input is.
SAMPLE_TEXTS = 4000
#: A longer training text gives so many characters, in windows drawn from all of it.
SAMPLE_CHARS = 4096
UNDETERMINED = "und"
#: The fold that is never learned from.
FOLDS, HELD_OUT_FOLD = 3, 1
_WIDTHS = (2, 3, 4)
_FILTERS, _DIMS = 16, 8
_PAD = 0


@dataclass
class Network:
    """Weights; prediction needs only tables that are sums of them per pair of bytes."""

    labels: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    shift: np.ndarray | None = None
    output: np.ndarray | None = None
    bias: np.ndarray | None = None

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width: (offset, table over byte pairs); the sum over its lookups is the convolution."""
        found = {}
        for width, weights in self.filters.items():
            single = [self.embedding @ weights[place] for place in range(width)]
            parts = []
            for place in range(0, width, 2):
                left, right = single[place], single[place + 1] if place + 1 < width else np.zeros_like(single[place])
                parts.append((place, (left[:, None, :] + right[None, :, :]).reshape(65536, -1).astype(np.float32)))
            found[width] = parts
        return found


def to_bytes(text: str) -> np.ndarray:
    """UTF-8 bytes with ASCII letters in lower case."""
    return np.frombuffer(text.encode("utf-8", "replace").lower(), dtype=np.uint8)


def windows(codes: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, side by side; the last one is padded."""
    count = max(1, -(-len(codes) // length))
    out = np.full(count * length, _PAD, dtype=np.uint8)
    out[: len(codes)] = codes
    return out.reshape(count, length)


def _softmax(values: np.ndarray) -> np.ndarray:
    values = np.exp(values - values.max(axis=1, keepdims=True))
    return values / values.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], steps: int = 500, batch: int = 64, length: int = 256, seed: int = 7) -> Network | None:
    """Adam on random windows; classes are drawn alike whatever their share. None without labels."""
    names = sorted(set(labels))
    if not names:
        return None
    draw = np.random.default_rng(seed)
    network = Network(names, draw.normal(0, 0.5, (256, _DIMS)))
    network.embedding[_PAD] = 0
    network.filters = {w: draw.normal(0, 0.5 / np.sqrt(w), (w, _DIMS, _FILTERS)) for w in _WIDTHS}
    pooled_size = _FILTERS * len(_WIDTHS)
    network.shift = np.zeros(pooled_size)
    network.output = draw.normal(0, 0.1, (pooled_size, len(names)))
    network.bias = np.zeros(len(names))
    if len(names) == 1:
        return network
    codes = [to_bytes(text) for text in texts]
    members = [[i for i, label in enumerate(labels) if label == name and len(codes[i])] for name in names]
    members = [m if m else [0] for m in members]
    params = {"embedding": network.embedding, "shift": network.shift, "output": network.output, "bias": network.bias}
    params |= {f"filter{w}": network.filters[w] for w in _WIDTHS}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    for step in range(1, steps + 1):
        classes = draw.integers(0, len(names), batch)
        rows = np.full((batch, length), _PAD, dtype=np.uint8)
        for row, name in enumerate(classes):
            text = codes[members[name][draw.integers(len(members[name]))]]
            # Short windows among the long ones teach the network short texts.
            size = length if draw.random() < 0.6 else int(draw.integers(12, length))
            start = int(draw.integers(0, max(1, len(text) - size + 1)))
            part = text[start : start + size]
            rows[row, : len(part)] = part
        embedded = network.embedding[rows]
        pooled, places = [], {}
        for width in _WIDTHS:
            weights = network.filters[width]
            count = length - width + 1
            response = sum(embedded[:, k : k + count] @ weights[k] for k in range(width))
            places[width] = response.argmax(axis=1)
            pooled.append(np.take_along_axis(response, places[width][:, None, :], axis=1)[:, 0])
        raw = np.concatenate(pooled, axis=1) + network.shift
        active = np.tanh(raw)
        chance = _softmax(active @ network.output + network.bias)
        chance[np.arange(batch), classes] -= 1
        error = chance / batch
        grads = {"output": active.T @ error + 1e-4 * network.output, "bias": error.sum(axis=0)}
        back = (error @ network.output.T) * (1 - active**2)
        grads["shift"] = back.sum(axis=0)
        grads["embedding"] = np.zeros_like(network.embedding)
        for index, width in enumerate(_WIDTHS):
            part = back[:, index * _FILTERS : (index + 1) * _FILTERS]
            change = np.zeros_like(network.filters[width])
            for k in range(width):
                # Only the place of the maximum takes part in the gradient.
                at = places[width] + k
                values = rows[np.arange(batch)[:, None], at]
                change[k] = np.einsum("bfd,bf->df", network.embedding[values], part)
                np.add.at(grads["embedding"], values, part[:, :, None] * network.filters[width][k].T[None])
            grads[f"filter{width}"] = change
        grads["embedding"][_PAD] = 0
        rate = 0.02 * (1 - 0.9 * step / steps)
        for name, value in params.items():
            first, second = moments[name]
            first += 0.1 * (grads[name] - first)
            second += 0.001 * (grads[name] ** 2 - second)
            value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return network


def window_chances(network: Network, rows: np.ndarray, tables=None) -> np.ndarray:
    """Softmax of every window: the convolution as lookups per pair of bytes."""
    tables = tables or network.tables()
    length = rows.shape[1]
    wide = rows.astype(np.int32)
    pairs = np.zeros_like(wide)
    pairs[:, :-1] = wide[:, :-1] * 256 + wide[:, 1:]
    pairs[:, -1] = wide[:, -1] * 256 + _PAD
    pooled = []
    for width, parts in tables.items():
        count = length - width + 1
        total = None
        for offset, table in parts:
            found = np.take(table, pairs[:, offset : offset + count], axis=0)
            total = found if total is None else np.add(total, found, out=total)
        pooled.append(total.max(axis=1))
    active = np.tanh(np.concatenate(pooled, axis=1) + network.shift)
    return _softmax(active @ network.output + network.bias)


def predictions(network: Network, texts: list[str], batch: int = 64, tables=None) -> tuple[np.ndarray, np.ndarray]:
    """Label numbers and scores of whole texts, window batches of fixed size at a time."""
    tables = tables or network.tables()
    sums = np.zeros((len(texts), len(network.labels)))
    held, owners, sizes, waiting = [], [], [], 0

    def flush() -> None:
        nonlocal held, owners, sizes, waiting
        if not waiting:
            return
        rows, owner, size = np.concatenate(held), np.concatenate(owners), np.concatenate(sizes)
        for low in range(0, len(rows), batch):
            part = slice(low, low + batch)
            np.add.at(sums, owner[part], window_chances(network, rows[part], tables) * size[part, None])
        held, owners, sizes, waiting = [], [], [], 0

    for number, text in enumerate(texts):
        codes = to_bytes(text)
        rows = windows(codes)
        size = np.full(len(rows), float(WINDOW))
        size[-1] = max(1, len(codes) - WINDOW * (len(rows) - 1))
        held.append(rows)
        owners.append(np.full(len(rows), number))
        sizes.append(size)
        waiting += len(rows)
        if waiting >= 16 * batch:
            flush()
    flush()
    best = sums.argmax(axis=1)
    return best, sums[np.arange(len(texts)), best] / sums.sum(axis=1)


def drawn_windows(text: Column, key: Column) -> Column:
    """Texts up to ``SAMPLE_CHARS`` whole, of longer ones so many characters in windows drawn from the whole text by the hash of a key."""
    count = SAMPLE_CHARS // WINDOW
    low = lambda n: F.pmod(F.xxhash64(key, n), F.length(text) - WINDOW).cast("int") + 1
    parts = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda n: F.substring(text, low(n), F.lit(WINDOW)))
    return F.when(F.length(text) > SAMPLE_CHARS, F.array_join(parts, "\n")).otherwise(text)


def fit(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> Network | None:
    """Train on about ``sample_texts`` labelled rows outside the held-out fold."""
    rows = frame.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(label_column).cast("string").alias("label")
    ).filter(F.col("label").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(~held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD))
    total = rows.count()
    sample = thinned(rows, F.col("doc_id"), total, sample_texts)
    table = sample.select("doc_id", "label", drawn_windows(F.col("text"), F.col("doc_id")).alias("text")).toPandas()
    table = table.sort_values(["doc_id", "text"], kind="stable")
    return train(table["text"].tolist(), table["label"].tolist())


def language(network: Network | None, text: Column) -> Column:
    """Struct of ``lang`` and ``score`` for a text column."""
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    nothing = F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"))
    if network is None:
        return nothing

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = network.tables()
        for batch in batches:
            best, score = predictions(network, [text or "" for text in batch], tables=tables)
            yield pd.DataFrame({"lang": [network.labels[n] for n in best], "score": np.clip(score, 0, 1)})

    return F.when(letters, predict(text)).otherwise(nothing)


def identify(frame: DataFrame, network: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: fold, predicted language, score."""
    rows = documents(frame, id_column, text_column)
    found = rows.select("doc_id", language(network, F.col("text")).alias("found"))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )
