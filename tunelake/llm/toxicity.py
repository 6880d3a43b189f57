"""Toxicity by weak supervision.

Many voters look at a text: word lists, patterns, and word beginnings that labelled rows single out. A
generative label model (EM) estimates how often each voter fires on toxic and on clean texts, the class
balance, and how voters depend on each other beyond the class; dependent voters share their weight. The
labels take part as one more voter whose errors are estimated too. A linear classifier on word features is
trained on the posterior labels and scores whole texts.

Models are fitted on a bounded sample of labelled rows outside the held-out fold. Labels, language, source
and id are never inputs of a score.

Defined cases: a null or empty text has no features and gets the score of the bias; without any labelled row
only the word lists and patterns speak, by default rates; labels of one id are averaged; near copies in the
sample count once; equal texts get equal scores; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import documents, held_out, thinned

#: About so many labelled texts are read for fitting, whatever the input is.
SAMPLE_TEXTS = 6000
FOLDS, HELD_OUT_FOLD = 4, 2
THRESHOLD = 0.3
#: Most voters found by labels, and most features of the classifier.
MINED_VOTERS, FEATURES = 200, 4096
#: Share of accidental features among those that are learned.
FALSE_SHARE = 0.001
_PREFIXES = (3, 4, 5, 6)

# Word lists of the lexicon voters.
LEXICONS = {
    "insult": "idiot idiots moron morons imbecile cretin dumbass fool loser losers clown clowns dimwit halfwit jerk creep scumbag lowlife weirdo freak pig",
    "contempt": "stupid pathetic worthless disgusting trash scum garbage filth filthy vermin parasite useless dumb retarded ugly repulsive vile degenerate subhuman",
    "profanity": "fuck fucking fucked fucker shit shitty bullshit bitch bitches bastard asshole arsehole crap cunt dick prick piss slut whore motherfucker",
    "threat": "murder strangle stab slaughter exterminate lynch behead",
    "german": "dumm idiot trottel arschloch scheisse scheiße miststück abschaum widerlich wertlos hurensohn schlampe vollidiot penner drecksau",
    "french": "connard connasse salope merde putain imbécile crétin débile ordure minable abruti pourriture bâtard",
    "spanish": "idiota imbécil estúpido estúpida mierda puta cabrón gilipollas pendejo basura escoria asqueroso inútil patético",
}
# Patterns of the pattern voters, on lower-case text.
PATTERNS = {
    "abuse": r"(?:kill yourself|shut up|go to hell|drop dead|(?:i|we) hate (?:you|them)|nobody likes you|hope you die|get lost)",
    "address": r"you(?:'re| are)? (?:all |just |such )?(?:an? |the )?(?:idiot|moron|fool|loser|clown|stupid|pathetic|worthless|disgusting|trash|scum)",
    "masked": r"\b(?:f[*@#u]+[*@#c]*k|sh[*@#!1]+t|b[*@#!1]+tch|a[*@#$]{2}hole|1d1[o0]t|m[0o]r[0]n|l[0]ser|tr[@4]sh|st[*@u]p[!1]d)"
}
_WORD = re.compile(r"[^\W\d_]+")
_LISTED = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
_COMPILED = {name: re.compile(pattern) for name, pattern in PATTERNS.items()}


def words_of(text: str | None) -> tuple[str, set[str]]:
    lowered = (text or "").lower()
    return lowered, set(_WORD.findall(lowered))


def curated_votes(lowered: str, words: set[str]) -> list[str]:
    """Names of the word lists and patterns that fire."""
    fired = [f"list:{name}" for name, listed in _LISTED.items() if not listed.isdisjoint(words)]
    return fired + [f"pattern:{name}" for name, pattern in _COMPILED.items() if pattern.search(lowered)]


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return ["=" + word, *("^" + word[:size] for size in _PREFIXES if len(word) >= size)]


def _gain(hits: float, others: float, positives: float, negatives: float) -> float:
    """Likelihood-ratio statistic of a feature that is more frequent among positives; else 0."""
    total = positives + negatives
    expected = (hits + others) * positives / total
    if hits <= expected:
        return 0.0
    value = 0.0
    cells = ((hits, positives, hits + others), (positives - hits, positives, total - hits - others), (others, negatives, hits + others), (negatives - others, negatives, total - hits - others))
    for seen, row, column in cells:
        if seen > 0:
            value += seen * math.log(seen * total / (row * column))
    return 2 * value


def mined(word_sets: list[set[str]], weights: np.ndarray, most: int, false_share: float = FALSE_SHARE) -> list[str]:
    """Features that go with weight in at least 3 toxic texts, the best ``most``.

    As many are taken as keep the share of accidental ones, which the number of features looked at and the
    likelihood ratio of the last one give: the same rule for any number of texts.
    """
    positive = weights > 0.5
    hits: Counter[str] = Counter()
    for words, toxic in zip(word_sets, positive):
        if toxic:
            hits.update({feature for word in words for feature in word_features(word)})
    hits = Counter({feature: n for feature, n in hits.items() if n >= 3})
    others: Counter[str] = Counter()
    for words, toxic in zip(word_sets, positive):
        if not toxic:
            others.update({feature for word in words for feature in word_features(word) if feature in hits})
    up, down = float(positive.sum()), float((~positive).sum())
    if not up or not down:
        return []
    scored = [(_gain(n, others[feature], up, down), feature) for feature, n in hits.items()]
    ordered = sorted(scored, key=lambda s: (-s[0], s[1]))
    chances = [0.5 * math.erfc(math.sqrt(gain / 2)) for gain, _ in ordered]
    taken = max((n for n, chance in enumerate(chances, 1) if chance * len(ordered) <= false_share * n), default=0)
    return [feature for _, feature in ordered[: min(taken, most)]]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 40) -> dict[str, np.ndarray | float]:
    """EM over voters that fire or do not (0/1) and labels (share of toxic marks).

    Returns rates of firing on toxic and clean texts, the share of weight each voter keeps because of its
    dependence on others, the error rates of the labels, the class balance and the posterior of every text.
    """
    posterior = 0.05 + 0.9 * labels
    balance, label_rates = 0.5, (0.95, 0.05)
    count = votes.shape[1]
    toxic_rate = clean_rate = share = np.zeros(count)
    for _ in range(rounds):
        up, down = posterior.sum(), (1 - posterior).sum()
        balance = float(np.clip(up / len(posterior), 1e-3, 1 - 1e-3))
        toxic_rate = (posterior @ votes + 0.5) / (up + 1)
        clean_rate = ((1 - posterior) @ votes + 0.5) / (down + 5)
        label_rates = (float((posterior @ labels + 9) / (up + 10)), float(((1 - posterior) @ labels + 1) / (down + 10)))
        # What two voters have in common beyond the class: correlation of what the class leaves unexplained.
        expected = posterior[:, None] * toxic_rate + (1 - posterior)[:, None] * clean_rate
        rest = votes - expected
        spread = np.sqrt((rest**2).sum(axis=0) + 1e-9)
        dependence = np.abs((rest / spread).T @ (rest / spread))
        share = 1.0 / np.maximum(1.0, np.where(dependence > 0.2, dependence, 0).sum(axis=1))
        fired, silent = np.log(toxic_rate / clean_rate), np.log((1 - toxic_rate) / (1 - clean_rate))
        logit = math.log(balance / (1 - balance)) + votes @ (share * (fired - silent)) + (share * silent).sum()
        logit += labels * math.log(label_rates[0] / label_rates[1]) + (1 - labels) * math.log((1 - label_rates[0]) / (1 - label_rates[1]))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return {"toxic": toxic_rate, "clean": clean_rate, "share": share, "labels": label_rates, "balance": balance, "posterior": posterior}


def linear_classifier(rows: list[np.ndarray], size: int, target: np.ndarray, rounds: int = 300, decay: float = 2e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: full gradients with a step per weight (Adam).

    Features were chosen as signs of toxicity, so no weight goes below zero: a word beginning that one
    language uses innocently must not speak for its texts.
    """
    lengths = np.array([len(row) for row in rows])
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    weights, bias = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    first, second, first_b, second_b = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, rounds + 1):
        logit = bias + np.bincount(owner, weights[flat], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) / len(rows)
        grad = np.bincount(flat, error[owner], minlength=size) + decay * weights / size
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        first_b, second_b = 0.9 * first_b + 0.1 * error.sum(), 0.99 * second_b + 0.01 * error.sum() ** 2
        scale_1, scale_2 = 1 - 0.9**step, 1 - 0.99**step
        weights = np.maximum(0.0, weights - 0.05 * (first / scale_1) / (np.sqrt(second / scale_2) + 1e-8))
        bias -= 0.05 * (first_b / scale_1) / (np.sqrt(second_b / scale_2) + 1e-8)
    return weights, float(bias)


@dataclass(frozen=True)
class Evidence:
    """What is learned from of a whole text: its four smallest shingle hashes, the lists and patterns that fire, and its different words."""

    smallest: tuple[int, ...]
    votes: tuple[str, ...]
    words: frozenset[str]


def evidence(text: str | None) -> Evidence:
    lowered, words = words_of(text)
    parts = lowered.split()
    shingles = {zlib.crc32(" ".join(parts[n : n + 5]).encode()) for n in range(max(1, len(parts) - 4))}
    return Evidence(tuple(sorted(shingles)[:4]), tuple(curated_votes(lowered, words)), frozenset(words))


def first_of_copies(found: list[Evidence]) -> list[int]:
    """Positions of texts that share less than half of their four smallest shingle hashes with an earlier one."""
    seen: set[int] = set()
    kept = []
    for position, one in enumerate(found):
        if sum(value in seen for value in one.smallest) * 2 < len(one.smallest):
            kept.append(position)
        seen.update(one.smallest)
    return kept


@dataclass
class Model:
    """Weights of voters and word features; ``score`` needs nothing else."""

    weights: dict[str, float]
    bias: float
    voters: int = 0

    def scorer(self):
        memo: dict[str, tuple[str, ...]] = {}
        known = self.weights

        def score(text: str | None) -> float:
            lowered, words = words_of(text)
            features: set[str] = set()
            for word in words:
                found = memo.get(word)
                if found is None:
                    if len(memo) > 200_000:
                        memo.clear()
                    found = memo[word] = tuple(f for f in word_features(word) if f in known)
                features.update(found)
            features.update(f for f in curated_votes(lowered, words) if f in known)
            # Summed in a fixed order, so equal texts get equal scores everywhere.
            logit = self.bias + math.fsum(known[f] for f in features)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))

        return score


def default_model() -> Model:
    """Word lists and patterns alone, when nothing is labelled."""
    return Model({**{f"list:{n}": 3.0 for n in LEXICONS}, **{f"pattern:{n}": 3.0 for n in PATTERNS}}, -3.0, len(LEXICONS) + len(PATTERNS))


def fit(texts: list[str], labels: list[float]) -> Model:
    """Voters, label model and classifier from labelled texts."""
    return fit_evidence([evidence(text) for text in texts], labels)


def fit_evidence(looked: list[Evidence], labels: list[float]) -> Model:
    """Voters, label model and classifier from what was found in labelled texts."""
    kept = first_of_copies(looked)
    looked, marks = [looked[n] for n in kept], np.array([labels[n] for n in kept], dtype=float)
    if not looked:
        return default_model()
    word_sets = [one.words for one in looked]
    curated = [f"list:{n}" for n in LEXICONS] + [f"pattern:{n}" for n in PATTERNS]
    found = mined(word_sets, marks, MINED_VOTERS)
    names = {name: n for n, name in enumerate(curated + found)}
    votes = np.zeros((len(looked), len(names)))
    for row, one in enumerate(looked):
        fired = [*one.votes, *(f for word in one.words for f in word_features(word))]
        votes[row, [names[f] for f in fired if f in names]] = 1
    model = label_model(votes, marks)
    posterior = model["posterior"]
    features = curated + mined(word_sets, posterior, FEATURES)
    places = {feature: n for n, feature in enumerate(features)}
    rows = []
    for one in looked:
        present = {places[f] for word in one.words for f in word_features(word) if f in places}
        present |= {places[f] for f in one.votes}
        rows.append(np.array(sorted(present), dtype=np.int64))
    weights, bias = linear_classifier(rows, len(features), posterior)
    known = {feature: float(weights[n]) for feature, n in places.items() if weights[n]}
    # Lists that the sample never met keep their default voice.
    met = {name for name, column in names.items() if votes[:, column].any()}
    known |= {name: weight for name, weight in default_model().weights.items() if name not in met}
    return Model(known, bias, len(names))


def fit_table(docs: DataFrame, labels: DataFrame, sample_texts: int = SAMPLE_TEXTS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit on about ``sample_texts`` labelled rows outside the held-out fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("marked"), F.col(label_column).cast("double").alias("toxic"))
    marks = marks.filter(F.col("toxic").isNotNull() & ~held_out(F.col("marked"), FOLDS, HELD_OUT_FOLD))
    total = marks.count()
    chosen = thinned(marks, F.col("marked"), total, sample_texts).groupBy("marked").agg(F.avg("toxic").alias("toxic"))
    rows = documents(docs, id_column, text_column).filter(F.col("text").isNotNull())
    # At most twice ``sample_texts`` ids.
    rows = rows.join(F.broadcast(chosen) if total > sample_texts else chosen, F.col("doc_id") == F.col("marked"))
    # Whole texts are looked at in the tasks; what is learned from leaves them.
    table = rows.select("doc_id", "toxic", "text").mapInPandas(_looked, "doc_id long, toxic double, smallest string, votes string, words string")
    table = table.limit(4 * sample_texts).toPandas().sort_values(["doc_id", "smallest", "words"], kind="stable")
    looked = [
        Evidence(tuple(map(int, smallest.split())), tuple(votes.split()), frozenset(map(sys.intern, words.split())))
        for smallest, votes, words in zip(table["smallest"], table["votes"], table["words"])
    ]
    return fit_evidence(looked, table["toxic"].tolist())


def _looked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The evidence of every text, as words in strings."""
    for batch in batches:
        found = [evidence(text) for text in batch["text"]]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "toxic": batch["toxic"],
                "smallest": [" ".join(map(str, one.smallest)) for one in found],
                "votes": [" ".join(one.votes) for one in found],
                "words": [" ".join(sorted(one.words)) for one in found],
            }
        )


def toxicity(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for batch in batches:
            yield pd.Series([score(text) for text in batch], dtype="float64")

    return scores(text)


def score_documents(frame: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: fold, score, and whether the score reaches the threshold."""
    rows = documents(frame, id_column, text_column).select("doc_id", toxicity(model, F.col("text")).alias("score"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
