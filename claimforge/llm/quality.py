"""Quality classifier without labels: heuristic labellers, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.llm.common import give_back

#: Documents that the scorer is trained on, at most about: a bounded sample by hash of the text. Votes and
#: accuracies are counted over all documents.
TRAIN_ROWS = 20_000
FEATURE_BITS = 16
EPOCHS = 6
#: Words whose weights a worker keeps.
WORDS_KEPT = 100_000
#: A document is rejected when the scorer holds it for good with less than this.
THRESHOLD = 0.5

GOOD, BAD, NONE = 1, 0, -1


@dataclass(frozen=True)
class Measures:
    """What the labellers look at, of one whole text."""

    words: int
    letters: float
    upper: float
    marks: float
    repeats: float
    lines_again: float
    mean_word: float
    grams_again: float
    wordless: float


_MARKS = b"!|#*_=~<>{}[]\\^@$%&+/"
_WORDLESS = re.compile(rb"(?<!\S)[^A-Za-z0-9\x80-\xff\s]+(?!\S)")
_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_UPPER = bytes(range(0x41, 0x5B))
_BLANK = b" \t\n\r\x0b\x0c"


def _share(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def measures(text: str) -> Measures:
    """Shares are of bytes or words; beyond ASCII every byte is held for a letter. An empty text has none of anything."""
    data = text.encode()
    words = data.split()
    n, size = len(words), max(1, len(data.translate(None, _BLANK)))
    letters = _share(data, _LETTERS)
    lines = data.split(b"\n")
    threes = list(zip(words, words[1:], words[2:], strict=False))
    return Measures(
        words=n,
        letters=letters / size,
        upper=_share(data, _UPPER) / max(1, letters),
        marks=_share(data, _MARKS) / size,
        repeats=1 - len(set(words)) / n if n else 0.0,
        lines_again=1 - sum(map(len, set(lines))) / max(1, sum(map(len, lines))),
        mean_word=size / n if n else 0.0,
        grams_again=1 - len(set(threes)) / len(threes) if threes else 0.0,
        wordless=len(_WORDLESS.findall(data)) / max(1, n),
    )


def _between(x: float, good: float, bad: float) -> int:
    """Good up to ``good``, bad from ``bad``, no vote between."""
    return GOOD if x <= good else BAD if x >= bad else NONE


# The labellers, each a heuristic of common use; they overlap, and each may say nothing.
LABELLERS = (
    ("letters", lambda m: _between(1 - m.letters, 0.12, 0.25)),
    ("upper", lambda m: _between(m.upper, 0.15, 0.5)),
    ("marks", lambda m: _between(m.marks, 0.01, 0.06)),
    ("length", lambda m: GOOD if m.words >= 30 else BAD if m.words < 5 else NONE),
    ("repeats", lambda m: _between(m.repeats, 0.55, 0.85) if m.words >= 20 else NONE),
    ("lines", lambda m: _between(m.lines_again, 0.1, 0.3)),
    ("word", lambda m: GOOD if 3.0 <= m.mean_word <= 11.0 else BAD),
    ("grams", lambda m: _between(m.grams_again, 0.15, 0.5) if m.words >= 20 else NONE),
    ("wordless", lambda m: _between(m.wordless, 0.03, 0.12)),
)


def votes(text: str | None) -> str:
    """One letter a labeller: g, b or - for no vote."""
    return _said(measures(text or ""))


def _said(m: Measures) -> str:
    return "".join("-bg"[f(m) + 1] for _, f in LABELLERS)


def estimate_accuracies(patterns: dict[str, int], rounds: int = 60, prior: float = 0.85) -> tuple[np.ndarray, float, dict[str, float]]:
    """EM over counts of vote patterns: accuracies (labeller x truth), the share of good, and P(good) of each pattern.

    Labellers are held to be independent given the truth. Where they start settles which of the two
    classes is called good; pseudo-counts keep all probabilities inside (0, 1).
    """
    m = len(LABELLERS)
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([["-bg".index(c) - 1 for c in k] for k in keys]).reshape(len(keys), m)
    said, is_good = v >= 0, v == GOOD
    # P(vote good | truth), truth bad and good: labellers call most bad documents good too, each seeing its own fault.
    calls = np.array([np.full(m, 0.6), np.full(m, 0.97)])
    share, good = prior, np.full(len(keys), prior)
    for _ in range(rounds):
        p = np.log([1 - share, share]) + np.stack([np.where(said, np.where(is_good, np.log(c), np.log(1 - c)), 0).sum(axis=1) for c in calls], axis=1)
        good = 1 / (1 + np.exp(np.clip(p[:, 0] - p[:, 1], -500, 500)))
        for truth, weight in ((0, n * (1 - good)), (1, n * good)):
            seen = (weight[:, None] * said).sum(axis=0)
            calls[truth] = np.clip(((weight[:, None] * is_good).sum(axis=0) + (0.6, 0.97)[truth] * 10) / (seen + 10), 0.001, 0.999)
        share = float(np.clip((n * good).sum() / max(n.sum(), 1), 0.05, 0.98))
    right = np.stack([1 - calls[0], calls[1]], axis=1)
    return right, share, dict(zip(keys, good.tolist(), strict=True))


_MASK = (1 << FEATURE_BITS) - 1


def _steps(m: Measures) -> list[str]:
    shares = (("l", 1 - m.letters), ("u", m.upper), ("m", m.marks * 4), ("r", m.repeats / 2), ("a", m.lines_again), ("g", m.grams_again), ("p", m.wordless))
    return [f"{name}={min(9, int(x * 20))}" for name, x in shares] + [f"w={m.words.bit_length()}", f"c={min(15, int(m.mean_word))}", "one"]


def _slot(feature: bytes) -> int:
    return zlib.crc32(feature) & _MASK


def _word_scale(n: int) -> float:
    return 0.3 / max(1, n) ** 0.5


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashed features: word slots and how often each occurs, slots of the measures' steps, and the number of words.

    Words are A-Z lower-cased and weighted down by the root of their number; slots and counts are 16 bits wide.
    """
    words = (text or "").encode().lower().split()
    slots, counts = np.unique(np.fromiter(map(_slot, words), np.uint16, len(words)), return_counts=True)
    steps = np.array([_slot(b"\x00" + s.encode()) for s in _steps(measures(text or ""))], np.uint16)
    return slots, np.minimum(counts, 0xFFFF).astype(np.uint16), steps, len(words)


class _Weights(dict):
    """Word -> its weight, looked up once."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > WORDS_KEPT:
            self.clear()
        weight = self[word] = float(self.weights[_slot(word)])
        return weight


class Scorer:
    """P(good) of a text under a model."""

    def __init__(self, model: QualityModel):
        self.model, self._known = model, _Weights(model.weights)

    def __call__(self, text: str | None) -> tuple[float, str, float]:
        """(score, votes, label); a blank text is bad."""
        if not (text or "").strip():
            return 0.0, votes(text), 0.0
        m = measures(text)
        said = _said(m)
        words = text.encode().lower().split()
        total = sum(map(self._known.__getitem__, words)) * _word_scale(len(words))
        total += sum(float(self.model.weights[_slot(b"\x00" + s.encode())]) for s in _steps(m))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), said, self.model.posteriors.get(said, self.model.share)


def train(rows: list[tuple[tuple, float]], seed: int = 5) -> np.ndarray:
    """Logistic regression on soft labels by seeded AdaGrad steps, from rows (features, label)."""
    weights, seen = np.zeros(1 << FEATURE_BITS), np.full(1 << FEATURE_BITS, 1e-6)
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            (slots, counts, steps, n), y = rows[i]
            scale = _word_scale(n) * counts
            total = weights[slots] @ scale + weights[steps].sum()
            error = 1 / (1 + np.exp(-np.clip(total, -30, 30))) - y
            for at, grad in ((slots, error * scale), (steps, np.full(len(steps), error))):
                if len(at):
                    seen[at] += grad**2
                    weights[at] -= 0.2 * grad / np.sqrt(seen[at])
    return weights


def with_votes(text_col: str = "text") -> Column:
    """The vote pattern of a text column."""

    @F.pandas_udf("string")
    def pattern(text: pd.Series) -> pd.Series:
        return text.map(votes)

    return pattern(F.col(text_col))


@dataclass(frozen=True)
class QualityModel:
    """What is learnt: labeller accuracies, the share of good documents, pattern posteriors and scorer weights."""

    accuracies: np.ndarray
    share: float
    posteriors: dict[str, float]
    weights: np.ndarray


FEATURED = "mark long, said string, n int, slots binary, counts binary, steps binary"


def _featured(batches):
    """Features of a sample's texts, made where the texts are."""
    for batch in batches:
        made = [(votes(t), *features(t)) for t in (x.as_py() for x in batch.column(1))]
        cols = [[m[0] for m in made], [m[4] for m in made], *([m[i].tobytes() for m in made] for i in (1, 2, 3))]
        types = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [x.split(" ")[0] for x in FEATURED.split(", ")])
    give_back()


def fit(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on ``docs``: votes are counted over all of them, the scorer sees about ``train_rows``.

    The counts are at most 3 to the number of labellers rows. The sample is chosen by a hash of the
    text, so it is the same however the table lies; copies of a text are in it or out together and count once. Never more
    than ``2 * train_rows`` are taken, those of the smallest hashes. What comes to the driver is their hashed features,
    at most 256 KB each however long the text; null texts are not in the sample, and an empty table gives a model that holds
    everything for good or bad by the votes' prior alone.
    """
    text = F.col(text_col)
    counted = {r["v"]: r["n"] for r in docs.select(with_votes(text_col).alias("v")).groupBy("v").agg(F.count("*").alias("n")).collect()}
    right, share, posterior = estimate_accuracies(counted)
    total = sum(counted.values())
    part = min(1.0, train_rows / max(1, total))
    mark = F.xxhash64("t")
    sample = docs.select(text.alias("t")).where(text.isNotNull()).where(F.pmod(mark, F.lit(1_000_000)) < F.lit(int(part * 1_000_000) + 1))
    made = sample.select(mark.alias("mark"), "t").mapInArrow(_featured, FEATURED).dropDuplicates(["mark"])
    table = made.orderBy("mark").limit(2 * train_rows).toArrow()
    packed = lambda x: np.frombuffer(x, np.uint16)
    rows = [((packed(r["slots"]), packed(r["counts"]), packed(r["steps"]), r["n"]), posterior[r["said"]]) for batch in table.to_batches(1000) for r in batch.to_pylist()]
    weights = train(rows)
    del rows, table
    give_back()
    return QualityModel(right, share, posterior, weights)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, votes, label, keep): the scorer's P(good), the posterior of the votes, and the decision.

    The scorer decides; the posterior is what it learnt from and is returned beside it. Null, empty and blank texts are rejected with score 0. A null id stays null; repeated
    rows get the same score each; an empty table gives no rows. Further columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            scores, said, labels = zip(*(scorer(x.as_py()) for x in batch.column(1)), strict=True) if batch.num_rows else ([], [], [])
            keep = [s >= threshold for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(said, pa.string()), pa.array(labels, pa.float64()), pa.array(keep, pa.bool_())], ["doc_id", "score", "votes", "label", "keep"])
        give_back()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(scored, "doc_id long, score double, votes string, label double, keep boolean")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, judged where they lie.

    Null, empty and blank texts go. Null ids, ties and repeated rows don't matter: each row is judged by its text alone. An empty
    table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(held.value)
        for texts in parts:
            yield pd.Series([s >= threshold for s, _, _ in map(scorer, texts)], dtype=bool)
        give_back()

    return docs.where(good(F.col(text_col)))
