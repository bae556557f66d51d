"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models; each later model
also sees the log-odds of the categories before it.  While training, those
come from out-of-fold predictions, so later models learn from errors like the
ones they will meet.

Features are the distinct words of a text and their prefixes of four to seven
letters.  The chain is fitted on a bounded, seeded sample of the labelled rows
(``sample`` rows, a documented limit); scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1 << 20
PREFIXES = (4, 5, 6, 7)
_words = regex.compile(r"[\p{L}\p{N}]+").findall


def word_features(word: str) -> list[int]:
    """Hashed features of one word: itself and its prefixes."""
    found = [zlib.crc32(b"=" + word.encode("utf-8", "replace")) % DIM]
    found += [zlib.crc32(b"^" + word[:n].encode("utf-8", "replace")) % DIM for n in PREFIXES if len(word) >= n]
    return found


def text_features(text: str | None) -> np.ndarray:
    """Sorted distinct features of a text."""
    out: set[int] = set()
    for w in set(_words((text or "").lower())):
        out.update(word_features(w))
    return np.array(sorted(out), np.int32)


@dataclass
class Linear:
    """A linear model on selected features and on earlier log-odds."""

    features: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]


def _rows(docs: Sequence[np.ndarray], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the selected features present in each text."""
    place = np.full(DIM, -1, np.int32)
    place[features] = np.arange(len(features), dtype=np.int32)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    col = place[np.concatenate(docs)] if len(docs) else np.zeros(0, np.int32)
    hit = col >= 0
    return row[hit], col[hit]


def fit_linear(
    docs: Sequence[np.ndarray], y: np.ndarray, chain: np.ndarray, keep: int = 2000, steps: int = 400, ridge: float = 1e-3
) -> Linear:
    """Logistic regression on the ``keep`` features with the largest chi-square."""
    n, pos = len(y), float(y.sum())
    if not 0 < pos < n:
        return Linear(np.zeros(0, np.int32), np.zeros(0), np.zeros(chain.shape[1]), 8.0 if pos else -8.0)
    every = np.concatenate(docs)
    seen = np.bincount(every, minlength=DIM).astype(float)
    with_pos = np.bincount(every, np.repeat(y, [len(d) for d in docs]), minlength=DIM)
    share = pos / n
    expected = seen * share
    spread = np.maximum(seen * share * (1 - share) * (1 - seen / n), 1e-9)
    score = np.where((seen >= 3) & (seen < n), (with_pos - expected) ** 2 / spread, 0.0)
    picked = np.argsort(-score, kind="stable")[:keep]
    picked = np.sort(picked[score[picked] > 0]).astype(np.int32)
    row, col = _rows(docs, picked)
    w, c, b = np.zeros(len(picked)), np.zeros(chain.shape[1]), np.log(pos / (n - pos))
    # Adam on the full sample: deterministic, no randomness involved.
    size = len(picked) + chain.shape[1] + 1
    m, v = np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], minlength=n) + chain @ c + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.r_[np.bincount(col, g[row], minlength=len(picked)) / n + ridge * w, chain.T @ g / n + ridge * c, g.mean()]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= move[: len(picked)]
        c -= move[len(picked) : -1]
        b -= move[-1]
    return Linear(picked, w, c, float(b))


def log_odds(model: Linear, docs: Sequence[np.ndarray], chain: np.ndarray) -> np.ndarray:
    row, col = _rows(docs, model.features)
    return np.clip(np.bincount(row, model.weights[col], minlength=len(docs)) + chain @ model.chain + model.bias, -30, 30)


def fit_chain(docs: Sequence[np.ndarray], labels: np.ndarray, categories: Sequence[str], folds: int = 3) -> Chain:
    """Fit one model per category (column of ``labels``), in order.

    The input of later models is each earlier model's log-odds on folds it
    was not trained on.
    """
    n = len(docs)
    fold = np.arange(n) % folds
    chain, models = np.zeros((n, 0)), []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        models.append(fit_linear(docs, y, chain))
        if k + 1 < len(categories):
            out = np.zeros(n)
            for f in range(folds):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if len(inside) and len(outside):
                    part = fit_linear([docs[i] for i in inside], y[inside], chain[inside])
                    out[outside] = log_odds(part, [docs[i] for i in outside], chain[outside])
            chain = np.column_stack([chain, out])
    return Chain(tuple(categories), models)


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, str],
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = 6000,
    seed: int = 7,
) -> Chain:
    """Fit a chain on at most ``sample`` labelled rows, in the order of a seeded hash.

    ``categories`` maps each category to a SQL condition over ``labels``.
    Rows with a null id or a null label are not used.
    """
    wanted = labels.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), *[F.expr(c).cast("int").alias(f"_y{k}") for k, c in enumerate(categories.values())]
    )
    # Of several labels of one id the largest counts, so that reruns agree.
    wanted = (
        wanted.dropna()
        .groupBy("_id")
        .agg(*[F.max(f"_y{k}").alias(f"_y{k}") for k in range(len(categories))])
        .orderBy(F.xxhash64("_id", F.lit(seed)), "_id")
        .limit(sample)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_features(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(found, pa.binary()), *b.columns[2:]], names=["_id", "_f", *b.schema.names[2:]]
            )

    ys = [f"_y{k}" for k in range(len(categories))]
    # At most `sample` rows of fixed width are broadcast.
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(
        F.broadcast(wanted), "_id"
    )
    kind = docs.schema[id_col].dataType.simpleString()
    rows = joined.mapInArrow(features, f"_id {kind}, _f binary, " + ", ".join(f"{y} int" for y in ys)).collect()
    rows.sort(key=lambda r: (r["_id"], bytes(r["_f"])))
    found = [np.frombuffer(r["_f"], np.int32) for r in rows]
    y = np.array([[r[c] for c in ys] for r in rows], float).reshape(len(rows), len(ys))
    return fit_chain(found, y, tuple(categories))


#: Words a scoring worker remembers, and the longest it remembers: at most some 15 MB.
REMEMBERED, LONGEST = 50_000, 48


class _Scorer:
    """Probabilities of texts, in chain order."""

    def __init__(self, chain: Chain):
        self.models = chain.models
        wanted = np.unique(np.concatenate([m.features for m in chain.models]))
        self.table = np.zeros((len(chain.models), len(wanted)))
        for k, m in enumerate(chain.models):
            self.table[k, np.searchsorted(wanted, m.features)] = m.weights
        self.place = {f: i for i, f in enumerate(wanted.tolist())}
        self.known: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        at = self.known.get(word)
        if at is None:
            at = tuple(self.place[f] for f in word_features(word) if f in self.place)
            if len(word) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = at
        return at

    def __call__(self, text: str | None) -> list[float]:
        hit: set[int] = set()
        for w in set(_words((text or "").lower())):
            if at := self._word(w):
                hit.update(at)
        z = self.table[:, sorted(hit)].sum(axis=1)
        before: list[float] = []
        for k, m in enumerate(self.models):
            before.append(float(np.clip(z[k] + m.bias + np.dot(m.chain, before), -30, 30)))
        return [1 / (1 + np.exp(-odds)) for odds in before]


def _score(chain: Chain, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(chain)
        for b in batches:
            out = np.array([scorer(t.as_py()) for t in b.column(1)], float).reshape(b.num_rows, len(chain.models))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(out[:, k]) for k in range(len(chain.models))]], names=schema_names
            )

    return run


def probability(text: Column, chain: Chain, category: str) -> Column:
    """The probability of ``category`` as a column: only texts go to Python, and one number a row comes back."""
    k = chain.categories.index(category)

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(chain)
        for part in parts:
            yield pa.array([scorer(t.as_py())[k] for t in part], pa.float64())

    return scored(text.cast("string"))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, p_<category> for every category)``, one row per input row.

    Null and empty texts get the probability of a text without features;
    repeated rows get equal scores; an empty table gives an empty result.  A
    category whose training labels are all equal is constant.
    """
    probs = [f"p_{c}" for c in chain.categories]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        _score(chain, [id_col, *probs]), f"`{id_col}` {kind}, " + ", ".join(f"`{p}` double" for p in probs)
    )


#: The labelled categories of the data folder, in chain order.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def toxicity(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, p_low_quality, p_toxic, is_toxic)`` for every document."""
    chain = train(docs if training_docs is None else training_docs, labels, CATEGORIES)
    return score(docs, chain).withColumn("is_toxic", F.col("p_toxic") >= threshold)
