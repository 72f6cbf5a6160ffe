"""Toxicity by FTRL-proximal logistic regression over hashed words.

A text's features are its distinct words, word pairs and skip-grams (two words
with one between), each hashed to one of ``2**bits`` coordinates. FTRL-proximal
keeps a learning rate per coordinate and an L1 penalty that leaves most weights
at exactly zero, so the model is a short list of (coordinate, weight) that is
broadcast to score any number of texts.

The model is fitted on a bounded sample of labelled rows: about ``max_rows`` of
them at most, chosen by a hash of their key, in one task. Rows come to it in the
order of that hash, once for each epoch, and each is forgotten when it has been
learned from, so the task holds the weights and a batch of texts, whatever the
length of the texts. Scoring is a narrow job over all rows.

Edge cases: a null text is empty and gets the score of the bias alone; labels
that are null, or whose document is missing, are ignored; without any label the
score is 0.5; repeated rows are scored each, and a column of the score's name is
replaced. Long texts are taken in stretches of ``STRETCH`` characters, cut
between words, each with the two words before it, so no pair is lost; a single
word longer than twice that is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import saved, text_of

BITS = 22
MAX_ROWS = 16_000
STRETCH = 2_000_000

_P = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
#: The end of the word before the last one, for a stretch to begin with two words of the one before.
_TWO_WORDS = re.compile(r"[a-zA-Z0-9\x80-\U0010ffff]+[^a-zA-Z0-9\x80-\U0010ffff]+[a-zA-Z0-9\x80-\U0010ffff]+[^a-zA-Z0-9\x80-\U0010ffff]*\Z")
_GAP = re.compile(r"[^a-zA-Z0-9\x80-\U0010ffff]")
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of every word, pair and skip-gram, with repeats."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    word = _IS_WORD[data]
    starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(data))
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    place[: starts[0]] = 0
    h = (data.astype(np.uint64) + np.uint64(1)) * _P[place & 63]
    h[~word] = 0
    h = _mix(np.add.reduceat(h, starts))
    of = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    a, b, c = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
    same1, same2 = of[1:] == of[:-1], of[2:] == of[:-2]
    pair = _mix(h[:-1] * a + h[1:] * b)[same1]
    skip = _mix(h[:-2] * b + h[2:] * c)[same2]
    shift = np.uint64(64 - bits)
    all_of = np.concatenate((of, of[:-1][same1], of[:-2][same2]))
    return all_of, (np.concatenate((h, pair, skip)) >> shift).astype(np.int64)


def _cut(text: str, most: int) -> list[str]:
    """A long text in parts of ``most`` characters or so, cut between words; each begins with the two words before it."""
    parts, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + most, at + 2 * most) if at + most < len(text) else None
        end = min(len(text), gap.start() if gap else at + (most if at + most >= len(text) else 2 * most))
        begin, back = at, 64
        while at and begin == at:
            if (two := _TWO_WORDS.search(text[max(0, at - back) : at])) and (two.start() or back >= at):
                begin = max(0, at - back) + two.start()
            elif back >= min(at, most):
                break
            back *= 4
        parts.append(text[begin:end])
        at = end
    return parts


def stretches(texts: list[str], most: int = STRETCH) -> Iterator[tuple[list[int], list[str]]]:
    """(text numbers, parts) of ``most`` characters or so together, in order; longer texts come in parts of their own."""
    numbers, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for part in [t] if len(t) <= most else _cut(t, most):
            if size + len(part) > most and parts:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            numbers.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, parts


def distinct_features(texts: list[str], bits: int = BITS) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, its distinct coordinates), text by text."""
    at, held = None, []
    for numbers, parts in stretches(texts):
        of, found = features(parts, bits)
        order = np.argsort(of, kind="stable")
        found, cuts = found[order], np.searchsorted(of[order], np.arange(len(parts) + 1))
        for j, n in enumerate(numbers):
            if n != at and at is not None:
                yield at, held[0] if len(held) == 1 else np.unique(np.concatenate(held))
                held = []
            at = n
            held.append(np.unique(found[cuts[j] : cuts[j + 1]]))
    if at is not None:
        yield at, held[0] if len(held) == 1 else np.unique(np.concatenate(held))


@dataclass(frozen=True)
class Model:
    """Coordinates whose weights are not 0, the weights, the bias, and the bits of a coordinate."""

    at: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS


@dataclass
class Ftrl:
    """FTRL-proximal for logistic loss on binary features (McMahan et al., 2013).

    ``alpha`` and ``l1`` have the least log loss of twelve choices that ``cross_validated`` compared on training rows.
    """

    bits: int = BITS
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1

    def __post_init__(self):
        self.z = np.zeros((1 << self.bits) + 1)
        self.n = np.zeros((1 << self.bits) + 1)
        self.bias = 1 << self.bits

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        w[i == self.bias] = -z[i == self.bias] / ((self.beta + np.sqrt(n[i == self.bias])) / self.alpha)
        return w

    def learn(self, i: np.ndarray, y: float) -> None:
        """One step on distinct coordinates ``i`` that include the bias."""
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g

    def model(self) -> Model:
        used = np.flatnonzero(self.n[:-1])
        w = self.weights(used)
        return Model(used[w != 0], w[w != 0], float(self.weights(np.array([self.bias]))[0]), self.bits)


def sampled(labels: DataFrame, label: str, key: str, max_rows: int, train: Column) -> DataFrame:
    """Labelled rows to learn from: all of them, or about ``max_rows`` chosen by a hash of the key."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & train).select(
        F.col(key).alias("key"), F.col(label).cast("double").alias("label")
    )
    share = max_rows / max(1, known.count())
    if share >= 1:
        return known
    return known.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20)) < int(share * (1 << 20)))


def _learned(rows: DataFrame, epochs: int, settings: dict) -> DataFrame:
    """``i, w``: the weights that are not 0 and, under coordinate -1, the bias. ``rows``: order, key, label, text."""

    def learn(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Ftrl(**settings)
        for batch in batches:
            ys = batch.column("label").to_pylist()
            for n, i in distinct_features(batch.column("text").to_pylist(), model.bits):
                model.learn(np.append(i, model.bias), ys[n])
        got = model.model()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(got.at, -1)), pa.array(np.append(got.weights, got.bias))], ["i", "w"])

    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ordered = each.repartition(1).sortWithinPartitions("epoch", "order", "key", "label", F.xxhash64("text"))
    # the sample is bounded by max_rows, so one task can go through it
    return ordered.select("label", "text").mapInArrow(learn, "i bigint, w double")


def labelled(docs: DataFrame, sample: DataFrame, key: str, text: str) -> DataFrame:
    """``order, key, label, text`` of the sampled rows."""
    # at most max_rows short rows: small enough to send to every task
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).join(F.broadcast(sample), "key")
    return rows.select(F.xxhash64(F.lit("order"), "key").alias("order"), "key", "label", "text")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    key: str = "doc_id",
    text: str = "text",
    train: Column | None = None,
    max_rows: int = MAX_ROWS,
    epochs: int = 3,
    **settings,
) -> Model:
    """The model. ``train`` is a condition on ``key`` for rows to learn from; ``settings`` are those of ``Ftrl``."""
    sample = sampled(labels, label, key, max_rows, F.lit(True) if train is None else train)
    got = _learned(labelled(docs, sample, key, text), epochs, settings).toArrow()
    i, w = got.column("i").to_numpy(), got.column("w").to_numpy()
    bias = w[i == -1]
    return Model(i[i >= 0], w[i >= 0], float(bias[0]) if len(bias) else 0.0, settings.get("bits", BITS))


def cross_validated(
    docs: DataFrame, labels: DataFrame, choices: list[dict], folds: int = 4, label: str = "toxic", key: str = "doc_id", text: str = "text", train: Column | None = None, max_rows: int = MAX_ROWS, threshold: float = 0.3
) -> list[dict]:
    """For each choice of settings (of ``fit``): log loss, recall and false alarms on rows that it did not learn from.

    All rows come from those that ``train`` allows; folds are dealt by a hash of the key.
    """
    sample = sampled(labels, label, key, max_rows, F.lit(True) if train is None else train)
    rows = saved(labelled(docs, sample, key, text).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "key"), F.lit(folds))), "labelled")
    out = []
    for choice in choices:
        loss = hits = alarms = toxic = clean = 0.0
        for fold in range(folds):
            own = {k: v for k, v in choice.items() if k != "epochs"}
            got = _learned(rows.where(F.col("fold") != fold).drop("fold"), choice.get("epochs", 3), own).toArrow()
            i, w = got.column("i").to_numpy(), got.column("w").to_numpy()
            model = Model(i[i >= 0], w[i >= 0], float(w[i == -1][0]), own.get("bits", BITS))
            p = F.greatest(F.lit(1e-9), F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score")))
            hit = F.col("score") >= threshold
            one = score(rows.where(F.col("fold") == fold), model).agg(
                F.sum(-F.log(p)), F.count_if(hit & (F.col("label") == 1)), F.count_if(hit & (F.col("label") == 0)), F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
            ).first()
            loss, hits, alarms, toxic, clean = (a + (b or 0) for a, b in zip((loss, hits, alarms, toxic, clean), one, strict=True))
        out.append({**choice, "log_loss": loss / max(1, toxic + clean), "recall": hits / max(1, toxic), "false_alarms": alarms / max(1, clean)})
    return out


def score_texts(texts: list[str], model: Model, dense: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1. ``dense``: the weights by coordinate."""
    hits_of, hits_at = [], []
    for numbers, parts in stretches(texts):
        of, at = features(parts, model.bits)
        hit = dense[at] != 0
        hits_of.append(np.asarray(numbers)[of[hit]])
        hits_at.append(at[hit])
    total = np.full(len(texts), model.bias)
    if hits_of:
        pairs = np.unique(np.concatenate(hits_of).astype(np.int64) << 32 | np.concatenate(hits_at))
        np.add.at(total, pairs >> 32, dense[pairs & 0xFFFFFFFF])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a column ``to``. The model goes to the executors as a broadcast of its non-zero weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name != to]

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        dense = np.zeros(1 << model.bits)
        dense[model.at] = model.weights
        for batch in batches:
            column = batch.column(text).cast(pa.string()).fill_null("")
            got = score_texts(column.to_pylist(), model, dense) if len(column) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(got, pa.float64())], [*(f.name for f in kept), to])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{to}` double"])
    return docs.mapInArrow(rows, fields)
