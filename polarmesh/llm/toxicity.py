"""Operator 12: a toxicity classifier learnt from confirmed toxic examples and unlabelled text.

A text is the set of its words' hashed features: the word itself and its
beginnings and ends of a few lengths, which words of one stem share. Features
that stand in far more of the toxic examples than the unlabelled texts lead to
expect are kept, scaled by the logarithm of that ratio; those in fewer aren't,
as copies of one clean text would speak against toxicity, and no weight is
negative. A linear
model on them is trained by the non-negative estimator of the risk: with the
prior p of the positive class, the risk is p times the positives' loss as
positives, plus the unlabelled texts' loss as negatives less p times the
positives' loss as negatives; that difference, the negatives' share, can't be
negative in truth, and where a batch makes it so, the step goes back up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.llm.langid import bounded_sample
from polarmesh.llm.shared import ids_and_text, slices_by_bytes
from polarmesh.llm.textops import BASE, BYTE_CODES, IS_WORD, LOWER, mix, utf8

BITS = 20
AFFIXES = (4, 5, 6)
SLICE_BYTES = 1_000_000


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of all words of all texts, and the text of each; not yet distinct."""
    inside = IS_WORD[data]
    first = inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
    by_text = np.concatenate([[0], np.cumsum(first)])[offsets]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(by_text))
    starts = np.flatnonzero(first[inside])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = BYTE_CODES[LOWER[data[inside]]]
    length = np.diff(starts, append=len(low))
    powers = np.cumprod(np.full(int(length.max()), BASE, np.uint64))
    out, of = [np.add.reduceat(low * powers[np.arange(len(low)) - np.repeat(starts, length)], starts)], [text]
    for n in AFFIXES:
        long = length >= n
        for tag, at in ((1, starts[long]), (2, starts[long] + length[long] - n)):
            code = np.full(len(at), tag * 16 + n, np.uint64)
            for k in range(n):
                code = code * BASE + low[at + k]
            out.append(code)
            of.append(text[long])
    return (mix(np.concatenate(out)) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(of)


def distinct(codes: np.ndarray, text: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a text once."""
    key = np.unique((text << bits) | codes)
    return key & ((1 << bits) - 1), key >> bits


@dataclass
class Model:
    """The weight of each hashed feature, 0 for those that weren't kept, and the bias."""

    weights: np.ndarray
    bias: float
    bits: int = BITS

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, text = features(data, offsets, self.bits)
        told = self.weights[codes] != 0
        codes, text = distinct(codes[told], text[told], self.bits)
        z = np.bincount(text, weights=self.weights[codes], minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Bags:
    """The features of many texts, `at`, and the text of each, `of`."""

    def __init__(self, rows: list[np.ndarray]):
        self.n, self.at, self.of = len(rows), np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=weights[self.at], minlength=self.n)


def chosen(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, least: int = 3, surprise: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """The features kept and their scales: the log ratio of their share in positives to that in unlabelled texts.

    Kept are those in `least` positives or more whose number there is
    `surprise` standard deviations above what the unlabelled texts' share tells.
    """
    n_p, n_u = len(positive), max(1, len(unlabelled))
    in_p, in_u = (np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), minlength=size) for rows in (positive, unlabelled))
    share = (in_u + 1) / (n_u + 1)
    expected = n_p * share
    kept = np.flatnonzero((in_p >= least) & (in_p - expected >= surprise * np.sqrt(expected)))
    scale = np.log(((in_p + share) / (n_p + 1) / share)[kept])
    return kept, scale


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS, steps: int = 400, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """A model from the distinct features of each example."""
    weights = np.zeros(1 << bits, np.float32)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(weights, start, bits)
    kept, scale = chosen(positive, unlabelled, 1 << bits)
    place = np.full(1 << bits, -1)
    place[kept] = np.arange(len(kept))
    bags = [Bags([place[x][place[x] >= 0] for x in rows]) for rows in (positive, unlabelled)]
    w, b = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)  # moments of Adam
    value = np.append(np.zeros(len(kept)), start)
    for step in range(1, steps + 1):
        grad = risk_gradient(*bags, value, scale, prior)
        grad[:-1] += decay * value[:-1]
        w += 0.1 * (grad - w)
        b += 0.001 * (grad * grad - b)
        value -= rate * (1 - step / (steps + 1)) * (w / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        np.maximum(value[:-1], 0, out=value[:-1])
    weights[kept] = value[:-1] * scale
    return Model(weights, float(value[-1]), bits)


def risk_gradient(positive: Bags, unlabelled: Bags, value: np.ndarray, scale: np.ndarray, prior: float) -> np.ndarray:
    """The step's direction by the non-negative risk, with the sigmoid as loss; the bias comes last.

    The loss of a text as positive is sigmoid(-z), as negative sigmoid(z); it
    is bounded, so that a few sure texts don't outweigh the rest.
    """
    s_p, s_u = (_sigmoid(rows.sums(value[:-1] * scale) + value[-1]) for rows in (positive, unlabelled))
    slope_p, slope_u = s_p * (1 - s_p) / len(s_p), s_u * (1 - s_u) / len(s_u)
    if s_u.mean() >= prior * s_p.mean():
        d_p, d_u = -2 * prior * slope_p, slope_u
    else:  # the negatives' share is below zero: overfitted
        d_p, d_u = prior * slope_p, -slope_u
    grad = np.zeros_like(value)
    for d, rows in ((d_p, positive), (d_u, unlabelled)):
        grad[:-1] += np.bincount(rows.at, weights=d[rows.of], minlength=len(scale)) * scale
        grad[-1] += d.sum()
    return grad


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def bounded(rows: DataFrame, most_rows: int, most_bytes: int, seed: int) -> DataFrame:
    """A sample of `rows` (id, text), chosen by a hash of both, of about so many rows and bytes of text at most; equal rows once."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, most_rows / max(1, n), most_bytes / max(1, size))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(1_000_003)) < int(1_000_003 * share))
    return rows.distinct()


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, sample_rows: int = 4000, sample_bytes: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Model:
    """A model from the texts of `docs` that `labels` calls 1, and from texts of `docs` whatever their label.

    `prior` is the share of toxic texts; None takes the share among the
    labels, or 0.1 where these have but one value. Of each kind, a sample of
    about `sample_rows` rows and `sample_bytes` bytes of text at most is
    fitted on; the driver gets its distinct hashed features, at most 2**bits
    a text. Null ids and labels are no examples; of repeated labels of one id
    the mean decides.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.avg(label_col) >= 0.5).alias("toxic"))
    if prior is None:
        ones, every = known.agg(F.count_if("toxic"), F.count("*")).first()
        prior = ones / every if 0 < ones < every else 0.1
    texts = ids_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    toxic = F.broadcast(bounded_sample(known.where("toxic").select("doc_id"), sample_rows))  # bounded by sample_rows
    marked = texts.join(toxic, "doc_id", "left_semi")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE_BYTES):
                codes, text = distinct(*features(*utf8(part.column("text"))))
                ends = np.searchsorted(text, np.arange(len(part) + 1))
                bags = [codes[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(bags, pa.binary())], ["id", "bag"])

    found = []
    for rows, seed in ((marked, 3), (texts, 4)):
        sample = bounded(rows.select(F.col("doc_id").cast("string").alias("id"), "text"), sample_rows, sample_bytes, seed)
        bags = sample.mapInArrow(describe, "id string, bag binary").toArrow().sort_by([("id", "ascending"), ("bag", "ascending")])
        found.append([np.frombuffer(x, "<u4").astype(np.int64) for x in bags.column("bag").to_pylist()])
    return fit(*found, prior, **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, score (0 to 1), predicted (1 if score >= 0.5).

    All words of the whole text count, each distinct feature once. A null or
    empty text, or one without words, gets the model's bias. Null ids stay
    null; repeated rows give a row each; other columns are dropped; an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.scores(*utf8(part.column("text"))), pa.float64())], ["doc_id", "score"])

    source = ids_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(predict, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
