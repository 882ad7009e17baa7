"""Operator 9: language identification by averaged hashed subword embeddings.

A text's subwords are the byte n-grams of its lower-cased letters (other
signs become one blank, which marks word ends). Each is hashed to a row of an
embedding matrix; the average of the rows goes through a linear softmax. Both
are trained together by stochastic gradient descent in NumPy on a bounded
sample of labelled rows. A part of that sample is kept back to calibrate the
temperature of the softmax and the score under which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.llm.shared import ids_and_text, slices_by_bytes, small_batches
from polarmesh.llm.textops import LOWER, utf8

ORDERS = (2, 3, 4)
UNDETERMINED = "und"
#: A letter of any script.
HAS_LETTER = r"\p{L}"


def subwords(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order: hashed subwords of all texts in order, and the offset of each text among them."""
    low = LOWER[data]
    if len(data) > 1:  # capitals of Latin-1, whose second byte follows 0xC3
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][capital] += 0x20
    letter = ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
    low[~letter] = 0x20
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    keep = letter.copy()
    if len(low):
        keep[1:] |= letter[:-1] & ~edge[1:-1]  # the first blank after a word stays
    low, by_text = low[keep].astype(np.uint32), np.concatenate([[0], np.cumsum(keep)])[offsets]
    out = []
    for n in ORDERS:
        code = np.full(max(0, len(low) - n + 1), n, np.uint32)
        for k in range(n):
            code = (code ^ low[k : k + len(code)]) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        # of each text, those that begin early enough to end in it
        inside = np.zeros(len(code) + 1, np.int32)
        stop = np.maximum(by_text[1:] - n + 1, by_text[:-1])
        np.add.at(inside, np.minimum(by_text[:-1], len(code)), 1)
        np.add.at(inside, np.minimum(stop, len(code)), -1)
        kept = np.cumsum(inside[:-1]) > 0
        counts = np.concatenate([[0], np.cumsum(stop - by_text[:-1])])
        out.append(((code >> np.uint32(32 - bits))[kept], counts))
    return out


def sums(values: np.ndarray, by_text: np.ndarray) -> np.ndarray:
    """The sum of the rows of each text; zeros for a text without rows."""
    out = np.zeros((len(by_text) - 1, values.shape[1]), np.float64)
    full = np.diff(by_text) > 0
    if full.any():
        out[full] = np.add.reduceat(values, by_text[:-1][full], axis=0, dtype=np.float64)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """`logits` has the contribution of each subword to each language, the embedding times the softmax's weights."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    bits: int
    temperature: float
    reject_below: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, n = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
        for codes, by_text in subwords(data, offsets, self.bits):
            total += sums(self.logits[codes], by_text)
            n += np.diff(by_text)
        return softmax((total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)


BITS = 15


def bags(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct hashed subwords of each text and their shares of all its subwords."""
    by_order = subwords(data, offsets, bits)
    out = []
    for k in range(len(offsets) - 1):
        codes, counts = np.unique(np.concatenate([c[at[k] : at[k + 1]] for c, at in by_order]), return_counts=True)
        out.append((codes, (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], bits: int = BITS, dimension: int = 16, epochs: int = 6, rate: float = 0.5, reject_quantile: float = 0.0005, seed: int = 7) -> Model:
    """Trains on nine tenths of the rows; the rest calibrate the temperature and the rejection.

    A text is rejected below the `reject_quantile` of the scores of the kept-back texts
    that were labelled right, or half of a sure score where that is less.
    """
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / dimension, 1 / dimension, (1 << bits, dimension)).astype(np.float32)
    weights, bias = np.zeros((dimension, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    order = rng.permutation(len(bags))
    kept_back, train = order[: len(order) // 10], order[len(order) // 10 :]
    step, steps = 0, max(1, epochs * len(train))
    for _ in range(epochs):
        for i in rng.permutation(train):
            codes, share = bags[i]
            now = rate * (1 - step / steps)
            step += 1
            if not len(codes):
                continue
            rows = embedding[codes]
            mean = share @ rows
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weights @ p
            weights -= now * np.outer(mean, p)
            bias -= now * 0.1 * p
            # the sum of a text's gradients over its rows is scaled up, as each row has a small share of the mean
            embedding[codes] = rows - now * 50 * share[:, None] * back
    logits = embedding @ weights
    if len(kept_back) < 10:
        kept_back = order
    own = np.array([bags[i][1] @ logits[bags[i][0]] + bias for i in kept_back]).reshape(len(kept_back), -1)
    truth = y[kept_back]
    grid = np.geomspace(0.05, 5, 60)
    losses = [-np.log(np.maximum(softmax(own / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = softmax(own / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    floor = 1 / len(languages)
    reject = min(float(np.quantile(right, reject_quantile)) if len(right) else floor, 0.5 + floor / 2) * 0.999
    return Model(languages, logits, bias, bits, temperature, reject)


def bounded_sample(labelled: DataFrame, rows: int, by: tuple[str, ...] = ("doc_id",), seed: int = 11) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of these columns, equal rows once: one count, a filter, and a shuffle of what it leaves."""
    n = labelled.count()
    if n <= rows:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1_000_003)) < int(1_000_003 * rows / n)).distinct()


def train(docs: DataFrame, sample_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", bits: int = BITS, **options) -> Model:
    """A model from at most about `sample_rows` rows of `docs` that have a label.

    Only their bags of hashed subwords come to the driver, each of at most
    2**bits entries however long its text.
    """
    labelled = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where(F.col("label").isNotNull())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", 250_000):
                made = bags(*utf8(part.column("text")), bits)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), *(pa.array([np.asarray(b[k], kind).tobytes() for b in made], pa.binary()) for k, kind in enumerate(("<u4", "<f4")))], ["id", "label", "codes", "shares"])

    small_batches(docs.sparkSession)
    rows = bounded_sample(labelled, sample_rows, ("id", "text")).where(F.col("text").rlike(HAS_LETTER)).mapInArrow(describe, "id string, label string, codes binary, shares binary").toPandas()
    if rows.empty:
        return Model([UNDETERMINED], np.zeros((1 << 8, 1), np.float32), np.zeros(1, np.float32), 8, 1.0, 0.0)
    rows = rows.sort_values(["id", "codes", "shares", "label"])  # so that training doesn't hang on the order of partitions
    return fit([(np.frombuffer(c, "<u4"), np.frombuffer(x, "<f4")) for c, x in zip(rows["codes"], rows["shares"], strict=True)], rows["label"].tolist(), bits, **options)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, lang_pred, score (0 to 1), rejected.

    A text that is null or has no letter gets `und`, score 0, and is rejected;
    so is one whose calibrated score lies below the model's threshold, which
    still gets its likeliest language. Null ids stay null, repeated rows give
    a row each, other columns are dropped, ties go to the language that sorts
    first, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = pa.array(own.languages, pa.string())
        for batch in batches:
            for part in slices_by_bytes(batch, "text", 250_000):
                p = own.probabilities(*utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("has_letter"), names.take(pa.array(p.argmax(axis=1))), pa.array(p.max(axis=1), pa.float64())], ["doc_id", "has_letter", "lang", "p"])

    source = ids_and_text(docs, id_col, text_col).withColumn("has_letter", F.col("text").rlike(HAS_LETTER))
    kind = source.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(predict, f"doc_id {kind}, has_letter boolean, lang string, p double")
    known = F.col("has_letter")
    return out.select(
        "doc_id",
        F.when(known, F.col("lang")).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(known, F.col("p")).otherwise(F.lit(0.0)).alias("score"),
        (~known | (F.col("p") < model.reject_below)).alias("rejected"),
    )
