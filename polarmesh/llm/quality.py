"""Operator 4: a quality classifier by gated attention over passages.

A text is a bag of passages (consecutive byte ranges of equal length; all of
them, whatever the text's length). Each passage is described by the shares of
character classes, of pairs of adjacent classes, and by how its words repeat;
a layer encodes it, gated attention (tanh times sigmoid) weighs it against the
other passages of its text, and the weighted sum of the encodings is scored.
All weights are learnt together, from labels of whole texts, by Adam in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.llm.langid import bounded_sample
from polarmesh.llm.shared import ids_and_text, slices_by_bytes
from polarmesh.llm.textops import utf8, word_starts, words

PASSAGE_BYTES = 512
CLASSES = 18
_GROUPS = ["!?", ".", ",;:", "|", "#$%&", "*_~^=+", "-", "'\"`", "()[]{}", "<>/\\@"]


def _classes() -> np.ndarray:
    b = np.arange(256)
    out = np.full(256, 17, np.int64)
    out[(b >= 97) & (b <= 122)] = 0
    out[(b >= 65) & (b <= 90)] = 1
    out[(b >= 48) & (b <= 57)] = 2
    out[32] = 3
    out[[9, 10, 11, 12, 13]] = 4
    out[(b >= 0x80) & (b < 0xC0)] = 5
    out[b >= 0xC0] = 6
    for k, group in enumerate(_GROUPS):
        out[[ord(c) for c in group]] = 7 + k
    return out


CLASS_OF = _classes()
WIDTH = CLASSES + CLASSES * CLASSES + 6


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the offset of each text among them (an empty text has none)."""
    n_bytes = np.diff(offsets)
    made = -(-n_bytes // PASSAGE_BYTES)
    by_text = np.concatenate([[0], np.cumsum(made)])
    total = int(by_text[-1])
    out = np.zeros((total, WIDTH), np.float32)
    if not total:
        return out, by_text
    passage = np.repeat(by_text[:-1], n_bytes) + (np.arange(len(data)) - np.repeat(offsets[:-1], n_bytes)) // PASSAGE_BYTES
    kind = CLASS_OF[data]
    size = np.bincount(passage, minlength=total)[:, None]
    out[:, :CLASSES] = np.bincount(passage * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES) / size
    pair = passage[1:] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:]
    inside = np.ones(len(data), bool)
    inside[offsets[:-1][n_bytes > 0]] = False  # the byte before a text's first is another text's
    pair = pair[inside[1:]]
    out[:, CLASSES : CLASSES + CLASSES**2] = np.bincount(pair, minlength=total * CLASSES**2).reshape(total, -1) / size
    hashes, words_by_text = words(data, offsets)
    n_words = np.diff(words_by_text)
    if len(hashes):
        at = word_starts(data, offsets)
        own = passage[at]
        text = np.repeat(np.arange(len(n_words)), n_words)
        key = hashes ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        new = np.bincount(own, weights=first, minlength=total)
        count = np.bincount(own, minlength=total)
        out[:, -6] = new / np.maximum(count, 1)
        out[:, -5] = count / size[:, 0] * 5
        share = np.bincount(text, weights=first, minlength=len(n_words)) / np.maximum(n_words, 1)
        out[:, -4] = np.repeat(share, made)
    out[:, -3] = np.log1p(np.repeat(n_bytes, made)) / 10
    out[:, -2] = size[:, 0] / PASSAGE_BYTES
    out[:, -1] = (np.arange(total) - np.repeat(by_text[:-1], made)) / np.maximum(np.repeat(made, made), 1)
    return out, by_text


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Weights, and the passes forward and back over bags of passages."""

    def __init__(self, mean, scale, hidden=24, gate=12, seed=3):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.p = {"W": draw(len(mean), hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, by_text: np.ndarray):
        """Logits of all texts, with what the way back needs; a text without passages gets the bias alone."""
        p, n = self.p, np.diff(by_text)
        full = n > 0
        starts = by_text[:-1][full]
        xs = (x - self.mean) * self.scale
        h = np.tanh(xs @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        z = np.zeros((len(n), h.shape[1]), np.float32)
        a = np.zeros(len(e), np.float32)
        if len(e):
            e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n[full]))
            a = e / np.repeat(np.add.reduceat(e, starts), n[full])
            z[full] = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return z @ p["c"] + p["d"][0], (xs, h, t, s, a, z, full, starts, n)

    def backward(self, kept, error: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the summed loss, `error` being its derivative by the logits."""
        p, (xs, h, t, s, a, z, full, starts, n) = self.p, kept
        g = {"c": z.T @ error, "d": np.array([error.sum()])}
        dz = np.repeat(error[full, None] * p["c"], n[full], axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), n[full])) if len(a) else a
        g["w"] = (t * s).T @ de
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        g["W"], g["b"] = xs.T @ dh, dh.sum(axis=0)
        return g

    def scores(self, x: np.ndarray, by_text: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x, by_text)[0].astype(np.float64))


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 15, batch: int = 32, rate: float = 0.003, decay: float = 1e-4, seed: int = 5) -> AttentionModel:
    every = np.concatenate([b for b in bags if len(b)] or [np.zeros((1, WIDTH), np.float32)])
    scale = 1 / np.maximum(every.std(axis=0), 0.02)
    model = AttentionModel(every.mean(axis=0), scale)
    rng, y = np.random.default_rng(seed), labels.astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step, steps = 0, max(1, epochs * -(-len(bags) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = np.concatenate([bags[i] for i in rows])
            by_text = np.concatenate([[0], np.cumsum([len(bags[i]) for i in rows])])
            logits, kept = model.forward(x, by_text)
            grads = model.backward(kept, ((_sigmoid(logits) - y[rows]) / len(rows)).astype(np.float32))
            step += 1
            now = rate * (1 - step / (steps + 1))
            for k, v in model.p.items():
                m, s = moments[k]
                grad = grads[k] + decay * v
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                v -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_bytes: int = 32_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AttentionModel:
    """A model from about `sample_rows` labelled rows and `sample_bytes` bytes of their text at most, whose features alone come to the driver.

    A row with a null id or label is no example; of repeated labels of one id
    the mean decides.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    sample = F.broadcast(bounded_sample(known, sample_rows))  # bounded by sample_rows
    source = ids_and_text(docs, id_col, text_col).join(sample, "doc_id")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > sample_bytes:  # features take 1.4 times a text's bytes
        source = source.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1_000_003)) < int(1_000_003 * sample_bytes / size))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", 500_000):
                x, by_text = passages(*utf8(part.column("text")))
                bags = [x[a:b].astype(np.float16).tobytes() for a, b in zip(by_text, by_text[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(bags, pa.binary())], ["id", "label", "bag"])

    rows = source.select(F.col("doc_id").cast("string").alias("id"), "label", "text").mapInArrow(describe, "id string, label int, bag binary").toPandas()
    rows = rows.sort_values(["id", "label"])  # so that training doesn't hang on the order of partitions
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH).astype(np.float32) for b in rows["bag"]]
    if not bags:
        return AttentionModel(np.zeros(WIDTH), np.ones(WIDTH))
    return fit(bags, rows["label"].to_numpy())


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, score (0 to 1), predicted (1 if score >= 0.5).

    Every passage of the whole text counts. A null or empty text has no
    passage and gets the model's bias. Null ids stay null; repeated rows give
    a row each; other columns are dropped; an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices_by_bytes(batch, "text", 500_000):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.scores(*passages(*utf8(part.column("text")))), pa.float64())], ["doc_id", "score"])

    source = ids_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(predict, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
