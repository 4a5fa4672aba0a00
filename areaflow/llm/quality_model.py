"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.llm.common import first_by_hash, ship_package, small_batches, table
from areaflow.session import cut_lineage

FIT_ROWS = 8000  # trusted positives, and unlabelled texts, that the model is fitted on, at most
SEED = 11
HIDDEN = 16

_SPACE_TO_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_BYTES = np.arange(256)
# Groups of bytes whose shares describe a text.
BYTE_GROUPS = [
    (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57), _BYTES >= 128,
    _BYTES == 32, _BYTES == 10, np.isin(_BYTES, list(b".,;:")), np.isin(_BYTES, list(b"!?")), np.isin(_BYTES, list(b"#*$%&")),
    np.isin(_BYTES, list(b"|<>\\^~_")), np.isin(_BYTES, list(b"()[]{}\"'`/@=+-")), (_BYTES < 32) & ~np.isin(_BYTES, [9, 10, 13])]
NAMES = [*[f"bytes_{i}" for i in range(len(BYTE_GROUPS))], "entropy", "log_words", "log_bytes", "word_length", "word_spread",
         "distinct", "top_word", "same_as_last", "short_words", "capitals", "ends_in_mark", "same_pairs", "same_lines",
         "line_words"]


def features(text: str | None) -> list[float]:
    """Shape of a whole text: shares of byte groups, word lengths, repetition.  Zeros for a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = [w for w in raw.translate(_SPACE_TO_BLANK).split(b" ") if w]
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    used = share[share > 0]
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    often = Counter(words)
    first = np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
    last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    plain = ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | (last >= 128)
    return [*[float(share[g].sum()) for g in BYTE_GROUPS], float(-(used * np.log2(used)).sum()), float(np.log1p(n)),
            float(np.log1p(len(raw))), float(length.mean()), float(length.std()), len(often) / n, max(often.values()) / n,
            sum(map(bytes.__eq__, words[1:], words)) / n, float((length <= 3).mean()),
            float(((first >= 65) & (first <= 90)).mean()), float((~plain).mean()),
            1 - len(set(zip(words, words[1:]))) / max(1, n - 1), 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines)))]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "shape"])


@dataclass
class PuModel:
    """One hidden layer over standardised features; the sign of its answer is the class."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    slope: float = 1.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def answer(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        hidden = np.tanh(z @ w1 + b1)
        return hidden, hidden @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.answer(self.inputs(x))[1] * self.slope, -50, 50)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED) -> float:
    """Share of positives among the unlabelled: the smallest ratio of tails of a classifier between the two.

    Held-out halves of both are compared; where scores are high, the unlabelled are
    nearly all positives, so the ratio of what lies above a threshold bounds the share.
    """
    rng = np.random.default_rng(seed)
    halves = [(x[p[: len(x) // 2]], x[p[len(x) // 2:]]) for x in (positive, unlabelled) for p in [rng.permutation(len(x))]]
    (p_fit, p_held), (u_fit, u_held) = halves
    if not all(map(len, (p_fit, p_held, u_fit, u_held))):
        return 0.5
    model = fit(p_fit, u_fit, 0.5, seed, epochs=20, plain=True)
    p, u = np.sort(model.score(p_held)), np.sort(model.score(u_held))
    cuts = np.quantile(p, np.linspace(0.0, 0.9, 91))
    above_p = 1 - np.searchsorted(p, cuts, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, side="left") / len(u)
    slack = np.sqrt(np.log(20) / 2 / len(u)) + np.sqrt(np.log(20) / 2 / len(p))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED, epochs: int = 40, rate: float = 0.005,
        batch: int = 256, plain: bool = False) -> PuModel:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the sigmoid loss.

    When the second part falls below zero, a step goes up on it instead, which is what
    keeps a flexible model from fitting the unlabelled as negatives.  `plain` fits
    positives against unlabelled, for the prior.
    """
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(0), every.std(0) + 1e-6
    dim = every.shape[1]
    model = PuModel(mean, scale, [rng.normal(0, dim ** -0.5, (dim, HIDDEN)), np.zeros(HIDDEN),
                                  rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)])
    zp, zu = model.inputs(positive), model.inputs(unlabelled)
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights]
    step = 0
    for _ in range(epochs):
        order_u = rng.permutation(len(zu))
        for a in range(0, len(zu), batch):
            step += 1
            u = zu[order_u[a:a + batch]]
            p = zp[rng.integers(len(zp), size=batch)]
            z = np.concatenate([p, u])
            hidden, g = model.answer(z)
            s = 1 / (1 + np.exp(-np.clip(g, -50, 50)))
            slope = s * (1 - s)  # the loss of class y is sigmoid(-y g)
            is_p = np.arange(len(z)) < len(p)
            up = np.where(is_p, -slope / len(p), 0.0)          # gradient of R_p(+)
            down = np.where(is_p, slope / len(p), 0.0)         # gradient of R_p(-)
            free = np.where(is_p, 0.0, slope / len(u))         # gradient of R_u(-)
            if plain:
                grad = up + free
            elif s[~is_p].mean() - prior * s[is_p].mean() >= 0:
                grad = prior * up + free - prior * down
            else:
                grad = prior * down - free
            w1, b1, w2, b2 = model.weights
            back = (grad[:, None] * w2) * (1 - hidden ** 2)
            grads = [z.T @ back, back.sum(0), hidden.T @ grad, np.array([grad.sum()])]
            for w, d, (m, v) in zip(model.weights, grads, state):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w -= rate * ((m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8) + 1e-3 * w)
    return model


def _scores(model: PuModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("shape").to_pylist(), float).reshape(-1, len(NAMES))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)],
                                             ["doc_id", "held_out", "score"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Trusted positives are texts labelled 1; unlabelled are texts as they come, whatever
    their label.  Both are taken from rows with crc32(doc_id) mod 3 other than 1, the
    first `fit_rows` of each in a seeded order over all documents.  Only shapes of
    whole texts are inputs.  The share of positives among the unlabelled is estimated.
    A null text is an empty one and scores like it; a null doc_id counts as the text ""
    and has no label; labels of repeated ids are met once; without any positive every
    score is 0.5.  Reads doc_id and text, and doc_id and quality of the labels.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shapes = cut_lineage(docs.select("doc_id", "text").mapInArrow(
        _describe, f"doc_id {id_type}, shape array<double>").withColumn(
        "held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1))
    learn = shapes.where(~F.col("held_out"))
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).where(
        F.crc32(F.col("_id").cast("string").cast("binary")) % 3 != 1).distinct()

    def first(rows: DataFrame) -> np.ndarray:
        got = first_by_hash(rows, F.xxhash64("doc_id", F.lit(seed)), ["doc_id"], fit_rows).select("shape").collect()
        return np.array([r["shape"] for r in got], float).reshape(-1, len(NAMES))

    positive = first(learn.join(good, F.col("doc_id") == F.col("_id"), "left_semi"))
    unlabelled = first(learn)
    model = fit(positive, unlabelled, estimate_prior(positive, unlabelled, seed), seed) if len(positive) else None
    return shapes.select("doc_id", "held_out", "shape").mapInArrow(
        _scores(model), f"doc_id {id_type}, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op4_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
