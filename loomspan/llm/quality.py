"""Quality classifier from weak labels.

Heuristic labellers, none of which sees a human label, vote bad (0), good (1) or abstain. Expectation
maximisation over the histogram of vote patterns estimates each labeller's accuracy and the
share of good documents; the posterior of a pattern is the soft label of its documents. A bounded sample of soft
labels trains a linear scorer over hashed features of the text, and the scorer judges every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import text_or_empty, unused

DIMENSIONS = 1 << 14
#: Documents that the scorer is trained on, about: the bound of the labelled sample.
SAMPLE = 12_000
ABSTAIN = "-"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_SYMBOLS = b"#$%&*|@^~<>{}[]=_+\\!?"
_GLUED = tuple(a + b for a in "#$%&*!?@~^" for b in "#$%&*!?@~^")
CACHE = 500_000
_SHAPES: dict[str, int] = {}


def statistics(text: str, words: list[str]) -> tuple[float, float, float, float, float, float, int]:
    """Upper-case share of letters, share of symbols, distinct words, most frequent word, words equal to their predecessor, words with glued symbols, words."""
    b = text.encode("utf-8", "surrogatepass")
    n, letters = len(words), max(1, len(b) - len(b.translate(None, _LETTERS)))
    if not n:
        return 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0
    count = Counter(words)
    glued = sum(c for w, c in count.items() if w.endswith(_GLUED))
    return (
        (len(b) - len(b.translate(None, _UPPER))) / letters, (len(b) - len(b.translate(None, _SYMBOLS))) / len(b),
        len(count) / n, max(count.values()) / n, sum(map(eq, words, words[1:])) / n, glued / n, n,
    )


def votes(s: tuple) -> str:
    """One character for each labeller: 0 bad, 1 good, - no opinion."""
    upper, symbols, distinct, top, repeats, glued, n = s
    bad = (n == 0, upper > 0.3, symbols > 0.05, glued > 0.2, n >= 6 and repeats > 0.2, n >= 40 and distinct < 0.3, n >= 6 and top > 0.45)
    calm = upper < 0.15 and symbols < 0.015
    good = (n > 0 and calm and repeats < 0.05, n >= 5 and calm and distinct > 0.45 and glued < 0.03, n > 0 and calm and repeats < 0.1 and top < 0.4)
    return "".join("0" if x else ABSTAIN for x in bad) + "".join("1" if x else ABSTAIN for x in good)


def label_model(patterns: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each vote pattern, accuracy of each labeller, share of good documents."""
    if not patterns:
        return {}, np.empty(0), 0.5
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    v = np.array([[{"0": -1, "1": 1}.get(c, 0) for c in k] for k in keys], dtype=float)
    accuracy, share = np.full(v.shape[1], 0.85), 0.8
    post = np.full(len(keys), 0.5)
    for _ in range(rounds):
        log_odds = np.log(share / (1 - share)) + v @ np.log(accuracy / (1 - accuracy))
        post = 1 / (1 + np.exp(-np.clip(log_odds, -50, 50)))
        right = ((v > 0) * post[:, None] + (v < 0) * (1 - post[:, None])) * n[:, None]
        cast = (v != 0) * n[:, None]
        # four of five imagined votes are right, and no labeller is taken for worse than a coin
        accuracy = np.clip((right.sum(0) + 4) / (cast.sum(0) + 5), 0.6, 0.995)
        share = float(np.clip((post @ n + 4) / (n.sum() + 5), 0.02, 0.98))
    return dict(zip(keys, post.tolist(), strict=True)), accuracy, share


def _shape(word: str) -> int:
    at = _SHAPES.get(word)
    if at is None:
        out = []
        for c in word:
            k = "x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else "a" if c.isalpha() else c
            if out[-2:] != [k, k]:
                out.append(k)
        at = zlib.crc32("".join(out).encode("utf-8", "surrogatepass")) % (DIMENSIONS - 512) + 512
        if len(_SHAPES) > CACHE:
            _SHAPES.clear()
        if len(word) <= 64:
            _SHAPES[word] = at
    return at


def features(words: list[str], s: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes, and one of a few steps for each statistic (below 512)."""
    if words:
        at, n = np.unique(np.fromiter(map(_shape, words), dtype=np.int64, count=len(words)), return_counts=True)
        value = np.sqrt(n / len(words))
    else:
        at, value = np.empty(0, dtype=np.int64), np.empty(0)
    steps = [k * 40 + min(39, int(x * 40)) for k, x in enumerate(s[:6])] + [240 + min(39, int(np.log2(1 + s[6]) * 2))]
    return np.concatenate([at, steps]), np.concatenate([value, np.full(len(steps), 0.5)])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.4, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels, by adaptive gradient steps over small batches; the last weight is the bias."""
    w, g2 = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-3)
    if not len(rows):
        return w
    good = max(1.0, float(labels.sum()))
    balance = np.where(labels > 0.5, 1.0, min(20.0, good / max(1.0, len(labels) - good)))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            at = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            z = np.bincount(of, weights=w[at] * value, minlength=len(part)) + w[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * balance[part] / len(part)
            gradient = np.bincount(at, weights=error[of] * value, minlength=DIMENSIONS + 1)
            gradient[-1] = error.sum()
            gradient += decay * w
            g2 += gradient * gradient
            w -= rate * gradient / np.sqrt(g2)
    return w


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vote patterns of a batch, counted before anything is shuffled."""
    for batch in batches:
        count = Counter(votes(statistics(t, t.split())) for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["votes", "n"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pattern, at, value = [], [], []
        for t in batch.column(0).to_pylist():
            words = t.split()
            s = statistics(t, words)
            a, v = features(words, s)
            pattern.append(votes(s))
            at.append(a.astype(np.int32).tobytes())
            value.append(v.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.string()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["votes", "at", "value"])


def _judged(text: str, weights: np.ndarray, posterior: dict[str, float], prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern, soft, score = [], [], []
            for t in batch.column(text).to_pylist():
                words = t.split()
                s = statistics(t, words)
                a, v = features(words, s)
                pattern.append(votes(s))
                soft.append(posterior.get(pattern[-1], prior))
                score.append(float(1 / (1 + np.exp(-np.clip(weights[a] @ v + weights[-1], -30, 30)))) if words else 0.0)
            rest = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(pattern, pa.string()), pa.array(soft, pa.float64()), pa.array(score, pa.float64()), pa.array([x >= 0.5 for x in score], pa.bool_())], names=[*rest, "votes", "posterior", "quality_score", "keep"])

    return run


class QualityModel:
    def __init__(self, weights: np.ndarray, posterior: dict[str, float], accuracy: np.ndarray, share: float):
        self.weights, self.posterior, self.accuracy, self.share = weights, posterior, accuracy, share

    def judge(self, docs: DataFrame) -> DataFrame:
        """Adds ``votes, posterior, quality_score, keep`` to every row; columns of those names are replaced."""
        docs = docs.drop("votes", "posterior", "quality_score", "keep")
        text = unused(docs, "judged")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        schema += ", votes string, posterior double, quality_score double, keep boolean"
        return docs.withColumn(text, text_or_empty()).mapInArrow(_judged(text, self.weights, self.posterior, self.share), schema)


def fit(docs: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fits the label model on the votes on all documents and the scorer on about ``sample`` of them, drawn by hash of text and doc_id, twice as many at most.

    To the driver come the histogram of vote patterns and the features of the sample, packed.
    """
    texts = docs.select(text_or_empty().alias("text"), *(["doc_id"] if "doc_id" in docs.columns else []))
    counts = texts.select("text").mapInArrow(_voted, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    patterns = {r.votes: r.n for r in counts}
    posterior, accuracy, share = label_model(patterns)
    total = sum(patterns.values())
    part = min(1.0, sample / max(1, total))
    drawn = texts.where(F.pmod(F.xxhash64(*texts.columns), F.lit(1_000_000_000)) < part * 1_000_000_000).select("text")
    rows = drawn.mapInArrow(_featured, "votes string, at binary, value binary").limit(2 * sample).collect()
    rows = sorted((r.votes, bytes(r.at), bytes(r.value)) for r in rows)
    weights = train([(np.frombuffer(at, dtype=np.int32), np.frombuffer(value, dtype=np.float32)) for _, at, value in rows], np.array([posterior[v] for v, *_ in rows]))
    return QualityModel(weights, posterior, accuracy, share)


def classify(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every row of ``docs`` with ``votes, posterior, quality_score, keep``.

    A null or empty text, or one of white space only, scores 0 and is rejected; repeated rows get equal scores; an empty table gives no
    rows; texts of any length are read whole; other columns are carried along.
    """
    return fit(docs, sample).judge(docs)
