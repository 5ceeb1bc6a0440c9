"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order (contexts of 0 to ``ORDER`` bytes) grown from a
bounded sample of labelled documents and then frozen. A byte costs -log2 of its share among
the bytes that followed the longest known context; where it never followed, the escape probability of
that context is paid (distinct followers / (count + distinct followers)) and the next shorter one is asked,
down to a uniform byte. A text's code length is exact: every byte of it is charged under every language,
and the shortest code names the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import text_or_empty

ORDER = 4
#: Bytes of text learned for each language, about: the bound of the sample that the trees are grown from.
SAMPLE_BYTES = 3_000_000
#: Languages that get a sample of that size. With more labels than this the samples of all are smaller.
MAX_LANGUAGES = 400
SLICE = 1 << 19
#: Letters, and numbers that are written as other signs, which ``isalpha`` tells apart.
_LETTER = re.compile(r"[^\W\d_]")
_PAD = b"\n" * ORDER
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_LOADED: dict[str, "Ppm"] = {}


def _codes(data: np.ndarray) -> np.ndarray:
    """For each byte after the first ORDER: it and its ORDER predecessors in one integer, the byte itself lowest."""
    n = len(data) - ORDER
    out = np.zeros(n, dtype=np.uint64)
    for k in range(ORDER + 1):
        out = out << np.uint64(8) | data[k : k + n]
    return out


class Ppm:
    """Frozen trees of all languages and a table of the costs of every context and byte that they have seen."""

    def __init__(self, languages: list[str], samples: list[list[bytes]]):
        self.languages, self.trees = languages, []
        keys = []
        for texts in samples:
            codes = [_codes(np.frombuffer(_PAD + t, dtype=np.uint8)) for t in texts if t]
            all_codes = np.concatenate(codes) if codes else np.empty(0, dtype=np.uint64)
            tree = []
            grams, count = np.unique(all_codes, return_counts=True)
            keys.append(grams)
            for order in range(ORDER, -1, -1):
                mask = np.uint64((1 << 8 * (order + 1)) - 1)
                low, back = np.unique(grams & mask, return_inverse=True)
                n = np.bincount(back, weights=count, minlength=len(low))
                contexts, inv = np.unique(low >> np.uint64(8), return_inverse=True)
                total = np.bincount(inv, weights=n, minlength=len(contexts))
                distinct = np.bincount(inv, minlength=len(contexts))
                tree.append((low, n, contexts, total, distinct))
                grams, count = low, n
            self.trees.append(tree)
        self.keys = np.unique(np.concatenate(keys)) if keys else np.empty(0, dtype=np.uint64)
        self.table: np.ndarray | None = None

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits for each code under each language."""
        out = np.zeros((len(codes), len(self.languages)))
        for k, tree in enumerate(self.trees):
            open_ = np.ones(len(codes), dtype=bool)
            for level, (grams, n, contexts, total, distinct) in enumerate(tree):
                order = ORDER - level
                code = codes & np.uint64((1 << 8 * (order + 1)) - 1)
                if not len(grams):
                    continue
                c = np.minimum(np.searchsorted(contexts, code >> np.uint64(8)), len(contexts) - 1)
                known = open_ & (contexts[c] == code >> np.uint64(8))
                g = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
                hit = known & (grams[g] == code)
                size = total[c] + distinct[c]
                out[hit, k] += np.log2(size[hit] / n[g[hit]])
                miss = known & ~hit
                out[miss, k] += np.log2(size[miss] / distinct[c[miss]])
                open_ &= ~hit
            out[open_, k] += 8.0
        return out

    def ready(self) -> "Ppm":
        if self.table is None:
            self.table = self.cost(self.keys)
            slot = (self.keys * _MULT >> np.uint64(64 - _BITS)).astype(np.int64)
            self.slots = np.full(1 << _BITS, -1, dtype=np.int32)
            self.slots[slot] = np.arange(len(self.keys), dtype=np.int32)
        return self

    def bits_of(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return self.cost(codes)
        at = self.slots[(codes * _MULT >> np.uint64(64 - _BITS)).astype(np.int64)]
        wrong = np.flatnonzero((at < 0) | (self.keys[at] != codes))
        out = self.table[at]
        if len(wrong):
            other = codes[wrong]
            found = np.minimum(np.searchsorted(self.keys, other), len(self.keys) - 1)
            known = self.keys[found] == other
            out[wrong[known]] = self.table[found[known]]
            if not known.all():
                rare, back = np.unique(other[~known], return_inverse=True)
                out[wrong[~known]] = self.cost(rare)[back]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language; long texts go in slices, short ones together."""
        out = np.zeros((len(texts), len(self.languages)))
        group: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal group, size
            if group:
                codes = np.concatenate([_codes(np.frombuffer(_PAD + texts[i], dtype=np.uint8)) for i in group])
                starts = np.cumsum([0, *(len(texts[i]) for i in group[:-1])])
                out[group] = np.add.reduceat(self.bits_of(codes), starts, axis=0)
            group, size = [], 0

        for i, t in enumerate(texts):
            if len(t) > SLICE:
                data = np.frombuffer(_PAD + t, dtype=np.uint8)
                for a in range(0, len(t), SLICE):
                    out[i] += self.bits_of(_codes(data[a : a + SLICE + ORDER])).sum(axis=0)
            elif t:
                group.append(i)
                size += len(t)
                if size >= SLICE:
                    flush()
        flush()
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        bits = self.code_lengths([t.encode("utf-8", "surrogatepass") for t in texts])
        names, scores = [], []
        for t, row in zip(texts, bits, strict=True):
            if not self.languages or not any(m[0].isalpha() for m in _LETTER.finditer(t)):
                names.append("und")
                scores.append(0.0)
            else:
                best = int(row.argmin())  # ties go to the first name in order
                names.append(self.languages[best])
                scores.append(float(1.0 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
        return names, scores


def learn(training: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Ppm:
    """Grows the trees from ``text, lang`` rows: about ``sample_bytes`` a language (less beyond MAX_LANGUAGES labels), drawn by hash.

    Texts of up to a 30th of that are drawn whole; where a label has too few of them, slices of its longer ones fill its sample, so
    every label with a text has a tree; where the draw finds none, its text of the least hash is learned. Copies are drawn
    together and learned once, so however many there are, one reaches the driver. Rows with a null language or text teach nothing.
    """
    rows = training.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", "text")
    labels = rows.select("lang").distinct().count()
    if not labels:
        return Ppm([], [])
    sample_bytes = sample_bytes * MAX_LANGUAGES // max(labels, MAX_LANGUAGES)
    most = max(4, sample_bytes // 30)
    hashed = F.xxhash64("text", F.lit(7))
    is_long = F.octet_length("text") > most
    cut = F.substring("text", F.pmod(hashed, F.greatest(F.lit(1), F.char_length("text") - most // 4 + 1)).cast("int") + 1, F.lit(most // 4))
    rows = rows.select("lang", F.pmod(hashed, F.lit(1_000_000)).alias("h"), is_long.alias("long"), F.when(is_long, cut).otherwise(F.col("text")).alias("text"))
    size = lambda of: F.coalesce(F.sum(F.when(of, F.octet_length("text"))), F.lit(0))
    sizes = rows.groupBy("lang").agg(size(~F.col("long")).alias("whole"), size(F.col("long")).alias("cut"), F.min_by("text", "h").alias("first")).collect()
    share = [(r.lang, min(1.0, sample_bytes / max(1, r.whole)), min(1.0, max(0.0, sample_bytes - r.whole) / max(1, r.cut))) for r in sizes]
    shares = F.broadcast(training.sparkSession.createDataFrame(share, "lang string, whole double, cut double"))
    drawn = rows.join(shares, "lang").where(F.col("h") < F.when(F.col("long"), F.col("cut")).otherwise(F.col("whole")) * 1_000_000)
    texts: dict[str, list[bytes]] = {r.lang: [] for r in sizes}
    for r in drawn.select("lang", "text").distinct().collect():
        texts[r.lang].append(r.text.encode("utf-8", "surrogatepass"))
    for r in sizes:
        if not texts[r.lang]:
            texts[r.lang].append(r.first.encode("utf-8", "surrogatepass"))
    names = sorted(texts)
    return Ppm(names, [sorted(texts[n]) for n in names])


def _scored(model, uid: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if uid not in _LOADED:
            _LOADED.clear()
            _LOADED[uid] = model.value.ready()
        ppm = _LOADED[uid]
        for batch in batches:
            names, scores = ppm.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(spark: SparkSession, docs: DataFrame, ppm: Ppm, held_out=None) -> DataFrame:
    """A row per document: ``doc_id, held_out, lang_pred, score``.

    The whole text is charged; ``lang``, ``source`` and ``doc_id`` play no part. ``und`` with score 0 stands where the text is null or
    has no letter, or nothing was learned. ``score`` is the best language's share of 2 ** -bits, 0 to 1. Repeated rows
    give repeated rows, an empty table gives none, other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    uid = f"{id(ppm)}-{len(ppm.keys)}-{int(ppm.keys.sum() % 2**32) if len(ppm.keys) else 0}"
    shared = spark.sparkContext.broadcast(ppm)
    rows = docs.select("doc_id", (F.lit(True) if held_out is None else held_out).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(_scored(shared, uid), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def fold() -> F.Column:
    """True for documents that are held out: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify_languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts all."""
    return identify(spark, docs, learn(docs.where(~fold()).select("text", "lang")), fold())
