"""Removal of repeated byte strings by a sparse, partitioned suffix array.

A string of ``LENGTH`` bytes (a window) is judged at its anchor: the leftmost of its ``GRAM``-byte grams with the
smallest hash. The anchor depends on the window's bytes alone, so equal windows have equal anchors at
equal offsets, and only suffixes at anchors (about 1 byte in 39) take part. Anchors whose gram occurs once
in the corpus are done with. For the others, the bytes that their windows cover are range-partitioned by the
leading tokens of the suffix at the anchor, with splitters that Spark samples. Each bucket keeps that order and sorts its suffixes by
multikey quicksort over successive tokens of eight bytes, through to the end of the window; of a run of equal windows all but the first
by (document, start) are repeats. A gram with more than ``HOT`` anchors is dealt over several buckets;
the first of each of its windows is then compared across these boundaries.

Exact copies of whole documents are told by digest before all this and never reach it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Scratch, partitions, text_or_empty, unused

LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM + 1  # grams in a window
HOT = 2000
CHUNK = 3000  # anchors that a bucket sorts at once, about; those of one gram and salt stay together
_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of each run of ``length`` bytes, from those of halves."""
    have, size = data.astype(np.uint64) + np.uint64(1), 1
    parts, at = None, 0
    rest = length
    while rest:
        if rest & 1:
            if parts is None:
                parts, at = have, size
            else:  # the larger block goes behind what there is
                n = len(data) - at - size + 1
                parts = parts[:n] * _power(_B, size) + have[at : at + n]
                at += size
        rest >>= 1
        if rest:
            have = have[: len(have) - size] * _power(_B, size) + have[size:]
            size *= 2
    return parts


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position, first and last window start of each anchor of one text; nothing for texts shorter than a window."""
    none = np.empty(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    h = rolling(data, GRAM)
    h = (h ^ (h >> np.uint64(31))) * _M1
    h ^= h >> np.uint64(29)
    least = _slide(h, REACH, np.minimum)  # one for each window
    pad = np.zeros(REACH - 1, dtype=np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), REACH, np.maximum)  # over the windows that hold a gram
    at = np.flatnonzero(h == most)  # every position of a smallest hash, ties too
    # the leftmost of a window: it is in reach, and the position of an equal hash before it is not
    value = h[at]
    starts = np.arange(len(least))
    first = at[np.searchsorted(at, starts)]
    # grams in `at` that a window reaches need not be its smallest: move on to the first that is
    k = np.searchsorted(at, starts)
    wrong = np.flatnonzero(h[first] != least)
    while len(wrong):
        k[wrong] += 1
        wrong = wrong[value[k[wrong]] != least[wrong]]
    own, lo = np.unique(k, return_index=True)
    hi = np.append(lo[1:], len(least)) - 1
    return value[own], at[own], lo, hi


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct anchor grams of each document and how often it holds each; a run of one period counts as one row."""
    names = ["h", "doc_id", "c"]
    for batch in batches:
        parts: list[list[np.ndarray]] = [[], [], []]
        size = 0
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h, c = np.unique(anchors(np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8))[0], return_counts=True)
            if len(h):
                for part, x in zip(parts, (h.view(np.int64), np.full(len(h), d, dtype=np.int64), c.astype(np.int32)), strict=True):
                    part.append(x)
                size += len(h)
            if size > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], names=names)
                parts, size = [[], [], []], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], names=names)


_CONTEXT = {"lead": pa.int64(), "h": pa.int64(), "salt": pa.int32(), "doc_id": pa.int64(), "anchor": pa.int32(), "start": pa.int64(), "end": pa.int64(), "ctx": pa.binary()}
CONTEXT_SCHEMA = "lead long, h long, salt int, doc_id long, anchor int, start long, end long, ctx binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each repeated anchor of a document the bytes that its windows cover, with the leading token of its suffix.

    Within a few megabytes of text, only the earliest of equal contexts goes on; the windows of the others are repeats, and
    their spans (rows without a context) are final.
    """
    for batch in batches:
        docs = batch.column("doc_id").to_numpy()
        part: list[int] = []
        size = 0
        for k in range(batch.num_rows):
            part.append(k)
            size += len(batch.column("text")[k].as_py())
            if size > 1 << 22 or k == batch.num_rows - 1:
                yield from _combined(batch, sorted(part, key=docs.__getitem__))
                part, size = [], 0


def _combined(batch: pa.RecordBatch, order: list[int]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    seen: set[tuple] = set()
    for k in order:
        d, data, marks = batch.column("doc_id")[k].as_py(), batch.column("text")[k].as_py().encode("utf-8", "surrogatepass"), batch.column("marks")[k].as_py()
        salts = {m["h"]: m["salt"] for m in marks}
        h, at, lo, hi = anchors(np.frombuffer(data, dtype=np.uint8))
        h = h.view(np.int64)
        some = np.isin(h, np.fromiter(salts, dtype=np.int64, count=len(salts)))
        span = None
        for g, p, x, y in zip(h[some].tolist(), at[some].tolist(), lo[some].tolist(), (hi[some] + LENGTH).tolist(), strict=True):
            ctx = data[x:y]
            if (key := (g, p - x, ctx)) not in seen:
                seen.add(key)
                rows.append((int.from_bytes(data[p : p + 7], "big"), g, salts[g], d, p - x, x, y, ctx))
            elif span and x <= span[1]:
                span[1] = y
            else:
                if span:
                    rows.append((d * 0x9E3779B97F4A7C15 % (1 << 55), 0, -1, d, 0, *span, None))
                span = [x, y]
        if span:
            rows.append((d * 0x9E3779B97F4A7C15 % (1 << 55), 0, -1, d, 0, *span, None))
    for i in range(0, len(rows), 50_000):
        columns = zip(*rows[i : i + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CONTEXT.values(), strict=True)], names=list(_CONTEXT))


def multikey_groups(tokens: list, n: int, order_by: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of n suffixes by successive tokens: a run of suffixes that agree so far is parted by the next token, and only what is still tied goes on.

    ``tokens`` are functions from indexes to 64-bit tokens, which order as the bytes do. Returns indexes in runs of suffixes that agree in all tokens, runs in the suffixes' order, each
    run in the order of ``order_by``, and the run of each; suffixes without an equal are left out.
    """
    index, run = np.arange(n), np.zeros(n, dtype=np.int64)
    for token in tokens:
        if not len(index):
            break
        key = token(index)
        head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        size = np.diff(np.append(head, len(index)))
        differs = key != np.repeat(key[head], size)
        if not differs.any():
            continue
        mixed = np.flatnonzero(np.repeat(np.logical_or.reduceat(differs, head), size))  # runs that this token parts
        order = mixed[np.lexsort((key[mixed], run[mixed]))]
        index[mixed], key[mixed] = index[order], key[order]
        run = np.cumsum(np.append(True, (run[1:] != run[:-1]) | (key[1:] != key[:-1])))
        tied = np.bincount(run)[run] > 1
        index, run = index[tied], run[tied]
    order = np.lexsort((*(c[index] for c in reversed(order_by)), run))
    return index[order], run[order]


def repeats(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, ctx: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Which windows of these anchors (places in their contexts) are not the first of their kind here.

    Suffixes are sorted by the gram at the anchor and then by the bytes of the window, eight at a time, so runs hold windows that are equal byte by byte.
    Returns for every window its row, its start, whether it is a repeat, its place in the joined bytes, and these bytes.
    """
    lengths = np.fromiter(map(len, ctx), dtype=np.int64, count=len(ctx))
    base = np.cumsum(lengths) - lengths
    joined = b"".join(ctx)
    data = np.frombuffer(joined, dtype=np.uint8)
    count = lengths - LENGTH + 1
    row = np.repeat(np.arange(len(ctx)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    where = base[row] + step
    begin = start[row] + step
    word = np.zeros(len(data) - 7, dtype=np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | data[k : len(data) - 7 + k]
    gram = base + anchor
    tokens = [lambda i, k=k: word[gram[row[i]] + k] for k in range(0, GRAM, 8)]
    tokens += [lambda i, k=k: word[where[i] + k] for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]]
    index, run = multikey_groups(tokens, len(row), (doc[row], begin))
    again = np.zeros(len(row), dtype=bool)
    if len(index):
        head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        first = index[np.repeat(head, np.diff(np.append(head, len(index))))]
        again[index[(doc[row[index]] != doc[row[first]]) | (begin[index] != begin[first])]] = True
    return row, begin, again, where, joined


def _buckets(chunk: int):
    """Sorts a bucket chunk by chunk; rows come in the order of their leading tokens, those of one gram and salt together, and these are never split.

    Parts of a gram that is dealt out by salts may fall into several chunks of one bucket: they are compared across boundaries anyway.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            final = table.filter(pc.is_null(table.column("ctx")))
            table = table.filter(pc.is_valid(table.column("ctx")))
            if not table.num_rows:
                return pa.RecordBatch.from_arrays([*(final.column(c).combine_chunks() for c in ("doc_id", "start", "end")), pa.nulls(final.num_rows, pa.binary())], names=["doc_id", "a", "b", "window"])
            anchor, doc, start, salt = (table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "doc_id", "start", "salt"))
            row, begin, again, where, joined = repeats(anchor, doc, start, table.column("ctx").to_pylist())
            # runs of repeated windows of one anchor become one span of bytes
            i = np.flatnonzero(again)
            cut = np.flatnonzero(np.append(True, (row[i][1:] != row[i][:-1]) | (begin[i][1:] != begin[i][:-1] + 1))) if len(i) else i
            last = np.append(cut[1:], len(i)) - 1 if len(i) else i
            spans = [doc[row[i[cut]]], begin[i[cut]], begin[i[last]] + LENGTH] if len(i) else [i, i, i]
            # firsts of grams that lie in several buckets are compared across the boundaries
            over = np.flatnonzero((salt[row] >= 0) & ~again)
            digests = [hashlib.blake2b(joined[w : w + LENGTH], digest_size=16).digest() for w in where[over].tolist()]
            out = [np.concatenate([x, final.column(c).to_numpy(), y]) for x, c, y in zip(spans, ("doc_id", "start", "end"), (doc[row[over]], begin[over], begin[over] + LENGTH), strict=True)]
            return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in out), pa.array([None] * (len(out[0]) - len(digests)) + digests, pa.binary())], names=["doc_id", "a", "b", "window"])

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                table = pa.Table.from_batches(held).combine_chunks()
                h, part = table.column("h").to_numpy(), table.column("salt").to_numpy()
                done = 0
                ends = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1])) + 1  # where a new gram begins, or the next part of one
                while rows - done >= chunk and len(e := ends[ends > done]):
                    to = int(e[min(np.searchsorted(e, done + chunk), len(e) - 1)])
                    yield flush(table.slice(done, to - done))
                    done = to
                    if to == ends[-1]:
                        break
                held = table.slice(done).to_batches()
                rows -= done
        if rows:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def _cleaned(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, spans, sha, kept = [], [], [], [], []
            for t, marks in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                out, end, n, k = [], 0, 0, 0
                last = -1
                for a, b in sorted((m["a"], m["b"]) for m in marks):
                    if a > last:  # a gap, or the start: a new maximal run
                        out.append(data[max(end, 0) : a])
                        k += 1
                        n += b - a
                        last = end = b
                    elif b > last:
                        n += b - last
                        last = end = b
                out.append(data[end:])
                rest = b"".join(out)
                n_bytes.append(len(data))
                removed.append(n)
                spans.append(k)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_spans(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, spans array<struct<a, b>>`` of the distinct documents ``rows`` (``doc_id long, text``) that repeat earlier strings; spans may overlap."""
    found = scratch.write(rows.where(F.octet_length("text") >= LENGTH).mapInArrow(_grams, "h long, doc_id long, c int"), "grams")
    several = scratch.write(found.groupBy("h").agg(F.sum("c").alias("n")).where("n > 1"), "several")
    scratch.release()
    many = found.join(several.hint("shuffle_hash"), "h")
    salt = F.when(F.col("n") > HOT, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / HOT)).cast("int")).otherwise(-1)
    marks = scratch.write(many.groupBy("doc_id").agg(F.collect_list(F.struct("h", salt.alias("salt"))).alias("marks")), "marks")
    scratch.drop(found, several)
    scratch.release()
    # written before they are dealt out, as the splitters' sample reads them too
    contexts = scratch.write(rows.join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(_contexts, CONTEXT_SCHEMA), "contexts")
    scratch.drop(marks)
    scratch.release()
    sorted_ = contexts.repartitionByRange(partitions(spark, 12), "lead", "h", "salt").sortWithinPartitions("lead", "h", "salt")
    found = scratch.write(sorted_.mapInArrow(_buckets(CHUNK), "doc_id long, a long, b long, window binary"), "spans")
    scratch.drop(contexts)
    scratch.release()
    across = found.where("window is not null")
    first = across.groupBy("window").agg(F.min(F.struct("doc_id", "a")).alias("first"))
    later = across.join(first, "window").where(F.struct("doc_id", "a") != F.col("first"))
    spans = found.where("window is null").select("doc_id", "a", "b").unionByName(later.select("doc_id", "a", "b"))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _numbered(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a long that orders and names its rows, and the name of that column: the doc_id itself where it is an integer, never null and never repeated, else the place by (doc_id, text)."""
    did = unused(docs, "did")
    if isinstance(docs.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        totals = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
        if totals.n == totals.ids:
            return docs.withColumn(did, F.col("doc_id").cast("long")), did
    return scratch.write(docs.orderBy("doc_id", text_or_empty()).withColumn(did, F.monotonically_increasing_id()), "numbered"), did


def dedup_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the bytes of repeated strings (see ``suffix_dedup``); documents of which nothing but blanks is left go.

    Documents that lose nothing are returned as they are; the others keep their other columns, whatever their names.
    """
    scratch = Scratch(spark, "cut")
    rows, did = _numbered(scratch, docs)
    kept = unused(rows, "kept")
    cut = scratch.write(_judged(spark, rows.select(F.col(did).alias("doc_id"), "text"), keep_changed=True).where("n_removed > 0").select(F.col("doc_id").alias(did), F.col("kept_text").alias(kept)), "cut")
    out = rows.join(cut, did, "left")
    return out.where(F.col(kept).isNull() | (F.btrim(kept, F.lit(" \t\r\n")) != "")).withColumn("text", F.coalesce(kept, "text")).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """A row per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]``.

    Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (smaller doc_id, or same document and earlier
    start) goes; strings are judged on the input. Null texts count as empty; shorter texts keep all. Ids may be of any ordered type, null (the smallest) or repeated: rows that share one are
    judged each on its own, those with smaller texts first. An empty table gives no rows; other columns are ignored. In ``kept_text``, a character
    cut in half becomes U+FFFD.
    """
    scratch = Scratch(spark, "ids")
    rows, did = _numbered(scratch, docs.select("doc_id", "text"))
    out = _judged(spark, rows.select(F.col(did).alias("doc_id"), "text"), keep_text)
    if not scratch.tables:
        return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    names = rows.select(F.col(did).alias("id"), F.col("doc_id").alias("name"))
    return out.join(names, out["doc_id"] == names["id"]).select(F.col("name").alias("doc_id"), *(c for c in out.columns if c != "doc_id"))


def _judged(spark: SparkSession, docs: DataFrame, keep_text: bool = False, keep_changed: bool = False) -> DataFrame:
    """As ``suffix_dedup``, for distinct long ids. With ``keep_changed`` only documents that lost bytes have their ``kept_text``, the others null."""
    scratch = Scratch(spark, "suffixes")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    size = F.octet_length("text").cast("long")
    told = scratch.write(rows.select("doc_id", size.alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "digests")
    # a table of its own, so that Spark can split a digest that very many documents share
    first = scratch.write(told.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    copies = scratch.write(told.join(first, "sha").where("doc_id <> first").select("doc_id"), "copies")
    spans = repeated_spans(spark, rows.join(copies, "doc_id", "left_anti"), scratch)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if keep_text or keep_changed else "")
    changed = rows.join(spans, "doc_id").mapInArrow(_cleaned(keep_text or keep_changed), schema)
    zero = F.lit(0).cast("long")
    whole = F.col("n_bytes") >= LENGTH
    again = told.join(copies, "doc_id").select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(zero).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"), F.when(whole, F.lit(_EMPTY_SHA)).otherwise(F.col("sha")).alias("kept_sha256"))
    changed = scratch.write(changed, "changed")
    scratch.keep_only(told, copies, changed)
    same = told.join(copies, "doc_id", "left_anti").join(changed.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    if keep_text:
        texts = rows.join(changed.select("doc_id"), "doc_id", "left_anti")
        rest = again.unionByName(same).join(texts, "doc_id").withColumn("kept_text", F.when((F.col("n_removed") > 0), F.lit("")).otherwise(F.col("text"))).drop("text")
        return changed.unionByName(rest)
    if keep_changed:
        return changed.unionByName(again.unionByName(same).withColumn("kept_text", F.when(F.col("n_removed") > 0, F.lit(""))))
    return changed.unionByName(again).unionByName(same)
