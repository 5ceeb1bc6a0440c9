"""Exact Jaccard join of documents on word shingles by PartEnum signatures.

Sets are banded by size. In each band the domain of shingles is cut into ``n1`` partitions (about two of the largest
set's elements each), and a set's non-empty partitions, each with its exact content, are its candidate signatures.
Two sets of Jaccard similarity j differ in at most d = (1 - j) / (1 + j) * (|A| + |B|) elements and hence in at most d
partitions, so of those enumerated in one common order the first d + 1 of both sets share one: only these become
signatures. A set near the top of its band also signs for the next band, where larger partners sign. Where
a set has no more than d non-empty partitions, it signs with its elements as partitions of their own as well.

The order puts signatures that are frequent in a bounded sample last. It is the same for all documents, so the sample
only moves work and never results. Candidates are verified on the exact sets.

Copies (equal sets) are one content and sign once a task. Groups that share a signature are first tied to
their smallest member; only what verification leaves in different components is compared further. There a set leaves the
largest groups of each level, all but one of as many as any partner shares with it: of the groups that two partners share, the smallest
stays in both, as all leave by one order. Small groups are compared pair by pair, large ones in blocks of ``BLOCK`` x ``BLOCK``
members that give links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, records_per_batch, text_or_empty
from .graph import connected_components, joined_components

WORDS = 5
#: Link when DENOMINATOR * |A and B| >= NUMERATOR * |A or B|.
NUMERATOR, DENOMINATOR = 75, 100
#: Documents of the sample that shows frequent signatures, about, and how many of these are kept.
SAMPLE, FREQUENT = 10_000, 20_000
#: Signatures that true partners share at a level, where their sizes allow it: prefixes are longer by so many.
SHARED = 12
ELEMENTS = 40
#: Groups of up to SMALL are compared pair by pair; blocks of BLOCK members; clusters of up to CLUSTER are compared once, larger ones by signature.
SMALL, BLOCK, CLUSTER = 12, 192, 8192
#: Pairs of blocks in an Arrow batch, at most.
BLOCKS = 32
#: Bytes of words that are hashed side by side, about, and places in a word that have a table.
SLICE, PLACES = 1 << 18, 64
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _mix1(x: int) -> int:
    """``mix`` of one number."""
    x = (x ^ x >> 30) * int(_M1) & _ALL
    x = (x ^ x >> 27) * int(_M2) & _ALL
    return x ^ x >> 31


_ALL = (1 << 64) - 1
_BLANK, _LOWER = np.zeros(256, dtype=bool), np.arange(256, dtype=np.int64)
_BLANK[[32, *range(9, 14)]] = True
_LOWER[65:91] += 32
#: A random number for each byte at each place of a word; the hash of a word is their sum, mixed.
_AT_PLACE = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * _M3)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has: A-Z lowered, words between ASCII white space."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*encoded, b""]), dtype=np.uint8)  # every text ends with a blank
    blank = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edges = np.append(0, edges)
    start, end = edges[::2], edges[1::2]
    counts = np.diff(np.searchsorted(start, np.cumsum([len(e) + 1 for e in encoded])), prepend=0)
    size = end - start
    first = np.cumsum(size) - size
    h = np.empty(len(start), dtype=np.uint64)
    cuts = [*np.unique(np.searchsorted(first, np.arange(0, int(size.sum()), SLICE))).tolist(), len(start)] if len(start) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        lo, hi = start[a], end[b - 1]
        byte = _LOWER[data[lo:hi][~blank[lo:hi]]]
        begin = first[a:b] - first[a]
        key = (np.arange(len(byte)) - np.repeat(begin, size[a:b])) * 256 + byte
        value = _AT_PLACE[np.minimum(key, PLACES * 256 - 1)]
        far = np.flatnonzero(key >= PLACES * 256)
        if len(far):
            value[far] = mix((key[far] + 1).astype(np.uint64) * _M3)
        h[a:b] = mix(np.add.reduceat(value, begin) + size[a:b].astype(np.uint64))
    return h, counts


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles, five words each; fewer words are one shingle, none an empty set."""
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    long = np.zeros(0, dtype=np.uint64)
    if len(h) >= WORDS:
        n = len(h) - WORDS + 1
        long = np.full(n, WORDS, dtype=np.uint64)
        for i in range(WORDS):
            long = long * _M3 + h[i : i + n]
        long = mix(long)
    out = []
    for end, k in zip(ends.tolist(), counts.tolist(), strict=True):
        if k >= WORDS:
            s = np.sort(long[end - k : end - WORDS + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif k:
            x = np.full(1, k, dtype=np.uint64)
            for i in range(end - k, end):
                x = x * _M3 + h[i : i + 1]
            out.append(mix(x))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def shingle_set(text: str) -> np.ndarray:
    return shingle_sets([text])[0]


def in_parts(texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """Texts with their sets, a few hundred at a time."""
    for i in range(0, len(texts), 256):
        yield from zip(texts[i : i + 256], shingle_sets(texts[i : i + 256]), strict=True)


def content_id(s: np.ndarray, mixed: np.ndarray | None = None) -> int:
    """A signed 64-bit name of a set; ``mixed`` is mix(s + _M3), where it is at hand."""
    mixed = mix(s + _M3) if mixed is None else mixed
    x = _mix1(int(mixed.sum(dtype=np.uint64)))
    x = _mix1(x + int(np.bitwise_xor.reduce(s, initial=np.uint64(0))) & _ALL)
    x = _mix1(x + len(s) & _ALL)
    return x - (x >> 63 << 64)


def largest_difference(size: int) -> int:
    """Elements by which a set of this size can differ from any set that is no smaller than it and similar enough."""
    partner = size * DENOMINATOR // NUMERATOR
    return (DENOMINATOR - NUMERATOR) * (size + partner) // (DENOMINATOR + NUMERATOR)


def band_of(size: int) -> int:
    """Bands hold sizes 4**b to 4**(b + 1) - 1."""
    return (size.bit_length() - 1) // 2


def partition_signatures(s: np.ndarray, band: int, mixed: np.ndarray | None = None) -> np.ndarray:
    """One signature for each non-empty partition of a band's domain; band -1 makes every element a partition."""
    if band < 0:
        return mix(s + _M1)
    n1 = max(1, 4 ** (band + 1) // 2)
    part = ((s >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)  # sets are sorted, and so are their partitions
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    content = np.add.reduceat(mix(s + _M3) if mixed is None else mixed, first)
    return mix(content * _M3 + part[first] * np.uint64(64) + np.uint64(band))


def signatures(s: np.ndarray, frequent: np.ndarray, mixed: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
    """(tag, signatures) of each level that a set signs at. A tag is 32 times the level (band, or ELEMENTS) plus how many of the level's a partner must share."""
    size = len(s)
    d = largest_difference(size)
    band = band_of(size)
    levels = [band, band + 1] if size * DENOMINATOR >= NUMERATOR * 4 ** (band + 1) else [band]
    out = []
    while levels:
        level = levels.pop(0)
        sigs = partition_signatures(s, -1 if level == ELEMENTS else level, mixed)
        if len(sigs) <= d and ELEMENTS not in levels:  # never so at the level of elements
            levels.append(ELEMENTS)
        out.append((level * 32 + max(1, min(SHARED, len(sigs) - d)), _first(sigs, d + SHARED, frequent)))
    return out


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's elements in as many hash buckets, rounded up to a power of two; counts stop at 255."""
    bits = max(6, min(16, (len(s) - 1).bit_length()))
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(counts: np.ndarray, width: int) -> np.ndarray:
    """Sketches brought to fewer buckets. The sum of differences of two sketches never exceeds the difference of the sets."""
    return np.minimum(counts.reshape(len(counts), width, -1).sum(axis=2, dtype=np.int32), 255) if counts.shape[1] != width else counts.astype(np.int32)


def _first(sigs: np.ndarray, n: int, frequent: np.ndarray) -> np.ndarray:
    if len(sigs) <= n:
        return sigs
    sigs = np.sort(sigs)  # what is sorted is found far sooner
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, sigs), len(frequent) - 1)
        late = frequent[at] == sigs
        if late.any():
            return np.concatenate([sigs[~late], sigs[late]])[:n]
    return sigs[:n]


# --- Spark stages ------------------------------------------------------------------------------


_LEVELS = pa.list_(pa.struct([("tag", pa.int32()), ("sigs", pa.list_(pa.int64()))]))
SIGNED = "n_shingles long, cid long, levels array<struct<tag: int, sigs: array<long>>>"


def _signed(frequent):
    """Size, content and signatures of each text. A content signs once a task; copies of it have no levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value if frequent is not None else np.empty(0, dtype=np.uint64)
        seen: set[int] = set()
        for batch in batches:
            sizes, cids, levels = [], [], []
            for _, s in in_parts(batch.column("text").to_pylist()):
                mixed = mix(s + _M3)
                cid = content_id(s, mixed)
                sizes.append(len(s))
                cids.append(cid)
                if not len(s) or cid in seen:
                    levels.append(None)
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(cid)
                levels.append([{"tag": tag, "sigs": sigs.view(np.int64)} for tag, sigs in signatures(s, late, mixed)])
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(sizes, pa.int64()), pa.array(cids, pa.int64()), pa.array(levels, _LEVELS)], names=[*rest, "n_shingles", "cid", "levels"])

    return run


def _each_signature(signed: DataFrame) -> DataFrame:
    one = signed.where("levels is not null").select("cid", F.explode("levels").alias("l"))
    return one.select("cid", "l.tag", F.explode("l.sigs").alias("sig")).select("sig", "cid", "tag")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sketch; rows whose text is not the content they were fetched for (others of the same doc_id) go."""
    for batch in batches:
        wanted, keep, sketches = batch.column("cid").to_pylist(), [], []
        for k, (_, s) in enumerate(in_parts(batch.column("text").to_pylist())):
            if content_id(s) == wanted[k]:
                keep.append(k)
                sketches.append(sketch(s))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("cid", "n", "text")), pa.array(sketches, pa.binary())], names=["cid", "n", "text", "sketch"])


def similar(inter: int, a: int, b: int) -> bool:
    return inter * DENOMINATOR >= (a + b - inter) * NUMERATOR


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those that link, by their exact sets."""
    last: tuple = (None, None)
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        ta = batch.column("ta").to_pylist()
        keep = []
        for k, (_, sb) in enumerate(in_parts(batch.column("tb").to_pylist())):
            if a[k] != last[0]:
                last = (a[k], shingle_set(ta[k]))
            sa = last[1]
            if min(len(sa), len(sb)) * DENOMINATOR >= max(len(sa), len(sb)) * NUMERATOR and similar(len(np.intersect1d(sa, sb, assume_unique=True)), len(sa), len(sb)):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches don't rule a link out."""
    for batch in batches:
        keep = []
        for k, (na, nb, ka, kb) in enumerate(zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), strict=True)):
            a, b = (np.frombuffer(x, dtype=np.uint8).reshape(1, -1) for x in (ka, kb))
            width = min(a.shape[1], b.shape[1])
            if int(np.abs(folded(a, width) - folded(b, width)).sum()) * (DENOMINATOR + NUMERATOR) <= (na + nb) * (DENOMINATOR - NUMERATOR):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that link: sizes and sketches first, then the exact sets. Texts move compressed, which sets would not."""
    left, right = (texts.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab")
    sized = pairs.join(left.select("a", "na"), "a").join(right.select("b", "nb"), "b").where(F.least("na", "nb") * DENOMINATOR >= F.greatest("na", "nb") * NUMERATOR)
    near = sized.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_close, "a long, b long")
    left, right = (texts.select(F.col("cid").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return near.join(right, "b").join(left, "a").mapInArrow(_linked, "a long, b long")


def _block_pairs(best_only: bool):
    """Candidates between two blocks of members in different components, by sizes and sketches; with ``best_only`` the nearest of each component to each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (batch.column(c)[k].as_py() for c in ("left", "right"))
                a, b = [], []
                by_width: dict[int, list] = {}
                for m in right:
                    by_width.setdefault(len(m["sketch"]), []).append(m)
                groups = {w: (np.array([m["cid"] for m in ms]), np.array([m["comp"] for m in ms]), np.array([m["n"] for m in ms]), np.frombuffer(b"".join(m["sketch"] for m in ms), dtype=np.uint8).reshape(len(ms), w)) for w, ms in by_width.items()}
                plain = {w: g[3].astype(np.int32) for w, g in groups.items()}
                for m in left:
                    own = np.frombuffer(m["sketch"], dtype=np.uint8).reshape(1, -1)
                    for w, (cids, comps, n, counts) in groups.items():
                        if not w // 2 <= own.shape[1] <= 2 * w:
                            continue
                        width = min(w, own.shape[1])
                        some = np.flatnonzero((comps != m["comp"]) & (np.minimum(n, m["n"]) * DENOMINATOR >= np.maximum(n, m["n"]) * NUMERATOR))
                        if not len(some):
                            continue
                        theirs = plain[w][some] if width == w else folded(counts[some], width)
                        apart = np.abs(theirs - folded(own, width)).sum(axis=1)
                        near = apart * (DENOMINATOR + NUMERATOR) <= (n[some] + m["n"]) * (DENOMINATOR - NUMERATOR)
                        some, apart = some[near], apart[near]
                        if best_only and len(some):
                            order = np.lexsort((cids[some], apart))
                            _, at = np.unique(comps[some][order], return_index=True)
                            some = some[order[at]]
                        a += np.minimum(cids[some], m["cid"]).tolist()
                        b += np.maximum(cids[some], m["cid"]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps.withColumnRenamed("node", "cid"), "cid", "left").select(*rows.columns, F.coalesce("component", "cid").alias("comp"))


def jaccard_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row per document: ``doc_id, n_shingles, component_id`` (the smallest doc_id reachable over links, itself included).

    Null texts count as empty; documents without words have an empty set and link with nothing, not even each other; rows
    that repeat a doc_id are returned each, with the component that the links of its own text give; a null doc_id names a component only where there is no other; an empty table gives none; other columns are ignored; texts of any length are read whole.
    """
    scratch = Scratch(spark, "jaccard")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    total, repeated = counts.n, counts.n != counts.ids
    drawn = rows.where(F.pmod(F.xxhash64("text", "doc_id", F.lit(11)), F.lit(1_000_000_000)) < min(1.0, SAMPLE / max(1, total)) * 1_000_000_000).select("text")
    counts = _each_signature(drawn.mapInArrow(_signed(None), SIGNED)).groupBy("sig").count().where("count >= 8")
    top = counts.orderBy(F.desc("count"), "sig").limit(FREQUENT).select("sig").toPandas()["sig"].to_numpy(dtype=np.int64)
    frequent = spark.sparkContext.broadcast(np.sort(top.view(np.uint64)))

    known = scratch.write(rows.mapInArrow(_signed(frequent), f"doc_id {kind}, {SIGNED}"), "signed")
    frequent.destroy()
    told = scratch.write(known.select("doc_id", "n_shingles", "cid"), "contents")
    full = told.where("n_shingles > 0")
    shared = scratch.write(_of_two(_each_signature(known)).select("sig", "cid", "tag").distinct(), "shared")
    scratch.drop(known)
    scratch.release()
    # one job, in which rows move once for each step
    groups = shared
    for _ in range(3):
        groups = _of_two(_sharing_enough(groups.select("sig", "cid", "tag")))
    groups = scratch.write(groups, "groups")
    scratch.drop(shared)
    scratch.release()

    # the texts of those that share a signature, each from its first document
    first = full.groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    wanted = groups.where("cid <> lo").select(F.explode(F.array("cid", "lo")).alias("cid")).distinct().join(first, "cid")
    found = rows.alias("r").join(wanted.alias("w"), F.expr("r.doc_id <=> w.doc_id")).select("cid", "n", "text").mapInArrow(_sketched, "cid long, n long, text string, sketch binary")
    sets = scratch.write(found.dropDuplicates(["cid"]) if repeated else found, "texts")
    scratch.release()

    # each group's members against its smallest
    links = scratch.write(_verified(groups.where("cid <> lo").select(F.col("lo").alias("a"), F.col("cid").alias("b")).distinct(), sets), "links")
    comps = scratch.write(connected_components(spark, links, scratch), "components")

    scratch.release()
    # what is left: groups whose members still lie in different components
    rest = scratch.write(_open(_with_components(groups, comps), 3), "rest")
    scratch.drop(groups, links)
    scratch.release()
    fewer = scratch.write(_open(_fewest(rest), 2), "rest")
    scratch.drop(rest)
    rest = fewer
    scratch.release()
    small = rest.where(F.col("n") <= SMALL)
    pairs = small.alias("x").join(small.alias("y"), F.expr("x.sig = y.sig and x.cid < y.cid and x.comp <> y.comp and x.cid <> x.lo")).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    # large groups: the nearest of other components first, then whoever is still apart and could be near enough
    large = scratch.write(_clusters(spark, scratch, rest.where(F.col("n") > SMALL).select("sig", "cid")), "large")
    scratch.release()
    with records_per_batch(spark, BLOCKS):
        near = scratch.write(_between_blocks(scratch, large, comps, sets, True), "near")
    scratch.release()
    more = scratch.write(_verified(pairs.unionByName(near).distinct(), sets), "more")
    scratch.release()
    if not more.isEmpty():
        comps = scratch.write(joined_components(spark, comps, more, scratch), "components")
    with records_per_batch(spark, BLOCKS):
        near = scratch.write(_between_blocks(scratch, large, comps, sets, False), "near")
    scratch.release()
    last = scratch.write(_verified(near, sets), "last")
    scratch.release()
    if not last.isEmpty():
        comps = scratch.write(joined_components(spark, comps, last, scratch), "components")

    named = full.select("doc_id", "cid").join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    of_component = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_content = scratch.write(named.select("cid", "component").distinct().join(of_component, "component").select("cid", "component_id"), "named")
    scratch.keep_only(told, of_content)
    scratch.release()
    return told.join(of_content, "cid", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _of_two(groups: DataFrame) -> DataFrame:
    """Rows whose signature more than one content has, with the smallest of these, ``lo``."""
    of = Window.partitionBy("sig")
    return groups.withColumn("lo", F.min("cid").over(of)).withColumn("hi", F.max("cid").over(of)).where("lo <> hi").drop("hi")


def _sharing_enough(groups: DataFrame) -> DataFrame:
    """Rows of contents that share as many signatures of a level as any partner of theirs would."""
    return groups.withColumn("held", F.count("*").over(Window.partitionBy("cid", "tag"))).where("held >= tag % 32").drop("held")


def _open(groups: DataFrame, least: int) -> DataFrame:
    """Groups (``sig, cid, tag, lo, comp``) of ``least`` members or more that lie in several components, with their size ``n``."""
    rows = groups.select("sig", "cid", "tag", "lo", "comp")
    state = rows.groupBy("sig").agg(F.count("*").alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where(f"c0 <> c1 and n >= {least}").select("sig", "n")
    return rows.join(state, "sig")


def _fewest(groups: DataFrame) -> DataFrame:
    """Groups without the rows that no pair needs to meet: a content that shares t signatures of a level with any partner leaves the t - 1 largest groups of that level."""
    order = Window.partitionBy("cid", "tag").orderBy(F.desc("n"), "sig")
    return groups.withColumn("place", F.row_number().over(order)).where("place >= tag % 32").drop("place")


def _clusters(spark: SparkSession, scratch: Scratch, large: DataFrame) -> DataFrame:
    """``key, cid, parts``: what is compared with each other; groups that overlap are one cluster unless it is larger than CLUSTER."""
    least = large.groupBy("sig").agg(F.min("cid").alias("lo"))
    label = connected_components(spark, large.join(least, "sig").select("lo", "cid").distinct(), scratch)
    label = scratch.write(label.withColumnRenamed("node", "cid"), "clusters")
    sizes = label.groupBy("component").count()
    fits = label.join(sizes.where(F.col("count") <= CLUSTER), "component").select(F.col("component").alias("key"), "cid", "count")
    over = label.join(sizes.where(F.col("count") > CLUSTER), "component").select("cid")
    split = large.join(over, "cid", "left_semi").select(F.col("sig").alias("key"), "cid")
    split = split.join(split.groupBy("key").count(), "key")
    return fits.unionByName(split).select("key", "cid", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))


def _between_blocks(scratch: Scratch, large: DataFrame, comps: DataFrame, sets: DataFrame, best_only: bool) -> DataFrame:
    # written, so that what meets itself and both sides of the join fetch sketches once
    members = scratch.write(_with_components(large, comps).join(sets.select("cid", "n", "sketch"), "cid"), "members")
    part = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("k")
    blocks = lambda rows: rows.groupBy("key", part, "parts").agg(F.collect_list(F.struct("cid", "comp", "n", "sketch")).alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    # a group of one block meets itself where it is; the others' blocks meet by a join
    alone = blocks(members.where("parts = 1")).where("c0 <> c1").select(F.col("m").alias("left"), F.col("m").alias("right"))
    content = blocks(members.where("parts > 1"))
    left = content.select("key", F.col("m").alias("left"), F.col("c0").alias("l0"), F.col("c1").alias("l1"), F.explode(F.expr("sequence(k, parts - 1)")).alias("j"))
    right = content.select("key", F.col("k").alias("j"), F.col("m").alias("right"), F.col("c0").alias("r0"), F.col("c1").alias("r1"))
    open_ = left.join(right, ["key", "j"]).where("least(l0, r0) <> greatest(l1, r1)")
    return alone.unionByName(open_.select("left", "right")).mapInArrow(_block_pairs(best_only), "a long, b long").distinct()


def one_of_each_group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose document is the smallest of its component; of repeated rows with one doc_id all stay."""
    found = jaccard_components(spark, docs)
    kept = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("d")).distinct()
    return docs.alias("x").join(kept.alias("y"), F.expr("x.doc_id <=> y.d"), "left_semi")
