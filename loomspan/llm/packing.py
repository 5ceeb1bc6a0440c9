"""Best-fit packing of token pieces into sequences.

The plan is made on the histogram of lengths (at most ``capacity`` bins, however many pieces there
are): a covering program whose variables are configurations (multisets of lengths that fit one
sequence). It is solved by multiplicative weights: each round prices every length by its weight, a
knapsack dynamic program over the capacity tables the best prices, columns near the optimum get a share of the remaining demand,
and lengths that stay behind gain weight. Rounded solutions of what is left, phase by phase, place nine pieces of ten and more;
the remainder goes best fit, longest first. Pieces then take their places by rank among those of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, text_or_empty, unused

CAPACITY = 4096
#: Pieces of one length that one task ranks, about.
RANKED = 1000
#: Columns of a round of the linear program, how near the optimum they come, and phases of solving and rounding, at most.
COLUMNS, NEAR, PHASES = 512, 0.002, 12
CACHE = 900_000
_STOP = re.compile(r"(?<=[a-zA-Z])([,.])(?=[ \n])")
_TOKENIZERS: dict[str, tuple] = {}


# --- cutting documents into pieces -------------------------------------------------------------


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        added = [x.content.lower() for x in t.get_added_tokens_decoder().values()]
        vocabulary = t.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            ends[i] = token.endswith("</w>")
        _TOKENIZERS[path] = (t, ends, {}, added)
    return _TOKENIZERS[path]


def _words(text: str) -> list[str]:
    """Parts of a text that are encoded apart, with the same ids as in place.

    Cut are blanks and, where a letter precedes and a blank follows, full stops and commas. Latin letters
    are lowered here, as the tokenizer does, so that fewer parts differ; elsewhere its own rules are left to it.
    """
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return _STOP.sub(r" \1", text).replace("\n", " ").split(" ")


def _learn(t, ends: np.ndarray, cache: dict[str, bytes], words: list[str]) -> None:
    """Latin words are one pretoken each and go through the tokenizer in one string, which its word-end tokens cut again; others go one by one."""
    latin = [w for w in words if w.isalpha() and len(w.encode("latin-1", "ignore")) == len(w)]
    single = set(words).difference(latin)
    for j in range(0, len(latin), 2000):
        part = latin[j : j + 2000]
        ids = np.array(t.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
        cuts = ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
        if len(cuts) == len(part):
            data = ids.tobytes()
            cache.update(zip(part, (data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
        else:
            single.update(part)
    rest = list(single)
    for j in range(0, len(rest), 20_000):
        part = rest[j : j + 20_000]
        for w, e in zip(part, t.encode_batch_fast(part, add_special_tokens=False), strict=True):
            cache[w] = array("I", e.ids).tobytes()


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts by a tokenizer whose words end in ``</w>`` and that drops white space; each distinct word is encoded once and remembered. Texts that hold one of the tokenizer's added tokens, in whatever case, are encoded in one piece."""
    t, ends, cache, added = _tokenizer(path)
    out: list[bytes] = []
    for i in range(0, len(texts), 512):
        odd = {k for k, x in enumerate(texts[i : i + 512]) if any(map(x.lower().__contains__, added))}
        split = [[] if k in odd else _words(x) for k, x in enumerate(texts[i : i + 512])]
        missing = set().union(*split).difference(cache)
        if len(cache) + len(missing) > CACHE:
            cache.clear()
            missing = set().union(*split)
        _learn(t, ends, cache, list(missing))
        get = cache.__getitem__
        out += [array("I", t.encode(texts[i + k], add_special_tokens=False).ids).tobytes() if k in odd else b"".join(map(get, s)) for k, s in enumerate(split)]
        for w in missing:
            if len(w) > 256:
                cache.pop(w, None)
    return out


def _cut(path: str, capacity: int, end_id: int, keep: bool):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for d, b in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1).to_pylist(), path), strict=True):
                b += end
                for k, at in enumerate(range(0, len(b), 4 * capacity)):
                    part = b[at : at + 4 * capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            columns = {"doc_id": pa.array(doc, batch.column(0).type), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if keep:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """Token pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32[, ids]``.

    Each document's ids are followed by ``end_id``; a null text counts as empty and gives a piece of
    that one id. Only documents longer than the capacity are cut.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_cut(tokenizer_path, capacity, end_id, keep_ids), schema)


# --- the linear program on the histogram -------------------------------------------------------


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the largest total price of lengths (each any number of times) that fit c; last[c]: the index of one of them, -1 for none."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        best[c], last[c] = best[c - 1], -2
        if k:
            v = prices[:k] + best[c - lengths[:k]]
            j = int(v.argmax())
            if v[j] > best[c] + 1e-12:
                best[c], last[c] = v[j], j
    return best, last


def _draw(best: np.ndarray, lengths: np.ndarray, prices: np.ndarray, left: np.ndarray, c: int, rng: np.random.Generator) -> dict[int, int]:
    """A configuration of capacity c, drawn from those whose price comes near the table's optimum at every step, what is left more often; where none of these is left, the longest that fits."""
    items: dict[int, int] = {}
    while c >= lengths[0]:
        k = int(np.searchsorted(lengths, c, side="right"))
        near = np.flatnonzero((left[:k] > 1e-9) & (prices[:k] + best[c - lengths[:k]] >= best[c] * (1 - NEAR)))
        if not near.size:
            near = np.flatnonzero(left[:k] > 1e-9)[-1:]
            if not near.size:
                break
        share = np.cumsum(left[near])
        j = int(near[min(len(near) - 1, np.searchsorted(share, rng.random() * share[-1], side="right"))])
        items[j] = items.get(j, 0) + 1
        c -= int(lengths[j])
    return items


def configuration_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 12, epsilon: float = 0.1, seed: int = 0) -> dict[tuple, float]:
    """Fractional numbers of configurations that cover the histogram, by multiplicative weights: a feasible point of the covering program.

    A configuration is a tuple of (index of a length, copies). ``lengths`` ascend. In each round the knapsack table prices every capacity under
    the current weights; lengths with demand left, up to ``COLUMNS`` of them, each get a column, drawn from the table around one copy of
    their own. Columns ask for what their length has left and get the share that the scarcest of their members allows. Lengths
    that stay behind the others gain weight. After the rounds, columns for what is left are drawn one after the other, each as often as its members last.
    """
    left, weight, rng = counts.astype(float), np.ones(len(lengths)), np.random.default_rng(seed)
    x: dict[tuple, float] = {}
    for t in range(rounds):
        some = np.flatnonzero(left > 1e-9)
        if not some.size:
            break
        own, price = lengths[some], weight[some] * lengths[some] / capacity
        best, _ = knapsack(own, price, capacity)
        top = float((price + best[capacity - own]).max())
        share = left[some] * own
        seeds = some if len(some) <= COLUMNS else rng.choice(some, COLUMNS, replace=False, p=share / share.sum())
        columns, asked = [], np.zeros(len(lengths))
        for i in np.searchsorted(some, np.sort(seeds))[::-1].tolist():
            items = _draw(best, own, price, left[some], capacity - int(own[i]), rng)
            items[i] = items.get(i, 0) + 1
            at, a = some[list(items)], np.array(list(items.values()))
            if price[list(items)] @ a < (1 - 2 * NEAR) * top:
                continue
            wanted = left[some[i]] / items[i]
            columns.append((at, a, wanted))
            asked[at] += a * wanted
        allowed = np.where(asked > 0, left / np.maximum(asked, 1e-12), 1.0)
        for at, a, wanted in columns:
            step = wanted * min(1.0, float(allowed[at].min()))
            key = tuple(sorted(zip(at.tolist(), a.tolist(), strict=True)))
            x[key] = x.get(key, 0.0) + step
            left[at] -= a * step
        left = np.maximum(left, 0)
        behind = left / counts
        weight = np.clip(weight * np.exp(epsilon * (behind - behind.mean())), 0.8, 1.25)
    if (left > 1e-9).any():
        price = weight * lengths / capacity
        best, _ = knapsack(lengths, price, capacity)
        for i in range(len(lengths) - 1, -1, -1):
            while left[i] > 1e-9:
                items = _draw(best, lengths, price, left, capacity - int(lengths[i]), rng)
                items[i] = items.get(i, 0) + 1
                step = min(left[j] / a for j, a in items.items())
                key = tuple(sorted(items.items()))
                x[key] = x.get(key, 0.0) + step
                for j, a in items.items():
                    left[j] -= a * step
    return x


def rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 12) -> tuple[list[tuple[int, list[tuple[int, int]]]], np.ndarray]:
    """Columns of the program in whole numbers, and the counts that they leave.

    Each phase solves the program of what is left, rounds down, and then up in the order of the fractions, wherever all members are there and
    the column wastes no more than columns do on average. Phases end when a tenth is left or a phase places little.
    """
    out: list[tuple[int, list[tuple[int, int]]]] = []
    left = counts.copy()
    for phase in range(PHASES):
        some = np.flatnonzero(left)
        if not some.size or left.sum() <= 0.1 * counts.sum() and phase:
            break
        x = configuration_lp(lengths[some], left[some], capacity, rounds, seed=phase)
        waste = {key: capacity - sum(int(lengths[some[j]]) * a for j, a in key) for key in x}
        bound = sum(waste[key] * v for key, v in x.items()) / sum(x.values())
        before = left.sum()
        for up in (0, 1):
            for key, v in sorted(x.items(), key=lambda kv: (waste[kv[0]], -(kv[1] % 1) if up else -kv[1], kv[0])):
                if waste[key] > bound:
                    break
                m = min([int(v) if not up else 1, *(int(left[some[j]]) // a for j, a in key)])
                if m > 0:
                    out.append((m, [(int(lengths[some[j]]), a) for j, a in key]))
                    for j, a in key:
                        left[some[j]] -= a * m
        if before - left.sum() < 0.01 * counts.sum():
            break
    return out, left


def plan(lengths: list[int], counts: list[int], capacity: int, rounds: int = 12) -> list[tuple[int, list[tuple[int, int]]]]:
    """Integral plan: (how many sequences, [(length, copies), ...]); every length is placed exactly as often as it occurs.

    Where the rounded program misses the lower bound and best fit alone does with fewer sequences (as happens where most pieces
    fill one alone), that plan is taken.
    """
    order = np.argsort(lengths)
    lens, cnt = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    if not len(lens):
        return []
    if lens[0] < 1 or lens[-1] > capacity:
        raise ValueError(f"lengths must lie in 1..{capacity}")
    columns, left = rounded(lens, cnt, capacity, rounds)
    rest = lambda n: [(int(a), int(b)) for a, b in zip(lens[::-1], n[::-1], strict=True) if b]
    planned, size = best_fit(rest(left), capacity, columns), lambda p: sum(n for n, _ in p)
    if size(planned) > -(-int(lens @ cnt) // capacity) and size(plain := best_fit(rest(cnt), capacity)) < size(planned):
        return plain
    return planned


def best_fit(rest: list[tuple[int, int]], capacity: int, opened: list[tuple[int, list[tuple[int, int]]]] = []) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, on (length, count): each goes where the least space stays free, in sequences that are ``opened`` or in new ones."""
    free: dict[int, list[list]] = {}  # free space: [[how many, items], ...]
    spaces: list[int] = []

    def add(space: int, n: int, items: list[tuple[int, int]]) -> None:
        if space not in free:
            free[space] = []
            insort(spaces, space)
        free[space].append([n, items])

    for n, items in opened:
        add(capacity - sum(a * b for a, b in items), n, items)
    for length, count in rest:
        while count:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                per = capacity // length
                if full := count // per:
                    add(capacity - full // max(full, 1) * per * length, full, [(length, per)])
                if more := count - full * per:
                    add(capacity - more * length, 1, [(length, more)])
                break
            space = spaces[k]
            bins = free[space]
            n, items = bins.pop()
            if not bins:
                del free[space]
                spaces.pop(k)
            per = min(space // length, count)
            take = min(n, count // per)
            if take < n:
                add(space, n - take, items)
            add(space - per * length, take, [*items, (length, per)])
            count -= take * per
    return [(n, items) for bins in free.values() for n, items in bins]


def slots(planned: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): the pieces of that length and those ranks lie at the offset of consecutive sequences."""
    out, taken, base = [], {}, 0
    for n, items in planned:
        offset = 0
        for length, copies in sorted(items, reverse=True):
            for _ in range(copies):
                first = taken.get(length, 0)
                out.append((length, first, n, base, offset))
                taken[length] = first + n
                offset += length
        base += n
    return out


def _placed(rows: list[tuple[int, int, int, int, int]], length_col: str, rank_col: str):
    rows = sorted(rows)
    length, first, _, base, offset = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, dtype=np.int64),) * 5
    key = length << 48 | first  # ranks stay below 2**48

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(rank_col).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, batch.column(length_col).to_numpy(zero_copy_only=False) << 48 | rank, side="right") - 1
            keep = [n for n in batch.schema.names if n not in (rank_col, length_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(base[at] + rank - first[at]), pa.array(offset[at])], names=[*keep, "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, pieces: DataFrame, order_by: list[str], length_col: str = "length", capacity: int = CAPACITY, rounds: int = 12) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces: each sequence is gapless from 0 and holds at most ``capacity``.

    ``order_by`` names columns that identify a piece; they only decide who of equal length goes where.
    Repeated rows are packed as often as they occur, an empty table gives no rows, a piece longer than the capacity
    or shorter than 1 (or null) is an error. Other columns are carried along, whatever their names; those named ``sequence_id`` or ``offset`` are replaced.
    What comes to the driver is the histogram (at most ``capacity`` rows), and what is broadcast is as long. Ranks are counted in parts of
    about ``RANKED`` pieces of a length, so that a length that most pieces share is spread, however many there are.
    """
    pieces = pieces.drop("sequence_id", "offset")
    histogram = pieces.groupBy(F.col(length_col).cast("long").alias("l")).count().collect()
    if any(r.l is None for r in histogram):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    rows = slots(plan([r.l for r in histogram], [r["count"] for r in histogram], capacity, rounds))
    names = pieces.columns
    l, parts, salt, n, before, rank = (unused(pieces, x) for x in ("l", "parts", "salt", "n", "before", "rank"))
    dealt = F.broadcast(spark.createDataFrame([(r.l, -(-r["count"] // RANKED)) for r in histogram], f"{l} long, {parts} long"))
    salted = pieces.withColumn(l, F.col(length_col).cast("long")).join(dealt, l).withColumn(salt, F.pmod(F.xxhash64(*order_by), F.col(parts))).drop(parts)
    sizes = salted.groupBy(l, salt).agg(F.count("*").alias(n))
    w = Window.partitionBy(l).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select(l, salt, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(before))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy(l, salt).orderBy(*order_by)) - 1)
    ranked = ranked.join(earlier, [l, salt]).select(*names, l, (F.col(rank) + F.col(before)).alias(rank))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placed(rows, l, rank), schema)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Cuts, tokenises and packs documents; see ``cut_documents`` and ``pack``.

    The pieces are written to the shared folder between the two passes, so tokenising is not repeated.
    """
    scratch = Scratch(spark, "pack")
    pieces = scratch.write(cut_documents(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces")
    return pack(spark, pieces, ["doc_id", "piece"], "length", capacity)


def assemble(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from packed pieces that carry ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
