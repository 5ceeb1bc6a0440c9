"""Byte-level BPE: encoding and decoding of whole texts.

A pretoken's bytes sit in the leaves of a segment tree. Leaf ``i`` holds the rank of the
pair that starts at live position ``i``, and each inner node the smallest ``(rank, position)``
below it, so that the root names the leftmost pair of the lowest rank. A merge changes the
leaves of the merged pair, of its left neighbour and of the position that it swallows, and
repairs their paths to the root: O(log n) for each merge.

Pretokens of one width class are merged side by side in numpy arrays (one tree in each column);
long ones go through the same tree one at a time.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_or_empty

NONE = np.int64(1 << 62)
SIDE_BY_SIDE = 512  # widest class that is merged in columns
CACHE = 700_000  # pretokens a worker remembers
_LOADED: dict[tuple, "ByteBpe"] = {}


class ByteBpe:
    """The encoder of one rank file; ``pattern`` cuts texts into pretokens that are encoded apart."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.single = np.full(256, -1, dtype=np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
        if (self.single < 0).any():
            raise ValueError("the rank file must hold every single byte")
        pairs = {}
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], NONE)
        self.pair_rank = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], NONE)
        self.pairs = pairs
        self.cache: dict[str, bytes] = {}

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], NONE)

    def merge_columns(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Encodes pieces of at most ``width`` bytes (a power of two), one tree a column."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        pos = np.arange(width)
        live = pos[None, :] < lengths[:, None]
        tokens = np.full((n, width + 1), -1, dtype=np.int64)  # the last column is the end of every piece
        tokens[:, :width] = np.where(live, self.single[flat], -1)
        after = np.minimum(np.broadcast_to(pos + 1, (n, width)), width).astype(np.int64)
        after = np.where(after < lengths[:, None], after, width)
        before = np.broadcast_to(np.append(pos - 1, width - 1), (n, width + 1)).astype(np.int64).copy()
        shift = np.int64(width.bit_length())  # a position takes as many bits
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        if width > 1:
            both = live[:, 1:]
            rank = self._rank_of(np.where(both, tokens[:, : width - 1], 0), np.where(both, tokens[:, 1:width], 0))
            rank = np.where(both, rank, NONE)
            tree[:, width : 2 * width - 1] = np.where(rank < NONE, rank << shift | pos[: width - 1], NONE)
        for level in range(width.bit_length() - 2, -1, -1):
            lo, hi = 1 << level, 2 << level
            tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])
        rows = np.flatnonzero(tree[:, 1] < NONE) if width > 1 else np.empty(0, dtype=np.int64)
        while rows.size:
            top = tree[rows, 1]
            at = top & ((np.int64(1) << shift) - 1)
            gone = after[rows, at]
            nxt = after[rows, gone]
            merged = top >> shift
            tokens[rows, at] = merged
            tokens[rows, gone] = -1
            after[rows, at] = nxt
            before[rows, nxt] = at
            prev = before[rows, at]
            right, left = tokens[rows, nxt], np.where(prev >= 0, tokens[rows, np.maximum(prev, 0)], -1)
            up_r = np.where((nxt < width) & (right >= 0), self._rank_of(merged, np.maximum(right, 0)), NONE)
            up_l = np.where(left >= 0, self._rank_of(np.maximum(left, 0), merged), NONE)
            tree[rows, width + gone] = NONE
            tree[rows, width + at] = np.where(up_r < NONE, up_r << shift | at, NONE)
            has = prev >= 0
            tree[rows[has], width + prev[has]] = np.where(up_l[has] < NONE, up_l[has] << shift | prev[has], NONE)
            nodes = (width + gone, width + at, np.where(has, width + prev, width + at))
            for _ in range(width.bit_length() - 1):
                nodes = tuple(x >> 1 for x in nodes)
                for x in nodes:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
            rows = rows[tree[rows, 1] < NONE]
        kept = tokens[:, :width]
        mask = kept >= 0
        ids = kept[mask].astype("<u4").tobytes()
        ends = np.cumsum(mask.sum(axis=1)) * 4
        starts = ends - mask.sum(axis=1) * 4
        return [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def merge_one(self, piece: bytes) -> bytes:
        """The same tree for one long piece, with plain integers."""
        n = len(piece)
        width = 1 << max(0, (n - 1).bit_length())
        none, pairs = int(NONE), self.pairs
        tok = [int(self.single[b]) for b in piece] + [-1]
        after, before = list(range(1, n + 1)) + [n], list(range(-1, n))
        tree = [none] * (2 * width)
        rank_of = lambda a, b: pairs.get(a << 32 | b, -1)
        for i in range(n - 1):
            r = rank_of(tok[i], tok[i + 1])
            if r >= 0:
                tree[width + i] = r << 32 | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                value = tree[2 * i] if tree[2 * i] < tree[2 * i + 1] else tree[2 * i + 1]
                if tree[i] == value:
                    break
                tree[i] = value

        while width > 1 and tree[1] < none:
            at = tree[1] & 0xFFFFFFFF
            tok[at] = tree[1] >> 32
            gone = after[at]
            nxt = after[at] = after[gone]
            before[nxt] = at
            tok[gone] = -1
            put(gone, none)
            r = rank_of(tok[at], tok[nxt]) if nxt < n else -1
            put(at, r << 32 | at if r >= 0 else none)
            if (prev := before[at]) >= 0:
                r = rank_of(tok[prev], tok[at])
                put(prev, r << 32 | prev if r >= 0 else none)
        return array("I", [t for t in tok[:n] if t >= 0]).tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes pretokens that the cache doesn't hold yet."""
        classes: dict[int, list[str]] = {}
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(b)) is not None:
                self.cache[w] = array("I", [whole]).tobytes()
            elif len(b) > SIDE_BY_SIDE:
                self.cache[w] = self.merge_one(b)
            else:
                classes.setdefault(max(4, 1 << (len(b) - 1).bit_length()), []).append(w)
        for width, group in classes.items():
            step = max(64, 400_000 // width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.cache.update(zip(part, self.merge_columns([w.encode("utf-8", "surrogatepass") for w in part], width), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for i in range(0, len(texts), 256):
            found = [self.find(t) for t in texts[i : i + 256]]
            missing = set().union(*found).difference(self.cache)
            if len(self.cache) + len(missing) > CACHE:
                self.cache.clear()
                missing = set().union(*found)
            self.learn(list(missing))
            get = self.cache.__getitem__
            out += [b"".join(map(get, words)) for words in found]
            for w in missing:
                if len(w) > 256:
                    self.cache.pop(w, None)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def loaded(ranks_path: str, pattern: str) -> ByteBpe:
    """One encoder a worker process."""
    key = (ranks_path, pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(ranks_path, pattern)
    return _LOADED[key]


def _batches(ranks_path: str, pattern: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = bpe.encode_batch(texts)
            back = [bpe.decode(x) for x in ids]
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
            }
            if keep:
                columns["ids"] = pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32()))
                columns["decoded"] = pa.array(back, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns a row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with
    ``keep_ids``, ``ids array<int>`` and ``decoded binary``. A null text counts as empty and an
    empty text has no ids; repeated rows give repeated rows; an empty table gives none; columns
    other than the two named are ignored, whatever their names. Texts of any length are encoded
    whole. There is no shuffle, and a lost task is simply run again.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded binary"
    return docs.select(docs[id_col].alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_batches(ranks_path, pattern, keep_ids), schema)
