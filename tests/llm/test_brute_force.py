"""Each operator against a brute-force statement of its contract, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomspan.llm import bpe, cover_tree, graph, jaccard, lang_id, line_dedup, nn_descent, packing, quality, suffix_dedup, vectors, warc  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "one", "x" * 5000, "é" * 300, "日本語のテキスト" * 40, "a b c d", "A  b\tc d", "İstanbul ΣΑΣ, O'Neil's. 'tis 12345 <|endoftext|>"]


class Components:
    def __init__(self, n):
        self.p = list(range(n))

    def find(self, x):
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a, b):
        self.p[self.find(a)] = self.find(b)

    def smallest(self, names):
        low = {}
        for i, n in enumerate(names):
            r = self.find(i)
            low[r] = min(low.get(r, n), n)
        return [low[self.find(i)] for i in range(len(names))]


@pytest.fixture(scope="module")
def corpus():
    r = np.random.default_rng(2)
    vocabulary = ["".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(vocabulary, n))
    rows = [(i, t) for i, t in enumerate(ODD)]
    passage = text(70)
    for _ in range(30):
        rows.append((len(rows), text(r.integers(1, 150)) + ".\n" + text(r.integers(1, 60))))
    for k in range(40):
        base = rows[len(ODD) + k % 6][1].split(" ")
        for _ in range(k % 5):
            base[r.integers(0, len(base))] = "new"
        rows.append((len(rows), " ".join(base)))
    for _ in range(25):
        rows.append((len(rows), text(r.integers(1, 40)) + " " + passage + " " + text(r.integers(1, 9))))
    rows += [(len(rows) + k, "Was. " * 60) for k in range(3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With columns whose names clash with what operators add."""
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    return df.withColumns({"offset": F.lit(1), "keep": F.lit("k"), "s": F.lit(0), "component_id": F.lit(0), "sequence_id": F.lit(0), "line": F.lit("l"), "n": F.lit(2)}).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_components(spark):
    r = np.random.default_rng(0)
    edges = [tuple(int(x) for x in e) for e in r.integers(0, 300, (200, 2))] + [(7, 7), (900, 901), (901, 902), (902, 903)]
    c = Components(1000)
    for a, b in edges:
        c.join(a, b)
    low = c.smallest(list(range(1000)))
    got = {x.node: x.component for x in graph.connected_components(spark, spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == {n: low[n] for e in edges for n in e}


def _tasks(spark, group: str, run) -> int:
    """Tasks of the jobs of ``run``, with shuffles of nine parts that nothing joins again."""
    held = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    told = spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds}
    return sum(x.numCompletedTasks for x in map(told.getStageInfo, stages) if x)


def test_stars_are_done_after_a_round(spark):
    scratch = line_dedup.Scratch(spark, "stars")
    stars = spark.createDataFrame([(n // 10 * 10, n) for n in range(1, 200) if n % 10], "a long, b long")
    found = {x.node: x.component for x in graph.connected_components(spark, stars, scratch).collect()}
    assert found == {n: n // 10 * 10 for n in range(200)}
    assert scratch.n == 2, "the links, and a round that finds nothing to move"


def test_packing(spark, docs, corpus, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(spark, docs, WORD, capacity=128, keep_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for x in rows:
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, dtype="<u4").tobytes())
        by_doc.setdefault(x.doc_id, []).append(x)
        by_sequence.setdefault(x.sequence_id, []).append(x)
    for d, text in corpus:
        parts = sorted(by_doc[d], key=lambda x: x.piece)
        assert [i for x in parts for i in x.ids] == [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert [x.start for x in parts] == [128 * k for k in range(len(parts))] and all(x.length == 128 for x in parts[:-1])
    for parts in by_sequence.values():
        at = 0
        for x in sorted(parts, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 128
    lengths = Counter(x.length for x in rows)
    alone = sum(n for n, _ in packing.best_fit(sorted(lengths.items(), reverse=True), 128))
    assert math.ceil(sum(x.length for x in rows) / 128) <= len(by_sequence) <= alone + 1
    whole = {x.sequence_id: x.ids for x in packing.assemble(packing.pack_documents(spark, docs, WORD, capacity=128, keep_ids=True)).collect()}
    assert sum(map(len, whole.values())) == sum(x.length for x in rows)
    assert packing.pack_documents(spark, nothing, WORD).count() == 0
    twice = packing.pack_documents(spark, docs.unionAll(docs), WORD)
    assert twice.count() == 2 * packing.pack_documents(spark, docs, WORD).count()
    assert twice.groupBy("sequence_id").agg((F.sum("length") == F.max(F.col("offset") + F.col("length"))).alias("ok")).where("not ok").count() == 0


def test_packing_encodes_as_the_library_does(spark):
    """Added tokens in a text are the library's business."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    texts = ["hello <unk> world <|endoftext|>", "a<|endoftext|>b", "A <|EndOfText|> b", "it<|startoftext|>'s", "<|endoftext|>" * 3, "plain. Text, here", ""]
    assert packing.encode_texts(texts, WORD) == [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]


def test_configuration_lp_on_the_lengths_of_documents():
    """The program comes within 5 % of its lower bound and covers all; its rounded columns place nine pieces of ten; the plan is no longer than best fit's."""
    import pyarrow.parquet as pq

    found = Counter()
    for data in packing.encode_texts([x or "" for x in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()], WORD):
        n = len(data) // 4 + 1
        found.update([4096] * (n // 4096) + [n % 4096] * (n % 4096 > 0))
    lengths = np.array(sorted(found))
    counts = np.array([found[x] for x in lengths.tolist()])
    x = packing.configuration_lp(lengths, counts, 4096)
    covered = np.zeros(len(lengths))
    for key, v in x.items():
        assert v > 0 and sum(int(lengths[j]) * a for j, a in key) <= 4096
        for j, a in key:
            covered[j] += a * v
    assert (covered >= counts * (1 - 1e-6)).all()
    assert sum(x.values()) <= 1.05 * (lengths @ counts) / 4096
    _, left = packing.rounded(lengths, counts, 4096)
    assert left.sum() <= 0.1 * counts.sum()
    planned = sum(n for n, _ in packing.plan(lengths.tolist(), counts.tolist(), 4096))
    assert planned <= sum(n for n, _ in packing.best_fit(list(zip(lengths[::-1].tolist(), counts[::-1].tolist(), strict=True)), 4096))


def test_packing_spreads_hot_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    pieces = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 40).otherwise(F.col("id") % 7 + 1).alias("length"), F.lit(1).alias("salt"), F.lit(2).alias("rank"), F.lit(0).alias("l"))
    rows = packing.pack(spark, pieces, ["id"], capacity=64).collect()
    assert len(rows) == 1000
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_configuration_lp_beats_best_fit_where_items_are_large():
    r = np.random.default_rng(1)
    lengths, counts = np.unique(r.integers(1100, 2200, 5000), return_counts=True)
    planned = packing.plan(lengths.tolist(), counts.tolist(), 4096)
    placed = Counter()
    for n, items in planned:
        assert sum(a * b for a, b in items) <= 4096
        for a, b in items:
            placed[a] += n * b
    assert placed == Counter(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    assert sum(n for n, _ in planned) < sum(n for n, _ in packing.best_fit(sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True), 4096))


def test_bpe(docs, corpus, nothing):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {x.doc_id: x for x in bpe.bpe_round_trip(docs, BYTE, public_tokenizers.PATTERN).collect()}
    for d, text in corpus:
        ids = enc.encode_ordinary(text or "")
        x = got[d]
        assert x.ids == ids and x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest() and bytes(x.decoded) == (text or "").encode()
    assert bpe.bpe_round_trip(nothing, BYTE, public_tokenizers.PATTERN).count() == 0


def test_bpe_trees_agree():
    b = bpe.loaded(BYTE, public_tokenizers.PATTERN)
    for w in ("hello", "thereupon" * 20, "ab", "ééé", "x" * 100):
        data = w.encode()
        assert b.merge_one(data) == b.merge_columns([data], 1 << max(2, (len(data) - 1).bit_length()))[0]


def test_jaccard(spark, docs, corpus, nothing):
    def words(t):
        return [w for w in t.encode().lower().split()]

    sets = []
    for _, t in corpus:
        w = words(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    c = Components(len(corpus))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                c.join(i, j)
    expected = {d: (len(s), low) for (d, _), s, low in zip(corpus, sets, c.smallest([d for d, _ in corpus]), strict=True)}
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark, docs).collect()}
    assert got == expected
    assert jaccard.jaccard_components(spark, nothing).count() == 0
    kept = jaccard.one_of_each_group(spark, docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {d for d, (_, low) in expected.items() if d == low}


def test_jaccard_shuffles_few_times(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(10 * g + k, " ".join([*words[13 * g : 13 * g + 60], f"x{k}"])) for g in range(20) for k in range(5)]
    of = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got: list = []
    tasks = _tasks(spark, "jaccard", lambda: got.extend(jaccard.jaccard_components(spark, of).collect()))
    assert {x.doc_id: x.component_id for x in got} == {d: d // 10 * 10 for d, _ in rows}
    assert tasks < 900, "777 as it is; 1084 where each filter was a join and wrote its rows"


def test_jaccard_of_repeated_and_null_ids(spark):
    """Links between texts hold whatever other rows share their ids."""
    r = np.random.default_rng(12)
    text = lambda n: " ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(n))
    a, b, c = text(100), text(100), text(60)
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (None, c), (None, None), (5, c + " more")]
    got = sorted(((x.doc_id or 0, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(0, 0, None), (0, 56, 5), (1, 96, 1), (1, 96, 1), (2, 97, 1), (3, 97, 1), (5, 57, 5)], key=lambda x: (x[0], x[1]))


def test_jaccard_large_groups(spark):
    """A common passage in documents of their own, and many near copies around the threshold: more than a group that is compared pair by pair."""
    r = np.random.default_rng(4)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(90):
        w = list(base)
        for p in r.choice(60, r.integers(0, 5), replace=False):
            w[p] = f"e{r.integers(0, 3)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join([*base[:30], *(f"u{k}_{i}" for i in range(r.integers(3, 20)))])) for k in range(60)]
    sets = [set(jaccard.shingle_set(t).tolist()) for _, t in rows]
    c = Components(len(rows))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 75 * len(a | b):
                c.join(i, j)
    expected = dict(zip((d for d, _ in rows), c.smallest([d for d, _ in rows]), strict=True))
    assert {x.doc_id: x.component_id for x in jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()} == expected


def test_word_hashes_tell_words_apart(monkeypatch):
    """Words are hashed side by side, across texts and slices: equal hashes where words are equal, and only there."""
    import re

    monkeypatch.setattr(jaccard, "SLICE", 50)
    long = "x" * 200
    texts = ["", " ", "Ab aB ba\x0bab\x1cab \t", long, f"{long}y y{long} {long}", "é É e\u0301", "a\u00a0b", "\ud800 z", "ab", *(f"w{k} w{k // 2}" for k in range(300))]
    words = [[w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode("utf-8", "surrogatepass"))] for t in texts]
    h, counts = jaccard.word_hashes(texts)
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    assert all(len(x) == 0 for x in jaccard.word_hashes([]))


def test_sketches_never_rule_out_links():
    r = np.random.default_rng(0)
    for n in (3, 40, 700):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.append(a[: int(n * 0.9)], r.integers(0, 2**63, max(1, n // 5), dtype=np.uint64)))
        x, y = (np.frombuffer(jaccard.sketch(s), dtype=np.uint8).reshape(1, -1) for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        assert np.abs(jaccard.folded(x, width) - jaccard.folded(y, width)).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("hot, chunk", [(2000, 3000), (8, 20)])
def test_suffix_dedup(spark, docs, corpus, nothing, hot, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    seen, expected = set(), {}
    for d, t in corpus:
        data = (t or "").encode()
        cover = np.zeros(len(data) + 1, dtype=int)
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                cover[p] += 1
                cover[p + 100] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[: len(data)] > 0
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        expected[d] = (len(data), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    for keep in (False, True):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.suffix_dedup(spark, docs, keep_text=keep).collect()}
        assert got == expected
    assert suffix_dedup.suffix_dedup(spark, nothing).count() == 0
    repeated = sorted((x.doc_id, x.n_removed) for x in suffix_dedup.suffix_dedup(spark, docs.unionAll(docs), keep_text=False).collect())
    assert repeated == sorted([(d, e[1]) for d, e in expected.items()] + [(d, e[0] if e[0] >= 100 else 0) for d, e in expected.items()])  # the second of two equal rows goes whole
    assert suffix_dedup.dedup_documents(spark, docs).columns == docs.columns


def test_suffix_dedup_of_odd_ids(spark):
    """Null, repeated and textual ids: rows are judged each on its own, in the order of id and text."""
    r = np.random.default_rng(4)
    passage, other = ("".join(r.choice(list("abcdefgh "), 150)) for _ in range(2))
    rows = [("b", "x" + passage), ("a", "y" + passage), (None, other + "z"), ("b", other + "w"), ("b", "a" + other), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"did": F.lit(1), "kept": F.lit(2)})
    got = sorted(((x.doc_id or "", x.n_bytes, x.n_removed) for x in suffix_dedup.suffix_dedup(spark, df).collect()))
    assert got == sorted([("", 151, 0), ("a", 151, 0), ("b", 151, 150), ("b", 151, 150), ("b", 151, 150), ("c", 0, 0)])
    out = suffix_dedup.dedup_documents(spark, df)
    assert out.columns == df.columns
    assert sorted((x.doc_id or "", x.text or "") for x in out.collect()) == sorted([("", other + "z"), ("a", "y" + passage), ("b", "x"), ("b", "w"), ("b", "a"), ("c", "")])


def test_multikey_groups_sort_as_bytes_do():
    r = np.random.default_rng(8)
    words = r.integers(0, 3, (400, 5)).astype(np.uint64) << np.uint64(56)
    index, run = suffix_dedup.multikey_groups([lambda i, k=k: words[i, k] for k in range(5)], 400, (np.arange(400),))
    by = {}
    for i, w in enumerate(map(tuple, words.tolist())):
        by.setdefault(w, []).append(i)
    assert [i for w in sorted(by) if len(by[w]) > 1 for i in by[w]] == index.tolist()
    assert len(set(run.tolist())) == sum(len(x) > 1 for x in by.values())


def windows(x):
    """Plain character shingles."""
    return {x[i : i + 12] for i in range(max(1, len(x) - 11))}


def test_line_dedup(spark, docs, corpus, nothing):
    lines = {(d, k): x.strip(" ") for d, t in corpus for k, x in enumerate((t or "").split("\n"))}
    first = {}
    for at in sorted(lines):
        if lines[at]:
            first.setdefault(lines[at], at)
    names = sorted(first.values())
    index = {at: i for i, at in enumerate(names)}

    sets = [windows(lines[at]) for at in names]
    c = Components(len(names))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.75 * len(a | b):
                c.join(i, j)
    low = c.smallest(names)
    expected = {at: low[index[first[x]]] if x else at for at, x in lines.items()}
    rows = line_dedup.line_components(spark, docs).collect()
    got = {(x.doc_id, x.line_no): (x.component_doc, x.component_line) for x in rows}
    assert set(got) == set(expected)
    missed = [at for at in expected if got[at] != expected[at]]
    assert len(missed) <= 0.05 * len(expected), missed  # banding is of high recall, not exact, and one link decides on a group
    assert all(x.kept == ((x.doc_id, x.line_no) == (x.component_doc, x.component_line)) for x in rows)
    assert line_dedup.line_components(spark, nothing).count() == 0
    assert line_dedup.line_components(spark, docs.unionAll(docs)).count() == 2 * len(rows)
    out = line_dedup.dedup_lines(spark, docs)
    assert out.columns == docs.columns
    texts = {x.doc_id: x.text for x in out.collect()}
    kept = {(x.doc_id, x.line_no) for x in rows if x.kept}
    for d, t in corpus:
        left = [x for k, x in enumerate((t or "").split("\n")) if (d, k) in kept]
        if d in texts:
            assert (texts[d] or "") == "\n".join(left)
        else:
            assert not "".join(left).strip()


def test_line_dedup_compares_large_bands_in_full(spark):
    """Pairs of near copies whose bands all come from one long phrase that many other lines hold too."""
    r = np.random.default_rng(6)
    word = lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    phrase = [word() for _ in range(20)]
    rows = []
    for k in range(200):
        own = [word() for _ in range(10)]
        rows += [(2 * k, " ".join(phrase + own)), (2 * k + 1, " ".join([*phrase, *own[:-1], word()]))]
    got = {x.doc_id: x.component_doc for x in line_dedup.line_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [got[2 * k] == got[2 * k + 1] == 2 * k for k in range(200)]
    assert sum(pairs) >= 199


def test_line_dedup_of_a_common_passage(spark, monkeypatch):
    """Lines that share a passage and little else, and a few long ones: as by brute force, and few pairs are compared, not those of all lines with all."""
    r = np.random.default_rng(11)
    text = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    passage = text(480).strip()
    lines = [f"q{text(int(n))} {passage} {text(int(n))}q" for n in r.integers(20, 200, 300)]
    long = text(20_000)
    lines += [f"x{long}{text(n)}x" for n in (100, 8_000, 8_100, 8_200)]
    counted, write = {}, line_dedup.Scratch.write

    def counting(self, df, name="t", compact=False):
        out = write(self, df, name, compact)
        counted[name] = counted.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup.Scratch, "write", counting)
    got = {x.doc_id: x.component_doc for x in line_dedup.line_components(spark, spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    sets = list(map(windows, lines))
    c = Components(len(lines))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.75 * len(a | b):
                c.join(i, j)
    assert [got[k] for k in range(len(lines))] == c.smallest(list(range(len(lines))))
    assert counted["apart"] <= 2 * len(lines)


def test_open_lines_meet_where_sketches_allow(spark):
    """Each line shares its rarest shingles with one other that is unlike it, and most of its own with many that are like it."""
    r = np.random.default_rng(31)
    draw = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    frames, rare = [draw(260), draw(260)], [draw(24) for _ in range(14)]
    lines = [x + f for x in rare for f in frames]
    sets = [{x[i : i + line_dedup.WINDOW] for i in range(len(x) - line_dedup.WINDOW + 1)} for x in lines]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(lines)) for a in range(b)}
    rows = spark.createDataFrame([(k, k, x) for k, x in enumerate(lines)], "lid long, comp long, line string")
    met = [tuple(p) for p in line_dedup._met(line_dedup.Scratch(spark, "met"), rows, 0.75).collect()]
    assert len(met) == len(set(met)) and {p for p, j in alike.items() if j >= 0.75} <= set(met)
    assert sum(j >= 0.75 for j in alike.values()) > 100 and all(alike[p] > 0.5 for p in met)


def test_open_lines_hold_what_components_share(spark, monkeypatch):
    """What one component alone holds stands first and is not kept; no pair of two components is lost by it."""
    r = np.random.default_rng(12)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 6))
    rows = []
    for g in range(30):
        base = [word() for _ in range(14)]
        for comp in range(2):
            for _ in range(3):
                own = list(base)
                own[int(r.integers(14))] = word()
                rows.append((len(rows), 1000 + 2 * g + comp, " ".join(own)))
        rows += [(len(rows) + k, 2000 + g, " ".join([*[f"only{g}text"] * 3, *base[:2], word(), "alone in here"])) for k in range(2)]
    sets = [{t[k : k + 12] for k in range(max(1, len(t) - 11))} for _, _, t in rows]
    comps = {}
    for (_, comp, _), x in zip(rows, sets, strict=True):
        for w in x:
            comps.setdefault(w, set()).add(comp)
    kept = []

    def counting(self, df, name="t", compact=False, f=line_dedup.Scratch.write):
        out = f(self, df, name, compact)
        if name == "held":
            kept.append(out.count())
        return out

    monkeypatch.setattr(line_dedup.Scratch, "write", counting)
    got = {tuple(x) for x in line_dedup._met(line_dedup.Scratch(spark, "lines"), spark.createDataFrame(rows, "lid long, comp long, line string"), 0.75).collect()}
    expected = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if rows[a][1] != rows[b][1] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert expected and expected <= got
    assert kept == [sum(len(comps[w]) > 1 for x in sets for w in x)]


def test_line_dedup_reads_long_tokens_whole(spark):
    """Against plain character shingles: what follows the first characters of a token counts, and as much as any other text."""
    r = np.random.default_rng(7)
    key = lambda n: "".join(r.choice(list("0123456789abcdef"), n))
    url = "https://www.example.com/archive/" + key(30)
    lines = ["https://www.example.com/a", "https://www.other.org/zzz", "2024-01-01T00:00:01Z", "2024-01-01T00:59:59Z", "see /usr/local/share/doc/one for more", "see /usr/local/share/man/two for more"]
    lines += ["I wrote this down last night, see " + url, "Nobody at our place would say " + url]
    lines += [f"common-prefix-{key(60)} {key(20)}" for _ in range(20)]
    lines += [x[:-4] + "wxyz" for x in lines[-20:]]  # near copies
    rows = list(enumerate(lines))
    long_url = "https://www.example.com/" + key(68)  # 0.95 alike, one with longer words on average
    lines += [long_url + " go", long_url + " go to"]
    rows = list(enumerate(lines))
    sets = list(map(windows, lines))
    c = Components(len(lines))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.75 * len(a | b):
                c.join(i, j)
    got = {x.doc_id: x.component_doc for x in line_dedup.line_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(lines))] == c.smallest(list(range(len(lines))))


def test_windows_of_a_line_share_it(spark):
    """Windows of a long line are hashed without a copy of the line for each."""
    line = spark.range(1, numPartitions=1).select(F.encode(F.repeat(F.lit("0123456789abcdefg"), 12_000), "UTF-16BE").alias("units")).localCheckpoint()
    began = time.time()
    n, distinct = line.select(line_dedup._hashes("units").alias("s")).select(F.size("s"), F.size(F.array_distinct("s"))).first()
    assert (n, distinct) == (17 * 12_000 - 11, 17)
    assert time.time() - began < 8


def test_line_dedup_of_crlf_texts(spark):
    """Blank lines stay, whatever blanks they hold; a line matches its copy with another ending."""
    rows = [(1, "hello world foo bar\r\n\r\nfirst\r\n\t\r\n"), (2, "second\r\n\r\n\t\nhello world foo bar"), (3, "\thello world foo bar \t\r\nthird")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lost = {(x.doc_id, x.line_no) for x in line_dedup.line_components(spark, df).collect() if not x.kept}
    assert lost == {(2, 3), (3, 0)}
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(spark, df).collect()} == {1: rows[0][1], 2: "second\r\n\r\n\t", 3: "third"}


def test_line_dedup_of_many_lines(spark):
    """Fifty thousand lines of one text, every other of which repeats an earlier one."""
    lines = [f"line number {k // 2} of a long text {k // 2 * 7919}" if k % 2 == 0 else f"the same line {k % 10} every time" for k in range(50_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "short\nand clean")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark, docs, 1.0).collect()}
    assert kept == {1: "\n".join(dict.fromkeys(lines)), 2: "short\nand clean"}


def test_line_dedup_recall(spark):
    """Of the pairs at 0.75 and above, in bands that hundreds of other lines share, at least 0.98 meet."""
    r = np.random.default_rng(9)
    word = lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    phrase = " ".join(word() for _ in range(14))
    rows, like = [], []
    for k in range(400):
        own = [word() for _ in range(24)]
        other = [*own[:4], word(), *own[5:14], word(), *own[15:]] if k % 2 else [*own[:9], word(), word(), word(), *own[12:]]
        texts = [phrase + " " + " ".join(x) for x in (own, other)]
        a, b = map(windows, texts)
        like.append(len(a & b) / len(a | b))
        rows += [(2 * k, texts[0]), (2 * k + 1, texts[1])]
    near = [k for k, x in enumerate(like) if x >= 0.75]
    assert len(near) >= 300 and min(like[k] for k in near) < 0.8
    got = {x.doc_id: x.component_doc for x in line_dedup.line_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in near) >= 0.98 * len(near)


def test_line_dedup_of_odd_ids(spark):
    """Null and repeated ids: rows that share one are judged apart, and lose lines of their own only."""
    rows = [(None, "the first line of all\nanother"), (5, "the first line of all\nmine"), (5, "yours and nobody else's\nmine too, as it happens"), (7, None), (None, "one more text without a name")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "lost": F.lit(2), "mine": F.lit(3)})
    out = line_dedup.dedup_lines(spark, df)
    assert out.columns == df.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in out.collect()) == sorted([(0, rows[0][1]), (5, "mine"), (5, rows[2][1]), (7, ""), (0, rows[4][1])])


def test_quality_model_on_known_junk(spark, nothing):
    r = np.random.default_rng(3)
    vocabulary = ["".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(800)]
    clean = [" ".join(r.choice(vocabulary, r.integers(8, 200))).capitalize() + "." for _ in range(300)]
    junk = ["SHOUT!! " * 40, " ".join(f"{w}###" for w in r.choice(vocabulary, 80)), "again " * 90, " | ".join(r.choice(vocabulary, 60))] * 8
    rows = [(i, t) for i, t in enumerate([*clean, *junk, None, "", " \n"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("votes", F.lit("clash"))
    got = {x.doc_id: x for x in quality.classify(spark, df).collect()}
    assert [got[i].keep for i in range(300)].count(True) >= 297
    assert not any(got[i].keep for i in range(300, len(rows)))
    assert all(0 <= x.quality_score <= 1 for x in got.values())
    assert quality.classify(spark, nothing).count() == 0
    own = df.select("*", F.col("doc_id").alias("__text"), F.col("doc_id").alias("Judged"))
    assert quality.classify(spark, own).where("__text = doc_id and Judged = doc_id").count() == len(rows)
    twice = quality.classify(spark, df.unionAll(df)).groupBy("doc_id").agg(F.count_distinct("quality_score").alias("n"), F.count("*").alias("c")).where("n <> 1 or c <> 2").count()
    assert twice == 0


def test_quality_shapes_cover_whole_words():
    plain = "x" * 24
    assert len({quality._shape(plain + end) for end in ("", "9", "Q9z", "+/=", "x" * 900 + "Zq7/")}) == 5


def test_label_model_finds_the_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(6000) < 0.8
    accuracy = (0.95, 0.9, 0.75, 0.65)
    votes = ["".join("-" if r.random() < 0.2 else str(int(t if r.random() < a else not t)) for a in accuracy) for t in truth]
    _, found, share = quality.label_model(Counter(votes))
    assert np.abs(found - accuracy).max() < 0.06 and abs(share - 0.8) < 0.05


def test_quality_against_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.classify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).join(labels, "doc_id")
    n = judged.groupBy((F.col("quality") == 1).alias("clean"), "keep").count().collect()
    right = sum(x["count"] for x in n if x.clean == x.keep)
    assert right >= 0.97 * sum(x["count"] for x in n)


def test_language_id(spark, sf_dir, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lang_id.identify_languages(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1
    held = [x for x in got if x.held_out]
    assert sum(x.lang == x.lang_pred for x in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 34 !", "en"), (3, "", None), (4, "und der die", None)], "doc_id long, text string, lang string")
    ppm = lang_id.learn(docs)
    pred = {x.doc_id: x.lang_pred for x in lang_id.identify(spark, odd, ppm).collect()}
    assert pred[1] == pred[2] == pred[3] == "und" and pred[4] == "de"
    assert lang_id.identify_languages(spark, nothing.withColumn("lang", F.lit("en"))).count() == 0


def test_texts_without_letters_have_no_language(spark):
    rows = [(k, t, x) for k, (t, x) in enumerate([("plain words of one tongue", "a"), ("autres mots que voici", "b")] * 30)]
    signs = ["½ ²", "①②", "Ⅷ", "123 _ !", "", None, "½ a"]
    df = spark.createDataFrame([*rows, *((1000 + k, t, None) for k, t in enumerate(signs))], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in lang_id.identify_languages(spark, df).where("doc_id >= 1000").collect()}
    assert [got[1000 + k] == "und" for k in range(len(signs))] == [not any(c.isalpha() for c in t or "") for t in signs]


def test_language_id_learns_every_label(spark, monkeypatch):
    """A label whose texts are all long, and more labels than get a full sample."""
    monkeypatch.setattr(lang_id, "MAX_LANGUAGES", 2)
    words = {"a": "abba cabbage bad dab ", "b": "hello hill ghoul log ", "c": "zyx wxyz vuz xuw "}
    rows = [(words[k] * (400 if k == "c" else 2), k) for k in words for _ in range(40)]
    ppm = lang_id.learn(spark.createDataFrame([(f"{i} {t}", k) for i, (t, k) in enumerate(rows)], "text string, lang string"), 6000)
    assert ppm.languages == ["a", "b", "c"] and ppm.ready().predict([words[k] for k in words])[0] == ["a", "b", "c"]


def test_code_lengths_are_exact():
    """Against a statement byte by byte."""
    texts = [b"the theory of the thing", b"then and there"]
    ppm = lang_id.Ppm(["x"], [texts])
    counts = {}
    for t in texts:
        padded = b"\n" * lang_id.ORDER + t
        for i in range(lang_id.ORDER, len(padded)):
            for o in range(lang_id.ORDER + 1):
                counts.setdefault(padded[i - o : i], Counter())[padded[i]] += 1
    query = b"the other zoo"
    bits, padded = 0.0, b"\n" * lang_id.ORDER + query
    for i in range(lang_id.ORDER, len(padded)):
        for o in range(lang_id.ORDER, -1, -1):
            c = counts.get(padded[i - o : i])
            if c is None:
                continue
            size = sum(c.values()) + len(c)
            if c[padded[i]]:
                bits += math.log2(size / c[padded[i]])
                break
            bits += math.log2(size / len(c))
        else:
            bits += 8
    assert ppm.ready().code_lengths([query])[0, 0] == pytest.approx(bits)


# --- vectors ----------------------------------------------------------------------------------

INF, NAN = float("inf"), float("nan")
SPECIAL = [(50, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (100, [NAN, 1.0]), (6, [None, 1.0]), (7, [0.99, 0.1]), (8, []), (9, [INF, 0.0]), (150, [1.0, 0.0, 0.0]), (11, [2.0, 0.0])]


def clustered(n=900, d=16, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(40, d))
    return [(i, (base[r.integers(0, 40)] + r.normal(size=d) * r.choice([0.05, 0.2, 0.4, 0.7])).tolist()) for i in range(n)]


def cosine(rows):
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_embedding_near_dedup(spark):
    rows = clustered()
    rows += [(1000 + k, rows[k][1]) for k in range(20)]
    linked = cosine(rows) >= 0.9
    np.fill_diagonal(linked, False)
    c = Components(len(rows))
    for i, j in zip(*np.nonzero(linked), strict=True):
        c.join(i, j)
    expected = {d: (int(n), low) for (d, _), n, low in zip(rows, linked.sum(1), c.smallest([d for d, _ in rows]), strict=True)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1))
    got = {x.vec_id: (x.n_links, x.component_id) for x in cover_tree.near_duplicates(spark, df, block=200).collect()}
    assert got == expected
    assert cover_tree.near_duplicates(spark, df.where("false")).count() == 0


def test_scattered_vectors_are_decided_at_the_top(monkeypatch):
    r = np.random.default_rng(8)
    base = r.normal(size=(1600, 64))
    x = vectors.unit(np.concatenate([base, base[:100] + r.normal(size=(100, 64)), base[100:200] + 0.1 * r.normal(size=(100, 64))]))  # strays at about 0.7, near copies
    a, b = (cover_tree.Tree(np.arange(k, len(x), 2), np.ones(len(x) // 2), x[k::2]) for k in (0, 1))
    made = []
    monkeypatch.setattr(cover_tree, "_expand", lambda *c, f=cover_tree._expand: (made.append(len((out := f(*c))[0])), out)[1])
    for m, n in ((a, a), (a, b)):
        linked = m.vectors @ n.vectors.T >= 0.9
        links, theirs, _ = cover_tree.dual_traversal(m, n, 0.9)
        assert (links == linked.sum(1) - (m is n)).all()
        assert m is n or (theirs == linked.sum(0)).all()
    assert sum(made) < len(x)  # wide nodes around strays met nearly all nodes


def test_embedding_bundles(spark, monkeypatch):
    """Trees in bundles of several, few rows a batch: the same links."""
    rows = clustered(700, 60, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    expected = cosine(rows) >= 0.9
    monkeypatch.setattr(cover_tree, "BUNDLES", 2)
    got = {x.vec_id: x.n_links for x in cover_tree.near_duplicates(spark, df, block=40).collect()}
    assert got == dict(enumerate((expected.sum(1) - 1).tolist()))


def test_embedding_special_vectors(spark):
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in cover_tree.near_duplicates(spark, spark.createDataFrame(SPECIAL, "vec_id long, embedding array<float>")).collect()}
    assert got == {50: (3, 2, False), 2: (3, 2, True), 7: (3, 2, False), 11: (3, 2, False), **{k: (0, k, True) for k in (3, 4, 100, 6, 8, 9, 150)}}


def test_nearest_neighbours_recall(spark):
    rows = clustered(1500, 24, 5)
    near = cosine(rows)
    np.fill_diagonal(near, -9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in nn_descent.search(spark, df, lambda c: F.pmod(c, F.lit(50)) == 0).collect():
        got.setdefault(x.query_id, []).append(x)
    assert set(got) == {i for i in range(1500) if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda x: x.rank)
        assert [x.rank for x in found] == [1, 2, 3, 4, 5] and q not in [x.vec_id for x in found]
        assert all(x.score == pytest.approx(near[q, x.vec_id], abs=1e-12) for x in found)
        assert [(-x.score, x.vec_id) for x in found] == sorted((-x.score, x.vec_id) for x in found)
        hits += len({x.vec_id for x in found} & set(np.argsort(-near[q])[:5].tolist()))
    assert hits >= 0.95 * 5 * len(got)


@pytest.mark.parametrize("spread", [0.014, 0.0032])
def test_nearest_neighbours_recall_in_a_dense_group(spark, spread):
    """Mean cosines of 0.9998 and 0.99999: half precision cannot tell these vectors apart."""
    r = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate((r.normal(size=64) + r.normal(size=(1500, 64)) * spread).tolist())]
    near = cosine(rows)
    np.fill_diagonal(near, -9)
    got = {}
    for x in nn_descent.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda c: F.pmod(c, F.lit(50)) == 0).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hits = sum(len(found & set(np.argsort(-near[q])[:5].tolist())) for q, found in got.items())
    assert len(got) == 30 and hits >= 0.95 * 5 * 30, hits


def test_nearest_neighbours_special_vectors(spark):
    df = spark.createDataFrame(SPECIAL, "vec_id long, embedding array<float>")
    is_query = lambda c: F.pmod(c, F.lit(50)) == 0
    got = sorted((x.query_id, x["rank"], x.vec_id) for x in nn_descent.search(spark, df, is_query).collect())
    assert got == [(50, 1, 2), (50, 2, 11), (50, 3, 7)]
    assert nn_descent.search(spark, df.where("false"), is_query).count() == 0


# --- archives ---------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    page = "<html lang='EN'><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><p>Hello <b>big</b>&nbsp;world<br>next<script>var x='</p>'</script></p><a href=\"/x?a=1&amp;b=2\">go</a></body></html>"
    pages = spark.createDataFrame([(1, "http://e.org/1", page), (2, None, None), (3, "u", ""), (1, "http://e.org/1", page)], "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    rows = warc.derivatives(pages).orderBy("page_id", "record_type").collect()
    assert len(rows) == 8
    by = {(x.page_id, x.record_type): x for x in rows}
    text, meta = by[1, "conversion"], by[1, "metadata"]
    assert text.block == "Hello big world\nnext\ngo"
    assert text.refers_to == meta.refers_to and text.record_id != meta.record_id
    assert "title: A & B" in meta.block and "outlink: /x?a=1&b=2" in meta.block and "languages-cld: en" in meta.block and "source-payload-digest-checked: true" in meta.block
    assert by[2, "conversion"].block == ""
    archive = b"".join(bytes(x.record) for x in warc.records(warc.derivatives(pages.where("page_id < 3").dropDuplicates(["page_id"]))).collect())
    parsed = list(warc.parse(archive))
    assert len(parsed) == 4
    for headers, block in parsed:
        assert headers["warc-block-digest"] == warc.digest(block) and int(headers["content-length"]) == len(block)
    headers, block = warc.response_record("http://e.org/1", page)
    source = {k.lower(): v for k, v in headers}
    assert source["warc-record-id"] == text.refers_to and source["warc-payload-digest"] == text.source_payload_digest
    assert list(warc.parse(warc.serialise(headers, block))) == [(source, block)]
    (tmp_path / "a.warc").write_bytes(archive)
    assert warc.read_archive(spark, str(tmp_path / "a.warc")).count() == 4
    assert warc.derive({"warc-type": "request"}, b"") == []
    assert warc.derivatives(pages.where("false")).count() == 0


def test_warc_of_broken_and_encoded_pages():
    """Unclosed tags cost no more than their length; charsets and content encodings are undone; text as an independent parser sees it."""
    import gzip
    import time
    from html.parser import HTMLParser

    for tag in ("<title>", "<a ", "<p ", "<head>", "<script ", "<!doctype ", '<a href="', "<html lang"):
        began = time.perf_counter()
        warc.derive({"warc-type": "response", "warc-record-id": "<urn:uuid:0>"}, (tag * 40_000).encode())
        assert time.perf_counter() - began < 5, tag
    page = "<html><head><title>T &amp; U</title></head><body><p>Café <b>au lait</b></p><script>x</script><div>two</div></body></html>"
    for extra, payload in (("", page.encode("latin-1")), ("Content-Encoding: gzip\r\n", gzip.compress(page.encode("latin-1")))):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n{extra}\r\n".encode() + payload
        (_, meta), (_, text) = warc.derive({"warc-type": "response", "warc-record-id": "<urn:uuid:0>"}, block)
        assert text.decode() == "Café au lait\ntwo" and "title: T & U\r\n" in meta.decode()

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("head", "script", "style", "noscript", "template")

        def handle_endtag(self, tag):
            self.skip -= tag in ("head", "script", "style", "noscript", "template")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        parser = Text()
        parser.feed(page or "")
        parser.close()
        assert "".join("".join(parser.out).split()) == "".join(warc.visible_text(page or "").split())


def test_warc_metadata_against_an_independent_parser(spark, sf_dir):
    """Title, language and outlinks of pages with comments, scripts and styles."""
    from html.parser import HTMLParser

    class Marks(HTMLParser):
        def __init__(self):
            super().__init__()
            self.title, self.lang, self.links, self.within = None, None, [], False

        def handle_starttag(self, tag, attrs):
            found = dict(reversed(attrs))
            if tag == "html" and self.lang is None:
                self.lang = found.get("lang")
            if tag == "a" and found.get("href") is not None:
                self.links.append(found["href"])
            if tag == "title" and self.title is None:
                self.title, self.within = "", True

        def handle_endtag(self, tag):
            self.within = self.within and tag != "title"

        def handle_data(self, data):
            if self.within:
                self.title += data

    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    pages += [
        "<!-- <title>ghost</title><a href='http://c/'> --><html lang='fr'><head><title>A  &amp;\n b</title><style>a{}<a href='s'></style></head><body><a class=x href=http://d/>d</a></body></html>",
        "<script>var t = \"<title>no</title><a href='http://s/'>\";</script><HTML LANG=de><TITLE>yes</TITLE><A HREF='http://x/?a=1&amp;b=2'>x</A><!-- open <a href='http://never/'>",
        "no markup at all", "<a href=''>empty</a><script>",
    ]
    for page in pages:
        want = Marks()
        want.feed(page)
        want.close()
        (_, meta), _ = warc.derive({"warc-type": "response", "warc-record-id": "<urn:uuid:0>"}, page.encode())
        fields = [x.partition(": ")[::2] for x in meta.decode().split("\r\n") if x]
        assert [v for k, v in fields if k == "outlink"] == [" ".join(x.split("\n")) for x in want.links], page[:200]
        assert [v for k, v in fields if k == "title"] == ([" ".join(want.title.split())] if want.title is not None else []), page[:200]
        assert [v for k, v in fields if k == "languages-cld"] == ([want.lang.lower()] if want.lang else []), page[:200]


def test_language_of_many_copies(spark, monkeypatch):
    """A label that has nothing but copies of one text is learned from one of them."""
    rows = [("aa", "bla blu " * 20)] * 500 + [("bb", f"xyzzy quux {k} " * 20) for k in range(50)]
    ppm = lang_id.learn(spark.createDataFrame(rows, "lang string, text string"), sample_bytes=3000).ready()
    assert ppm.languages == ["aa", "bb"] and ppm.predict(["bla blu bla", "quux xyzzy"])[0] == ["aa", "bb"]
