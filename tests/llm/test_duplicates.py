"""Jaccard join, suffix-array and substring dedup, and components, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import ugly
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_text import split

from keyforge.llm import components, jaccard_join, substring_dedup, suffix_dedup
from keyforge.llm.common import table


def corpus(seed=1, n=60):
    """Documents of 0 to 120 words, with passages that documents share, copies, near copies, and self-repeats."""
    rng = random.Random(seed)
    passages = [ugly.words(rng, rng.randint(8, 30)) for _ in range(6)]
    docs = []
    for k in range(n):
        w = ugly.words(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w = w[:at] + rng.choice(passages) + w[at:]
        if docs and rng.random() < 0.4:
            w = list(rng.choice(docs))
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = "edit"
        if rng.random() < 0.1:
            w = ["the"] * rng.randint(1, 40)
        docs.append(w)
    return {k + 1: " ".join(w) for k, w in enumerate(docs)}


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], ugly.SCHEMA).repartition(4)


def grams(text, n):
    w = split(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(docs, n, t):
    sets = {k: grams(x, n) for k, x in docs.items()}
    out = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= t:
                    out[a, b] = j
    return out


def expand(df):
    """All pairs that the rows stand for, of copies too; each row once, n - 1 for n copies."""
    rows, copy_of = df.collect(), {}
    for r in rows:
        assert r.doc_a < r.doc_b
        if r.jaccard == 1:
            assert copy_of.setdefault(r.doc_b, r.doc_a) == r.doc_a
    members = defaultdict(list)
    for b, a in copy_of.items():
        assert a not in copy_of
        members[a].append(b)
    out = {}
    for a, copies in members.items():
        every = [a, *copies]
        out |= {(min(x, y), max(x, y)): 1.0 for x in every for y in every if x != y}
    for r in rows:
        if r.jaccard < 1:
            assert not {r.doc_a, r.doc_b} & set(copy_of)
            for x in (r.doc_a, *members.get(r.doc_a, ())):
                for y in (r.doc_b, *members.get(r.doc_b, ())):
                    assert out.setdefault((min(x, y), max(x, y)), r.jaccard) == r.jaccard
    assert len({(r.doc_a, r.doc_b) for r in rows}) == len(rows)
    return out


def test_bands_reach_the_recall():
    for t, r in ((0.5, 0.95), (0.8, 0.99), (0.2, 0.9)):
        b, rows = jaccard_join.bands_for(t, r)
        assert 1 - (1 - t**rows) ** b >= r


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_pairs(spark, seed):
    docs = corpus(seed)
    want, got = similar(docs, 3, 0.5), expand(jaccard_join.jaccard_join(frame(spark, docs)))
    assert set(got) <= set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in got)
    assert len(got) >= 0.9 * len(want)


def test_jaccard_tiles(spark, monkeypatch):
    """Large groups are worked on in blocks; the blocks' size doesn't change the pairs."""
    rng = random.Random(3)
    base = ugly.words(rng, 60)
    docs = {k: " ".join("edit" if i == k else w for i, w in enumerate(base)) for k in range(1, 41)}
    want = expand(jaccard_join.jaccard_join(frame(spark, docs)))
    assert len(want) >= 0.9 * len(similar(docs, 3, 0.5))


def classes(docs, pairs):
    """(doc, least document of its connected group, how many it is paired with)."""
    root, links = {k: k for k in docs}, dict.fromkeys(docs, 0)
    for a, b in pairs:
        links[a], links[b] = links[a] + 1, links[b] + 1
        x, y = sorted((root[a], root[b]))
        root = {k: x if r == y else r for k, r in root.items()}
    return {(k, root[k], links[k]) for k in docs}


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_no_pair_at_the_threshold_is_missed(spark, threshold):
    """200 pairs at the threshold and just above it, of which banding with recall 0.95 misses some; sizes differ in half of them."""
    rng, docs, at = random.Random(5), {}, set()
    for k in range(200):
        shared, rest = (60, 60) if threshold == 0.5 else (80, 20)
        shared += k % 4
        left = rng.randint(0, rest) if k % 2 else rest // 2
        w = [f"w{k}x{i}" for i in range(shared + 2)]
        docs[2 * k] = " ".join(w + [f"a{k}x{i}" for i in range(left)])
        docs[2 * k + 1] = " ".join([f"b{k}x{i}" for i in range(rest - left)] + w)
        at.add((2 * k, 2 * k + 1))
    want = similar(docs, 3, threshold)
    assert set(want) == at
    got = expand(jaccard_join.jaccard_join(frame(spark, docs), threshold=threshold))
    assert got == want


@pytest.mark.parametrize("block", [None, ("BLOCK_DOCS", 7)])
def test_a_row_a_document(spark, monkeypatch, block):
    rng = random.Random(3)
    base = ugly.words(rng, 60)
    docs = corpus(6, 30) | {k: " ".join("edit" if i == k - 100 else w for i, w in enumerate(base)) for k in range(100, 140)} | {k: " ".join(base) for k in range(200, 210)}
    if block:
        monkeypatch.setattr(jaccard_join, *block)
    got = [tuple(r) for r in jaccard_join.jaccard_classes(frame(spark, docs)).collect()]
    assert len(got) == len(docs) and set(got) == classes(docs, similar(docs, 3, 0.5))
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard_join.jaccard_classes(ugly.documents(spark)).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == 1 and got[4] == (4, 0) and None not in got
    assert jaccard_join.jaccard_classes(ugly.empty(spark)).count() == 0


@pytest.mark.parametrize("block", [("BLOCK_DOCS", 7), ("BLOCK_GRAMS", 300)])
def test_split_buckets_give_the_same_pairs(spark, monkeypatch, block):
    rng = random.Random(3)
    base = ugly.words(rng, 60)
    docs = corpus(6, 30) | {k: " ".join("edit" if i == k - 100 else w for i, w in enumerate(base)) for k in range(100, 140)} | {k: " ".join(base) for k in range(200, 210)}
    df = frame(spark, docs)
    want, kept = ugly.rows(jaccard_join.jaccard_join(df)), ugly.rows(jaccard_join.drop_near_duplicates(df))
    monkeypatch.setattr(jaccard_join, *block)
    assert ugly.rows(jaccard_join.jaccard_join(df)) == want and ugly.rows(jaccard_join.drop_near_duplicates(df)) == kept


def test_large_parts_are_sent_in_rounds(spark, monkeypatch):
    rng = random.Random(3)
    base = ugly.words(rng, 60)
    docs = corpus(6, 30) | {k: " ".join("edit" if i == k - 100 else w for i, w in enumerate(base)) for k in range(100, 140)}
    rounds, run = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 7)
    monkeypatch.setattr(jaccard_join, "_verified", lambda *a: rounds.append(a) or run(*a))
    got = [tuple(r) for r in jaccard_join.jaccard_classes(frame(spark, docs)).collect()]
    assert len(rounds) >= 2 and set(got) == classes(docs, similar(docs, 3, 0.5))


def test_copies_cost_a_row_each(spark):
    docs = {k: f"the same words for {k % 3} documents of a crowd" for k in range(300)}
    got = jaccard_join.jaccard_join(frame(spark, docs)).filter("jaccard = 1").collect()
    assert {(r.doc_a, r.doc_b) for r in got} == {(k % 3, k) for k in range(3, 300)}


def test_join_on_ugly_tables(spark):
    got = expand(jaccard_join.jaccard_join(ugly.documents(spark)))
    assert got[1, 2] == 1 and (1, 3) in got and (2, 3) in got and got[7, 8] == 1
    assert (9, 10) in got and not {4, 5, 6, 13} & {x for p in got for x in p}
    assert jaccard_join.jaccard_join(ugly.empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = corpus(4)
    df = frame(spark, docs)
    edges = expand(jaccard_join.jaccard_join(df))
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    kept = jaccard_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [k for k in docs if find(k) == k]


def test_dropping_with_maps_and_clashing_names(spark):
    df = ugly.documents(spark).withColumns({c: F.lit(f"extra {c}") for c in ("row", "tie", "place", "__rank", "set_a", "kept", "members", "size")}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = jaccard_join.drop_near_duplicates(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == {None, 1, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15}
    assert {(r.row, r.m["a"]) for r in got.collect()} == {("extra row", 1)}


def test_dropping_on_ugly_tables(spark):
    df = ugly.documents(spark)
    got = jaccard_join.drop_near_duplicates(df)
    assert got.columns == df.columns
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert ids.count(None) == 2 and sorted(i for i in ids if i) == [1, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15]
    assert jaccard_join.drop_near_duplicates(ugly.empty(spark)).count() == 0


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=30))
@settings(max_examples=100, deadline=None)
def test_forest(edges):
    a, b = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
    node, root = components.forest(a, b)
    want = brute_components(edges)
    assert dict(zip(node.tolist(), root.tolist())) == want


def brute_components(edges):
    low = {x: x for e in edges for x in e}
    for _ in range(len(low)):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return {k: v for k, v in low.items() if k != v}


@pytest.mark.parametrize("shape", ["chain", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {"chain": [(k, k + 1) for k in range(60)], "random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)], "none": []}[shape]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 3), (5, None), (99, 99)], "a long, b long").repartition(6)
    assert dict(ugly.rows(components.components(df))) == brute_components(edges)


def brute_repeats(docs, length):
    """Repeated words by (doc, first doc)."""
    places = defaultdict(list)
    for k in sorted(docs):
        w = split(docs[k])
        for i in range(len(w) - length + 1):
            places[tuple(w[i : i + length])].append((k, i))
    own = defaultdict(set)
    for at in places.values():
        for k, i in at[1:]:
            own[k, at[0][0]].update(range(i, i + length))
    return own


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize(("length", "anchor", "hot"), [(8, 4, 1 << 14), (12, 3, 1 << 14), (5, 5, 1 << 14), (8, 4, 3), (5, 5, 1)])
def test_suffix_repeats(spark, monkeypatch, seed, length, anchor, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = corpus(seed)
    got = defaultdict(set)
    for r in suffix_dedup.repeats(frame(spark, docs), length, anchor).collect():
        span = set(range(r.start, r.start + r.words))
        assert not span & got[r.doc_id, r.first_doc_id]
        got[r.doc_id, r.first_doc_id] |= span
    assert got == brute_repeats(docs, length)


def test_lone_windows_in_many_batches():
    """The first occurrence is carried from batch to batch, and texts whose hashes collide are apart."""
    schema = pa.schema([("hash", pa.int64()), ("alone", pa.bool_()), ("doc_id", pa.int64()), ("word", pa.int64()), ("segment", pa.string())])
    rows = [(1, True, d, 0, "a b") for d in range(5)] + [(2, True, d, 1, "c d") for d in range(3)] + [(2, True, d, 7, "e f") for d in range(2)] + [(3, True, 9, 9, "g h")]
    want = [(d, 0, 0, 2) for d in range(1, 5)] + [(1, 0, 1, 3), (2, 0, 1, 3), (1, 0, 7, 9)]
    for size in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + size]), schema)], schema=schema) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in suffix_dedup._shards(2)(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize(("seed", "length", "anchor"), [(1, 8, 4), (2, 5, 5), (3, 12, 3)])
def test_all_pairs_of_a_repeat_follow_from_the_rows(spark, seed, length, anchor):
    """Places that rows connect, word by word, are all those with equal windows, in any two documents, and no others."""
    docs = corpus(seed)
    follows(docs, substring_dedup.maximal_repeats(frame(spark, docs), length, anchor).collect(), length)


def follows(docs, rows, length):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in rows:
        for i in range(r.words - length + 1):
            x, y = find((r.doc_id, r.start + i)), find((r.other_doc_id, r.other_start + i))
            root[max(x, y)] = min(x, y)
    got, want = defaultdict(set), defaultdict(set)
    for x in root:
        got[find(x)].add(x)
    for k, text in docs.items():
        w = split(text)
        for i in range(len(w) - length + 1):
            want[tuple(w[i : i + length])].add((k, i))
    want = [at for at in want.values() if len(at) > 1]
    assert want and sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def brute_maximal(docs, length):
    """Rows of maximal_repeats(): each window with the occurrence before it, extended both ways."""
    places = defaultdict(list)
    words = {k: split(docs[k]) for k in docs}
    for k in sorted(docs):
        for i in range(len(words[k]) - length + 1):
            places[tuple(words[k][i : i + length])].append((k, i))
    out = set()
    for at in places.values():
        for (a, x), (b, y) in zip(at, at[1:]):
            p, q, n = words[a], words[b], length
            while x and y and p[x - 1] == q[y - 1]:
                x, y, n = x - 1, y - 1, n + 1
            while x + n < len(p) and y + n < len(q) and p[x + n] == q[y + n]:
                n += 1
            out.add((b, y, n, a, x))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("length", "anchor", "hot"), [(8, 4, 1 << 17), (12, 3, 1 << 17), (8, 4, 2)])
def test_substring_repeats(spark, monkeypatch, seed, length, anchor, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    docs = corpus(seed) | {500: " ".join(["la"] * 50), 501: " ".join(["x", *["la"] * 30, "y"] * 2)}
    rows = [tuple(r) for r in substring_dedup.maximal_repeats(frame(spark, docs), length, anchor).collect()]
    assert len(set(rows)) == len(rows) and set(rows) == brute_maximal(docs, length)


def test_a_passage_in_many_batches(spark):
    """A cell's rows come in several Arrow batches: the last place of each window is carried over."""
    rng = np.random.default_rng(1)
    windows = [rng.integers(0, 5, 6) for _ in range(40)]
    rows = [(7, d, 0, w) for d, w in enumerate(windows)] + [(8, d, 3, w) for d, w in enumerate(windows[:10])]
    make = lambda part: pa.RecordBatch.from_pydict({"cell": [r[0] for r in part], "doc_id": [r[1] for r in part], "word": [r[2] for r in part], "windows": [r[3].tolist() for r in part]}, schema=pa.schema([("cell", pa.int64()), ("doc_id", pa.int64()), ("word", pa.int64()), ("windows", pa.list_(pa.int64()))]))
    got = []
    for size in (1, 7, 100):
        found = set()
        for b in substring_dedup._matches(1)(iter([make(rows[i : i + size]) for i in range(0, len(rows), size)])):
            for r in b.to_pylist():
                found |= {(r["doc_a"], r["doc_b"], r["diagonal"], s) for s in range(r["start"], r["end"])}
        got.append(found)
    assert got[0] == got[1] == got[2] and got[0]


def test_repeats_on_ugly_tables(spark):
    df = ugly.documents(spark)
    got = {(r.doc_id, r.first_doc_id) for r in suffix_dedup.repeats(df).collect()}
    assert got == {(2, 1), (10, 9)}
    pairs = {(r.other_doc_id, r.doc_id): (r.words, r.start, r.other_start) for r in substring_dedup.maximal_repeats(df).collect()}
    assert pairs == {(1, 2): (80, 0, 0), (9, 10): (15_000, 0, 0)}
    assert suffix_dedup.repeats(ugly.empty(spark)).count() == 0 == substring_dedup.maximal_repeats(ugly.empty(spark)).count()


def test_queries_find_what_brute_force_finds(spark):
    docs = {r.doc_id: r.text for r in table(spark, ugly.SF, "documents").collect()}
    own = brute_repeats(docs, 50)
    got = defaultdict(set)
    for r in suffix_dedup.op3_suffix_dedup(spark, ugly.SF).collect():
        got[r.doc_id, r.first_doc_id].update(range(r.start, r.start + r.words))
    assert got == own
    got = [tuple(r) for r in substring_dedup.op9_substring_dedup(spark, ugly.SF).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_maximal(docs, 50)
    assert {tuple(r) for r in jaccard_join.op2_jaccard_join(spark, ugly.SF).collect()} == classes(docs, similar(docs, 3, 0.5))
