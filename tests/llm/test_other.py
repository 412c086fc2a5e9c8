"""Decontamination, mixing, embeddings, WARC packages and the pipeline."""

from __future__ import annotations

import gzip
import io
import json
import random
import zipfile
from collections import Counter

import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pytest
import ugly
from pyspark.sql import functions as F
from test_duplicates import brute_components, corpus, frame, grams

import corpus_pipeline
from keyforge.llm import decontaminate, embedding_dedup, mixing, queries, secrets, toxicity, warc
from keyforge.llm.common import table


@pytest.mark.parametrize("name", queries.oracle_sql())
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_agrees_with_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    df = queries.queries()[name](spark, d)
    assert oracle.compare(df, oracle.connection(d), queries.oracle_sql()[name]) is None


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("rows, batches", [(None, 4), (500, 2)])
def test_few_texts_are_read_at_once(spark, tmp_path, rows, batches):
    """4096 long texts in a batch fill a task's memory; a session's own setting stays."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.range(1000).selectExpr("id AS doc_id", "repeat('a ', 10) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = spark.newSession()
    if rows:
        own.conf.set(name, rows)
    ran = table(own, str(tmp_path), "documents")._jdf.queryExecution()
    assert ran.toRdd().count() == 1000
    node = ran.executedPlan()
    while node.nodeName() != "ColumnarToRow":
        node = node.children().head()
    assert node.metrics().get("numInputBatches").get().value() == batches


# decontamination


def benchmark(spark, rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


@pytest.mark.parametrize("item_bytes", [decontaminate.ITEM_BYTES, 0])
def test_containment(spark, item_bytes):
    docs = corpus(7)
    some = {k: t for k, t in docs.items() if len(t.split()) > 40}
    items = {k: " ".join(t.split()[5 : 5 + 8 + k % 40]) for k, t in list(some.items())[:12]} | {900: "nothing like it at all in there", 901: "short", 902: None, 903: ""}
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contaminated(frame(spark, docs), benchmark(spark, [*items.items(), *list(items.items())[:2]]), item_bytes=item_bytes).collect()}
    want = {}
    for i, t in items.items():
        g = grams(t or "", 5)
        for d, x in docs.items():
            if g and (c := len(g & grams(x, 5)) / len(g)) >= 0.8:
                want[d, i] = c
    assert len(want) > 12 and set(got) <= set(want) and len(got) >= 0.95 * len(want) and all(abs(got[p] - want[p]) < 1e-12 for p in got)


@pytest.mark.parametrize("item_bytes", [decontaminate.ITEM_BYTES, 0])
def test_items_in_long_documents(spark, item_bytes):
    df = ugly.documents(spark)
    long = df.filter("doc_id = 9").first().text.split()
    items = [(k, " ".join(long[s : s + n])) for k, (s, n) in enumerate([(0, 15), (14_990, 40), (29_960, 40), (100, 500), (777, 16), (5, 20_000)])]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, benchmark(spark, items), item_bytes=item_bytes).collect()}
    assert got == {(9, k) for k in range(6)} | {(10, k) for k in (0, 3, 4)}
    assert decontaminate.contaminated(df, benchmark(spark, []), item_bytes=item_bytes).count() == 0
    assert decontaminate.contaminated(ugly.empty(spark), benchmark(spark, items), item_bytes=item_bytes).count() == 0
    kept = decontaminate.drop_contaminated(df, benchmark(spark, items))
    assert kept.columns == df.columns and kept.count() == df.count() - 2


@pytest.mark.parametrize("item_bytes", [decontaminate.ITEM_BYTES, 0])
def test_small_items_agree_with_sql(spark, item_bytes):
    rng = random.Random(3)
    docs = [(k, " ".join(ugly.words(rng, 640))) for k in range(40)] + [(100, "only four words here"), (101, "only four words here too"), (102, ""), (103, None)]
    items = [(0, "only four words here"), (1, "four words"), (2, ""), (3, None)]
    for k, t in docs[:40]:
        w = t.split()
        for n in range(5, 12):
            for s in (0, rng.randrange(20, 600), 640 - n):
                got = w[s : s + n]
                items.append((len(items), " ".join(got)))
                items.append((len(items), " ".join([*got[:-1], "changed"])))  # of 5 shingles on, 4/5 or more are left
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [k for k, _ in docs], "text": [t for _, t in docs]}))
    for few in (items, items[:4]):
        con.register("benchmark", pa.table({"item_id": [k for k, _ in few], "text": [t for _, t in few]}))
        got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark(spark, few), item_bytes=item_bytes)
        assert oracle.compare(got, con, decontaminate.SQL) is None


# mixing


def brute_mix(rows, quality, weights=None, share=1.0):
    import hashlib
    import math

    total = Counter()
    for d, t, s in rows:
        total[s] += len(t.split())
    use = {s: (weights or dict.fromkeys(total, 1.0)).get(s, 0) for s, n in total.items() if n}
    use = {s: w for s, w in use.items() if w > 0}
    out = {}
    for s, w in use.items():
        budget = int(sum(total.values()) * share * w / sum(use.values()) + 1e-9)
        epochs, rest = divmod(budget, total[s])
        keyed = []
        for d, t, x in rows:
            if x == s and t.split():
                u = (int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
                keyed.append((-math.log(u) / {1: mixing.GOOD, 0: mixing.BAD}.get(quality.get(d), mixing.UNKNOWN), d, len(t.split())))
        upto = 0
        for _, d, n in sorted(keyed):
            upto += n
            if epochs + (upto <= rest):
                out[d] = epochs + (upto <= rest)
    return out


@pytest.mark.parametrize(("weights", "share"), [(None, 1.0), ({"a": 3.0, "b": 1.0, "z": 5.0, "c": 0.0}, 0.5), ({"b": 1.0}, 4.0)])
def test_mix(spark, weights, share):
    rows = [(k, t, "aabc"[k % 4]) for k, t in corpus(9, 120).items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    quality = {k: k % 2 for k, _, _ in rows if k % 3}
    labels = ugly.labels(spark, [(k, q, 0) for k, q in quality.items()])
    targets = spark.createDataFrame(list(weights.items()), "source string, weight double") if weights else None
    # the reference mix shares among sources that are there
    want = brute_mix(rows, quality, weights, share)
    got = {r.doc_id: r.copies for r in mixing.sample(df, labels, targets, share).collect()}
    assert got == want
    assert {r.doc_id: r.copies for r in mixing.mixed(df, labels, targets, share).collect()} == want


def test_good_documents_are_taken_more_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = Counter(r.doc_id % 2 for r in mixing.sample(df, labels, share=0.4).collect())
    assert got[0] + got[1] == 1600 and got[1] > 2 * got[0]


def test_mix_of_ugly_tables(spark):
    df, labels = ugly.documents(spark), ugly.labels(spark, [(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1)])
    got = mixing.mixed(df, labels)
    assert got.columns == [c for c in df.columns if c not in ("tokens", "copies")] + ["tokens", "copies"]
    assert got.count() and not {4, 5, 6} & {r.doc_id for r in got.collect()} and None in {r.source for r in got.collect()}
    assert mixing.sample(df, ugly.labels(spark)).count()
    assert mixing.sample(ugly.empty(spark), labels).count() == 0


# embeddings


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[300:450] = x[:150] + rng.normal(0, 0.05, (150, 16))
    x[450:500] = x[0] * 2
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(u @ u.T >= 0.95)) if a < b]
    rep = {r.vec_id: r.representative for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert len(rep) == 600 and sum(rep[a] == rep[b] for a, b in pairs) >= 0.95 * len(pairs)
    want = {k: k for k in range(600)} | brute_components(pairs)
    assert sum(rep[k] == want[k] for k in want) >= 590
    assert all((rep[k] == rep[j]) <= (want[k] == want[j]) for k, j in rng.integers(0, 600, (2000, 2)).tolist())


def test_vectors_in_rounds(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"id": np.arange(50), "v": pa.array(np.random.default_rng(5).normal(size=(50, 4)).astype(np.float32).tolist(), pa.list_(pa.float32()))})
    held = type("Held", (), {"value": np.random.default_rng(6).normal(size=(7, 4)).astype(np.float32)})
    cells = lambda rounds, at: [(c, i) for b in embedding_dedup._cells(held, 3, rounds, at)([batch]) for c, i in zip(b.column("cell").to_pylist(), b.column("id").to_pylist())]
    parts = [cells(3, at) for at in range(3)]
    assert len(cells(1, 0)) == 150 and sorted(sum(parts, [])) == sorted(cells(1, 0)) and all(c % 3 == at for at in range(3) for c, _ in parts[at])
    freed = []
    monkeypatch.setattr(embedding_dedup, "ROUND_BYTES", 0)
    monkeypatch.setattr(embedding_dedup, "tidy", freed.append)
    test_near_vectors(spark)
    assert len(freed) == 4


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [5.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (8, [None, 1.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (9, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("id", "v", "cell", "node", "root")})
    got = {r.vec_id: (r.representative, r.keep) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert got == {k: (k, True) for k in (1, 3, 4, 5, 6, 7, 8)} | {2: (1, False), 9: (1, False)}
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicate_vectors(df.filter("vec_id = 3")).count() == 1


def test_vectors_of_two_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8 if k < 60 else 5).tolist()) for k in range(100)]
    rows += [(200 + k, (np.array(rows[k][1]) * 3 + 0.01 * (k % 2)).tolist()) for k in range(50, 70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rep = {r.vec_id: r.representative for r in embedding_dedup.near_duplicate_vectors(df, threshold=0.99).collect()}
    want = {k: k for k in range(100)} | {200 + k: k for k in range(50, 70)}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    assert all(unit[a] @ unit[b] < 0.99 for n in (range(60), range(60, 100)) for a in n for b in n if a < b) and rep == want


# packages


def _zip(members, deflate=(), comment=b"", before=b"", force64=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = comment
        for name, data in members.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=force64) as f:
                f.write(data)
        for name, data in dict(deflate).items():
            z.writestr(name, data, zipfile.ZIP_DEFLATED)
    return before + out.getvalue()


def _zip64(data: bytes) -> bytes:
    """The same file with its directory's place in ZIP64 records only."""
    import struct

    at = data.rindex(b"PK\x05\x06")
    n, size, start = struct.unpack_from("<H", data, at + 10)[0], *struct.unpack_from("<LL", data, at + 12)
    big = b"PK\x06\x06" + struct.pack("<QHHLLQQQQ", 44, 45, 45, 0, 0, n, n, size, start)
    locator = b"PK\x06\x07" + struct.pack("<LQL", 0, at, 1)
    return data[:at] + big + locator + b"PK\x05\x06" + struct.pack("<HHHHLLH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


RECORDS = [({"WARC-Type": "resource", "WARC-Target-URI": f"http://x/{k}"}, b"body %d" % k * k) for k in range(6)]


@pytest.mark.parametrize("kind", ["plain", "zip64", "prefixed", "prefixed64", "commented", "deflated index", "no index", "bare warc", "entries64"])
def test_reading_packages(spark, tmp_path, kind):
    z = zipfile.ZipFile(io.BytesIO(warc.package(RECORDS)))
    body, index = z.read("archive/data.warc.gz"), z.read("indexes/index.cdxj")
    names = {"archive/data.warc.gz": body, "indexes/index.cdxj": index}
    if kind == "bare warc":
        raw = b"".join(b"WARC/1.1\r\nWARC-Target-URI: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (h["WARC-Target-URI"].encode(), len(b), b) for h, b in RECORDS)
        data = _zip({"archive/data.warc": raw})
    else:
        data = {
            "plain": lambda: _zip(names), "zip64": lambda: _zip64(_zip(names)), "prefixed": lambda: _zip(names, before=b"MZ junk" * 9), "prefixed64": lambda: b"junk" + _zip64(_zip(names)),
            "commented": lambda: _zip(names, comment=b"a PK\x05\x06 comment" * 3), "deflated index": lambda: _zip({"archive/data.warc.gz": body}, {"indexes/index.cdxj": index}),
            "no index": lambda: _zip({"archive/data.warc.gz": body, "other.txt": b"x"}), "entries64": lambda: _zip(names, force64=True),
        }[kind]()
    path = tmp_path / "p.wacz"
    path.write_bytes(data)
    got = warc.read_packages(spark.createDataFrame([(str(path),), (str(path),), (None,)], "path string")).collect()
    assert sorted((r.url, bytes(r.block)) for r in got) == sorted((h["WARC-Target-URI"], b) for h, b in RECORDS) and not any(r.error for r in got)


def test_damaged_packages(spark, tmp_path):
    z = zipfile.ZipFile(io.BytesIO(warc.package(RECORDS)))
    body, index = z.read("archive/data.warc.gz"), z.read("indexes/index.cdxj").decode().splitlines()
    first = next(json.loads(x[x.index("{") :]) for x in index if json.loads(x[x.index("{") :])["offset"] == "0")
    bad = b"\0" * int(first["length"]) + body[int(first["length"]) :]
    lines = [*index, "nonsense", 'x {"filename": "data.warc.gz", "offset": "99999999", "length": "5"}']
    (tmp_path / "a.wacz").write_bytes(_zip({"archive/data.warc.gz": bad, "indexes/index.cdxj": "\n".join(lines).encode()}))
    got = warc.read_packages(spark.createDataFrame([(str(tmp_path / "a.wacz"),)], "path string")).collect()
    assert len(got) == 6 and sum(r.error is not None for r in got) == 1
    for junk in (b"", b"not a zip", b"PK\x05\x06"):
        with pytest.raises(ValueError):
            warc.directory(io.BytesIO(junk))
    with pytest.raises(ValueError):
        warc.locate(io.BytesIO(_zip({}, {"archive/data.warc.gz": body})))
    assert warc.locate(io.BytesIO(_zip({}))) == []


def _index(z):
    """(archive, index lines by offset) of a package."""
    lines = z.read("indexes/index.cdxj").decode().splitlines()
    return z.read("archive/data.warc.gz"), sorted(lines, key=lambda x: int(json.loads(x[x.index("{") :])["offset"]))


@pytest.mark.parametrize("kind", ["first", "last", "middle", "outside", "null name", "bad number", "no fields", "list", "none"])
def test_what_an_index_leaves_out_is_scanned(spark, tmp_path, kind):
    body, lines = _index(zipfile.ZipFile(io.BytesIO(warc.package(RECORDS))))
    keep = {
        "first": lines[:1], "last": lines[-1:], "middle": lines[2:4], "outside": ['x 1 {"filename": "data.warc.gz", "offset": "99999999", "length": "5"}'], "null name": ['x 1 {"filename": null, "offset": "0", "length": "5"}', *lines[1:]],
        "bad number": ['x 1 {"filename": "data.warc.gz", "offset": "zero", "length": "5"}'], "no fields": ["x 1 {}", "x 1 {", lines[3]], "list": ["x 1 [1]"], "none": [""],
    }[kind]
    path = tmp_path / "p.wacz"
    path.write_bytes(_zip({"archive/data.warc.gz": body, "indexes/index.cdxj": "\n".join(keep).encode()}))
    got = warc.read_packages(spark.createDataFrame([(str(path),)], "path string")).collect()
    assert sorted((r.url, bytes(r.block)) for r in got) == sorted((h["WARC-Target-URI"], b) for h, b in RECORDS) and not any(r.error for r in got)


def test_bad_packages_and_records_are_rows(spark, tmp_path):
    raw = lambda h, b: b"WARC/1.1\r\nWARC-Target-URI: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (h["WARC-Target-URI"].encode(), len(b), b)
    every = b"".join(raw(*r) for r in RECORDS)
    body, lines = _index(zipfile.ZipFile(io.BytesIO(warc.package(RECORDS))))
    second = int(json.loads(lines[1][lines[1].index("{") :])["offset"])
    files = {
        "good": _zip({"archive/a.warc": every}), "junk": b"not a zip", "empty": b"", "packed": _zip({}, {"archive/a.warc": every}), "one stream": _zip({"archive/a.warc.gz": gzip.compress(every)}),
        "cut off": _zip({"archive/a.warc": every[:-20]}), "cut gzip": _zip({"archive/a.warc.gz": body[:-9]}), "torn": _zip({"archive/a.warc.gz": body[:second] + b"\0" * 30, "indexes/i.cdxj": lines[0].replace("data.", "a.").encode()}), "text": _zip({"archive/a.warc": b"hello\r\n\r\nthere"}),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.read_packages(spark.createDataFrame([(str(tmp_path / n),) for n in [*files, "missing"]], "path string")).collect()
    got = Counter((r.path.rsplit("/", 1)[1], r.error is None, r.offset is None) for r in rows)
    assert got == {
        ("good", True, False): 6, ("junk", False, True): 1, ("empty", False, True): 1, ("packed", False, True): 1, ("missing", False, True): 1, ("one stream", True, False): 6, ("cut off", True, False): 5, ("cut off", False, False): 1,
        ("cut gzip", True, False): 5, ("cut gzip", False, False): 1, ("torn", True, False): 1, ("torn", False, False): 1, ("text", False, False): 1,
    }
    assert sorted(bytes(r.block) for r in rows if r.path.endswith("one stream")) == sorted(b for _, b in RECORDS)


def test_headers_of_pages(spark, tmp_path):
    """Others read the records by the standard headers."""
    df = spark.createDataFrame([(7, "https://example.org/a?b=%20c", "<p>"), (8, None, None)], "page_id long, url string, html string")
    got = {r.headers["warc-record-id"].split(":")[2]: r for r in warc.read_packages(warc.write_packages(df, str(tmp_path / "w"))).collect()}
    assert got["7"].url == "https://example.org/a?b=%20c" and got["7"].type == "resource" and "x-target" not in got["7"].headers and got["8"].url is None


def test_pages_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b\nc", "<p>é</p>"), (1, "http://a/ b\nc", "<p>é</p>"), (2, None, None), (None, "", ""), (3, "x: y\r\n", "z" * 3_000_000), (4, "http://ü/{}", "\r\n\r\nWARC/1.0\0"), (-5, " x ", "1"), (6, "a\u2028b", "2"), (7, "%0A%", "3")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("extra"))
    packages = warc.write_packages(df, str(tmp_path / "w"))
    got = warc.pages_of(warc.read_packages(packages))
    assert ugly.rows(got) == sorted(rows, key=repr)
    assert warc.pages_of(warc.read_packages(warc.write_packages(df.limit(0), str(tmp_path / "e")))).count() == 0


# pipeline


def test_stages_on_ugly_tables(spark):
    df = ugly.documents(spark).drop("tokens", "copies")
    for docs in (df, ugly.empty(spark)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, ugly.SF)
            if k < 4:
                assert got.columns == docs.columns
            got.count()


def test_what_stages_keep_of_ugly_tables(spark):
    """Extra columns of any name come through, and each row has its defined fate."""
    odd = {c: F.lit(f"extra {c}") for c in ("row", "order", "range", "last", "s", "label_id", "tie", "place", "__key", "__tokens", "__rank")}
    df = ugly.documents(spark).drop("tokens", "copies").withColumns(odd)
    tox, near, leak, secret, mix = (stage for _, stage in corpus_pipeline.STAGES)
    rows = ugly.rows(df)
    kept = ugly.rows(tox(spark, df, ugly.SF))
    toxic = {r.doc_id for r in toxicity.toxicity(df, table(spark, ugly.SF, "labels")).filter("toxic AND doc_id IS NOT NULL").collect()}
    assert Counter(kept) == Counter(r for r in rows if r[0] not in toxic) and not toxic & {4, 5, 6, 13}
    one = near(spark, df, ugly.SF).collect()
    assert Counter(r.doc_id for r in one) == Counter([1, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15, None, None]) and all(tuple(r) in rows for r in one)
    items = benchmark(spark, [(1, " ".join(ugly.words(random.Random(5), 80)[10:40]))])  # in documents 1, 2 and 3, and where the id is null
    assert Counter(ugly.rows(decontaminate.drop_contaminated(df, items))) == Counter(r for r in rows if r[0] not in (1, 2, 3))
    assert Counter(ugly.rows(leak(spark, df, ugly.SF))) == Counter(rows) == Counter(ugly.rows(secret(spark, df, ugly.SF)))
    mixed = mix(spark, df, ugly.SF).collect()
    of = [c for c in df.columns]
    assert mixed and all(tuple(r[c] for c in of) in rows and r.tokens == len(r.text.split()) and r.copies >= 1 for r in mixed)
    equal = {(r.doc_id, r.text): r.copies for r in mixed}
    assert all(equal[r.doc_id, r.text] == r.copies for r in mixed)  # equal rows are taken together
    near_all = {(r.doc_id, r.text) for r in df.collect() if r.text and r.text.split()}
    assert set(equal) <= near_all


def test_equal_keys_are_ordered_by_id_then_text(spark, monkeypatch):
    """With one key for all, the least ids are taken; without ids, the order of the texts' hashes decides, the same each time."""
    monkeypatch.setattr(mixing.F, "log", lambda c: F.lit(-1.0))
    df = spark.createDataFrame([(k, f"two words{k % 3}", "a") for k in range(20)], "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id for r in mixing.sample(df, ugly.labels(spark), share=0.5).collect()}
    assert got == set(range(10))
    none = df.withColumn("doc_id", F.lit(None).cast("long"))
    first, again = ([r.text for r in mixing.mixed(none.repartition(n), ugly.labels(spark), share=0.5).collect()] for n in (2, 5))
    assert Counter(first) == Counter(again) and len(set(first)) < 3


def test_pipeline_by_stage(spark):
    """run() is the stages one after the other, and each stage's decision can be seen in its result."""
    docs = table(spark, ugly.SF, "documents")
    labels = {r.doc_id: r.toxic for r in table(spark, ugly.SF, "labels").collect()}
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], ugly.SF).checkpoint())
    ids = [{r.doc_id for r in k.collect()} for k in kept]
    assert ids[0] > ids[1] > ids[2] > ids[3] == ids[4] >= ids[5]
    gone = ids[0] - ids[1]
    assert sum(labels.get(d) == 0 for d in gone) <= 0.05 * sum(v == 0 for v in labels.values())
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len({text[d] for d in ids[2]}) == len(ids[2])  # no two exact copies are left
    hits = {r[0] for r in decontaminate.contaminated(docs, table(spark, ugly.SF, "benchmark")).collect()}
    assert ids[3] == ids[2] - hits
    assert secrets.secrets(kept[4]).count() == 0 and kept[4].filter(F.col("text").contains(secrets.MARK)).count() == secrets.secrets(kept[3]).select("doc_id").distinct().count()
    assert ugly.rows(corpus_pipeline.run(spark, ugly.SF)) == ugly.rows(kept[5])
