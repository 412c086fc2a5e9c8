"""Exact n-gram Jaccard self-join by rare prefixes, verified on full n-gram sets.

Documents of which most n-grams occur once are like no other, and go first. Of the
others' n-grams, rarest first, the first few (all but `threshold` of the set, and one)
hold one of any similar document's first few: they make connected parts, within which all pairs
are counted. Each step keeps every pair from the threshold on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .common import cut, one_row_per_id, small, table, texts, tidy, without
from .components import components, forest

#: Production parameters: word 3-grams, pairs from this Jaccard on.
NGRAM, THRESHOLD = 3, 0.5
#: A part with more documents, or more n-grams of them together, is split into blocks, of which each pair is a task's work.
BLOCK_DOCS, BLOCK_GRAMS = 2048, 1 << 22
#: A round of cells is sent so many times what the sets hold once: a set is sent for each of its cells, and large parts have many.
ROUND_TIMES = 2
_TILE, _COLUMNS = 1024, 4096
_LEAST = 1e-9  # what rounding may add to a bound


def bands_for(threshold: float, recall: float, rows: int | None = None, most: int = 256) -> tuple[int, int]:
    """(bands, rows) with recall 1 - (1 - t^rows)^bands at the threshold.

    Of all row counts that need at most `most` hashes, the largest is taken:
    it makes the fewest false candidates.
    """
    best = None
    for r in [rows] if rows else range(1, 17):
        b = math.ceil(math.log(1 - recall) / math.log(1 - min(threshold**r, 1 - 1e-12)))
        if best is None or b * r <= most / 3:
            best = (b, r)
    return best


def _buckets(spark: SparkSession) -> int:
    """Into how many parts all n-grams are split: as the session's shuffles, half as many."""
    return max(16, min(1024, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2))


_POSTINGS = "bucket int, ids array<long>, counts array<int>, grams array<int>, set_a array<long>, set_b array<long>"


def _by_bucket(bucket: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by bucket, where in it each bucket's row begins, which of those begin a bucket)."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    b, r = bucket[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (r[1:] != r[:-1])]))
    first = np.flatnonzero(np.concatenate([[True], b[begin][1:] != b[begin][:-1]]))
    return order, begin, first


def _postings(n: int, buckets: int):
    """Documents' n-grams by bucket, as 32 bits of their hashes; and a row of a slice's documents with sizes and hashes of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                g, o = T.unique_by_row(*T.Words(part.column("text")).grams(n))
                if not len(g):
                    continue
                size, ids = np.diff(o), part.column("doc_id").to_numpy()
                has = size > 0
                a, b = T.reduce_rows(np.add, g, o, 0)[has], T.reduce_rows(np.add, T.mix(g ^ np.uint64(0x5BD1E995)), o, 0)[has]
                one, none = np.array([0, has.sum()]), np.zeros(2, np.int64)
                own = {"ids": T.lists(ids[has], one), "counts": T.lists(size[has].astype(np.int32), one), "grams": T.lists(np.zeros(0, np.int32), none), "set_a": T.lists(T.signed(a), one), "set_b": T.lists(T.signed(b), one)}
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(ids[has][0]) % buckets], pa.int32())} | own)
                h = T.mix(g)
                bucket, row = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), np.repeat(np.arange(len(ids)), size)
                order, begin, first = _by_bucket(bucket, row)
                some, where = order[begin], np.append(first, len(begin))
                none = T.lists(np.zeros(0, np.int64), np.zeros(len(first) + 1, np.int64))
                got = {"ids": T.lists(ids[row[some]], where), "counts": T.lists(np.diff(np.append(begin, len(order))).astype(np.int32), where)}
                got |= {"grams": T.lists(h.astype(np.uint32)[order].view(np.int32), np.append(begin[first], len(order))), "set_a": none, "set_b": none}
                yield pa.RecordBatch.from_pydict({"bucket": bucket[some[first]]} | got)

    return run


def _of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, tuple | None]]:
    """(bucket, rows of documents, (id and n-grams of each of the bucket's documents, the n-grams, their numbers)) of each bucket."""
    for tab in T.whole_groups(batches, "bucket"):
        bucket = tab.column("bucket").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for s, e in zip(edge[:-1], edge[1:]):
            part = tab.slice(s, e - s)
            is_own = pc.greater(pc.list_value_length(part.column("set_a")), 0)
            own, part = part.filter(is_own), part.filter(pc.invert(is_own))
            if not part.num_rows:
                yield int(bucket[s]), own, None
                continue
            ids, counts, grams = (pc.list_flatten(part.column(c)).to_numpy() for c in ("ids", "counts", "grams"))
            order = np.argsort(grams.view(np.uint32))
            new = np.concatenate([[True], grams[order][1:] != grams[order][:-1]])
            times = np.empty(len(grams), np.int32)
            times[order] = np.diff(np.append(np.flatnonzero(new), len(grams)))[np.cumsum(new) - 1]
            yield int(bucket[s]), own, (ids, counts, grams, times)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, set_a, set_b, size, repeated): a document's sets, or how many of a bucket's n-grams it isn't alone with."""
    for _, own, found in _of_buckets(batches):
        if own.num_rows:
            ids, size, a, b = (pc.list_flatten(own.column(c)).combine_chunks() for c in ("ids", "counts", "set_a", "set_b"))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "set_a": a, "set_b": b, "size": size, "repeated": pa.nulls(len(ids), pa.int32())})
        if found is not None:
            ids, counts, _, times = found
            n = np.add.reduceat(times > 1, np.cumsum(counts) - counts, dtype=np.int32)
            ids, n = ids[n > 0], n[n > 0]
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "set_a": pa.nulls(len(ids), pa.int64()), "set_b": pa.nulls(len(ids), pa.int64()), "size": pa.nulls(len(ids), pa.int32()), "repeated": n})


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, size, grams, times): a document's size, or its n-grams of a bucket that others have, and how many have them."""
    for bucket, own, found in _of_buckets(batches):
        if own.num_rows:
            ids, size = (pc.list_flatten(own.column(c)).combine_chunks() for c in ("ids", "counts"))
            none = T.lists(np.zeros(0, np.int64), np.zeros(len(ids) + 1, np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "size": size, "grams": none, "times": none.cast(pa.list_(pa.int32()))})
        if found is not None:
            ids, counts, grams, times = found
            keep = times > 1
            row = np.repeat(np.arange(len(ids)), counts)[keep]
            offs = np.searchsorted(row, np.arange(len(ids) + 1))
            key = (np.int64(bucket) << 32) | grams[keep].view(np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "size": pa.nulls(len(ids), pa.int32()), "grams": T.lists(key, offs), "times": T.lists(times[keep], offs)})


def _prefixes(threshold: float):
    """(bucket, ids, sizes, grams): each document's rarest n-grams, as many as hold one in common with any similar document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in T.whole_groups(batches, "doc_id"):
            ids, of = np.unique(tab.column("doc_id").to_numpy(), return_inverse=True)
            size = np.zeros(len(ids), np.int64)
            np.maximum.at(size, of, pc.fill_null(tab.column("size"), 0).to_numpy())
            row = np.repeat(of, pc.list_value_length(tab.column("grams")).to_numpy())
            gram, times = (pc.list_flatten(tab.column(c)).to_numpy() for c in ("grams", "times"))
            order = np.lexsort((gram, times, row))
            row, gram = row[order], gram[order]
            have = np.bincount(row, minlength=len(ids))
            place = np.arange(len(row)) - (np.cumsum(have) - have)[row]
            first = place < (have - np.ceil(threshold * size - _LEAST) + 1)[row]
            row, gram = row[first], gram[first]
            if not len(row):
                continue
            order, _, _ = _by_bucket(gram >> 32, row)
            row, gram = row[order], gram[order]
            bucket = (gram >> 32).astype(np.int32)
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            yield pa.RecordBatch.from_pydict({"bucket": bucket[edge[:-1]], "ids": T.lists(ids[row], edge), "sizes": T.lists(size[row].astype(np.int32), edge), "grams": T.lists(gram.astype(np.uint32).view(np.int32), edge)})

    return run


def _chains(threshold: float):
    """(u, v): those that share an n-gram of their prefixes, each with the next smaller, if sizes allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in T.whole_groups(batches, "bucket"):
            bucket = np.repeat(tab.column("bucket").to_numpy(), pc.list_value_length(tab.column("ids")).to_numpy())
            ids, size, gram = (pc.list_flatten(tab.column(c)).to_numpy() for c in ("ids", "sizes", "grams"))
            order = np.lexsort((size, gram, bucket))
            bucket, ids, size, gram = (x[order] for x in (bucket, ids, size, gram))
            both = (bucket[1:] == bucket[:-1]) & (gram[1:] == gram[:-1]) & (ids[1:] != ids[:-1]) & (size[:-1] >= threshold * size[1:] - _LEAST)
            a, b = forest(ids[1:][both], ids[:-1][both])
            if len(a):
                yield pa.RecordBatch.from_pydict({"u": a, "v": b})

    return run


def _groups(tab: pa.Table) -> Iterator[pa.Table]:
    cell = tab.column("cell").to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    for s, e in zip(edge[:-1], edge[1:]):
        if e - s > 1:
            yield tab.slice(s, e - s)


def _tiles(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row ranges to compare: a block's rows among themselves, or with those of the other block."""
    block, other = group.column("block").to_numpy(), group.column("other").to_numpy()
    n, cross = len(block), block[0] != other[0]
    half = int(np.searchsorted(block, block[0], "right")) if cross else 0
    tiles = lambda s, e: [np.arange(i, min(i + _TILE, e)) for i in range(s, e, _TILE)]
    if cross:
        yield from ((r, c) for r in tiles(0, half) for c in tiles(half, n))
    else:
        every = tiles(0, n)
        yield from ((r, c) for i, r in enumerate(every) for c in every[i:])


def _sets(n: int):
    """Rows (cell, block, other, rep, members, grams) for each cell of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                g, o = T.unique_by_row(*T.Words(part.column("text")).grams(n))
                own = part.column("own")
                take = np.repeat(np.arange(part.num_rows), own.value_lengths().to_numpy(zero_copy_only=False))
                grams = T.lists(T.signed(g), o)
                flat = own.flatten()
                # a few rows at a time: a document's set is repeated for each of its cells
                size = np.cumsum(np.diff(o)[take])
                at = 0
                while at < len(take):
                    to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 20), "right")))
                    idx, where = pa.array(take[at:to]), flat.slice(at, to - at)
                    cells = dict(zip(("cell", "block", "other"), where.flatten()))
                    yield pa.RecordBatch.from_pydict(cells | {"rep": part.column("rep").take(idx), "members": part.column("members").take(idx), "grams": grams.take(idx)})
                    at = to

    return run


def _shared_counts(grams: np.ndarray, owner: np.ndarray, r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Numbers of common grams of documents r x c, from their (gram, owner) postings sorted by gram."""
    out = np.zeros((len(r), len(c)), np.float32)
    if not len(grams):
        return out
    col = np.cumsum(np.concatenate([[0], grams[1:] != grams[:-1]]))
    place_r, place_c = np.full(n, -1), np.full(n, -1)
    place_r[r], place_c[c] = np.arange(len(r)), np.arange(len(c))
    starts = np.searchsorted(col, np.arange(0, col[-1] + _COLUMNS + 1, _COLUMNS))
    for k, (s, e) in enumerate(zip(starts[:-1], starts[1:])):
        if s == e:
            continue
        o, x = owner[s:e], col[s:e] - k * _COLUMNS
        width = int(x[-1]) + 1
        a, b = np.zeros((len(r), width), np.float32), np.zeros((len(c), width), np.float32)
        pr, pc_ = place_r[o], place_c[o]
        a[pr[pr >= 0], x[pr >= 0]] = 1
        b[pc_[pc_ >= 0], x[pc_ >= 0]] = 1
        out += a @ b.T
    return out


def _verified(threshold: float, pairs: bool):
    """Pairs from the threshold on of whole cells; or a spanning forest of them, and for each document how many others it is like, with copies (v null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in T.whole_groups(batches, "cell"):
            for group in _groups(tab):
                n = group.num_rows
                lists = group.column("grams").combine_chunks()
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                grams = lists.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(n), size)
                order = np.argsort(grams, kind="stable")
                grams, owner = grams[order], owner[order]
                same = np.concatenate([[False], grams[1:] == grams[:-1], [False]])
                twice = same[:-1] | same[1:]
                grams, owner = grams[twice], owner[twice]
                rep, members = group.column("rep").to_numpy(), group.column("members").to_numpy()
                fa, fb, links = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
                for r, c in _tiles(group):
                    shared = _shared_counts(grams, owner, r, c, n).astype(np.int64)
                    total = size[r][:, None] + size[c][None, :] - shared
                    like = (shared >= threshold * total) & (r[:, None] < c[None, :])
                    x, y = np.nonzero(like)
                    a, b = r[x], c[y]
                    if not len(a):
                        continue
                    lo, hi = np.where(rep[a] < rep[b], a, b), np.where(rep[a] < rep[b], b, a)
                    if pairs:
                        yield pa.RecordBatch.from_pydict({"doc_a": rep[lo], "doc_b": rep[hi], "shared": shared[x, y], "total": total[x, y]})
                    else:
                        links[r] += like @ members[c]
                        links[c] += like.T @ members[r]
                        fa, fb = forest(np.concatenate([fa, rep[hi]]), np.concatenate([fb, rep[lo]]))
                if len(fa):
                    some = links > 0
                    yield pa.RecordBatch.from_pydict({"u": fa, "v": fb, "links": pa.nulls(len(fa), pa.int64())})
                    yield pa.RecordBatch.from_pydict({"u": rep[some], "v": pa.nulls(int(some.sum()), pa.int64()), "links": links[some]})

    return run


_LINKS = "u long, v long, links long"
_PAIRS = "doc_a long, doc_b long, shared long, total long"


def _signed(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set_a, set_b) of the documents of which as many n-grams repeat as a pair must share, and their classes: a row for each distinct n-gram set.

    Classes: set_a, set_b, rep (least id), members, size.
    """
    postings = texts(docs).mapInArrow(_postings(n, _buckets(docs.sparkSession)), _POSTINGS)
    rows = postings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeats, "doc_id long, set_a long, set_b long, size int, repeated int")
    rows = rows.groupBy("doc_id").agg(F.max("set_a").alias("set_a"), F.max("set_b").alias("set_b"), F.max("size").alias("size"), F.sum("repeated").alias("repeated"))
    signed = cut(rows.filter(F.col("repeated") >= threshold * F.col("size") - _LEAST).drop("repeated"))
    tidy(docs.sparkSession)
    classes = signed.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("size").alias("size"))
    return signed.drop("size"), cut(classes)


def _found(docs: DataFrame, classes: DataFrame, n: int, threshold: float, pairs: bool) -> DataFrame:
    """What _verified() gives for all cells that must be verified.

    A cell is a connected part of the documents that share n-grams of their prefixes, or of a large one a pair of its blocks.
    Where sets are sent for many cells, the cells are worked on in rounds, whose shuffle files go before the next.
    """
    docs = texts(docs)
    asked = small(classes.select("rep"), 16)
    postings = docs.join(asked, docs.doc_id == asked.rep).select("doc_id", "text").mapInArrow(_postings(n, _buckets(docs.sparkSession)), _POSTINGS)
    times = postings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_times, "doc_id long, size int, grams array<long>, times array<int>")
    prefixes = times.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_prefixes(threshold), "bucket int, ids array<long>, sizes array<int>, grams array<int>")
    roots = components(prefixes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_chains(threshold), "u long, v long"))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    part = Window.partitionBy("root")
    rows = roots.join(classes.select("rep", "members", "size"), F.col("node") == F.col("rep"))
    rows = rows.withColumn("n", F.count("*").over(part)).withColumn("grams", F.sum("size").over(part))
    rows = rows.withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("grams") / BLOCK_GRAMS)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") == 1, F.col("root")).otherwise(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")))
    ask = cut(rows.groupBy("rep", "members", "size").agg(F.collect_list(F.struct(cell.alias("cell"), "block", "other")).alias("own")))
    tidy(docs.sparkSession)
    once, sent = ask.agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(1)), F.coalesce(F.sum(F.col("size").cast("long") * F.size("own")), F.lit(1))).first()
    rounds = -(-sent // (ROUND_TIMES * once))
    given = []
    for at in range(rounds):
        part = ask.withColumn("own", F.filter("own", lambda x: F.pmod(x["cell"], F.lit(rounds)) == at)).filter(F.size("own") > 0) if rounds > 1 else ask
        part = small(part, 64 + 16 * F.size("own"))
        found = docs.join(part, docs.doc_id == part.rep).select("text", "rep", "members", "own")
        sets = found.mapInArrow(_sets(n), "cell long, block int, other int, rep long, members long, grams array<long>")
        sets = sets.repartition("cell").sortWithinPartitions("cell", "block", "rep").mapInArrow(_verified(threshold, pairs), _PAIRS if pairs else _LINKS)
        given.append(cut(sets) if rounds > 1 else sets)
        if rounds > 1:
            del found, sets
            tidy(docs.sparkSession)
    return reduce(DataFrame.unionByName, given)


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard): all pairs of documents whose sets of word n-grams have a Jaccard similarity from `threshold` on.

    doc_a < doc_b, and no pair comes twice. Documents with equal sets are copies: the least
    id represents them, and each other one has a row with it, of jaccard 1. Documents with
    different sets are paired by their representatives. So n copies give n - 1 rows, and all other
    pairs follow: a copy is as similar to any document as its representative is.
    A crowd of different near copies has a row a pair; jaccard_classes() has a row a document.

    No pair is missed. There is no cap on a part: its all-pairs counts are blocked matrix products, and a
    large part's blocks are worked on by different tasks.

    Rows with a null id or text, and texts without words, have no n-grams and
    no pairs. A text of fewer than n words is one n-gram. Rows that repeat an
    id count once (the least text). Other columns are ignored.
    """
    docs = one_row_per_id(docs.select("doc_id", "text"))
    signed, classes = _signed(docs, n, threshold)
    found = _found(docs, classes, n, threshold, True)
    near = found.select("doc_a", "doc_b", (F.col("shared") / F.col("total")).alias("jaccard"))
    many = small(classes.filter("members > 1").select("set_a", "set_b", F.col("rep").alias("doc_a")), 32)
    same = signed.join(many, ["set_a", "set_b"]).filter("doc_id <> doc_a").select("doc_a", F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return same.unionByName(near)


def jaccard_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of each id: the least id that pairs of jaccard_join() connect it with, and how many documents it is similar to.

    Links count all similar documents, copies too. A document that is like no other is a class of its own, without
    links, as are null texts and texts without words. Null ids are left out; an id that repeats has one row.
    """
    docs = one_row_per_id(docs.select("doc_id", "text"))
    signed, classes = _signed(docs, n, threshold)
    found = cut(_found(docs, classes, n, threshold, False))
    links = found.filter("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "rep")
    of = classes.join(roots, "rep", "left").join(links, "rep", "left")
    of = of.select("set_a", "set_b", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"))
    linked = cut(signed.join(small(cut(of.filter("links > 0")), 40), ["set_a", "set_b"]).select("doc_id", "class_id", "links"))
    every = docs.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL")
    return every.join(small(linked, 24), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def drop_near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each connected group of similar ones: the least id.

    Documents without words, or with a null text or id, aren't similar to
    any other and stay. Of rows that repeat an id one stays.
    """
    docs = one_row_per_id(docs)
    signed, classes = _signed(docs, n, threshold)
    edges = _found(docs, classes, n, threshold, False)
    roots = components(edges.filter("v IS NOT NULL").select("u", "v"))
    kept = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").filter("members > 1 OR root IS NOT NULL")
    kept = small(cut(kept.select("set_a", "set_b", F.coalesce("root", "rep").alias("kept"))), 32)
    gone = signed.join(kept, ["set_a", "set_b"]).filter("doc_id <> kept").select("doc_id")
    return without(docs, cut(gone))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of the whole documents table."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\\x00-\\x7F])+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] ELSE [array_to_string(w, ' ')] END)) AS g FROM w WHERE len(w) > 0),
r AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n + b.n) AS n FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE k >= 0.5 * (n - k)),
c AS (SELECT doc_id, doc_id AS root FROM documents WHERE doc_id IS NOT NULL UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id WHERE c.root < e.b),
l AS (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY 1)
SELECT doc_id, min(root) AS class_id, coalesce(any_value(links), 0) AS links FROM c LEFT JOIN l USING (doc_id) GROUP BY 1
"""
