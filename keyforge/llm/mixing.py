"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key whose rate is its quality weight. Within
a source, documents are taken in the order of their keys while the prefix sum
of their tokens fits the budget. A source whose budget is a multiple of its
tokens first gives whole epochs; the sampling fills the rest.

Prefix sums are taken in two levels: sums of key ranges, then rows of the one
range in which a source's budget ends. So a hot source isn't sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small, table

#: Production parameters: weights of labelled and other documents, tokens wanted as a share of those there are, seed, key ranges of a source.
GOOD, BAD, UNKNOWN, BUDGET_SHARE, SEED, RANGES = 1.0, 0.25, 0.5, 1.0, 17, 4096


def tokens(text: Column) -> Column:
    """Number of whitespace-separated tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("\\S++")), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, labels: DataFrame, *kept: Column) -> DataFrame:
    """(doc_id, source, key, order (ties too), range, *kept) of the documents with tokens."""
    docs = docs.filter(F.col("text").rlike("\\S")).select("doc_id", "source", "text", *kept)
    docs = docs.join(labels, docs.doc_id == labels.label_id, "left")
    weight = F.when(F.col("label_quality") == 1, GOOD).when(F.col("label_quality") == 0, BAD).otherwise(UNKNOWN)
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5("text")), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), name)), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    return docs.withColumn("key", -F.log(u) / weight).drop("label_id", "label_quality").withColumns({
        "order": F.struct("key", F.col("doc_id"), F.xxhash64("text")),
        "range": F.floor(F.col("key") / (1 + F.col("key")) * RANGES),
    })


def _labels(labels: DataFrame) -> DataFrame:
    got = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("label_quality"))
    return small(cut(got), 24)


def _cutoffs(narrow: DataFrame, targets: DataFrame | None, share: float) -> DataFrame:
    """By source: whole epochs, the range in which the rest ends, and the last order taken in it."""
    sums = cut(narrow.groupBy("source", "range").agg(F.sum("tokens").alias("n")))
    totals = sums.groupBy("source").agg(F.sum("n").alias("total"))
    if targets is None:
        plan = totals.withColumn("weight", F.lit(1.0))
    else:
        want = targets.groupBy(F.col("source").alias("s")).agg(F.max("weight").alias("weight")).filter("weight > 0")
        plan = totals.join(want, totals.source.eqNullSafe(want.s)).drop("s")
    every = plan.agg(F.sum("weight").alias("weights")).crossJoin(totals.agg(F.sum("total").alias("corpus")))
    budget = F.floor(F.col("corpus") * F.lit(share) * F.col("weight") / F.col("weights"))
    plan = plan.crossJoin(every).withColumn("budget", budget)
    plan = plan.select(F.col("source").alias("s"), F.expr("budget div total").alias("epochs"), F.expr("budget % total").alias("rest"))
    run = Window.partitionBy("source").orderBy("range")
    sums = sums.withColumn("upto", F.sum("n").over(run)).join(plan, F.col("source").eqNullSafe(F.col("s")))
    ends = cut(sums.filter("upto > rest AND upto - n <= rest").select("s", "epochs", "rest", F.col("range").alias("end"), (F.col("upto") - F.col("n")).alias("base")))
    last = narrow.join(small(ends, 64), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("end")))
    last = last.withColumn("upto", F.col("base") + F.sum("tokens").over(Window.partitionBy("s", "end").orderBy("order")))
    last = last.filter("upto <= rest").groupBy(F.col("s").alias("s2")).agg(F.max("order").alias("last"))
    got = ends.join(last, F.col("s").eqNullSafe(F.col("s2")), "left")
    return small(cut(got.select("s", "epochs", "end", "last")), 96)


def _taken(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    part = (F.col("range") < F.col("end")) | ((F.col("range") == F.col("end")) & F.coalesce(F.col("order") <= F.col("last"), F.lit(False)))
    return rows.join(cutoffs, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", F.col("epochs") + part.cast("long")).filter("copies > 0")


def _narrow(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = _keyed(docs, labels)
    return cut(rows.select("doc_id", "source", "key", "order", "range", tokens(F.col("text")).alias("tokens")))


def sample(docs: DataFrame, labels: DataFrame, targets: DataFrame | None = None, share: float = BUDGET_SHARE) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents taken, with how often.

    A source's budget is its weight's share of `share` times all tokens;
    `targets` has (source, weight), and without it all sources weigh the same.
    A source that targets leaves out, or whose weight isn't positive, gives nothing.
    copies is the number of whole epochs, plus one for a document that is
    among the sampled rest: the longest prefix by key that fits.

    A null source is a source of its own. A null text has no tokens, and
    documents without tokens aren't taken. Equal keys are ordered by id, then text;
    rows that repeat both are taken together or not at all. Unlabelled
    documents, null ids and null labels weigh UNKNOWN; of labels that repeat an id
    the least counts.
    """
    narrow = _narrow(docs, _labels(labels))
    return _taken(narrow, _cutoffs(narrow, targets, share)).select("doc_id", "source", "tokens", "copies")


def mixed(docs: DataFrame, labels: DataFrame, targets: DataFrame | None = None, share: float = BUDGET_SHARE) -> DataFrame:
    """The taken rows of docs, with tokens and copies; otherwise as sample().

    Columns of docs named tokens or copies are replaced.
    """
    labels = _labels(labels)
    cutoffs = _cutoffs(_narrow(docs, labels), targets, share)
    keep = [c for c in docs.columns if c not in ("tokens", "copies")]
    # rows travel as one struct, so that no name of theirs is in the way; only tokens of what is taken are counted again
    got = _taken(_keyed(docs, labels, F.struct(*keep).alias("row")), cutoffs)
    return got.select("row.*", tokens(F.col("text")).alias("tokens"), "copies")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole documents table, all sources weighing the same."""
    return sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = f"""
WITH l AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.doc_id, source, len(regexp_extract_all(text, '\\S+')) AS tokens,
        -ln((('0x' || substr(md5('{SEED}:' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / {16**13}::DOUBLE)
        / CASE quality WHEN 1 THEN {GOOD} WHEN 0 THEN {BAD} ELSE {UNKNOWN} END::DOUBLE AS key
      FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id),
s AS (SELECT source, sum(tokens)::BIGINT AS total FROM k WHERE tokens > 0 GROUP BY source),
b AS (SELECT source, total, floor((SELECT sum(total) FROM s) * {BUDGET_SHARE}::DOUBLE / (SELECT count(*) FROM s))::BIGINT AS budget FROM s),
r AS (SELECT doc_id, k.source, tokens, budget // total AS epochs, budget % total AS rest,
        sum(tokens) OVER (PARTITION BY k.source ORDER BY key, doc_id) AS upto
      FROM k JOIN b ON b.source IS NOT DISTINCT FROM k.source WHERE tokens > 0)
SELECT doc_id, source, tokens::BIGINT AS tokens, (epochs + (upto <= rest)::BIGINT)::BIGINT AS copies FROM r WHERE epochs > 0 OR upto <= rest
"""
