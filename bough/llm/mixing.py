"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (ordered by a keyed MD5 digest); a document's
virtual finish time is its source's tokens up to and with it, divided by the
source's target weight. All documents are range-sorted by finish time and the
queue is cut where the total budget of tokens is reached, so that sources are
drawn in proportion to their weights for as long as they last.

No source is summed in one task: the running sums of a source are taken within
4096 buckets of the digest and offset by the buckets before, and the running
total over all sources within the range partitions of the sort.

Edge cases: a token is a maximal run of characters other than space, tab, newline
and carriage return; a null text has none, and such rows finish when the row before
them does. A null source is a source of its own. Rows alike in doc_id, text and
source have one digest: they finish together and are admitted or cut together.
Other ties in finish time go by source (null first), then digest. A source without
a weight has ``default`` for its weight; with a weight of 0 or less it is left out.
Further columns pass through, whatever their names. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bough.llm.shared import spill

TOKEN = r"[^ \t\n\r]+"
_FIRST = Window.unboundedPreceding


def _digest(seed: str) -> Column:
    """Of what settles a row: null and empty differ, and so do fields that run together differently."""
    source, text = F.col("row.source"), F.col("row.text")
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.concat(F.length(source).cast("string"), F.lit(":"), source), F.lit("-")), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("t"), text), F.lit("-"))))


def _rows(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).withColumn("digest", _digest(seed))


def queue(docs: DataFrame, weights: dict[str | None, float] | None = None, default: float = 1.0, fraction: float = 0.5, budget: int | None = None, seed: str = "mix") -> DataFrame:
    """(doc_id, source, tokens, digest, finish_time, cum_tokens) of the admitted rows.

    The budget is ``budget`` tokens, or else ``fraction`` of all tokens of docs,
    rounded down. cum_tokens counts over all sources in order of finish time.
    """
    spark = docs.sparkSession
    weight = F.lit(float(default))
    for source, x in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(x))).otherwise(weight)
    light = spill(
        _rows(docs, seed).select(
            F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.coalesce(F.regexp_count("row.text", F.lit(TOKEN)).cast("long"), F.lit(0).cast("long")).alias("tokens"), "digest", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int").alias("bucket")
        )
    )
    if budget is None:
        budget = int((light.agg(F.sum("tokens")).first()[0] or 0) * fraction)
    sums = light.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = sums.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(_FIRST, 0)) - F.col("n")).alias("before"))
    own = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("digest").rangeBetween(_FIRST, 0))
    joined = light.withColumn("own", own).alias("l").join(before.alias("b"), F.col("l.source").eqNullSafe(F.col("b.source")) & (F.col("l.bucket") == F.col("b.bucket")))
    timed = joined.select("l.doc_id", "l.source", "l.tokens", "l.digest", (F.col("own") + F.col("before")).alias("upto")).withColumn("weight", weight).where("weight > 0")
    order = ["finish_time", "source", "digest"]
    ranged = spill(timed.withColumn("finish_time", F.col("upto").cast("double") / F.col("weight")).drop("upto", "weight").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(_FIRST, 0)) - F.col("n")).alias("before"))
    total = F.sum("tokens").over(Window.partitionBy("part").orderBy(*order).rangeBetween(_FIRST, 0)) + F.col("before")
    return ranged.join(parts, "part").withColumn("cum_tokens", total).where(F.col("cum_tokens") <= F.lit(budget)).select("doc_id", "source", "tokens", "digest", "finish_time", "cum_tokens")


def mix(docs: DataFrame, seed: str = "mix", **parameters: object) -> DataFrame:
    """The admitted rows of docs, whole, range-sorted by finish time, which is added as finish_time (in place of a column of that name)."""
    times = queue(docs, seed=seed, **parameters).groupBy("digest").agg(F.min("finish_time").alias("at"))
    out = _rows(docs, seed).join(times, "digest").orderBy("at", F.col("row.source"), "digest")
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "finish_time"), F.col("at").alias("finish_time"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) AS tokens,
         md5('mix|' || coalesce(length(source) || ':' || source, '-') || '|' || coalesce(doc_id::VARCHAR, '-') || '|' || coalesce('t' || text, '-')) AS digest
  FROM documents),
t AS (
  SELECT *, (sum(tokens) OVER (PARTITION BY source ORDER BY digest))::DOUBLE AS finish_time FROM d),
c AS (
  SELECT *, sum(tokens) OVER (ORDER BY finish_time, source NULLS FIRST, digest) AS cum_tokens FROM t)
SELECT doc_id, source, tokens::BIGINT AS tokens, digest, finish_time, cum_tokens::BIGINT AS cum_tokens
FROM c WHERE cum_tokens <= (SELECT sum(tokens) // 2 FROM d)
"""
