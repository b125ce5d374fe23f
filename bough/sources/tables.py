"""Snapshot relations projected from plain tables: documents as files, orders as commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bough.functions.octets import object_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, mode, kind, oid, size, data): one file for each document, at source/lang/doc_id.txt."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    data = F.encode("text", "UTF-8")
    return d.select(F.encode(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))), "UTF-8").alias("path"), F.lit(0o100644).alias("mode"), F.lit("blob").alias("kind"), object_id("blob", data).alias("oid"), F.octet_length(data).cast("long").alias("size"), data.alias("data"))


def with_directories(files: DataFrame) -> DataFrame:
    """(path, depth, kind, mode, oid, size): files and the directories above them, whose oid is null."""
    path = F.decode("path", "ISO-8859-1")
    parts = F.split(path, "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias("p")).where("p is not null").distinct()
    leaves = files.select(path.alias("p"), "kind", "mode", "oid", "size")
    both = leaves.unionByName(above.select("p", F.lit("tree").alias("kind"), F.lit(0o040000).alias("mode"), F.lit(None).cast(files.schema["oid"].dataType).alias("oid"), F.lit(None).cast("long").alias("size")))
    return both.select(F.encode("p", "ISO-8859-1").alias("path"), F.size(F.split("p", "/")).alias("depth"), "kind", "mode", "oid", "size")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(base, head) of (path, mode, oid, data): head lacks some files, has others new, changed, moved or of another type."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", "lang", "text")
    name = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))

    def of(rows: DataFrame, path, text, mode) -> DataFrame:
        data = F.encode(text, "UTF-8")
        return rows.select(F.encode(path, "UTF-8").alias("path"), mode.alias("mode"), object_id("blob", data).alias("oid"), data.alias("data"))

    base = of(d.where("doc_id % 7 <> 0"), name, F.col("text"), F.lit(0o100644))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nappended line"))).otherwise(F.col("text"))
    moved = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("moved/"), name)).otherwise(name)
    mode = F.when(F.col("doc_id") % 13 == 0, F.lit(0o120000)).otherwise(F.lit(0o100644))
    return base, of(d.where("doc_id % 5 <> 0"), moved, text, mode)


def commit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent, idx): commit k has the parents k div 2 and, if k is even and it differs, k div 3."""
    k = table(spark, sf_dir, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("child"))
    second = F.expr("case when child % 2 = 0 and child div 3 <> child div 2 then child div 3 end")
    each = k.select("child", F.posexplode(F.array(F.expr("child div 2"), second)).alias("idx", "parent"))
    return each.where("parent is not null").select("child", "parent", "idx")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(oid, t_mono, t_skew): two clocks, of which the first never runs backwards along an edge."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("oid"), F.col("o_orderkey").alias("t_mono"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("t_skew"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, kind, oid, symbolic_target): nations are branches, regions point to their first nation, HEAD to a region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none = F.lit(None)
    branches = n.select(F.concat(F.lit("refs/heads/"), "n_name").alias("name"), F.lit("direct").alias("kind"), (F.col("n_nationkey") * 37).cast("long").alias("oid"), none.cast("string").alias("symbolic_target"))
    first = n.groupBy("n_regionkey").agg(F.min("n_name").alias("first"))
    remotes = r.join(first, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("refs/remotes/"), "r_name").alias("name"), F.lit("symbolic").alias("kind"), none.cast("long").alias("oid"), F.concat(F.lit("refs/heads/"), "first").alias("symbolic_target"))
    head = r.agg(F.min("r_name").alias("m")).where("m is not null").select(F.lit("HEAD").alias("name"), F.lit("symbolic").alias("kind"), none.cast("long").alias("oid"), F.concat(F.lit("refs/remotes/"), "m").alias("symbolic_target"))
    return branches.unionByName(remotes).unionByName(head)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, version, line_no, line): file conv_id at version t has the turns up to t, a line each."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ").alias("line"))
    at = c.select("conv_id", F.col("turn").alias("version")).distinct()
    both = at.join(c, "conv_id").where("turn <= version")
    return both.select(F.col("conv_id").alias("path"), "version", (F.col("turn") + 1).alias("line_no"), "line")
