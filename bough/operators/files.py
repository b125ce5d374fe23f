"""Reading files: slices of lines and caps in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bough.functions import octets as O
from bough.model import EngineError

MAX_BYTES = 256_000


def _check(lines: tuple[int, int] | None, max_bytes: int) -> None:
    if lines is not None and (lines[0] < 1 or lines[1] < lines[0]):
        raise EngineError("invalid_argument", "lines are counted from 1, first to last")
    if max_bytes < 1:
        raise EngineError("invalid_argument", "max_bytes must be positive")


def read(files: DataFrame, lines: tuple[int, int] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Each file of (path, mode, oid, data, ...) with kind, its data cut to whole lines and to max_bytes, and what was cut.

    Columns: path, blob_oid, mode, kind, data, start_line, end_line, total_lines (null
    when the cap cut the scan), truncated, lfs_pointer. Gitlinks have no data. A range
    that starts behind the last line gives no bytes. Only a first line that alone
    exceeds the cap is cut within.
    """
    _check(lines, max_bytes)
    gitlink = F.col("mode").bitwiseAND(F.lit(O.FILE_TYPE)) == 0o160000
    data = F.when(gitlink, F.unhex(F.lit(""))).otherwise(F.col("data"))
    capped = F.octet_length(data) > max_bytes
    scanned = O.chars(F.substring(data, 1, max_bytes))
    rows = F.transform(O.lines(scanned), lambda x: F.concat(x, F.lit("\n")))
    partial = (scanned != "") & ~scanned.endswith("\n")
    first = files.select("path", F.col("oid").alias("blob_oid"), "mode", O.file_kind(data, F.col("mode")).alias("kind"), data.alias("whole"), capped.alias("capped"), scanned.alias("scanned"), rows.alias("rows"), partial.alias("partial"))
    total = F.when(~F.col("capped"), O.line_count(F.col("whole")))
    last_cut = F.col("capped") & F.col("partial")
    n = F.size("rows")
    if lines is None:
        kept = F.when(last_cut & (n > 1), n - 1).otherwise(n)
        text = F.when(last_cut & (n > 1), F.array_join(F.slice("rows", F.lit(1), kept), "")).otherwise(F.col("scanned"))
        start, end, truncated = F.lit(None).cast("int"), F.lit(None).cast("int"), F.col("capped")
    else:
        a, b = lines
        complete = n - last_cut.cast("int")
        stop = F.least(F.lit(b), F.when(last_cut & (F.lit(a) < n), complete).otherwise(n))
        some = stop >= a
        joined = F.array_join(F.slice("rows", F.lit(a), F.greatest(stop - a + 1, F.lit(0))), "")
        # a newline was put behind every line; an unterminated one has none
        text = F.when(some, F.when(F.col("partial") & (stop == n), F.substr(joined, F.lit(1), F.length(joined) - 1)).otherwise(joined)).otherwise(F.lit(""))
        start, end = F.when(some, F.lit(a)), F.when(some, stop)
        truncated = F.col("capped") & ~(F.lit(b) <= complete)
    pointer = F.when(F.col("kind") == "text", O.lfs_pointer(F.col("whole")))
    return first.select("path", "blob_oid", "mode", "kind", O.octets(text).alias("data"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), total.alias("total_lines"), truncated.alias("truncated"), pointer.alias("lfs_pointer"))


def headers(objects: DataFrame) -> DataFrame:
    """(oid, kind, size); payloads aren't read."""
    return objects.select("oid", "kind", "size")


def read_many(objects: DataFrame, wanted: DataFrame, max_total_bytes: int | None = None) -> DataFrame:
    """(oid, found, kind, size, data) for every distinct id asked for; more bytes together than allowed are an error."""
    ids = wanted.select(F.col("oid").alias("asked")).distinct()
    stored = objects.select(F.col("oid").alias("stored"), "kind", "size", "data")
    out = ids.join(stored, F.col("asked") == F.col("stored"), "left").select(F.col("asked").alias("oid"), F.col("stored").isNotNull().alias("found"), "kind", "size", "data")
    if max_total_bytes is not None and (ids.join(objects.select("oid", "size"), F.col("asked") == F.col("oid")).agg(F.sum("size")).first()[0] or 0) > max_total_bytes:
        raise EngineError("result_too_large", "the objects exceed the ceiling together")
    return out


def layered(layers: list[DataFrame], key: str = "oid") -> DataFrame:
    """The first layer's row for every key, with ``layer``, its number from 0.

    A row whose ``error`` isn't null fails the query if it is the first layer's: layers
    behind a hit aren't consulted, so their errors don't count.
    """
    if not layers:
        raise EngineError("invalid_argument", "there must be a layer")
    union: DataFrame | None = None
    for i, layer in enumerate(layers):
        if "error" not in layer.columns:
            layer = layer.withColumn("error", F.lit(None).cast("string"))
        layer = layer.withColumn("layer", F.lit(i))
        union = layer if union is None else union.unionByName(layer)
    rest = [c for c in union.columns if c not in (key, "error")]
    best = union.groupBy(key).agg(F.min_by(F.struct(*rest, "error"), "layer").alias("best"))
    message = F.concat(F.lit("backend_error: layer "), F.col("best.layer").cast("string"), F.lit(": "), F.col("best.error"))
    checked = F.when(F.col("best.error").isNotNull(), F.raise_error(message).cast(union.schema[key].dataType)).otherwise(F.col(key))
    return best.select(checked.alias(key), *(F.col("best")[c].alias(c) for c in rest))


def verified(objects: DataFrame, algorithm: str = "sha1") -> Column:
    """Whether an object's payload has its id (as bytes)."""
    return O.format_oid(F.col("oid")) == O.object_id(F.col("kind"), F.col("data"), algorithm)


def checked(objects: DataFrame, algorithm: str = "sha1") -> DataFrame:
    """objects; a payload that doesn't have its id fails the query when it is read."""
    wrong = F.raise_error(F.concat(F.lit("hash_mismatch: "), O.format_oid(F.col("oid"))))
    return objects.withColumn("data", F.when(verified(objects, algorithm), F.col("data")).otherwise(wrong.cast("binary")))
