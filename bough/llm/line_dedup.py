"""Line dedup that can be undone.

Of all lines of the corpus that are alike, trimmed of blanks at both ends, the first
stays, in order of (doc_id, text's hash, number of the line); the others are taken out.
Lines of fewer than ``least`` characters are left alone: in ``report`` those under ``LEAST``, as in its SQL; in
``dedup``, the pipeline's stage, none but blank ones, so that copies made up of short
lines go as well.

``LineStore`` keeps the state in tables: the references themselves (a line's 128-bit
hash, doc_id, version, line), a table for each insertion; and sharded by the hash exact
reference counts (key, refs, owner) and for each shard a cuckoo filter of the keys
whose count isn't 0. Inserting documents asks the filters first: keys that they don't
hold are new and skip the join with the exact table. Deleting documents takes their
references away; keys that lose the last one are deleted from the filter, and keys
that lose their owner get the next reference for one. A change rewrites only the
shards that it touches. So insertions and deletions of documents, in whatever order,
end in the state that the documents present would give at once. The number of shards
follows from the number of references of the first insertion (``PER_SHARD`` each).

``report`` takes the corpus in by two insertions, deletes a sixteenth of the
documents and inserts them again, so all parts of the store are in its result.

Edge cases: rows without doc_id are neither counted nor changed. A null text stays
null; an empty one empty. Rows that repeat a doc_id with the same text count as one;
with different texts they are versions of one document (deleted together), whose lines
are told apart by the text's hash. A document that had lines and has lost all its
non-blank ones is dropped by ``dedup``. Other columns pass through, whatever their
names. Inserting a doc_id that the store holds is an error (delete it first). No rows
give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bough.llm.cuckoo import CuckooFilter
from bough.llm.shared import shared_dir

LEAST = 10
#: Keys of a shard, about, and the fewest shards.
PER_SHARD, SHARDS = 1 << 19, 16
_KEY = ["shard", "hi", "lo"]
_REFERENCES = "hi long, lo long, doc_id long, version long, line int"
_COUNTS = "hi long, lo long, refs long, owner_doc long, owner_version long, owner_line int, shard int"


def _trimmed(line: Column) -> Column:
    return F.trim(line)


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(hi, lo, doc_id, version, line): every line long enough of the documents that have an id."""
    lines = docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("version"), F.posexplode(F.split(docs["text"], "\n")).alias("line", "said"))
    long = lines.select("doc_id", "version", "line", _trimmed(F.col("said")).alias("said")).where((F.length("said") >= least) & ((F.length("said") >= LEAST) | F.col("said").rlike(r"\S")))  # short lines of other blanks aren't lines to compare
    return long.select(F.xxhash64("said").alias("hi"), F.xxhash64(F.lit(7), F.col("said")).alias("lo"), "doc_id", "version", "line").distinct()


_FILTER = "shard int, buckets long, slots binary"


def _blob(shard: int, filter_: CuckooFilter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(filter_.table)], pa.int64()), pa.array([filter_.table.tobytes()], pa.binary())], ["shard", "buckets", "slots"])


def _opened(filters: pa.Table) -> CuckooFilter | None:
    if not filters.num_rows:
        return None
    return CuckooFilter(filters["buckets"][0].as_py(), np.frombuffer(filters["slots"][0].as_py(), np.uint16).copy())


def _numpy(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return t["hi"].to_numpy().astype(np.int64), t["lo"].to_numpy().astype(np.int64)


class LineStore:
    """State of the corpus's lines under ``path``; tables that a change replaces are deleted by ``vacuum``."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None, least: int = LEAST):
        self.spark, self.shards, self.least = spark, shards, least
        self.path = path or f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        self.generation = 0
        self._inserted: list[int] = []
        self._deleted: list[int] = []
        self._at: dict[int, int] = {}  # of each shard the generation of its counts and filter

    def _read(self, name: str, generation: int, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/{generation}/{name}")

    def _write(self, name: str, df: DataFrame, by_shard: bool = False) -> DataFrame:
        """df as a table of the generation in the making, read again."""
        path = f"{self.path}/{self.generation + 1}/{name}"
        if by_shard:
            df.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
            return self.spark.read.schema(_COUNTS).parquet(path)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _sharded(self, references: DataFrame) -> DataFrame:
        return references.select(F.pmod("hi", F.lit(self.shards)).cast("int").alias("shard"), "*")

    def references(self) -> DataFrame:
        """(hi, lo, doc_id, version, line) of the documents held."""
        out = self.spark.createDataFrame([], _REFERENCES)
        for k, g in enumerate(self._inserted):
            part = self._read("references", g, _REFERENCES)
            for later in (x for x in self._deleted if x > g):
                part = part.join(self._read("gone", later, "doc_id long"), "doc_id", "left_anti").select(*part.columns)
            out = out.unionByName(part) if k else part
        return out

    def _of(self, name: str, schema: str, shards: list[int] | None) -> DataFrame:
        by: dict[int, list[int]] = {}
        for shard, g in self._at.items():
            if shards is None or shard in shards:
                by.setdefault(g, []).append(shard)
        out = None
        for g, mine in by.items():
            part = self._read(name, g, schema).where(F.col("shard").isin(mine))
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def counts(self, shards: list[int] | None = None) -> DataFrame:
        """(shard, hi, lo, refs, owner_doc, owner_version, owner_line), exact; of these shards alone if given."""
        return self._of("counts", _COUNTS, shards).select(*_KEY, "refs", "owner_doc", "owner_version", "owner_line")

    def _build(self, counts: DataFrame) -> DataFrame:
        def build(key: tuple, rows: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_blob(key[0].as_py(), CuckooFilter.build(*_numpy(rows)))])

        return counts.select(*_KEY).groupBy("shard").applyInArrow(build, _FILTER)

    def _change(self, touched: list[int], counts: DataFrame, insert: DataFrame, delete: DataFrame) -> None:
        """Write the filters of the shards touched, and take these for the shards' present state; what a filter has no room for is built anew from the counts."""

        def update(key: tuple, change: pa.Table, filters: pa.Table) -> pa.Table:
            shard, into = key[0].as_py(), change["into"].to_numpy(zero_copy_only=False)
            filter_ = _opened(filters) or CuckooFilter.sized(len(into))
            hi, lo = _numpy(change)
            filter_.delete(hi[~into], lo[~into])
            full = not filter_.insert(hi[into], lo[into])
            return pa.Table.from_batches([_blob(shard, CuckooFilter(1 << 4) if full else filter_)]).append_column("full", pa.array([full]))

        change = insert.select(*_KEY, F.lit(True).alias("into")).unionByName(delete.select(*_KEY, F.lit(False).alias("into")))
        old = self._of("filters", _FILTER, touched)
        changed = self._write("changed", change.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(update, _FILTER + ", full boolean"))
        done = {r[0]: r[1] for r in changed.select("shard", "full").collect()}  # shards at most
        fine = changed.where("not full").select("shard", "buckets", "slots")
        same = [x for x in touched if x not in done]
        if same:
            fine = fine.unionByName(old.where(F.col("shard").isin(same)))
        full = [x for x, is_full in done.items() if is_full]
        if full:
            fine = fine.unionByName(self._build(counts.where(F.col("shard").isin(full))))
        self._write("filters", fine)
        self.generation += 1
        self._at.update(dict.fromkeys(touched, self.generation))

    def insert(self, docs: DataFrame) -> None:
        """Take in documents whose ids the store doesn't hold."""
        new = self._write("references", occurrences(docs, self.least))
        if self._inserted and not new.select("doc_id").distinct().join(self.references().select("doc_id"), "doc_id", "left_semi").isEmpty():
            raise ValueError("the store holds such a document")
        first = not self._at
        if self.shards is None:
            self.shards = max(SHARDS, 1 << (new.count() // PER_SHARD).bit_length())
        gained = self._sharded(new).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("refs"), F.min(F.struct("doc_id", "version", "line")).alias("owner"))
        gained = gained.select(*_KEY, "refs", F.col("owner.doc_id").alias("owner_doc"), F.col("owner.version").alias("owner_version"), F.col("owner.line").alias("owner_line"))
        self._inserted.append(self.generation + 1)
        if first:
            counts = self._write("counts", gained, by_shard=True)
            self._write("filters", self._build(counts))
            self.generation += 1
            self._at = dict.fromkeys(range(self.shards), self.generation)
            return

        def probe(key: tuple, rows: pa.Table, filters: pa.Table) -> pa.Table:
            filter_ = _opened(filters)
            maybe = filter_.contains(*_numpy(rows)) if filter_ and rows.num_rows else np.zeros(rows.num_rows, bool)
            return rows.append_column("maybe", pa.array(maybe))

        gained = self._write("gained", gained)
        touched = sorted(r[0] for r in gained.select("shard").distinct().collect())
        probed = self._write("probed", gained.groupBy("shard").cogroup(self._of("filters", _FILTER, touched).groupBy("shard")).applyInArrow(probe, "shard int, hi long, lo long, refs long, owner_doc long, owner_version long, owner_line int, maybe boolean"))
        hit, fresh = probed.where("maybe").drop("maybe"), probed.where("not maybe").drop("maybe")
        counts = self.counts(touched)
        owner = lambda t: F.when(F.col(f"{t}.refs").isNotNull(), F.struct(*(F.col(f"{t}.owner_{x}").alias(x) for x in ("doc", "version", "line"))))
        both = counts.alias("c").join(hit.alias("h"), _KEY, "full")
        merged = both.select(*_KEY, (F.coalesce("c.refs", F.lit(0)) + F.coalesce("h.refs", F.lit(0))).alias("refs"), F.least(owner("c"), owner("h")).alias("o"))
        merged = merged.select(*_KEY, "refs", *(F.col(f"o.{x}").alias(f"owner_{x}") for x in ("doc", "version", "line")))
        now = self._write("counts", merged.unionByName(fresh), by_shard=True)
        wrong = hit.join(counts, _KEY, "left_anti")
        self._change(touched, now, fresh.select(*_KEY).unionByName(wrong.select(*_KEY)), fresh.select(*_KEY).limit(0))

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents whose doc_id is in ids; ids not held are passed over."""
        if not self._at:
            return
        gone = self._write("gone", ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct())
        lost = self._write("lost", self._sharded(self.references().join(gone, "doc_id", "left_semi")).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("lost")))
        touched = sorted(r[0] for r in lost.select("shard").distinct().collect())
        self._deleted.append(self.generation + 1)
        held = self.counts(touched).join(lost, _KEY, "left").withColumn("refs", F.col("refs") - F.coalesce("lost", F.lit(0))).drop("lost")
        left = held.where("refs > 0").join(gone.select(F.col("doc_id").alias("owner_doc"), F.lit(True).alias("orphan")), "owner_doc", "left")
        left = self._write("left", left)
        orphans = left.where("orphan").select(*_KEY)
        heirs = self._sharded(self.references()).join(orphans, _KEY, "left_semi").groupBy(*_KEY).agg(F.min(F.struct("doc_id", "version", "line")).alias("o"))
        renewed = left.where("orphan").select(*_KEY, "refs").join(heirs, _KEY).select(*_KEY, "refs", F.col("o.doc_id").alias("owner_doc"), F.col("o.version").alias("owner_version"), F.col("o.line").alias("owner_line"))
        kept = left.where("orphan is null").select(*renewed.columns)
        now = self._write("counts", kept.unionByName(renewed), by_shard=True)
        dead = held.where("refs = 0").select(*_KEY)
        self._change(touched, now, dead.limit(0), dead)

    def filters(self) -> Iterator[tuple[int, CuckooFilter]]:
        for r in self._of("filters", _FILTER, None).toLocalIterator():
            yield r["shard"], CuckooFilter(r["buckets"], np.frombuffer(r["slots"], np.uint16).copy())

    def removed(self) -> DataFrame:
        """(doc_id, version, lines): the numbers of the lines to take out of each text, by the exact tables."""
        repeated = self.counts().where("refs > 1").select(*_KEY, "owner_doc", "owner_version", "owner_line")
        hit = self._sharded(self.references()).join(repeated, _KEY).where("doc_id <> owner_doc or version <> owner_version or line <> owner_line")
        return hit.groupBy("doc_id", "version").agg(F.collect_set("line").alias("lines"))

    def render(self, docs: DataFrame) -> DataFrame:
        """docs with ``row`` (the row as it was), ``kept`` (the text without repeated lines) and ``n_removed``."""
        row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
        out = row.join(self.removed(), (F.col("row.doc_id") == F.col("doc_id")) & (F.xxhash64("row.text") == F.col("version")), "left")
        kept = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(F.split(F.col("row.text"), "\n"), lambda x, i: ~F.array_contains(F.col("lines"), i)), "\n"))
        return out.select("row", kept.alias("kept"), F.coalesce(F.size("lines"), F.lit(0)).alias("n_removed"))

    def vacuum(self) -> None:
        """Delete the tables that no present state needs."""
        jvm = self.spark.sparkContext._jvm
        needed = {self.generation} | set(self._at.values())
        for g in range(1, self.generation + 1):
            drop = ["gained", "probed", "changed", "lost", "left"] + ([] if g in needed else ["counts", "filters"])
            for name in drop:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{g}/{name}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def report(docs: DataFrame, shards: int | None = None, least: int = LEAST) -> DataFrame:
    """(doc_id, text, n_removed) for every row: the text without repeated lines."""
    store = LineStore(docs.sparkSession, shards=shards, least=least)
    part = F.pmod(F.xxhash64(docs["doc_id"].cast("long")), F.lit(16))
    store.insert(docs.where(part < 8))
    store.insert(docs.where(part >= 8))
    again = docs.where(part == 3)
    store.delete(again.select("doc_id"))
    store.insert(again)
    store.vacuum()
    return store.render(docs).select(F.col("row.doc_id").alias("doc_id"), F.col("kept").alias("text"), F.col("n_removed").cast("long").alias("n_removed"))


def dedup(docs: DataFrame, shards: int | None = None, least: int = 1) -> DataFrame:
    """docs without repeated lines, short ones too; n_chars, if there is such a column, is the new text's length."""
    store = LineStore(docs.sparkSession, shards=shards, least=least)
    store.insert(docs)
    out = store.render(docs).where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    column = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*(column.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS said, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
k AS (
  SELECT doc_id, text, line, said,
         CASE WHEN length(trim(said)) >= 10 THEN row_number() OVER (PARTITION BY trim(said) ORDER BY doc_id, text, line) ELSE 1 END AS place
  FROM l)
SELECT doc_id, coalesce(string_agg(said, chr(10) ORDER BY line) FILTER (WHERE place = 1), '') AS text, count(*) FILTER (WHERE place > 1) AS n_removed
FROM k GROUP BY doc_id, k.text
"""
