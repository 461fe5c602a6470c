"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations alone.

A run is a table of line keys and the number of documents that hold each, bucketed and
sorted by key, so that runs of one store meet in merge joins without a new shuffle of
theirs. A batch of documents counts its own keys, merge-anti-joins the runs' settled keys
(those already known from enough documents, which need no further count) and adds the
rest as a run of level 0. When a level holds `fanout` runs they are compacted into one
run of the next level. At the end the runs are summed.

A line's key is the line without ASCII white space at both ends and with A-Z in lower
case, hashed to 128 bits (two seeds of XXH64). Keys found in at least min_docs documents
lose all their lines in every document; keys shorter than min_chars lose none. Lines that
stay keep their text and order.

Defined results: a null or empty text is one empty line and stays so; a text all of
whose lines go is empty; repeated rows count as documents of their own; a line repeated
in one document counts once; an empty table gives an empty result; null ids are ids; only
the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import remove_path
from .common import ASCII_SPACE, materialise, new_path, remove, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["_h1", "_h2"]


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


class LineRuns:
    """A levelled store of sorted runs (_h1, _h2, n: documents that hold the key)."""

    def __init__(self, spark, min_docs: int, fanout: int = 3, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "run")
        (
            df.repartition(self.buckets, *KEY)
            .write.option("path", self.paths[name])
            .option("compression", "zstd")
            .bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .saveAsTable(name)
        )
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, self.paths.pop(name))  # the table's own entry doesn't hold its files

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def add(self, keys: DataFrame) -> None:
        """keys: one row for each document and key of a batch."""
        new = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        for run in self.runs():
            new = new.join(run.where(F.col("n") >= self.min_docs).select(*KEY).hint("merge"), KEY, "left_anti")
        self._put(new, 0)

    def drop(self) -> None:
        """Every run written, those of a step that failed too."""
        for name in list(self.paths):
            self._drop(name)
        self.levels = []

    def _put(self, df: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(self._write(df))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(self._sum(old), level + 1)
            # the runs that were compacted have been read in full by now
            for name in old:
                self._drop(name)

    def _sum(self, names: list[str]) -> DataFrame:
        """Runs merged by key, counts added. Keys are unique in a run, so full outer merge joins of the sorted buckets do it."""
        df = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("n", "_n").hint("merge")
            df = df.join(other, KEY, "full_outer").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"))
        return df

    def common(self) -> DataFrame:
        """Keys of at least min_docs documents."""
        names = [t for level in self.levels for t in level]
        return self._sum(names).where(F.col("n") >= self.min_docs).select(*KEY)


#: Common keys up to this number (16 bytes each) go to every executor; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def dedup_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Returns id, n_lines (before dropping), n_dropped and kept (the text that stays), a row for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    # with the id, the text's hash names a row; rows alike in both lose the same lines
    whole = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_doc"), lines(text).alias("_lines"))
    keys = F.filter(F.transform("_lines", line_key), lambda k: F.length(k) >= min_chars)
    held = whole.select(F.pmod(F.xxhash64("_doc", "_id"), F.lit(batches)).alias("_batch"), F.explode(F.array_distinct(keys)).alias("_key"))
    held = materialise(held.select("_batch", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(9), "_key").alias("_h2")), "lines")

    runs = LineRuns(spark, min_docs)
    try:
        for i in range(batches):
            runs.add(held.where(F.col("_batch") == i).select(*KEY))
        common = materialise(runs.common(), "common_lines")
    finally:
        runs.drop()
    remove(held)

    n_common = common.count()
    at = whole.select("_id", "_doc", F.posexplode("_lines").alias("_at", "_line")).withColumn("_key", line_key(F.col("_line")))
    at = at.where(F.length("_key") >= min_chars).select("_id", "_doc", "_at", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(9), "_key").alias("_h2"))
    at = at.join(F.broadcast(common) if n_common <= BROADCAST_KEYS else common, KEY, "left_semi")
    gone = at.groupBy("_id", "_doc").agg(F.collect_set("_at").alias("_gone")).withColumnsRenamed({"_id": "_id2", "_doc": "_doc2"})

    found = whole.join(gone, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_doc") == F.col("_doc2")), "left")
    n = F.size("_lines")
    stay = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone")), lambda i: F.get(F.col("_lines"), i))
    )
    return found.select(
        F.col("_id").alias(id_col),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(stay, "\n").alias("kept"),
    )


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (
  SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
