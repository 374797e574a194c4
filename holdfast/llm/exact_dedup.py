"""Exact deduplication by a streaming aggregation over keyed, disk-backed state.

The corpus is read as a file stream.  The state store (RocksDB: on the executors' disks, its
change log in the shared folder) keeps, for every digest ever met and with no watermark and so no
expiry: the digest, the number of rows, the row that stays (most code points, then smallest id)
and where its text lies (file and row).  Each micro-batch sends the keys it changed to the shared
folder; the newest state of a key counts.  A second run with the same ``state_dir`` goes on from
the state it finds there; its rows are those of the new folder, their groups count the old ones too.

On every hit (a digest with more than one row) the whole normalised text is compared with that of
the row that stays, read by its locator.  Digests whose texts differ are grouped again by the text
itself, so a collision never merges two texts.  Of the rows of earlier runs such a group knows the
one the state names; a text equal to another of them stays, so that none is lost.

Everything is DataFrame and SQL functions.  Defined results: null text counts as empty; null ids
order last among equals; a repeated row is a member like any other; an empty table gives no row.
Further columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE, documents, new_path, place, spill

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # An open store holds preallocated files; with many partitions these outweigh the state.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).alias("length"),
        normalised(F.col(text_col)).alias("norm"),
        place(docs, "file_path").alias("file"),
        place(docs, "row_index").alias("row"),
    ).withColumn("digest", digest(F.col("norm")))


def _rank() -> Column:
    """Smaller is better: most code points, smallest id (null last), then the place."""
    return F.struct((-F.col("length")).alias("short"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row")


def digest_state(spark: SparkSession, path: str, schema, *, id_col: str, text_col: str, digest, state_dir: str | None = None, max_bytes: int = 64 << 30) -> DataFrame:
    """Run the stream over what is new under ``path``; the newest state of every digest."""
    state_dir = state_dir or new_path(spark, "dedup-state")
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern it may also name a single file
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(path)
    state = _keyed(stream, id_col, text_col, digest).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(_rank()).alias("best"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{state_dir}/changes/batch={number}_")

    with _settings(spark, _STORE):
        state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{state_dir}/stream").trigger(availableNow=True).start().awaitTermination()
    try:
        changes = spark.read.parquet(f"{state_dir}/changes/*")
    except Exception as e:  # an empty table makes no batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], spark.createDataFrame([], state.schema).schema)
    newest = changes.groupBy("digest").agg(F.max_by(F.struct("n", "best"), "batch").alias("at"))
    return newest.select("digest", "at.n", "at.best")


def _earlier_keepers(spark: SparkSession, hits: DataFrame, table: DataFrame, keyed: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """The rows that stay for the hits and lie in files of earlier runs, read by their locators."""
    wanted = hits.select("digest", F.col("best.file").alias("file"), F.col("best.row").alias("row")).distinct()
    here = table.select(place(table, "file_path").alias("file")).distinct()
    wanted, _ = spill(wanted.join(F.broadcast(here), "file", "left_anti"), "dedup-earlier")
    files = [unquote(r.file) for r in wanted.select("file").distinct().collect()]
    if not files:
        return None
    found, _ = spill(keyed(spark.read.schema(table.schema).parquet(*files)).drop("digest").join(wanted, ["file", "row"]), "dedup-keepers")
    if found.count() != wanted.count():
        raise RuntimeError("rows that the state names are no longer in their files")
    return found


def exact_dedup(spark: SparkSession, docs: DataFrame | str, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state_dir: str | None = None) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256, file and row of its text.

    ``docs`` is the path of a Parquet table, or a DataFrame, which is first written to the shared
    folder because a stream reads files.
    """
    path = docs.rstrip("/") if isinstance(docs, str) else spill(docs.select(id_col, text_col), "dedup-input")[1]
    table = spark.read.parquet(path)
    state = digest_state(spark, path, table.schema, id_col=id_col, text_col=text_col, digest=digest, state_dir=state_dir)
    rows = _keyed(table, id_col, text_col, digest)
    keeps = (F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row"))
    met, _ = spill(
        rows.join(state, "digest").select(
            "doc_id", "length", "file", "row", "digest", "n", "best", keeps.alias("kept"),
            (F.col("digest") if digest is sha256 else sha256(F.col("norm"))).alias("text_sha256"),
            F.when(F.col("n") > 1, F.col("norm")).alias("norm"),
        ),
        "dedup-hits",
    )
    # Every hit against the whole text of the row that stays.
    keepers = met.filter("n > 1 AND kept").select("digest", F.col("norm").alias("keeper_norm"))
    earlier = _earlier_keepers(spark, met.filter("n > 1"), table, lambda t: _keyed(t, id_col, text_col, digest)) if state_dir else None
    if earlier is not None:
        keepers = keepers.unionByName(earlier.select("digest", F.col("norm").alias("keeper_norm")))
    clashes, _ = spill(met.filter("n > 1").join(keepers, "digest").filter("norm <> keeper_norm").select("digest").distinct(), "dedup-clashes")
    if not clashes.isEmpty():
        # Digests that collided: the text itself is the key, and the state's row is not used.
        own = Window.partitionBy("digest", "norm")
        mixed = met.join(clashes, "digest", "left_semi").withColumn("new", F.lit(True))
        if earlier is not None:
            old = earlier.join(clashes, "digest", "left_semi").withColumn("new", F.lit(False))
            mixed = mixed.unionByName(old, allowMissingColumns=True)
        mixed = mixed.withColumns({"n": F.count(F.lit(1)).over(own), "best": F.min(_rank()).over(own)}).withColumn("kept", keeps).filter("new").drop("new")
        met = met.join(clashes, "digest", "left_anti").unionByName(mixed)
    return met.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        "kept", "text_sha256", "file", "row",
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for it."""
    return exact_dedup(spark, f"{sf_dir}/documents.parquet").drop("file", "row")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
       sha256(norm) AS text_sha256
FROM r
"""

__all__ = ["digest_state", "documents", "exact_dedup", "op4"]
