"""Exact deduplication by a stream with disk-backed keyed state that never expires.

Each micro-batch folds (digest, id, locator) rows into state kept by RocksDB and keyed by the
SHA-256 digest of the normalised text: the least stable identifier, the locator of its content and
the number of rows. Rows of one digest are summed before they reach the state, so a group of copies
of any size costs it one row per task. Digests that were hit more than once then have their full
bytes compared; a digest shared by different texts is split by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kveil.llm.common import SPACE_CLASS, col, scratch, table
from kveil.session import cut_lineage

# State on disk; many small stores should not reserve megabytes of file space each.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


def digest_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The stream's rows: binary digest, stable identifier, and where the content lies."""
    where = F.struct(F.input_file_name().alias("file"), col(id_col).alias("id"))
    return df.select(
        F.unhex(F.sha2(normalised(col(text_col)), 256)).alias("digest"), col(id_col).alias("id"), where.alias("locator")
    )


def run_stream(spark: SparkSession, feed: str, schema: T.StructType, name: str, files_per_batch: int) -> DataFrame:
    """State of every digest after the stream has read all files of ``feed``: keeper, locator, size.

    The stream may be stopped and started again on the same folder: state and offsets live under
    ``<name>/state``, and a batch that runs twice overwrites its own updates.
    """
    with settings(spark, STATE_SETTINGS):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(feed)
        # nulls sort last among identifiers: a row without one stays only if all its copies lack it
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "locator"))
        state = rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("size"))

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{name}/updates/batch={number}")

        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{name}/state")
            .trigger(availableNow=True)
            .foreachBatch(save)
            .start()
        )
        query.awaitTermination()
    value = T.StructType(
        [
            T.StructField("none", T.BooleanType()),
            T.StructField("id", schema["id"].dataType),
            T.StructField("locator", schema["locator"].dataType),
        ]
    )
    shape = T.StructType(
        [
            T.StructField("digest", T.BinaryType()),
            T.StructField("first", value),
            T.StructField("size", T.LongType()),
        ]
    )
    updates = spark.read.schema(shape).parquet(f"{name}/updates")
    # a digest's later updates only lower its first row and raise its size
    return updates.groupBy("digest").agg(F.min("first").alias("first"), F.max("size").alias("size"))


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 64
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``df``, dropped ones too.

    Of equal texts the row with the least identifier stays; null identifiers come last. Identifiers
    should be unique: rows that share text and identifier are one row told twice, and all of them
    are marked kept when that identifier stays. A null text counts as empty, and an empty table
    gives an empty one. No other column is read.
    """
    spark = df.sparkSession
    work = scratch(spark, "exact-dedup")
    rows = digest_rows(df, id_col, text_col)
    rows.write.parquet(f"{work}/feed")
    feed = spark.read.schema(rows.schema).parquet(f"{work}/feed")
    if feed.isEmpty():
        final = spark.createDataFrame([], "digest binary, keep_id long, size long").withColumn(
            "keep_id", F.col("keep_id").cast(rows.schema["id"].dataType)
        )
    else:
        state = run_stream(spark, f"{work}/feed", rows.schema, work, files_per_batch)
        final = cut_lineage(state.select("digest", F.col("first.id").alias("keep_id"), "size"))
    out = feed.select("digest", "id").join(final, "digest").select(
        "id", "keep_id", F.col("size").alias("group_size"), "digest"
    )
    clashes = cut_lineage(different_bytes(df, final, id_col, text_col))
    if not clashes.isEmpty():
        out = split_clashes(df, out, clashes, id_col, text_col)
    return out.select(
        F.col("id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def texts_of(df: DataFrame, digests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, id, text) of the rows with one of the given digests."""
    text = normalised(col(text_col))
    rows = df.select(F.unhex(F.sha2(text, 256)).alias("digest"), col(id_col).alias("id"), text.alias("text"))
    return rows.join(digests.select("digest"), "digest", "left_semi")


def different_bytes(df: DataFrame, final: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests whose rows differ in their full bytes.

    Grouping by digest and text compares the bytes of every hit; copies meet before the shuffle.
    """
    hits = final.filter("size > 1")
    texts = texts_of(df, hits, id_col, text_col).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")


def split_clashes(df: DataFrame, out: DataFrame, clashes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of digests with several texts, grouped by text instead."""
    texts = texts_of(df, clashes, id_col, text_col)
    groups = texts.groupBy("digest", "text").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    again = texts.join(groups, ["digest", "text"]).select("id", "keep_id", "group_size", "digest")
    return out.join(clashes, "digest", "left_anti").select("id", "keep_id", "group_size", "digest").unionByName(again)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of equal texts, the one with the least id.

    Of rows repeated with their id, any one stays.
    """
    digest = F.lower(F.sha2(normalised(F.col("text")), 256))
    found = exact_dedup(docs).filter("kept").groupBy("id", "text_sha256").agg(F.count(F.lit(1)).alias("rows"))
    keepers = cut_lineage(found)

    def rows_of(some: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(some["id"]) & (digest == some["text_sha256"])
        return docs.join(some, same, "left_semi").select(docs.columns)

    once, repeated = keepers.filter("rows = 1"), keepers.filter("rows > 1")
    if repeated.isEmpty():
        return rows_of(once)
    return rows_of(once).unionByName(rows_of(repeated).dropDuplicates(["doc_id", "text"]))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")
