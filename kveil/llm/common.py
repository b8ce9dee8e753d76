"""What several operators share: table access, word rules, let-bindings and prefix sums in Spark SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.session import ensure_checkpoint_dir

# The six characters that end a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col(quoted(name))


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` standing for ``value``, which is then evaluated once per row.

    Inside a lambda an expression is evaluated anew for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text in order; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def running_totals(lengths: Column, block: int = 512) -> Column:
    """Sum of all earlier elements, for each element of an array of integers.

    Two levels, blocks and elements within a block, keep the cost of growing arrays in bounds.
    """

    def totals(xs: Column) -> Column:
        start = F.struct(F.array().cast("array<long>").alias("seen"), F.lit(0).cast("long").alias("sum"))

        def step(acc: Column, x: Column) -> Column:
            seen = F.concat(acc["seen"], F.array(acc["sum"]))
            return F.struct(seen.alias("seen"), (acc["sum"] + x).alias("sum"))

        return F.aggregate(xs, start, step)

    def whole(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / F.lit(block)).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(starts, lambda i: totals(F.slice(xs, i * block + 1, F.lit(block))))

        def joined(bs: Column) -> Column:
            before = totals(F.transform(bs, lambda b: b["sum"]))["seen"]
            shifted = F.zip_with(bs, before, lambda b, o: F.transform(b["seen"], lambda s: s + o))
            return F.flatten(shifted)

        return let(blocks, joined)

    return let(lengths, whole)


CHUNK = 256


def chunks_of(text: Column) -> Column:
    """A text in pieces of CHUNK code points, so that a part of it is found without walking from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part_of(chunks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (from 0, end exclusive) of a text given by ``chunks_of``."""
    first = F.floor(start / CHUNK).cast("int")
    count = F.ceil(end / CHUNK).cast("int") - first
    near = F.array_join(F.slice(chunks, first + 1, F.greatest(count, F.lit(0))), "")
    return F.substring(near, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))


def ship(spark: SparkSession) -> None:
    """Sends this library to the executors, once per Spark context, so that tasks can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_kveil_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="kveil-ship-"), "kveil_library.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._kveil_shipped = True


def map_arrow(df: DataFrame, work, schema: str) -> DataFrame:
    """``df.mapInArrow`` for workers of this library."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)
