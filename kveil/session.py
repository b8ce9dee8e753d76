"""Session helpers: sessions for tests and benches, lineage cuts, small local tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# A table of at most this many rows may travel through the driver (hierarchies, offsets).
SMALL_ROWS = 100_000


def local_session(
    app: str = "kveil", cores: str = "*", memory: str = "8g", settings: dict[str, str] | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # no Python call site per expression: building a plan takes a third of the time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the session's own, else a scratch folder in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kveil-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return sc.getCheckpointDir()


_job_folder: ContextVar[str | None] = ContextVar("kveil_job_folder", default=None)


@contextmanager
def job_folder(spark: SparkSession, name: str = "job") -> Iterator[str]:
    """Tables written inside the block go to one sub-folder of the checkpoint folder.

    Gives its path; it belongs to the caller, who deletes it when the job's results are written elsewhere.
    """
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    token = _job_folder.set(path)
    try:
        yield path
    finally:
        _job_folder.reset(token)


def work_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the present job's folder, else the checkpoint folder itself."""
    return _job_folder.get() or ensure_checkpoint_dir(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table once into the checkpoint folder and go on from the file.

    Later passes see exactly these rows whichever executors are lost, and read only the columns
    they use. The folder is the caller's to empty when the job is over, see ``job_folder``.
    """
    path = f"{work_folder(df.sparkSession)}/kveil-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, int | None]:
    """Evaluate a table that is expected to be small; returns it and its rows, None when it is large.

    Up to ``max_rows`` rows it becomes a local relation, whose exact size lets Catalyst broadcast
    it on its own; a larger one is written out and joins to it stay shuffle joins.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows:
        return df.sparkSession.createDataFrame(head, df.schema), head.num_rows
    return cut_lineage(df), None
