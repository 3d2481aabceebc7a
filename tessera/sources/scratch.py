"""Tables between the steps of a job, in the folder that all executors share.

A stored table cuts lineage, is computed once, and outlives lost executors. (checkpoint() would compute a lineage
without a shuffle twice: once to count and once to write.)
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}
#: Spark's setting by which a job's shuffle files go when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names. Only a session whose executors are threads of this process may do without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return "/tmp/checkpoints"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by release()."""
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def store(df: DataFrame, label: str, files: int | None = None, buckets: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back; `files` bounds the number of files of a small table. What was
    shuffled for it isn't needed any more and is deleted.

    `buckets`: a column by which the files are Spark's buckets, as many as a shuffle has partitions, so that the table meets others
    by that column without being shuffled itself. Spark reads buckets only from a table of its catalog: the name is dropped as
    soon as the plan that is returned has it, the files stay.
    """
    spark = df.sparkSession
    path, conf = scratch_path(spark, label), spark.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    writer = (df.coalesce(files) if files else df).write.mode("overwrite").option("compression", "zstd")
    try:
        if buckets is None:
            writer.parquet(path)
            out = spark.read.schema(df.schema).parquet(path)
        else:
            name = f"spark_catalog.default.scratch_{uuid.uuid4().hex}"
            n = int(conf.get("spark.sql.shuffle.partitions"))
            try:
                writer.bucketBy(n, buckets).option("path", path).format("parquet").saveAsTable(name)
                out = spark.table(name).select(*df.columns)
            finally:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    if spark._sc._jsc is None:  # the session has ended; the cluster's own clean-up of that folder applies
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that store() returned and that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path in _WRITTEN:
            _delete(_WRITTEN.pop(path), path)


def written() -> set[str]:
    """The paths of all tables that aren't deleted yet."""
    return set(_WRITTEN)


def release(keep: set[str] = frozenset()) -> None:
    """Deletes every table written so far but those to keep; results that still read one must be stored before."""
    for path in [p for p in _WRITTEN if p not in keep]:
        _delete(_WRITTEN.pop(path), path)


def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001 - the gateway may be gone while the interpreter ends
        _WRITTEN.clear()


atexit.register(_at_exit)
