"""Durable intermediate results.

A fixpoint loop or a plan that reads one expensive result several times must
cut its lineage somewhere that outlives an executor.  Everything here goes to
the folder the cluster names in ``spark.checkpoint.dir``; a private folder is
made only where that setting is absent and the session runs on one machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can read and write."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def table(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result has exact file statistics, so the planner's broadcast decisions
    downstream rest on measured sizes, and a lost executor costs a re-read only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str = "step", **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`table`, with aggregates of its rows taken by the job that writes it."""
    seen = Observation()
    out = table(df.observe(seen, *[v.alias(k) for k, v in metrics.items()]), name)
    return out, seen.get


def drop_tables(keep: int = 0) -> None:
    """Delete the tables written so far, except the last ``keep``."""
    done, _written[:] = _written[: len(_written) - keep], _written[len(_written) - keep :]
    for spark, path in done:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass


def drop(df: DataFrame) -> None:
    """Delete the table behind ``df`` (a result of :func:`table`) once it is superseded."""
    files = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for pair in list(_written):
        if any(pair[1].split(":", 1)[-1].lstrip("/") in f for f in files):
            _written.remove(pair)
            jvm = pair[0].sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(pair[1])
            p.getFileSystem(pair[0].sparkContext._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(drop_tables)
