"""Session settings and lineage cutting shared by the planners."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "factloom", **config) -> SparkSession:
    """A session with the settings the engine relies on: ANSI errors, adaptive execution, UTC."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for k, v in (defaults | config).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where none is set, one of our own if there are no executors
    but the driver, as in tests, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        import tempfile

        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the shared folder: lineage ends there and a lost executor loses nothing. Unlike a
    checkpoint it brings its size along, by which small sides of later joins are broadcast."""
    path = f"{shared_folder(df.sparkSession)}/factloom/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
