"""Tables written to the folder that the driver and all executors share, and read back: computed once, and not lost with an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where none is set (a local session) a temporary folder is made."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        place = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = place.get() if place.isDefined() else None
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="antiphon-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/antiphon/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    place = new_place(df.sparkSession, name)
    df.write.option("compression", codec).parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    out._antiphon_place = place
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of keep() that nothing needs any more."""
    for df in tables:
        place = getattr(df, "_antiphon_place", None)
        if place:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
