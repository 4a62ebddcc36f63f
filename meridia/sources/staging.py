"""Written intermediates in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a written table: no lineage, and whole when executors are lost.

    The folder is spark.checkpoint.dir; only a local session may do without, and gets a new folder.
    """
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    path = f"{place.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled, never broadcast.

    Spark takes the size of a side from the files it comes from; exploded and well compressed rows are many times that.
    """
    return df.hint("merge")


def forgotten(*tables: DataFrame) -> None:
    """Deletes the files of cut tables that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        if hasattr(t, "_cut"):
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(t._cut)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
