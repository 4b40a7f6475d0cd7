"""Tables written to the cluster's shared folder.

``settle`` cuts lineage by writing a table and reading it back. It survives the
loss of executors, freezes row placement, and gives Spark the true size of a
small table, so that its own threshold decides between broadcast and shuffle.
"""

from __future__ import annotations

import uuid


def shared_root(spark):
    """The folder named in spark.checkpoint.dir; where it is unset, the warehouse, which is shared too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_settled"
    return f"{root.rstrip('/')}/emberlog-{spark.sparkContext.applicationId}"


def fresh_path(spark, kind="table"):
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def settle(df, packed=False):
    """Write ``df`` to the shared folder and return a scan of it.

    ``packed`` is for large tables of texts: less disk for more CPU. Small tables go unpacked, as
    Spark takes the size of the files for that of the rows when it decides on a broadcast.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    writer = df.write.option("compression", "zstd") if packed else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark):
    """Delete the tables this application settled. Call when its frames are done with."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.delete(path, True)
