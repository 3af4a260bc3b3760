"""Shared folder for written intermediate tables.

Tables live in the folder named by `spark.checkpoint.dir`, which every executor and the
driver can reach. Where that is unset a folder of this machine serves, but only under a
`local` master; on a cluster the library raises instead of losing rows in node-local disks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_owned: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a local one where that is unset under a local master."""
    folder = (spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
              or spark.conf.get("spark.checkpoint.dir", None))
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.gettempdir()


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; removed by `release` or when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/countgrove-{label}-{uuid.uuid4().hex}"
    _owned[path] = spark
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The table written once to the shared folder and read back: short lineage, one evaluation.

    Lost executors cost only their own tasks, and the size of the files tells the planner
    whether the table may be broadcast.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables) -> None:
    """Deletes tables of `written` (or their paths) that nothing reads any more."""
    for table in tables:
        paths = [table] if isinstance(table, str) else {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for path in paths:
            owned = path if path in _owned else next((p for p in _owned if p.split("/countgrove-")[-1]
                                                      == path.split("/countgrove-")[-1]), None)
            if owned:
                _delete(owned, _owned.pop(owned))


def _delete(path: str, spark: SparkSession) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release_all() -> None:
    """Deletes every table still owned; runs when the driver ends with its session alive."""
    while _owned:
        path, spark = _owned.popitem()
        try:
            _delete(path, spark)
        except Exception:  # the session or its JVM has already gone
            return


atexit.register(release_all)
