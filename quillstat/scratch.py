"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows a file, for tables whose writer knows how many there are at most.
FILE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process (a local master), as in tests, an unset one is replaced by a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            found = "file://" + tempfile.mkdtemp(prefix="quillstat-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one operator call in the shared folder.

    A written table cuts lineage: later stages reread it instead of recomputing, on any executor. Tables that are not
    needed any more are removed with `remove`; the folder goes with `close`, at the end of a `with` block, or when the
    driver's process ends, since a returned frame reads it lazily. All work after the session has stopped. Operators that
    return such frames take a `scratch`: who passes one decides when its tables go.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/quillstat/{name}-{uuid.uuid4().hex}"
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(self.close)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: how many the table has at most, if they are narrow and cheap to make. It then has a file for FILE_ROWS of
        them, or for each core, and not for each shuffle partition: a file costs processes on a local file system (its mode
        is set by a chmod that the executor forks) and requests on any other.
        """
        path = f"{self.path}/{name}"
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self._conf).delete(p, True)

    def remove(self, name: str) -> None:
        """Deletes one table; frames that read it are of no use from here on."""
        self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # noqa: BLE001  the gateway may already be closed at exit
            return
        finally:
            atexit.unregister(self.close)
