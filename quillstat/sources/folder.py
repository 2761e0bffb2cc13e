"""Named files in and out: a writer that shows files only once its job has succeeded, and what it is used for.

Tasks write to a staging folder of their own attempt; the driver moves the files of the attempts that Spark accepted to
their places. Files of failed, killed or doubled attempts never show, and a job that is run again after a crash, even
one in the middle of its moves, leaves each file once, since places depend on the rows alone.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quillstat.shipping import ship

STAGING = "_staging"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that driver and executors share."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    paths: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root, self.job = root.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = _store(self.root)
        folder, paths = f"{STAGING}/{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            path = row["path"]
            if path.startswith(("/", STAGING)) or ".." in path.split("/"):
                raise ValueError(f"not a place below the folder: {path}")
            target = f"{root}/{folder}/{path}"
            store.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(target) as out:
                out.write(bytes(row["content"] or b""))
            paths.append(path)
        return _Written(folder, paths)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.root)
        for m in filter(None, messages):
            for path in m.paths:
                target = f"{root}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                if store.get_file_info(target).type != fs.FileType.NotFound:
                    store.delete_file(target)
                store.move(f"{root}/{m.folder}/{path}", target)
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_store(self.root))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        staged = f"{root}/{STAGING}/{self.job}"
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class NamedFiles(DataSource):
    """Format `named_files`, for writing: rows (path, content) to files below the folder `path` of the options. A path that rows share keeps the one written last."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_files(files: DataFrame, root: str) -> None:
    """Writes (path string, content binary) rows below `root`."""
    ship(files.sparkSession).dataSource.register(NamedFiles)
    files.select("path", "content").write.format("named_files").mode("append").save(root)


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below `root`, paths from there on. Spark lists no files without content."""
    at = F.substring_index(F.col("path"), root.rstrip("/").removeprefix("file://") + "/", -1)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).where(~F.col("path").contains(f"/{STAGING}/")).select(at.alias("path"), "content")


def pending_files(files: DataFrame, root: str) -> DataFrame:
    """Those of (path, content) that `root` does not have yet, asked where the rows are: a write that was cut short is taken up with them."""

    def absent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(root)
        for b in batches:
            found = store.get_file_info([f"{place}/{p}" for p in b.column("path").to_pylist()])
            yield b.filter(pa.array([f.type == fs.FileType.NotFound for f in found], pa.bool_()))

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(absent, "path string, content binary")


def _csv_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A table's rows (path, names, rows of cells in order) as a file."""
    for b in batches:
        out = []
        for names, rows in zip(b.column("names").to_pylist(), b.column("rows").to_pylist(), strict=True):
            text = io.StringIO(newline="")
            w = csv.writer(text, lineterminator="\n")
            cells = [{e["key"]: e["value"] for e in r["cells"]} for r in rows]
            w.writerows([names, *[["" if c.get(n) is None else c[n] for n in names] for c in cells]])
            out.append(text.getvalue().encode())
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], ["path", "content"])


def bundle_files(cells: DataFrame) -> DataFrame:
    """(path, content): the numbered CSV tables <game>/<endpoint>_<suffix>.csv of rows in the form of `files.CELLS`. A table is a file, so it is a group."""
    path = F.concat_ws("/", "game_id", F.concat(F.col("endpoint"), F.lit("_"), F.col("suffix").cast("string"), F.lit(".csv")))
    rows = F.array_sort(F.collect_list(F.when(F.col("ord") >= 0, F.struct("ord", F.map_entries("cells").alias("cells")))))
    heads = F.max(F.when(F.col("ord") == -1, F.col("names")))
    ship(cells.sparkSession)
    return cells.groupBy(path.alias("path")).agg(heads.alias("names"), rows.alias("rows")).mapInArrow(_csv_files, "path string, content binary")


def copy_bundles(cells: DataFrame, games: DataFrame, root: str) -> None:
    """Copies the bundles of the listed games (game_id) to `root`; files that are there already stay."""
    mine = cells.join(games.select("game_id").distinct(), "game_id", "left_semi")
    write_files(pending_files(bundle_files(mine), root), root)
