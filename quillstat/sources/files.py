"""Files in and out: game bundles of numbered CSV tables, season lists, appending and JSON sinks, markdown."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.shipping import ship

#: The endpoints of a game bundle.
ENDPOINTS = ("traditional", "advanced", "misc", "hustle", "player_track", "playbyplay", "summary")
GAMES = "game_id string, date string, away string, home string, away_pts bigint, home_pts bigint, label string, season string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has a file, in whatever store it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def suffixes(spark: SparkSession, pattern: str) -> list[int]:
    """The numbers that stand before the extension of the files a glob finds."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted({int(m[1]) for f in found if (m := re.search(r"_([0-9]+)\.csv$", f.getPath().getName()))})


#: Rows of numbered tables whose columns differ: a header of each file (ord -1), then its rows.
CELLS = "game_id string, endpoint string, suffix int, ord long, names array<string>, cells map<string,string>"
_CELLS = pa.schema([("game_id", pa.string()), ("endpoint", pa.string()), ("suffix", pa.int32()), ("ord", pa.int64()), ("names", pa.list_(pa.string())), ("cells", pa.map_(pa.string(), pa.string()))])
_NUMBERED = re.compile(r"([^/]+)/([^/]+)_([0-9]+)\.csv$")


def cell_rows(game: str, endpoint: str, suffix: int, names: list[str], rows: Iterator[list[str | None]]) -> Iterator[tuple]:
    """One table in the form of CELLS. Of columns of one name the first counts; cells a row lacks are null."""
    yield game, endpoint, suffix, -1, names, None
    first = {n: k for k, n in reversed(list(enumerate(names)))}
    for at, row in enumerate(rows):
        yield game, endpoint, suffix, at, None, [(n, row[k] if k < len(row) else None) for n, k in first.items()]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(2**31 - 1)
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            game, endpoint, suffix = _NUMBERED.search(path).groups()
            lines = csv.reader(io.StringIO(content.as_py().decode("utf-8-sig"), newline=""))
            values = ([c or None for c in line] for line in lines if line)
            out = list(cell_rows(game, endpoint, int(suffix), [c or "" for c in next(values, [])], values))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_CELLS)], schema=_CELLS)


def numbered_tables(spark: SparkSession, root: str, endpoint: str = "*", suffix: str = "*", games: str = "*") -> DataFrame:
    """The tables <root>/<game>/<endpoint>_<suffix>.csv of all chosen games in the form of CELLS, parsed file by file where Spark puts them. Only the empty field is null."""
    files = ship(spark).read.format("binaryFile").load(f"{root}/{games}/{endpoint}_{suffix}.csv").where(F.col("path").rlike(r"_[0-9]+\.csv$"))
    return files.select("path", "content").mapInArrow(_parsed, CELLS)


def table_of(cells: DataFrame, endpoint: str, suffix: int, ordered: bool = False, key: str = "game_id") -> DataFrame | None:
    """One table over all games of `cells`, by name: every column that some game has, as text, null in games without it; with game_id (as `key`) and, `ordered`, the row's place in its file. None if no game has it.

    Columns come in the order of their places in the headers; those named like the keys give way to them.
    """
    mine = cells.where((F.col("endpoint") == endpoint) & (F.col("suffix") == suffix))
    heads = mine.where("ord = -1")
    names = [r.name for r in heads.select(F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]
    if not names and heads.isEmpty():
        return None
    keys = [F.col("game_id").alias(key), *([F.col("ord")] if ordered else [])]
    taken = {key, "ord"} if ordered else {key}
    return mine.where("ord >= 0").select(*[F.col("cells").getItem(n).alias(n) for n in names if n.lower() not in taken], *keys)


def bundle_table(spark: SparkSession, root: str, endpoint: str, suffix: int, games: str = "*", ordered: bool = False) -> DataFrame | None:
    """One table of an endpoint over all chosen games, keyed by its file suffix; null only for the empty field; None if no game has it.

    Columns, and their order, differ between games: each is read as text by name (later casts are tolerant), null where
    a game lacks it, with the game's folder as game_id. `ordered` adds `ord`, the row's place in its file.
    """
    if not exists(spark, f"{root}/{games}/{endpoint}_{suffix}.csv"):
        return None
    return table_of(numbered_tables(spark, root, endpoint, str(suffix), games), endpoint, suffix, ordered)


def load_bundle(spark: SparkSession, root: str, games: str = "*") -> dict[tuple[str, int], DataFrame]:
    """Every table that some game has, by (endpoint, suffix), whatever the suffix. Raises if there is none."""
    found = {(e, k): bundle_table(spark, root, e, k, games, e == "playbyplay") for e in ENDPOINTS for k in suffixes(spark, f"{root}/{games}/{e}_*.csv")}
    if not found:
        raise FileNotFoundError(f"no game tables under {root}/{games}")
    return found


def load_sample(spark: SparkSession, root: str, game_id: str) -> dict[tuple[str, int], DataFrame]:
    """One game's tables. Raises if an endpoint has none."""
    found = load_bundle(spark, root, game_id)
    if missing := [e for e in ENDPOINTS if e not in {e for e, _ in found}]:
        raise FileNotFoundError(f"game {game_id}: no table of {', '.join(missing)}")
    return found


def sample_games(spark: SparkSession, root: str, season: str | None = None) -> DataFrame:
    games = spark.read.schema(GAMES).option("header", True).option("nullValue", "").csv(f"{root}/games.csv")
    return games if season is None else games.where(F.col("season") == season)


def first_found(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists."""
    return next((p for p in paths if exists(spark, p)), None)


def with_fallback(live: DataFrame | None, sample: DataFrame) -> DataFrame:
    """Live rows where there are any, else the sample's, flagged."""
    if live is not None and not live.isEmpty():
        return live.withColumn("sample", F.lit(False))
    return sample.withColumn("sample", F.lit(True))


def is_finals(game_id: Column) -> Column:
    """Ten characters, the eighth a 4."""
    return (F.length(game_id) == 10) & (F.substring(game_id, 8, 1) == "4")


def build_sample(seasons: list[DataFrame], path: str) -> None:
    """Finals of all seasons as one list, partitioned by season."""
    whole = seasons[0]
    for s in seasons[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    whole.where(is_finals(F.col("game_id"))).write.mode("overwrite").partitionBy("season").parquet(path)


def append(df: DataFrame, path: str, columns: list[str]) -> None:
    """Appends rows with a fixed column order."""
    df.select(*columns).write.mode("append").parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str, csv: bool = False) -> None:
    """One folder a table, Parquet or CSV with header."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        w.option("header", True).csv(f"{path}/{name}") if csv else w.parquet(f"{path}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("v")).select("v.*")


def markdown_row(columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))


def markdown_table(df: DataFrame) -> str:
    """A small, ordered frame as a markdown table."""
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + [r[0] for r in df.select(markdown_row(df.columns)).collect()])


def splice(text: str, marker: str, part: str) -> str:
    """Puts `part` between the two markers <!-- marker --> and <!-- /marker -->."""
    a, b = f"<!-- {marker} -->", f"<!-- /{marker} -->"
    before, rest = text.split(a, 1)
    return f"{before}{a}\n{part}\n{b}{rest.split(b, 1)[1]}"
