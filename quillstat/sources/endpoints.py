"""Game endpoints: a data source that fetches them, a landing table that keeps them, and the views of a game.

Fetching is a Python data source, one partition a key (game, endpoint), so Spark places, retries and commits the work. A
transport does the single request; it is named by its import path and options, so that it can be swapped: a folder, HTTP,
or a caller's own. Landed keys are never fetched again: `land` reads what is missing only, after one quick probe, and
appends it in one commit; a job that fails lands nothing of its wave.
"""

from __future__ import annotations

import csv
import importlib
import json
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillstat.operators.boxscore import games_of_rows
from quillstat.shipping import ship
from quillstat.sources.files import CELLS, ENDPOINTS, cell_rows, exists, is_finals, table_of

#: Seconds a request may take, a probe may take, between requests, and before the k-th retry (times k).
TIMEOUT, PROBE_TIMEOUT, PAUSE, BACK_OFF = 40.0, 20.0, 0.8, 2.0
RETRIES, WAVE = 3, 512
#: The list of a season's games: two rows a game, under the key "<season> <type>".
FINDER = "games"

#: A table: its column names and its rows.
Table = tuple[list[str], list[list[Any]]]


class FolderTransport:
    """Answers from <root>/<key>/<endpoint>_<i>.csv. `journal` names a folder in which every call leaves a file."""

    def __init__(self, root: str, journal: str | None = None) -> None:
        self.root, self.journal = Path(root), journal and Path(journal)

    def fetch(self, endpoint: str, key: str, timeout: float) -> list[Table]:
        if self.journal:
            self.journal.mkdir(parents=True, exist_ok=True)
            (self.journal / uuid.uuid4().hex).write_text(json.dumps([endpoint, key, timeout]))
        found = sorted((self.root / key).glob(f"{endpoint}_*.csv"), key=lambda p: int(p.stem.rsplit("_", 1)[1]))
        if not found:
            raise ConnectionError(f"no answer for {endpoint} of {key}")
        tables = []
        for path in found:
            with path.open(newline="", encoding="utf-8-sig") as f:
                lines = [line for line in csv.reader(f) if line]
            tables.append((lines[0] if lines else [], lines[1:]))
        return tables


class HttpTransport:
    """GET <base>/<endpoint>?key=<key>, answered in JSON: {"resultSets": [{"headers": [...], "rowSet": [[...]]}]}. `parameter` names the key's parameter, `headers` are sent along."""

    def __init__(self, base: str, parameter: str = "GameID", headers: dict[str, str] | None = None) -> None:
        self.base, self.parameter, self.headers = base.rstrip("/"), parameter, headers or {}

    def fetch(self, endpoint: str, key: str, timeout: float) -> list[Table]:
        url = f"{self.base}/{urllib.parse.quote(endpoint)}?{urllib.parse.urlencode({self.parameter: key})}"
        with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=timeout) as answer:
            sets = json.load(answer)["resultSets"]
        return [(s["headers"], s["rowSet"]) for s in sets]


def fetched(transport: Any, endpoint: str, key: str, retries: int, timeout: float, pause: float, back_off: float) -> list[Table]:
    """The tables of one endpoint: up to `retries` tries, each failure followed by a longer wait, each success by a pause."""
    for k in range(retries):
        try:
            tables = transport.fetch(endpoint, key, timeout)
        except Exception as e:  # noqa: BLE001  no network, no answer, or one that makes no sense
            last = e
            if k + 1 < retries:
                time.sleep(back_off * (k + 1))
        else:
            time.sleep(pause)
            return tables
    raise RuntimeError(f"request {endpoint} of {key} failed: {last}")


def _text(cell: Any) -> str | None:
    """A cell as a CSV file would give it: nothing is null."""
    return None if cell is None or cell == "" else cell if isinstance(cell, str) else json.dumps(cell)


class _Key(InputPartition):
    def __init__(self, endpoint: str, key: str) -> None:
        self.endpoint, self.key = endpoint, key


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Key(endpoint, key) for key, endpoint in json.loads(self.options["keys"])]

    def read(self, partition: _Key) -> Iterator[tuple]:
        o = self.options
        module, name = o["transport"].split(":")
        transport = getattr(importlib.import_module(module), name)(**json.loads(o.get("arguments", "{}")))
        number = lambda name, default: float(o.get(name, default))
        tables = fetched(transport, partition.endpoint, partition.key, int(number("retries", RETRIES)), number("timeout", TIMEOUT), number("pause", PAUSE), number("back_off", BACK_OFF))
        for suffix, (names, rows) in enumerate(tables):
            for game, endpoint, at, nth, heads, cells in cell_rows(partition.key, partition.endpoint, suffix, names, ([_text(c) for c in row] for row in rows)):
                yield game, endpoint, at, nth, heads, None if cells is None else dict(cells)


class GameEndpoints(DataSource):
    """Format `game_endpoints`, rows as in `files.CELLS`. Options: keys, a JSON list of [key, endpoint]; transport, "module:class"; arguments, its JSON; retries, timeout, pause, back_off."""

    @classmethod
    def name(cls) -> str:
        return "game_endpoints"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


class Source:
    """Where endpoints come from: a transport with its arguments and manners."""

    def __init__(self, transport: str, arguments: dict[str, Any] | None = None, pause: float = PAUSE, back_off: float = BACK_OFF, timeout: float = TIMEOUT, probe_timeout: float = PROBE_TIMEOUT) -> None:
        self.transport, self.arguments, self.pause, self.back_off, self.timeout, self.probe_timeout = transport, arguments or {}, pause, back_off, timeout, probe_timeout

    def read(self, spark: SparkSession, keys: list[tuple[str, str]], retries: int = RETRIES, timeout: float | None = None) -> DataFrame:
        """The endpoints of (key, endpoint) pairs. Every action fetches them."""
        ship(spark).dataSource.register(GameEndpoints)
        options = {"keys": json.dumps(keys), "transport": self.transport, "arguments": json.dumps(self.arguments), "pause": self.pause, "back_off": self.back_off, "retries": retries, "timeout": timeout or self.timeout}
        return spark.read.format("game_endpoints").options(**options).load()


def landed(spark: SparkSession, path: str) -> DataFrame:
    """What the landing table holds, in the form of CELLS."""
    if not exists(spark, f"{path}/*/*.parquet"):
        return spark.createDataFrame([], CELLS)
    return spark.read.schema(CELLS).parquet(path)


def missing(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Those of (game_id, endpoint) without a landed table. An endpoint of empty tables has landed: its headers have."""
    have = landed(spark, path).where("ord = -1").select("game_id", "endpoint").distinct()
    return wanted.select("game_id", "endpoint").distinct().join(have, ["game_id", "endpoint"], "left_anti")


def _append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("endpoint").parquet(path)


def land(spark: SparkSession, path: str, wanted: DataFrame, source: Source, wave: int = WAVE, retries: int = RETRIES) -> int:
    """Fetches what is missing of `wanted` (game_id, endpoint) and appends it; returns the number of keys fetched.

    The first key is a probe: one try with a short limit, so that a source that does not answer fails at once and not
    after every key's retries. The rest comes in waves of `wave` keys, each one commit, so a crash repeats one wave.
    """
    first = F.when(F.col("endpoint") == ENDPOINTS[0], 0).otherwise(1)  # the first endpoint of a game is its probe
    todo = missing(spark, path, wanted).orderBy(first, "game_id", "endpoint")
    keys = [(r.game_id, r.endpoint) for r in todo.toLocalIterator()]
    if keys:
        try:
            _append(source.read(spark, keys[:1], 1, source.probe_timeout), path)
        except Exception as e:
            raise RuntimeError(f"the source did not answer: {e}") from e
    for at in range(1, len(keys), wave):
        _append(source.read(spark, keys[at : at + wave], retries), path)
    return len(keys)


def load_games(spark: SparkSession, path: str, games: list[str], source: Source, endpoints: tuple[str, ...] = ENDPOINTS) -> dict[tuple[str, int], DataFrame]:
    """Every table of some games, by (endpoint, suffix), landed first where it is missing."""
    wanted = spark.createDataFrame([(g, e) for g in games for e in endpoints], "game_id string, endpoint string")
    land(spark, path, wanted, source)
    return tables_of(landed(spark, path).where(F.col("game_id").isin(games)))


def tables_of(cells: DataFrame) -> dict[tuple[str, int], DataFrame]:
    """The tables that some game of `cells` has; plays come with their order."""
    found = cells.where("ord = -1").select("endpoint", "suffix").distinct().collect()
    return {(r.endpoint, r.suffix): table_of(cells, r.endpoint, r.suffix, r.endpoint == "playbyplay") for r in found}


def season_games(spark: SparkSession, path: str, season: str, source: Source, kind: str = "Playoffs") -> DataFrame:
    """(game_id, date, away, home, away_pts, home_pts, label, season): a season's games, from its landed list, fetched once with a single try."""
    key = f"{season} {kind}"
    land(spark, path, spark.createDataFrame([(key, FINDER)], "game_id string, endpoint string"), source)
    raw = table_of(landed(spark, path).where(F.col("game_id") == key), FINDER, 0, key="_key")
    games = games_of_rows(raw.withColumn("PTS", F.col("PTS").try_cast("double").cast("long")))
    return games.withColumn("season", F.lit(season))


def endpoint_profile(cells: DataFrame, seasons: DataFrame) -> DataFrame:
    """(season, endpoint, games, tables, n_rows, empty): how many tables and rows each season's games have of an endpoint; empty: no row at all. seasons: (game_id, season)."""
    counted = cells.join(seasons.select("game_id", "season"), "game_id").groupBy("season", "endpoint").agg(F.count_distinct("game_id").alias("games"), F.count_if(F.col("ord") == -1).alias("tables"), F.count_if(F.col("ord") >= 0).alias("n_rows"))
    return counted.withColumn("empty", F.col("n_rows") == 0)


def finals_cells(cells: DataFrame) -> DataFrame:
    """The bundles of Finals games, for the sample."""
    return cells.where(is_finals(F.col("game_id")))
