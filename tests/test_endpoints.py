"""The endpoint source, its landing table and what fails fast."""

from __future__ import annotations

import http.server
import json
import threading
from pathlib import Path

import pytest

from quillstat.sources import endpoints, files
from quillstat.sources.endpoints import Source, landed, load_games, missing, season_games


@pytest.fixture()
def store(tmp_path):
    """Two games with other columns and an empty table each, and a season's list."""
    for game, names in (("0042100401", "teamTricode,points"), ("0042100402", "points,teamTricode,extra")):
        g = tmp_path / "store" / game
        g.mkdir(parents=True)
        for e in files.ENDPOINTS:
            lines = {"teamTricode,points": ["BOS,20", "GSW,"], "points,teamTricode,extra": ["9,LAL,NA"]}[names]
            (g / f"{e}_0.csv").write_text("\n".join([names, *lines]) + "\n")
            (g / f"{e}_1.csv").write_text("a,b\n")
    g = tmp_path / "store" / "2021-22 Playoffs"
    g.mkdir()
    (g / "games_0.csv").write_text("GAME_ID,GAME_DATE,MATCHUP,TEAM_ABBREVIATION,PTS\n1,2022-06-02,BOS @ GSW,BOS,120\n1,2022-06-02,GSW vs. BOS,GSW,108\n2,2022-06-05,BOS @ GSW,BOS,88\n")
    journal = tmp_path / "journal"
    return Source("quillstat.sources.endpoints:FolderTransport", {"root": str(tmp_path / "store"), "journal": str(journal)}, pause=0.0, back_off=0.0), journal, str(tmp_path / "landing")


def calls(journal: Path):
    return sorted(json.loads(p.read_text()) for p in journal.glob("*")) if journal.exists() else []


def test_reads_through_and_never_twice(spark, store):
    source, journal, path = store
    tables = load_games(spark, path, ["0042100401"], source)
    assert set(tables) == {(e, k) for e in files.ENDPOINTS for k in (0, 1)}
    first = calls(journal)
    assert len(first) == 7 and sorted(e for e, _, _ in first) == sorted(files.ENDPOINTS)
    assert [t for e, _, t in first if e == "traditional"] == [source.probe_timeout]  # the probe
    got = {r.teamTricode: r.points for r in tables["misc", 0].collect()}
    assert got == {"BOS": "20", "GSW": None} and tables["misc", 1].columns == ["a", "b", "game_id"] and tables["misc", 1].count() == 0
    load_games(spark, path, ["0042100401"], source)
    assert calls(journal) == first
    both = load_games(spark, path, ["0042100401", "0042100402"], source)
    assert len(calls(journal)) == 14
    rows = {r.teamTricode: r for r in both["playbyplay", 0].collect()}
    assert both["playbyplay", 0].columns == ["points", "teamTricode", "extra", "game_id", "ord"]
    assert (rows["LAL"].points, rows["LAL"].extra, rows["BOS"].extra, rows["GSW"].ord) == ("9", "NA", None, 1)
    profile = {r.endpoint: r for r in endpoints.endpoint_profile(landed(spark, path), spark.createDataFrame([("0042100401", "2021-22"), ("0042100402", "2021-22")], "game_id string, season string")).collect()}
    assert (profile["misc"].games, profile["misc"].tables, profile["misc"].n_rows, profile["misc"].empty) == (2, 4, 3, False)


def test_unreachable_source_fails_after_one_probe(spark, store, tmp_path):
    source, journal, path = store
    with pytest.raises(RuntimeError, match="did not answer"):
        load_games(spark, path, ["0099999999"], source)
    assert calls(journal) == [["traditional", "0099999999", source.probe_timeout]]
    assert landed(spark, path).isEmpty()


def test_failed_wave_lands_nothing_and_is_resumed(spark, store):
    source, journal, path = store
    wanted = spark.createDataFrame([(g, e) for g in ("0042100401", "gone") for e in files.ENDPOINTS], "game_id string, endpoint string")
    with pytest.raises(Exception, match="failed"):
        endpoints.land(spark, path, wanted, source, wave=6, retries=2)
    left = {(r.game_id, r.endpoint) for r in missing(spark, path, wanted).collect()}
    whole = {(r.game_id, r.endpoint) for r in landed(spark, path).where("ord = -1").select("game_id", "endpoint").distinct().collect()}
    assert ("gone", "traditional") in left and ("0042100401", "traditional") in whole
    assert left | whole == {(g, e) for g in ("0042100401", "gone") for e in files.ENDPOINTS} and not left & whole
    before = len(calls(journal))
    again = wanted.where("game_id <> 'gone'")
    assert endpoints.land(spark, path, again, source) == len([k for k in left if k[0] != "gone"])
    assert len(calls(journal)) - before == len([k for k in left if k[0] != "gone"])
    rows = landed(spark, path)
    assert rows.count() == rows.dropDuplicates(["game_id", "endpoint", "suffix", "ord"]).count() == 7 * (3 + 1)


class Flaky:
    def __init__(self, failures):
        self.left = failures

    def fetch(self, endpoint, key, timeout):
        self.left -= 1
        if self.left >= 0:
            raise OSError("busy")
        return [(["a"], [["1"]])]


def test_retries_back_off_in_steps(monkeypatch):
    waits = []
    monkeypatch.setattr(endpoints.time, "sleep", waits.append)
    assert endpoints.fetched(Flaky(2), "misc", "1", 3, 1.0, 0.8, 2.0) == [(["a"], [["1"]])]
    assert waits == [2.0, 4.0, 0.8]
    with pytest.raises(RuntimeError, match="misc of 1 failed: busy"):
        endpoints.fetched(Flaky(3), "misc", "1", 3, 1.0, 0.8, 2.0)


def test_season_list_is_cached(spark, store):
    source, journal, path = store
    for _ in range(2):
        games = season_games(spark, path, "2021-22", source)
        assert [tuple(r) for r in games.collect()] == [("1", "2022-06-02", "BOS", "GSW", 120, 108, "2022-06-02  BOS 120 @ GSW 108", "2021-22")]
    assert len(calls(journal)) == 1


def test_http_transport(spark, tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps({"resultSets": [{"headers": ["teamTricode", "points"], "rowSet": [["BOS", 20], ["GSW", None], [self.path.split("=")[1], 1.5]]}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        source = Source("quillstat.sources.endpoints:HttpTransport", {"base": f"http://127.0.0.1:{server.server_port}/stats"}, pause=0.0)
        table = load_games(spark, f"{tmp_path}/l", ["0042100401"], source, ("summary",))["summary", 0]
        assert sorted((r.teamTricode, r.points) for r in table.collect()) == [("0042100401", "1.5"), ("BOS", "20"), ("GSW", None)]
    finally:
        server.shutdown()
