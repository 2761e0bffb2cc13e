"""Event-time state against the batch operators, for any arrival order inside the watermark."""

from __future__ import annotations

import os
import random
from pathlib import Path

import pytest

from quillstat.operators import possession
from quillstat.streaming import states

HOLDERS = "shot long, frame long, pid string, team string"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    states.use_state_store(spark)
    yield spark
    spark.conf.set(key, before)


def batches(spark, path, rows, schema, size, seed, shuffled=40):
    """Files in the order of arrival: each row comes at most `shuffled` places from its own."""
    r = random.Random(seed)
    rows = [row for _, row in sorted((k + r.uniform(0, shuffled), row) for k, row in enumerate(rows))]
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:06d}")
    for k, part in enumerate(sorted(Path(path).rglob("*.parquet"), key=lambda p: p.parent.name)):  # files are read by their times
        os.utime(part, (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}")


def drained(stream, name, path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


@pytest.mark.parametrize("seed", [1, 2])
def test_states_equal_batch(rocks, tmp_path, seed):
    """Holders that change, gaps of all lengths, three shots one after the other; the last is closed by a later clip."""
    r, rows, frame = random.Random(seed), [], 0
    for shot in range(3):
        for _ in range(25):
            pid = r.choice("abc")
            for _ in range(r.choice([1, 4, 5, 9])):
                frame += r.choice([1, 1, 1, 2, 4, 5])
                rows.append((shot, frame, f"p{pid}", "light" if pid == "a" else "dark"))
        frame += 30
    stream = batches(rocks, f"{tmp_path}/in", [*rows, (99, frame + 10_000, "z", "dark"), (99, frame + 20_000, "z", "dark")], HOLDERS, 90, seed)
    got = drained(states.streaming_states(stream, "10 seconds", frame_ms=33), f"states{seed}", f"{tmp_path}/cp")
    want = possession.holder_states(rocks.createDataFrame(rows, HOLDERS))
    order = lambda df: sorted(tuple(x) for x in df.select("shot", "pid", "team", "start", "end", "n").collect())
    assert order(got) == order(want) and got.count() > 15


def test_open_run_outlives_a_restart(rocks, tmp_path):
    """The state of a stopped query is taken up again; the run closes when another shot passes the last frame that could go on with it."""
    rows = [(1, f, "a", "light") for f in range(10)] + [(2, 12, "b", "dark")]
    batches(rocks, f"{tmp_path}/in", rows, HOLDERS, 100, 0, 0)

    def drain():
        stream = rocks.readStream.schema(HOLDERS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = states.streaming_states(stream, "0 seconds", frame_ms=100)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for r in rocks.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()]

    assert drain() == []
    rocks.createDataFrame([(2, 15, "b", "dark")], HOLDERS).coalesce(1).write.parquet(f"{tmp_path}/in/zz")
    assert drain() == [(1, "a", "light", 0, 9, 10)]


def test_counts_equal_batch(rocks, tmp_path):
    r = random.Random(7)
    frames = [(1, f, r.choice(["light", "dark", None])) for f in range(300)]
    events = [(1, f, r.choice(["light", "dark", "other"]), r.choice(["pass", "interception"])) for f in range(0, 330, 3) for _ in range(r.choice([0, 1, 2]))]
    one = "clip long, frame long, team string"
    rocks.createDataFrame([(2, 100_000, None), (2, 200_000, None)], one).coalesce(1).write.parquet(f"{tmp_path}/f/zz")  # the last file
    a = batches(rocks, f"{tmp_path}/f", frames, one, 80, 1)
    b = batches(rocks, f"{tmp_path}/e", events, f"{one}, type string", 60, 2)
    got = drained(states.streaming_counts(a, b, "30 seconds"), "counts", f"{tmp_path}/cp").where("clip = 1")
    want = possession.cumulative_counts(rocks.createDataFrame(events, f"{one}, type string"), rocks.createDataFrame(frames, one))
    assert sorted(tuple(x) for x in got.collect()) == sorted(tuple(x) for x in want.select(got.columns).collect()) and got.count() == 300
