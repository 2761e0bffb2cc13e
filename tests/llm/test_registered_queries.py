"""Every registered query of the training-data operators on the smallest tables: against its SQL, or against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_text_operators import brute_groups, brute_print

from quillstat.llm import registry
from quillstat.llm.tool_calls import calls_of_turns

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall())


def rows(spark, name):
    got = registry.queries()[name](spark, DIR)
    return [r.asDict() for r in got.collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = rows(spark, name)
    want = duck.execute(registry.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    at = {c[0]: k for k, c in enumerate(want.description)}
    assert sorted(got[0]) == columns
    assert sorted(repr([r[c] for c in columns]) for r in got) == sorted(repr([r[at[c]] for c in columns]) for r in want.fetchall())


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, "op1_token_store")) == want


def test_op4(spark, texts):
    """The counts and the base score; the model's score is a probability that beats it."""
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in rows(spark, "op4_suffix_tree")}
    assert set(got) == set(texts)
    for i, ws in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    aside = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in aside) > sum(r["base_score"] for r in aside)


def test_op7(spark, duck):
    truth = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = rows(spark, "op7_language_id")
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    aside = [r for r in got if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in aside) >= 0.9 * len(aside) > 20


def test_op8(spark, texts):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in texts.items():
        ids = lib.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op8_byte_bpe")) == want


def test_op9(spark, texts):
    ids, prints = list(texts), [brute_print(t) for t in texts.values()]
    groups = brute_groups(prints).tolist()
    least = {}
    for i, g in zip(ids, groups, strict=True):
        least[g] = min(least.get(g, i), i)
    want = sorted((i, f"{p:016x}", least[g]) for i, p, g in zip(ids, prints, groups, strict=True))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(spark, "op9_simhash")) == want


def test_op13(spark, duck, texts):
    truth = dict(duck.execute("SELECT doc_id, toxic FROM labels").fetchall())
    got = rows(spark, "op13_toxicity")
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == 0 for r in got if truth.get(r["doc_id"]) == 0)


def test_calls_of_turns(spark):
    """Each user turn is a call, the next assistant turn its result, turn t - 2 its dependency."""
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d")], "conv_id long, turn long, role string, text string")
    calls, results = calls_of_turns(turns)[:2]
    assert calls.count() == 2 and results.count() == 2
