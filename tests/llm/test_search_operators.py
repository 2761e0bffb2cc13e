"""Decontamination, top-k, suffix tree, tool calls, PII and language ID against brute force."""

from __future__ import annotations

import itertools
import json
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from util import LONG, ROWS, documents, empty, prose

from quillstat.llm import decontaminate, language_id, pii, suffix_tree, tool_calls, topk
from quillstat.llm.common import Scratch


def test_masks_hit_every_pattern():
    """Whatever fifth of 8 to 20 tokens is substituted, some mask stands clear of it."""
    assert all(m != tuple(range(len(m))) for m in decontaminate.MASKS)
    for n in range(decontaminate.EXACT, decontaminate.WINDOW + 1):
        for bad in itertools.combinations(range(n), n // 5):
            assert any(not any(p + o in bad for o in m) for m in decontaminate.MASKS for p in range(n - m[-1])), (n, bad)


def brute_leaks(rows, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    best = {}
    for i, t, *_ in rows:
        w = words(t)
        for j, b in items:
            v = words(b)
            c = min(len(v), 20)
            if len(v) < 3:
                continue
            free = c // 5 if c >= 8 else 0
            for diag in range(-len(v), len(w)):
                same = [w[q + diag] == v[q] for q in range(len(v)) if 0 <= q + diag < len(w)]
                for k in range(len(same) - c + 1):
                    m = sum(same[k : k + c])
                    if m >= c - free:
                        best[i, j] = max(best.get((i, j), 0), m)
    return best


@pytest.mark.parametrize("part,few", [(500_000, 250_000), (40, 0)])
def test_leaks_equal_brute_force(spark, part, few):
    r = random.Random(2)
    items = [(k, prose(100 + k, n)) for k, n in enumerate((30, 25, 20, 15, 9, 8, 7))] + [(7, None), (8, ""), (9, prose(100, 30)), (10, "alphas omegas zeta"), (11, "one"), (12, prose(106, 4)), (13, prose(107, 5))]
    rows = []
    for i in range(40):
        w = prose(200 + i, 40).split()
        k = i % 7
        leak = items[k][1].split()
        for _ in range(i % 8):
            leak[r.randrange(len(leak))] = "substitute"
        at = r.randrange(40)
        rows.append((i, " ".join([*w[:at], *leak[r.randrange(3) :], *w[at:]]).upper(), "en"))
    rows += [(60 + k, f"{prose(300, 9)} {items[k][1]} {prose(301, 9)}", "en") for k in (10, 11, 12, 13)] + [(70, "alphas other zeta one", "en")]
    rows += [(50, items[0][1], None), (50, items[0][1], None), (None, items[1][1], None), (51, None, None), (52, "", None)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "wh": F.lit(2)})
    got = {(x.doc_id, x.item_id): x.matched for x in decontaminate.find_leaks(documents(spark, rows), bench, part=part, few=few).collect()}
    assert got == brute_leaks(rows, items) and len(got) > 15
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(documents(spark), bench.where("false")).count() == 0


def test_leaks_of_an_item_without_id(spark):
    text = prose(100, 30)
    bench = spark.createDataFrame([(None, text), (1, prose(101, 30))], "item_id long, text string")
    got = [tuple(r) for r in decontaminate.find_leaks(documents(spark, [(1, text, "en"), (2, prose(102, 30), "en")]), bench).collect()]
    assert got == [(1, None, 20, 20)]


def brute_top(vectors, k=5):
    out = []
    for i, (q, a) in enumerate(vectors):
        if q is not None and q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c is None, c or 0) for j, (c, b) in enumerate(vectors) if j != i and len(b) == len(a))
            out += [(q, n + 1, None if no_id else c, -s) for n, (s, no_id, c) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(0, 0.2, 16).round(2).tolist()) for i in range(160)]
    data += [(i, data[3][1]) for i in range(200, 230)]  # ties
    data += [(250, [0.5] * 7), (251, [0.25] * 7)]
    data += [(None, [1.0] * 16), (None, [1.0] * 16), (5, data[5][1]), (5, data[7][1]), (50, data[9][1]), (50, data[50][1])]  # ids that are null or repeated
    odd = [(300, None), (350, []), (301, [None, *[1.0] * 15]), (302, [float("nan")] * 16), (303, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v) for i, v in data + odd], "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("score", "dim", "g", "bound", "key", "keys", "id")})
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data]
    got = sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()), key=repr)
    assert got == brute_top(ints)
    small = topk.QUERY_ROWS, topk.VECTOR_ROWS, topk.QUERY_BLOCKS, topk.VECTOR_BLOCKS, topk.CELLS
    topk.QUERY_ROWS, topk.VECTOR_ROWS, topk.QUERY_BLOCKS, topk.VECTOR_BLOCKS, topk.CELLS = 2, 7, 1, 2, 3  # many cells
    assert sorted((tuple(r) for r in topk.top_k(df.repartition(3), F.col("vec_id") % 50 == 0).collect()), key=repr) == got
    topk.QUERY_ROWS, topk.VECTOR_ROWS, topk.QUERY_BLOCKS, topk.VECTOR_BLOCKS, topk.CELLS = small
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_large_numbers(spark):
    data = [(0, [5e6, -5e6, 3.0]), (1, [5e6, 5e6, 1.0]), (2, [5e6, -5e6, 1.0]), (3, [0.0, 0.0, 5e6])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in data]
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()) == [r for r in brute_top(ints) if r[0] == 0]


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def test_scores(spark):
    rows = [(i, prose(i, 300) + (f" rare{i}" if i % 3 else " the same old line again") * 3, "en") for i in range(120)] + [(1000 + r[0], *r[1:]) for r in ROWS if r[0] is not None]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows}
    from quillstat.llm.common import bucket_of_id

    got = suffix_tree.score(documents(spark, rows), bucket_of_id("doc_id", 10) != 0).collect()
    c = Counter(w for i, t, _ in rows if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    want = sorted((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n) for i, t, _ in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    texts = {i: t for i, t, _ in rows}
    for r in got:
        assert r.base_score == pytest.approx(base(texts[r.doc_id]), rel=1e-9)
    out = [r for r in got if held[r.doc_id]]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    none = suffix_tree.score(documents(spark), F.lit(False)).collect()
    assert len(none) == len(ROWS) and all(r.n_known == 0 and r.score == 0 for r in none)
    assert suffix_tree.score(empty(spark), F.lit(True)).count() == 0


def test_states_sum_to_one(spark):
    """Each state's probabilities over all words and the unknown one, of every depth, made up from the tables."""
    rows = [(k, prose(k % 5, 60 + k % 7), "en") for k in range(300)]
    tree = suffix_tree.grow(documents(spark, rows), Scratch(spark, "test"))
    words = {r.h: r.n for r in tree.words.collect() if r.h != suffix_tree._signed(suffix_tree.START_HASH)}
    left = [{r.ctx: r.left for r in s.collect()} for s in tree.states]
    grams = [{r.h: r for r in s.collect()} for s in tree.rows]
    follow = [{} for _ in grams]
    for f, table in zip(follow, grams, strict=True):
        for r in table.values():
            f.setdefault(r.ctx, {})[r.suf] = 10**r.more if r.more is not None else 1.0
    starts = [{h: (r.ctx, r.suf) for h, r in g.items()} for g in grams]

    by_pair = [{pair: h for h, pair in s.items()} for s in starts]
    seen = [0, 0, 0]
    for d in range(1, 4):
        for ctx in list(left[d - 1])[:12]:
            history, at = [ctx], ctx
            for k in range(d - 2, -1, -1):  # a context without its first token is the suffix of the gram it is
                at = grams[k][at].suf
                history.insert(0, at)
            total = 0.0
            for w in [None, *words]:
                p, gram = (words[w] - suffix_tree.DISCOUNT) / tree.n if w is not None else tree.unknown, w
                for k in range(d):
                    p *= left[k].get(history[k], 1.0)
                    if gram is not None:
                        p *= follow[k].get(history[k], {}).get(gram, 1.0)
                        gram = by_pair[k].get((history[k], gram))
                total += p
            assert abs(total - 1) < 1e-9
            seen[d - 1] += 1
    assert min(seen) > 0


def brute_scores(train, texts, depth):
    """The suffix tree's log10 scores by dictionaries of whole word tuples."""
    seqs = [["^", *tokens(t)] for t in train]
    c = Counter(tuple(s[i : i + k]) for s in seqs for k in range(1, depth + 2) for i in range(len(s) - k + 1))
    n = sum(x for g, x in c.items() if len(g) == 1) - c["^",]
    v = sum(len(g) == 1 for g in c) - 1
    after, states = {}, {}
    for g, x in c.items():
        if len(g) > 1 and x >= 3:
            after.setdefault(g[:-1], {})[g[-1]] = x

    def p(w, context):
        if not context:
            return (c[w,] - 0.5) / n if c[w,] else 0.5 * v / n
        parent = p(w, context[1:])
        if context not in states:
            return parent
        row = after[context].get(w)
        return states[context] * parent + ((row - 0.5) / c[context] if row else 0.0)

    for context in sorted(after, key=len):
        total, rows = c[context], after[context]
        left = max(1 - sum(x - 0.5 for x in rows.values()) / total, 1e-12)
        gain = (total - sum(rows.values())) * math.log(left)
        for w, x in rows.items():
            q = p(w, context[1:])
            gain += x * math.log((x - 1.5 + left * total * q) / (total - 1) / q)
        if gain >= 30:
            states[context] = left
    out = []
    for t in texts:
        s = ["^", *tokens(t)]
        out.append(sum(math.log10(p(s[i], tuple(s[max(0, i - depth) : i]))) for i in range(1, len(s))))
    return out, states


@pytest.mark.parametrize("cached", [suffix_tree.CACHED, 1.0])
def test_scores_equal_brute_force(spark, cached):
    """Contexts, rows and words far under one in 10,000 tokens, of up to three tokens, count as others do."""
    rows = [(i, prose(i, 900), "en") for i in range(300)]
    rows += [(1000 + i, f"marker alpha {prose(3000 + i, 8)}", "en") for i in range(20)]
    rows += [(4000 + i, f"{prose(4000 + i, 8)} alpha seldom met beta {prose(5000 + i, 8)} left seldom met gamma", "en") for i in range(70)]
    rows += [(i, None, "en") for i in (5000, 5001, 5002)]
    texts = [t for _, t, _ in rows] + ["marker alpha", "unknown seldom met beta"]
    want, states = brute_scores([t for _, t, _ in rows], texts, suffix_tree.DEPTH)
    assert (b"marker",) in states and (b"left", b"seldom", b"met") in states and ("^",) in states
    rows += [(9000 + k, t, "en") for k, t in enumerate(texts[-2:])]
    got = {r.doc_id: r.score for r in suffix_tree.score(documents(spark, rows), F.col("doc_id") < 9000, cached=cached).collect()}
    for (i, _, _), w in zip(rows, want, strict=True):
        assert got[i] == pytest.approx(w, rel=1e-6), i


def test_tool_calls(spark):
    call = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
    calls = [(1, "a", 0, "add", '{"y": 2, "x": 1}', None), (1, "b", 1, "add", '{"x": "1"}', ["a"]), (1, "c", 2, "add", "not json", ["a", "b", "zz"]), (1, "d", 3, "nope", "[1]", ["c"]), (1, "e", 4, "add", "{}", ["f"]), (1, "f", 5, "add", "{}", ["e"]), (1, "g", 6, "add", "{}", ["f", "a"]),
             (1, "a", 9, "add", '{"x": 9}', None), (2, None, 0, "add", '{"x": 1}', ["a"]), (3, "a", 0, "add", '{"x": 1, "q": null}', ["b"]), (3, "b", 1, "add", '{"x":1}', [])]
    calls += [(4, f"k{i}", i, "add", '{"x":1}', [f"k{i - 1}"] if i else None) for i in range(70)]
    results = [(1, "a", 1, "three"), (1, "a", 2, "four"), (1, "zz", 1, "orphan"), (2, None, 1, "x"), (3, "a", 4, None)]
    schemas = {"add": {"required": ["x"], "properties": {"x": {"type": "integer"}, "y": {"type": "integer"}}, "additionalProperties": False}}
    random.Random(0).shuffle(calls)
    c = spark.createDataFrame(calls, call).withColumn("level", F.lit(5))
    got = tool_calls.link_calls(c, spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), schemas).collect()
    by = {(r.conv_id, r.call_id): r for r in got}
    assert len(got) == 8 + 2 + 70 + 2
    assert by[1, "zz"].json == '{"id":"zz","result":"orphan"}' and not by[1, "zz"].linked and by[1, "zz"].level is None and by[1, "zz"].errors
    assert by[1, "a"].n_repeats == 2 and by[1, "b"].n_repeats == 0
    got = [r for r in got if r.errors != "$: result without a call"]
    by = {(r.conv_id, r.call_id): r for r in got}
    level = {k: r.level for k, r in by.items()}
    assert [level[1, x] for x in "abcdefg"] == [0, 1, 2, 3, None, None, None] and level[3, "a"] == 1
    assert [level[4, f"k{i}"] for i in range(70)] == list(range(70))
    assert by[1, "c"].n_missing == 1 and by[1, "a"].linked and not by[1, "b"].linked and by[3, "a"].linked
    assert by[1, "a"].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"three"}' and by[1, "a"].errors == ""
    assert by[1, "b"].errors == "$.x: not of type integer" and by[1, "c"].errors == "$: not JSON" and by[1, "d"].errors == "$: unknown tool"
    assert by[3, "a"].errors == "$.q: unknown" and json.loads(by[1, "c"].json)["arguments"] == "not json"
    assert by[2, None].level == 0 and not by[2, None].linked
    none = spark.createDataFrame([], call)
    assert tool_calls.link_calls(none, spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), schemas).count() == 0


def test_hostile_arguments(spark):
    schemas = {"f": {"properties": {"x": {"type": ["integer", "null"], "minimum": 0}, "s": {"type": "string", "minLength": 2, "maxLength": 3}}}}
    args = ['{"x":"\\ud800"}', "[" * 100_000, '{"x":NaN}', '{"x":-Infinity}', '{"x":1e999}', '{"x":null,"s":"ab"}', '{"x":-1}', '{"s":"abcd"}', '{"x":' + "9" * 5000 + "}", '{"y":' * 990 + "1" + "}" * 990, "", None]
    rows = [(1, f"c{k}", k, "f", a, None) for k, a in enumerate(args)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    none = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = [r for _, r in sorted((r.turn, r) for r in tool_calls.link_calls(calls, none, schemas).collect())]
    assert [r.errors for r in got[:8]] == ["$.x: not of type integer or null", "$: nested too deep", "$: not JSON", "$: not JSON", "$: not JSON", "", "$.x: out of range", "$.s: length out of range"]
    assert all(r.errors for r in got[8:9] + got[10:]) and json.loads(got[0].json)["arguments"] == {"x": "\ud800"} and all(json.loads(r.json) for r in got)
    with pytest.raises(ValueError, match="unknown type"):
        tool_calls.link_calls(calls, none, {"f": {"properties": {"x": {"type": "text"}}}})


def test_levels_of_calls_with_several_dependencies(spark):
    r, calls = random.Random(8), []
    for conv in range(6):
        for i in range(40):
            calls.append((conv, f"c{i}", i, "f", "{}", [f"c{j}" for j in {r.randrange(i) for _ in range(r.randrange(4))}] if i else None))
    want = {}
    for conv, c, _, _, _, deps in calls:
        want[conv, c] = 1 + max((want[conv, d] for d in deps or ()), default=-1)
    r.shuffle(calls)
    rows = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    got = {(x.conv_id, x.call_id): x.level for x in tool_calls.levels(rows, Scratch(spark, "test")).collect()}
    assert got == want and max(want.values()) > 8


@pytest.mark.parametrize("group", [tool_calls.GROUP, 0])
def test_levels_do_not_depend_on_the_way(spark, group):
    """Two parents each, 12 levels, and a call behind a cycle: settled by conversation and round by round."""
    calls = [(1, f"c{i}", [f"c{i - 1}", f"c{i - 2}"] if i > 1 else None) for i in range(14)] + [(1, "x", ["y", "c3"]), (1, "y", ["x", "c3"]), (1, "z", ["x", "c13"]), (None, "n", ["m"])]
    rows = spark.createDataFrame(calls, "conv_id long, call_id string, depends_on array<string>")
    got = {x.call_id: x.level for x in tool_calls.levels(rows, Scratch(spark, "test"), group).collect()}
    assert {c: v for c, v in got.items() if c[0] == "c"} == {f"c{i}": max(i - 1, 0) for i in range(14)}
    assert got["x"] is None and got["y"] is None and got["z"] is None


def test_deep_chain_of_two_parents_takes_no_round_a_level(spark):
    calls = [(1, f"c{i}", [f"c{i - 1}", f"c{i - 2}"] if i > 1 else None) for i in range(300)]
    rows = spark.createDataFrame(calls, "conv_id long, call_id string, depends_on array<string>")
    written, scratch = [], Scratch(spark, "test")
    scratch.write = lambda df, name, write=scratch.write: written.append(name) or write(df, name)
    assert {x.call_id: x.level for x in tool_calls.levels(rows, scratch).collect()}["c299"] == 298
    assert len(written) < 12


def test_json_values_are_compared_as_json(spark):
    check = tool_calls.schema_errors
    assert check(True, {"enum": [1]}) and check(1, {"enum": [True]}) and not check(1.0, {"enum": [1]}) and not check({"a": [1, True]}, {"enum": [{"a": [1.0, True]}]})
    assert not check(1.0, {"type": "integer"}) and check(1.5, {"type": "integer"}) and check(True, {"type": "integer"}) and check(True, {"type": "number"}) and not check(False, {"type": "boolean"})


def brute_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(x) for x in reversed(digits(s))]
        return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0

    def mod97(s):
        s = s.replace(" ", "")
        return 15 <= len(s) <= 34 and int("".join(str(int(ch, 36)) for ch in s[4:] + s[:4])) % 97 == 1

    ok = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": luhn, "phone": lambda s: 9 <= len(digits(s)) <= 15, "iban": mod97}
    t, out = t or "", []
    for k in pii.KINDS:
        found = list(re.finditer(pii.PLAIN[k], t, re.ASCII))
        ends, starts = [0, *(m.end() for m in found)], [*(m.start() for m in found), len(t)]
        for i, m in enumerate(found):
            around = t[ends[i] : m.start()][-40:] + "\n" + t[m.end() : starts[i + 1]][:40]
            n = {c: n for n, codes in pii.IBAN_LENGTHS.items() for c in codes.split()}.get(m[0][:2])
            strong = k != "iban" or n == len(m[0].replace(" ", ""))
            if ok[k](m[0]) and (strong or re.search(pii.CONTEXT[k], around.lower())):
                out.append((k, m.start(), m.end()))
    return out


def test_pii_equals_plain_patterns(spark):
    r = random.Random(4)
    parts = ["a.b@c.de", "x_y%+@foo-bar.co.uk", "@", "a@b", ".", "..", "1.2.3.4", "300.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "5500 0000 0000 0004", "+1 (415) 555-2671", "+12", "+49 30 1234567-", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82WEST12345698765433", "BE68 5390 0754 7034 EUR", "ES91 2100 0418 4502 0005 1332", "ZZ26 0000 0000 0000 0000", "BE68 5390 0754 7034CARD", "iban ", "konto", " ", "  ", "-", "7", "é", "日本", "_", "card", "\n", "call", "0" * 25]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(1500)]
    texts += [None, "", "a" * 60_000, "1" * 60_000, "1 " * 30_000, "1." * 30_000, "+1" + "-" * 60_000, "a.b@c.de " * 300, "A1" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(0))
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.spans] for x in pii.find_pii(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_pii(t), repr((t or "")[:80])
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_context(spark):
    df = spark.createDataFrame([(0, "pay by visa card 4111111111111111 now"), (1, "number 4111111111111111")], "doc_id long, text string")
    got = {r.doc_id: r.spans[0].score for r in pii.find_pii(df).collect()}
    assert got == pytest.approx({0: 0.9, 1: 0.6})


def test_weak_ibans_need_context(spark):
    code = next(f"ZZ{k:02d}{'0' * 16}" for k in range(100) if int("".join(str(int(ch, 36)) for ch in "0" * 16 + f"ZZ{k:02d}")) % 97 == 1)
    texts = [f"the number {code} stands here", f"by bank to {code}", "BE68 5390 0754 7034 CARD", "AT61 1904 3002 3457 3201 BKAUATWW"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end, round(s.score, 1)) for s in r.spans if s.kind == "iban"] for r in pii.find_pii(df).collect()}
    assert got == {0: [], 1: [(11, 31, 0.7)], 2: [(0, 19, 0.6)], 3: [(0, 24, 0.6)]}


def test_language_id(spark):
    alphabets = {"aa": "abcde fgh", "bb": "klmno pqr", "cc": "stuvw xyz"}
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(alphabets[lang]) for _ in range(200)), lang) for i, lang in ((k, list(alphabets)[k % 3]) for k in range(240))]
    docs = documents(spark, [*rows, (900, "12 34 !?", "aa"), (901, None, "aa"), (902, "", None), (903, "abc " * 400_000, "aa")])
    learn = ~language_id.held_out()
    model = language_id.train(docs, learn)
    got = {r.doc_id: r for r in language_id.predict(docs, model).withColumn("held", language_id.held_out()).collect()}
    held = [got[i] for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == "aa"
    again = language_id.train(docs.repartition(7), learn)
    assert (again.weights == model.weights).all() and again.temperature == model.temperature
    few = language_id.train(docs, learn, sample=60)
    assert few.langs == model.langs
    # Rows that all share one id, and a language with 1 in 300 of them.
    same = documents(spark, [(7, t, lang) for _, t, lang in rows] + [(7, "0123 zzzz 9876", "rare")])
    assert language_id.train(same, F.lit(True), sample=80).langs == ["aa", "bb", "cc", "rare"]
    # Rows that share id and text, over a third of all: they count up to their language's part, and nothing else is displaced.
    copied = documents(spark, rows + [(7, "abcde fgh", "aa")] * 200)
    assert language_id.train(copied, F.lit(True), sample=80).langs == ["aa", "bb", "cc"]
    none = language_id.train(empty(spark), learn)
    assert language_id.predict(docs, none).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(empty(spark), model).count() == 0
    assert language_id.predict(documents(spark), model).count() == len(ROWS) and LONG


def brute_ftrl(rows, n_langs, epochs):
    """FTRL-proximal, one coordinate at a time."""
    a, b, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    z, n = Counter(), Counter()

    def weight(f, y):
        x = z[f, y]
        return 0.0 if abs(x) <= l1 else (math.copysign(l1, x) - x) / ((b + math.sqrt(n[f, y])) / a + l2)

    order = np.random.default_rng(42)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x, truth = rows[k]
            w = {(f, y): weight(f, y) for f in x for y in range(n_langs)}
            logits = [sum(v * w[f, y] for f, v in x.items()) for y in range(n_langs)]
            e = [math.exp(v - max(logits)) for v in logits]
            for f, v in x.items():
                for y in range(n_langs):
                    g = v * (e[y] / sum(e) - (y == truth))
                    z[f, y] += g - (math.sqrt(n[f, y] + g * g) - math.sqrt(n[f, y])) / a * w[f, y]
                    n[f, y] += g * g
    return {key: weight(*key) for key in z}


@pytest.mark.parametrize("sample", [language_id.SAMPLE, 45])
def test_language_model_equals_brute_force(spark, sample):
    """TF-IDF, FTRL and temperature by dictionaries of features, over all rows and over a sample of them; the hashed buckets are the only thing shared."""
    alphabets = {"aa": "abcdeλμν ", "bb": "abcfgλξπ ", "cc": "abhij語文 "}
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice(alphabets[lang]) for _ in range(40)), lang) for i, lang in ((k, list(alphabets)[k % 3]) for k in range(90))]
    model = language_id.train(documents(spark, rows), F.lit(True), sample=sample)

    def grams(t):
        t = re.sub(r"\s+", " ", f" {t.lower()} ")
        found = Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))
        out = Counter()
        for g, c in found.items():
            h = 0
            for ch in g:
                h = (h * 0x01000193 + ord(ch) + 1) % 2**32
            h = (h ^ (h >> 15)) * language_id._MIX[len(g) - 1] % 2**32
            out[h >> (32 - language_id.BUCKETS.bit_length() + 1)] += c
        return out

    every = {i: grams(t) for i, t, _ in rows}
    df = Counter(f for g in every.values() for f in g)
    idf = {f: math.log((1 + len(rows)) / (1 + c)) + 1 for f, c in df.items()}

    def vector(g):
        v = {f: math.sqrt(c) * idf[f] for f, c in g.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / size for f, x in v.items()} | {"bias": 1.0}

    order = {r.doc_id: r.h for r in documents(spark, rows).select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    ranked = sorted(rows, key=lambda r: order[r[0]])
    if sample < len(rows):  # a language's lowest hashes, 15 of 30, within the share of hash space that should hold 18
        limit = int(-(2**63) + 2**64 * 0.6)
        ranked = [r for lang in alphabets for r in [x for x in ranked if x[2] == lang and order[x[0]] <= limit][:15]]
        ranked.sort(key=lambda r: order[r[0]])
        assert 40 <= len(ranked) <= 45
    data = [(vector(every[i]), list(alphabets).index(lang)) for i, _, lang in ranked]
    aside, used = data[::5], [x for k, x in enumerate(data) if k % 5]
    w = brute_ftrl(used, 3, language_id.EPOCHS)
    for (f, y), x in w.items():
        assert (model.bias[y] if f == "bias" else model.weights[f, y]) == pytest.approx(x, abs=1e-9)
    logits = [[sum(v * w.get((f, y), 0.0) for f, v in x.items()) for y in range(3)] for x, _ in aside]
    loss = lambda t: sum(math.log(sum(math.exp(v / t) for v in row)) - row[y] / t for row, (_, y) in zip(logits, aside, strict=True))
    assert model.temperature == pytest.approx(min(np.geomspace(0.05, 20.0, 121), key=loss))


def test_words_hashed_together_equal_the_library():
    import xxhash

    r = random.Random(3)
    texts = ["", " \t\n", " b ", " ".join("q" * k for k in range(1, 45)), *("".join(r.choice("abcÉé \n\t\x0b\x1c\xa0\x85Σ\x00Z") for _ in range(r.randrange(120))) for _ in range(300))]
    h, length = suffix_tree._hashes(texts)
    want = [[suffix_tree.START_HASH, *map(xxhash.xxh64_intdigest, suffix_tree.words_of(t))] for t in texts]
    assert h.tolist() == [x for w in want for x in w] and length.tolist() == list(map(len, want))
    assert suffix_tree._hashes([""])[1].tolist() == [2]


def test_windows_leave_a_task_by_small_batches():
    """A window's blocks are never held whole as Arrow, and are cut between buckets."""
    import pyarrow as pa

    texts = pa.record_batch([pa.array([f"{prose(k, 400)} w{k} " + " ".join(f"{k}x{j}" for j in range(3000)) for k in range(200)])], ["t"])
    batches = list(suffix_tree._count_blocks(None, 1, 10)([texts]))
    entries = [sum(len(x.as_py()) // 4 for x in b.column(3)) for b in batches]
    assert len(batches) > 3 and max(entries) < 1.1 * suffix_tree.PACKED
    buckets = [p for b in batches for p in b.column(0).to_pylist()]
    assert buckets == sorted(set(buckets))
    count = Counter(w for t in texts.column(0).to_pylist() for w in tokens(t))
    assert sum(entries) == len(count) + 1
