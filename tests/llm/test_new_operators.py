"""Vector codes, Merkle manifest and toxicity against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from util import documents, empty, prose

from quillstat.llm import merkle, toxicity, vector_codes
from quillstat.llm.common import Scratch

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_codes(rows):
    kept = sorted(((i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows), key=lambda r: (r[0] is None, r[0], r[1]))
    parts = [[tuple(v[p * len(v) // 8 : (p + 1) * len(v) // 8]) for p in range(8)] for _, v, _ in kept]
    books = [[x[p] for x in parts[:16]] for p in range(8)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        for p in range(8):
            of = [near(p, x[p])[1] for x in parts]
            for k in range(len(books[p])):
                mine = [x[p] for x, o in zip(parts, of, strict=True) if o == k]
                if mine:
                    books[p][k] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
        # all books change together: assignments of a part do not depend on the others
    out = [[near(p, x[p]) for p in range(8)] for x in parts]
    total = {}
    for (_, _, lab), o in zip(kept, out, strict=True):
        total[lab] = total.get(lab, 0) + sum(d for d, _ in o)
    digest = hashlib.sha256(",".join(str(c) for p in range(8) for e in books[p] for c in e).encode()).hexdigest()
    return sorted((repr(i), "".join(f"{k:02x}" for _, k in o), sum(d for d, _ in o), total[lab], digest) for (i, _, lab), o in zip(kept, out, strict=True))


@pytest.mark.parametrize("n,dim,spread", [(300, 16, 4.0), (60, 8, 0.001), (7, 24, 1.0), (120, 16, 4000.0)])
def test_codes_equal_brute_force(spark, n, dim, spread):
    """Ties (few distinct values), repeated rows and ids, fewer vectors than entries, components at the limit."""
    r = random.Random(n)
    rows = [(i // 2 if i % 9 else None, [r.choice([r.uniform(-spread, spread), 0.0, spread]) for _ in range(dim)], r.choice([None, 1, 2])) for i in range(n)]
    rows += [rows[0], rows[1]]
    odd = [(-5, None, 1), (-4, [], 1), (-3, [1.0] * (dim - 1) + [None], 1), (-2, [float("nan")] * dim, 1), (-1, [float("inf")] * dim, 1), (-6, [5000.0] * dim, 1), (-7, [1.0] * (dim + 1), 1), (9999, [1.0] * (dim + 8), 1)]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumns({c: F.lit(3) for c in ("code", "error", "q", "slot", "dim")}).repartition(5)
    got = sorted((repr(x.vec_id), x.code, x.error, x.label_error, x.codebooks_sha256) for x in vector_codes.compress(df).collect())
    assert got == brute_codes(rows)


def test_tree_skips_and_is_exact():
    r = np.random.default_rng(3)
    entries = r.integers(-(1 << 20), 1 << 20, (16, 4))
    entries[5] = entries[2]  # a tie goes to the lower index
    v = np.concatenate([r.integers(-(1 << 20), 1 << 20, (500, 4)), entries])
    code, d2 = vector_codes.nearest(vector_codes.build(entries), v)
    every = ((v[:, None] - entries) ** 2).sum(-1)
    assert (d2 == every.min(1)).all() and (code == every.argmin(1)).all()
    best, where = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), 99)
    assert vector_codes._visit(vector_codes.build(entries), v, np.arange(len(v)), best, where) < every.size


def test_codes_of_odd_tables(spark):
    out = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with Scratch(spark, "codes") as scratch:
        rows = vector_codes.quantised(spark.createDataFrame([(1, [0.5] * 8, 1)], VECTORS), scratch)
        books = vector_codes.train(rows)
        one = vector_codes.encode(rows, books).first()
        assert one.error == 0 and vector_codes.decode(one.code, books).tolist() == [2048] * 8


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    h = lambda r, t: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*r[:4], t)))

    def forged(r):
        crc = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 0
        return h(r, r[4] if r[4] is None or crc % 3 else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))

    def tree(nodes):
        """The top, and for each node its (before, after) by level."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k in range(len(nodes)):
                lo = at[k] // 8 * 8
                paths[k].append(("".join(level[lo : at[k]]), "".join(level[at[k] + 1 : lo + 8])))
                at[k] //= 8
            level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        return level[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, h(r, r[4]), forged(r), r[0]) for r in rows if r[2] == lang), key=lambda x: x[:3])
        trees[lang] = mine, *tree([m[2] for m in mine])
    root, above = tree([trees[x][1] for x in langs])
    out = []
    for lang, up in zip(langs, above, strict=True):
        mine, top, paths = trees[lang]
        for (_, _, leaf, other, i), path in zip(mine, paths, strict=True):
            fold = other
            for before, after in path + up:
                fold = sha(before + fold + after)
            out.append((repr(i), leaf, top, root, sha("".join(a + b for a, b in path + up)), fold, fold == root))
    return sorted(out)


def records(n, seed, langs=("en", "de", None, "é", "")):
    r = random.Random(seed)
    rows = [(r.choice([None, k, k, k // 2]), r.choice(["web", None]), r.choice(langs), r.choice([None, k]), r.choice([None, "", "ABC é", f"Text {k}", "x" * 3000])) for k in range(n)]
    return rows + rows[:3]


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_of(spark, rows, most=merkle.LEVELS):
    docs = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit(1) for c in ("leaf", "tree", "n", "at", "total", "path")}).repartition(5)
    return sorted((repr(x.doc_id), *x[1:]) for x in merkle.manifest(docs, merkle.tampered(F.col("text")), most=most).collect())


@pytest.mark.parametrize("n", [1, 2, 40, 300])
def test_manifest_equals_brute_force(spark, n):
    rows = records(n, n)
    assert manifest_of(spark, rows) == brute_manifest(rows)


def test_manifest_of_one_language_and_many(spark):
    """A hot language with runs of equal rows, and more languages than a node has children."""
    rows = records(90, 5, ("en",)) + [(7, "s", "en", 1, "the same")] * 100
    assert manifest_of(spark, rows) == brute_manifest(rows)
    rows = [(k, "s", f"l{k % 30}", k, f"T{k}") for k in range(70)]
    assert manifest_of(spark, rows) == brute_manifest(rows)
    assert merkle.manifest(spark.createDataFrame([], FIELDS)).count() == 0


@pytest.mark.parametrize("most", [1, 2])
def test_manifest_in_several_rounds(spark, most):
    """Blocks of 8 and of 64 leaves: the tops of blocks are the nodes of further rounds; runs are cut at the blocks' bounds."""
    rows = records(200, 9, ("en", "en", "de")) + [(7, "s", "en", 1, "the same")] * 150 + [(1, "s", "xx", 1, "alone")]
    rows += [(k, "s", f"l{k}", k, "t") for k in range(20)]
    assert manifest_of(spark, rows, most) == brute_manifest(rows)


def test_untampered_manifest_verifies(spark):
    docs = spark.createDataFrame(records(60, 2), FIELDS)
    assert merkle.manifest(docs).select("verified").distinct().collect() == [(True,)]


def brute_segments(x):
    """Maximal scoring segments by their definition: of all segments, the best (the shortest) first, then the rest on both sides."""
    if not len(x) or max(x) <= 0:
        return []
    s, a, b = max(((sum(x[a:b]), a - b, -a) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=None)
    a, b = -b, -b - a
    return [*brute_segments(x[:a]), (s, a, b), *((t, c + b, d + b) for t, c, d in brute_segments(x[b:]))]


def test_segments_are_all_maximal_ones():
    r = random.Random(4)
    for _ in range(400):
        x = [r.choice([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) + r.random() / 100 for _ in range(r.randrange(12))]
        got = toxicity.maximal_segments(np.array(x, dtype=float))
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in brute_segments(x)]
        assert all(abs(s - sum(x[a:b])) < 1e-9 for s, a, b in got)


def labelled(spark, n=400, seed=0):
    """Prose, a tenth of it with rude words; one clean text in many copies, a text that repeats a word, ids labelled twice."""
    r, docs, labels = random.Random(seed), [], []
    for k in range(n):
        toxic = int(k % 10 == 0)
        words = prose(3000 + k, r.choice([12, 60, 300])).split()
        for _ in range(r.randrange(2, 6) * toxic):
            words.insert(r.randrange(len(words)), r.choice(["vilor", "grubsk"]) + r.choice(["", "a", "ing", "os"]))
        docs.append((k, " ".join(words)))
        labels.append((k, toxic))
    docs += [(1000 + k, prose(1, 80)) for k in range(60)]
    labels += [(1000 + k, 0) for k in range(60)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_of_held_out_documents(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    out = toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held"), "score", "passages").collect()
    held = [r for r in out if r.held]
    assert len(held) > 60 and all((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held)
    worst = {r.doc_id: r for r in out if truth[r.doc_id]}
    words = {r.doc_id: toxicity.tokens(r.text) for r in docs.collect()}
    for i, r in worst.items():
        found = [w for p in r.passages for w in words[i][p["first"] : p["end"]]]
        assert any(w.startswith(("vilor", "grubsk")) for w in found)
    assert toxicity.score(docs, model).columns == ["doc_id", "text", "score", "passages"]


def test_log_odds_by_hand(spark):
    docs, labels, truth = labelled(spark, 200, 1)
    model = toxicity.train(docs, labels, F.lit(True))
    sample = {r.doc_id: r.text for r in docs.collect()}
    # Copies of one text count once.
    texts = {}
    for i, t in sample.items():
        texts.setdefault((truth[i], min(t.lower().split()[k : k + 5] for k in range(len(t.split()) - 4))[0] if i >= 1000 else i), t)
    holds = lambda unit, t: any(w == unit or (unit.endswith("*") and w.startswith(unit[:-1]) and len(w) >= len(unit)) for w in set(toxicity.tokens(t)))
    for word in ("vilor", "alpha", "vilorxyz"):
        share = model.share
        for unit in [word[:k] + "*" for k in (3, 4, 5, 6) if len(word) > k] + [word]:
            n = sum(holds(unit, t) for t in texts.values())
            if n >= 3:
                share = (sum(holds(unit, t) * y for (y, _), t in texts.items()) + 4 * share) / (n + 4)
        assert math.isclose(model.log_odds(word), math.log(share / (1 - share)) - math.log(model.share / (1 - model.share)), abs_tol=1e-9)


def test_decay_and_logistic():
    values, p = np.array([-1.0, 1.0]), np.array([0.75, 0.25])
    assert math.isclose(toxicity.decay(values, p), math.log(3), rel_tol=1e-9)  # p e^l + q e^-l = 1 for e^l = q / p
    assert toxicity.decay(np.array([1.0]), np.array([1.0])) == toxicity.decay(np.array([-1.0]), np.array([2.0])) == 1.0
    x = np.array([0.0] * 50 + [3.0] * 10)
    slope, offset = toxicity.logistic(x, np.array([0] * 50 + [1] * 10))
    assert slope > 0 and 1 / (1 + math.exp(-offset)) < 0.05 and 1 / (1 + math.exp(-offset - 3 * slope)) > 0.8


def test_toxicity_of_odd_tables(spark):
    docs, labels, _ = labelled(spark, 200, 2)
    model = toxicity.train(docs, labels.unionByName(spark.createDataFrame([(3, 1), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")), F.lit(True))
    odd = {r.doc_id: r for r in toxicity.score(documents(spark), model).collect()}
    assert len(odd) == 11 and all(0 <= r.score <= 1 and r.n == 7 for r in odd.values())
    assert odd[2].score == odd[3].score == odd[10].score == model.probability(0.0) < 0.5
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert toxicity.score(docs, none).select("score").distinct().collect() == [(0.0,)]
    assert toxicity.train(empty(spark), labels, F.lit(True)).judge("any text") == (0.0, [])
