"""The corpus pipeline, stage by stage, against brute force."""

from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_search_operators import brute_leaks
from test_text_operators import brute_groups, brute_lines, brute_print
from util import prose

import corpus_pipeline
from quillstat.llm import near_copies, registry, simhash
from quillstat.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SHARED = "this line is shared by a good many documents of the corpus"
LEAK = prose(900, 30)


def build(spark, path):
    rows = []
    for i in range(60):
        text = prose(i, 120) if i % 2 else "".join(chr(0x3B1 + ord(c) % 24) if c.isalpha() else c for c in prose(i, 120))
        if i % 5 == 0:
            text += "\n" + SHARED
        if i in (7, 21):
            text = prose(5, 40) + " " + LEAK + " " + prose(i, 40)
        rows.append((i, text, "aa" if i % 2 else "bb"))
    rows += [(60 + k, rows[3][1] + (" more" if k == 2 else ""), "aa") for k in range(3)] + [(63, rows[9][1], None), (64, "123 456", "aa"), (65, None, "aa"), (66, "", "bb"), (67, rows[11][1], "aa"), (67, rows[11][1], "aa"), (None, prose(70, 90), "aa")]
    whole = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(whole, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, LEAK), (2, prose(901, 20))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return whole


def test_stages(spark, tmp_path):
    import tiktoken

    path = str(tmp_path)
    whole = build(spark, path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontaminate", "byte_bpe"]
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/out/{k}")
        docs = spark.read.parquet(f"{path}/out/{k}")
        seen.append([tuple(r) for r in docs.collect()])
        if k < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    order = lambda rows: sorted(map(repr, rows))
    # 1: texts without a letter go, all others stay.
    want = [r for r in whole if any(map(str.isalpha, r[1] or ""))]
    assert order(seen[0]) == order(want)
    # 2
    lines = brute_lines([(r[0], r[1]) for r in want])
    want = [(r[0], t, r[2], r[3], len(t)) for r, (_, _, _, t) in zip(want, lines, strict=True)]
    assert order(seen[1]) == order(want) and any("\n" + SHARED not in r[1] and r[0] == 0 for r in want)
    # 3
    label, kept = brute_groups([brute_print(r[1]) for r in want]), {}
    for k in sorted(set(label.tolist())):
        group = [r for r, x in zip(want, label, strict=True) if x == k]
        first = min(group, key=lambda r: (r[0] is None, r[0]))
        kept[k] = first
    want = list(kept.values())
    assert order(seen[2]) == order(want) and len(want) < 62
    # 4
    leaking = {i for i, _ in brute_leaks(want, [(1, LEAK), (2, prose(901, 20))])}
    want = [r for r in want if r[0] not in leaking]
    assert order(seen[3]) == order(want) and leaking & {7, 21}
    # 5
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {r[0]: np.array(lib.encode_ordinary(r[1]), "<u4").tobytes() for r in want}
    assert order(seen[4]) == order((r[0], len(ids[r[0]]) // 4, sha(ids[r[0]]), sha(r[1].encode())) for r in want)
    assert order(tuple(r) for r in corpus_pipeline.run(spark, path).collect()) == order(seen[4])


def brute_sets(texts):
    """Each text's five-word shingles."""
    words = [(t or "").encode().lower().split() for t in texts]
    return [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in words]


def brute_keepers(rows):
    """The least row of each group of sets with a Jaccard similarity of 0.8 or more."""
    sets = brute_sets([r[1] for r in rows])
    forest = simhash._Forest(len(rows))
    for i, a in enumerate(sets):
        near = [(i, j) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)]
        forest.join(np.array(near).reshape(-1, 2))
    kept = {}
    for r, k in zip(rows, forest.labels().tolist(), strict=True):
        kept[k] = min(kept.get(k, r), r, key=lambda r: (r[0] is None, r[0]))
    return list(kept.values())


@pytest.mark.parametrize("hot,few", [(1024, 250_000), (8, 0)])
def test_near_copies_equal_brute_force(spark, hot, few):
    """Near copies with words changed all over a text, short and long, in groups and in chains."""
    r, rows = random.Random(5), []
    for k in range(40):
        words = prose(7000 + k, r.choice([3, 30, 60, 200, 2000])).split()
        for _ in range(r.randrange(1, 8)):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(1 + len(words) // 80):
                words[r.randrange(len(words))] = f"changed{r.randrange(1000)}"
    rows += [(500 + k, prose(1, 200) + f" tail{k}") for k in range(40)] + [(600, ""), (601, " "), (602, "two words"), (603, "Two  words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.encode(F.col("doc_id").cast("string"), "utf-8"))
    got = sorted(int(bytes(x.key)) for x in near_copies.keepers(docs, hot, few).collect())
    assert got == sorted(i for i, _ in brute_keepers(rows)) and len(got) < len(rows) - 80


def test_near_dedup_stage_takes_copies_of_similarity(spark, tmp_path):
    words = prose(31, 100).split()
    changed = list(words)
    changed[20] = changed[70] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, prose(32, 100))]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], SCHEMA)
    assert len(brute_keepers(rows)) == 2
    assert {x.doc_id for x in corpus_pipeline._simhash(spark, docs, str(tmp_path)).collect()} == {1, 3}


def test_near_copies_come_from_fingerprints(spark):
    """The groups of the trie join over five-word fingerprints, and exact links inside them, without any band."""
    r, texts = random.Random(6), []
    for k in range(12):
        words = prose(8000 + k, 400).split()
        for _ in range(5):
            texts.append(" ".join(words))
            words = list(words)
            words[r.randrange(400)] = f"changed{r.randrange(1000)}"
    texts += ["", "two words", "Two  words"]
    rows = [(k.to_bytes(2, "big"), k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "key binary, doc_id long, text string")
    prints = docs.mapInArrow(near_copies._prints, "key binary, doc_id long, sid long, fp long, bands array<long>")
    own = [simhash.fingerprint(t, 5) for t in texts]
    label = brute_groups(own).tolist()
    full = near_copies.fingerprint_groups(prints, Scratch(spark, "test")).collect()
    sid = {x.doc_id: x.sid for x in prints.collect()}
    bucket = {x.sid: x.bucket for x in full}
    got = [bucket[sid[k]] for k in range(len(texts))]
    assert len(set(zip(label, got, strict=True))) == len(set(label)) == len(set(got)) and len(set(label)) < len(set(own)) - 10
    sets = docs.select("doc_id", "text").mapInArrow(lambda bs: near_copies._sets(bs), "sid long, grams binary").where("octet_length(grams) > 0")
    groups = spark.createDataFrame([(got[k], k, got.count(got[k])) for k in range(60)], "bucket long, sid long, n long")
    exact = brute_sets(texts)
    found = near_copies._search(groups, sets, 1024).collect()
    assert len(found) > 10 and all(len(exact[x.u] & exact[x.v]) >= 0.8 * len(exact[x.u] | exact[x.v]) for x in found)


def test_rows_that_share_an_id_are_judged_apart(spark, tmp_path):
    """Many null ids and a repeated one: one row of each group stays, and only the rows that leak go."""
    path = str(tmp_path)
    x, y = prose(41, 60), prose(42, 60)
    rows = [(5, x), (7, x), (7, y), *[(None, prose(50 + k, 60)) for k in range(6)], (None, x), (None, prose(50, 60)), (None, prose(60, 20) + " " + LEAK), (7, LEAK + " " + prose(61, 20))]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], SCHEMA)
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    order = lambda rows: sorted(map(repr, rows))
    alone = [(5, x), (7, y), *rows[3:9]]
    assert order((r.doc_id, r.text) for r in corpus_pipeline._simhash(spark, docs, path).collect()) == order([*alone, *rows[11:]])
    assert order((r.doc_id, r.text) for r in corpus_pipeline._decontaminate(spark, docs, path).collect()) == order(rows[:11])


def test_queries_are_registered():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    path, names = str(tmp_path), ["score", "copy", "n_lines", "n_dropped", "lang_pred", "row_key", "leak_key", "held_row", "key"]
    build(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit(k + 100) for k, c in enumerate(names)})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, path).write.parquet(f"{path}/clash/{k}")
        after = spark.read.parquet(f"{path}/clash/{k}")
        assert after.dtypes == docs.dtypes
        docs = after
        assert docs.select(*names).distinct().collect() == [tuple(range(100, 100 + len(names)))]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == docs.count() > 20


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    """An empty table, one without labels, and one with a text of millions of characters."""
    path = str(tmp_path)
    build(spark, path)
    for docs, left in ((spark.createDataFrame([], SCHEMA), 0), (spark.createDataFrame([(1, "words here", None, "s", 9), (2, "12", None, "s", 2), (3, "long text " * 300_000, None, "s", 9)], SCHEMA), 2)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, path).write.parquet(f"{path}/odd-{left}/{k}")
            docs = spark.read.parquet(f"{path}/odd-{left}/{k}")
            assert docs.count() == left


def test_stages_keep_columns_of_any_name_and_type(spark, tmp_path):
    path = str(tmp_path)
    build(spark, path)
    odd = {"my col": F.lit(1), "a-b": F.lit("x"), "a.b": F.lit(2.5), "m": F.create_map(F.lit("k"), F.lit(1)), "arr": F.array(F.lit(1), F.lit(None)), "st": F.struct(F.lit(1).alias("in.ner"), F.lit("s").alias("b c")), "back`tick": F.lit(4)}
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({f"_{k}": v for k, v in enumerate(odd.values())})
    docs = docs.toDF(*docs.columns[: -len(odd)], *odd)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, path).write.parquet(f"{path}/any/{k}")
        after = spark.read.parquet(f"{path}/any/{k}")
        assert after.columns == docs.columns
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == docs.count() > 20
    row = docs.first()
    assert (row["my col"], row["a-b"], row["a.b"], row["m"], row["arr"]) == (1, "x", 2.5, {"k": 1}, [1, None])


def test_codec_is_put_back_when_a_stage_fails(spark, tmp_path):
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.createDataFrame([(1,)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(Exception):  # noqa: B017  no text
        corpus_pipeline.run(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.parquet.compression.codec") == before


def test_narrow_tables_have_few_files(spark, tmp_path, monkeypatch):
    """However many shuffle partitions there are: each file is a fork or a request more."""
    written = {}
    write = Scratch.write

    def noted(self, df, name, *rows):
        out = write(self, df, name, *rows)
        written[f"{Path(self.path).name.rsplit('-', 1)[0]}/{name}"] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "write", noted)
    rows = [(k, prose(k % 90, 60) + f" tail{k}") for k in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.encode(F.col("doc_id").cast("string"), "utf-8"))
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    own = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert near_copies.keepers(docs).count() == 90
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    heavy = {"links", "sets", "links-printed", "links-banded"}
    assert len(written) > 20 and {k for k, v in written.items() if v > spark.sparkContext.defaultParallelism and k.split("/")[1] not in heavy} == set()
