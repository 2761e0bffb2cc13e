"""Line dedup, token store, byte BPE and SimHash against brute force and the tokenizer libraries."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from util import LONG, ROWS, documents, empty, prose

from quillstat.llm import byte_bpe, components, line_dedup, simhash, token_store
from quillstat.llm.common import Scratch

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    ident = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(ident(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and ident(i) != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    shared = "This very line stands in a good many documents, as licences do."
    rows = [(i, f"own {i}\n {shared.upper() if i % 2 else shared}\t\n{shared}") for i in range(6)] + [(6, shared[:39]), (6, shared), (6, shared), (None, shared), (7, None), (8, ""), (9, "É" * 40)] + [(20 + i, "É" * 40 + ("\n" + "é" * 40) * 2) for i in range(5)]
    rows += [(40, "\n".join(f"{k} {shared}" for k in range(3000)) + "\n" + shared)]
    from pyspark.sql import functions as F

    docs = documents(spark).where("false").unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")), allowMissingColumns=True)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted((str(a), b, c, d) for a, b, c, d in brute_lines(rows))
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_token_store(spark, tokenizer, tmp_path):
    rows = [*ROWS, *((100 + k, prose(k, 3000) + " shared " + LONG[:20_000], "en") for k in range(4))]
    path = f"{tmp_path}/store"
    token_store.write_store(documents(spark, rows), WORDS, 2, path)
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    want = sorted(((-1 if i is None else i), ids(t)) for i, t, _ in rows)
    got = sorted(token_store.read_checksums(spark, path, 2).collect(), key=lambda r: r.start)
    at = 0
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == [w[0] for w in want]
    for r, (_, x) in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    whole = sorted(token_store.read_documents(spark, path, 2).collect(), key=lambda r: r.start)
    assert [np.frombuffer(r.ids, "<u2").tolist() for r in whole] == [w[1] for w in want]
    stored = spark.read.parquet(path).selectExpr("sum(length(payload)) AS p").first().p
    assert stored < 2 * at * 0.8  # copies are stored once


def test_token_store_finds_damage(spark, tmp_path):
    path = f"{tmp_path}/store"
    token_store.write_store(documents(spark).limit(3), WORDS, 2, path)
    from pyspark.sql import functions as F

    bad = spark.read.parquet(path).withColumn("payload", F.when(F.col("n_docs").isNull(), F.concat(F.expr("x'0001'"), F.expr("substring(payload, 3)"))))
    bad.write.parquet(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="does not match its address"):
        token_store.read_checksums(spark, f"{tmp_path}/bad", 2).collect()
    # A document, a chunk that others use, a file's manifest row, or a whole file is gone.
    path = f"{tmp_path}/shared"
    token_store.write_store(documents(spark, [(k, prose(k, 300) + " " + LONG, "en") for k in range(6)]), WORDS, 2, path)
    rows = spark.read.parquet(path)
    owner = rows.where("n_docs is null AND length(payload) > 4096").first().doc_id
    cuts = {"document": "n_docs is not null OR doc_id <> 3", "owner": f"n_docs is not null OR doc_id <> {owner}", "manifest": "n_docs is null", "all": "false"}
    for name, kept in cuts.items():
        rows.where(kept).write.parquet(f"{tmp_path}/{name}")
        spark.read.parquet(f"{path}-manifest").write.parquet(f"{tmp_path}/{name}-manifest")
        for read in (token_store.read_checksums, token_store.read_documents):
            with pytest.raises(ValueError, match="manifest"):
                read(spark, f"{tmp_path}/{name}", 2)
    # The manifests agree, but shared chunks are nowhere.
    lost = rows.withColumn("flags", F.when(F.col("n_docs").isNull(), F.expr("unhex(repeat('02', size(leaves)))")))
    lost.write.parquet(f"{tmp_path}/lost")
    spark.read.parquet(f"{path}-manifest").write.parquet(f"{tmp_path}/lost-manifest")
    for read in (token_store.read_checksums, token_store.read_documents):
        with pytest.raises(ValueError, match="missing"):
            read(spark, f"{tmp_path}/lost", 2)
    token_store.write_store(empty(spark), WORDS, 2, f"{tmp_path}/none")
    assert token_store.read_checksums(spark, f"{tmp_path}/none", 2).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 49_000, 20_000)
    cut = lambda x: np.split(x, np.cumsum(token_store.chunk_lengths(x))[:-1])
    moved = np.concatenate([rng.integers(0, 49_000, 777), base])
    lengths = token_store.chunk_lengths(base)
    assert sum(lengths) == len(base) and max(lengths) <= token_store.MAX
    a, b = ({x.tobytes() for x in cut(y)} for y in (base, moved))
    assert len(a & b) >= len(a) - 2
    assert token_store.chunk_lengths(np.zeros(10_000, int)) and token_store.chunk_lengths(base[:0]) == []


def test_word_encoder_equals_library(tokenizer):
    r = random.Random(1)
    parts = ["a", "B", "'s", "'", "́", "é", "É", "\x85", "\xa0", "\x1c", " ", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", ".", ",", "Σ", "İ", "1", "٣", "　", "!"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(2000)]
    for t, got in zip(texts, token_store.encoder(WORDS).encode_batch(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_are_learned_without_marks_and_case(tokenizer):
    own = token_store.WordEncoder(WORDS)
    texts = ["éa ÉA, Éa*** straße. STRASSE? Straße!! ab Ab., x1; <|a, o'k' ¿qué?"]
    (got,) = own.encode_batch(texts)
    assert np.frombuffer(got, "<u2").tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert {"éa", "straße", "ab", "***"} <= set(own.memo) and not {"éa,", "éa***", "straße.", "Straße", "ab.,"} & set(own.memo)
    # Ends of words: what must not be cut off, and runs of marks that are one piece with what stands before them.
    r = random.Random(2)
    stems, ends = ["été", "ÀÇÑ", "ŒUF", "œ", "ß", "ẞ", "ÿ", "×", "µ", "ª", "€", "e\u0301", "=", "q\u0323", "7", "don't", "Σς", "<|endoftext", "<|Endoftext", "n'"], ["", ",", "'s", "'s!", "'ll.", "|>", "|>,", "$$$", "\u0301.", "€!", ".", "_"]
    texts = [" ".join(r.choice(stems) + r.choice(ends) for _ in range(r.randrange(9))) for _ in range(1500)]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_of_texts(tokenizer, monkeypatch):
    own = token_store.WordEncoder(WORDS)
    texts = ["", prose(1, 40), "", "é" * 300, prose(2, 200), " ", "\n.", "", prose(3, 3)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (1, 100, 700, 1 << 20):
        monkeypatch.setattr(token_store, "PIECE", size)
        monkeypatch.setattr(token_store, "MEMO", 20)
        assert [np.frombuffer(x, "<u2").tolist() for x in own.encode_batch(texts)] == want
    assert own.encode_batch([]) == []


def test_chunks_of_streams_equal_single_streams():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 49_000, n).astype("<u2") for n in (1, 63, 64, 65, 5000, 1, 700, 20_000)] + [np.zeros(9000, "<u2")] * 2
    ends = np.cumsum([len(x) for x in parts]).tolist()
    assert token_store.chunks_of_streams(np.concatenate(parts), ends) == [token_store.chunk_lengths(x) for x in parts]
    x = parts[7].astype(np.uint32)
    full = sum((np.pad(x, (j, 0))[: len(x)] * np.uint32(pow(token_store._FACTOR, j, 1 << 32)) for j in range(token_store.WINDOW)), np.uint32(0)) * np.uint32(token_store._SPREAD)
    assert token_store.chunk_ends(parts[7]).tolist() == (np.flatnonzero(full < (1 << 32) // token_store.MEAN) + 1).tolist()


def test_crc_join():
    a, b = b"hello" * 7, b"world" * 1234
    assert token_store.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_store.crc_join(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


@pytest.fixture(scope="module")
def bpe():
    import tiktoken

    own = byte_bpe.coder(RANKS, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    return own, lambda t: np.array(lib.encode_ordinary(t), "<u4").tobytes()


def test_bpe_equals_library(bpe):
    own, ref = bpe
    r = random.Random(5)
    letters = "ab'sS \n\t\r\x1c\x1f\x85 　éß1٣-.,'llvmre  \n\nդ՘࢏"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["a" * 20_000, " " * 3000 + "x", "-" * 5000, "ab" * 5000, "\n" * 999, "é" * 3001, "", "<|endoftext|>"]
    for t, got in zip(texts, own.encode_batch(texts), strict=True):
        assert got == ref(t), repr(t[:60])


def test_lanes_equal_single_merges(bpe):
    own, _ = bpe
    r = random.Random(7)
    pieces = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(5, 9))).encode() for _ in range(300)]
    assert own._merge(pieces) == [own._merge_one(p) for p in pieces]


def test_bpe_rows(spark, bpe):
    own, ref = bpe
    got = sorted(tuple(r) for r in byte_bpe.round_trip(documents(spark).where("doc_id IS NOT NULL"), RANKS, public_tokenizers.PATTERN).collect())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted((i, len(ref(t or "")) // 4, sha(ref(t or "")), sha((t or "").encode())) for i, t, _ in ROWS if i is not None)
    assert got == want
    assert byte_bpe.round_trip(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(documents(spark), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(r.decoded for r in back.collect()) == sorted((t or "").encode() for _, t, _ in ROWS)


def brute_print(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    forest = simhash._Forest(len(prints))
    for i in range(len(prints)):
        forest.join(np.array([(i, j) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]).reshape(-1, 2))
    return forest.labels()


def test_fingerprints(spark):
    for _, t, _ in ROWS[:8]:
        assert simhash.fingerprint(t or "") == brute_print(t)
    spark_hash = spark.sql("SELECT xxhash64('alpha beta gamma')").first()[0]
    assert spark_hash % 2**64 == xxhash.xxh64_intdigest(b"alpha beta gamma", 42)


@pytest.mark.parametrize("hot", [4, 2048])
def test_links_equal_all_pairs(spark, tmp_path, hot):
    rng = random.Random(hot)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            y = x
            for _ in range(rng.randrange(5)):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    scratch = Scratch(spark, "test")
    roots = {r.node: r.root for r in components.components(simhash.fingerprint_links(df, scratch, hot=hot), scratch).collect()}
    label = brute_groups(prints)
    got = [roots.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    assert len(set(zip(label.tolist(), got, strict=True))) == len(set(label.tolist())) == len(set(got))


def test_trie_equals_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        prints = []
        for base in rng.integers(0, 2**63, size=rng.integers(1, 5), dtype=np.uint64).tolist():
            for _ in range(rng.integers(1, 30)):
                x = base
                for _ in range(rng.integers(0, 6)):
                    x ^= 1 << int(rng.integers(0, 64))
                prints.append(x)
        p = np.unique(np.array(prints, np.uint64))
        assert (simhash.trie_links(p) == brute_groups([int(x) for x in p])).all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500)], "u long, v long")
    got = {r.node: r.root for r in components.components(links, Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_near_groups(spark):
    rows = [(i, prose(i // 3, 400) + (" extra" if i % 3 else ""), "en") for i in range(3, 30)] + [(1, "", None), (2, None, None), (None, " ", None), (40, LONG, None), (41, LONG, None), (41, LONG, None)]
    got = simhash.near_groups(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [brute_print(t) for _, t, _ in rows]
    label, least = brute_groups(prints), {}
    for (i, _, _), k in zip(rows, label, strict=True):
        least[k] = min((x for x in (i, least.get(k)) if x is not None), default=None)
    want = sorted(repr((i, simhash._signed(p), least[k])) for (i, _, _), p, k in zip(rows, prints, label, strict=True))
    assert sorted(repr((r.doc_id, r.fp, r.component_id)) for r in got) == want
    assert simhash.near_groups(empty(spark)).count() == 0
