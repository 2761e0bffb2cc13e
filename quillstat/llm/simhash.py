"""SimHash near-dedup: 64-bit fingerprints linked by a binary trie self-join under a Hamming error budget.

Fingerprint: words are runs of characters other than ASCII space after A-Z are lower-cased; shingles are `SHINGLE` words
joined by one space, repeats included (fewer words: the whole sequence; none: fingerprint zero). A bit is 1 if it is set
in over half of the shingles' XXH64 values (seed 42).

Join: equal fingerprints collapse first (a partial aggregate), so groups of exact copies cost one row. The distinct
fingerprints are cut into BLOCKS blocks of bits; two within MAX_BITS differing bits agree in at least BLOCKS - MAX_BITS
blocks, so every such pair meets under one of the C(5, 2) = 10 choices of two equal blocks. Rows that share a choice and
its bits form a bucket. In a bucket, two copies of one binary trie are walked together: node pairs split bit by bit,
differing bits add up, pairs over the budget are pruned, and so are pairs already known to be one component. A bucket
of over HOT rows is dealt into chunks and every pair of chunks is walked by some task, so no task holds more than
2 * HOT rows and no pair is missed. A bucket yields a chain through each of its components, never all pairs. Components
are then found by star rounds (see components.py).

Defined cases: a null or empty text, or one of only space, has fingerprint zero and is linked like any other; repeated
rows give repeated result rows; a null doc_id is never a component's id unless all its members are null; an empty table gives no rows; a long text is hashed whole, in memory that grows with its words; other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import Scratch, table, text_of
from quillstat.llm.components import components

SHINGLE, SEED = 3, 42
MAX_BITS, BLOCKS, HOT = 3, 5, 2048


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    total = np.zeros(64, np.int64)
    n = 0
    while True:
        digests = b"".join(map(xxhash.xxh64_digest, islice(grams, 1 << 16), repeat(SEED)))
        if not digests:
            break
        rows = len(digests) // 8
        n += rows
        bits = np.zeros((-(-rows // 255) * 255, 64), np.uint8)
        bits[:rows] = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(rows, 64)
        total += np.add.reduce(bits.reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(x, shingle) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _blocks(n: int) -> list[int]:
    """The bit masks of n blocks that together cover 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class _Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            a, b = self.find(a), self.find(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        return np.fromiter(map(self.find, range(len(self.up))), np.int64, len(self.up))


def trie_links(prints: np.ndarray, budget: int = MAX_BITS) -> np.ndarray:
    """prints: sorted distinct uint64. The component (least index) of each under links of at most `budget` differing bits.

    A trie node is a range of the sorted array; a level of the walk splits all live node pairs at one bit.
    """
    n = len(prints)
    forest = _Forest(n)
    near = np.flatnonzero(np.bitwise_count(prints[1:] ^ prints[:-1]) <= budget)
    forest.join(np.stack([near, near + 1], axis=1))
    a0, a1, b0, b1, err = (np.array([x], np.int64) for x in (0, n, 0, n, 0))
    label = forest.labels()
    for bit in range(63, -1, -1):
        if not len(a0):
            break
        turns = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        one = (turns[a0] == turns[a1 - 1]) & (turns[b0] == turns[b1 - 1]) & (label[a0] == label[b0])
        a0, a1, b0, b1, err = (x[~one] for x in (a0, a1, b0, b1, err))
        ones = np.concatenate([[0], np.cumsum((prints >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        self_pair = a0 == b0
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        other = tuple(x[~self_pair] for x in (am, a1, b0, bm, err + 1))
        a0, a1, b0, b1, err = (np.concatenate([p[k] for p in [*parts, other]]) for k in range(5))
        live = (a1 > a0) & (b1 > b0) & (err <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, err = (x[live] for x in (a0, a1, b0, b1, err))
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            hit = np.bitwise_count(prints[x] ^ prints[y]) <= budget
            if hit.any():
                forest.join(np.stack([x[hit], y[hit]], axis=1))
                label = forest.labels()
            a0, a1, b0, b1, err = (v[~leaf] for v in (a0, a1, b0, b1, err))
    return forest.labels()


def _bucket_links(budget: int):
    """Streams rows sorted by bucket; keeps one bucket's rows at a time. Emits a chain through each component of a bucket."""

    def links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = np.unique(prints)
        if len(prints) == 2:
            keep = np.bitwise_count(prints[:1] ^ prints[1:]) <= budget
            return prints[:1][keep], prints[1:][keep]
        label = trie_links(prints, budget)
        order = np.argsort(label, kind="stable")
        same = label[order][1:] == label[order][:-1]
        return prints[order[:-1][same]], prints[order[1:][same]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            fp = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            starts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            starts = np.concatenate([[0], starts, [len(fp)]])
            us, vs = [], []
            for k, (i, j) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
                if k == 0 and held_key is not None and tuple(key[0]) == held_key:
                    held.append(fp[i:j])
                    continue
                if held:
                    whole = np.concatenate(held)
                    if len(whole) > 1:
                        u, v = links(whole)
                        us.append(u)
                        vs.append(v)
                held_key, held = tuple(key[i]), [fp[i:j]]
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
        if held and len(whole := np.concatenate(held)) > 1:
            u, v = links(whole)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def fingerprint_links(prints: DataFrame, scratch: Scratch, budget: int = MAX_BITS, blocks: int = BLOCKS, hot: int = HOT, rows: int | None = None) -> DataFrame:
    """prints: (fp) distinct, `rows` at most. (u, v): links that connect every two fingerprints within `budget` differing bits, directly or in steps."""
    masks = _blocks(blocks)
    choices = [sum(c) for c in combinations(masks, blocks - budget)]
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in choices])).alias("choice", "bits"))
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = scratch.write(sizes, "bucket-sizes", rows and rows * len(choices))
    full = keyed.join(sizes, ["choice", "bits"])
    chunks = F.ceil(F.col("n") / hot).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), chunks.cast("long")).cast("int")
    # The pairs of chunks that hold this row's chunk c: (i, j) with i <= j is numbered j * (j + 1) / 2 + i.
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: (F.greatest(x, F.col("c")) * (F.greatest(x, F.col("c")) + 1) / 2 + F.least(x, F.col("c"))).cast("long"))
    dealt = full.withColumn("chunks", chunks).withColumn("c", chunk).select("choice", "bits", "fp", F.explode(F.array_distinct(pair)).alias("pair"))
    dealt = dealt.repartition("choice", "bits", "pair").sortWithinPartitions("choice", "bits", "pair").select(F.col("choice").cast("long").alias("choice"), "bits", "pair", "fp")
    return dealt.mapInArrow(_bucket_links(budget), "u long, v long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, budget: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links, the document's own included."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, shingle), "prints")
    classes = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = scratch.write(fingerprint_links(classes.select("fp"), scratch, budget), "links")
    roots = components(links, scratch)
    rooted = scratch.write(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = scratch.write(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = scratch.write(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
