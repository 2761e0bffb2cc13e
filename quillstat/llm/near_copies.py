"""Near copies by Jaccard similarity of shingles: SimHash fingerprints, then MinHash bands, propose; exact similarity decides.

A text's set holds the XXH64 hashes of its shingles of SHINGLE words (words as in simhash.py; fewer words: the whole
sequence; none: the empty set). Two texts are near copies if their sets have a Jaccard similarity of at least LEAST.

Texts of equal sets collapse first. Each text has the fingerprint of simhash.py over shingles of SHINGLE words, and its
trie join links fingerprints by its budget of bits; the sets of a group that such links connect form a bucket, and the
similar ones in it are linked. That settles most copies, but a budget of a few bits loses many pairs of similarity LEAST
(about a tenth of the bits differ), so bands find the rest: of each set BANDS x ROWS minima are taken, ROWS to a band; sets
that agree in a band form a bucket, searched unless the links so far connect all of it. A pair of similarity LEAST meets in no band with a chance of (1 - LEAST ** ROWS) ** BANDS, under 1e-4, and
more similar pairs with less. Buckets of the same members count once; a bucket of over HOT sets is dealt into chunks and
every pair of chunks is searched by some task. Only the sets in buckets are read again, and a bucket is searched breadth
first: every set reached is compared exactly with all that are not, so no similar pair in it stays apart.

Defined cases: a null or empty text has the empty set, and all such are copies of each other; keys must be distinct
unless the texts are equal; an empty table gives no rows; a long text's set grows with its words, and a bucket holds HOT sets
of each side at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm import simhash
from quillstat.llm.common import Scratch
from quillstat.llm.components import components

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
HOT, FEW = 1024, 250_000
_ROUND = np.random.default_rng(11)
_MASK, _FACTOR = _ROUND.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64), _ROUND.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_WIDE = 4096


def shingles(text: str) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def bands(grams: np.ndarray) -> list[int]:
    """A hash for each band; none for the empty set."""
    if not len(grams):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), _WIDE):
        least = np.minimum(least, ((grams[None, lo : lo + _WIDE] ^ _MASK) * _FACTOR).min(axis=1))
    data = least.tobytes()
    wide = 8 * ROWS
    return [xxhash.xxh64_intdigest(data[wide * k : wide * (k + 1)], k) for k in range(BANDS)]


def _signed(x: list[int]) -> list[int]:
    return np.array(x, np.uint64).view(np.int64).tolist()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sids, found = [], []
        prints = np.fromiter((simhash.fingerprint(t, SHINGLE) for t in b.column(2).to_pylist()), np.uint64, b.num_rows).view(np.int64)
        for text in b.column(2).to_pylist():
            grams = shingles(text)
            sids.append(xxhash.xxh64_intdigest(grams.tobytes()))
            found.append(_signed(bands(grams)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_signed(sids), pa.int64()), pa.array(prints), pa.array(found, pa.list_(pa.int64()))], ["key", "doc_id", "sid", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["sid", "grams"])


def bucket_edges(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges, each of a similarity of at least `least`, that connect all sets which such edges connect."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    left, reached, edges = np.ones(len(sets), bool), [], []
    while left.any() or reached:
        if not reached:
            reached.append(int(np.argmax(left)))
            left[reached[0]] = False
        on = left[owner]
        flat, owner = flat[on], owner[on]
        at = reached.pop()
        if not len(flat):
            continue
        place = np.minimum(np.searchsorted(sets[at], flat), size[at] - 1)
        both = np.bincount(owner[sets[at][place] == flat], minlength=len(sets))
        near = np.flatnonzero(left & (both >= least * (size + size[at] - both) - 1e-9))
        edges += [(at, k) for k in near.tolist()]
        reached += near.tolist()
        left[near] = False
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows (bucket, pair, sid, grams) sorted by the first two; holds one bucket's rows at a time."""
    held_key, sids, sets = None, [], []

    def out() -> Iterator[pa.RecordBatch]:
        if len(sids) > 1:
            edges = bucket_edges(sets)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([sids[a] for a, _ in edges], pa.int64()), pa.array([sids[b] for _, b in edges], pa.int64())], ["u", "v"])

    for b in batches:
        for bucket, pair, sid, grams in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if (bucket, pair) != held_key:
                yield from out()
                held_key, sids, sets = (bucket, pair), [], []
            sids.append(sid)
            sets.append(np.frombuffer(grams, np.uint64))
    yield from out()


def fingerprint_groups(prints: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """prints: (sid, fp), `rows` at most. (sid, bucket): the sets of each group of fingerprints that the trie join connects."""
    own = scratch.write(prints.select("sid", "fp").distinct(), "own", rows)
    links = scratch.write(simhash.fingerprint_links(own.select("fp").distinct(), scratch, rows=rows), "links")
    roots = components(links, scratch).withColumnRenamed("node", "fp")
    return own.join(roots, "fp", "left").select("sid", F.coalesce("root", "fp").alias("bucket")).distinct()


def _several(band: DataFrame, scratch: Scratch, name: str, rows: int) -> DataFrame:
    """band: (sid, bucket), `rows` at most. (bucket, sid, n): buckets of n > 1 sets, those of the same members once."""
    members = [F.count("*").alias("n"), F.min("sid").alias("least"), F.bit_xor(F.xxhash64("sid")).alias("all")]
    buckets = scratch.write(band.groupBy("bucket").agg(*members).where(F.col("n") > 1).groupBy("n", "least", "all").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), f"{name}-buckets", rows)
    return scratch.write(band.join(buckets, "bucket"), f"{name}-full", rows)


def _search(full: DataFrame, sets: DataFrame, hot: int) -> DataFrame:
    """full: (bucket, sid, n). (u, v): links between similar sets that connect all similar ones of a bucket."""
    chunks = F.ceil(F.col("n") / hot).cast("int")
    chunk = F.pmod(F.xxhash64("sid"), chunks.cast("long")).cast("int")
    # The pairs of chunks that hold this row's chunk c: (i, j) with i <= j is numbered j * (j + 1) / 2 + i.
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: (F.greatest(x, F.col("c")) * (F.greatest(x, F.col("c")) + 1) / 2 + F.least(x, F.col("c"))).cast("long"))
    dealt = full.withColumn("chunks", chunks).withColumn("c", chunk).select("bucket", "sid", F.explode(F.array_distinct(pair)).alias("pair"))
    laid = dealt.join(sets, "sid").select("bucket", "pair", "sid", "grams").repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
    return laid.mapInArrow(_links, "u long, v long")


def keepers(docs: DataFrame, hot: int = HOT, few: int = FEW) -> DataFrame:
    """docs: (key, doc_id, text), texts not null. (key): of each group of near copies that of the least doc_id, null last, then the least key."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-copies")
    prints = scratch.write(docs.select("key", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, "key binary, doc_id long, sid long, fp long, bands array<long>"), "prints")
    n = prints.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    classes = scratch.write(prints.groupBy("sid").agg(first), "classes", n)
    # The empty set has no bands and no copy but itself.
    printed = _several(fingerprint_groups(prints.where(F.size("bands") > 0), Scratch(spark, "near-copies-prints"), n), scratch, "printed", n)
    banded = _several(scratch.write(prints.select("sid", F.explode("bands").alias("bucket")).distinct(), "bands", BANDS * n), scratch, "banded", BANDS * n)
    wanted = scratch.write(banded.select("sid").union(printed.select("sid")).distinct().join(classes, "sid").select("sid", F.col("first.key").alias("key")), "wanted", n)
    # Only texts in buckets are read again: found by a broadcast of their keys where these are few, else by a merge join.
    by_key = F.broadcast(wanted) if wanted.count() <= few else wanted.hint("merge")
    sets = docs.select("key", "text").join(by_key, "key").select("sid", "text").mapInArrow(_sets, "sid long, grams binary")
    # Rows that share key and text give the same set.
    sets = scratch.write(sets, "sets").dropDuplicates(["sid"])
    links = scratch.write(_search(printed, sets, hot), "links-printed")
    so_far = components(links, Scratch(spark, "near-copies-printed")).withColumnRenamed("node", "sid")
    root = F.coalesce("root", "sid")
    unsettled = banded.join(so_far, "sid", "left").groupBy("bucket").agg(F.min(root).alias("low"), F.max(root).alias("high")).where("low < high").select("bucket")
    rest = scratch.write(_search(banded.join(scratch.write(unsettled, "unsettled", BANDS * n), "bucket"), sets, hot), "links-banded")
    roots = components(links.union(rest), scratch)
    rooted = classes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", root)
    return scratch.write(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.key"), "keepers", n)
