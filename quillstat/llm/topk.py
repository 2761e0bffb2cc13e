"""Exact top-k inner products by a three-phase uniform threshold.

A vector's dimensions are cut into SLICES; a slice of a block of vectors is a node that holds, for each query, a list of
partial scores. 1: every node gives its K best entries, of which the K-th best whole score is a lower bound for the
query's K-th score. 2: that bound is handed to every node as cutoff bound / SLICES: a vector whose partial scores all lie
below it cannot reach the bound, so the entries at or above it, of any node, are sufficient. 3: the entries collected are
resolved to their exact scores, and those that reach the bound are ranked.

Queries are a stated set; both sides are packed into blocks of rows and every query block meets every block of vectors
once a phase, in a grid of cells of about QUERY_BLOCKS x VECTOR_BLOCKS blocks (fewer vectors where there would be under
CELLS groups of them): blocks of one side are copied once a group of the other, a task holds the query blocks of a cell
and streams its vectors. Every row has a key of its own.

Scores are integers. They are exact as long as they stay below 2^53 in size (checked for each pair of blocks; beyond it
64-bit integer arithmetic is used, exact up to 2^63).

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; rows with the same id
are separate candidates and separate queries, and only a query's own row is never among its results; a row with a null id
is a candidate like any other and comes last of equal scores; vectors of different length are never compared; fewer than
K candidates give fewer ranks; an empty table, or one without queries, gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.llm.common import Scratch, table

K, SLICES, EVERY = 5, 4, 50
#: Rows of a packed block: queries, vectors.
QUERY_ROWS, VECTOR_ROWS = 512, 2048
#: Blocks of a cell of the grid; groups of vectors there are at least, where there are so many blocks.
QUERY_BLOCKS, VECTOR_BLOCKS, CELLS = 8, 32, 256
NO_BOUND, NO_ID = -(2**63), 2**63 - 1


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(key, vec_id, v): floor(256 * x) of each component, for the vectors that take part; the key holds once it is written."""
    usable = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).select(F.monotonically_increasing_id().alias("key"), "vec_id", "v")


def _pack(rows: int):
    """Blocks of vectors of one length: (dim, keys, extra, data) as packed 64-bit integers; extra: a query's bound, a vector's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[int], int]]] = {}

        def block(part: list[tuple[int, list[int], int]], dim: int) -> pa.RecordBatch:
            keys, v, extra = zip(*part, strict=True)
            packed = [np.array(keys, "<i8").tobytes(), np.array(extra, "<i8").tobytes(), np.array(v, "<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["dim", "keys", "extra", "data"])

        for b in batches:
            for key, v, extra in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = held.setdefault(len(v), [])
                part.append((key, v, extra))
                if len(part) == rows:
                    yield block(held.pop(len(v)), len(v))
        for dim, part in held.items():
            yield block(part, dim)

    return run


_BLOCK = "dim int, keys binary, extra binary, data binary"


def _partials(q: np.ndarray, c: np.ndarray, slices: int) -> list[np.ndarray]:
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2**53
    kind = np.float64 if exact else np.int64
    cuts = [q.shape[1] * s // slices for s in range(slices + 1)]
    return [(q[:, a:b].astype(kind) @ c[:, a:b].T.astype(kind)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The column indices of k largest entries of each row."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def _entries(q_keys: np.ndarray, bound: np.ndarray, q: np.ndarray, c_keys: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, slices: int, resolve: bool) -> tuple[np.ndarray, ...]:
    """A query block with a block of vectors: at most k entries of each query, with their whole scores."""
    parts = _partials(q, c, slices)
    own = q_keys[:, None] == c_keys
    if resolve:  # phases 2 and 3
        wanted = np.zeros(own.shape, bool)
        for p in parts:
            wanted |= p >= (bound // slices)[:, None]
        at, col = np.nonzero(wanted & ~own)
    else:  # phase 1
        at, col = [], []
        for p in parts:
            p = np.where(own, p.min(initial=0) - 1, p)
            best = _best(p, min(k + 1, p.shape[1]))
            at.append(np.repeat(np.arange(len(q_keys)), best.shape[1]))
            col.append(best.ravel())
        pairs = np.unique(np.concatenate(at) * len(c_keys) + np.concatenate(col))
        at, col = pairs // len(c_keys), pairs % len(c_keys)
        at, col = at[~own[at, col]], col[~own[at, col]]
    score = sum(p[at, col] for p in parts).astype(np.int64)
    keep = score >= bound[at]
    at, col, score = at[keep], col[keep], score[keep]
    return _nearest(q_keys[at], c_keys[col], c_ids[col], score, k)


def _nearest(query: np.ndarray, key: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best entries of each query: by score, then id, then key."""
    order = np.lexsort((key, ids, -score, query))
    query = query[order]
    near = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
    return query[near], *(x[order][near] for x in (key, ids, score))


def _phase(k: int, slices: int, resolve: bool):
    """Blocks sorted by cell, its queries first; holds a cell's query blocks and their k best entries, which leave it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, {}, {}

        def out() -> Iterator[pa.RecordBatch]:
            for found in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query", "key", "id", "score"])

        for b in batches:
            for at, dim, keys, extra, data in zip(*(b.column(n) for n in range(5)), strict=True):
                at, dim, *block = at.as_py(), dim.as_py(), *(np.frombuffer(x.as_buffer(), "<i8") for x in (keys, extra, data))
                block[2] = block[2].reshape(-1, dim)
                if at >> 1 != cell:
                    yield from out()
                    cell, held, best = at >> 1, {}, {}
                if at & 1:
                    for nth, asked in enumerate(held.get(dim, ())):
                        found = _entries(*asked, *block, k, slices, resolve)
                        if (dim, nth) in best:
                            found = _nearest(*(np.concatenate(x) for x in zip(best[dim, nth], found, strict=True)), k)
                        best[dim, nth] = found
                else:  # outlives its batch
                    held.setdefault(dim, []).append([x.copy() for x in block])
        yield from out()

    return run


def _meet(queries: DataFrame, vectors: DataFrame, n_queries: int, n_vectors: int, k: int, slices: int, resolve: bool) -> DataFrame:
    """(query, key, id, score): each cell's best entries of each query, by the rows' keys; an unknown id is NO_ID."""
    wide, high = max(1, min(n_vectors, max(CELLS, n_vectors // VECTOR_BLOCKS))), max(1, n_queries // QUERY_BLOCKS)

    def group(n: int) -> Column:
        return F.pmod(F.xxhash64("keys"), F.lit(n))

    def copies(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    asked = queries.select(copies(wide).alias("g"), group(high).alias("r"), "dim", "keys", "extra", "data").withColumn("at", (F.col("g") * high + F.col("r")) * 2)
    held = vectors.select(group(wide).alias("g"), copies(high).alias("r"), "dim", "keys", "extra", "data").withColumn("at", (F.col("g") * high + F.col("r")) * 2 + 1)
    met = asked.unionByName(held).repartition(F.shiftright("at", 1)).sortWithinPartitions("at").select("at", "dim", "keys", "extra", "data")
    return met.mapInArrow(_phase(k, slices, resolve), "query long, key long, id long, score long")


def _ranked(lists: DataFrame, k: int) -> DataFrame:
    """rank from 1 to k: by score, then the smaller id (unknown ones last), then the key."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "key")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query (rows of `vectors` for which `is_query` holds, seen as (vec_id)) with all other vectors."""
    scratch = Scratch(vectors.sparkSession, "top-k")
    whole = scratch.write(integer_vectors(vectors), "vectors")
    blocks = scratch.write(whole.select("key", "v", F.coalesce("vec_id", F.lit(NO_ID))).mapInArrow(_pack(VECTOR_ROWS), _BLOCK), "blocks")
    queries = scratch.write(whole.where(is_query), "queries")
    packed = scratch.write(queries.select("key", "v", F.lit(NO_BOUND)).mapInArrow(_pack(QUERY_ROWS), _BLOCK), "packed-1")
    sizes = packed.count(), blocks.count()
    lists = scratch.write(_meet(packed, blocks, *sizes, k, slices, False), "lists")
    bounds = _ranked(lists, k).where(F.col("rank") == k).select(F.col("query").alias("key"), F.col("score").alias("bound"))
    packed = scratch.write(queries.join(bounds, "key", "left").select("key", "v", F.coalesce("bound", F.lit(NO_BOUND))).mapInArrow(_pack(QUERY_ROWS), _BLOCK), "packed-2")
    found = _ranked(_meet(packed, blocks, *sizes, k, slices, True), k)
    named = queries.select(F.col("key").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(named, "query").select("query_id", "rank", F.nullif("id", F.lit(NO_ID)).alias("vec_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS k, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.k AS q, c.k, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.k <> c.k AND len(q.e) = len(c.e)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, k) AS INT) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
