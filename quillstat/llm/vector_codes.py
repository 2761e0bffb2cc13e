"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

Components are integers, floor(SCALE * x); a vector is cut into PARTS equal consecutive parts, and each part position has
a codebook of at most ENTRIES entries. It starts as that part of the vectors with the smallest vec_ids. A round assigns
every part to the nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by the
componentwise floor of its parts' mean; after ROUNDS rounds the parts are assigned once more.

Nearest entries come from a vantage-point tree over the entries of each part position. A subtree is kept with the least
and the greatest distance of its entries from the vantage point, rounded outwards; a part descends into the nearer
subtree first and into the other one unless its bound is strictly beyond the best distance found. What is visited is
compared in integers, ties included, so rounding can only cost a visit. A batch of parts goes down together.

Quantised vectors are written once, as packed integers. A round sends PARTS x ENTRIES sums a task to the exchange and the
codebooks, PARTS x ENTRIES entries whatever the table's size, through the driver.

Defined cases: vectors that are null or empty, or hold a null or non-finite component, take no part, and neither do those
with a component beyond LIMIT in size once scaled (squared distances then fit 64 bits up to 8,192 components a vector),
those whose length is no multiple of PARTS, and those of another length than the first by vec_id; null vec_ids come last
in the starting order, rows that share a vec_id are ordered by their components; every row that takes part gets a row;
fewer vectors than ENTRIES start as many entries; null labels are equal; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import Scratch, table

PARTS, ENTRIES, ROUNDS, SCALE, LIMIT = 8, 16, 6, 4096, 1 << 24
#: More than the relative error of a distance in double precision.
_OUT = 1e-12


@dataclass
class Node:
    """A vantage point (an entry) and its two subtrees, each with the bounds of its entries' distances from it."""

    index: int
    point: np.ndarray
    near: Node | None = None
    far: Node | None = None
    near_bounds: tuple[float, float] = (0.0, 0.0)
    far_bounds: tuple[float, float] = (0.0, 0.0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def build(entries: np.ndarray, indices: np.ndarray | None = None) -> Node | None:
    """A vantage-point tree over 64-bit integer entries, split at the median distance."""
    indices = np.arange(len(entries)) if indices is None else indices
    if not len(indices):
        return None
    node, rest = Node(int(indices[0]), entries[indices[0]]), indices[1:]
    if len(rest):
        d = np.sqrt(squared(entries[rest], node.point).astype(np.float64))
        order = np.argsort(d, kind="stable")
        half = (len(rest) + 1) // 2
        bounds = lambda x: (float(d[x].min() * (1 - _OUT)), float(d[x].max() * (1 + _OUT)))
        node.near, node.near_bounds = build(entries, rest[order[:half]]), bounds(order[:half])
        if len(rest) > half:
            node.far, node.far_bounds = build(entries, rest[order[half:]]), bounds(order[half:])
    return node


def _visit(node: Node, v: np.ndarray, rows: np.ndarray, best: np.ndarray, code: np.ndarray) -> int:
    """Improves the best (squared distance, index) of the given rows; returns how many distances that took."""
    d2 = squared(v[rows], node.point)
    better = (d2 < best[rows]) | ((d2 == best[rows]) & (node.index < code[rows]))
    best[rows[better]], code[rows[better]] = d2[better], node.index
    taken = len(rows)
    if node.near is None:
        return taken
    d = np.sqrt(d2.astype(np.float64))
    children = [(node.near, *node.near_bounds)] + ([(node.far, *node.far_bounds)] if node.far else [])
    # Whichever subtree's ring the part is closer to goes first.
    gaps = [np.maximum(np.maximum(d * (1 - _OUT) - hi, lo - d * (1 + _OUT)), 0.0) for _, lo, hi in children]
    first = gaps[0] <= gaps[-1]
    for order, which in (((0, -1), first), ((-1, 0), ~first)):
        for k in order if len(children) > 1 else order[:1]:
            at = which.nonzero()[0]
            reach = gaps[k][at] <= np.sqrt(best[rows[at]].astype(np.float64)) * (1 + _OUT)
            if reach.any():
                taken += _visit(children[k][0], v, rows[at[reach]], best, code)
    return taken


def nearest(tree: Node, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each row of v, ties to the lower index."""
    best, code = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), np.iinfo(np.int64).max)
    if len(v):
        _visit(tree, v, np.arange(len(v)), best, code)
    return code, best


def assign(books: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, a column a part position. books: (parts, entries, width); v: (rows, parts * width)."""
    parts = v.reshape(len(v), books.shape[0], books.shape[2])
    found = [nearest(build(books[p]), np.ascontiguousarray(parts[:, p])) for p in range(books.shape[0])]
    return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def packed(values: np.ndarray) -> np.ndarray:
    """Integers whose bytes sort as they do: big-endian, from the least 32-bit one."""
    return (values.astype(np.int64) + 2**31).astype(">u4")


def unpacked(data: object) -> np.ndarray:
    return np.frombuffer(data, ">u4").astype(np.int64) - 2**31


def _rows(column: pa.Array) -> np.ndarray:
    """Packed integers of equal length, a row each."""
    return np.array([unpacked(x.as_buffer()) for x in column])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        q = b.column("q")
        values, cuts = packed(q.flatten().to_numpy(zero_copy_only=False)), np.cumsum([0, *[len(x) for x in q]])
        rows = [values[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(cuts), pa.int32()), pa.array(rows, pa.binary())], [*b.schema.names[:-1], "dim", "q"])


def quantised(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """(vec_id, label, dim, q): the vectors that take part, their components as packed 32-bit integers."""
    fit = (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= LIMIT / SCALE), F.lit(False)))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    rows = vectors.where(fit).select("vec_id", "label", q.alias("q"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    whole = scratch.write(rows.mapInArrow(_pack, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, q binary"), "quantised")
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "q").limit(1).collect()
    return whole.where(F.col("dim") == first[0].dim) if first else whole


def _sums(books: np.ndarray):
    """One set of rows a task: (slot, total), the sums of what each entry was assigned; an entry's last slot is its number of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        total = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            v = _rows(b.column(0))
            codes, _ = assign(books, v)
            v = v.reshape(len(v), parts, width)
            for p in range(parts):
                np.add.at(total[p, :, :-1], codes[:, p], v[:, p])
                total[p, :, -1] += np.bincount(codes[:, p], minlength=entries)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], ["slot", "total"])

    return run


def train(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width) from quantised rows; None without any."""
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "q").select("q").limit(ENTRIES).collect()
    if not start:
        return None
    books = np.array([unpacked(r.q) for r in start])
    books = np.ascontiguousarray(books.reshape(len(start), PARTS, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for slot, n in rows.select("q").mapInArrow(_sums(books), "slot long, total long").groupBy("slot").agg(F.sum("total")).collect():
            total.ravel()[slot] = n
        n = total[:, :, -1:]
        books = np.where(n > 0, total[:, :, :-1] // np.maximum(n, 1), books)
    return books


def _encoded(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, away = assign(books, _rows(b.column("q")))
                names = [n for n in b.schema.names if n != "q"]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([bytes(c).hex() for c in codes.astype(np.uint8)]), pa.array(away.sum(axis=1))], [*names, "code", "error"])

    return run


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of quantised rows."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("vec_id", "label", "q").mapInArrow(_encoded(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p, k] for p, k in enumerate(bytes.fromhex(code))])


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256). The result reads tables of `scratch`; without one they last until the driver ends."""
    scratch = scratch or Scratch(vectors.sparkSession, "vector-codes")
    rows = quantised(vectors, scratch)
    books = train(rows)
    if books is None:
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    coded = scratch.write(encode(rows, books), "coded")
    labels = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _round_sql(k: int) -> str:
    """The assignment by the k-th codebooks, and the codebooks after it."""
    return f"""
d{k} AS (SELECT i, b.p, b.e, CAST(list_sum(list_transform(range(1, len(b.v) + 1), lambda j: (s.v[j] - b.v[j]) * (s.v[j] - b.v[j]))) AS BIGINT) AS d FROM parts s JOIN b{k} b USING (p)),
a{k} AS (SELECT i, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM d{k} GROUP BY i, p),
m{k} AS (SELECT p, e, j, sum(x) AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{k} JOIN parts USING (i, p)) GROUP BY p, e, j),
b{k + 1} AS (SELECT b.p, b.e, coalesce(any_value(f.v), any_value(b.v)) AS v FROM b{k} b LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM m{k} GROUP BY p, e) f USING (p, e) GROUP BY b.p, b.e)"""


SQL = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS i, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT i, p, q[p * len(q) // {PARTS} + 1 : (p + 1) * len(q) // {PARTS}] AS v FROM kept, range({PARTS}) r(p)),
b0 AS (SELECT p, i AS e, v FROM parts WHERE i < {ENTRIES}),{",".join(_round_sql(k) for k in range(ROUNDS))},
d AS (SELECT i, b.p, b.e, CAST(list_sum(list_transform(range(1, len(b.v) + 1), lambda j: (s.v[j] - b.v[j]) * (s.v[j] - b.v[j]))) AS BIGINT) AS d FROM parts s JOIN b{ROUNDS} b USING (p)),
a AS (SELECT i, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM d GROUP BY i, p),
c AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY i),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS sum FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sum FROM books) AS codebooks_sha256 FROM kept JOIN c USING (i)
"""
