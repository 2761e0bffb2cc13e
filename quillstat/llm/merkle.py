"""Merkle dataset manifest: contiguous numpy digest matrices.

A leaf is the SHA-256 (hex) of a document's fields, each with its length. The leaves of a language, in the order of their
doc_ids, form a tree: every FANOUT consecutive nodes, the last run maybe fewer, become the hash of their joined hex
digests, until one node is left, the language's subroot; the subroots, in the order of the languages, form the tree of
the dataset's root in the same way.

Leaves get their places by a range sort: each partition counts what it holds of a tree, the sums before it are its
offsets. FANOUT ** LEVELS consecutive, aligned places are a block: one contiguous matrix of 64 hex bytes a digest, reshaped by the
fanout and hashed row by row, level by level. The tops of the blocks are the next round's nodes, so there are
log(rows) / log(block) rounds, each written. On the way down every block gets the siblings above it; those inside it are
slices of the matrices, found by index arithmetic. No task holds more than a block, whatever its tree's size: a
language with all rows is as many blocks as any other rows are.

Defined cases: null fields are hashed as `-`; a null doc_id comes first in its tree, and its check sum is that of no
digits, 0; rows of one doc_id are ordered by their leaves; rows equal in all fields travel as one run with their number
and get a place and a proof each; an empty text is `0:`; a text of any length is hashed whole by the scan and goes no
further; a lone leaf is its subroot, a lone subroot the root, and a proof without siblings the hash of nothing; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.llm.common import ASCII_LOWER, ASCII_UPPER, Scratch, bucket_of_id, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A block has FANOUT ** LEVELS places.
FANOUT, LEVELS, HEX = 8, 4, 64
_PATH = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """A field as it is hashed: its length in bytes, a colon and its text; `-` if null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(text if name == "text" else F.col(name)) for name in FIELDS]), 256)


def depth(total: int, most: int) -> int:
    """The levels above its nodes, `most` at most, that a block of a tree of so many nodes holds."""
    n = 0
    while total > 1 and n < most:
        total, n = -(-total // FANOUT), n + 1
    return n


def levels(nodes: bytes, deep: int) -> list[bytes]:
    """The block's hex digests of each level, from its nodes up: whole runs are rows of the matrix reshaped by the fanout."""
    out = [nodes]
    for _ in range(deep):
        m = np.frombuffer(out[-1], np.uint8).reshape(-1, HEX)
        whole = len(m) // FANOUT * FANOUT
        up = [sha256(row).hexdigest() for row in m[:whole].reshape(-1, FANOUT * HEX)]
        if whole < len(m):
            up.append(sha256(m[whole:]).hexdigest())
        out.append("".join(up).encode())
    return out


def siblings(level: bytes) -> list[tuple[bytes, bytes]]:
    """For each node of a level, the digests of its run before and after it."""
    out = []
    for k in range(len(level) // HEX):
        lo = k - k % FANOUT
        out.append((level[lo * HEX : k * HEX], level[(k + 1) * HEX : (lo + FANOUT) * HEX]))
    return out


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition (tree, n, ...): how many of its tree come before each one in it."""
    tree, held = None, 0
    for b in batches:
        at = []
        for t, n in zip(b.column("tree").to_pylist(), b.column("n").to_pylist(), strict=True):
            if t != tree:
                tree, held = t, 0
            at.append(held)
            held += n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], [*b.schema.names, "at"])


def _placed(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Rows (tree, n, ...) with `at`, the first of their n places in their tree, and `total`, the places of the tree."""
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    within = scratch.write(dealt.mapInArrow(_places, f"{fields}, at long"), name)
    parts = within.groupBy("tree", "part").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy("tree")).alias("total"))
    return within.join(parts, ["tree", "part"]).withColumn("at", F.col("at") + F.col("before")).drop("part", "before")


def _packed(most: int):
    """A block's rows (tree, block, total, lo, n, id, leaf, other) as one, with its top."""

    def run(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("lo")
        n, total = nodes.column("n").to_numpy(), nodes.column("total")[0].as_py()
        leaves, others = ("".join(nodes.column(c).to_pylist()).encode() for c in ("leaf", "other"))
        top = levels(_spread(leaves, n), depth(total, most))[-1]
        values = [[nodes.column("tree")[0].as_py()], [nodes.column("block")[0].as_py()], [total], [nodes.column("id").to_pylist()], [n.tolist()], [leaves], [others], [top.decode()]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, _BLOCKS, strict=True)], schema=_BLOCKS)

    return run


_BLOCKS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("leaves", pa.binary()), ("others", pa.binary()), ("top", pa.string())])


def _spread(digests: bytes, n: np.ndarray) -> bytes:
    """Each digest as often as its run is long."""
    return np.repeat(np.frombuffer(digests, np.uint8).reshape(-1, HEX), n, axis=0).tobytes()


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows (tree, at, n, total, id, leaf, other), cut at the bounds of the blocks and put together by block."""
    size = FANOUT**most
    end = F.col("at") + F.col("n")
    cut = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((end - 1) / size))))
    first, last = F.greatest("at", F.col("block") * size), F.least(end, (F.col("block") + 1) * size)
    cut = cut.select("tree", "block", "total", (first - F.col("block") * size).cast("int").alias("lo"), (last - first).cast("int").alias("n"), "id", "leaf", "other")
    return cut.groupBy("tree", "block").applyInArrow(_packed(most), "tree string, block long, total long, ids array<long>, n array<int>, leaves binary, others binary, top string")


def _down(most: int):
    """Blocks (tree, total, ids, leaves, subroot, path): the siblings above each node, which is itself a block of the round below."""
    steps = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, total, ids, leaves, subroot, path in zip(*(b.column(c).to_pylist() for c in ("tree", "total", "ids", "leaves", "subroot", "path")), strict=True):
                inside = [siblings(x) for x in levels(leaves, depth(total, most))[:-1]]
                paths = [[{"l": l.decode(), "r": r.decode()} for l, r in (s[k // FANOUT**d] for d, s in enumerate(inside))] + path for k in range(len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(ids)), pa.array(ids, pa.int64()), pa.array([subroot] * len(ids), pa.string()), pa.array(paths, steps)], ["tree", "block", "subroot", "path"])

    return run


def _proved(root: str | None, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for total, ids, n, leaves, others, subroot, path in zip(*(b.column(c).to_pylist() for c in ("total", "ids", "n", "leaves", "others", "subroot", "path")), strict=True):
                inside = [siblings(x) for x in levels(_spread(leaves, np.array(n)), depth(total, most))[:-1]]
                above = [(s["l"].encode(), s["r"].encode()) for s in path]
                rest = b"".join(l + r for l, r in above)
                runs, rows = np.repeat(np.arange(len(n)), n).tolist(), []
                for k, run_of in enumerate(runs):
                    own = [s[k // FANOUT**d] for d, s in enumerate(inside)]
                    digest = others[run_of * HEX : (run_of + 1) * HEX]
                    for l, r in own + above:
                        digest = sha256(l + digest + r).hexdigest().encode()
                    proof = sha256(b"".join(l + r for l, r in own) + rest).hexdigest()
                    rows.append((ids[run_of], leaves[run_of * HEX : (run_of + 1) * HEX].decode(), subroot, root, proof, digest.decode(), digest.decode() == root))
                types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _OUT)

    return run


_OUT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _rounds(rows: DataFrame, most: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round from the rows up, and (tree, top), what is left of each tree."""
    found, tops, size = [], None, FANOUT**most
    while True:
        blocks = scratch.write(_blocks(rows, most), f"{name}-{len(found)}")
        found.append(blocks)
        done = blocks.where(F.col("total") <= size).select("tree", "top")
        tops = done if tops is None else tops.unionByName(done)
        more = blocks.where(F.col("total") > size)
        if more.isEmpty():
            return found, tops
        rows = more.select("tree", F.col("block").alias("at"), F.lit(1).alias("n"), F.ceil(F.col("total") / size).alias("total"), F.col("block").alias("id"), F.col("top").alias("leaf"), F.lit("").alias("other"))


def _below(blocks: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """(tree, block, subroot, path) of the nodes of blocks whose own paths are given."""
    held = blocks.select("tree", "block", "total", "ids", "leaves").join(paths, ["tree", "block"])
    return held.select("tree", "total", "ids", "leaves", "subroot", "path").mapInArrow(_down(most), f"tree string, block long, subroot string, path {_PATH}")


def _paths(rounds: list[DataFrame], above: DataFrame, most: int, scratch: Scratch, name: str) -> DataFrame:
    """(tree, block, subroot, path) of the blocks of the lowest round. above: (tree, subroot, path) of the trees' tops; a tree has its top in its last round."""
    path = None
    for k in reversed(range(len(rounds))):
        own = rounds[k].where(F.col("total") <= FANOUT**most).select("tree", "block").join(above, "tree").select("tree", "block", "subroot", "path")
        path = own if path is None else path.unionByName(own)
        if k:
            path = scratch.write(_below(rounds[k], path, most), f"{name}-path-{k}")
    return path


def manifest(docs: DataFrame, other_text: Column | None = None, scratch: Scratch | None = None, most: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row a document.

    folded_root is what the proof makes of the leaf with `other_text` in place of the text: the root, if the text is the
    same (or none is given). A block holds `most` levels. The result reads tables of `scratch`; without one they last until the driver ends.
    """
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    text = F.col("text")
    rows = docs.select(field(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf(text).alias("leaf"), F.when(other_text.eqNullSafe(text), None).otherwise(leaf(other_text)).alias("other") if other_text is not None else F.lit(None).cast("string").alias("other"))
    rows = rows.withColumn("other", F.coalesce("other", "leaf")).groupBy("tree", "id", "leaf", "other").agg(F.count("*").alias("n"))
    rounds, tops = _rounds(_placed(rows, ["id", "leaf"], scratch, "leaves"), most, scratch, "blocks")
    tops = scratch.write(tops, "tops")
    # The languages' order: none first, then by name.
    named = tops.select(F.lit("").alias("tree"), F.lit(1).cast("long").alias("n"), (F.col("tree") != "-").alias("named"), F.expr("substring(tree, instr(tree, ':') + 1)").alias("name"), F.col("tree").alias("of"), "top")
    langs = _placed(named, ["named", "name"], scratch, "langs")
    langs = scratch.write(langs.select("tree", "at", "n", "total", F.col("at").alias("id"), F.col("top").alias("leaf"), F.lit("").alias("other"), "of"), "placed-langs")
    root_rounds, roots = _rounds(langs.drop("of"), most, scratch, "roots")
    found = roots.collect()  # one row, or none of an empty table
    root = found[0].top if found else None
    start = roots.select("tree", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(_PATH).alias("path")).withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
    above = _below(root_rounds[0], _paths(root_rounds, start, most, scratch, "roots"), most).select(F.col("block").alias("at"), "path")
    above = scratch.write(langs.join(above, "at").select(F.col("of").alias("tree"), F.col("leaf").alias("subroot"), "path"), "above")
    proofs = rounds[0].select("tree", "block", "total", "ids", "n", "leaves", "others").join(_paths(rounds, above, most, scratch, "blocks"), ["tree", "block"])
    return proofs.mapInArrow(_proved(root, most), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered(text: Column) -> Column:
    """A text with A-Z lower-cased where 3 divides the check sum of doc_id."""
    return F.when(bucket_of_id("doc_id", 3) == 0, F.translate(text, ASCII_UPPER, ASCII_LOWER)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents").select(*FIELDS), tampered(F.col("text")))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS[:-1]) + " || " + _FIELD.replace("{0}", "{text}") + ")"
_UP = "SELECT {key}, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM {of} WHERE n > 1 GROUP BY {key}, level, pos // 8, n"
_SIBS = """SELECT {key}, level, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {of} WHERE n > 1 WINDOW w AS (PARTITION BY {key}, level, pos // 8 ORDER BY pos)"""
SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) b(i)),
sums AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN 0 ELSE xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295)) END AS sum FROM documents, crc),
leaves AS (
  SELECT lang, doc_id, {_LEAF.replace("{text}", "text")} AS leaf, {_LEAF.replace("{text}", "other")} AS forged
  FROM (SELECT *, CASE WHEN sum % 3 = 0 THEN translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}') ELSE text END AS other FROM sums)),
placed AS (
  SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes(lang, level, pos, n, h) AS (
  SELECT lang, 0, pos, n, leaf FROM placed UNION ALL {_UP.format(key="lang", of="nodes")}),
langs AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(one, level, pos, n, h) AS (
  SELECT 1, 0, pos, n, h FROM langs UNION ALL {_UP.format(key="one", of="tops")}),
low AS ({_SIBS.format(key="lang", of="nodes")}),
high AS ({_SIBS.format(key="one", of="tops")}),
steps AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY part, level) AS i, l, r FROM (
    SELECT k, 0 AS part, level, l, r FROM placed p JOIN low s ON s.lang IS NOT DISTINCT FROM p.lang AND s.pos = p.pos // CAST(pow(8, level) AS BIGINT)
    UNION ALL SELECT k, 1, level, l, r FROM placed p JOIN langs g ON g.lang IS NOT DISTINCT FROM p.lang JOIN high s ON s.pos = g.pos // CAST(pow(8, level) AS BIGINT))),
folds(k, i, h) AS (
  SELECT k, CAST(0 AS BIGINT), forged FROM placed UNION ALL SELECT f.k, f.i + 1, sha256(s.l || f.h || s.r) FROM folds f JOIN steps s ON s.k = f.k AND s.i = f.i + 1),
folded AS (SELECT k, arg_max(h, i) AS folded_root FROM folds GROUP BY k),
proofs AS (SELECT k, sha256(string_agg(l || r, '' ORDER BY i)) AS proof FROM steps GROUP BY k)
SELECT p.doc_id, p.leaf, g.h AS subroot, t.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM placed p JOIN langs g ON g.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT h FROM tops WHERE n = 1) t ON true JOIN folded USING (k) LEFT JOIN proofs USING (k)
"""
