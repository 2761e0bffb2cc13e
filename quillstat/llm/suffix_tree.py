"""LM scoring with a probabilistic suffix tree (PST) over words.

Tokens: words (runs of characters other than ASCII space, A-Z lower-cased), then one end token a document. The alphabet
is the distinct training tokens and one symbol for every unknown token, as in the base score.

States are contexts of up to DEPTH preceding tokens, of which the first may be the start of the text; the root is the
empty one. Grams of one order are counted a pass over all training texts, the next order after the one before: a gram
occurs FEWEST times only if the grams without its last and without its first token do, so all others are left out
before they are sent. Every context and every row (a context's next token) of FEWEST occurrences is admitted, whatever
the corpus' size, with any word in any place.

Retention: a context stays if it tells its next tokens from its parent's distribution: with each occurrence left out in
turn, the summed log likelihood ratio of its distribution to its parent's must be at least GAIN nats.

Smoothing: P(w | s) = (c(s, w) - DISCOUNT) / c(s) where the row is kept, plus all mass not given to rows times the
parent's P(w). The root gives a known token (c - DISCOUNT) / N and the unknown symbol the sum of all discounts. Each
state's probabilities sum to one.

Scoring: the longest retained suffix of the tokens before is the state. log P(w | s) is the root's plus, for every
order, what the context adds (log of the mass it leaves) and what the row adds: so a text's score is a sum of one number
a gram in it, and texts are scored by one join of their grams with a table of these numbers.

Tables: counts, states and numbers stay in written tables, joined by 64-bit hashes (a word's XXH64; a gram's is Spark's
xxhash64 of the hashes without its last and without its first token). Only two things of bounded size are broadcast and
neither changes a result: a bitmap of hashes (MAP_BITS at most), whose false positives are counted or looked up in vain,
and the numbers of grams with a share of CACHED of all tokens, which are added in place and so never meet in one task.

Blocks: counts, look-ups and numbers are shuffled as packed arrays, one a bucket of hash space and window of WINDOWS
tokens (WINDOWS / 8 numbers), counts summed in their window before; they leave a task by batches of PACKED entries; the number of buckets grows with the texts, so a bucket holds a bounded number of grams at
any size. Texts are cut into windows of whole documents. A window asks every bucket for the numbers of its grams, the
bucket answers with sums by document, and the answers meet again at the window.

Defined cases: a null or empty text is the end token alone; with nothing to learn from, all counts are zero, and the
score is that of unknown symbols, 0 each; equal doc_ids are separate rows; other columns play no part.
"""

from __future__ import annotations

import gc
import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.llm.common import Scratch, bucket_of_id, table, text_of

DEPTH, DISCOUNT, GAIN, FEWEST = 3, 0.5, 30.0, 3
FOLDS = 10
CACHED, MAP_BITS = 2e-7, 1 << 28
#: The hash of what stands before a text: no word holds a space.
START_HASH = xxhash.xxh64_intdigest(b" ")
#: Tokens held before they are passed on; characters of text handled at once; characters of the corpus for one bucket.
WINDOWS, CHARS, BUCKET_CHARS = 1 << 21, 1 << 20, 1 << 22
#: Entries of a batch of packed blocks.
PACKED = 1 << 17


def words_of(text: str) -> list[bytes]:
    """The tokens of a text, the end token last."""
    out = text.encode().lower().split()
    out.append(b"")
    return out


def _parts(texts: pa.Array) -> Iterator[list[str]]:
    """Cuts a column into lists of texts of about CHARS characters together; only the list at hand is turned into strings."""
    part, size = [], 0
    for lo in range(0, len(texts), 64):
        for text in texts.slice(lo, 64).to_pylist():
            part.append(text)
            size += len(text)
            if size >= CHARS:
                yield part
                part, size = [], 0
    if part:
        yield part


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


_NOTHING = np.uint64(0xEF46DB3751D8E999)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = (seed + (_P5 + np.uint64(8))) ^ (_turn(x * _P2, 31) * _P1)
    h = _turn(h, 27) * _P1 + _P4
    return _finish(h)


def _hash_words(data: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The XXH64 of the words at these places of `data`, all of one size at once; words of 32 bytes and more by the library."""
    out = np.empty(len(first), np.uint64)
    padded = data + bytes(8)
    longs, ints = (np.ndarray((len(data) + 1,), kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))
    one = np.frombuffer(data, np.uint8)
    by = np.argsort(np.minimum(size, 32).astype(np.uint8), kind="stable")
    cuts = np.searchsorted(np.minimum(size[by], 32), np.arange(34))
    for n in range(1, 32):
        own = by[cuts[n] : cuts[n + 1]]
        if not len(own):
            continue
        at, done = first[own], 0
        h = np.full(len(own), _P5 + np.uint64(n), np.uint64)
        while n - done >= 8:
            h = _turn(h ^ (_turn(longs[at + done] * _P2, 31) * _P1), 27) * _P1 + _P4
            done += 8
        if n - done >= 4:
            h = _turn(h ^ (ints[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
            done += 4
        while done < n:
            h = _turn(h ^ (one[at + done] * _P5), 11) * _P1
            done += 1
        out[own] = _finish(h)
    for k in by[cuts[32] :].tolist():
        out[k] = xxhash.xxh64_intdigest(data[first[k] : first[k] + size[k]])
    return out


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts on end, each after the start's; the number of each text's hashes. Words are those of words_of."""
    raw = [text.encode() for text in texts]
    data = b"\n" + b"\n".join(raw).lower() + b"\n"
    space = _SPACE[np.frombuffer(data, np.uint8)]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, size = turn[::2], turn[1::2] - turn[::2]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    upto = np.searchsorted(first, ends)
    words = np.diff(upto, prepend=0)
    out = np.empty(len(first) + 2 * len(raw), np.uint64)
    out[np.arange(len(first)) + 2 * np.repeat(np.arange(len(raw)), words) + 1] = _hash_words(data, first, size)
    length = words + 2
    end = np.cumsum(length)
    out[end - length], out[end - 1] = START_HASH, _NOTHING
    return out, length


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of two longs."""
    return _hash_long(b, _hash_long(a, np.full(1, 42, np.uint64)))


def _orders(x: np.ndarray, length: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 2 to `most`: where its grams end, their hashes, and those without the last and the first token."""
    place = np.arange(len(x)) - np.repeat(np.cumsum(length) - length, length)
    grams = x
    for order in range(2, most + 1):
        end = np.flatnonzero(place >= order - 1)
        context, suffix = grams[end - 1], grams[end]
        grams = np.zeros(len(x), np.uint64)
        grams[end] = pair_hash(context, suffix)
        yield end, grams[end], context, suffix


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def bucket_bits(texts: DataFrame) -> int:
    """The number of buckets is 2 to this: a few a shuffle partition, and one for every BUCKET_CHARS characters of all texts (t)."""
    chars = texts.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    wanted = max(4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // BUCKET_CHARS)
    return min((wanted - 1).bit_length(), 24)


def _buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _joined(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Each column of all blocks on end. Empties the list, and lets a column's blocks go before the next one is joined."""
    columns, out = [list(x) for x in zip(*held, strict=True)], []
    held.clear()
    while columns:
        out.append(np.concatenate(columns.pop(0)))
    return out


def _packs(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[list[pa.Array]]:
    """bucket: sorted. The buckets there are, and of each column the bytes of each bucket; about PACKED entries at once, so that what is sent is held neither here nor by Spark as a whole."""
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    lo = 0
    for k in range(1, len(cuts)):
        if k == len(cuts) - 1 or cuts[k] - cuts[lo] >= PACKED:
            spans = list(zip(cuts[lo:k], cuts[lo + 1 : k + 1], strict=True))
            yield [pa.array(bucket[cuts[lo:k]], pa.int32()), *(pa.array([c[i:j].tobytes() for i, j in spans], pa.binary()) for c in columns)]
            lo = k


def _count_blocks(packed: object, order: int, bits: int):
    """(p, ctx, suf, n): per bucket and window the grams of an order whose two parts are in the bitmap, and their counts; of order 1 all words, as ctx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = None if packed is None else np.load(io.BytesIO(packed.value))["bits"]
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            h, *ends = _joined(held)
            by = np.argsort(h)
            h = h[by]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n, first, h = np.diff(starts, append=len(h)).astype(np.uint32), by[starts], h[starts]
            del by, starts
            ends = [x[first] for x in ends] or [h]
            for p, counts, ctx, *suf in _packs(_buckets(h, bits), n, *ends):
                yield pa.RecordBatch.from_arrays([p, ctx, suf[0] if suf else pa.array([b""] * len(p), pa.binary()), counts], ["p", "ctx", "suf", "n"])

        for b in batches:
            for part in _parts(b.column(0)):
                h, length = _hashes(part)
                if order == 1:
                    held.append((h,))
                else:
                    *_, (_, grams, context, suffix) = _orders(h, length, order)
                    on = _in_map(often, context) & _in_map(often, suffix)
                    held.append((grams[on], context[on], suffix[on]))
                size += len(held[-1][0])
                if size >= WINDOWS:
                    yield from out()
                    size = 0
        if size:
            yield from out()

    return run


def _add_up(order: int, fewest: int):
    """Blocks sorted by bucket to (h, ctx, suf, n) rows of at least `fewest` occurrences; holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            context, suffix, n = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held, strict=True), (np.uint64, np.uint64, np.uint32), strict=True))
            h = context if order == 1 else pair_hash(context, suffix)
            by = np.argsort(h)
            h = h[by]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            total = np.add.reduceat(n[by].astype(np.int64), starts)
            starts, total = starts[total >= fewest], total[total >= fewest]
            for lo in range(0, len(total), 1 << 16):
                cut = starts[lo : lo + (1 << 16)]
                first = by[cut]
                yield pa.RecordBatch.from_arrays([_longs(h[cut]), _longs(context[first]), _longs((suffix if order > 1 else context)[first]), pa.array(total[lo : lo + (1 << 16)])], ["h", "ctx", "suf", "n"])

        for b in batches:
            for p, *block in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if p != bucket:
                    if held:
                        yield from out()
                    bucket, held = p, []
                held.append(block)
        if held:
            yield from out()

    return run


def count_grams(texts: DataFrame, order: int, bits: int, often: DataFrame | None = None, fewest: int = 1) -> DataFrame:
    """texts: (t); often: (h), what is long enough to stay of the order before. (h, ctx, suf, n) of the grams of `fewest` occurrences."""
    packed = None if often is None else _packed(texts.sparkSession, bits=_bitmap(often))
    blocks = texts.mapInArrow(_count_blocks(packed, order, bits), "p int, ctx binary, suf binary, n binary")
    return blocks.repartition("p").sortWithinPartitions("p").mapInArrow(_add_up(order, fewest), "h long, ctx long, suf long, n long")


def _in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(64 * len(bits) - 1)
    return ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """hashes: (h). The low bits of all of them, as words of 64 bits; about 16 bits a hash, MAP_BITS at most."""
    size = 1 << 12
    wanted = 16 * hashes.count()
    while size < min(wanted, MAP_BITS):
        size *= 2
    at = F.col("h").bitwiseAND(F.lit(size - 1))
    rows = hashes.select(F.shiftright(at, 6).alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _packed(spark: SparkSession, **arrays: object) -> object:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return spark.sparkContext.broadcast(out.getvalue())


class Tree:
    """Written tables of a trained tree: words (h, n), the start among them; for each depth from 1 states (ctx, left,
    total) that are retained, and rows (h, ctx, suf, n, p, more): all grams of the next order, with the probability of
    the last token after the longest retained suffix, and what a retained state's row adds to the log10 score.
    """

    def __init__(self, words: DataFrame, n: int, v: int) -> None:
        self.words, self.n, self.v = words, n, v
        self.states: list[DataFrame] = []
        self.rows: list[DataFrame] = []

    @property
    def unknown(self) -> float:
        return DISCOUNT * self.v / self.n if self.n else 1.0

    def numbers(self) -> DataFrame:
        """(h, c, v, n): what a gram adds to the log10 score, v; c: a word's count; n: occurrences. A gram that is a row or a word and a context too has two rows, to be added up."""
        none = F.lit(None).cast("long").alias("c")
        found = [self.words.where(F.col("h") != _signed(START_HASH)).select("h", F.col("n").alias("c"), F.log10((F.col("n") - DISCOUNT) / float(max(self.n, 1))).alias("v"), "n")]
        found += [s.select(F.col("ctx").alias("h"), none, F.log10("left").alias("v"), F.col("total").alias("n")) for s in self.states]
        found += [r.where(F.col("more").isNotNull()).select("h", none, F.col("more").alias("v"), "n") for r in self.rows]
        return reduce(DataFrame.unionAll, found)


def _merged(h: np.ndarray, c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by hash, equal ones added up."""
    by = np.argsort(h, kind="stable")
    h = h[by]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    if not len(starts):
        return h, c, v
    return h[starts], np.maximum.reduceat(c[by], starts), np.add.reduceat(v[by], starts)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _learn(grams: DataFrame, before: DataFrame, counts: DataFrame, scratch: Scratch, d: int) -> tuple[DataFrame, DataFrame]:
    """grams: (ctx, suf, n, h) of order d + 1; before: (suf, parent); counts: (ctx, total). The states and rows of depth d.

    Two exchanges of the grams: by suffix, for the parent's distribution, and by context, for its total; what a context's
    rows add up to are windows over the second one, which spill.
    """
    wide = grams.join(before.hint("shuffle_hash"), "suf").join(counts.hint("shuffle_hash"), "ctx")
    own = Window.partitionBy("ctx")
    wide = wide.withColumns({"given": F.sum("n").over(own), "k": F.count("*").over(own), "first": F.min("h").over(own) == F.col("h")})
    wide = wide.withColumn("left", F.greatest(1.0 - (F.col("given") - DISCOUNT * F.col("k")) / F.col("total"), F.lit(1e-12)))
    # Each occurrence left out in turn: its row has one less, the context too.
    without = (F.col("n") - 1 - DISCOUNT + F.col("left") * F.col("total") * F.col("parent")) / F.greatest(F.col("total") - 1, F.lit(1))
    known = F.sum(F.col("n") * F.log(without / F.col("parent"))).over(own)
    other = F.greatest(F.col("total") - F.col("given"), F.lit(0)) * F.log("left")
    p = (F.col("n") - DISCOUNT) / F.col("total") + F.col("left") * F.col("parent")
    rows = wide.withColumn("kept", known + other >= GAIN)
    state = F.when(F.col("kept") & F.col("first"), F.struct("left", "total"))
    rows = rows.select("h", "ctx", "suf", "n", F.when(F.col("kept"), p).otherwise(F.col("parent")).alias("p"), F.when(F.col("kept"), F.log10(p / F.col("left") / F.col("parent"))).alias("more"), state.alias("state"))
    rows = scratch.write(rows, f"rows-{d}")
    states = scratch.write(rows.where(F.col("state").isNotNull()).select("ctx", "state.left", "state.total"), f"states-{d}")
    scratch.remove(f"grams-{d}")
    return states, rows.drop("state")


def _release(spark: SparkSession) -> None:
    """Shuffle files of finished passes go once the driver finds that nothing refers to them; asked for here, as a later pass needs their space."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def grow(docs: DataFrame, scratch: Scratch, depth: int = DEPTH, bits: int | None = None) -> Tree:
    """docs: (text). Counts and learns in written tables; bits: see bucket_bits."""
    spark = docs.sparkSession
    texts = docs.select(text_of().alias("t"))
    bits = bucket_bits(texts) if bits is None else bits
    words = scratch.write(count_grams(texts, 1, bits).select("h", "n"), "words")
    token = words.where(F.col("h") != _signed(START_HASH))
    tree = Tree(words, *token.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())
    often, parent = words.where(F.col("n") >= FEWEST), token.where(F.col("n") >= FEWEST).select(F.col("h").alias("suf"), ((F.col("n") - DISCOUNT) / float(max(tree.n, 1))).alias("parent"))
    for d in range(1, depth + 1):
        grams = scratch.write(count_grams(texts, d + 1, bits, often.select("h"), FEWEST), f"grams-{d}")
        _release(spark)
        states, rows = _learn(grams, parent, often.select(F.col("h").alias("ctx"), F.col("n").alias("total")), scratch, d)
        tree.states.append(states)
        tree.rows.append(rows)
        often, parent = rows, rows.select(F.col("h").alias("suf"), F.col("p").alias("parent"))
        _release(spark)
    return tree


def _position(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted number stands in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


NUMBER, GRAM, WORD, DOCS = range(4)
_SENT = "p int, kind int, w long, keys binary, docs binary, ids array<long>"
_SENT_ARROW = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("w", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("ids", pa.list_(pa.int64()))])
_FOUND = "w long, kind int, p int, docs binary, score binary, base binary, known binary, ids array<long>"
_FOUND_ARROW = pa.schema([("w", pa.int64()), ("kind", pa.int32()), ("p", pa.int32()), ("docs", pa.binary()), ("score", pa.binary()), ("base", pa.binary()), ("known", pa.binary()), ("ids", pa.list_(pa.int64()))])
_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _record(schema: pa.Schema, n: int, **columns: object) -> pa.RecordBatch:
    """A batch of n rows; columns that are not given are null."""
    given = {k: v if isinstance(v, pa.Array) else pa.array(v, schema.field(k).type) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def _base(count: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((count + 0.1) / (n + 0.1 * (v + 1)))


def _ask(packed: object, n: int, v: int, depth: int, bits: int):
    """Per window w: a row of its documents with their sums over cached grams, and for each bucket the other words, and grams that may have a number, with the window's document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.load(io.BytesIO(packed.value))
        often, key, value, own_base = x["bits"], x["h"], x["v"], _base(x["c"], n, v)
        window = TaskContext.get().partitionId() << 32
        ids, tokens, asked, parts = [], 0, {GRAM: [], WORD: []}, []

        def add(h: np.ndarray, doc: np.ndarray, kind: int, sums: np.ndarray) -> None:
            at = _position(key, h.view(np.int64))
            on, off = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            sums[2] += np.bincount(doc[on], value[at[on]], sums.shape[1])
            if kind == WORD:
                sums[0] += np.bincount(doc[on], minlength=sums.shape[1])
                sums[1] += np.bincount(doc[on], own_base[at[on]], sums.shape[1])
            asked[kind].append((h[off], (doc[off] + len(ids)).astype(np.uint32)))

        def out() -> Iterator[pa.RecordBatch]:
            length, known, base, total = np.concatenate(parts, axis=1)
            yield _record(_SENT_ARROW, 1, p=[window % (1 << bits)], kind=[DOCS], w=[window], ids=[ids], keys=[length.tobytes()], docs=[np.stack([known, base, total]).tobytes()])
            for kind, found in asked.items():
                h, doc = _joined(found)
                if len(h):
                    bucket = _buckets(h, bits)
                    by = np.argsort((bucket << 32) | doc, kind="stable")
                    h, doc, bucket = h[by], doc[by], bucket[by]
                    del by
                    step = np.diff(doc, prepend=doc[:1] * 0)
                    turn = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
                    step[turn] = doc[turn]
                    for p, keys, docs in _packs(bucket, h, step):
                        yield _record(_SENT_ARROW, len(p), p=p, kind=[kind] * len(p), w=[window] * len(p), keys=keys, docs=docs)

        for b in batches:
            doc_ids, done = b.column(0).to_pylist(), 0
            for part in _parts(b.column(1)):
                h, length = _hashes(part)
                doc, first = np.repeat(np.arange(len(part)), length), np.cumsum(length) - length
                word = np.ones(len(h), bool)
                word[first] = False
                sums = np.zeros((3, len(part)))
                add(h[word], doc[word], WORD, sums)
                for end, grams, *_ in [(first, h[first]), *_orders(h, length, depth + 1)]:
                    on = _in_map(often, grams)
                    add(grams[on], doc[end[on]], GRAM, sums)
                parts.append(np.concatenate([[length - 1.0], sums]))
                ids += doc_ids[done : done + len(part)]
                done, tokens = done + len(part), tokens + len(h)
                if tokens >= WINDOWS:
                    yield from out()
                    window, ids, tokens, asked, parts = window + 1, [], 0, {GRAM: [], WORD: []}, []
        if ids:
            yield from out()

    return run


def _number_blocks(bits: int):
    """(h, c, v) to blocks, one a bucket and WINDOWS / 8 numbers: the hashes, and their counts and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            h, c, v = _joined(held)
            by = np.argsort(h)
            h = h[by]
            for p, keys, counts, values in _packs(_buckets(h, bits), h, c[by], v[by]):
                both = pa.array([a.as_py() + b.as_py() for a, b in zip(counts, values, strict=True)], pa.binary())
                yield _record(_SENT_ARROW, len(p), p=p, kind=[NUMBER] * len(p), keys=keys, docs=both)

        for b in batches:
            held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()))
            size += b.num_rows
            if size >= WINDOWS // 8:
                yield from out()
                size = 0
        if size:
            yield from out()

    return run


def _answer(n: int, v: int, unknown: float):
    """Rows sorted by bucket, its numbers first, to sums by document for each block asked; holds one bucket's numbers. Document rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, numbers, table = None, [], None
        for b in batches:
            p, kind = b.column("p").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(p)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if p[i] != bucket:
                    bucket, numbers, table = p[i], [], None
                if kind[i] == NUMBER:
                    for keys, both in zip(b.column("keys")[i:j], b.column("docs")[i:j], strict=True):
                        h = np.frombuffer(keys.as_py(), np.int64)
                        numbers.append([h, np.frombuffer(both.as_py(), np.int64, len(h)), np.frombuffer(both.as_py(), np.float64, offset=8 * len(h))])
                    continue
                rows = b.slice(i, j - i)
                if kind[i] == DOCS:
                    yield _record(_FOUND_ARROW, j - i, w=rows.column("w"), kind=rows.column("kind"), p=rows.column("p"), docs=rows.column("keys"), score=rows.column("docs"), ids=rows.column("ids"))
                    continue
                if table is None:
                    table = _merged(*(np.concatenate(y) for y in zip(*numbers, strict=True))) if numbers else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                h, c, value = table
                found = []
                for keys, docs in zip(rows.column("keys"), rows.column("docs"), strict=True):
                    at = _position(h, np.frombuffer(keys.as_buffer(), np.int64))
                    step = np.frombuffer(docs.as_buffer(), np.uint32)
                    starts = np.flatnonzero((step > 0) | (np.arange(len(step)) == 0))
                    none = np.log10(unknown) if kind[i] == WORD else 0.0
                    score = np.where(at >= 0, value[at], none) if len(h) else np.full(len(at), none)
                    sums = [step[starts].tobytes(), np.add.reduceat(score, starts).tobytes(), None, None]
                    if kind[i] == WORD:
                        count = np.where(at >= 0, c[at], 0) if len(h) else np.zeros(len(at), np.int64)
                        sums[2:] = np.add.reduceat(_base(count, n, v), starts).tobytes(), np.add.reduceat((count > 0).astype(np.uint32), starts).astype(np.uint32).tobytes()
                    found.append(sums)
                docs, score, base, known = zip(*found, strict=True)
                yield _record(_FOUND_ARROW, j - i, w=rows.column("w"), kind=rows.column("kind"), p=rows.column("p"), docs=docs, score=score, base=base, known=known)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window, its documents first, to one row a document."""
    now, ids, length, sums = None, None, None, None

    def out() -> pa.RecordBatch:
        whole = (pa.array(ids, pa.int64()), pa.array(length.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]))
        return pa.RecordBatch.from_arrays(list(whole), ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    for b in batches:
        for w, kind, _, docs, score, base, known, its_ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if w != now:
                if now is not None:
                    yield out()
                now, ids, length, sums = w, its_ids, np.frombuffer(docs), np.frombuffer(score).reshape(3, -1).copy()
                continue
            at = np.cumsum(np.frombuffer(docs, np.uint32), dtype=np.int64)
            sums[2, at] += np.frombuffer(score)
            if kind == WORD:
                sums[1, at] += np.frombuffer(base)
                sums[0, at] += np.frombuffer(known, np.uint32)
    if now is not None:
        yield out()


def score(docs: DataFrame, learn: Column, depth: int = DEPTH, cached: float = CACHED) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`, learning from those with `learn`."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-tree")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    bits = bucket_bits(source)
    tree = grow(docs.where(learn), scratch, depth, bits)
    numbers = tree.numbers()
    hot = numbers.where(F.col("n") >= max(FEWEST, cached * tree.n)).select("h", F.coalesce("c", F.lit(0)).alias("c"), "v").toArrow()
    h, c, own = _merged(*(hot[name].to_numpy() for name in ("h", "c", "v")))
    # A hash of no word has a number if it is a gram or the start; that of a word is met as a word only.
    packed = _packed(spark, bits=_bitmap(numbers.where(F.col("c").isNull()).select("h")), h=h, c=c, v=own)
    _release(spark)
    asked = source.mapInArrow(_ask(packed, tree.n, tree.v, depth, bits), _SENT)
    known = numbers.select("h", F.coalesce("c", F.lit(0)).cast("long").alias("c"), "v").mapInArrow(_number_blocks(bits), _SENT)
    met = asked.unionAll(known).repartition("p").sortWithinPartitions(F.col("p") * 4 + F.col("kind"))  # one number is sorted by its digits
    answers = met.mapInArrow(_answer(tree.n, tree.v, tree.unknown), _FOUND)
    # A window's documents come first: their kind is the highest.
    out = answers.repartition("w").sortWithinPartitions("w", F.desc("kind"), "p").mapInArrow(_gather, _SCORED)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, bucket_of_id("doc_id", FOLDS) != 0)
    return out.select("doc_id", (bucket_of_id("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
