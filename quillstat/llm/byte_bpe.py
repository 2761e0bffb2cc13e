"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is cut into pieces by the vocabulary's pattern; a piece that is a token is that token, any other starts as single
bytes. A segment tree over the piece's byte positions stores, at each node, the leftmost minimum rank of the pairs that
start below it (the rank of a pair is the id of the token its two parts spell). A merge takes the root's pair, then
updates two leaves, that of the merged token and that of its live left neighbour, and kills the right part's leaf: each a
path of log2(n) nodes. Live neighbours are kept in two link arrays. Many pieces of one length class are merged at once,
one lane each, so that a step is a handful of array operations.

The ids of a chunk of text between spaces never depend on what stands around it but for one leading space, so workers
memoise chunks (beyond MEMO entries the half met first is kept).

Defined cases: a null or empty text has no ids; a lone surrogate cannot occur in Spark strings; special tokens' strings
are ordinary text; repeated rows give repeated result rows; an empty table gives no rows; a
long text is encoded whole, in memory of a few times its size, and so is one long chunk; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import table, text_of

MEMO = 600_000
#: Texts whose unknown chunks are merged together.
TEXTS = 256
#: Lanes times leaves of one segment-tree array at most.
LANE_CELLS = 1 << 20
#: Below so many pieces of a length class, each is merged by itself.
FEW = 24
_NONE = np.int32(2**31 - 1)
#: White space as the vocabulary's pattern sees it (Unicode White_Space), runs of it and of all else.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"[^{_SPACE}]+|[{_SPACE}]+")
#: Where none of these occurs, and no space or line feed at either end, words are parted by one space or line feed each.
_ODD = ["  ", "\n\n", " \n", "\n ", *"\t\x0b\x0c\r"]
_ODD_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _stand_ins() -> dict[int, str]:
    """Characters that the rank library's pattern engine, with its own Unicode version, puts in another class than ours: each with a character of that class."""
    import tiktoken

    every = "".join(map(chr, (c for c in range(0x80, 0x40000) if not 0xD800 <= c < 0xE000)))
    single = {bytes([b]): b for b in range(256)}

    def theirs(kind: str) -> set[str]:
        return set(bytes(tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())

    found: dict[int, str] = {}
    sets = {stand_in: (theirs(kind), set(regex.findall(kind, every))) for kind, stand_in in ((r"\p{L}", "Ω"), (r"\p{N}", "²"), (r"\s", "\u3000"))}
    for stand_in, (there, here) in sets.items():
        found |= {ord(c): stand_in for c in there - here}
        found |= {ord(c): "¶" for c in here - there if ord(c) not in found}
    return {c: next((s for s, (there, _) in sets.items() if chr(c) in there), "¶") for c in found}


class ByteBPE:
    """An encoder over `ranks` (token bytes -> id) with pre-splitting pattern `pattern`."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.width = max(ranks.values()) + 1
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = i
        self.pairs = pairs
        self.pair_keys = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
        self.pair_ranks = np.fromiter((pairs[k] for k in self.pair_keys.tolist()), np.int32, len(pairs))
        self.memo: dict[str, bytes] = {}
        self.stand_ins = _stand_ins()

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; _NONE where it spells no token or a side is absent (-1)."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], _NONE)

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """ids, as little-endian uint32 bytes, of pieces of 2 bytes and more whose lengths share a power of two."""
        lanes, longest = len(pieces), max(map(len, pieces))
        leaves = 1 << (longest - 1).bit_length()
        length = np.fromiter(map(len, pieces), np.int64, lanes)
        ids = np.full((lanes, leaves), -1, np.int64)
        inside = np.arange(leaves) < length[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        left = np.tile(np.arange(-1, leaves - 1), (lanes, 1))
        right = np.tile(np.arange(1, leaves + 1), (lanes, 1))
        right[np.arange(lanes), length - 1] = -1
        tree = np.full((lanes, 2 * leaves), _NONE, np.int32)
        tree[:, leaves : 2 * leaves - 1] = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(lanes, leaves - 1)
        size = leaves
        while size > 1:
            tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
            size //= 2
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            least = tree[live, 1]
            node = np.ones(len(live), np.int64)
            while node[0] < leaves:  # the leftmost leaf that holds the minimum
                node = 2 * node + (tree[live, 2 * node] != least)
            at = node - leaves
            gone = right[live, at]
            after, before = right[live, gone], left[live, at]
            ids[live, at], ids[live, gone] = least, -1
            right[live, at] = after
            has = after >= 0
            left[live[has], after[has]] = at[has]
            after_id = np.where(has, ids[live, after], -1)
            before_id = np.where(before >= 0, ids[live, before], -1)
            new = least.astype(np.int64)
            for leaf, rank in ((at, self.pair_rank(new, after_id)), (gone, np.full(len(live), _NONE, np.int32)), (before, self.pair_rank(before_id, new))):
                on = leaf >= 0
                lane, node, value = live[on], leaf[on] + leaves, rank[on]
                tree[lane, node] = value
                while len(node) and node[0] > 1:
                    node = node >> 1
                    tree[lane, node] = np.minimum(tree[lane, 2 * node], tree[lane, 2 * node + 1])
            live = live[tree[live, 1] < _NONE]
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [flat[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def _merge_one(self, piece: bytes) -> bytes:
        """The same for one piece, over plain lists: quicker where there are few lanes."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        leaves = 1 << (n - 1).bit_length()
        row = np.full(leaves, _NONE, np.int32)
        row[: n - 1] = self.pair_rank(ids[:-1], ids[1:])
        levels = [row]
        while len(row) > 1:
            row = np.minimum(row[::2], row[1::2])
            levels.append(row)
        tree = [0, *np.concatenate(levels[::-1]).tolist()]
        ids, left, right = ids.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        pairs, width, none = self.pairs, self.width, int(_NONE)
        while (least := tree[1]) < none:
            node = 1
            while node < leaves:
                node *= 2
                node += tree[node] != least
            at = node - leaves
            gone, before = right[at], left[at]
            after = right[gone]
            ids[at], ids[gone], right[at] = least, -1, after
            new = none
            if after >= 0:
                left[after] = at
                new = pairs.get(least * width + ids[after], none)
            changed = [(at, new), (gone, none)]
            if before >= 0:
                changed.append((before, pairs.get(ids[before] * width + least, none)))
            for leaf, rank in changed:
                node = leaf + leaves
                tree[node] = rank
                while node > 1:
                    a, b = tree[node], tree[node ^ 1]
                    node >>= 1
                    low = a if a < b else b
                    if tree[node] == low:
                        break
                    tree[node] = low
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        found, classes = {}, {}
        for p in pieces:
            if (i := self.ranks.get(p)) is not None:
                found[p] = i.to_bytes(4, "little")
            else:
                classes.setdefault((len(p) - 1).bit_length(), []).append(p)
        for power, group in classes.items():
            if len(group) < FEW:
                found.update((p, self._merge_one(p)) for p in group)
                continue
            lanes = max(1, LANE_CELLS >> power)
            for k in range(0, len(group), lanes):
                part = group[k : k + lanes]
                found.update(zip(part, self._merge(part), strict=True))
        return found

    def _cut(self, chunk: str) -> list[bytes]:
        if chunk.isascii() or (shown := chunk.translate(self.stand_ins)) == chunk:
            return [x.encode() for x in self.pattern.findall(chunk)]
        return [chunk[m.start() : m.end()].encode() for m in self.pattern.finditer(shown)]

    def _learn(self, chunks: list[str]) -> None:
        """Adds chunks to the memo."""
        cut = [self._cut(c) for c in chunks]
        ids = self._pieces(list({p for pieces in cut for p in pieces}))
        for c, pieces in zip(chunks, cut, strict=True):
            self.memo[c] = b"".join([ids[p] for p in pieces])

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Cuts a text where the pattern always cuts: runs of other characters, each with the one space before it, and the white space left between."""
        plain = not text or text[0] not in " \n" and text[-1] not in " \n"
        if plain and not any(x in text for x in _ODD) and (text.isascii() or not any(x in text for x in _ODD_WIDE)):
            lines = [line.split(" ") for line in text.split("\n")]
            out = []
            for words in lines:
                out.append("\n")
                out.append(words[0])
                out += [" " + w for w in words[1:]]
            return out[1:] if text else []
        runs, out, space = _RUNS.findall(text), [], ""
        for k, run in enumerate(runs):
            if not run[0].isspace() or "\x1c" <= run[0] <= "\x1f":
                out.append(space + run)
                space = ""
            elif k == len(runs) - 1:
                out.append(run)
            else:
                space = " " if run[-1] == " " else ""
                if len(run) > 1:
                    out.append(run[:-1])
                if not space:
                    out.append(run[-1])
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        out: list[bytes] = []
        for k in range(0, len(texts), TEXTS):
            cut = [self.chunks(text) for text in texts[k : k + TEXTS]]
            if len(self.memo) > MEMO:  # the chunks met first are mostly the frequent ones
                self.memo = dict(islice(self.memo.items(), MEMO // 2))
            if missing := {c for chunks in cut for c in chunks}.difference(self.memo):
                self._learn(list(missing))
            out += [b"".join(map(self.memo.__getitem__, chunks)) for chunks in cut]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[tuple[str, str], ByteBPE] = {}


def coder(vocabulary: str, pattern: str) -> ByteBPE:
    """The encoder for a rank file (base64 token, rank on each line); built once in a process."""
    if (vocabulary, pattern) not in _CODERS:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _CODERS[vocabulary, pattern] = ByteBPE(ranks, pattern)
    return _CODERS[vocabulary, pattern]


def _encode(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for b in batches:
            ids = bpe.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids are little-endian uint32 bytes. `vocabulary` is the path of a rank file on every machine."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")).mapInArrow(_encode(vocabulary, pattern), "doc_id long, ids binary")


def _decode(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for b in batches:
            texts = [bpe.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return run


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, decoded): the bytes that ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(vocabulary, pattern), "doc_id long, decoded binary")


def _digest(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for b in batches:
            ids = bpe.encode_batch(b.column(1).to_pylist())
            sha = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encodes, decodes the ids, and returns digests of both a row (doc_id, n_tokens, ids_sha256, decoded_sha256) in one pass."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")).mapInArrow(_digest(vocabulary, pattern), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
