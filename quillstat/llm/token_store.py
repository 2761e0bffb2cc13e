"""Token-ID output: a content-addressed store of id streams.

Encoding: the `tokenizers` library's file, without special tokens, and one end id a document. Ids are kept as
little-endian unsigned integers of `width` bytes (2 where the vocabulary allows it, else 4).

Chunking: a polynomial rolling hash over the last WINDOW ids cuts a document's stream where the hash's low bits are zero
(1 position in MEAN), with MIN to MAX ids a chunk, so equal passages give equal chunks wherever they stand. A chunk's
address is its SHA-256.

Layout (`write_store`): Parquet files in ascending doc_id order. A document row holds its recipe (the lengths and
addresses of its chunks), their Merkle root, its offset in the file's id stream, and the bytes of the chunks that it
owns. A chunk that several documents hold is owned by one of them and stored only there. `flags` says for each chunk:
0 owned, 1 owned and used by others, 2 stored elsewhere, 3 a repeat of one earlier in the document. Each file ends with a
manifest row: the number of its documents and ids, and the Merkle root over its documents' roots. Beside the files, at
`<path>-manifest`, one row holds the same of the whole store, its root over the files' roots.

Only chunk addresses are shuffled to find owners, never their bytes; the bytes move once, to be put in order.

Reading: `verify` checks the store against its manifests: every file's documents, ids, offsets and Merkle root, and all
files against the whole store's. `read_checksums` does so, checks every stored chunk against its address and every recipe against its Merkle root, and returns each document's place and CRC-32. It carries the CRCs of runs of chunks
over the join, not chunk bytes, and combines them. `read_documents` returns the ids themselves, after the same checks. A missing document, file or chunk raises
ValueError; a chunk or recipe that does not match raises it in the task that reads it.

Defined cases: a null or empty text is the end id alone; rows with equal or null doc_id are separate documents (null
first, equal ones in no fixed order); an empty table gives an empty store; other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.llm.common import Scratch, table, text_of

WINDOW, MEAN, MIN, MAX = 8, 512, 64, 4096
_FACTOR, _SPREAD = 0x2C1B3C6D, 0x9E3779B1
#: Words remembered by a worker, and the memory of those met since the memo was last halved.
MEMO, MEMO_BYTES = 600_000, 64 << 20
OWN, SHARED, ELSEWHERE, REPEAT = range(4)
#: Characters of a word that is kept when the memo is halved.
LONG = 64
#: Bytes of texts that are cut into words together, and unknown words that are encoded in one call.
PIECE, CALL = 4 << 20, 500
#: Words of Latin letters only, A-Z being lower-cased: one piece for the tokenizer, which its normaliser changes in case only.
_LATIN = re.compile("[a-zÀ-ÖØ-öø-ÿŒœ]+")
#: A letter or digit before a run of ASCII marks ends a piece, so both are encoded apart.
_ENDS, _MARKS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100), 0x152, 0x153]))), string.punctuation


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible Latin-1, else the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


#: How a vocabulary file must cut texts for words to be encoded apart.
_NORMALIZERS, _CUTTERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]


def _cuts_at_spaces(path: str) -> bool:
    """Whether the file's tokenizer lower-cases, drops white space and splits at it, and does nothing else around its model."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    names = lambda part, field: [x["type"] for x in ((own.get(part) or {}).get(field) or [])]
    split = next(iter((own.get("pre_tokenizer") or {}).get("pretokenizers") or []), {})
    drops = split.get("behavior") == "Removed" and split.get("invert") is True and r"[^\s\p{L}\p{N}]+" in split.get("pattern", {}).get("Regex", "")
    return names("normalizer", "normalizers") == _NORMALIZERS and names("pre_tokenizer", "pretokenizers") == _CUTTERS and drops and own["model"]["type"] == "BPE" and not own.get("post_processor")


class WordEncoder:
    """Encodes by words between ASCII spaces, which the tokenizer drops and never joins across, without the marks at their ends; remembers at most MEMO of both. A file of another kind is left to the library, text by text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _cuts_at_spaces(path)
        self.plain = Tokenizer(self.tokenizer.model)  # for words that are one piece, given in byte letters
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = _byte_letters()
        self.letters = {ord(c): "".join([letters[b] for b in c.lower().encode()]) for c in _ENDS | {c.upper() for c in _ENDS} if not c.isascii()}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, words: set[str]) -> None:
        ascii_letters, latin, odd = [], [], []
        for w in words:
            if w.isalpha() and w.isascii():
                ascii_letters.append(w)
            elif _LATIN.fullmatch(w):
                latin.append(w)
            else:
                odd.append(w)
        for group, letters in ((ascii_letters, None), (latin, self.letters)):
            for k in range(0, len(group), CALL):
                some = group[k : k + CALL]
                line = " ".join(some)
                e = self.plain.encode(line.translate(letters) if letters else line, add_special_tokens=False)
                ids = array(self.code, e.ids).tobytes()
                ends = (np.cumsum(np.bincount(e.word_ids, minlength=len(some))) * self.width).tolist()
                self.memo.update(zip(some, map(ids.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.memo[w] = array(self.code, e.ids).tobytes()

    def _of_words(self, words: pa.StringArray) -> list[bytes]:
        """The ids of each of some distinct words."""
        low, special = pc.ascii_lower(words), pc.match_substring(words, "<|")
        if pc.any(special).as_py():  # a special token's string counts in its own case only
            low = pc.if_else(special, words, low)
        stems = pc.ascii_rtrim(low, _MARKS)
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(stems), pc.binary_length(low)).to_numpy(zero_copy_only=False))
        stems, marks = stems.to_numpy(zero_copy_only=False), {}
        for k, w, s in zip(marked.tolist(), low.take(pa.array(marked)).to_numpy(zero_copy_only=False), stems[marked], strict=True):
            if s and s[-1] in _ENDS and "<|" not in w:
                marks[k] = w[len(s) :]
            else:
                stems[k] = w
        stems = stems.tolist()
        if len(self.memo) > MEMO or self.held > MEMO_BYTES:  # the words met first are mostly the frequent ones
            self.memo = {w: ids for w, ids in islice(self.memo.items(), MEMO // 2) if len(w) <= LONG}
            self.held = 0
        if missing := {*stems, *marks.values()}.difference(self.memo):
            self.held += sum(map(sys.getsizeof, missing))
            self._learn(missing)
        ids = list(map(self.memo.__getitem__, stems))
        for k, m in marks.items():
            ids[k] += self.memo[m]
        return ids

    def encode_pieces(self, texts: pa.StringArray) -> Iterator[list[bytes]]:
        """The ids of each text, packed in `width` bytes each, for some of the texts at a time."""
        at, ends = 0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        while at < len(texts):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            piece, at = texts.slice(at, until - at), until
            if not self.by_words:
                yield [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(piece.to_pylist(), add_special_tokens=False)]
                continue
            cut = pc.ascii_split_whitespace(piece)
            words = cut.flatten().dictionary_encode()
            take, places = self._of_words(words.dictionary).__getitem__, words.indices.to_numpy()
            bounds = (cut.offsets.to_numpy() - cut.offsets[0].as_py()).tolist()
            yield [b"".join(map(take, places[a:b].tolist())) for a, b in pairwise(bounds)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [ids for piece in self.encode_pieces(pa.array(texts, pa.string())) for ids in piece]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def chunk_ends(ids: np.ndarray) -> np.ndarray:
    """The places after which the rolling hash of the ids allows a cut."""
    h, reach = ids.astype(np.uint32), 1
    while reach < WINDOW:  # sums over twice as many ids
        before = h[:-reach] * np.uint32(pow(_FACTOR, reach, 1 << 32))
        h[reach:] += before
        reach *= 2
    h *= np.uint32(_SPREAD)
    return np.flatnonzero((h >> np.uint32(32 - MEAN.bit_length() + 1)) == 0) + 1


def _lengths(n: int, cuts: list[int]) -> list[int]:
    out, last = [], 0
    for c in [*cuts, n]:
        while c - last > MAX:
            out.append(MAX)
            last += MAX
        if c - last >= MIN or c == n and c > last:
            out.append(c - last)
            last = c
    return out


def chunk_lengths(ids: np.ndarray) -> list[int]:
    """The lengths, in ids, of the content-defined chunks of one stream."""
    return _lengths(len(ids), chunk_ends(ids).tolist())


def chunks_of_streams(ids: np.ndarray, ends: list[int]) -> list[list[int]]:
    """`chunk_lengths` of each of the streams that lie end to end in `ids`. A hash reaches back over a stream's start only within WINDOW ids of it, and no chunk is so short (MIN)."""
    cuts = chunk_ends(ids)
    at = np.searchsorted(cuts, [0, *ends], "right").tolist()
    return [_lengths(b - a, (cuts[i:j] - a).tolist()) for (a, b), (i, j) in zip(pairwise([0, *ends]), pairwise(at), strict=True)]


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 over pairs, level by level; an odd last node moves up as it is. No leaves: the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        up = [hashlib.sha256(a + b).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = up + leaves[len(leaves) & ~1 :]
    return leaves[0]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = encoder(path), zstandard.ZstdCompressor(level=1)
        end, uid = end_id.to_bytes(words.width, "little"), TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for piece in words.encode_pieces(b.column(1)):
                streams = [ids + end for ids in piece]
                ends = [x // words.width for x in accumulate(map(len, streams))]
                for data, lengths in zip(streams, chunks_of_streams(np.frombuffer(b"".join(streams), f"<u{words.width}"), ends), strict=True):
                    at, leaves = 0, []
                    for n in lengths:
                        leaves.append(hashlib.sha256(data[at : at + n * words.width]).digest())
                        at += n * words.width
                    rows.append((uid, len(data) // words.width, packer.compress(data), lengths, leaves))
                    uid += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "uid", "n_tokens", "packed", "lengths", "leaves"])

    return run


def _values(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of some columns; lists come from one conversion of all their values, a null one is empty."""
    cols = []
    for name in names:
        col = b.column(name)
        if pa.types.is_list(col.type):
            flat = col.flatten()
            flat = flat.to_numpy(zero_copy_only=False).tolist() if pa.types.is_binary(flat.type) else flat.to_pylist()
            ends = accumulate(pc.fill_null(pc.list_value_length(col), 0).to_pylist(), initial=0)
            cols.append([flat[i:j] for i, j in pairwise(ends)])
        else:
            cols.append(col.to_pylist())
    return zip(*cols, strict=True)


_ENCODED = "doc_id long, uid long, n_tokens long, packed binary, lengths array<int>, leaves array<binary>"
_STORED = "doc_id long, uid long, shard long, offset long, n_tokens long, lengths array<int>, leaves array<binary>, flags binary, root binary, payload binary, n_docs long"


def _layout(width: int):
    """Rows sorted by document; a document's `shared` row comes just before its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, unpack = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        offset, roots, notes = 0, [], (None, {}, {})
        schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("lengths", pa.list_(pa.int32())), ("leaves", pa.list_(pa.binary())), ("flags", pa.binary()), ("root", pa.binary()), ("payload", pa.binary()), ("n_docs", pa.int64())])
        for b in batches:
            rows = []
            for doc_id, uid, n_tokens, packed, lengths, leaves, *held in _values(b, "doc_id", "uid", "n_tokens", "packed", "lengths", "leaves", "mine", "others"):
                if packed is None:
                    notes = (uid, *map(set, held))
                    continue
                mine, others = notes[1:] if notes[0] == uid else ((), ())
                data, at, seen = unpack.decompress(packed), 0, set()
                flags, payload = bytearray(), []
                for n, leaf in zip(lengths, leaves, strict=True):
                    flag = REPEAT if leaf in seen else ELSEWHERE if leaf in others else SHARED if leaf in mine else OWN
                    seen.add(leaf)
                    flags.append(flag)
                    if flag in (OWN, SHARED):
                        payload.append(data[at : at + n * width])
                    at += n * width
                root = merkle_root(leaves)
                rows.append((doc_id, uid, shard, offset, n_tokens, lengths, leaves, bytes(flags), root, b"".join(payload), None))
                roots.append(root)
                offset += n_tokens
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if roots:
            last = (None, None, shard, offset, offset, None, None, None, merkle_root(roots), None, len(roots))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(last, schema, strict=True)], schema=schema)

    return run


def vocabulary_width(path: str) -> int:
    return encoder(path).width


def write_store(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """Encodes `docs` (doc_id, text) and writes the store at `path`. `vocabulary` is a tokenizers file present on every machine."""
    scratch = Scratch(docs.sparkSession, "token-store")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    encoded = scratch.write(source.mapInArrow(_encode(vocabulary, end_id), _ENCODED), "encoded")
    held = encoded.select("doc_id", "uid", F.explode(F.array_distinct("leaves")).alias("leaf"))
    owners = held.groupBy("leaf").agg(F.min("uid").alias("owner"), F.count("*").alias("n")).where(F.col("n") > 1).select("leaf", "owner")
    owners = scratch.write(owners, "owners")
    mine = F.col("uid") == F.col("owner")
    notes = (
        held.join(owners, "leaf")
        .groupBy("doc_id", "uid")
        .agg(F.collect_list(F.when(mine, F.col("leaf"))).alias("mine"), F.collect_list(F.when(~mine, F.col("leaf"))).alias("others"))
    )
    notes = scratch.write(notes, "notes")
    rows = encoded.select("doc_id", "uid", F.lit(1).alias("kind"), "n_tokens", "packed", "lengths", "leaves").unionByName(
        notes.select("doc_id", "uid", F.lit(0).alias("kind"), "mine", "others"), allowMissingColumns=True
    )
    placed = rows.repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid", "kind")
    placed.mapInArrow(_layout(vocabulary_width(vocabulary)), _STORED).write.option("compression", "zstd").parquet(path)
    _of_store(docs.sparkSession.read.schema(_STORED).parquet(path)).write.parquet(f"{path}-manifest")


# CRC-32 of a concatenation: crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where shift multiplies by x^(8 len(b)).


def _times(matrix: list[int], v: int) -> int:
    out, k = 0, 0
    while v:
        if v & 1:
            out ^= matrix[k]
        v >>= 1
        k += 1
    return out


def _shifts() -> list[list[int]]:
    """The 32 x 32 bit matrices (as columns) that shift by 2^k bytes."""
    one_bit = [0xEDB88320, *(1 << k for k in range(31))]
    m, out = one_bit, []
    for k in range(35):
        if k >= 3:
            out.append(m)
        m = [_times(m, c) for c in m]
    return out


_SHIFT = _shifts()


def crc_join(a: int, b: int, b_bytes: int) -> int:
    """The CRC-32 of two byte strings' concatenation from theirs and the second one's length."""
    k = 0
    while b_bytes:
        if b_bytes & 1:
            a = _times(_SHIFT[k], a)
        b_bytes >>= 1
        k += 1
    return a ^ b


def _wide(data: bytes, width: int) -> bytes:
    return np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()


_PARTS = "doc_id", "lengths", "leaves", "flags", "payload", "root"


def _chunks(width: int, doc_id: int | None, lengths: list[int], leaves: list[bytes], flags: bytes, payload: bytes, root: bytes) -> Iterator[tuple[int, int, bytes, int, bytes | None]]:
    """(position, ids, address, flag, bytes where stored here or repeated from here) of a document row; checks what is stored."""
    if merkle_root(leaves) != root:
        raise ValueError(f"document {doc_id}: its recipe does not match its Merkle root")
    at, here = 0, {}
    for pos, (n, leaf, flag) in enumerate(zip(lengths, leaves, flags, strict=True)):
        data = here.get(leaf)
        if flag in (OWN, SHARED):
            data = payload[at : at + n * width]
            at += n * width
            if hashlib.sha256(data).digest() != leaf:
                raise ValueError(f"document {doc_id}: chunk {pos} does not match its address")
            here[leaf] = data
        yield pos, n, leaf, flag, data


def _checksums(width: int):
    """One row a document: lengths in ids and `crcs` of its parts. A part is a run of chunks stored here, or one stored elsewhere (crc -1), whose address is in `leaves` and `away`. Shared chunks give (address, crc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.struct([("leaf", pa.binary()), ("crc", pa.int64())])), pa.list_(pa.binary())]
        same = ["doc_id", "uid", "shard", "offset", "n_tokens"]
        for b in batches:
            rows = []
            for row in _values(b, *_PARTS):
                sizes, at, crcs, shared, away = [], [], [], [], []
                for _, n, leaf, flag, data in _chunks(width, *row):
                    if data is None:
                        sizes.append(n)
                        at.append(leaf)
                        crcs.append(-1)
                        away += [leaf] if flag == ELSEWHERE else []
                        continue
                    wide = _wide(data, width)
                    if flag == SHARED:
                        shared.append({"leaf": leaf, "crc": zlib.crc32(wide)})
                    if crcs and crcs[-1] >= 0:
                        sizes[-1] += n
                        crcs[-1] = zlib.crc32(wide, crcs[-1])
                    else:
                        sizes.append(n)
                        at.append(None)
                        crcs.append(zlib.crc32(wide))
                rows.append((sizes, at if away else None, crcs, shared, away))
            if rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*map(b.column, same), *cols, b.column("root")], [*same, "lengths", "leaves", "crcs", "shared", "away", "root"])

    return run


_CHECKED = "doc_id long, uid long, shard long, offset long, n_tokens long, lengths array<long>, leaves array<binary>, crcs array<long>, shared array<struct<leaf:binary,crc:long>>, away array<binary>, root binary"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for lengths, leaves, crcs, elsewhere in _values(b, "lengths", "leaves", "crcs", "found"):
            found = {x["leaf"]: x["crc"] for x in elsewhere}
            total = 0
            for k, (n, crc) in enumerate(zip(lengths, crcs, strict=True)):
                if crc < 0:
                    crc = found[leaves[k]]
                total = crc_join(total, crc, 4 * n) if k else crc
            out.append(total)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("shard"), b.column("offset"), b.column("n_tokens"), pa.array(out, pa.int64())], ["doc_id", "shard", "offset", "n_tokens", "ids_crc32"])



_FILE_DOCS, _MANIFEST = "shard long, offset long, n_tokens long, root binary", "n_files long, n_docs long, n_tokens long, root binary"


def merkle_path(path: list[tuple[int, bytes]], leaf: bytes) -> None:
    """Adds a leaf to the complete subtrees (height, root) of the tree so far, largest first."""
    height = 0
    while path and path[-1][0] == height:
        leaf, height = hashlib.sha256(path.pop()[1] + leaf).digest(), height + 1
    path.append((height, leaf))


def merkle_end(path: list[tuple[int, bytes]]) -> bytes:
    """The root that `merkle_root` gives for all leaves added."""
    if not path:
        return merkle_root([])
    root = path[-1][1]
    for _, left in path[-2::-1]:
        root = hashlib.sha256(left + root).digest()
    return root


def _file_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, n_docs, offset, n_tokens, root), a file's documents by offset and its manifest (n_docs is not null) last, to (wrong): what its documents break of it. Holds one path of the file's tree."""
    shard, path, n, at = None, [], 0, 0
    for b in batches:
        wrong = []
        for s, n_docs, offset, n_tokens, root in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if s != shard:
                if shard is not None:
                    wrong.append(f"file {shard}: it has no manifest")
                shard, path, n, at = s, [], 0, 0
            if n_docs is None:
                at = at + n_tokens if offset == at else -1 if at >= 0 else at
                n += 1
                merkle_path(path, root)
                continue
            if not (n == n_docs and at == n_tokens and merkle_end(path) == root):
                wrong.append(f"file {s}: its documents do not match its manifest")
            shard = None
        yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.string())], ["wrong"])
    if shard is not None:
        yield pa.RecordBatch.from_arrays([pa.array([f"file {shard}: it has no manifest"])], ["wrong"])


def _store_manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            files = r["files"] or []
            row = len(files), sum(f["n_docs"] for f in files), sum(f["n_tokens"] for f in files), merkle_root([f["root"] for f in files])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["n_files", "n_docs", "n_tokens", "root"])


def _of_store(store: DataFrame) -> DataFrame:
    """One row: the manifest that the files' manifest rows make."""
    files = store.where("n_docs is not null").agg(F.array_sort(F.collect_list(F.struct("shard", "n_docs", "n_tokens", "root"))).alias("files"))
    return files.mapInArrow(_store_manifest, _MANIFEST)


def verify(spark: SparkSession, path: str, docs: DataFrame | None = None) -> None:
    """Raises ValueError unless the files at `path` hold just the documents of their manifests. docs: (shard, offset, n_tokens, root), where they are at hand."""
    store = spark.read.schema(_STORED).parquet(path)
    found = _of_store(store).first()
    if found != spark.read.schema(_MANIFEST).parquet(f"{path}-manifest").first():
        raise ValueError("the files' manifests do not match the store's manifest")
    none = F.lit(None).cast("long").alias("n_docs")
    held = (store.where("n_docs is null") if docs is None else docs).select("shard", none, "offset", "n_tokens", "root")
    files = store.where("n_docs is not null").select("shard", "n_docs", F.lit(None).cast("long").alias("offset"), "n_tokens", "root")
    rows = held.unionByName(files).repartition("shard").sortWithinPartitions("shard", F.asc_nulls_last("offset"), F.asc_nulls_first("n_docs"))
    bad = rows.mapInArrow(_file_states, "wrong string").first()
    if bad:
        raise ValueError(bad.wrong)


def shard_starts(store: DataFrame) -> DataFrame:
    """(shard, first): ids in all files before each. The window is over one row a file."""
    files = store.where("n_docs is not null").select("shard", "n_tokens")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))


def read_checksums(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files at `path`."""
    scratch = Scratch(spark, "token-read")
    store = spark.read.schema(_STORED).parquet(path)
    checked = scratch.write(store.where("n_docs is null").mapInArrow(_checksums(width), _CHECKED), "checked")
    verify(spark, path, checked.select("shard", "offset", "n_tokens", "root"))
    crcs = checked.select(F.inline("shared"))
    wanted = checked.select("uid", F.explode("away").alias("leaf"))
    found = wanted.join(crcs, "leaf", "left").groupBy("uid").agg(F.collect_list(F.struct("leaf", "crc")).alias("found"))
    found = scratch.write(found, "found")
    if not found.where(F.exists("found", lambda x: x["crc"].isNull())).isEmpty():
        raise ValueError("a chunk that documents share is missing from the store")
    whole = checked.drop("shared", "away", "root").join(found, "uid", "left")
    joined = whole.mapInArrow(_combine, "doc_id long, shard long, offset long, n_tokens long, ids_crc32 long")
    return joined.join(shard_starts(store), "shard").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def _spread(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*ids, pos, leaf, data, flag == SHARED) for *ids, row in zip(*(b.column(k).to_pylist() for k in ("doc_id", "uid", "shard", "offset")), _values(b, *_PARTS), strict=True) for pos, _, leaf, flag, data in _chunks(width, *row)]
            if rows:
                kinds = [pa.int64()] * 5 + [pa.binary(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "uid", "shard", "offset", "pos", "leaf", "data", "shared"])

    return run


def read_documents(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(doc_id, start, ids): the id stream of every document, rebuilt from its recipe; ids are `width`-byte little-endian."""
    verify(spark, path)
    store = spark.read.schema(_STORED).parquet(path)
    parts = Scratch(spark, "token-read").write(store.where("n_docs is null").mapInArrow(_spread(width), "doc_id long, uid long, shard long, offset long, pos long, leaf binary, data binary, shared boolean"), "parts")
    shared = parts.where("shared").select("leaf", F.col("data").alias("held"))
    away = parts.where("data is null").drop("data").join(shared, "leaf", "left").withColumnRenamed("held", "data")
    if not away.where("data is null").isEmpty():
        raise ValueError("a chunk that documents share is missing from the store")
    whole = parts.where("data is not null").unionByName(away).groupBy("uid", "doc_id", "shard", "offset").agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["data"]))
    return whole.join(shard_starts(store), "shard").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), ids.alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    path = f"{Scratch(spark, 'token-files').path}/store"
    write_store(table(spark, sf_dir, "documents"), vocabulary, 2, path)
    return read_checksums(spark, path, vocabulary_width(vocabulary))
