"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of 1 to ORDERS characters of the text (lower-cased, white space runs as one space), hashed into
BUCKETS; tf is the square root of a bucket's count, idf the smoothed log of the share of documents without it, and a
document's vector has length 1. Document frequencies cover every training document.

Training: follow-the-regularised-leader (proximal, per-coordinate rates) with L1 and L2 penalties, over a sample of the
labelled documents: each language has its share of SAMPLE, but LEAST at least (SAMPLE / languages, if that is less; one in
any case), as far as it has so many, so that every language is learned from at most 2 x SAMPLE rows, or SAMPLE and one a
language; those of its rows with the lowest hash of id and text; a fifth of them is set aside. Labels are counted over
all training rows. The model is BUCKETS x languages doubles.
The set-aside part then fixes the temperature that divides the logits, by least negative log likelihood.

The features of the sampled documents, and one number a bucket, are all that reaches the driver: both bounded by the
parameters. Prediction is one pass over whole texts.

Defined cases: a null text, or one without a letter, is `und` with score 0; with no labelled document to learn from,
every text is `und`; a null lang is no label; rows that share an id are told apart by their texts, and rows that share both
are sampled together, up to their language's part; an empty table gives no rows; a long text is featurised PIECE by
PIECE, in memory that does not grow with it beyond the text itself; other columns are kept, but those named like the
results are replaced.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import bucket_of_id, table, with_fields

ORDERS, BUCKETS = 3, 1 << 14
SAMPLE, LEAST, EPOCHS = 4_000, 20, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Characters featurised in one go; longer texts are added up piece by piece.
PIECE = 1 << 20
_MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
_SPACES = re.compile(r"\s+")


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    data = np.frombuffer(_SPACES.sub(" ", f" {text.lower()} ").encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(data), PIECE):
        x = data[lo : lo + PIECE + ORDERS - 1]
        gram = np.zeros(len(x), np.uint32)
        for n in range(1, ORDERS + 1):
            gram = gram[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(1)
            starts = gram[:PIECE]
            h = (starts ^ (starts >> np.uint32(15))) * np.uint32(_MIX[n - 1])
            total += np.bincount(h >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return total


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets a text has and their TF-IDF weights, of length 1 together."""
    c = counts(text)
    at = np.flatnonzero(c)
    v = np.sqrt(c[at]) * idf[at]
    return at, v / max(np.sqrt(v @ v), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Weights (BUCKETS x languages), bias, idf, temperature and the languages in order."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        at, v = vector(text, self.idf)
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, langs=np.array(self.langs, dtype=str), idf=self.idf, weights=self.weights, bias=self.bias, temperature=self.temperature)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        x = np.load(io.BytesIO(data), allow_pickle=False)
        return Model(x["langs"].tolist(), x["idf"], x["weights"], x["bias"], float(x["temperature"]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (buckets, values, label) rows; returns weights and bias. Row BUCKETS of the state is the bias."""
    z, n = np.zeros((BUCKETS + 1, n_langs)), np.zeros((BUCKETS + 1, n_langs))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        w = (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    order = np.random.default_rng(42)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, v, y = rows[k]
            at, v = np.append(at, BUCKETS), np.append(v, 1.0)
            w = weights(at)
            error = softmax(v @ w)
            error[y] -= 1.0
            g = v[:, None] * error
            step = np.sqrt(n[at] + g * g) - np.sqrt(n[at])
            z[at] += g - step / alpha * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:BUCKETS], w[BUCKETS]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood, on a geometric grid."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 20.0, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-300)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: the documents it saw, and in how many each bucket occurs."""
    df, n = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for text in b.column(0).to_pylist():
            df += counts(text) > 0
            n += 1
    at = np.append(np.flatnonzero(df), BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.append(df[at[:-1]], n))], ["bucket", "df"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [counts(x) for x in b.column("text").to_pylist()]
        at = [np.flatnonzero(c) for c in rows]
        packed = [pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([c[a].astype("<u4").tobytes() for c, a in zip(rows, at, strict=True)], pa.binary())]
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("h", "lang", "k")), *packed], ["h", "lang", "k", "at", "c"])


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """A model from the rows of `docs` (doc_id, text, lang) for which `learn` holds and text and lang are not null."""
    rows = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    found = dict(rows.select("text").mapInArrow(_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df")).collect())
    n = found.pop(BUCKETS, 0)
    df = np.zeros(BUCKETS)
    df[list(found)] = list(found.values())
    idf = np.log((1 + n) / (1 + df)) + 1.0
    if not n:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    # The lowest hashes of each language: a share of hash space that holds 1.2 times its part, its least hash at least; then the part itself.
    order = F.xxhash64("doc_id", "text")
    part = {}
    if n > sample:
        labels = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(order).alias("first")).collect()
        least = max(1, min(LEAST, sample // len(labels)))
        part = {r.lang: max(least, sample * r.n // n) for r in labels}
        below = {r.lang: max(r.first, min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 1.2 * part[r.lang] / r.n)))) for r in labels}
        limits = docs.sparkSession.createDataFrame(list(below.items()), "of string, below long")
        rows = rows.join(F.broadcast(limits), F.col("lang") == F.col("of")).where(order <= F.col("below"))
    # Rows that share id and text come as one with their number, so no key gathers rows; what is left is bounded by `sample`.
    once = rows.groupBy(order.alias("h"), "lang").agg(F.count("*").alias("k"), F.min("text").alias("text"))
    chosen = once.mapInArrow(_counted, "h long, lang string, k long, at binary, c binary").collect()
    got, left = [], dict(part)
    for r in sorted(chosen, key=lambda r: (r.h, r.lang)):
        k = min(r.k, left.get(r.lang, 0)) if part else r.k
        left[r.lang] = left.get(r.lang, 0) - k
        got += [(r.lang, np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.c, "<u4"))] * k
    langs = sorted({lang for lang, _, _ in got})
    vectors = []
    for lang, at, c in got:
        v = np.sqrt(c) * idf[at]
        vectors.append((at, v / max(np.sqrt(v @ v), 1e-12), langs.index(lang)))
    aside, used = vectors[::5], [v for k, v in enumerate(vectors) if k % 5]
    if not used:
        used = aside
    weights, bias = ftrl(used, len(langs))
    logits = np.array([v @ weights[at] + bias for at, v, _ in aside])
    return Model(langs, idf, weights, bias, temperature(logits, np.array([y for _, _, y in aside])))



def _predict(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.from_bytes(packed)
        for b in batches:
            got = [model.predict(x) for x in b.column("text").to_pylist()]
            names = [*b.schema.names, "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names)

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of `docs`, lang_pred and score (the calibrated probability). Columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    return docs.mapInArrow(_predict(model.to_bytes()), with_fields(docs, "lang_pred string, score double"))


def held_out() -> Column:
    return bucket_of_id("doc_id", FOLDS) == HELD_OUT


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
