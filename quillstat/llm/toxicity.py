"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme values.

Tokens are runs of letters, lower-cased; a token equal to the one before it adds nothing. A token's toxic share is a
Dirichlet (two classes) posterior mean: the documents that hold it, toxic or not, on a prior of PRIOR documents centred
on the share of its longest stem, whose prior is the next shorter stem's, down to the share of all documents. Stems are
the first STEMS characters, so inflected words that were never seen take the score of their stem. A token's score is its
log-odds against that of all documents, less DRIFT, so that clean text falls.

Passages are all maximal scoring segments of the whole text (Ruzzo and Tompa's scan: one pass, each candidate settled by a
chain of earlier ones). Their lengths of score S are extreme values in clean text: a text of n tokens holds K n exp(-lambda
S) segments of that score by chance, with lambda from the clean tokens' scores and K from the median of clean texts' best
segments (Karlin and Altschul). A passage is significant if fewer than one is expected; a document's evidence adds up
lambda S - ln(K n) over its significant passages, and a logistic curve over log(1 + evidence), fitted to the training
texts, gives the score.

The classifier is fitted on a bounded sample: of each class the SAMPLE labelled training rows with the lowest hash of
their id, one text an id; of texts that share their least five-word shingle hash (as copies and near copies mostly do) one
a class counts. Training texts are scored without their own counts. What reaches the driver is bounded: the UNITS most
frequent words and stems of at least LEAST documents, token scores as a histogram, three numbers a sampled text. Every
document is then scored in one pass over whole texts.

Defined cases: a null text is the empty one; a text without a letter has no passage and the score of no evidence; an id
labelled more than once is toxic if any of its labels is; labels other than 0 and 1, and null ids, teach nothing; a null
doc_id is scored and counts as the empty text's fold; without training rows of both classes the score is the toxic share of
what there is (0 of nothing) and there are no passages; repeated rows are scored each; texts of any length are scanned
whole, in memory that grows with the one text; an empty table gives no rows; other columns are kept, but those named like
the results are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillstat.llm.common import Scratch, bucket_of_id, table, text_of, with_fields

SAMPLE, UNITS, LEAST = 4_000, 300_000, 3
STEMS, PRIOR, DRIFT = (3, 4, 5, 6), 4.0, 1.0
SHINGLE, FOLDS, HELD_OUT = 5, 5, 0
#: Scores are counted in steps of 1 / BINS for lambda.
BINS = 50
#: Words remembered by a task; longer ones than LONG are worked out each time.
WORDS, LONG = 200_000, 64
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, without immediate repeats."""
    found = _WORD.findall((text or "").lower())
    return [w for k, w in enumerate(found) if not k or w != found[k - 1]]


def stems(word: str) -> list[str]:
    """Its proper beginnings, marked as such."""
    return [word[:k] + "*" for k in STEMS if len(word) > k]


def maximal_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, start, end) of all maximal scoring segments, left to right, in linear time."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    left, right, start, end, lower = [], [], [], [], []  # lower: the last candidate before with a lesser left sum
    for at in np.flatnonzero(scores > 0).tolist():
        lo, hi, begin = sums[at], sums[at + 1], at
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = lower[j]
            if j < 0 or right[j] >= hi:
                break
            lo, begin = left[j], start[j]
            for part in (left, right, start, end, lower):
                del part[j:]
        for part, value in zip((left, right, start, end, lower), (lo, hi, begin, at + 1, j), strict=True):
            part.append(value)
    return [(float(b - a), s, e) for a, b, s, e in zip(left, right, start, end, strict=True)]


@dataclass
class Model:
    """share: of toxic documents; units: (toxic, all) documents of each word and stem; then the calibration."""

    share: float
    units: dict[str, tuple[int, int]] | None = None
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    _known: list[dict[str, float]] = field(default_factory=lambda: [{}, {}, {}])

    def log_odds(self, word: str, own: int | None = None) -> float:
        """own: the class of a document whose own counts are left out; None: of none."""
        known = self._known[2 if own is None else own]
        found = known.get(word)
        if found is None:
            share = self.share
            for unit in [*stems(word), word]:
                toxic, n = self.units.get(unit, (0, 0))
                if own is not None and n:
                    toxic, n = toxic - own, n - 1
                if n >= LEAST:
                    share = (toxic + PRIOR * share) / (n + PRIOR)
            found = math.log(share / (1 - share)) - math.log(self.share / (1 - self.share))
            if len(word) <= LONG:
                if len(known) >= WORDS:
                    known.clear()
                known[word] = found
        return found

    def scores(self, words: list[str], own: int | None = None) -> np.ndarray:
        return np.array([self.log_odds(w, own) for w in words], dtype=np.float64) - DRIFT

    def excess(self, score: float, n: int) -> float:
        """-ln of the segments of that score expected in n clean tokens."""
        return self.rate * score - self.log_k - math.log(max(n, 1))

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The score, and the significant passages as (first token, end token, excess)."""
        if self.units is None:
            return self.share, []
        words = tokens(text)
        found = [(a, b, e) for s, a, b in maximal_segments(self.scores(words)) if (e := self.excess(s, len(words))) > 0]
        return self.probability(sum(e for _, _, e in found)), found

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.slope * math.log1p(evidence) + self.offset))))


def least_shingle(text: str) -> int:
    """The least hash of the five-word shingles of a text (of the whole sequence, if it has fewer words), signed."""
    words = text.lower().split()
    return min(xxh64_intdigest(" ".join(words[k : k + SHINGLE])) for k in range(max(len(words) - SHINGLE + 1, 1))) - 2**63


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([least_shingle(x) for x in b.column("text").to_pylist()], pa.int64())], [*b.schema.names, "least"])


def sampled(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """(toxic, text): at most `sample` texts of each class."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learn)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = [marked.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    # At most 2 * sample ids.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    once = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    keyed = once.select("toxic", "text").mapInArrow(_shingled, "toxic int, text string, least long")
    return keyed.groupBy("toxic", "least").agg(F.min("text").alias("text")).drop("least")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = set(tokens(text))
            units = list(words.union(*map(stems, words)))
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([toxic] * len(units), pa.int64())], ["unit", "toxic"])


def _tried(model: Model):
    """A training text without its own counts: its class, tokens, best segment; and how often each score of clean tokens occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            rows = []
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = tokens(text)
                x = model.scores(words, toxic)
                segments = sorted((s for s, _, _ in maximal_segments(x)), reverse=True)
                rows.append((toxic, len(words), segments[:1], None))
                if not toxic:
                    for at, n in zip(*np.unique(np.rint(x * BINS).astype(np.int64), return_counts=True), strict=True):
                        seen[int(at)] = seen.get(int(at), 0) + int(n)
            yield _batch(rows)
        yield _batch([(-1, at, [], n) for at, n in seen.items()])

    def _batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["toxic", "n", "best", "count"])

    return run


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = tokens(text)
                out.append(sum(max(model.excess(s, len(words)), 0.0) for s, _, _ in maximal_segments(model.scores(words, toxic))))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(out, pa.float64())], ["toxic", "evidence"])

    return run


def decay(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda for which the mean of exp(lambda * score) is 1; 1 if scores never rise or do not fall on average."""
    if not len(values) or values.max() <= 0 or values @ weights >= 0:
        return 1.0
    lo, hi = 0.0, 700.0 / values.max()
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if weights @ np.exp(mid * values) > weights.sum() else (mid, hi)
    return lo


def logistic(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with targets drawn in by the classes' sizes (Platt) so that separable classes have a curve."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    y = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design, w = np.stack([x, np.ones_like(x)], axis=1), np.array([0.0, math.log((n1 + 1) / (n0 + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (p - y) + 1e-6 * w
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + 1e-6 * np.eye(2), grad)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, scratch: Scratch | None = None) -> Model:
    """A model from the texts of `docs` (doc_id, text) labelled in `labels` (doc_id, toxic) for whose doc_id `learn` holds."""
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    rows = scratch.write(sampled(docs, labels, learn, sample), "sample")
    sizes = dict(rows.groupBy("toxic").count().collect())
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model(toxic / max(clean + toxic, 1))
    counts = rows.mapInArrow(_units, "unit string, toxic long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).where(F.col("n") >= LEAST)
    kept = counts.orderBy(F.desc("n"), "unit").limit(UNITS).collect()
    model = Model(toxic / (clean + toxic), {r.unit: (r.toxic, r.n) for r in kept})
    tried = rows.mapInArrow(_tried(model), "toxic int, n long, best array<double>, count long").groupBy("toxic", "n", "best").agg(F.sum("count").alias("count"), F.count("*").alias("times")).collect()
    seen = [(r.n / BINS, r["count"]) for r in tried if r.toxic < 0]
    values, weights = np.array([v for v, _ in seen]), np.array([float(n) for _, n in seen])
    model.rate = decay(values, weights) if seen else 1.0
    best = np.repeat([model.rate * (r.best or [0.0])[0] - math.log(max(r.n, 1)) for r in tried if r.toxic == 0], [r.times for r in tried if r.toxic == 0])
    model.log_k = float(np.median(best)) + math.log(math.log(2))  # the median of a Gumbel law lies -ln(ln 2) above its mode
    scored = np.array([(r.toxic, r.evidence) for r in rows.mapInArrow(_evidence(model), "toxic int, evidence double").collect()])
    model.slope, model.offset = logistic(np.log1p(scored[:, 1]), scored[:, 0])
    return model


def _judged(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("excess", pa.float64())]))
        for b in batches:
            found = [model.judge(x) for x in b.column("text").to_pylist()]
            spans = [[{"first": a, "end": e, "excess": x} for a, e, x in s] for _, s in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p for p, _ in found], pa.float64()), pa.array(spans, passage)], [*b.schema.names, "score", "passages"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of `docs`, score (0 to 1) and passages: the significant ones, in tokens, with their excess."""
    docs = docs.drop("score", "passages")
    return docs.mapInArrow(_judged(model), with_fields(docs, "score double, passages array<struct<first:int,end:int,excess:double>>"))


def held_out() -> Column:
    return bucket_of_id("doc_id", FOLDS) == HELD_OUT


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
