"""Toxicity by maximum-scoring segment search over token log-odds.

A token's weight is its log-odds between toxic and clean labelled documents under a Dirichlet prior that gives every
word the same pseudo-documents, shared out as the classes are; rare words stay near zero, and words may lean either way.
One linear pass (Ruzzo and Tompa) over all tokens of a text finds all maximal scoring segments.  Segment scores are
judged by extreme-value statistics (Karlin and Altschul): lambda is first solved from the distribution of clean tokens,
then lambda and K are fitted to the largest segment scores of clean documents that did not give the weights.  The
evidence of all significant segments adds up to the document's score through a logistic curve, fitted on the same
documents' scores: each labelled document is judged by weights from the other folds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, give_back, small_batches
from .textvec import chunks, words

#: Labelled documents of each class that the model is fitted on, at most in expectation: the only bounded sample.
SAMPLE = 20_000
#: Pseudo-documents that the prior gives every word, in both classes together.
PRIOR = 2.0
#: Standard deviations that shrink a word's log-odds to nothing.
SHRINK = 2.0
#: What each word subtracts, so that chance segments stay short.
DRIFT = 0.05
#: Parts of the sample, each of which is judged by weights from the others.
FOLDS = 4
#: Chance at or below which a segment is a toxic passage.
PASSAGE_CHANCE = 0.01
CHUNK = 500_000


@dataclass
class ToxicityModel:
    """Word weights (sorted by hash), extreme-value parameters and the logistic curve."""

    keys: np.ndarray
    weights: np.ndarray
    lam: float = 1.0
    k: float = 0.01
    slope: float = 1.0
    offset: float = -2.0

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        """Weight of each word; 0 for one that no labelled document holds."""
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, self.weights[at], 0.0)

    def chance(self, score: float, n: int) -> float:
        """Expected number of clean segments that score as much in a text of n words."""
        return self.k * max(n, 1) * math.exp(-self.lam * score)

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Sum of -ln(chance) over segments whose chance is below 1."""
        return sum(max(0.0, -math.log(max(self.chance(s, n), 1e-300))) for _, _, s in segments)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * math.log1p(evidence) + self.offset))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), by the linear-time scan.

    A segment begins and ends with a run of positive scores, so the scan takes one step for each of those.
    """
    good = np.zeros(len(scores) + 2, np.int8)
    good[1:-1] = scores > 0
    edge = np.diff(good)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # first, end, sum before first, and up to the end
    for first, stop, left, right in zip(begin.tolist(), end.tolist(), total[begin].tolist(), total[end].tolist(), strict=True):
        while stack:
            # nearest earlier segment that begins lower; those above it on the stack cannot be extended
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                break
            first, left = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((first, stop, left, right))
    return [(a, b - 1, r - l) for a, b, l, r in stack]


def text_segments(model: ToxicityModel, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
    """For each text its word count, segments, and the words' first and last code points."""
    for part in chunks([len(t) for t in texts], CHUNK):
        hashes, of, start, end = words(texts[part])
        scores = model.weigh(hashes) - DRIFT
        for i in range(len(of) - 1):
            spots = slice(of[i], of[i + 1])
            yield int(of[i + 1] - of[i]), maximal_segments(scores[spots]), start[spots], end[spots]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-odds of words between the classes, from the documents of each class that hold them, under the Dirichlet prior.

    Each is shrunk by its own uncertainty, by the positive part of 1 - (SHRINK / z) ** 2 with z its number of standard
    deviations, whichever way it leans.
    """
    share = n_toxic / (n_toxic + n_clean)
    a, b = toxic + PRIOR * share, clean + PRIOR * (1 - share)
    delta = np.log(a / (n_toxic + PRIOR * share)) - np.log(b / (n_clean + PRIOR * (1 - share)))
    return delta * np.maximum(0.0, 1 - SHRINK**2 * (1 / a + 1 / b) / np.maximum(delta * delta, 1e-12))


def solve_lambda(shares: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * score)) = 1, by bisection; 1 if there is none."""
    if not len(scores) or scores.max() <= 0 or shares @ scores >= 0:
        return 1.0
    f = lambda x: float(shares @ np.exp(np.minimum(x * scores, 700))) - 1
    low, high = 0.0, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def fit_extremes(largest: np.ndarray, sizes: np.ndarray, lam: float) -> tuple[float, float]:
    """Lambda and K by maximum likelihood from the largest segment scores of clean texts of ``sizes`` words.

    The largest score of n words is at most x with chance exp(-K n exp(-lambda x)).  ``lam`` is the start: lambda is
    looked for within a factor of 16.
    """
    known = sizes > 0
    x, n = largest[known], sizes[known].astype(float)
    if not len(x):
        return lam, 1.0

    def slope(value: float) -> float:
        weight = n * np.exp(-value * (x - x.min()))
        return 1 / value - x.mean() + float(weight @ x) / float(weight.sum())

    low, high = lam / 16, lam * 16
    for _ in range(60):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return high, len(x) / float((n * np.exp(-high * x)).sum())


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a weak ridge."""
    slope, offset, ridge = 0.0, 0.0, 1e-2
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        w = p * (1 - p) + 1e-9
        g = np.array([(x * (y - p)).sum() - ridge * slope, (y - p).sum() - ridge * offset])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        slope, offset = slope + float(np.clip(step[0], -5, 5)), offset + float(np.clip(step[1], -5, 5))
    return slope, offset


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``fold, text, toxic`` of labelled training rows; about ``sample`` of each class at most, chosen by a hash of the id."""
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[x for k in (0, 1) for x in (F.lit(k), F.lit(min(1.0, sample / max(1, counts.get(k, 0)))))])
    place = (F.xxhash64(F.lit(8), "doc_id") / F.lit(2.0**64)) + 0.5
    chosen = rows.filter(place <= share[F.col("toxic")])  # about 2 * sample ids: bounded
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(FOLDS)).cast("int")
    return texts.join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull()).select(fold.alias("fold"), "text", "toxic")


def count_words(texts: list[str], toxic: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, ...]:
    """``word, fold``, documents of each class that hold the word, and its occurrences in clean ones."""
    hashes, of, *_ = words(texts)
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    order = np.lexsort((hashes, fold[doc]))
    h, d = hashes[order], doc[order]
    if not len(h):
        return h, fold[:0], *(np.zeros(0, np.int64),) * 3
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (fold[d[1:]] != fold[d[:-1]])
    group = np.cumsum(new) - 1
    first = np.ones(len(h), bool)  # each word once a document, however often it is said
    first[1:] = new[1:] | (d[1:] != d[:-1])  # the sort is stable: a document's occurrences stand together
    n = int(group[-1]) + 1
    bad = toxic[d]
    return h[new], fold[d[new]], np.bincount(group, first * bad, n).astype(np.int64), np.bincount(group, first * (1 - bad), n).astype(np.int64), np.bincount(group, 1 - bad, n).astype(np.int64)


def weights_of(toxic: np.ndarray, clean: np.ndarray, said: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, float]:
    """Weights of words and the lambda of clean tokens."""
    weights = log_odds(toxic, clean, n_toxic, n_clean)
    return weights, solve_lambda(said / max(1, said.sum()), weights - DRIFT)


def weighted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that weigh something, as words that weigh nothing count like unknown ones."""
    some = np.flatnonzero(weights)
    return keys[some], weights[some]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on the training part of ``labels`` (columns ``doc_id, toxic``) and the texts of ``docs``.

    Without rows of both classes the model has no weights and calls every text clean.
    """
    spark = docs.sparkSession
    small_batches(spark)
    train = cut(training_sample(docs, labels, sample), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, texts, toxic = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for part in chunks([len(t) for t in texts], CHUNK):
                word, own, *counts = count_words(texts[part], toxic[part], fold[part])
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(own.astype(np.int32)), *map(pa.array, counts)], ["word", "fold", "toxic", "clean", "said"])

    sums = [F.sum(c).alias(c) for c in ("toxic", "clean", "said")]
    counts = train.mapInArrow(count, "word long, fold int, toxic long, clean long, said long").groupBy("word", "fold").agg(*sums).toArrow()  # the words of the sample: bounded
    sizes = np.zeros((FOLDS, 2), np.int64)
    for r in train.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect():
        sizes[r.fold, r.toxic] = r.n
    model = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0))
    if not sizes.sum(axis=0).all():
        model.slope, model.offset = 0.0, -5.0
        return model
    keys, at = np.unique(counts["word"].to_numpy().view(np.uint64), return_inverse=True)
    by_fold = np.zeros((3, FOLDS, len(keys)), np.int64)
    for k, c in enumerate(("toxic", "clean", "said")):
        by_fold[k, counts["fold"].to_numpy(), at] = counts[c].to_numpy()
    weights, lam = weights_of(*by_fold.sum(axis=1), *(int(n) for n in sizes.sum(axis=0)[::-1]))
    model.keys, model.weights = weighted(keys, weights)
    # each fold is judged by weights from the others
    others = [weighted(keys, weights_of(*(by_fold.sum(axis=1) - by_fold[:, f]), *(max(1, int(n)) for n in (sizes.sum(axis=0) - sizes[f])[::-1]))[0]) for f in range(FOLDS)]
    shared = spark.sparkContext.broadcast(others)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in np.unique(batch.column(0).to_numpy()):
                own = batch.filter(pa.array(batch.column(0).to_numpy() == f))
                rows = [(n, [s for _, _, s in seg]) for n, seg, *_ in text_segments(ToxicityModel(*shared.value[f]), own.column(1).to_pylist())]
                best = pa.array([max(s, default=0.0) for _, s in rows], pa.float64())
                yield pa.RecordBatch.from_arrays([own.column(2), pa.array([n for n, _ in rows], pa.int64()), best, pa.array([s for _, s in rows], pa.list_(pa.float64()))], ["toxic", "n", "best", "scores"])
        give_back()

    seen = cut(train.mapInArrow(top, "toxic int, n long, best double, scores array<double>"), "toxicity-scores")
    clean = seen.filter("toxic = 0").select("n", "best").toArrow()  # as many rows as the sample
    model.lam, model.k = fit_extremes(clean["best"].to_numpy(), clean["n"].to_numpy(), lam)
    evidence = F.aggregate("scores", F.lit(0.0), lambda total, s: total + F.greatest(F.lit(0.0), F.lit(model.lam) * s - F.log(F.lit(model.k) * F.greatest("n", F.lit(1)))))
    x = seen.select("toxic", evidence.alias("evidence")).toArrow()
    model.slope, model.offset = fit_logistic(np.log1p(x["evidence"].to_numpy()), x["toxic"].to_numpy().astype(float))
    return model


RESULT = "doc_id long, held_out boolean, score double, predicted int, n_passages int, passages array<struct<begin:int,end:int,score:double,chance:double>>"


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, n_passages, passages`` of every row; passages are code point spans.

    Defined results: a null or empty text has no passages and the score of no evidence; a null id is kept with
    held_out false; repeated rows are scored once each; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # the words of the sample
    schema = to_arrow_schema(StructType.fromDDL(RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, passages = [], []
            for n, segments, start, end in text_segments(m, [t or "" for t in batch.column(2).to_pylist()]):
                scores.append(m.score(m.evidence(segments, n)))
                passages.append([{"begin": int(start[a]), "end": int(end[b]), "score": s, "chance": c} for a, b, s in segments if (c := m.chance(s, n)) <= PASSAGE_CHANCE])
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), predicted, pa.array(list(map(len, passages)), pa.int32()), pa.array(passages, schema.field("passages").type)], schema=schema)

    doc_id = F.col(id_col).cast("long")
    held_out = F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
    return docs.select(doc_id.alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, RESULT)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model does not call toxic; nothing is shuffled."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            clean = [m.score(m.evidence(segments, n)) < 0.5 for n, segments, *_ in text_segments(m, texts)]
            yield batch.filter(pa.array(clean, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``labels`` and score all of ``docs``."""
    return score_documents(docs, fit(docs, labels))
