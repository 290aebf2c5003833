"""Language identification by interpolated Kneser-Ney character models.

One model a language, of order four over lower-case characters with white space folded.  All models share sorted
arrays of n-gram hashes, one for each order, with a column of log-probabilities and one of back-off weights for every
language, so one search serves all languages.  A text goes to the language of lowest cross-entropy a character;
the margin to the second calibrates the score, and texts that fit their language worse than nearly all of its texts do
are marked rejected.  Both are calibrated on training documents that gave no n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, small_batches
from .textvec import LETTER, MARK, SPACE, char_classes, chunks, code_points, lower, mix, segment_sums

ORDER = 4
#: Training documents of each language, at most in expectation: with SAMPLE_CHARS the only bounded sample.
SAMPLE = 2_000
#: Characters of a language's training documents, at most in expectation; the model keeps all n-grams of what is drawn.
SAMPLE_CHARS = 4_000_000
#: One in so many training documents calibrates score and rejection and gives no n-grams.
ASIDE = 5
#: Standard deviations above a language's mean cross-entropy from which a text is rejected.
REJECT = 4.0
UNKNOWN = "und"
CHUNK = 500_000

_STEP = 0x9E3779B97F4A7C15


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the 1- to ORDER-grams that end at each character of texts, the texts' bounds, and their letter counts.

    Each text stands behind one space, runs of white space count as one, and an n-gram that would reach over the
    text's beginning is that of the characters there are, behind zeros.
    """
    cps, bounds = code_points([" " + lower(t) for t in texts])
    kind = char_classes()[cps]
    space = kind == SPACE
    keep = np.ones(len(cps), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[bounds[:-1]] = True
    cps = np.where(space, 32, cps)[keep]
    letters = np.diff(np.concatenate([[0], np.cumsum((kind == LETTER) | (kind == MARK))])[bounds])
    bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
    first = np.repeat(bounds[:-1], np.diff(bounds))
    place = np.arange(len(cps)) - first
    symbol = mix(cps.astype(np.uint64) + np.uint64(1))
    grams, h = [], np.zeros(len(cps), np.uint64)
    for n in range(ORDER):
        earlier = np.zeros(len(cps), np.uint64)
        if n:
            earlier[n:] = symbol[:-n] if n < len(cps) else 0
            earlier[place < n] = 0
        else:
            earlier = symbol
        h = h + mix(earlier + np.uint64((n + 1) * _STEP % (1 << 64)))
        grams.append(mix(h))
    return grams, bounds, letters


@dataclass
class LanguageModels:
    """Sorted hash arrays of all orders, of n-grams and of their contexts, with a row of values for each and a column for
    each language."""

    languages: list[str]
    keys: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    back_off: list[np.ndarray]
    floor: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    @staticmethod
    def find(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash among sorted ``keys``, -1 where it is unknown."""
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.searchsorted(keys, hashes)
        at[at == len(keys)] = 0
        at[keys[at] != hashes] = -1
        return at

    def log_probabilities(self, grams: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of every character under every language."""
        out = np.zeros((len(grams[0]), len(self.languages)), np.float32)
        left = np.arange(len(grams[0]))
        for n in range(ORDER - 1, -1, -1):
            row = self.find(self.keys[n], grams[n][left])
            hit = row >= 0
            out[left[hit]] += self.log_p[n][row[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if n:  # back off: the weight of the context, which is the (n)-gram that ends a character earlier
                context = np.where(left > 0, grams[n - 1][left - 1], 0)
                row = self.find(self.contexts[n], context)
                known = row >= 0
                out[left[known]] += self.back_off[n][row[known]]
        out[left] += self.floor
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy a character of every text under every language; characters and letters of each text."""
        grams, bounds, letters = ngrams(texts)
        sizes = np.diff(bounds)
        # the space before each text is context alone
        log_p = self.log_probabilities(grams)
        log_p[bounds[:-1]] = 0
        return -segment_sums(log_p, bounds) / np.maximum(1, sizes - 1)[:, None], sizes - 1, letters

    def margins(self, entropy: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and a margin to the second that grows with the text's length."""
        best = entropy.argmin(1)
        if entropy.shape[1] == 1:
            return best, np.full(len(best), 10.0)
        two = np.partition(entropy, 1, axis=1)
        return best, np.log1p((two[:, 1] - two[:, 0]) * np.sqrt(np.maximum(sizes, 1)))


def build(counts: pd.DataFrame, languages: list[str]) -> LanguageModels:
    """Interpolated Kneser-Ney from n-gram counts: columns ``n, gram, context, suffix, language, count``.

    The highest order is counted by occurrences, lower orders by the distinct characters before them.  ``context`` is
    the hash without the last character, ``suffix`` that without the first.
    """
    k = len(languages)
    keys, log_p, contexts, back_off = [], [], [], []
    floor = np.full(k, -np.log(4096.0))
    lower_p: tuple[np.ndarray, np.ndarray] | None = None
    tables = {n: g for n, g in counts.groupby("n")}
    for n in range(ORDER):
        own = tables.get(n, counts.iloc[:0])
        gram = np.sort(own["gram"].unique())
        at = np.searchsorted(gram, own["gram"].to_numpy())
        times = np.zeros((len(gram), k))
        times[at, own["language"].to_numpy()] = own["count"].to_numpy()
        last = own.drop_duplicates("gram")
        place = np.searchsorted(gram, last["gram"].to_numpy())
        context, suffix = np.zeros(len(gram), np.uint64), np.zeros(len(gram), np.uint64)
        context[place], suffix[place] = last["context"].to_numpy(), last["suffix"].to_numpy()
        if n < ORDER - 1:  # continuation counts: kinds of (n + 2)-grams that end in this one
            above = tables.get(n + 1, counts.iloc[:0])
            where = np.searchsorted(gram, above["suffix"].to_numpy())
            where[where == len(gram)] = 0
            ok = gram[where] == above["suffix"].to_numpy() if len(gram) else np.zeros(0, bool)
            kinds = np.zeros_like(times)
            np.add.at(kinds, (where[ok], above["language"].to_numpy()[ok]), 1)
            times = np.where(kinds > 0, kinds, np.minimum(times, 1))
        ones, twos = (times == 1).sum(0), (times == 2).sum(0)
        discount = np.clip(ones / np.maximum(1, ones + 2 * twos), 0.1, 0.95)
        # totals and distinct followers of each context
        kinds_of, group = np.unique(context, return_inverse=True)
        total, followers = np.zeros((len(kinds_of), k)), np.zeros((len(kinds_of), k))
        np.add.at(total, group, times)
        np.add.at(followers, group, times > 0)
        weight = np.where(total > 0, discount * followers / np.maximum(total, 1), 1.0)
        if n == 0:
            lower_value = np.exp(floor)[None, :]
            unseen = floor + np.log(weight[0]) if len(weight) else floor  # a character that no text holds
        else:
            below, value = lower_p
            where = np.searchsorted(below, suffix)
            where[where == len(below)] = 0
            known = below[where] == suffix
            lower_value = np.where(known[:, None], value[where], np.exp(floor)[None, :])
        p = np.maximum(times - discount, 0) / np.maximum(total[group], 1) + weight[group] * lower_value
        keys.append(gram)
        log_p.append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
        contexts.append(kinds_of)
        back_off.append(np.log(weight).astype(np.float32))
        lower_p = gram, p
    return LanguageModels(languages, keys, log_p, contexts, back_off, unseen.astype(np.float32), np.zeros(k), np.ones(k))


def count_ngrams(texts: list[str], language: np.ndarray) -> pd.DataFrame:
    """``n, gram, context, suffix, language, count`` of the n-grams of texts; ``n`` is the order less one."""
    grams, bounds, _ = ngrams(texts)
    of = np.repeat(language, np.diff(bounds)).astype(np.uint64)
    begins = np.zeros(len(of), bool)
    begins[bounds[:-1]] = True
    usable = np.flatnonzero(~begins)
    out = []
    for n in range(ORDER):
        h = grams[n][usable]
        _, first, times = np.unique(h ^ mix(of[usable] + np.uint64(77)), return_index=True, return_counts=True)
        at = usable[first]
        context = grams[n - 1][at - 1] if n else np.zeros(len(at), np.uint64)
        suffix = grams[n - 1][at] if n else np.zeros(len(at), np.uint64)
        out.append(pd.DataFrame({"n": np.full(len(at), n, np.int32), "gram": grams[n][at], "context": context, "suffix": suffix, "language": of[at].astype(np.int32), "count": times.astype(np.int64)}))
    return pd.concat(out, ignore_index=True)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModels:
    """Fit on rows with a language whose crc32(id) mod 5 is not 0; about ``sample`` documents of each language at most.

    Null ids, texts and languages are left out.  Without any row the model knows no language.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    counts = {r.lang: (r.n, r.chars or 0) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModels([], *([np.zeros(0, np.uint64)] * ORDER, [np.zeros((0, 0))] * ORDER) * 2, np.zeros(0), np.zeros(0), np.ones(0))
    share = F.create_map(*[x for k, (n, chars) in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / n, SAMPLE_CHARS / max(1, chars))))])
    place = (F.xxhash64(F.lit(1), "doc_id") / F.lit(2.0**64)) + 0.5
    number = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    aside = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(ASIDE)) == 0
    train = cut(rows.filter((place <= share[F.col("lang")]) & F.col("text").isNotNull()).select("text", number[F.col("lang")].alias("language"), aside.alias("aside")), "langid-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, language = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for part in chunks([len(t) for t in texts], CHUNK):
                table = count_ngrams(texts[part], language[part])
                for c in ("gram", "context", "suffix"):
                    table[c] = table[c].to_numpy().view(np.int64)
                yield pa.RecordBatch.from_pandas(table, preserve_index=False)

    keys = ["n", "gram", "context", "suffix", "language"]
    grams = train.filter("not aside").mapInArrow(count, "n int, gram long, context long, suffix long, language int, count long").groupBy(*keys).agg(F.sum("count").alias("count"))
    table = grams.toArrow().to_pandas()  # the n-grams of the sample: bounded by ORDER * languages * SAMPLE_CHARS
    for c in ("gram", "context", "suffix"):
        table[c] = table[c].to_numpy(np.int64).view(np.uint64)
    model = build(table, languages)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in chunks([len(t) for t in texts], CHUNK):
                entropy, sizes, letters = shared.value.entropies(texts[part])
                best, margin = shared.value.margins(entropy, sizes)
                right = best == batch.column(1).to_numpy()[part]
                ok = letters > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (best.astype(np.int32), margin, right, entropy[np.arange(len(best)), best], sizes)], ["best", "margin", "correct", "entropy", "size"])

    seen = train.filter("aside").mapInArrow(judge, "best int, margin double, correct boolean, entropy double, size long").toArrow().to_pandas()  # a part of the sample
    if len(seen):
        from .toxicity import fit_logistic

        model.slope, model.offset = fit_logistic(seen["margin"].to_numpy(), seen["correct"].to_numpy(float))
        for i in range(len(languages)):
            own = seen[(seen["best"] == i) & seen["correct"] & (seen["size"] >= 20)]["entropy"]
            if len(own) > 1:
                model.mean[i], model.deviation[i] = own.mean(), max(own.std(), 1e-3)
    return model


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


def predict(docs: DataFrame, model: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cross_entropy, rejected`` of every row, from the whole text.

    Defined results: a null text, one without a letter, or a model without languages gives ``und`` with score 0,
    rejected; a null id is kept with held_out false; repeated rows are judged once each; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the n-grams of the sample
    schema = to_arrow_schema(StructType.fromDDL(RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for part in chunks([len(t) for t in texts], CHUNK):
                own = texts[part]
                if m.languages:
                    entropy, sizes, letters = m.entropies(own)
                    best, margin = m.margins(entropy, sizes)
                    score = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.offset, -50, 50)))
                    lowest = entropy[np.arange(len(own)), best]
                    rejected = lowest > m.mean[best] + REJECT * m.deviation[best]
                    none = letters == 0
                    best = np.where(none, len(m.languages), best)
                    score, lowest = np.where(none, 0.0, score), np.where(none, np.nan, lowest)
                    rejected |= none
                else:
                    best, score, lowest, rejected = np.zeros(len(own), int), np.zeros(len(own)), np.full(len(own), np.nan), np.ones(len(own), bool)
                a, n = part.start, len(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(lowest, from_pandas=True), pa.array(rejected)],
                    schema=schema,
                )

    doc_id = F.col(id_col).cast("long")
    held_out = F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
    return docs.select(doc_id.alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, RESULT)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled part of ``docs`` and predict all of it."""
    return predict(docs, fit(docs))
