"""The four places where a model plugs in, each behind Arrow batches, and stand-ins that need none.

A model is any object with the method that its interface names.  It is sent to the executors once, and sees lists of
texts, a batch at a time; rows keep all their columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructType

#: Texts that go to a model at a time.
EMBEDDED, SCORED, JUDGED, ASKED = 64, 16, 8, 1

# Fixed value: what stands before a question, not before a document, when it is embedded.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


@runtime_checkable
class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """A row of ``dimension`` numbers for each text."""


@runtime_checkable
class PairModel(Protocol):
    def score_pairs(self, questions: list[str], passages: list[str]) -> np.ndarray:
        """A number for each pair; larger is better."""


@runtime_checkable
class NliModel(Protocol):
    def probabilities(self, premises: list[str], hypotheses: list[str]) -> np.ndarray:
        """A row of contradiction, neutral, entailment for each pair."""


@runtime_checkable
class ClaimGenerator(Protocol):
    def generate(self, prompt: str, temperature: float) -> str:
        """An answer, a JSON object with claims."""


def added(rows: DataFrame, inputs: list[str], outputs: StructType, work: Callable[..., list[pa.Array]], size: int) -> DataFrame:
    """``rows`` with further columns that ``work`` makes from lists of the inputs' texts, ``size`` rows at a time."""
    schema = StructType([f for f in rows.schema if f.name not in outputs.names] + list(outputs))
    kept = [f for f in rows.columns if f not in outputs.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                texts = [[t or "" for t in part.column(c).to_pylist()] for c in inputs]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *work(*texts)], schema.names)

    return rows.mapInArrow(run, schema)


def embedded(rows: DataFrame, text_col: str, model: Embedder, prefix: str = "", out: str = "embedding", size: int = EMBEDDED) -> DataFrame:
    """Adds a vector of length 1 for each text; an all-zero vector stays.  Questions take ``prefix=QUERY_PREFIX``."""

    def work(texts: list[str]) -> list[pa.Array]:
        x = np.asarray(model.embed([prefix + t for t in texts]), np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return [pa.array((x / np.where(norm > 0, norm, 1)).astype(np.float32).tolist(), pa.list_(pa.float32()))]

    return added(rows, [text_col], StructType().add(out, ArrayType(FloatType())), work, size)


def pair_scorer(model: PairModel, size: int = SCORED) -> Callable[[DataFrame, str, str], DataFrame]:
    """A scorer for ``retrieval.rerank``."""
    work = lambda q, p: [pa.array(np.asarray(model.score_pairs(q, p), np.float64))]
    return lambda rows, question, passage: added(rows, [question, passage], StructType().add("score", DoubleType()), work, size)


def nli_scorer(model: NliModel, size: int = JUDGED) -> Callable[[DataFrame, str, str], DataFrame]:
    """A scorer for ``answers.verify`` and ``answers.gate``."""

    def work(premises: list[str], hypotheses: list[str]) -> list[pa.Array]:
        p = np.asarray(model.probabilities(premises, hypotheses), np.float64)
        return [pa.array(p[:, k]) for k in (2, 1, 0)]

    shape = StructType().add("entailment", DoubleType()).add("neutral", DoubleType()).add("contradiction", DoubleType())
    return lambda rows, premise, hypothesis: added(rows, [premise, hypothesis], shape, work, size)


def generated(prompts: DataFrame, model: ClaimGenerator, temperature: float = 0.2, prompt_col: str = "prompt") -> DataFrame:
    """Adds ``raw``, the model's answer to each prompt; where it fails the answer is empty, so that extraction takes over."""
    if not 0 <= temperature <= 1:
        raise ValueError("0 <= temperature <= 1 is required")

    def ask(prompt: str) -> str:
        try:
            return model.generate(prompt, temperature)
        except Exception:  # noqa: BLE001  an unreachable model is no error of the job: its claims are extracted instead
            return ""

    return added(prompts, [prompt_col], StructType().add("raw", StringType()), lambda texts: [pa.array([ask(t) for t in texts], pa.string())], ASKED)


class HashingEmbedder:
    """Stand-in: counts of a text's words, each in the column and with the sign that its hash gives."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"[a-z0-9]+", text.lower()):
                h = zlib.crc32(word.encode())
                row[h % self.dimension] += 1 if h >> 16 & 1 else -1
        return out


class CoverageModel:
    """Stand-in for both pair models: the rules of ``retrieval.overlap`` and ``answers.stand_in_nli``, in Python."""

    @staticmethod
    def words(text: str) -> list[str]:
        import re

        return re.findall(r"[a-z0-9]+", text.lower())

    def coverage(self, of: str, by: str) -> float:
        wanted = set(self.words(of))
        return len(wanted & set(self.words(by))) / len(wanted) if wanted else 0.0

    def score_pairs(self, questions: list[str], passages: list[str]) -> np.ndarray:
        return np.array([self.coverage(q, p) + 0.01 / (1 + len(self.words(p))) for q, p in zip(questions, passages, strict=True)])

    def probabilities(self, premises: list[str], hypotheses: list[str]) -> np.ndarray:
        out = []
        for p, h in zip(premises, hypotheses, strict=True):
            c = self.coverage(h, p)
            yes, no = c * c, (1 - c) * 0.1
            if any(w in ("not", "no", "never") for w in self.words(p)) != any(w in ("not", "no", "never") for w in self.words(h)):
                yes, no = no, yes
            out.append((no, 1 - yes - no, yes))
        return np.array(out).reshape(-1, 3)
