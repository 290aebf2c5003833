"""Benchmark decontamination: BM25 retrieval by block-max WAND over an inverted index of test items, then verification.

Test items, in parts of at most 64 words, make up the index; BM25 weights are divided by the part's score of its own
words, so one threshold fits all parts.  Training texts are cut into blocks of 64 words, and every two neighbouring
blocks are one passage and one query: an item that stands in a text lies whole in some passage.  Block maxima are first summed
for whole batches of passages: one with no range of parts whose bound reaches the threshold can retrieve nothing.  For
the others block-max WAND finds all parts that reach the threshold.  A retrieved item is verified by the share of its
question's and its answer's five-word shingles that the text holds nearby: half of each, or most of both together.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, give_back, scratch_path, small_batches
from .textvec import chunks, mix, words

#: Words of an index part and of a text block; a passage is two blocks.
PART = 64
K1, B = 1.2, 0.75
#: Postings of a block that shares one maximum.
POSTINGS = 64
#: Ranges of parts that have a maximum of their own for every term, at most.
RANGES = 256
#: Text blocks whose bounds are summed at a time.
BOUNDED = 8192
#: Share of its own score that a part must reach to be retrieved.
RETRIEVE = 0.4
#: Words of a shingle, and the share of shingles of question and of answer that verify an item.
SHINGLE, OVERLAP = 5, 0.5
#: Share of all of an item's shingles that verifies it if question and answer have any: short sides lose half to one changed word.
WHOLE = 0.7
#: Test items of one index, about; more items make more indexes, each of which all texts are run against.
INDEX_ITEMS = 20_000
CHUNK = 500_000
#: Code points of texts that are run against one index after the other: a worker holds one index at a time.
HELD = 32_000_000

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n]
    for k in range(1, width):
        h = mix(h * _STEP) + hashes[k : k + n]
    return h


def question_and_answer(text: str, count: int, starts: np.ndarray) -> int:
    """Number of words of the question: up to the last sentence, or two thirds where that leaves a side under five."""
    for place in range(len(text) - 2, 0, -1):
        if text[place] in ".!?\n" and (text[place] == "\n" or text[place + 1].isspace()):
            cut = int(np.searchsorted(starts, place))
            if SHINGLE <= cut <= count - SHINGLE:
                return cut
    return -(-2 * count // 3) if count >= 3 * SHINGLE else 0


@dataclass
class Item:
    item_id: int
    width: int
    question: np.ndarray
    answer: np.ndarray
    words: int


class BlockMaxIndex:
    """Inverted index with maxima of terms and of posting blocks."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes, of, start, _ = words([t for _, t in items])
        self.items: list[Item] = []
        parts: list[tuple[int, np.ndarray]] = []
        for k, (item_id, text) in enumerate(items):
            own = hashes[of[k] : of[k + 1]]
            n = len(own)
            if not n:
                continue
            width = min(SHINGLE, n)
            cut = question_and_answer(text, n, start[of[k] : of[k + 1]])
            question, answer = (own[:cut], own[cut:]) if cut else (own, own)
            for a in range(0, n, PART):
                parts.append((len(self.items), own[a : a + PART]))
            self.items.append(Item(item_id, width, np.unique(shingles(question, width)), np.unique(shingles(answer, width)), n))
        self.part_item = np.array([k for k, _ in parts], np.int64)
        lengths = np.array([len(w) for _, w in parts], float)
        n_parts = len(parts)
        term = np.concatenate([w for _, w in parts]) if parts else np.zeros(0, np.uint64)
        part = np.repeat(np.arange(n_parts), lengths.astype(np.int64))
        self.vocabulary, number = np.unique(term, return_inverse=True)
        pair, tf = np.unique(number * max(1, n_parts) + part, return_counts=True)
        number, part = pair // max(1, n_parts), pair % max(1, n_parts)
        df = np.bincount(number, minlength=len(self.vocabulary))
        idf = np.log(1 + (n_parts - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / (lengths.mean() if n_parts else 1.0))
        weight = idf[number] * tf * (K1 + 1) / (tf + norm[part])
        own_score = np.bincount(part, weight, n_parts)
        weight = weight / own_score[part]
        edges = np.searchsorted(number, np.arange(len(self.vocabulary) + 1))
        self.postings = [part[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.weights = [weight[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.block_max = [[max(w[a : a + POSTINGS]) for a in range(0, len(w), POSTINGS)] for w in self.weights]
        self.term_max = np.array([max(w) for w in self.weights]) if self.weights else np.zeros(0)

        # maxima of (term, range of parts), a row of them for each term
        self.span = max(1, -(-n_parts // RANGES))
        key = number * RANGES + part // self.span
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        self.range_max = np.maximum.reduceat(weight, heads) if len(heads) else weight
        self.range_of = key[heads] % RANGES
        self.range_edges = np.searchsorted(key[heads] // RANGES, np.arange(len(self.vocabulary) + 1))

    def bounds(self, block: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Largest possible score of each of ``n`` blocks in each range of parts; pairs are (block, term)."""
        count = self.range_edges[term + 1] - self.range_edges[term]
        before = np.cumsum(count) - count
        at = np.repeat(self.range_edges[term] - before, count) + np.arange(int(count.sum()))
        return np.bincount(np.repeat(block, count) * RANGES + self.range_of[at], self.range_max[at], n * RANGES).reshape(n, RANGES)

    def candidates(self, pair_block: np.ndarray, term: np.ndarray, edges: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Blocks that begin a passage whose bound reaches the threshold."""
        out = []
        for a in range(0, len(follows), BOUNDED):
            b = min(a + BOUNDED + 1, len(follows))  # one more: a passage takes the block that follows
            pairs = slice(edges[a], edges[b])
            bound = self.bounds(pair_block[pairs] - a, term[pairs], b - a)
            passage = bound[: min(BOUNDED, len(follows) - a)].copy()
            onward = np.flatnonzero(follows[a : a + len(passage)])
            passage[onward] += bound[onward + 1]
            likely = np.flatnonzero(passage.max(axis=1) >= RETRIEVE - 1e-6)
            # those again, with words of both blocks counted once
            first, count = edges[a + likely], edges[a + likely + 1 + follows[a + likely]] - edges[a + likely]
            of = np.repeat(np.arange(len(likely)), count)
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            pairs = np.unique(of * len(self.vocabulary) + term[at])
            exact = self.bounds(pairs // len(self.vocabulary), pairs % len(self.vocabulary), len(likely))
            out.append(a + likely[exact.max(axis=1, initial=0.0) >= RETRIEVE - 1e-6])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def retrieve(self, terms: list[int], threshold: float = RETRIEVE) -> list[tuple[int, float]]:
        """All parts whose score for the distinct ``terms`` reaches ``threshold``, by block-max WAND."""
        cursors = [[self.postings[t][0], 0, t] for t in terms]  # current part, place, term
        top, out = self.term_max, []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += top[c[2]]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return out
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            # the blocks that would hold the target
            bound, beyond = 0.0, math.inf
            for c in cursors[: pivot + 1]:
                posting = self.postings[c[2]]
                block = c[1] // POSTINGS
                last = min(len(posting), (block + 1) * POSTINGS) - 1
                while posting[last] < target and last + 1 < len(posting):
                    block += 1
                    last = min(len(posting), (block + 1) * POSTINGS) - 1
                if posting[last] >= target:
                    bound += self.block_max[c[2]][block]
                    beyond = min(beyond, posting[last] + 1)
            if bound < threshold - 1e-9:  # no part up to the nearest block end can reach it
                if pivot + 1 < len(cursors):
                    beyond = min(beyond, cursors[pivot + 1][0])
                goal = max(target + 1, beyond) if beyond < math.inf else target + 1
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == target:
                score = sum(self.weights[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    out.append((target, score))
                goal, moved = target + 1, cursors[: pivot + 1]
            else:
                goal, moved = target, [c for c in cursors[:pivot] if c[0] < target]
            for c in moved:
                posting, at = self.postings[c[2]], c[1]
                while at < len(posting) and posting[at] < goal:
                    if at % POSTINGS == 0 and at + POSTINGS <= len(posting) and posting[at + POSTINGS - 1] < goal:
                        at += POSTINGS
                    else:
                        at += 1
                c[1] = at
                c[0] = posting[at] if at < len(posting) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def verify(self, item: Item, hashes: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and of the answer's shingles among the words ``hashes``."""
        near = shingles(hashes, item.width)
        share = lambda own: float(np.isin(own, near).mean()) if len(own) else 0.0
        return share(item.question), share(item.answer)

    def search(self, texts: list[str]) -> Iterator[list[tuple[int, float]]]:
        """For each text the verified items and their overlap (the smaller of question's and answer's)."""
        if not self.items:
            yield from ([] for _ in texts)
            return
        hashes, of, *_ = words(texts)
        sizes = np.diff(of)
        blocks = -(-sizes // PART)
        first = np.append(0, np.cumsum(blocks))
        place = np.arange(len(hashes)) - np.repeat(of[:-1], sizes)
        block = np.repeat(first[:-1], sizes) + place // PART
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = np.flatnonzero(self.vocabulary[at] == hashes)
        pairs = np.unique(block[known] * len(self.vocabulary) + at[known])
        pair_block, term = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        edges = np.searchsorted(pair_block, np.arange(first[-1] + 1))
        follows = np.ones(first[-1], bool)
        follows[first[1:][blocks > 0] - 1] = False  # a text's last block
        found: dict[int, dict[int, float]] = {}
        text_of = np.repeat(np.arange(len(texts)), blocks)
        for k in self.candidates(pair_block, term, edges, follows).tolist():
            if not follows[k] and k > 0 and follows[k - 1]:
                continue  # the last block alone is part of the passage before
            end = k + 2 if follows[k] else k + 1
            terms = np.unique(term[edges[k] : edges[end]]).tolist()
            i = int(text_of[k])
            for part, _ in self.retrieve(terms):
                number = int(self.part_item[part])
                item = self.items[number]
                begin = of[i] + (k - first[i]) * PART
                near = hashes[max(of[i], begin - item.words) : min(of[i + 1], begin + 2 * PART + item.words)]
                question, answer = self.verify(item, near)
                whole = (question * len(item.question) + answer * len(item.answer)) / (len(item.question) + len(item.answer))
                overlap = max(min(question, answer), whole if min(question, answer) > 0 and whole >= WHOLE else 0.0)
                if overlap >= OVERLAP:
                    own = found.setdefault(i, {})
                    own[item.item_id] = max(overlap, own.get(item.item_id, 0.0))
        for i in range(len(texts)):
            yield sorted(found.get(i, {}).items())



def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[str, int]:
    """Build indexes of all test items on the executors, each of about ``INDEX_ITEMS``; their folder and their number.

    They are files of the shared folder: neither the driver nor a broadcast holds them.  Items without id or text are left out.
    """
    spark = benchmark.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    items = cut(items, "test-items")
    n = items.count()
    parts = -(-n // INDEX_ITEMS)
    folder = scratch_path(spark, "test-indexes")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store, base = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        rows = rows.sort_values(["item_id", "text"])
        name = f"{base}/{int(key[0])}"
        passing = f"{name}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(passing) as f:
            f.write(pickle.dumps(BlockMaxIndex(list(zip(rows["item_id"].tolist(), rows["text"].tolist(), strict=True))), pickle.HIGHEST_PROTOCOL))
        store.move(passing, name)  # the same bytes, whichever attempt wrote them
        return pd.DataFrame({"part": [int(key[0])], "items": [len(rows)]})

    if parts:
        built = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts))).groupBy("part").applyInPandas(build, "part long, items long")
        made = {r.part: r["items"] for r in built.collect()}  # a row an index
        if sum(made.values()) != n:
            raise ValueError(f"indexes hold {sum(made.values())} of {n} items")
        return folder, max(made) + 1
    return folder, 0


@lru_cache(maxsize=1)
def load_index(folder: str, part: int) -> BlockMaxIndex | None:
    """One index; None for a number that no item fell to."""
    store, base = arrow_fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{base}/{part}").type != arrow_fs.FileType.File:
        return None
    with store.open_input_file(f"{base}/{part}") as f:
        return pickle.loads(f.read())


def search_all(folder: str, parts: int, texts: list[str | None]) -> list[list[tuple[int, float]]]:
    """The verified items of each text, over all indexes, one after the other."""
    own = [t or "" for t in texts]
    hits: list[list] = [[] for _ in own]
    for k in range(parts):
        if (index := load_index(folder, k)) is None:
            continue
        for part in chunks([len(t) for t in own], CHUNK):
            for i, found in enumerate(index.search(own[part]), part.start):
                hits[i] += found
    return hits


def gathered(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts have ``HELD`` bytes, so that an index is loaded once for all of them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(at).nbytes
        if size >= HELD:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item; nothing is shuffled."""
    folder, parts = indexes(benchmark)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, at) if parts > 1 else batches:
            clean = [not found for found in search_all(folder, parts, batch.column(at).to_pylist())]
            yield batch.filter(pa.array(clean, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, max_overlap`` of every row.

    Defined results: a null or empty text or item, or an empty benchmark, gives no contamination; an item of fewer
    than five words must stand as a whole; rows that repeat a document come out once each; null ids are kept;
    other columns are ignored.
    """
    schema = to_arrow_schema(StructType.fromDDL("doc_id long, items array<struct<item_id:long,overlap:double>>"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    folder, parts = indexes(benchmark, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1) if parts > 1 else batches:
            hits = [[{"item_id": a, "overlap": b} for a, b in own] for own in search_all(folder, parts, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, schema.field("items").type)], schema=schema)

    found = texts.mapInArrow(run, "doc_id long, items array<struct<item_id:long,overlap:double>>")
    ids = F.array_sort(F.array_distinct(F.col("items.item_id")))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"), F.array_max(F.col("items.overlap")).alias("max_overlap"))
