"""Best-fit packing of token sequences by the sum-of-squares rule.

Documents become token ids; ids are cut into pieces of at most one sequence, and pieces are placed in sequences
(bins) so that the sum over residual gaps of the squared number of open bins with that gap stays smallest.  The
rule needs lengths only, so placement runs on (piece, length) rows: a first round packs independent groups of
bounded size, a second packs what they left open, so that no group's remainder costs a sequence of its own.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, give_back, small_batches
from .textvec import LETTER, MARK, OTHER, SPACE, HashTable, char_classes, chunks, code_points, span_hashes

#: Tokens in a sequence.
CAPACITY = 2048
#: Pieces that one task of the first round places.
GROUP = 100_000
#: Distinct words whose ids a Python worker remembers.
REMEMBERED = 100_000
#: Code points that are cut into words at a time.
CHUNK = 500_000

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for: printable bytes are shown as
    themselves, the others as the characters from U+0100 on, in order."""
    printable = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelTokenizer:
    """Ids of a byte-level BPE vocabulary, a batch of texts at a time.

    Text is split into words by the vocabulary's own splitting rule, done on arrays of character classes; each
    distinct word is merged once, by the ranks that the vocabulary file gives, and its ids are remembered together with
    its characters, with which every later occurrence is compared.  Ids equal those of the ``tokenizers`` library
    (tested); they come several times faster.  With ``added``, strings that the file lists as added tokens get their own
    ids, as the library gives them; without, they are ordinary text, as with the library's ``encode_special_tokens``.
    """

    def __init__(self, path: str, added: bool = False):
        with open(path, encoding="utf-8") as f:
            loaded = json.load(f)
        vocabulary = loaded["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in loaded["added_tokens"]} if added else {}
        self.parted = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        shown = byte_alphabet()
        import tiktoken

        # Ids of a byte-level vocabulary stand in the order of its merges, so they serve as ranks.
        ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if all(c in shown for c in token)}
        self.encode_word = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.clear()

    def clear(self) -> None:
        self.table = HashTable(2 * REMEMBERED)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0
        self.characters, self.written = np.zeros(1 << 16, np.uint32), 0
        self.spelt, self.letters = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def splits(self, cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where words begin, in order."""
        kind = char_classes()[cps]
        kind[kind == MARK] = OTHER
        n = len(cps)
        starts = np.ones(n, bool)
        same = (kind[1:] == kind[:-1]) & (kind[1:] != SPACE)
        starts[1:] = ~same
        text_start = np.zeros(n + 1, bool)
        text_start[bounds] = True
        text_start = text_start[:n]
        # White space: all but the last character of a run stay together; a last plain space joins what follows.
        space = kind == SPACE
        next_in_text = np.zeros(n, bool)
        next_in_text[:-1] = ~text_start[1:]
        followed = np.zeros(n, bool)  # by a character of the same text that is no space
        followed[:-1] = next_in_text[:-1] & ~space[1:]
        prior_space = np.zeros(n, bool)
        prior_space[1:] = space[:-1] & ~text_start[1:]
        starts[space & prior_space & ~followed] = False
        plain = (cps == 32) & followed
        after = np.zeros(n, bool)
        after[1:] = plain[:-1]
        starts[after] = False
        starts |= text_start
        # English contractions are words of their own where the apostrophe begins a word.
        quote = np.flatnonzero((cps == 39) & starts & followed)
        if len(quote):
            quote = quote[(kind[quote + 1] == LETTER)]
            for q in quote.tolist():
                stop = int(bounds[np.searchsorted(bounds, q, "right")])
                two = "".join(map(chr, cps[q + 1 : min(q + 3, stop)]))
                tail = 2 if two in ("re", "ve", "ll") else 1 if two[:1] in ("s", "t", "m", "d") else 0
                if tail:
                    starts[q + 1] = False
                    if q + 1 + tail < stop:
                        starts[q + 1 + tail] = True
        return np.flatnonzero(starts)

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        got = list(map(self.encode_word, texts))
        cps, bounds = code_points(texts)
        k, n = self.table.count, len(keys)

        def room(values: np.ndarray, need: int) -> np.ndarray:
            return values if need <= len(values) else np.concatenate([values, np.zeros(max(need - len(values), len(values)), values.dtype)])

        for place, many, begin, length, at, flat in (
            ("used", "ids", "at", "size", np.append(0, np.cumsum(list(map(len, got)))).astype(np.int64), np.fromiter(chain.from_iterable(got), np.uint32)),
            ("written", "characters", "spelt", "letters", bounds, cps),
        ):
            used = getattr(self, place)
            values, first, size = room(getattr(self, many), used + len(flat)), room(getattr(self, begin), k + n), room(getattr(self, length), k + n)
            values[used : used + len(flat)] = flat
            first[k : k + n], size[k : k + n] = used + at[:-1], np.diff(at)
            for name, v in ((place, used + len(flat)), (many, values), (begin, first), (length, size)):
                setattr(self, name, v)
        self.table.add(keys)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts in one array, and where each text's ids begin (one entry more than texts)."""
        if self.parted and any(t in text for text in texts for t in self.added):
            return self.encode_parted(texts)
        return self.encode_ordinary(texts)

    def encode_parted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode`` where added tokens stand in texts: what lies between them is encoded as texts of its own."""
        pieces, marks, edges = [], [], [0]
        for text in texts:
            at = 0
            for found in self.parted.finditer(text):
                pieces.append(text[at : found.start()])
                marks.append(self.added[found[0]])
                at = found.end()
            pieces.append(text[at:])
            marks.append(-1)  # the text's end
            edges.append(len(pieces))
        ids, of = self.encode_ordinary(pieces)
        marks = np.array(marks)
        real = marks >= 0
        out = np.insert(ids, of[1:][real], marks[real].astype(np.uint32))
        return out, (of + np.append(0, np.cumsum(real)))[edges]

    def encode_ordinary(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cps, bounds = code_points(texts)
        if not len(cps):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        start = self.splits(cps, bounds)
        end = np.append(start[1:], len(cps))
        keys = span_hashes(cps, start, end)
        if self.table.count > REMEMBERED:
            self.clear()
        slot = self.table.find(keys)
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            distinct, first = np.unique(keys[fresh], return_index=True)
            first = fresh[first]
            whole = "".join(texts)
            if self.table.count + len(distinct) > 2 * REMEMBERED:  # one chunk of mostly new words
                self.table = self.table.wider(len(distinct))
            self.learn(distinct, [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            slot[fresh] = self.table.find(keys[fresh])
        source, at, size = self.ids, self.at[slot], self.size[slot]
        if len(other := self.misspelt(slot, cps, start, end)):  # another word of the same hash
            whole = "".join(texts)
            own = [self.encode_word(whole[a:b]) for a, b in zip(start[other].tolist(), end[other].tolist(), strict=True)]
            size[other] = list(map(len, own))
            at[other] = len(source) + np.cumsum(size[other]) - size[other]
            source = np.concatenate([source, np.fromiter(chain.from_iterable(own), np.uint32)])
        before = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        ids = source[np.repeat(at - before[:-1], size) + np.arange(before[-1])]
        return ids, before[np.searchsorted(start, bounds)]

    def misspelt(self, slot: np.ndarray, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of words whose characters are not those remembered in their slots; words cover all of ``cps``."""
        length = end - start
        wrong = self.letters[slot] != length
        if wrong.any():
            return np.flatnonzero([a != b or (cps[s:e] != self.characters[p : p + b]).any() for a, b, s, e, p in zip(length, self.letters[slot], start, end, self.spelt[slot], strict=True)])
        same = self.characters[np.repeat(self.spelt[slot] - start, length) + np.arange(len(cps))] == cps
        return np.flatnonzero(~np.logical_and.reduceat(same, start))


@lru_cache(maxsize=2)
def tokenizer(path: str, added: bool) -> ByteLevelTokenizer:
    return ByteLevelTokenizer(path, added)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, added: bool = True) -> DataFrame:
    """Every piece of every document: ``doc_id, piece, start, length, ids_crc32``.

    A document's ids are those of its text and a closing id 0.  One longer than ``capacity`` is cut into pieces of
    ``capacity``, of which the first may be shorter.  A null text counts as empty: one piece of length 1.  ``added``:
    the vocabulary's added tokens, spelt out in a text, get their own ids.
    """
    small_batches(docs.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(PIECES))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(vocabulary or default_vocabulary(), added)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for part in chunks([len(t) for t in texts], CHUNK):
                ids, of = encoder.encode(texts[part])
                for doc_id, a, b in zip(doc_ids[part], of[:-1].tolist(), of[1:].tolist(), strict=True):
                    own = ids[a:b].astype("<u4").tobytes() + b"\0\0\0\0"
                    n = len(own) // 4
                    edge, begin = n % capacity or min(n, capacity), 0
                    for piece in range(-(-n // capacity)):
                        rows.append((doc_id, piece, begin, edge - begin, zlib.crc32(own[4 * begin : 4 * edge])))
                        begin, edge = edge, edge + capacity
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut_up, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed longest first.

    ``open_bins[g]`` counts the open bins with gap g.  Moving a bin from gap g to gap g - s changes the sum of squares by
    ``2 * (open_bins[g - s] - open_bins[g] + 1)``; gap 0 counts for nothing, as a full bin is closed, and a new bin is
    a move from a gap that holds none.  Ties go to the smallest gap, so the rule falls back to best fit.
    """
    order = np.argsort(-lengths, kind="stable")
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i in order.tolist():
        s = int(lengths[i])
        gap = capacity
        if s < capacity:
            here = open_bins[s:capacity]
            filled = np.flatnonzero(here)
            if len(filled):
                rest = open_bins[filled]  # gap after placement is filled itself, as here[k] is gap s + k
                change = 2 * (rest - here[filled] + 1)
                change[filled == 0] = 1 - 2 * here[0]
                k = int(np.argmin(change))
                # An open bin that takes the item is preferred to a new one: fewest sequences come first.
                gap = s + int(filled[k])
        if gap == capacity:
            b = made
            made += 1
        else:
            b = stacks[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if left := gap - s:
            stacks[left].append(b)
            open_bins[left] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Place rows with a ``length`` (1 to ``capacity``) in sequences: adds ``sequence_id`` and ``offset``.

    Full pieces are sequences already.  The rest is dealt by hash to groups of about ``group`` rows.  Bins
    that a group leaves less than half full come back as single items of the second round, in which
    ``group`` times as many pieces share a task's leftovers; a sequence is then known by its bin of the second round.
    """
    keyed = cut(pieces.withColumn("row_key", F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id())), "pack-rows")
    n = keyed.count()
    groups = max(1, -(-n // group))
    keyed = keyed.withColumn("part", F.pmod(F.col("row_key"), F.lit(groups)).cast("long"))

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "row_key"], ascending=[False, True, True, True], kind="stable")
        b, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        fill = np.bincount(b, rows["length"].to_numpy()).astype(np.int64)
        return rows.assign(bin=b, offset=offset, fill=fill[b])[names]

    names = [*[f for f in pieces.columns], "part", "bin", "offset", "fill"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = cut(keyed.repartition(groups, "part").groupBy("part").applyInPandas(first, f"{fields}, part long, bin long, offset long, fill long"), "pack-first")

    halves = placed.filter(F.col("fill") * 2 <= capacity).select("part", "bin", "fill").distinct()
    rounds = max(1, -(-groups // group))

    def second(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fill", "part", "bin"], ascending=[False, True, True])
        b, offset = sum_of_squares(rows["fill"].to_numpy(), capacity)
        head = rows.groupby(b)[["part", "bin"]].transform("first")
        return pd.DataFrame({"part": rows["part"], "bin": rows["bin"], "to_part": head["part"], "to_bin": head["bin"], "shift": offset})

    merged = halves.withColumn("task", F.pmod(F.xxhash64("part"), F.lit(rounds))).groupBy("task").applyInPandas(second, "part long, bin long, to_part long, to_bin long, shift long")
    out = placed.join(merged, ["part", "bin"], "left")
    sequence = F.coalesce("to_bin", "bin") * F.lit(groups) + F.coalesce("to_part", "part")
    return out.select(*pieces.columns, sequence.alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Defined results: a null or empty text is one piece of length 1 (the closing id); a null id is kept as null;
    repeated rows are packed once each; an empty table gives no rows; other columns are ignored.
    """
    out = pack(piece_table(docs, id_col, text_col, vocabulary, capacity), capacity)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
