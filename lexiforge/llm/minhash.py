"""Near-duplicate texts by order min-hash and banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence number, so that every symbol stands
once.  A sketch takes the four symbols of smallest hash and keeps them in text order; texts agree in a sketch if they
share these symbols and their order.  Texts that agree in any of several sketches are candidates; they link if the
longest common subsequence of their symbols, aligned inside the band that the threshold leaves, is at least 0.8 of
the symbols of both together.

Buckets of few texts are compared pair by pair.  In a crowded bucket all texts are compared with its smallest id first.
Then rounds go on, block by block, until all of a bucket is compared: texts outside the bucket's largest class so far
meet everything in it that is not yet of their class, and leave it.  Links decide classes only, so a pair whose ends are
linked already is not compared; every other pair is.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, join_counted, release_shuffles, small_batches
from .components import connected_components
from .textvec import chunks, mix, words

SHINGLE = 5
THRESHOLD = 0.8
#: Sketches of a text, and symbols of each sketch.
FIRST = (24, 4)
#: Texts of a bucket that are compared with each other at once; a larger bucket is compared in rounds.
PAIRWISE = 8
#: Bytes of text in a block of a crowded bucket, and how many times as much leads in each round as in the one before.
BLOCK, GROWTH = 1_000_000, 8
#: Symbols that pass the first sieve for each text and sketch.
SIEVE = 20
CHUNK = 500_000
LEVEL = 5

_STEP = np.uint64(0xA0761D6478BD642F)
_TWO = np.uint64(0xE7037ED1A0B428DB)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labelled shingles of texts, where each text's begin, two hashes of each text's words, and the word counts.

    A text of one to four words has one symbol, its words together.
    """
    hashes, of, *_ = words(texts)
    sizes = np.diff(of)
    n = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    edges = np.append(0, np.cumsum(n))
    text = np.repeat(np.arange(len(texts)), n)
    at = np.arange(edges[-1]) - np.repeat(edges[:-1], n) + np.repeat(of[:-1], n)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    end = np.repeat(of[1:], n)
    h = padded[at]
    for k in range(1, SHINGLE):
        h = mix(h * _STEP) + np.where(at + k < end, padded[at + k], 0)
    # occurrence numbers
    key = h ^ mix(text.astype(np.uint64) + _TWO)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    number = np.empty(len(key), np.int64)
    number[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    labelled = mix(h + number.astype(np.uint64) * _TWO)
    # the words of a text as two numbers
    place = (np.arange(len(hashes)) - np.repeat(of[:-1], sizes)).astype(np.uint64)
    keys = []
    for salt in (_STEP, _TWO):
        total = np.append(np.uint64(0), np.cumsum(mix(hashes + mix(place * salt + salt)), dtype=np.uint64))
        keys.append(mix(total[of[1:]] - total[of[:-1]] + sizes.astype(np.uint64)))
    return labelled, edges, np.stack(keys, axis=1), sizes


def sketches(labelled: np.ndarray, edges: np.ndarray, count: int, length: int, seed: int) -> np.ndarray:
    """``count`` order min-hashes of ``length`` symbols for every text; a text of fewer symbols gives all it has."""
    n = np.diff(edges)
    out = np.zeros((len(n), count), np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    odd = np.random.default_rng([20240517, seed]).integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    share = np.minimum(1.0, (SIEVE + 2 * length) / np.maximum(n, 1))
    limit = np.where(share >= 1, np.uint64(0xFFFFFFFFFFFFFFFF), (share * 2.0**63).astype(np.uint64) * np.uint64(2))
    limit_of = np.repeat(limit, n)
    need = np.minimum(n, length)
    for s in range(count):
        g = labelled * odd[s]
        near = np.flatnonzero(g <= limit_of)
        short = np.flatnonzero(np.bincount(text[near], minlength=len(n)) < need)
        if len(short):  # a text whose sieve let too few through gives all its symbols
            near = np.union1d(near, np.concatenate([np.arange(edges[t], edges[t + 1]) for t in short]))
        of = text[near]
        order = np.lexsort((g[near], of))
        begin = np.searchsorted(of, np.arange(len(n)))
        rank = np.arange(len(near)) - begin[of[order]] if len(near) else np.zeros(0, np.int64)
        kept = np.sort(near[order[rank < length]])  # text order
        of = text[kept]
        rank = np.arange(len(kept)) - np.searchsorted(of, np.arange(len(n)))[of] if len(kept) else rank[:0]
        value = np.full(len(n), np.uint64(s + 1))
        for r in range(length):
            at = kept[rank == r]
            value[text[at]] = mix(value[text[at]] * _STEP + labelled[at])
        out[:, s] = value
    return out


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Common subsequence of two symbol sequences over the symbols of both together; 0 once it cannot reach ``threshold``."""
    n = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    least = threshold * n / (1 + threshold) - 1e-9
    band = n - 2 * least
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= band + 1e-9
    i, j = i[inside], j[inside]
    if len(i) < least:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        common = len(j)
    else:
        tails: list[int] = []  # symbols stand once, so the longest increasing run of places is the alignment
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        common = len(tails)
    return common / (n - common)


def sketch_table(texts: DataFrame, count: int, length: int, seed: int) -> DataFrame:
    """``doc_id, key_1, key_2, sketches`` of rows ``doc_id, text`` that hold a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [t or "" for t in batch.column(1).to_pylist()]
            for part in chunks([len(t) for t in own], CHUNK):
                labelled, edges, keys, sizes = symbols(own[part])
                values = sketches(labelled, edges, count, length, seed).view(np.int64)
                some = np.flatnonzero(sizes > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, count * len(some) + 1, count, dtype=np.int32)), pa.array(values[some].ravel()))
                keys = keys.view(np.int64)[some]
                ids = batch.column(0).slice(part.start, part.stop - part.start).take(pa.array(some))
                give_back()
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], ["doc_id", "key_1", "key_2", "sketches"])

    return texts.mapInArrow(run, "doc_id long, key_1 long, key_2 long, sketches array<long>")


def candidates(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a < b`` to compare and members of crowded buckets (``bucket, leader, doc_id``) from ``doc_id, sketches``."""
    spots = cut(sketched.select("doc_id", F.posexplode("sketches").alias("slot", "value")).select("doc_id", F.xxhash64("slot", "value").alias("bucket")), "minhash-spots")
    sizes = cut(spots.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).filter("n > 1"), "minhash-sizes")
    members = join_counted(spots, sizes, ["bucket"], "n").filter("n is not null")
    few = members.filter(F.col("n") <= PAIRWISE).groupBy("bucket").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    each = few.select("ids", F.posexplode("ids").alias("k", "a"))
    close = each.select("a", F.explode(F.slice("ids", F.col("k") + 2, F.size("ids"))).alias("b"))
    crowded = cut(members.filter(F.col("n") > PAIRWISE).select("bucket", "leader", "doc_id").filter("leader != doc_id").distinct(), "minhash-crowded")
    return close.union(crowded.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))).distinct(), crowded


def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=LEVEL)
    for batch in batches:
        data = [(t or "").encode() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, data)), pa.int64()), pa.array([codec.compress(d, asbytes=True) for d in data], pa.binary())], ["doc_id", "size", "small"])


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, alike: bool = False) -> DataFrame:
    """``a, b`` of those pairs whose texts align.

    ``alike``: the ids grow with the corpus, so they meet the texts by a sorted join at every size.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            size_a, size_b = c["size_a"].to_numpy(), c["size_b"].to_numpy()
            for part in chunks((size_a + size_b).tolist(), CHUNK):
                own = [pa.decompress(s.as_buffer(), int(n), codec="zstd", asbytes=True).decode() for x, m in ((c["small_a"], size_a), (c["small_b"], size_b)) for s, n in zip(x[part.start : part.stop], m[part], strict=True)]
                labelled, edges, *_ = symbols(own)
                k = len(own) // 2
                good = [i for i in range(k) if alignment(labelled[edges[i] : edges[i + 1]], labelled[edges[k + i] : edges[k + i + 1]], threshold) >= threshold]
                took = pa.array([part.start + i for i in good], pa.int64())
                yield pa.RecordBatch.from_arrays([c["a"].take(took), c["b"].take(took)], ["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if alike:
        wanted = wanted.hint("merge")
    small = texts.mapInArrow(shrink, "doc_id long, size long, small binary").join(wanted, "doc_id", "left_semi")
    small = cut(small, "minhash-texts")
    side = lambda x: small.select(F.col("doc_id").alias(x), F.col("size").alias(f"size_{x}"), F.col("small").alias(f"small_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "small_a", "size_b", "small_b")
    return joined.mapInArrow(align, "a long, b long").distinct()


def block_links(ids: np.ndarray, component: np.ndarray, role: np.ndarray, texts: list[str], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links that join components, from all pairs of a leader and a member of different components.

    ``role``: 0 for a leader, 1 for a member, 2 for a member that is a leader too; leaders meet each other once.
    """
    labelled, edges, *_ = symbols(texts)
    n = np.diff(edges)
    _, number = np.unique(labelled, return_inverse=True)
    _, root = np.unique(component, return_inverse=True)
    marked = np.zeros(len(labelled) + 1, bool)
    members = np.flatnonzero((role > 0) & (n > 0))
    out = []
    if not len(members):
        return out
    own = np.concatenate([number[edges[m] : edges[m + 1]] for m in members])
    begin = np.cumsum(n[members]) - n[members]
    for i in np.flatnonzero((role == 0) & (n > 0)).tolist():
        least = threshold * (n[i] + n[members]) / (1 + threshold) - 1e-9
        fits = (root[members] != root[i]) & (np.minimum(n[i], n[members]) >= least) & ((role[members] == 1) | (ids[members] > ids[i]))
        near = np.flatnonzero(fits)
        if not len(near):
            continue
        mine = number[edges[i] : edges[i + 1]]
        marked[mine] = True
        if 4 * len(near) > len(members):
            common = np.add.reduceat(marked[own], begin, dtype=np.int64)[near]
        else:
            common = np.array([np.count_nonzero(marked[own[begin[k] : begin[k] + n[members[k]]]]) for k in near.tolist()])
        marked[mine] = False
        for j in members[near[common >= least[near]]].tolist():
            if root[i] != root[j] and alignment(labelled[edges[i] : edges[i + 1]], labelled[edges[j] : edges[j + 1]], threshold) >= threshold:
                out.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return out


def crowded_links(crowded: DataFrame, links: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``links`` and the links inside crowded buckets that join further components; the components of all of them.

    A bucket is finished when what has not been a leader in it is of one component.  Who leads is drawn by hash from
    outside the largest component; a round's leaders meet all of the bucket, by blocks of bounded bytes.
    """
    spark = texts.sparkSession

    def compare(group: pa.Table) -> pa.Table:
        ids, component, role, size = (group.column(c).to_numpy() for c in ("doc_id", "component", "role", "size"))
        own = [pa.decompress(s.as_buffer(), int(k), codec="zstd", asbytes=True).decode() for s, k in zip(group.column("small"), size, strict=True)]
        found = np.array(block_links(ids, component, role, own, threshold), np.int64).reshape(-1, 2)
        give_back()
        return pa.table({"a": found.min(axis=1), "b": found.max(axis=1)}) if len(found) else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    # of buckets with the same members one is enough
    sets = crowded.groupBy("bucket", "leader").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("all"))
    now = crowded.join(sets.groupBy("leader", "n", "all").agg(F.min("bucket").alias("bucket")), ["bucket", "leader"], "left_semi").select("bucket", "doc_id")
    small, turn = None, 0
    while True:
        parts = cut(connected_components(links, "a", "b"), "minhash-parts")
        named = now.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"), *(["size"] if small else []))
        kinds = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        mixed = kinds.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1").select("bucket", F.col("most.component").alias("largest"))
        now = cut(named.join(mixed, "bucket").withColumn("open", F.col("component") != F.col("largest")).drop("largest"), "minhash-open")
        if now.isEmpty():
            return links, parts
        if small is None:
            small = cut(texts.join(now.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(shrink, "doc_id long, size long, small binary"), "minhash-blocks")
            now = cut(now.join(small.groupBy("doc_id").agg(F.sum("size").alias("size")), "doc_id"), "minhash-open")
        share = now.groupBy("bucket").agg(F.sum(F.when(F.col("open"), F.col("size"))).alias("whole"))
        drawn = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(1_000_000)) * (F.col("whole") / F.lit(float(BLOCK * GROWTH**turn))) < 1_000_000
        now = cut(now.join(share, "bucket").select("bucket", "doc_id", "component", "size", (F.col("open") & drawn).alias("leads")), "minhash-round")
        blocks = now.groupBy("bucket").agg(*[F.ceil(F.coalesce(F.sum(s), F.lit(0)) / BLOCK).cast("int").alias(k) for k, s in (("rows", F.when(F.col("leads"), F.col("size"))), ("columns", F.col("size")))]).filter("rows > 0")
        dealt = now.join(blocks, "bucket")
        at = lambda salt, k: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(k)).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        leaders = dealt.filter("leads").select("bucket", at("row", "rows").alias("row"), every("columns").alias("column"), "doc_id", "component", F.lit(0).alias("role"))
        members = dealt.select("bucket", every("rows").alias("row"), at("column", "columns").alias("column"), "doc_id", "component", F.when(F.col("leads"), 2).otherwise(1).alias("role"))
        found = leaders.union(members).join(small, "doc_id").groupBy("bucket", "row", "column").applyInArrow(compare, "a long, b long").distinct()
        links = links.union(cut(found, f"minhash-links-{turn + 2}"))
        release_shuffles(spark)
        now, turn = now.filter("not leads").select("bucket", "doc_id", "size"), turn + 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` of every row; the class is the smallest id that links reach.

    Defined results: texts of the same words in the same order, whatever their case, space and punctuation, are one
    class; texts without a word (null, empty, punctuation) link with nothing; null ids are kept with a null class;
    rows that repeat an id are one document; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = texts.filter("doc_id is not null")
    table = cut(sketch_table(known, *FIRST, 1), "minhash-sketches")
    firsts = table.groupBy("key_1", "key_2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    copied = cut(firsts.filter("n > 1"), "minhash-copies")
    named = join_counted(table, copied, ["key_1", "key_2"], "n").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "sketches")
    pairs, crowded = candidates(named.filter("doc_id = rep").select("doc_id", "sketches"))
    pairs = cut(pairs, "minhash-pairs")
    links = cut(verified(pairs, known, threshold, alike=True), "minhash-links")
    release_shuffles(spark)
    _, parts = crowded_links(crowded, links, known, threshold)
    parts = parts.withColumnRenamed("node", "rep")
    classes = named.select("doc_id", "rep").distinct().join(parts, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("class_id"))
    classes = cut(classes, "minhash-classes")
    sizes = cut(classes.groupBy("class_id").agg(F.count("*").alias("class_size")).filter("class_size > 1"), "minhash-sizes")
    out = texts.select("doc_id").join(join_counted(classes, sizes, ["class_id"], "class_size"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce(F.col("doc_id") == F.coalesce("class_id", "doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest id of their class; of rows that repeat an id one stays."""
    classes = near_duplicates(docs, id_col, text_col, threshold).filter("not kept").select(F.col("doc_id").alias(id_col))
    gone = cut(classes.distinct(), "minhash-gone")
    repeated = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").select(id_col)
    out = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    if repeated.limit(1).count():
        known = out.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        out = known.union(out.filter(F.col(id_col).isNull()))
    return out
