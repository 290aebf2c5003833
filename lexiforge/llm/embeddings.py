"""Near-duplicate vectors by random-hyperplane sign hashing, exact verification and connected components.

Equal vectors of a label collapse to one class with a count.  Each class gets a signature of sign bits in each of
several tables; classes that share a signature in any table are candidates, and their cosine is computed in double
precision.  A pair counts in the first table in which its signatures agree, so pairs are never listed or made
distinct: a bucket returns counts of links and a spanning forest.  Large buckets are worked off in pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut, join_counted
from .components import connected_components

THRESHOLD = 0.98
#: Chance that all tables miss a pair that lies right at the threshold.
MISS = 1e-5
#: Vectors of a bucket in a block: two blocks meet in a task.  Products are formed for so many rows at a time.
BLOCK, STEP = 4096, 512
#: Bits of a signature beyond those that would give each vector of a label a bucket of its own: chance company travels too.
SPARE_BITS = 4
SEED = 20240229


def plan_tables(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a signature and number of tables for ``n`` vectors of one label."""
    bits = min(62, max(8, math.ceil(math.log2(max(2, n))) + SPARE_BITS))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def signatures(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One integer of ``bits`` sign bits a table for every unit vector."""
    planes = np.random.default_rng([SEED, unit.shape[1], bits]).standard_normal((unit.shape[1], bits * tables))
    signs = (unit @ planes > 0).reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node that each of n nodes reaches by links (i, j)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def pack_signs(signs: np.ndarray, bits: int) -> np.ndarray:
    """Signatures as rows of bytes."""
    return np.packbits((signs[:, :, None] >> np.arange(bits) & 1).astype(np.uint8).reshape(len(signs), -1), axis=1)


def unpack_signs(packed: list[bytes], bits: int, tables: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)[:, : bits * tables]
    return flat.reshape(len(packed), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


class Bucket:
    """Rows of one bucket, or of one pair of its blocks: side 0 rows are compared with each other or with side 1."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, sides: np.ndarray, vectors: np.ndarray, signs: np.ndarray):
        self.ids, self.counts, self.sides, self.unit, self.signs = ids, counts, sides, vectors, signs

    def links(self, table: int, both: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of linked pairs that agree in no earlier table."""
        a, b = np.flatnonzero(self.sides == 0), np.flatnonzero(self.sides == 1) if both else np.flatnonzero(self.sides == 0)
        out_i, out_j = [], []
        for x in range(0, len(a), STEP):
            for y in range(0 if both else x, len(b), STEP):
                i, j = np.nonzero(self.unit[a[x : x + STEP]] @ self.unit[b[y : y + STEP]].T >= threshold)
                i, j = a[i + x], b[j + y]
                if not both:
                    i, j = i[i < j], j[i < j]
                fresh = np.ones(len(i), bool)
                for t in range(table):
                    fresh &= self.signs[i, t] != self.signs[j, t]
                out_i.append(i[fresh])
                out_j.append(j[fresh])
        return np.concatenate(out_i or [np.zeros(0, int)]), np.concatenate(out_j or [np.zeros(0, int)])


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows link if their labels are equal and their cosine reaches ``threshold``.  Defined results: rows whose label,
    id or vector is null, or whose vector is empty, zero or holds a null or non-finite component, link with
    nothing and keep themselves; vectors of different lengths do not link; rows that repeat an id count as rows
    of their own in n_links; an empty table gives no rows; other columns are ignored.
    """
    element = vectors.schema[vector_col].dataType
    kind = "float" if isinstance(element, ArrayType) and isinstance(element.elementType, FloatType) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    rows = rows.withColumn("sound", sound)
    rows = cut(rows.select("vec_id", "sound", F.when(F.col("sound"), F.unhex(F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.col("v").cast("array<string>"), ",")), 256))).alias("key"), "label", "v"), "vectors")
    good = rows.filter("sound")
    classes = good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = cut(classes.select("rep", "times", "key", F.col("label").cast("string").alias("label"), F.size("v").alias("size"), "v"), "vector-classes")
    largest = classes.groupBy("label", "size").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    bits, tables = plan_tables(largest, threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for d in np.unique(sizes):
                for own in np.array_split(np.flatnonzero(sizes == d), -(-int((sizes == d).sum()) // STEP)):
                    part = batch.take(pa.array(own))
                    signs = signatures(unit_rows(part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(own), d)), bits, tables)
                    packed = pa.array([r.tobytes() for r in pack_signs(signs, bits)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), packed, pa.array(signs.tolist(), pa.list_(pa.int64()))], ["rep", "label", "size", "packed", "signs"])

    signed = cut(classes.select("rep", "label", "size", "v").mapInArrow(sign, "rep long, label string, size int, packed binary, signs array<long>"), "vector-signs")
    spots = signed.select("rep", "label", "size", F.posexplode("signs").alias("table", "sign"))
    bucket = ["label", "size", "table", "sign"]
    crowded = spots.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1")
    crowded = cut(crowded.withColumn("bucket", F.monotonically_increasing_id()), "vector-buckets")  # a number for each, once and for all
    members = spots.join(crowded, bucket).select("rep", "bucket", "table", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Every block meets itself and, in a pair task, each other block once.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("x"), F.greatest("block", other).alias("y"), (F.col("block") > other).cast("int").alias("side")))
    dealt = members.select("rep", "bucket", "table", F.explode(meets).alias("m")).select("rep", "bucket", "table", "m.x", "m.y", "m.side")
    # vectors travel as they came, signatures as bits
    held = classes.select("rep", "times", F.col("v").cast(f"array<{kind}>").alias("v")).join(signed.select("rep", "packed"), "rep")
    dealt = dealt.join(held, "rep").select("bucket", "x", "y", "table", "side", "rep", "times", "v", "packed").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: pa.Table) -> pa.RecordBatch:
            x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
            table, side, ids, times = (rows[c].to_numpy() for c in ("table", "side", "rep", "times"))
            signs = unpack_signs(rows["packed"].to_pylist(), bits, tables)
            vectors = rows["v"].combine_chunks()
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            edges = starts(rows)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(edges, [*edges[1:], len(ids)], strict=True):
                order = a + np.argsort(ids[a:b], kind="stable")  # ids in order make roots the smallest ids
                unit = unit_rows(flat[at[a] : at[b]].reshape(b - a, -1))[order - a]
                own = Bucket(ids[order], times[order], side[order], unit, signs[order])
                i, j = own.links(int(table[a]), bool(x[a] != y[a]), threshold)
                if not len(i):
                    continue
                n = np.bincount(i, own.counts[j], len(order)) + np.bincount(j, own.counts[i], len(order))
                touched = np.flatnonzero(n)
                out.append((own.ids[touched], n[touched].astype(np.int64), own.ids[roots(len(order), i, j)[touched]]))
            columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "n", "root"])

        def starts(rows: pa.Table | pa.RecordBatch) -> list[int]:
            keys = np.stack([rows.column(k).to_numpy() for k in range(3)])
            return [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]

        held: list[pa.RecordBatch] = []  # of a task that goes on; its rows are bounded by two blocks
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held)
            last = starts(whole)[-1]
            if last:
                yield work(whole.slice(0, last))
                held = whole.slice(last).to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    found = cut(dealt.mapInArrow(compare, "rep long, n long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select("rep", "root").distinct(), "rep", "root")
    copies = classes.filter("times > 1").select("key", F.col("rep").alias("first"), "times")
    out = join_counted(rows.select("vec_id", "sound", "key"), copies, ["key"], "times").withColumn("rep", F.when(F.col("sound"), F.coalesce("first", "vec_id")))
    out = out.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("times", F.lit(1)) - 1).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
