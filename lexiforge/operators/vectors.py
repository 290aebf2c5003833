"""Dense vectors: a store with keyed upserts, and exact search for whole sets of queries.

The store is a folder of Parquet files, in folders by a hash of the id, and a row that states dimension and distance.
An upsert rewrites the folders that it touches and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from ..sources.tables import IntegrityError

DISTANCE = "cosine"
FOLDERS = 64
#: Query vectors that are searched for at a time: what is broadcast is bounded by this and their dimension.
BLOCK = 2048
#: Vectors that are multiplied at a time.
ROWS = 2000
#: Scores that are equal to nine decimals are ties, so what lies this near to the k-th stays in the race.
TIE = 2e-9

# What a point carries, at least and beside that.
PAYLOAD = ("chunk_id", "document_id", "theme", "page_start", "page_end")
FULL_PAYLOAD = (*PAYLOAD, "tokens_est", "text")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def ensure_collection(spark: SparkSession, folder: str, dimension: int, recreate: bool = False) -> str:
    """``created``, ``recreated`` or ``reused``; raises if what is there has another dimension or distance."""
    found = exists(spark, f"{folder}/config")
    if found and not recreate:
        row = spark.read.parquet(f"{folder}/config").first()
        if (row.dimension, row.distance) != (dimension, DISTANCE):
            raise IntegrityError(f"{folder} holds vectors of dimension {row.dimension} by {row.distance}, not {dimension} by {DISTANCE}")
        return "reused"
    if found:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    spark.range(1).select(F.lit(dimension).alias("dimension"), F.lit(DISTANCE).alias("distance")).write.parquet(f"{folder}/config")
    return "recreated" if found else "created"


def points(chunks: DataFrame, vectors: DataFrame, minimal: bool = True, id_col: str = "chunk_id") -> DataFrame:
    """Chunks with their vectors: ``id, vector`` and the payload's columns."""
    return chunks.select(*(PAYLOAD if minimal else FULL_PAYLOAD)).join(vectors.select(F.col(id_col).alias("chunk_id"), F.col("embedding").alias("vector")), "chunk_id").withColumn("id", F.col("chunk_id"))


def upsert(rows: DataFrame, folder: str, id_col: str = "id", vector_col: str = "vector") -> int:
    """Insert or replace points by id, and return how many the store then has.

    Raises, before anything is written, if a vector is missing or has another dimension, or an id stands twice.
    """
    spark = rows.sparkSession
    dimension = spark.read.parquet(f"{folder}/config").first().dimension
    new = stored(rows.withColumn("folder", F.pmod(F.xxhash64(F.col(id_col)), F.lit(FOLDERS)).cast("int")), "points")
    bad = new.agg(F.count_if(F.coalesce(F.size(vector_col), F.lit(-1)) != dimension)).first()[0]
    repeated = new.groupBy(id_col).count().filter("count > 1").limit(1).count()
    if bad or repeated:
        raise IntegrityError(f"{bad} vectors are not of dimension {dimension}; ids repeat: {bool(repeated)}")
    out = new
    if exists(spark, f"{folder}/points"):
        old = spark.read.parquet(f"{folder}/points")
        touched = [r.folder for r in new.select("folder").distinct().collect()]  # FOLDERS at most
        out = stored(old.filter(F.col("folder").isin(touched)).join(new, id_col, "left_anti").select(*new.columns).union(new), "points-merged")
    out.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(f"{folder}/points")
    return spark.read.parquet(f"{folder}/points").count()


def verify_store(spark: SparkSession, folder: str, expected: DataFrame, id_col: str = "id", payload: tuple[str, ...] = PAYLOAD) -> DataFrame:
    """``expected, indexed, count_match, all_found, payload_ok, status`` of a readback against the ids in ``expected``."""
    held = spark.read.parquet(f"{folder}/points")
    lost = expected.select(F.col(id_col).alias("id")).join(held.select(F.col(id_col).alias("id")), "id", "left_anti").agg(F.count("*").alias("lost"))
    counts = expected.agg(F.count("*").alias("expected")).crossJoin(held.agg(F.count("*").alias("indexed"))).crossJoin(lost)
    whole = F.lit(set(payload) <= set(held.columns))
    good = (F.col("expected") == F.col("indexed")) & (F.col("lost") == 0) & whole
    return counts.select("expected", "indexed", (F.col("expected") == F.col("indexed")).alias("count_match"), (F.col("lost") == 0).alias("all_found"), whole.alias("payload_ok"), F.when(good, "PASS").otherwise("FAIL").alias("status"))


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, doc_id, score``: for each query the k best dot products of every batch of vectors, and ties of the last.

    The final k are among them: each batch keeps its own best, so few rows travel.  Queries go in blocks of bounded size.
    """
    spark = vectors.sparkSession
    parts = max(1, -(-queries.count() // BLOCK))
    out = None
    for part in range(parts):
        own = queries.filter(F.pmod(F.xxhash64(id_col), F.lit(parts)) == part) if parts > 1 else queries
        asked = own.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).toArrow()
        if not asked.num_rows:
            continue
        matrix = np.stack(asked["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(asked.num_rows, -1))
        shared = spark.sparkContext.broadcast((asked["id"].to_numpy(), matrix))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, wanted = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    rows = batch.slice(at, ROWS)
                    x = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
                    scores = x @ wanted.T
                    keep = max(0, len(x) - k)
                    least = np.partition(scores, keep, axis=0)[keep] - TIE
                    i, j = np.nonzero(scores >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j]), rows.column(0).take(pa.array(i)), pa.array(scores[i, j])], ["query_id", "doc_id", "score"])

        known = vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) == matrix.shape[1]))
        hits = known.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(best, "query_id long, doc_id long, score double")
        out = hits if out is None else out.union(hits)
    return out if out is not None else spark.createDataFrame([], "query_id long, doc_id long, score double")
