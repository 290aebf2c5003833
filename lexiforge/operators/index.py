"""The lexical index as tables: built once, read by every search.

``forward`` holds a row a document with its length and its terms' counts, made without a shuffle.  ``terms`` holds
document frequencies and weights.  ``postings`` holds the finished gain of each (term, document), laid out in folders by
a hash of the term, so that a search opens the folders of its own terms alone; the postings of a very common term
are spread over several files.  ``stats`` is one row with parameters and totals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import IntegrityError

K1, B, FLOOR = 1.5, 0.75, 0.25
FORMAT = 2
#: Postings of a folder and of a file, about.
FOLDER_ROWS, FILE_ROWS = 4_000_000, 1_000_000
#: The question that a readback asks.
WITNESS = "retrieval augmented generation"


@dataclass(frozen=True)
class LexicalIndex:
    """Tables of an index, with the number of its folders and whether stop words are left out."""

    forward: DataFrame
    terms: DataFrame
    postings: DataFrame
    stats: DataFrame
    buckets: int
    stopwords: bool


def term_counts(tokens: Column) -> Column:
    """``term, tf`` structs of a document's tokens: ends of runs in their sorted order."""

    def of(ordered: Column) -> Column:
        last = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(0), last - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return T.let(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.get(ordered, at).alias("term"), (F.coalesce(F.get(s, k + 1), last) - at).cast("long").alias("tf"))))

    return F.when(F.size(tokens) > 0, T.let(F.array_sort(tokens), of)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B, stopwords: bool = True) -> LexicalIndex:
    """Write the index of ``docs`` to ``folder`` and open it; raises if a parameter or the readback is bad.

    Documents without a token have length 0 and count in the mean.  Negative inverse frequencies become a quarter of the
    mean over all terms.
    """
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 > 0 and 0 <= b <= 1 are required")
    spark = docs.sparkSession
    tokens = docs.select(F.col(id_col).alias("id"), T.index_tokens(F.coalesce(F.col(text_col), F.lit("")), stopwords).alias("tokens"))
    tokens.select("id", F.size("tokens").cast("long").alias("dl"), term_counts(F.col("tokens")).alias("terms")).write.mode("overwrite").parquet(f"{folder}/forward")
    forward = spark.read.parquet(f"{folder}/forward")
    n, mean, total, empty, rows = forward.agg(F.count("*"), F.avg("dl"), F.sum("dl"), F.count_if(F.col("dl") == 0), F.sum(F.size("terms").cast("long"))).first()
    buckets = max(1, min(4096, -(-(rows or 0) // FOLDER_ROWS)))
    df = forward.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw.write.mode("overwrite").parquet(f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    kinds, average = raw.agg(F.count("*"), F.avg("raw")).first()
    idf = F.when(F.col("raw") < 0, FLOOR * (average or 0.0)).otherwise(F.col("raw"))
    raw.select("term", "df", idf.alias("idf")).write.mode("overwrite").parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    flat = forward.select("id", "dl", F.inline("terms")).join(terms, "term")
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (mean or 1.0)))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / FILE_ROWS)).cast("int")
    laid = flat.select("term", "id", "tf", gain.alias("gain"), bucket_of(F.col("term"), buckets).alias("bucket"), part.alias("part"))
    files = max(buckets, min(8192, -(-(rows or 0) // FILE_ROWS)), 1)
    laid.repartition(files, "term", "part").sortWithinPartitions("bucket", "term").drop("part").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    one = spark.range(1).select(
        F.lit(FORMAT).alias("format"), F.lit(n).alias("documents"), F.lit(mean).cast("double").alias("avgdl"), F.lit(total).cast("long").alias("tokens"), F.lit(empty).alias("empty_documents"),
        F.lit(kinds).alias("vocabulary"), F.lit(rows).cast("long").alias("postings"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"), F.lit(stopwords).alias("stopwords"), F.lit(buckets).alias("buckets"),
    )
    one.write.mode("overwrite").parquet(f"{folder}/stats")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> LexicalIndex:
    """The tables of an index; raises if it is of another format."""
    stats = spark.read.parquet(f"{folder}/stats")
    row = stats.first()
    if row is None or row["format"] != FORMAT:
        raise IntegrityError(f"{folder} holds no index of format {FORMAT}")
    posting = spark.read.schema("term string, id long, tf long, gain double, bucket int") if row.postings == 0 else spark.read
    return LexicalIndex(spark.read.parquet(f"{folder}/forward"), spark.read.parquet(f"{folder}/terms"), posting.parquet(f"{folder}/postings"), stats, row.buckets, row.stopwords)


def verify_index(index: LexicalIndex, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``check, passed`` of a readback: totals, ids, finite gains, and a witness question whose hits are known ids."""
    found = index.postings.agg(F.count("*").alias("n"), F.count_if(F.isnan("gain") | F.col("gain").isNull() | (F.abs("gain") == float("inf"))).alias("odd"))
    ids = docs.select(F.col(id_col).alias("id"))
    stray = index.forward.join(ids, "id", "left_anti").agg(F.count("*").alias("stray")).crossJoin(ids.join(index.forward, "id", "left_anti").agg(F.count("*").alias("lost")))
    asked = docs.sparkSession.createDataFrame([(0, WITNESS)], "item_id long, text string")
    hits = score(index, asked).join(ids, F.col("doc_id") == F.col("id"), "left_anti").agg(F.count("*").alias("unknown"))
    row = index.stats.crossJoin(found).crossJoin(stray).crossJoin(hits)
    checks = [("postings_counted", "n = postings"), ("gains_finite", "odd = 0"), ("ids_match", "stray = 0 and lost = 0"), ("witness_hits_known", "unknown = 0"), ("tokenizer_stored", "stopwords is not null")]
    return row.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.expr(rule).alias("passed")) for name, rule in checks])))


def lexical_statistics(index: LexicalIndex) -> DataFrame:
    """One row: documents, tokens, vocabulary, and the mean, least, largest and empty lengths."""
    return index.forward.agg(F.count("*").alias("documents"), F.sum("dl").cast("long").alias("total_tokens"), F.round(F.avg("dl"), 1).alias("mean_tokens"), F.min("dl").alias("min_tokens"), F.max("dl").alias("max_tokens"), F.count_if(F.col("dl") == 0).alias("empty_documents")).crossJoin(
        index.terms.agg(F.count("*").alias("vocabulary"))
    )


def query_terms(queries: DataFrame, id_col: str, text_col: str, stopwords: bool = True) -> DataFrame:
    """``query_id, term, qtf``: a repeated word counts as often as it stands."""
    tokens = T.index_tokens(F.coalesce(F.col(text_col), F.lit("")), stopwords)
    return queries.select(F.col(id_col).alias("query_id"), F.inline(term_counts(tokens))).withColumnRenamed("tf", "qtf")


def score(index: LexicalIndex, queries: DataFrame, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``query_id, doc_id, score`` of documents that share a term with the query.

    The questions' terms choose the folders and the postings; nothing else of the index is read.
    """
    asked = query_terms(queries, query_id, query_text, index.stopwords).withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    hits = index.postings.join(asked, ["bucket", "term"])
    return hits.groupBy("query_id", F.col("id").alias("doc_id")).agg(F.sum(F.col("qtf") * F.col("gain")).alias("score"))
