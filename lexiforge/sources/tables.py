"""Scans with explicit schemas and guards, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Columns of the files that are read and written.
MANIFEST = "theme string, arxiv_id string, title string, authors array<string>, summary string, pdf_url string, local_path string"
DOCUMENTS = "documents array<struct<id:string,theme:string,title:string,file_path:string,page_count:int,chars:int,pages:array<struct<page:int,text:string>>>>"
CHUNKS = "chunks array<struct<chunk_id:string,document_id:string,theme:string,page_start:int,page_end:int,tokens_est:int,text:string>>"
QUESTIONS = "id string, theme string, question string, relevant_chunks array<string>, source_document string, difficulty string, notes string"
RESULTS = (
    "query_id string, query string, theme string, difficulty string, config string, recall_at_3 double, recall_at_5 double, recall_at_10 double, "
    "mrr double, faithfulness double, citation_accuracy double, avg_latency_ms double, p95_latency_ms double"
)


REFERENCE = "documents array<struct<id:string,page_count:int>>"
QUESTION_ENVELOPE = "questions array<struct<" + ",".join(":".join(c.split(" ")) for c in QUESTIONS.split(", ")) + ">>"


#: What is read of a search service's Atom feed, and where a paper's file stands if the feed does not say.
ATOM = "entry array<struct<id:string,title:string,summary:string,author:array<struct<name:string>>,link:array<struct<_title:string,_href:string>>>>"
PDF_URL = "https://arxiv.org/pdf/"


class IntegrityError(ValueError):
    """A table that must not be used: empty, with missing values or repeated keys."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def enveloped(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """Rows of the one list inside a JSON object."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline(field))


def documents(spark: SparkSession, path: str) -> DataFrame:
    return enveloped(spark, path, DOCUMENTS, "documents")


def chunks(spark: SparkSession, path: str, required: tuple[str, ...] = ("chunk_id", "document_id", "theme", "page_start", "page_end", "tokens_est", "text")) -> DataFrame:
    """Chunks, checked: not empty, no required value missing, no id twice."""
    return checked(enveloped(spark, path, CHUNKS, "chunks"), required, "chunk_id")


def payload(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as they are, with the one guard that there is a list of them."""
    rows = enveloped(spark, path, CHUNKS, "chunks")
    if rows.isEmpty():
        raise IntegrityError(f"{path} holds no list of chunks")
    return rows


def page_counts(spark: SparkSession, path: str) -> DataFrame | None:
    """``document_id, page_count`` of a documents file; None if it is absent or no such file."""
    if not present(spark, path):
        return None
    rows = enveloped(spark, path, REFERENCE, "documents").filter("id is not null").select(F.col("id").alias("document_id"), "page_count")
    return None if rows.isEmpty() else rows


def atom_entries(feeds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """``arxiv_id, title, authors, summary, pdf_url`` of the entries of Atom feeds, with the other columns of each feed.

    The file is the first link titled ``pdf``, or else derived from the id.
    """
    parsed = F.from_xml(F.col(xml_col), ATOM, {"ignoreNamespace": "true"})
    rows = feeds.select(*[c for c in feeds.columns if c != xml_col], F.explode(parsed["entry"]).alias("e"))
    own = F.element_at(F.split(T.strip(F.col("e.id")), "/abs/"), -1)
    pdf = F.get(F.filter("e.link", lambda x: x["_title"] == "pdf"), 0)["_href"]
    return rows.select(
        *[c for c in rows.columns if c != "e"], own.alias("arxiv_id"), T.collapse_space(F.col("e.title")).alias("title"), F.transform("e.author", lambda a: a["name"]).alias("authors"),
        F.translate(T.strip(F.col("e.summary")), "\n", " ").alias("summary"), F.coalesce(pdf, F.concat(F.lit(PDF_URL), own)).alias("pdf_url"),
    )


def present(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def located(spark: SparkSession, name: str, folders: list[str]) -> str:
    """The first of ``folders`` that holds ``name``, as a path; raises if none does."""
    for folder in folders:
        if present(spark, f"{folder.rstrip('/')}/{name}"):
            return f"{folder.rstrip('/')}/{name}"
    raise FileNotFoundError(f"{name} stands in none of {', '.join(folders)}")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Annotated questions of a file that is a list, or an object with a list of that name."""
    listed = spark.read.schema(QUESTIONS).json(path, multiLine=True).filter("id is not null")
    return listed if not listed.isEmpty() else enveloped(spark, path, QUESTION_ENVELOPE, "questions")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an evaluation; none if the file is missing."""
    return spark.read.schema(RESULTS).csv(path, header=True) if present(spark, path) else spark.createDataFrame([], RESULTS)


def report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report's one object as a row; none if the file is missing."""
    return spark.read.schema(schema).json(path, multiLine=True) if present(spark, path) else spark.createDataFrame([], schema)


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def checked(rows: DataFrame, required: tuple[str, ...], key: str) -> DataFrame:
    """``rows`` itself; raises if it fails a guard.  One aggregate over the data."""
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in required])
    per_key = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(missing).alias("missing"))
    n, lacking, repeated = per_key.agg(F.sum("n"), F.sum("missing"), F.count_if((F.col("n") > 1) & F.col(key).isNotNull())).first()
    if not n or lacking or repeated:
        raise IntegrityError(f"{n or 0} rows, {lacking or 0} without a required value, {repeated or 0} repeated values of {key}")
    return rows


def resolve_questions(asked: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Question and relevant chunk pairs, and ``id, reason`` of the questions that are left out.

    A question is left out as a whole if it has no text or no chunk, or names a chunk that is not ``known``.  Ids
    need not be unique: a question is told by its id, text and chunks.
    """
    key = F.xxhash64("id", "question", "relevant_chunks")
    rows = asked.withColumn("key", key).withColumn("chunks", F.coalesce("relevant_chunks", F.array().cast("array<string>")))
    blank = (F.trim(F.coalesce("question", F.lit(""))) == "") | (F.size("chunks") == 0)
    empty = rows.filter(blank).select("id", F.lit("empty slot").alias("reason"))
    pairs = rows.filter(~blank).select("key", "id", "question", "theme", "difficulty", F.size("chunks").alias("n"), F.explode("chunks").alias("chunk_id"))
    lost = pairs.join(known.select("chunk_id").distinct(), "chunk_id", "left_anti").groupBy("key").agg(F.first("id").alias("id"), F.count("*").alias("k"), F.first("n").alias("n"))
    reason = F.format_string("%d of %d chunks unknown", "k", "n")
    return pairs.join(lost, "key", "left_anti").drop("key", "n").distinct(), empty.union(lost.select("id", reason))


def write_csv(rows: DataFrame, path: str) -> None:
    """One file with a header, in the rows' order; null is written as nothing."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_manifest(entries: DataFrame, path: str) -> None:
    """What is kept of a manifest, valid or flagged and not quarantined, by theme and id."""
    kept = entries.filter(F.col("status").isin("valid", "flagged") & ~F.col("quarantined"))
    kept.orderBy("theme", "id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_with_metadata(rows: DataFrame, path: str, generator: str, config: dict[str, str], statistics: DataFrame | None = None) -> None:
    """Rows, and beside them one row that says what made them, when and how, and their statistics."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    run_metadata(rows.sparkSession, generator, config).write.mode("overwrite").parquet(f"{path}/metadata")
    if statistics is not None:
        statistics.write.mode("overwrite").parquet(f"{path}/statistics")


def write_index(tables: dict[str, DataFrame], folder: str) -> None:
    """Parquet tables of an index, read back and counted; raises if a count differs."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        back = rows.sparkSession.read.parquet(f"{folder}/{name}")
        if back.schema != rows.schema and [f.dataType for f in back.schema] != [f.dataType for f in rows.schema]:
            raise IntegrityError(f"{name} changed its schema")
        stated, found = rows.count(), back.count()
        if found != stated:
            raise IntegrityError(f"{name} has {found} rows instead of {stated}")


def run_metadata(spark: SparkSession, generator: str, config: dict[str, str]) -> DataFrame:
    """One row: what made an artefact, when, and with which settings."""
    one = spark.range(1).select(F.lit(generator).alias("generator"), F.current_timestamp().alias("made_at"))
    pairs = [x for k, v in sorted(config.items()) for x in (F.lit(k), F.lit(str(v)))]
    return one.withColumn("config", F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>"))
