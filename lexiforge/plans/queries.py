"""Registered queries over the test tables.

The tables stand in for a paper corpus: a document's lines are its pages, its language is its theme, items of
``benchmark`` are questions, and question *i* goes with vector *i*.  The lexical index of a folder is built by the
first query of a session that needs it and stays in the session's shared folder, as an index does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import python_text as P
from ..functions import text as T
from ..operators import answers as A
from ..operators import chunking, corpus, evaluation, models, quality, reports, vectors
from ..operators import index as I
from ..operators import retrieval as R
from ..sources.scratch import scratch_path, stored
from ..sources.tables import atom_entries as read_atom
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# Text functions


@query
def token_estimate(spark, d):
    return docs_of(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query
def normal_form(spark, d):
    return docs_of(spark, d).select("doc_id", F.md5(T.normal_form(F.col("text"))).alias("form"))


@query
def tokenize_stats(spark, d):
    t = T.index_tokens(F.col("text"))
    return docs_of(spark, d).select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("kinds"))


@query
def top_terms(spark, d):
    words = docs_of(spark, d).select(F.explode(T.index_tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(20)


@query
def sentence_units(spark, d):
    s = T.sentences(F.col("text"), ".;!?")
    return docs_of(spark, d).select("doc_id", F.size(s).cast("long").alias("units"), F.md5(F.array_join(s, "|")).alias("units_md5"))


@query
def shingle_counts(spark, d):
    return docs_of(spark, d).select("doc_id", F.size(T.shingle_set(F.col("text"))).cast("long").alias("shingles"))


@query
def noisy_sentence_filter(spark, d):
    s = docs_of(spark, d).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(T.is_noisy_sentence(F.col("s"))).alias("noisy"))


@query
def text_quality(spark, d):
    return corpus.text_quality(corpus.pages(docs_of(spark, d))).withColumn("empty_pages_idx", F.array_join(F.col("empty_pages_idx").cast("array<string>"), ","))


@query
def theme_keyword_hits(spark, d):
    titles = table(spark, d, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("title"))
    best = corpus.best_theme(F.col("title"))
    return titles.select("page_id", *[F.size(T.keyword_hits(F.col("title"), t)).cast("long").alias(t) for t in sorted(T.THEME_KEYWORDS)], best["theme"].alias("best_theme"), best["score"].cast("long").alias("best_score"))


@query
def string_functions(spark, d):
    t = F.col("text")
    return docs_of(spark, d).select("doc_id", F.md5(T.collapse_space(t)).alias("collapsed"), T.preview(t).alias("preview"), T.file_slug(t, F.col("doc_id").cast("string")).alias("slug"))


@query
def ids_and_keys(spark, d):
    name = F.format_string("%s-c%04d|%s", F.col("doc_id").cast("string"), F.lit(1), F.substring("text", 1, 200))
    return docs_of(spark, d).select("doc_id", T.uuid5(name).alias("chunk_id"), T.citation_id(F.col("text"), F.lit(1), F.lit(0)).alias("citation_id"), T.pair_key(F.col("text"), F.col("lang")).alias("pair_key"), F.sha2("text", 256).alias("sha256"))


@query
def clean_pages(spark, d):
    return docs_of(spark, d).select("doc_id", P.clean_page("text").alias("text"))


@query
def author_names(spark, d):
    """Distinct words of a text, whatever their case, in order of first appearance."""
    return docs_of(spark, d).select("doc_id", F.md5(F.array_join(T.distinct_names(F.split("text", "[ \n]+")), "|")).alias("names"))


def model_answer(text):
    return F.concat(F.lit("Assistant: hello\n"), text, F.lit("\n[/INST] end\nSOURCES:\n[2] second\n noise \n[1]  "), F.substring(text, 1, 30), F.lit("\n[2] again\n"))


@query
def cleaned_answers(spark, d):
    return asked(spark, d).select("item_id", T.clean_answer(model_answer(F.col("text"))).alias("answer"))


@query
def source_lines(spark, d):
    lines = T.source_lines(model_answer(F.translate("text", "\n", " ")))
    return asked(spark, d).select("item_id", F.explode(lines).alias("n", "line"))


@query
def paragraph_counts(spark, d):
    parts = F.filter(F.split("text", r"\n(?U)\s*\n"), lambda p: T.strip(p) != "")
    return docs_of(spark, d).select("doc_id", F.size(parts).cast("long").alias("paragraphs"))


# Corpus rules


def papers(spark, d):
    p = F.col("page_id")
    paper = F.format_string("%04d.%05dv%d", (p % 7 + 2401).cast("int"), (p / 3).cast("int"), (p % 4 + 1).cast("int"))
    return table(spark, d, "pages").select(p.alias("pos"), F.when(p % 11 == 0, "bad").otherwise(paper).alias("id"), "url")


@query
def dedupe_best_version(spark, d):
    return corpus.newest_versions(papers(spark, d)).select("pos", "id", "kept")


@query
def atom_entries(spark, d):
    """Feeds of two entries each; the second names no file."""
    p = F.col("page_id").cast("string")
    entry = lambda n, link: F.concat(F.lit("<entry><id>http://arxiv.org/abs/2401."), p, F.lit(f"v{n}</id><title> A title\n  of &amp; "), p, F.lit("</title><summary>\n Line one\nline two </summary><author><name>Ann</name></author><author><name>Bo</name></author>"), link, F.lit("</entry>"))
    links = F.concat(F.lit('<link href="http://x/abs" rel="alternate"/><link title="pdf" href="http://x/pdf/'), p, F.lit('"/>'))
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>'), entry(1, links), entry(2, F.lit('<link href="http://x/abs" rel="alternate"/>')), F.lit("</feed>"))
    return read_atom(table(spark, d, "pages").select("page_id", xml.alias("xml"))).withColumn("authors", F.array_join("authors", ","))


@query
def first_documents(spark, d):
    return corpus.first_rows(docs_of(spark, d).select("doc_id", "n_chars"), 25, "doc_id")


@query
def contained_ids(spark, d):
    """Whether all judged documents are known, and all documents judged."""
    a, b = docs_of(spark, d), table(spark, d, "labels")
    return quality.contained(b, a, "doc_id").withColumn("of", F.lit("labels")).union(quality.contained(a, b, "doc_id").withColumn("of", F.lit("documents")))


def manifest_rows(spark, d):
    """Entries of a made-up manifest: some without a file, some in the wrong folder or under the wrong name."""
    themes = F.array(*map(F.lit, ["rag", "agents", "fine_tuning", "other"]))
    titles = F.array(*map(F.lit, ["Retrieval of passages", "Agents that plan with tools", "Low-rank adapters", "A note on agent query index"]))
    pos = F.col("pos")
    name = F.concat("id", F.when(pos % 6 == 0, "-").otherwise("_"), pos.cast("string"), F.lit(".pdf"))
    return papers(spark, d).select(
        "pos", "id", F.element_at(themes, (pos % 4 + 1).cast("int")).alias("theme"), F.element_at(titles, (pos % 3 + 1 + (pos % 5 == 0).cast("int")).cast("int")).alias("title"),
        F.concat(F.lit("files\\rag\\"), name).alias("local_path"), F.when(pos % 13 != 0, F.concat(F.lit("/corpus/rag/"), name)).alias("stored"),
    )


def manifest_files(spark, d):
    """The files that stand in the corpus: those of the manifest, each with its issues, and some that no entry names."""
    content = F.encode(F.concat(F.when(F.col("pos") % 10 != 0, "%PDF").otherwise("PDF"), F.repeat(F.lit("x"), (F.col("pos") % 40 * 2500).cast("int")), F.when(F.col("pos") % 9 == 0, "/Encrypt").otherwise(""), F.when(F.col("pos") % 7 != 0, "%%EOF").otherwise("")), "UTF-8")
    rows = manifest_rows(spark, d).filter("stored is not null").select("pos", F.col("stored").alias("path"))
    more = rows.filter("pos % 17 = 0").select("pos", F.concat(F.lit("/corpus/"), F.when(F.col("pos") % 2 == 0, corpus.QUARANTINE).otherwise("agents"), F.lit("/lost-"), F.col("pos").cast("string"), F.lit(".pdf")).alias("path"))
    return corpus.file_issues(rows.union(more).withColumn("content", content).withColumn("length", F.octet_length("content")))


def resolved_entries(spark, d):
    return corpus.resolved(manifest_rows(spark, d).drop("stored"), manifest_files(spark, d))


@query
def manifest_issues(spark, d):
    return corpus.entry_issues(resolved_entries(spark, d)).select("pos", F.concat_ws(",", "issues").alias("issues"), "status")


@query
def file_issues(spark, d):
    return manifest_files(spark, d).select("path", F.col("length").cast("long").alias("length"), F.concat_ws(",", "issues").alias("issues"), "sha256")


@query
def orphan_files(spark, d):
    return corpus.orphans(manifest_files(spark, d), resolved_entries(spark, d))


@query
def text_issues(spark, d):
    return corpus.text_issues(corpus.text_quality(corpus.pages(docs_of(spark, d)))).select("doc_id", F.concat_ws(",", "issues").alias("issues"))


def validated(spark, d):
    """The manifest with the issues of entries, files and texts; entry *i* has the text of document *i*."""
    texts = corpus.text_issues(corpus.text_quality(corpus.pages(docs_of(spark, d))))
    entries = resolved_entries(spark, d)
    named = entries.select("id", F.col("pos").alias("doc_id")).join(texts, "doc_id").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("issues"))
    return corpus.validated(entries, manifest_files(spark, d), named)


@query
def validated_manifest(spark, d):
    return validated(spark, d).select("pos", "id", F.concat_ws(",", F.array_sort("issues")).alias("issues"), "status", "quarantined")


@query
def manifest_status_counts(spark, d):
    return corpus.status_counts(validated(spark, d))


@query
def orphans_anti_join(spark, d):
    return docs_of(spark, d).join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query
def per_theme_counts(spark, d):
    return docs_of(spark, d).groupBy("lang").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))


@query
def acquisition_cap(spark, d):
    found = docs_of(spark, d).select(F.col("lang").alias("theme"), (F.col("doc_id") % 97).alias("id"), (F.col("doc_id") % 5).alias("query_no"), F.col("doc_id").alias("pos"))
    return corpus.acquire(found).select("theme", "id", "query_no", "pos", F.col("place").cast("long").alias("place"))


# Chunks and their gates


@query
def chunk_documents(spark, d):
    return chunking.chunk_documents(docs_of(spark, d))


@query
def page_bounded_chunks(spark, d):
    return chunking.chunk_pages(docs_of(spark, d))


def line_chunks(spark, d):
    """Lines as chunks: their number is their page.  Every fifth document is said to have another theme too."""
    lines = corpus.pages(docs_of(spark, d)).join(docs_of(spark, d).select("doc_id", "lang"), "doc_id")
    doc = F.col("doc_id").cast("string")
    theme = F.when((F.col("doc_id") % 5 == 0) & (F.col("page") == 2), "other").otherwise(F.col("lang"))
    return lines.filter("doc_id % 7 != 0 or page != 2").select(
        F.concat(doc, F.lit("-"), F.when(F.col("doc_id") % 50 == 0, F.lit(1)).otherwise(F.col("page")).cast("string")).alias("chunk_id"), doc.alias("document_id"), theme.alias("theme"),
        F.col("page").cast("int").alias("page_start"), F.col("page").cast("int").alias("page_end"), T.token_estimate(F.col("text")).alias("tokens_est"), "text",
    )


def line_counts(spark, d):
    return docs_of(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), (F.size(F.split("text", "\n")) + (F.col("doc_id") % 11 == 0).cast("int")).alias("page_count")).filter("document_id % 13 != 0")


@query
def chunk_statistics(spark, d):
    return quality.theme_rollup(line_chunks(spark, d), "theme", "document_id", "tokens_est")


@query
def chunk_gate(spark, d):
    return reports.gate_report(quality.chunk_gate(line_chunks(spark, d), line_counts(spark, d), id_pattern=r"^\d+$"))


@query
def duplication_report(spark, d):
    rows = line_chunks(spark, d).filter("document_id % 50 != 0")
    return quality.duplication(rows, "chunk_id", "document_id", "text")


@query
def near_pair_examples(spark, d):
    return quality.first_pairs(quality.near_duplicates(docs_of(spark, d), "doc_id", "source", "text"))


@query
def exact_group_examples(spark, d):
    return quality.first_groups(docs_of(spark, d), "doc_id", "text")


@query
def coverage_totals(spark, d):
    return quality.coverage_totals(intervals(spark, d))


@query
def span_totals(spark, d):
    return quality.span_totals(intervals(spark, d))


@query
def length_examples(spark, d):
    return quality.length_examples(docs_of(spark, d), "n_chars", "doc_id", 500, 3000)


def intervals(spark, d):
    q = F.col("l_partkey") % 40 + 1
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 5000).alias("document_id"), q.alias("page_start"), (q + F.rint("l_quantity").cast("long") % 5).alias("page_end"))


@query
def page_islands(spark, d):
    return quality.islands(intervals(spark, d))


@query
def span_distribution(spark, d):
    return intervals(spark, d).groupBy((F.col("page_end") - F.col("page_start") + 1).alias("span")).agg(F.count("*").alias("n"))


@query
def incoherent_pages(spark, d):
    rows = intervals(spark, d).withColumn("page_end", F.col("page_end") - F.when(F.col("document_id") % 9 == 0, 3).otherwise(0))
    return quality.incoherent_pages(rows).groupBy("document_id").agg(F.count("*").alias("n"))


@query
def exact_duplicates(spark, d):
    return quality.exact_duplicates(docs_of(spark, d), "doc_id", "text")


@query
def near_duplicate_pairs(spark, d):
    return quality.near_duplicates(docs_of(spark, d), "doc_id", "source", "text")


@query
def size_histogram(spark, d):
    return quality.histogram(docs_of(spark, d), "n_chars", 1000)


@query
def rank_percentiles(spark, d):
    return quality.rank_percentiles(docs_of(spark, d), "n_chars", "lang")


@query
def grouped_statistics(spark, d):
    out = quality.grouped_statistics(docs_of(spark, d), "lang", "source", "n_chars")
    return out.select(F.col("level").cast("long").alias("level"), "theme", "document", "n", "total", "low", "high", "mean")


@query
def theme_rollup(spark, d):
    return quality.theme_rollup(docs_of(spark, d), "lang", "source", "n_chars")


@query
def length_flags(spark, d):
    return quality.length_flags(docs_of(spark, d), "n_chars", 500, 3000)


@query
def length_outliers(spark, d):
    return quality.outliers(docs_of(spark, d), "n_chars").select("doc_id", "n_chars", "kind", "preview")


@query
def required_fields(spark, d):
    rows = docs_of(spark, d).join(table(spark, d, "labels"), "doc_id", "left").withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    return quality.null_patterns(rows, ("lang", "quality", "toxic", "text"))


@query
def repeated_keys(spark, d):
    return quality.repeated_keys(table(spark, d, "conversations"), "conv_id")


@query
def worst_status(spark, d):
    status = F.when(F.col("o_totalprice") > 300000, "FAIL").when(F.col("o_totalprice") > 150000, "WARNING").otherwise("PASS")
    return table(spark, d, "orders").groupBy("o_custkey").agg(quality.worst(status).alias("status"))


# Retrieval


def asked(spark, d):
    return table(spark, d, "benchmark")


def shown(hits: DataFrame, score: str = "score") -> DataFrame:
    return hits.select("query_id", "doc_id", F.round(score, 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_FOLDERS: dict[tuple[str, str], str] = {}


def index_of(spark: SparkSession, d: str) -> I.LexicalIndex:
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOLDERS:
        folder = scratch_path(spark, "lexical-index")
        I.build_index(docs_of(spark, d), folder)
        _FOLDERS[key] = folder
    return I.open_index(spark, _FOLDERS[key])


@query
def bm25_index_build(spark, d):
    """Builds an index anew and returns its statistics."""
    return I.lexical_statistics(I.build_index(docs_of(spark, d), scratch_path(spark, "lexical-index")))


@query
def bm25_index_status(spark, d):
    index = index_of(spark, d)
    return reports.index_status(I.verify_index(index, docs_of(spark, d)), I.lexical_statistics(index))


@query
def bm25_topk(spark, d):
    return shown(R.bm25_top(index_of(spark, d), asked(spark, d), 10))


@query
def bm25_padded(spark, d):
    """With zero-score documents up to k, as the hybrid search sees the channel."""
    return shown(R.bm25_top(index_of(spark, d), asked(spark, d), 50, pad_zero=True))


@query
def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    return shown(R.dense_top(v, v.join(asked(spark, d).select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), 10))


@query
def vector_store(spark, d):
    """Vectors go in twice, the second time with some replaced and some new; what the store then holds is read back."""
    folder = scratch_path(spark, "vectors")
    v = table(spark, d, "embeddings")
    dimension = v.select(F.size("embedding")).first()[0]
    first, again = vectors.ensure_collection(spark, folder, dimension), vectors.ensure_collection(spark, folder, dimension)
    rows = v.select(*[F.col("vec_id").cast("string").alias(c) for c in ("id", "chunk_id", "document_id")], F.col("label").cast("string").alias("theme"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.col("embedding").alias("vector"))
    vectors.upsert(rows.filter("id % 3 != 0"), folder)
    vectors.upsert(rows.filter("id % 2 = 0"), folder)
    return vectors.verify_store(spark, folder, rows.filter("id % 3 != 0 or id % 2 = 0")).withColumn("actions", F.lit(f"{first},{again}"))


@query
def hashed_embeddings(spark, d):
    """Questions embedded by the stand-in, with the questions' prefix, searched for among documents embedded without it."""
    model = models.HashingEmbedder(64)
    docs = models.embedded(docs_of(spark, d).select(F.col("doc_id").alias("vec_id"), "text"), "text", model)
    items = models.embedded(asked(spark, d).select(F.col("item_id").alias("vec_id"), "text"), "text", model, models.QUERY_PREFIX)
    return shown(R.dense_top(docs.select("vec_id", "embedding"), items.select("vec_id", "embedding"), 10))


def hybrid_hits(spark, d):
    return R.hybrid(index_of(spark, d), asked(spark, d), table(spark, d, "embeddings"))


@query
def hybrid_search(spark, d):
    h = hybrid_hits(spark, d)
    return h.select("query_id", "doc_id", F.round("score_dense", 6).alias("score_dense"), F.round("score_bm25", 6).alias("score_bm25"), F.round("rrf", 6).alias("rrf"), "channels", F.col("rank").cast("long").alias("rank"))


@query
def hybrid_previews(spark, d):
    chunks = docs_of(spark, d).select("doc_id", F.col("lang").alias("theme"), "text")
    return R.shown_hits(hybrid_hits(spark, d).filter("rank <= 10").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank")), chunks)


@query
def dense_only_from_hybrid(spark, d):
    return shown(R.dense_only(hybrid_hits(spark, d), 10), "score_dense")


def reranked(spark, d, k=5, scorer=R.overlap_scorer):
    return R.rerank(hybrid_hits(spark, d), docs_of(spark, d), asked(spark, d), k=k, scorer=scorer)


def shown_ranks(r):
    return r.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("hybrid_rank").cast("long").alias("hybrid_rank"), F.col("final_rank").cast("long").alias("final_rank"))


@query
def rerank_topk(spark, d):
    return shown_ranks(reranked(spark, d))


@query
def rerank_by_model(spark, d):
    """The same by an object behind the batched interface."""
    return shown_ranks(reranked(spark, d, scorer=models.pair_scorer(models.CoverageModel())))


@query
def rank_movement(spark, d):
    return R.rank_movement(reranked(spark, d))


@query
def rerank_summary(spark, d):
    return R.rerank_summary(reranked(spark, d), hybrid_hits(spark, d).join(docs_of(spark, d), "doc_id", "left_semi"))


@query
def search_report(spark, d):
    hits = stored(hybrid_hits(spark, d).join(docs_of(spark, d).select("doc_id", "text"), "doc_id"), "hits")
    every = asked(spark, d).select(F.col("item_id").alias("query_id"))
    return reports.search_status(every, hits).crossJoin(reports.rerank_readiness(every, hits))


# Answers


def answer_parts(spark, d):
    sources = stored(A.sources_of(reranked(spark, d)), "sources")  # a few rows a query; every step below reads them
    claims = stored(A.extractive_claims(sources), "claims")
    return sources, claims, A.render(claims, sources)


@query
def extractive_claims(spark, d):
    _, claims, _ = answer_parts(spark, d)
    return claims.select("query_id", F.col("claim").cast("long").alias("claim"), "text", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"))


@query
def rendered_answers(spark, d):
    return answer_parts(spark, d)[2]


@query
def quotations(spark, d):
    return A.quotations(A.sources_of(reranked(spark, d)))


@query
def grounding_filter(spark, d):
    sources, claims, _ = answer_parts(spark, d)
    return A.grounded_claims(claims, sources).select("query_id", F.col("claim").cast("long").alias("claim"), F.round("coverage", 6).alias("coverage"))


@query
def segmented_claims(spark, d):
    s = A.segments(answer_parts(spark, d)[2])
    return s.select("query_id", F.col("segment").cast("long").alias("segment"), "claim_text", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"))


def verified(spark, d):
    sources, _, text = answer_parts(spark, d)
    return A.verify(A.segments(text), sources)


@query
def verified_citations(spark, d):
    v = verified(spark, d)
    return v.select("query_id", F.col("segment").cast("long").alias("segment"), F.col("source").cast("long").alias("source"), "doc_id", F.round("entailment", 6).alias("entailment"), F.round("support", 4).alias("support"), "verdict")


@query
def verdict_summary(spark, d):
    return evaluation.verdict_counts(verified(spark, d))


@query
def faithfulness(spark, d):
    return evaluation.faithfulness(verified(spark, d))


@query
def weighted_accuracy(spark, d):
    return evaluation.weighted_by_citations(evaluation.faithfulness(verified(spark, d)))


@query
def verification_by_model(spark, d):
    """The same support by an object behind the batched interface, each pair once."""
    sources, _, text = answer_parts(spark, d)
    v = A.verify(A.segments(text), sources, lambda rows, p, h: A.scored_once(rows, models.nli_scorer(models.CoverageModel()), p, h))
    return v.select("query_id", F.col("segment").cast("long").alias("segment"), F.col("source").cast("long").alias("source"), "support", "verdict", "citation_id")


def doubtful(claims):
    """Claims as a model might make them: some as extracted, some negated, some of words that no source has, all cited to
    the first source."""
    kind = F.col("query_id") % 4
    text = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("It is never so that "), F.col("text"))).when(kind == 2, F.concat(F.col("text"), F.lit(" qq ww ee rr tt yy uu ii oo pp aa ss dd ff gg hh jj kk ll zz xx cc vv bb nn mm"))).otherwise(F.lit("Qq ww ee rr tt yy uu ii oo pp aa ss dd ff gg hh jj kk ll zz xx cc vv bb nn."))
    return claims.select("query_id", "claim", text.alias("text"), F.array(F.lit(1)).alias("citations"))


@query
def nli_gate(spark, d):
    sources, claims, _ = answer_parts(spark, d)
    made = stored(doubtful(claims), "made-claims")
    return A.gate(made, A.render(made, sources), sources)


@query
def answers(spark, d):
    sources, claims, _ = answer_parts(spark, d)
    final = A.answers(sources, claims)
    plain = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return final.select("query_id", "decision", "answer", plain("citations"), plain("cited"))


@query
def citation_repair(spark, d):
    sources, claims, _ = answer_parts(spark, d)
    wrong = claims.withColumn("citations", F.when(F.col("claim") % 2 == 0, F.array(F.lit(1))).otherwise(F.col("citations")))
    out = A.repaired(wrong, sources)
    return out.select("query_id", F.col("claim").cast("long").alias("claim"), "text", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"), "changed")


@query
def claims_from_model(spark, d):
    """Claims parsed from a model's answers, some of them spoilt, cleaned, grounded and repaired, or else extracted."""
    sources, claims, _ = answer_parts(spark, d)
    one = F.to_json(F.struct(F.concat("text", F.lit(" [1] and [9].")).alias("text"), F.array(F.lit(1), F.lit(7)).alias("citations")))
    body = claims.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim", one.alias("o")))), lambda x: x["o"]), ",").alias("o"))
    raw = F.when(F.col("query_id") % 3 == 0, F.lit("I do not know.")).otherwise(F.concat(F.lit('Here: {"claims": ['), "o", F.when(F.col("query_id") % 3 == 1, "]} done").otherwise("], oops} done")))
    out = A.generated_claims(body.select("query_id", raw.alias("raw")), sources)
    return out.select("query_id", F.col("claim").cast("long").alias("claim"), "text", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"))


INSTRUCTIONS = "Answer from the numbered sources alone and cite them."


@query
def prompts(spark, d):
    sources, _, _ = answer_parts(spark, d)
    paged = sources.withColumn("page_start", F.lit(1)).withColumn("page_end", F.size(F.split("passage", "\n")))
    p = A.prompts(paged, INSTRUCTIONS)
    return p.select("query_id", F.md5("prompt").alias("prompt"), T.prompt_question(F.col("prompt")).alias("question"), F.size(T.prompt_sources(F.col("prompt"))).cast("long").alias("n_sources"))


@query
def answer_summary(spark, d):
    sources, claims, _ = answer_parts(spark, d)
    final = stored(A.answers(sources, claims), "answers")
    return A.generation_summary(final).drop("mean_generation_ms", "max_generation_ms").crossJoin(reports.verification_readiness(final, sources))


@query
def source_references(spark, d):
    sources, claims, _ = answer_parts(spark, d)
    return A.source_references(sources, A.answers(sources, claims)).withColumn("source", F.col("source").cast("long"))


@query
def generation_readiness(spark, d):
    r = stored(reranked(spark, d).withColumn("page_start", F.lit(1)), "reranked")
    return reports.generation_readiness(asked(spark, d).select(F.col("item_id").alias("query_id")), r)


@query
def self_check(spark, d):
    """A claim that a text holds, and its negation with words of its own."""
    rows = asked(spark, d).select("item_id", F.col("text").alias("passage"), F.col("text").alias("true_claim"), F.concat(F.lit("never "), "text", F.lit(" qq ww ee")).alias("false_claim"))
    return A.self_check(rows).groupBy("kind", "verdict", "expected").agg(F.count("*").alias("n"))


@query
def sanitized_claims(spark, d):
    text = F.concat("text", F.lit(" as said in ["), F.col("item_id").cast("string"), F.lit("] ,  [2] and [1]."))
    own = F.when(F.col("item_id") % 2 == 0, F.array(F.lit(4), F.lit(9))).otherwise(F.array(F.lit(5)))
    return asked(spark, d).select("item_id", T.sanitized_claim(text).alias("claim"), F.array_join(T.claim_citations(text, own, F.lit(5)).cast("array<string>"), ",").alias("citations"))


@query
def parsed_claims(spark, d):
    raw = F.concat(F.lit('noise {"claims": [{"text": "a '), F.col("item_id").cast("string"), F.lit('", "citations": [2, "1", 3.7, "x"]}, {"text": "b", "citations": [2512.1v1'), F.lit("]}]} tail"))
    return asked(spark, d).select("item_id", F.inline(P.parse_claims(raw)))


@query
def support_verdicts(spark, d):
    e, c = F.col("l_discount") * 10, F.col("l_tax") * 5
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", e.alias("e"), c.alias("c"))
    s = T.support_score(F.col("e"), F.col("c"))
    return rows.groupBy(T.verdict(s).alias("verdict")).agg(F.count("*").alias("n"), F.round(F.avg(s), 3).alias("mean"))


# Evaluation


def relevant(spark, d):
    """``query_id, doc_id`` of documents that hold an item's text.

    A text that holds an item holds all of its words but the first and last as words of its own.  The rarest of these
    finds candidates in the index, and containment decides; items without such a word meet all texts.
    """
    index = index_of(spark, d)
    items = asked(spark, d).select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    words = T.word_list(F.col("needle"))
    inner = F.filter(F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 2)), lambda w: ~w.isin(T.STOPWORDS))
    rare = items.select("query_id", F.explode(F.array_distinct(inner)).alias("term")).join(index.terms, "term").groupBy("query_id").agg(F.min(F.struct("df", "term"))["term"].alias("term"))
    rare = rare.withColumn("bucket", I.bucket_of(F.col("term"), index.buckets))
    found = index.postings.join(rare, ["bucket", "term"]).select("query_id", F.col("id").alias("doc_id")).join(items, "query_id").join(docs_of(spark, d), "doc_id")
    bare = items.filter(F.size(inner) == 0)
    every = docs_of(spark, d).join(bare, F.contains("text", F.col("needle")))
    return found.filter(F.contains("text", F.col("needle"))).select("query_id", "doc_id").union(every.select("query_id", "doc_id"))


@query
def recall_at_k(spark, d):
    return evaluation.recall(R.bm25_top(index_of(spark, d), asked(spark, d), 10), relevant(spark, d))


@query
def reciprocal_rank(spark, d):
    return evaluation.reciprocal_rank(R.bm25_top(index_of(spark, d), asked(spark, d), 10), relevant(spark, d))


@query
def latency_percentiles(spark, d):
    return evaluation.latency(table(spark, d, "events"), "event_type", "value")


@query
def latency_summary(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("value").alias("total_ms"), (F.col("value") / 4).alias("dense_ms"), (F.col("value") / 8).alias("bm25_ms"))
    return reports.latency_summary(rows, ("dense_ms", "bm25_ms"))


def latencies(spark, d):
    """Samples that stand in for times, as runs differ: event *i* is a run of one configuration on one question."""
    return table(spark, d, "events").select(
        F.element_at(F.array(*map(F.lit, evaluation.CONFIGS)), (F.col("event_id") % 4 + 1).cast("int")).alias("config"), (F.col("event_id") / 4).cast("long").alias("query_id"), F.col("value").alias("latency_ms")
    )


def evaluated(spark, d):
    """Every configuration on every question that some document answers, from one search and one re-ranking."""
    hits = stored(hybrid_hits(spark, d), "hits")
    ranks = stored(R.rerank(hits, docs_of(spark, d), asked(spark, d), k=evaluation.DEPTH), "reranked")
    sources = stored(A.sources_of(ranks.filter(F.col("final_rank") <= evaluation.SOURCES)), "sources")
    text = A.render(stored(A.extractive_claims(sources), "claims"), sources)
    rel = stored(relevant(spark, d), "relevant")
    return evaluation.evaluated(stored(evaluation.hits_by_config(hits, ranks), "config-hits"), rel, A.verify(A.segments(text), sources), latencies(spark, d))


@query
def evaluation_rows(spark, d):
    return evaluated(spark, d)


@query
def explored_theme(spark, d):
    """What the configurations give for questions of one theme: those of even items."""
    themes = asked(spark, d).select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("theme"))
    return evaluation.explored(evaluated(spark, d), themes, "even")


def summary(spark, d):
    return stored(evaluation.summarized(evaluated(spark, d)), "summary")


def metrics(spark, d):
    return evaluation.long_metrics(evaluation.displayed(summary(spark, d)), [*evaluation.QUALITY, *T.COSTS])


@query
def configuration_summary(spark, d):
    return summary(spark, d)


@query
def metrics_pivot(spark, d):
    return evaluation.pivot_metrics(metrics(spark, d), [*evaluation.QUALITY, *T.COSTS])


@query
def metrics_display(spark, d):
    return metrics(spark, d).select("config", "metric", T.shown_metric(F.col("metric"), F.col("value")).alias("shown"))


@query
def best_config(spark, d):
    return evaluation.best_config(metrics(spark, d))


@query
def winning_config(spark, d):
    return evaluation.winner(stored(evaluation.best_config(metrics(spark, d)), "best"))


@query
def metric_gains(spark, d):
    return evaluation.step_gains(metrics(spark, d))


@query
def trade_off(spark, d):
    return evaluation.trade_off(evaluation.long_metrics(summary(spark, d), ["recall_at_5", "avg_latency_ms"]))


@query
def normalised_metrics(spark, d):
    return evaluation.normalised(metrics(spark, d))


@query
def verification_summary(spark, d):
    return evaluation.verification_summary(stored(verified(spark, d), "verified"))


@query
def readiness_flags(spark, d):
    return evaluation.readiness(docs_of(spark, d), "source", "n_chars >= 100")


@query
def judged_ids(spark, d):
    """Set operations: ids that either table judges, both do, or only one does."""
    a, b = docs_of(spark, d).select(F.col("doc_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    tag = lambda df, name: df.select("id", F.lit(name).alias("kind"))
    return tag(a.union(b).distinct(), "any").union(tag(a.intersect(b), "both")).union(tag(a.exceptAll(b), "first"))
