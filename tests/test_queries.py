"""Registered queries against their SQL, and hand-checkable cases."""

import math

import duckdb
import pytest

from lexiforge.plans import oracles, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A slice of every family; the driver compares all of them.
CHECKED = "author_names text_quality validated_manifest chunk_gate duplication_report vector_store bm25_index_status evaluation_rows nli_gate claims_from_model file_issues token_estimate sentence_units shingle_counts ids_and_keys dedupe_best_version manifest_issues page_islands near_duplicate_pairs rank_percentiles bm25_padded hybrid_search verified_citations metric_gains latency_percentiles".split()


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return out


def rows(frame):
    plain = lambda v: "" if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, (tuple(plain(getattr(v, "item", lambda v=v: v)()) for v in r) for r in frame.itertuples(index=False)))), list(frame.columns)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, FOLDER).toPandas()) == rows(duck.sql(oracles.ORACLES[name]).df())


def test_every_oracle_has_a_query():
    assert set(oracles.ORACLES) <= set(queries.QUERIES)


def test_token_estimates(spark):
    from pyspark.sql import functions as F

    from lexiforge.functions import text as T

    got = [r.n for r in spark.createDataFrame([("x" * n,) for n in (0, 2, 6, 10, 14)], "t string").select(F.length("t").alias("k"), T.token_estimate(F.col("t")).alias("n")).orderBy("k").collect()]
    assert got == [1, 1, 2, 2, 4]


def test_bm25_by_hand(spark):
    from lexiforge.operators import retrieval as R
    from lexiforge.operators.index import build_index, verify_index
    from lexiforge.sources.scratch import scratch_path

    docs = spark.createDataFrame([(1, "cat sat mat"), (2, "cat cat dog"), (3, "cat ran"), (4, "bird flew away far"), (5, "dog dog bird")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cat dog"), (2, "dog dog"), (3, "zebra")], "item_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in R.bm25_scores(docs, asked).collect()}
    want = {(1, 1): 0.192448, (1, 2): 0.611399, (1, 3): 0.226410, (1, 5): 0.480675, (2, 2): 0.672944, (2, 5): 0.961349}
    assert got.keys() == want.keys() and all(math.isclose(got[k], v, abs_tol=1e-5) for k, v in want.items())
    index = build_index(docs, scratch_path(spark, "index"))
    assert verify_index(index, docs).filter("not passed").isEmpty() and index.stats.first().avgdl == 3.0
    padded = R.bm25_top(index, asked, 2, pad_zero=True).filter("query_id = 3").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in padded] == [(1, 0.0), (2, 0.0)]


def test_support_verdicts_and_segments(spark):
    from pyspark.sql import functions as F

    from lexiforge.functions import text as T
    from lexiforge.operators import answers as A

    pairs = spark.createDataFrame([(0.9, 0.05), (0.6, 0.1), (0.3, 0.0), (0.1, 0.8)], "e double, c double")
    got = [(r.s, r.v) for r in pairs.select("e", T.support_score(F.col("e"), F.col("c")).alias("s")).withColumn("v", T.verdict(F.col("s"))).orderBy(F.desc("e")).collect()]
    assert got == [(0.8526, "Supported"), (0.5143, "Weak Support"), (0.3, "Unsupported"), (0.0111, "Unsupported")]
    answer = spark.createDataFrame([(1, "A is b [1]. C d [2][2]. Uncited. Why? [3].")], "query_id long, answer string")
    assert [(r.claim_text, r.citations) for r in A.segments(answer).orderBy("segment").collect()] == [("A is b .", [1]), ("C d .", [2, 2]), (".", [3])]


def test_lenient_claims():
    from lexiforge.functions.python_text import claims_of

    assert claims_of('x {"claims": [{"text": "a", "citations": [2, "1", 3.7, "x"]}]} y') == [{"text": "a", "citations": [1, 2, 3]}]
    assert claims_of('{"claims": [{"text": "a", "citations": [2512.1v1, 2]}, {"text": "b", "citations": [x]}]}') == [{"text": "a", "citations": [2]}]
    assert claims_of("none") == claims_of(None) == []


def test_chunker_limits():
    from lexiforge.operators.chunking import Chunker

    text = " ".join(f"Sentence number {i} has some words in it." for i in range(400))
    chunks = Chunker()([(1, text[:6000]), (2, text[6000:])])
    assert chunks and [c["seq"] for c in chunks] == list(range(1, len(chunks) + 1))
    assert all(100 <= c["tokens_est"] <= 512 for c in chunks)
    assert Chunker()([(1, "too short")]) == []


def test_malformed_chunks_are_findings(spark):
    from lexiforge.operators import quality

    rows = [("a", "d1", "t", 1, 2, 120, "some words"), ("a", "d1", "u", None, 2, None, ""), (None, None, None, None, None, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, theme string, page_start int, page_end int, tokens_est int, text string")
    got = {r.check: r.status for r in quality.chunk_gate(chunks).collect()}
    assert got["required_fields"] == got["chunk_id_unique"] == got["empty_text"] == got["page_coherence"] == "FAIL"
    assert got["document_id_consistency"] == got["length_range"] == "WARNING" and len(got) == 8
    assert quality.gate_status(quality.chunk_gate(chunks)).first().status == "FAIL"


def test_short_index_tables_are_refused(spark, tmp_path, monkeypatch):
    from lexiforge.sources import tables

    rows = spark.range(5)
    tables.write_index({"whole": rows, "none": rows.limit(0)}, str(tmp_path))
    whole = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths: whole(self, *paths).limit(3))
    with pytest.raises(tables.IntegrityError, match="3 rows instead of 5"):
        tables.write_index({"short": rows}, str(tmp_path))


def test_claims_that_are_no_claims():
    from lexiforge.functions.python_text import claims_of, clean_page_text

    assert claims_of('{"claims": [{"text": "a", "citations": 2}, "x", 3, {"text": "b", "citations": ["1", null, [2]]}]}') == [{"text": "b", "citations": [1]}]
    assert claims_of('{"claims": 7}') == claims_of("[1]") == claims_of("}{") == claims_of("") == []
    assert claims_of('{"claims": [{"text": "say \\"a\\"\\nb", "citations": [4], }') == [{"text": 'say "a" b', "citations": [4]}]
    assert clean_page_text("a\u00a0 b \t c\n\n\n\n d\fe \ufb01x ") == "a b c\n\nd\ne fix"


def test_chunker_against_a_plain_version():
    import random

    from lexiforge.operators.chunking import Chunker, estimate, last_words

    def plain(units, target, overlap, cap, least):
        """One unit after the other, as the rules say it."""
        out, held, new = [], [], 0
        size = lambda: sum(n for *_, n in held)

        def flush():
            nonlocal held, new
            total, new = size(), 0
            if total < least:
                held = []
                return
            text = " ".join(t for _, t, _ in held)
            out.append((held[0][0], held[-1][0], total, text))
            tail = last_words(text, overlap)
            held = [(held[-1][0], tail, estimate(tail))]

        for unit in units:
            if new and size() + unit[2] > cap:
                flush()
            held.append(unit)
            new += 1
            if size() >= target:
                flush()
        if new and size() >= least:
            flush()
        return out

    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "a", ". ", "; ", "  ", "x" * 50, "! "]) for _ in range(rng.randrange(1, 200)))
        target, overlap, cap, least = rng.randrange(1, 60), rng.randrange(1, 30), rng.choice([20, 60, 90]), rng.choice([1, 5, 20])
        cutter = Chunker(target, overlap, cap, least)
        got = [(c["page_start"], c["page_end"], c["tokens_est"], c["text"]) for c in cutter([(1, text)])]
        assert got == plain(cutter.units([(1, text)]), target, overlap, cap, least)


def test_sections_and_page_bounded_chunks(spark):
    from lexiforge.operators import chunking as C

    assert [C.section_header(x) for x in ("INTRO:", "1.2. Method of things", "a", "Related work", "This. is")] == ["INTRO", "1.2. Method of things", None, "Related work", None]
    assert C.paragraphs("a b\n\n  c d \n \n\ne") == [(0, "a b"), (7, "c d"), (15, "e")]
    text = "Abstract\n\n" + "A long paragraph of words here. " * 12 + "\n\np. 3.\n\n" + "Next one has more words. " * 200
    rows = C.page_chunks(text)
    assert {r["section"] for r in rows} == {"Abstract"} and all(C.PAGE_LEAST <= r["tokens_est"] for r in rows) and rows[0]["text"].startswith("A long")
    got = C.chunk_pages(spark.createDataFrame([(1, text + "\f" + text, "en"), (2, None, "en")], "doc_id long, text string, lang string")).collect()
    assert {r.page for r in got} == {1, 2} and len({r.chunk_id for r in got}) == len(got) and all(r.reference.startswith(f"1-p{r.page:03d}-c") for r in got)


def test_files_and_guards(spark, tmp_path):
    import json

    from lexiforge.sources import tables as S

    chunk = {"chunk_id": "c1", "document_id": "d", "theme": "rag", "page_start": 1, "page_end": 1, "tokens_est": 120, "text": "x"}
    write = lambda name, value: (tmp_path / name).write_text(json.dumps(value)) and str(tmp_path / name)
    good = write("good.json", {"chunks": [chunk, {**chunk, "chunk_id": "c2"}]})
    assert S.chunks(spark, good).count() == S.payload(spark, good).count() == 2
    for rows in ([], [chunk, chunk], [{**chunk, "text": None}]):
        with pytest.raises(S.IntegrityError):
            S.chunks(spark, write("bad.json", {"chunks": rows}))
    with pytest.raises(S.IntegrityError):
        S.payload(spark, write("none.json", {"chunks": []}))
    documents = write("documents.json", {"documents": [{"id": "d", "theme": "rag", "page_count": 3, "pages": [{"page": 1, "text": "x"}]}]})
    assert S.documents(spark, documents).first().pages[0].text == "x" and [tuple(r) for r in S.page_counts(spark, documents).collect()] == [("d", 3)]
    assert S.page_counts(spark, str(tmp_path / "missing.json")) is None and S.page_counts(spark, good) is None
    assert S.manifest(spark, write("manifest.json", [{"theme": "rag", "arxiv_id": "2401.00001v1", "title": "t"}])).first().arxiv_id == "2401.00001v1"
    assert S.located(spark, "good.json", [str(tmp_path / "no"), str(tmp_path)]) == good
    with pytest.raises(FileNotFoundError):
        S.located(spark, "x.json", [str(tmp_path)])
    slots = [{"id": "q", "question": "a?", "relevant_chunks": ["c1"]}, {"id": "q", "question": "b?", "relevant_chunks": ["c1", "zz"]}, {"id": "r", "question": "", "relevant_chunks": ["c1"]}, {"id": "s", "question": "c?"}]
    for path in (write("list.json", slots), write("envelope.json", {"questions": slots})):
        pairs, skipped = S.resolve_questions(S.questions(spark, path), S.chunks(spark, good))
        assert [(r.id, r.question, r.chunk_id) for r in pairs.collect()] == [("q", "a?", "c1")]
        assert sorted((r.id, r.reason) for r in skipped.collect()) == [("q", "1 of 2 chunks unknown"), ("r", "empty slot"), ("s", "empty slot")]
    rows = spark.createDataFrame([("q1", "A", 0.5, None), ("q2", "B", None, 1.5)], "query_id string, config string, recall_at_3 double, faithfulness double")
    S.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(p.read_text() for p in (tmp_path / "csv").glob("*.csv")) == ["query_id,config,recall_at_3,faithfulness\nq1,A,0.5,\nq2,B,,1.5\n"]
    assert S.results(spark, str(tmp_path / "missing.csv")).count() == 0 and S.report(spark, str(tmp_path / "x"), "status string").count() == 0
    S.write_report(rows, str(tmp_path / "report"))
    assert S.report(spark, str(tmp_path / "report"), "config string, faithfulness double").count() == 2
    S.write_with_metadata(rows, str(tmp_path / "kept"), "test", {"k": "1"}, rows.groupBy().count())
    assert spark.read.parquet(str(tmp_path / "kept/metadata")).first().config == {"k": "1"}
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.pdf").write_bytes(b"%PDF" + b"x" * 60_000 + b"%%EOF")
    (tmp_path / "pdf/b.pdf").write_bytes(b"PDF /Encrypt")
    from lexiforge.operators import corpus

    got = {r.path.rsplit("/", 1)[1]: r.issues for r in corpus.file_issues(S.binary_files(spark, str(tmp_path / "pdf"))).collect()}
    assert got == {"a.pdf": [], "b.pdf": ["too_small", "bad_signature", "no_eof", "corrupt_pdf"]}


def test_manifest_is_written_in_order(spark, tmp_path):
    from lexiforge.sources import tables as S

    rows = spark.createDataFrame([("b", "rag", "valid", False), ("a", "rag", "flagged", False), ("c", "agents", "valid", False), ("d", "rag", "invalid", False), ("e", "rag", "valid", True)], "id string, theme string, status string, quarantined boolean")
    S.write_manifest(rows, str(tmp_path / "m"))
    got = [x for p in sorted((tmp_path / "m").glob("*.json")) for x in p.read_text().splitlines()]
    assert [x.split('"id":"')[1][0] for x in got] == ["c", "a", "b"]


def test_vector_store_refuses_what_does_not_fit(spark, tmp_path):
    from lexiforge.operators import vectors as V
    from lexiforge.sources.tables import IntegrityError

    folder = str(tmp_path / "v")
    assert [V.ensure_collection(spark, folder, 2), V.ensure_collection(spark, folder, 2), V.ensure_collection(spark, folder, 2, recreate=True)] == ["created", "reused", "recreated"]
    with pytest.raises(IntegrityError):
        V.ensure_collection(spark, folder, 3)
    rows = lambda *r: spark.createDataFrame(list(r), "id string, vector array<double>")
    assert V.upsert(rows(("a", [1.0, 0.0]), ("b", [0.0, 1.0])), folder) == 2 and V.upsert(rows(("b", [1.0, 1.0]), ("c", [0.0, 0.0])), folder) == 3
    assert spark.read.parquet(f"{folder}/points").filter("id = 'b'").first().vector == [1.0, 1.0]
    for bad in (rows(("d", [1.0])), rows(("d", None)), rows(("d", [1.0, 0.0]), ("d", [1.0, 0.0]))):
        with pytest.raises(IntegrityError):
            V.upsert(bad, folder)
    assert V.verify_store(spark, folder, rows(("a", None), ("b", None), ("z", None)), payload=("id",)).first().status == "FAIL"


def test_dense_search_against_all_products(spark, monkeypatch):
    import numpy as np

    from lexiforge.operators import retrieval as R
    from lexiforge.operators import vectors as V

    x = np.round(np.random.default_rng(1).standard_normal((300, 4)), 1)
    v = spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(x)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<double>")
    monkeypatch.setattr(V, "BLOCK", 3)  # several blocks of queries
    got = [(r.query_id, r.doc_id) for r in R.dense_top(v, v.filter("vec_id < 10"), 7).orderBy("query_id", "rank").collect()]
    want = [(q, int(i)) for q in range(10) for i in sorted(range(300), key=lambda i: (-round(float(x[i] @ x[q]), 9), i))[:7]]
    assert got == want


def test_parameter_domains(spark):
    from lexiforge.operators import chunking, models, quality
    from lexiforge.operators import retrieval as R
    from lexiforge.operators.index import build_index

    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for bad in (
        lambda: chunking.Chunker(0), lambda: chunking.Chunker(5, -1), lambda: build_index(rows, "x", k1=0), lambda: build_index(rows, "x", b=1.5), lambda: R.hybrid(None, rows, rows, fetch=5, k=9),
        lambda: R.rerank(rows, rows, rows, pool=3, k=5), lambda: models.generated(rows, None, 1.5), lambda: quality.length_flags(rows, "doc_id", 5, 4), lambda: quality.near_duplicates(rows, "doc_id", "doc_id", "text", 0.0), lambda: quality.outliers(rows, "doc_id", 0, 5),
    ):
        with pytest.raises(ValueError):
            bad()


def test_models_behind_their_interfaces(spark):
    from lexiforge.operators import answers as A
    from lexiforge.operators import models as M
    from lexiforge.operators import retrieval as R

    assert isinstance(M.HashingEmbedder(), M.Embedder) and isinstance(M.CoverageModel(), M.PairModel) and isinstance(M.CoverageModel(), M.NliModel)

    class Generator:
        def generate(self, prompt, temperature):
            if "fail" in prompt:
                raise OSError("unreachable")
            return '{"claims": [{"text": "The cat sat on the mat all day long and did not move.", "citations": [1]}]}'

    assert isinstance(Generator(), M.ClaimGenerator)
    sentence = "The cat sat on the mat all day long and it did not move at all."
    sources = spark.createDataFrame([(1, 1, 7, "where is the cat", sentence, 1, 1), (2, 1, 8, "fail: where is the cat", sentence, 1, 1)], "query_id long, source int, doc_id long, question string, passage string, page_start int, page_end int")
    raw = M.generated(A.prompts(sources, "x"), Generator())
    got = {r.query_id: (r.text, r.citations) for r in A.generated_claims(raw, sources).collect()}
    assert got == {1: ("The cat sat on the mat all day long and did not move", [1]), 2: (sentence, [1])}
    vectors = M.embedded(sources, "passage", M.HashingEmbedder(8)).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in vectors)
    with pytest.raises(R.EmptyPool):
        hits = spark.createDataFrame([(1, 99, 1, 0.1, "dense")], "query_id long, doc_id long, rank int, rrf double, channels string")
        R.rerank(hits, sources.select("doc_id", F_text(sources)), spark.createDataFrame([(1, "q")], "item_id long, text string"), strict=True).count()


def F_text(rows):
    return rows["passage"].alias("text")


def test_gate_by_hand(spark):
    from lexiforge.operators import answers as A

    passage = "Bread needs flour and water and some salt to rise well. It is baked in a hot oven for an hour."
    sources = spark.createDataFrame([(k, 1, 7, q, passage) for k, q in ((1, "what does bread need"), (2, "zebra stripes"), (3, "how is bread baked"), (4, "bread"))], "query_id long, source int, doc_id long, question string, passage string")
    claims = spark.createDataFrame([
        (1, 1, "Bread needs flour and water and some salt to rise well.", [1]), (2, 1, "Zebra stripes are black on white hides of Africa.", [1]),
        (3, 1, "Bread is an old baked thing of flour and water, some say it rises in a hot oven slowly there.", [1]), (4, 1, "Yeast ferments sugars quickly under warmth everywhere bread.", [1]),
    ], "query_id long, claim int, text string, citations array<int>")
    got = {r.query_id: (r.decision, r.answer) for r in A.gate(claims, A.render(claims, sources), sources).collect()}
    assert got[1][0] == "keep" and got[2] == ("refuse", A.REFUSAL) and got[3][0] == "rescue" and got[4][0] == "extract" and got[4][1].endswith("[1].")
    none = A.render(claims.filter("query_id < 0"), sources)
    assert {r.answer for r in A.gate(claims, none, sources).collect()} == {A.REFUSAL}


def test_chunk_stream(spark, tmp_path):
    from lexiforge.streaming.chunks import arriving_documents, chunk_stream

    text = " ".join(f"Sentence number {i} has some words in it." for i in range(60))
    rows = lambda ids: spark.createDataFrame([(i, text, "en") for i in ids], "doc_id long, text string, lang string")
    for ids in ((1, 2), (3,)):
        rows(ids).write.mode("append").parquet(str(tmp_path / "in"))
        chunk_stream(arriving_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.document_id for r in got.select("document_id").distinct().collect()} == {"1", "2", "3"} and got.count() == got.select("chunk_id").distinct().count()


def test_islands_of_equal_intervals_when_sorts_spill(spark):
    """Runs of a few rows are merged without regard to the order of equal rows; what is covered does not depend on it."""
    from lexiforge.operators import quality

    rows = [(d, a, a + 2) for d in range(40) for a in (1 + d % 3, 10, 13, 30) for _ in range(50)]
    conf, limit = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(limit, "33")
    try:
        got = {tuple(r) for clamp in (True, False) for r in quality.islands(spark.createDataFrame(rows, "document_id long, page_start long, page_end long"), clamp=clamp).collect()}
    finally:
        conf.remove(limit)
    assert got == {(d, 12, 32, 32 - d % 3 - 12, 37.5) for d in range(40)}


def test_islands_that_end_before_they_begin(spark):
    from lexiforge.operators import quality

    rows = spark.createDataFrame([(1, 1, 4), (1, 2, 3), (1, 9, 6), (1, 9, 10), (2, 5, None), (3, None, None), (4, None, 9), (4, 1, 3)], "document_id long, page_start long, page_end long")
    got = {clamp: {r.document_id: (r.covered, r.last_page, r.holes) for r in quality.islands(rows, clamp=clamp).collect()} for clamp in (True, False)}
    assert got[True] == {1: (6, 10, 4), 2: (1, 5, 0), 3: (None, None, 0), 4: (3, 9, 6)}
    assert got[False] == {1: (4, 10, 6), 2: (None, None, 0), 3: (None, None, 0), 4: (3, 9, 6)}


def test_page_islands_of_fractions_and_missing_values(spark, tmp_path):
    con = duckdb.connect()
    # every document has an interval of each start once, as the SQL leaves the order of equal ones open
    con.execute("""create table lineitem as select distinct on (l_orderkey, l_partkey) * from (select case when i % 9 > 0 then i % 400 end l_orderkey,
        case when i % 7 > 0 then (i * 13 + i // 400) % 40 - 20 end l_partkey, case when i % 11 > 0 then (i % 200 - 40) / 4 end::double l_quantity from range(1500) t(i))""")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    got, want = map(tuple, queries.page_islands(spark, str(tmp_path)).collect()), con.sql(oracles.ORACLES["page_islands"]).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
