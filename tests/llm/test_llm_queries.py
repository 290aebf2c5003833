"""Registered queries on whole small tables, and defined results of odd rows."""

import hashlib
import re
import zlib
from html import unescape

import numpy as np
import pyarrow.parquet as pq
import pytest

from lexiforge.llm import decontamination, embeddings, html_text, langid, minhash, packing, queries, sharding, substrings, toxicity, warc
from lexiforge.llm.components import connected_components

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, "The same words are here once more and again", "en"), (2, "the SAME words, are here once more and again!", "en"), (3, None, None), (4, "", "en"), (5, "...", None), (None, "no id at all", "en"), (1, "The same words are here once more and again", "en"), (6, "x" * 70, "de"), (7, "x" * 90, "de")]


def odd(spark, rows=ODD):
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return out.selectExpr("*", "1 as version", "'a' as source", "length(text) as n_chars", "2 as rep", "3 as size")


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pandas()


def test_language_held_out(spark):
    got = queries.op1_kneser_ney_langid(spark, FOLDER).toPandas().merge(table("documents"), on="doc_id")
    held = got[got.held_out]
    assert len(got) == len(table("documents")) and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    own = langid.identify(odd(spark)).toPandas()
    assert len(own) == len(ODD) and set(own[own.doc_id.isin([3, 4, 5])].lang_pred) == {"und"}


def test_near_duplicates_against_all_pairs(spark):
    docs = table("documents")
    got = dict(queries.op2_order_minhash_dedup(spark, FOLDER).toPandas()[["doc_id", "class_id"]].itertuples(index=False))
    labelled, edges, *_ = minhash.symbols(docs.text.tolist())
    own = [labelled[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    root = {i: i for i in docs.doc_id}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = docs.doc_id.tolist()
    for i in range(len(ids)):
        for j in range(i):
            if minhash.alignment(own[i], own[j]) >= 0.8:
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in ids}


def test_crowded_buckets_against_all_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(150):  # of a template with 16 slots, every text fills 12 in its own way
        own = [f"w{i}" for i in range(400)]
        for slot in rng.choice(16, 12, replace=False).tolist():
            own[25 * slot + 7] = f"x{rng.integers(4)}"
        texts.append(" ".join(own))
    labelled, edges, *_ = minhash.symbols(texts)
    values = minhash.sketches(labelled, edges, *minhash.FIRST, 1)
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and (values[i] == values[j]).any() and minhash.alignment(labelled[edges[i] : edges[i + 1]], labelled[edges[j] : edges[j + 1]]) >= 0.8:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 30_000)  # several blocks and rounds
    got = dict(minhash.near_duplicates(docs).toPandas()[["doc_id", "class_id"]].itertuples(index=False))
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicate_odd_rows(spark):
    got = minhash.near_duplicates(odd(spark)).toPandas()
    assert len(got) == len(ODD) and set(got[got.doc_id.isin([1, 2])].class_id) == {1} and got[got.doc_id.isin([3, 4, 5, 6])].kept.all()
    kept = minhash.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7]
    assert minhash.near_duplicates(odd(spark, [])).count() == 0


def test_repeats_by_definition(spark):
    docs = table("documents").sort_values("doc_id")
    got = queries.op3_deep_shallow_dedup(spark, FOLDER).toPandas().set_index("doc_id")
    first = set()
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        own = [data[p : p + 50] for p in range(len(data) - 49)]
        for p, w in enumerate(own):
            if w in first:
                gone[p : p + 50] = True
        first.update(own)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        row = got.loc[doc_id]
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    own = substrings.remove_repeats(odd(spark)).toPandas()
    assert own[own.doc_id == 7].n_removed.tolist() == [90] and own[own.doc_id == 6].n_removed.tolist() == [0] and len(own) == len(ODD)
    stripped = substrings.strip_repeats(odd(spark))
    assert stripped.columns == odd(spark).columns and sorted(r.doc_id or 0 for r in stripped.collect()) == [0, 1, 1, 2, 3, 4, 5, 6]


def test_vectors_against_all_pairs(spark):
    data = table("embeddings")
    got = queries.op4_hyperplane_near_duplicates(spark, FOLDER).toPandas().set_index("vec_id")
    unit = embeddings.unit_rows(np.stack(data.embedding))
    links = (unit @ unit.T >= 0.98) & (data.label.to_numpy()[:, None] == data.label.to_numpy())
    assert (got.loc[data.vec_id].n_links.to_numpy() == links.sum(1) - 1).all()
    reach = links.copy()
    while (wider := reach @ reach).sum() > reach.sum():
        reach = wider
    want = [int(data.vec_id.to_numpy()[r].min()) for r in reach]
    assert got.loc[data.vec_id].component_id.tolist() == want and (got.loc[data.vec_id].kept.to_numpy() == (data.vec_id.to_numpy() == np.array(want))).all()
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 0, [0.0, 0.0]), (4, None, [1.0, 0.0]), (5, 0, None), (6, 0, [float("nan"), 1.0]), (7, 0, [1.0, None]), (8, 1, [1.0, 0.0]), (2, 0, [2.0, 0.0])]
    own = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).toPandas()
    assert len(own) == len(rows) and set(own[own.vec_id.isin([1, 2])].n_links) == {2} and own[own.vec_id > 2].n_links.sum() == 0


def test_components(spark):
    rows = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200), (400, 400), (None, 5)]
    got = dict(connected_components(spark.createDataFrame(rows, "a long, b long")).toPandas().itertuples(index=False))
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100, 400: 400}


def test_shards(spark):
    got = queries.op5_lpt_sharding(spark, FOLDER).toPandas()
    assert got.groupby("text_crc32").shard.nunique().max() == 1 and set(got.law) == {"bytes"} and got.shard.between(0, 23).all()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= got.groupby("text_crc32")["size"].sum().max()
    assert len(sharding.shard_documents(odd(spark)).toPandas()) == len(ODD) and sharding.shard_documents(odd(spark, [])).count() == 0


def test_packing(spark):
    got = queries.op6_sum_of_squares_packing(spark, FOLDER).toPandas()
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1].tolist()] and own.length.sum() <= 2048
    assert got.sequence_id.nunique() <= got.length.sum() / 2048 * 1.05 + 1
    own = packing.pack_documents(odd(spark)).toPandas()
    assert len(own) == len(ODD) and own[own.doc_id == 3].ids_crc32.tolist() == [zlib.crc32(b"\0" * 4)]


def test_archives(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    twice = pages.unionByName(pages.filter("page_id < 9").selectExpr("page_id + 1000 as page_id", "url", "html")).unionByName(pages.limit(1).selectExpr("5000L as page_id", "url", "cast(null as string) as html"))
    got = warc.round_trip(spark, twice).toPandas().set_index("page_id")
    want = twice.toPandas()
    for page_id, html in zip(want.page_id, want.html, strict=True):
        data = (html or "").encode()
        big = page_id < 9 and len(data) >= 1000
        row = got.loc[page_id]
        assert (row.payload_bytes, row.payload_digest, row.record_type) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if big else "response")
        assert not big or row.refers_to == page_id + 1000


def test_toxicity_held_out(spark):
    got = queries.op8_toxic_segments(spark, "/root/testdata/sf0.01").toPandas()
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    model = toxicity.fit(odd(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(odd(spark), model).filter("predicted = 0").count() == len(ODD)


def test_leaks(spark):
    got = queries.op9_block_max_decontamination(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs, items = (pq.read_table(f"/root/testdata/sf0.01/{n}.parquet").to_pandas() for n in ("documents", "benchmark"))
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        held = [i for i, t in zip(items.item_id, items.text, strict=True) if t in text]
        assert set(held) <= set(got.loc[doc_id].item_ids) and (not got.loc[doc_id].contaminated or got.loc[doc_id].max_overlap >= 0.5)
    assert got.contaminated.sum() <= 40
    none = spark.createDataFrame([(None, "x"), (1, None)], "item_id long, text string")
    assert decontamination.contaminations(odd(spark), none).filter("not contaminated").count() == len(ODD)


def article_by_cutting(page):
    """The blocks between the tags of the one article element, cut out with plain string work."""
    inside = page.split("<article>")[1].split("</article>")[0]
    blocks = re.split(r"</?(?:h1|p)>", inside)
    plain = (" ".join(unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n\n".join(b for b in plain if b)


def test_pages(spark):
    got = queries.op10_html_main_text(spark, "/root/testdata/sf0.01").toPandas()
    want = {r.page_id: article_by_cutting(r.html) for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pandas().itertuples()}
    assert dict(zip(got.page_id, got.text, strict=True)) == want
    got = queries.op10_html_main_text(spark, FOLDER).toPandas()
    assert (got.n_chars == got.text.str.len()).all() and (got.n_chars > 0).all()
    rows = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>a")], "page_id long, url string, html string").selectExpr("*", "1 as text")
    assert sorted(html_text.extract_pages(rows).toPandas().text) == ["", "", "a"]


def test_pipeline(spark):
    import corpus_pipeline

    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in docs.collect()} >= {1, 3, 4, 5}


def test_empty_tables(spark):
    docs = odd(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    for rows in (
        langid.identify(docs), substrings.remove_repeats(docs), substrings.strip_repeats(docs), embeddings.near_duplicate_vectors(vectors), packing.pack_documents(docs), warc.round_trip(spark, pages),
        toxicity.classify(spark, docs, labels), decontamination.contaminations(docs, items), decontamination.drop_contaminated(docs, items), html_text.extract_pages(pages),
    ):
        assert rows.count() == 0


def test_very_long_texts(spark):
    rng = np.random.default_rng(3)
    word = lambda k: "".join(map(chr, rng.integers(97, 123, k)))
    long = " ".join(word(int(k)) for k in rng.integers(2, 12, 400_000))  # about 2.8 MB: several batches of every operator
    part = long[1_500_000:1_500_300]
    rows = [(5, long, "en"), (6, "other words first, " + part, "en"), (7, long[:2_000_000], "en"), (3, "x" * 60, "en")]
    docs = odd(spark, rows)
    got = substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans").toPandas().set_index("doc_id")
    assert got.loc[5].tolist() == [len(long), 0, 0] and got.loc[6].tolist() == [319, 300, 1] and got.loc[7].tolist() == [2_000_000, 2_000_000, 1]
    classes = dict(minhash.near_duplicates(odd(spark, [*rows, (9, long.upper(), "en")])).select("doc_id", "class_id").toPandas().itertuples(index=False))
    assert classes[9] == 5 and classes[7] == 7 and classes[6] == 6
    pieces = packing.pack_documents(docs).toPandas()
    assert pieces[pieces.doc_id == 5].length.sum() > 1_000_000 and (pieces.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()
    found = decontamination.contaminations(docs, spark.createDataFrame([(1, part)], "item_id long, text string")).toPandas()
    assert set(found[found.contaminated].doc_id) == {5, 6, 7}
    assert len(toxicity.classify(spark, docs, spark.createDataFrame([(5, 1), (6, 0), (7, 0)], "doc_id long, toxic int")).toPandas()) == 4
    assert set(langid.identify(docs).toPandas().lang_pred) == {"en"}


def test_clashing_columns(spark):
    names = "none carry missing data version size small ranges __text c0 c1 key rep sketches bucket n hash group_key cell fold toxic aside language html payload".split()
    docs = odd(spark).select("doc_id", "text", "lang", "n_chars")
    for c in names:
        docs = docs.withColumn(c, docs.doc_id)
    kept = substrings.strip_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == 8 and kept.filter("`none` is not null and `none` != doc_id").count() == 0
    assert minhash.keep_first(docs).columns == docs.columns
    clean = decontamination.drop_contaminated(docs, spark.createDataFrame([(1, "the same words are here once more and again", 5)], "item_id long, text string, part long"))
    assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 3, 4, 5, 6, 7]
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0], 7, 7, 7), (2, 0, [1.0, 0.1], 7, 7, 7)], "vec_id long, label int, embedding array<double>, rep long, bucket long, sound int")
    assert embeddings.near_duplicate_vectors(vectors).toPandas().n_links.tolist() == [1, 1]
    labels = spark.createDataFrame([(1, 1, "x", 3), (2, 0, "y", 4)], "doc_id long, toxic int, text string, fold int")
    assert toxicity.classify(spark, docs, labels).count() == len(ODD)
    pages = spark.createDataFrame([(1, "u", "<p>a", 9, 9)], "page_id long, url string, html string, digest long, refers_to long")
    assert warc.round_trip(spark, pages).first().payload_bytes == 4 and html_text.extract_pages(pages).first().text == "a"


def test_ties_and_repeated_rows(spark):
    docs = odd(spark, [(k, f"text number {k % 3} of the same size", "en") for k in range(9)] + [(1, "text number 1 of the same size", "en")])
    shards = sharding.shard_documents(docs, shards=3).toPandas()
    assert sorted(shards.groupby("shard")["size"].sum()) == sorted(shards.groupby("text_crc32")["size"].sum()) and shards.groupby("text_crc32").shard.nunique().max() == 1
    pieces = packing.pack_documents(docs).toPandas()
    assert len(pieces) == 10 and pieces.sequence_id.nunique() == 1
    pages = spark.createDataFrame([(4, "u", "x" * 1000), (4, "u", "x" * 1000), (9, "u", "x" * 1000), (2, "u", "x" * 999), (3, "u", "x" * 999)], "page_id long, url string, html string")
    got = sorted(map(tuple, warc.round_trip(spark, pages).select("page_id", "record_type", "refers_to").collect()), key=str)
    assert got == [(2, "response", None), (3, "response", None), (4, "revisit", 9), (4, "revisit", 9), (9, "response", None)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    half = " ".join(item.split()[:10]) + " other words that end the text here"
    found = decontamination.contaminations(odd(spark, [(1, item, "en"), (1, item, "en"), (2, half, "en")]), spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")).toPandas()
    assert found[found.doc_id == 1].contaminated.tolist() == [True, True] and found[found.doc_id == 1].n_items.tolist() == [1, 1] and not found[found.doc_id == 2].contaminated.any()


def test_altered_leaks_are_found(spark):
    rng = np.random.default_rng(11)
    items = pq.read_table("/root/testdata/sf0.1/benchmark.parquet").to_pandas()
    filler = "plain filler words stand before and behind the passage in every text of this test ".split()
    rows, long = [], 0
    for k, text in enumerate(items.text):
        words = text.split()
        if len(words) >= 30:
            long += 1
            words[int(rng.integers(3, len(words) - 3))] = "altered"
            rows.append((k, " ".join([*filler * 3, *words, *filler * 3]), "en"))
    rows.append((10_000, " ".join(filler * 50), "en"))
    got = decontamination.contaminations(odd(spark, rows), spark.createDataFrame(items[["item_id", "text"]])).toPandas()
    assert long > 20 and got[got.doc_id < 10_000].contaminated.mean() >= 0.95 and not got[got.doc_id == 10_000].contaminated.any()


def test_damaged_archives(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"page {k} " * 300) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, folder)
    assert warc.read_listed(manifest, folder).filter("kind = 'record'").count() == warc.read_archives(spark, folder).filter("kind = 'record'").count() == 20
    (path,) = (tmp_path / "w").glob("*.warc.gz")
    data = bytearray(path.read_bytes())
    data[len(data) // 2 : len(data) // 2 + 30] = b"\0" * 30
    path.write_bytes(bytes(data))
    kinds = [r.kind for r in warc.read_archives(spark, folder).collect()]
    assert kinds.count("record") >= 17 and "gap" in kinds
    with pytest.raises(Exception, match="LostRecords"):
        warc.read_listed(manifest, folder).count()


def test_common_minimisers_are_parted(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefgh "), 60)) + "0123456789" + "".join(rng.choice(list("abcdefgh "), 60)) for _ in range(40)]
    texts += [texts[3], texts[5][20:120]]
    first, want = set(), {}
    for k, t in enumerate(texts):
        own = [t[p : p + 50] for p in range(len(t) - 49)]
        gone = np.zeros(len(t), bool)
        for p, w in enumerate(own):
            gone[p : p + 50] |= w in first
        want[k] = int(gone.sum())
        first.update(own)
    data = np.frombuffer(b"0123456789" + bytes(60), np.uint8)
    h = substrings.mix(substrings.mix(substrings.words_at(data.data)[:1].astype(np.uint64)) + substrings.words_at(data.data)[2:3].astype(np.uint64))
    monkeypatch.setattr(substrings, "common_minimisers", lambda rows, total: h)
    got = substrings.remove_repeats(odd(spark, [(k, t, "en") for k, t in enumerate(texts)])).toPandas()
    assert dict(zip(got.doc_id, got.n_removed, strict=True)) == want
