"""Quality gates and statistics over chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import stored

# What a chunk must have, limits of sizes, similarity and coverage, and how many examples a report shows.
REQUIRED = ("chunk_id", "document_id", "theme", "page_start", "page_end", "tokens_est", "text")
SHORTEST, LONGEST = 100, 512
SMALL, LARGE = 150, 700
NEAR, WIDTH = 0.60, 8
COVERAGE = 99.0
EXAMPLES, EXAMPLE_GROUPS = 10, 5
EXCESSIVE_PAIRS, EXCESSIVE_SHARE = 5, 0.02
FEW_CHUNKS = 5
PERCENTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
#: Statuses from mild to severe.
SEVERITY = ("PASS", "WARNING", "FAIL")


def null_patterns(rows: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``missing`` (column names joined by comma) and ``n`` for rows that lack a required value."""
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in columns])
    return rows.select(missing.alias("missing")).filter("missing != ''").groupBy("missing").agg(F.count("*").alias("n"))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def contained(part: DataFrame, whole: DataFrame, *keys: str) -> DataFrame:
    """One row: whether every key of ``part`` stands in ``whole``, and how many do not."""
    lost = part.select(*keys).distinct().join(whole.select(*keys).distinct(), list(keys), "left_anti")
    return lost.agg((F.count("*") == 0).alias("contained"), F.count("*").alias("missing"))


def empty_texts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.filter(F.coalesce(T.normal_form(F.col(text_col)), F.lit("")) == "")


def exact_duplicates(rows: DataFrame, id_col: str, text_col: str, empty: bool = False) -> DataFrame:
    """Groups of equal normal forms: ``first_id, n, redundant``; grouping is by hash, so texts do not travel.

    ``empty``: texts without a word are a group too.
    """
    form = T.normal_form(F.coalesce(F.col(text_col), F.lit("")))
    keyed = rows.filter(form != "") if not empty else rows
    keyed = keyed.select(F.col(id_col).alias("id"), F.sha2(form, 256).alias("form"))
    return keyed.groupBy("form").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("first_id", "n", (F.col("n") - 1).alias("redundant"))


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Distinct hashes of a text's word shingles: words are hashed once, and a shingle is a run of their hashes."""
    hashes = F.transform(F.filter(F.split(T.normal_form(text), " "), lambda w: w != ""), lambda w: F.xxhash64(w))

    def of(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) <= width, F.array(F.xxhash64(words))).otherwise(F.array_distinct(many))

    return T.let(hashes, of)


def near_duplicates(rows: DataFrame, id_col: str, block_col: str, text_col: str, threshold: float = NEAR, width: int = WIDTH) -> DataFrame:
    """Pairs ``id_a < id_b`` of one block whose shingle sets reach ``threshold``, by prefix filtering.

    Shingles are ordered by how many sets of the block hold them, rarest first.  Two sets that reach the threshold
    share one of each one's first ``size - ceil(threshold * size) + 1``, so only those meet, only if the sizes allow it,
    and only what meets is compared in full.  Shingles of one set alone take up places of the prefix and never travel.
    """
    if not 0 < threshold <= 1:
        raise ValueError("0 < threshold <= 1 is required")
    hashed = rows.select(F.col(id_col).alias("id"), F.col(block_col).alias("block"), shingle_hashes(F.coalesce(F.col(text_col), F.lit("")), width).alias("s"))
    sets = stored(hashed.filter("size(s) > 0 and id is not null and block is not null"), "shingle-sets")
    flat = sets.select("id", "block", F.size("s").alias("size"), F.explode("s").alias("shingle"))
    held = flat.groupBy("block", "shingle").agg(F.count("*").alias("n")).filter("n > 1")
    shared = flat.join(held, ["block", "shingle"])
    inside = Window.partitionBy("block", "id")
    place = F.row_number().over(inside.orderBy("n", "shingle")) + F.col("size") - F.count("*").over(inside)
    prefix = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    first = shared.withColumn("place", place).filter(F.col("place") <= prefix).select("id", "block", "size", "shingle")
    a, b = first.alias("a"), first.alias("b")
    fits = F.least("a.size", "b.size") >= threshold * F.greatest("a.size", "b.size") - 1e-9
    meet = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.id") < F.col("b.id")) & fits)
    pairs = meet.select(F.col("a.block").alias("block"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
    side = lambda x: sets.select("block", F.col("id").alias(f"id_{x}"), F.col("s").alias(f"s_{x}"))
    both = pairs.join(side("a"), ["block", "id_a"]).join(side("b"), ["block", "id_b"]).withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    value = F.col("common") / (F.size("s_a") + F.size("s_b") - F.col("common"))
    return both.filter(value >= threshold).select("id_a", "id_b", F.round(value, 3).alias("jaccard"))


def first_pairs(pairs: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The pairs that a report shows: most alike first, then by ids."""
    return pairs.orderBy(F.desc("jaccard"), "id_a", "id_b").limit(most)


def first_groups(rows: DataFrame, id_col: str, text_col: str, most: int = EXAMPLE_GROUPS) -> DataFrame:
    """``first_id, id`` of the members of the first groups of equal normal forms, a row each."""
    groups = exact_duplicates(rows, id_col, text_col).orderBy("first_id").limit(most).select("first_id")
    keyed = rows.select(F.col(id_col).alias("id"), F.sha2(T.normal_form(F.col(text_col)), 256).alias("form"))
    heads = keyed.join(F.broadcast(groups), F.col("id") == F.col("first_id")).select("first_id", "form").distinct()
    return keyed.join(F.broadcast(heads), "form").select("first_id", "id")


def duplication(rows: DataFrame, id_col: str, block_col: str, text_col: str, threshold: float = NEAR) -> DataFrame:
    """One row: exact groups and redundant rows, near pairs and the rows in them, and whether that is excessive."""
    exact = exact_duplicates(rows, id_col, text_col, empty=True).agg(F.count("*").alias("exact_groups"), F.coalesce(F.sum("redundant"), F.lit(0)).alias("redundant"))
    pairs = stored(near_duplicates(rows, id_col, block_col, text_col, threshold), "near-pairs")
    near = pairs.agg(F.count("*").alias("near_pairs"))
    involved = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).agg(F.count_distinct("id").alias("involved"))
    out = exact.crossJoin(near).crossJoin(involved).crossJoin(rows.agg(F.count("*").alias("n")))
    most = F.greatest(F.lit(EXCESSIVE_PAIRS), F.floor(F.col("n") * EXCESSIVE_SHARE))
    return out.select("exact_groups", "redundant", "near_pairs", "involved", ((F.col("redundant") > 0) | (F.col("near_pairs") > most)).alias("excessive"))


def islands(rows: DataFrame, key: str = "document_id", start: str = "page_start", end: str = "page_end", clamp: bool = True) -> DataFrame:
    """Per document: pages covered, last page, holes and coverage in percent; intervals that touch are one.

    ``clamp``: an interval ends where it begins at least, as the statistics have it; the gate takes its end as it is.
    Every interval counts what it adds to the pages before it, so one sort does and equal intervals may come in any order.
    """
    first, last = F.col(start), F.greatest(F.col(start), F.col(end)) if clamp else F.col(end)
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last(start), last)
    marked = rows.withColumn("before", F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    apart = F.coalesce(first > F.col("before") + 1, F.lit(True))
    added = F.when(apart, last - first + 1).otherwise(F.greatest(F.lit(0), last - F.col("before")))
    out = marked.groupBy(key).agg(F.sum(added).cast("long").alias("covered"), F.max(last).cast("long").alias("last_page"), F.min(first).cast("long").alias("first_page"))
    holes = F.greatest(F.lit(0), F.col("last_page") - F.col("first_page") + 1 - F.col("covered"))
    percent = F.round(100 * F.col("covered") / F.greatest(F.lit(1), F.col("last_page")), 1)
    return out.select(key, "covered", "last_page", holes.alias("holes"), percent.alias("coverage_pct"))


def coverage_totals(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """One row: documents, their fewest, most and mean chunks, how many have few, and the pages covered of all in percent."""
    per = rows.groupBy(key).agg(F.count("*").alias("chunks"))
    counts = per.agg(F.count("*").alias("documents"), F.min("chunks").alias("fewest"), F.max("chunks").alias("most"), F.round(F.avg("chunks"), 1).alias("mean_chunks"), F.count_if(F.col("chunks") < FEW_CHUNKS).alias("thin_documents"))
    return counts.crossJoin(islands(rows, key).agg(F.round(100 * F.sum("covered") / F.greatest(F.lit(1), F.sum("last_page")), 1).alias("overall_coverage_pct")))


def span_totals(rows: DataFrame, start: str = "page_start", end: str = "page_end") -> DataFrame:
    """One row: mean and largest span in pages, and chunks over several pages."""
    span = F.greatest(F.lit(1), F.col(end) - F.col(start) + 1)
    return rows.agg(F.round(F.avg(span), 2).alias("mean_span"), F.max(span).cast("long").alias("max_span"), F.count_if(span > 1).alias("multi_page"), F.round(100 * F.count_if(span > 1) / F.count("*"), 1).alias("multi_page_pct"))


def histogram(values: DataFrame, value: str, width: int = 100) -> DataFrame:
    return values.groupBy((F.floor(F.col(value) / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def rank_percentiles(values: DataFrame, value: str, group: str | None = None, at: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Element ``min(n - 1, int(q * n))`` of each group's sorted values, for every q, by counting: no group is gathered.

    Values are first counted, and running counts find the element, so a group of any size spreads over tasks by
    its distinct values.
    """
    keyed = values.select((F.col(group) if group else F.lit("all")).alias("group"), F.col(value).alias("value")).filter("value is not null")
    counts = keyed.groupBy("group", "value").agg(F.count("*").alias("c"))
    running = Window.partitionBy("group").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    up = counts.withColumn("upto", F.sum("c").over(running)).withColumn("n", F.sum("c").over(Window.partitionBy("group")))
    asked = up.select("*", F.explode(F.array(*map(F.lit, at))).alias("q"))
    place = F.least(F.col("n") - 1, (F.col("q") * F.col("n")).cast("long"))
    return asked.filter((place < F.col("upto")) & (place >= F.col("upto") - F.col("c"))).select("group", "q", "value")


def grouped_statistics(rows: DataFrame, theme: str, document: str, size: str) -> DataFrame:
    """Counts, sums and means at three levels: everything, each theme, each document."""
    rows.createOrReplaceTempView("lexiforge_stats")
    return rows.sparkSession.sql(
        f"""select grouping_id() as level, `{theme}` as theme, `{document}` as document, count(*) as n, sum(`{size}`) as total,
        min(`{size}`) as low, max(`{size}`) as high, round(avg(`{size}`), 1) as mean
        from lexiforge_stats group by grouping sets ((), (`{theme}`), (`{theme}`, `{document}`))"""
    )


def theme_rollup(rows: DataFrame, theme: str, document: str, size: str) -> DataFrame:
    """Documents, chunks, sizes and their means for each theme."""
    return rows.groupBy(F.col(theme).alias("theme")).agg(
        F.count_distinct(document).alias("documents"), F.count("*").alias("chunks"), F.sum(size).alias("tokens"),
        F.round(F.count("*") / F.count_distinct(document), 1).alias("chunks_per_document"), F.round(F.avg(size), 1).alias("mean_tokens"),
    )


def length_flags(rows: DataFrame, size: str, low: int = SHORTEST, high: int = LONGEST) -> DataFrame:
    """Counts of sizes below, inside, above the range and not positive."""
    if not 0 < low <= high:
        raise ValueError("0 < low <= high is required")
    s = F.col(size)
    return rows.agg(F.count_if(s < low).alias("below"), F.count_if(s.between(low, high)).alias("inside"), F.count_if(s > high).alias("above"), F.count_if(s <= 0).alias("not_positive"))


def length_examples(rows: DataFrame, size: str, id_col: str, low: int = SHORTEST, high: int = LONGEST, most: int = EXAMPLES) -> DataFrame:
    """``kind, id, size`` of the shortest below and the longest above the range, ties by id."""
    side = lambda kind, rule, order: rows.filter(rule).select(F.lit(kind).alias("kind"), F.col(id_col).alias("id"), F.col(size).alias("size")).orderBy(order, "id").limit(most)
    return side("below", F.col(size) < low, F.asc("size")).union(side("above", F.col(size) > high, F.desc("size")))


def outliers(rows: DataFrame, size: str, small: int = SMALL, large: int = LARGE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows that are small or large, with their kind, a preview of 80 characters and their place: the smallest first among
    the small, the largest first among the large, ties by id."""
    if small <= 0 or large <= 0:
        raise ValueError("small and large must be positive")
    kind = F.when(F.col(size) < small, "small").when(F.col(size) > large, "large")
    out = rows.withColumn("kind", kind).filter("kind is not null").withColumn("preview", F.substring(T.normal_form(F.col(text_col)), 1, 80))
    return out.orderBy(F.desc("kind"), F.when(F.col("kind") == "small", F.col(size)).otherwise(-F.col(size)), id_col)


def incoherent_pages(rows: DataFrame, start: str = "page_start", end: str = "page_end") -> DataFrame:
    return rows.filter(~F.coalesce((F.col(start) >= 1) & (F.col(start) <= F.col(end)), F.lit(False)))


def worst(statuses: Column) -> Column:
    """Most severe of a group's statuses; PASS if there are none."""
    number = reduce(lambda out, k: F.when(statuses == SEVERITY[k], k).otherwise(out), range(len(SEVERITY)), F.lit(0))
    return F.element_at(F.array(*map(F.lit, SEVERITY)), F.coalesce(F.max(number), F.lit(0)) + 1)


def coverage_findings(sound: DataFrame, reference: DataFrame | None, least: float = COVERAGE) -> DataFrame:
    """``kind, n``: documents with holes or little coverage, with another last page than the reference has, without
    chunks, and without a reference.  ``reference`` has ``document_id, page_count``."""
    covered = islands(sound, clamp=False)
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    out = [n(covered.filter((F.col("holes") > 0) | (F.col("coverage_pct") < least)), "low_coverage"), n(covered.limit(1), "any_document")]
    if reference is not None:
        out.append(n(covered.join(reference, "document_id").filter(F.col("last_page") != F.col("page_count")), "page_count_mismatch"))
        out.append(n(reference.join(covered, "document_id", "left_anti"), "missing"))
        out.append(n(covered.join(reference, "document_id", "left_anti"), "unexpected"))
    return reduce(DataFrame.union, out)


def chunk_gate(chunks: DataFrame, reference: DataFrame | None = None, id_pattern: str = r"^\d{4}\.\d{4,5}v\d+$", threshold: float = NEAR, least_coverage: float = COVERAGE) -> DataFrame:
    """``check, status, findings`` of the eight checks; malformed rows are findings, never errors.

    ``reference`` has ``document_id, page_count``.
    """
    n = lambda df: df.agg(F.count("*").cast("long").alias("findings"))
    sound = chunks.filter("chunk_id is not null and document_id is not null and text is not null and page_start is not null and page_end is not null")
    named = F.coalesce(F.trim("document_id"), F.lit("")) != ""
    odd = chunks.filter(~named | ~F.col("document_id").rlike(id_pattern)).select("chunk_id")
    mixed = chunks.filter(named).groupBy("document_id").agg(F.count_distinct(F.coalesce("theme", F.lit(""))).alias("t")).filter("t > 1").select("document_id")
    repeated = duplication(sound, "chunk_id", "document_id", "text", threshold).select((F.col("exact_groups") + F.col("near_pairs")).alias("findings"))
    size = F.coalesce(F.col("tokens_est"), F.lit(0))
    checks = [
        ("required_fields", "FAIL", chunks.agg(F.count_if(reduce(lambda x, y: x | y, [F.col(c).isNull() for c in REQUIRED])).alias("findings"))),
        ("chunk_id_unique", "FAIL", n(repeated_keys(chunks.withColumn("chunk_id", F.coalesce("chunk_id", F.lit("None"))), "chunk_id"))),
        ("empty_text", "FAIL", n(empty_texts(chunks))),
        ("content_duplicates", "WARNING", repeated),
        ("document_id_consistency", "WARNING", n(odd.union(mixed))),
        ("page_coherence", "FAIL", n(incoherent_pages(chunks))),
        ("length_range", "WARNING", chunks.agg(F.count_if((size < SHORTEST) | (size > LONGEST)).alias("findings"))),
    ]
    rows = [df.select(F.lit(name).alias("check"), F.when(F.col("findings") > 0, bad).otherwise("PASS").alias("status"), "findings") for name, bad, df in checks]
    found = coverage_findings(sound, reference, least_coverage).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "missing", F.col("n"))), F.lit(0)).alias("missing"), F.sum(F.when(F.col("kind") == "any_document", F.col("n"))).alias("any"),
        F.coalesce(F.sum(F.when(F.col("kind") != "any_document", F.col("n"))), F.lit(0)).cast("long").alias("findings"),
    )
    state = F.when((F.col("missing") > 0) | (F.col("any") == 0), "FAIL").when(F.col("findings") > 0, "WARNING").otherwise("PASS")
    rows.append(found.select(F.lit("document_coverage").alias("check"), state.alias("status"), "findings"))
    return reduce(DataFrame.union, rows)


def gate_status(checks: DataFrame) -> DataFrame:
    """One row: the worst status of all checks."""
    return checks.agg(worst(F.col("status")).alias("status"))
