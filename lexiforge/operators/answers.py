"""Answers with citations: claims, their gate and repair, and the verification of every citation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.python_text import parse_claims
from ..sources.scratch import stored

#: Adds ``entailment, neutral, contradiction`` to rows, given the names of their premise and hypothesis.
Scorer = Callable[[DataFrame, str, str], DataFrame]

# The answer without a quotation, sizes and beginnings of quotations, the refusal, the limits of an answer, and thresholds.
UNCITED = "Based on the retrieved passages, an answer is synthesized from the provided sources. [1] [2] [3] [4] [5]."
QUOTED_SIZE, NOT_QUOTED = (60, 220), ("1 ", "2 ", "3 ", "Figure", "Table", "Abstract")
REFUSAL = "The provided sources do not contain sufficient information."
LEAST_CLAIMS, MOST_CLAIMS = 1, 5
#: Lexical coverage that grounds a claim, and the first claim, which answers the question.
GROUNDED, GROUNDED_ANSWER = 0.45, 0.15
#: Support below which a citation counts as unsupported, coverage that rescues a paraphrase, and the contradiction that forbids it.
SUPPORT_LOW, RESCUE, CONTRADICTED = 0.40, 0.40, 0.5
#: Citations that a claim keeps.
MOST_CITATIONS = 2


def sources_of(reranked: DataFrame) -> DataFrame:
    """``query_id, source, doc_id, question, passage``: the kept hits, numbered from 1."""
    return reranked.select("query_id", F.col("final_rank").alias("source"), "doc_id", "question", "passage")


def extractive_claims(sources: DataFrame, most: int = MOST_CLAIMS) -> DataFrame:
    """``query_id, claim, text, citations``: the best sentence of each source, and all sources that hold it.

    Best is most words in common with the question, then shortest, then first.
    """
    pieces = sources.select("query_id", "source", T.word_set(F.col("question")).alias("wanted"), F.posexplode(T.sentences(F.col("passage"))).alias("pos", "sentence")).filter(~T.is_noisy_sentence(F.col("sentence")))
    shared = F.size(F.array_intersect(T.word_set(F.col("sentence")), "wanted"))
    best = pieces.groupBy("query_id", "source").agg(F.min(F.struct((-shared).alias("less"), F.length("sentence").alias("size"), "pos", "sentence")).alias("best"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("source"))
    claims = best.withColumn("claim", number).filter(F.col("claim") <= most).select("query_id", "claim", F.col("source").alias("own"), F.col("best.sentence").alias("text"))
    others = sources.select("query_id", F.col("source").alias("other"), T.collapse_space(F.col("passage")).alias("flat"))
    held = claims.join(others, "query_id").filter((F.col("own") == F.col("other")) | F.contains("flat", T.collapse_space(F.col("text"))))
    return held.groupBy("query_id", "claim", "text").agg(F.array_sort(F.collect_set("other")).alias("citations"))


def render(claims: DataFrame, asked: DataFrame | None = None, most: int = MOST_CLAIMS) -> DataFrame:
    """``query_id, n_claims, answer``: sentences with their marks, or the refusal.

    With ``asked`` (rows with ``query_id``) a query without a claim is answered with the refusal.
    """
    text = F.regexp_replace("text", rf"{T.SPACE}+$", "")
    marks = F.array_join(F.transform(F.array_sort("citations"), lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))), "")
    plain = F.concat(F.regexp_replace(F.regexp_replace(text, r"\.+$", ""), rf"{T.SPACE}+$", ""), F.lit(" "), marks, F.lit("."))
    marked = F.when(text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))
    sentence = F.when(F.regexp_count("text", F.lit(r"\[\d+\]")) > 0, marked).otherwise(plain)
    one = claims.select("query_id", F.struct("claim", sentence.alias("sentence")).alias("s"))
    out = one.groupBy("query_id").agg(F.count("*").alias("n_claims"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["sentence"]), " ").alias("answer"))
    if asked is not None:
        out = asked.select("query_id").distinct().join(out, "query_id", "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0).cast("long")))
    return out.withColumn("answer", F.when(F.col("n_claims").between(LEAST_CLAIMS, most), F.col("answer")).otherwise(REFUSAL))


def quotations(sources: DataFrame, most: int = 5) -> DataFrame:
    """``query_id, answer``: the first sentence of each source that can be quoted, with its mark; a plain text if there is none."""
    s = F.col("sentence")
    fit = F.length(s).between(*QUOTED_SIZE) & ~s.contains("arXiv:") & ~s.contains("http") & (T.letters(s) / F.length(s) >= 0.55)
    for head in NOT_QUOTED:
        fit = fit & ~s.startswith(head)
    pieces = sources.filter(F.col("source") <= most).select("query_id", "source", F.posexplode(T.sentences(F.col("passage"))).alias("pos", "sentence")).filter(fit)
    first = pieces.groupBy("query_id", "source").agg(F.min(F.struct("pos", "sentence"))["sentence"].alias("sentence"))
    marked = F.concat("sentence", F.lit(" ["), F.col("source").cast("string"), F.lit("]."))
    told = first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", marked.alias("m")))), lambda x: x["m"]), " ").alias("answer"))
    return sources.select("query_id").distinct().join(told, "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(UNCITED)))


def covered(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``query_id, claim, text, citations, coverage``: the best coverage of a claim's words by a source that it cites."""
    cited = claims.select("query_id", "claim", "text", F.explode("citations").alias("source")).join(sources.select("query_id", "source", "passage"), ["query_id", "source"])
    best = cited.groupBy("query_id", "claim").agg(F.max(T.coverage(T.word_set(F.col("text")), T.word_set(F.col("passage")))).alias("coverage"))
    return claims.join(best, ["query_id", "claim"], "left")


def enough(coverage: Column, claim: Column) -> Column:
    return F.coalesce(coverage >= F.when(claim == 1, GROUNDED_ANSWER).otherwise(GROUNDED), F.lit(False))


def grounded_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with a cited source that covers enough of their words; the first claim needs less."""
    return covered(claims, sources).filter(enough(F.col("coverage"), F.col("claim"))).drop("citations")


def segments(answers: DataFrame) -> DataFrame:
    """``query_id, segment, claim_text, citations``: the sentences of an answer that carry a mark."""
    pieces = answers.select("query_id", F.posexplode(T.sentences(F.col("answer"))).alias("segment", "raw"))
    text = F.regexp_replace(T.strip(F.regexp_replace("raw", r"\[\d+\]", "")), "^[:;,]+|[:;,]+$", "")
    out = pieces.withColumn("citations", T.citation_numbers(F.col("raw"))).filter(F.size("citations") > 0)
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("segment")) - 1
    return out.select("query_id", number.alias("segment"), text.alias("claim_text"), "citations")


def with_best_sentence(rows: DataFrame, passage: str, claim: str) -> DataFrame:
    """Adds ``every`` (sentences of the passage), ``overlap`` and ``at``: the sentence with most of the claim's words,
    the first among equals."""
    out = rows.withColumn("every", T.sentences(F.col(passage)))
    shared = lambda wanted: F.transform("every", lambda s, k: F.struct(F.size(F.array_intersect(T.word_set(s), wanted)).alias("n"), (-k).alias("order")))
    out = out.withColumn("top", F.array_max(T.let(T.word_set(F.col(claim)), shared)))
    return out.select(*rows.columns, "every", F.coalesce("top.n", F.lit(0)).alias("overlap"), (-F.coalesce("top.order", F.lit(0))).alias("at"))


def with_local_premise(rows: DataFrame, passage: str = "passage", claim: str = "claim_text") -> DataFrame:
    """Adds ``premise``: the best sentence with its neighbours; the whole passage where nothing overlaps."""
    out = with_best_sentence(rows, passage, claim)
    low = F.greatest(F.lit(0), F.col("at") - 1)
    window = F.array_join(F.slice("every", low + 1, F.col("at") + 2 - low), " ")
    return out.withColumn("premise", F.when(F.col("overlap") <= 0, F.col(passage)).otherwise(window)).drop("every", "overlap", "at")


def with_gate_premise(rows: DataFrame, passage: str = "passage", claim: str = "claim_text") -> DataFrame:
    """Adds ``premise``: the best sentence alone; the whole passage where nothing overlaps."""
    out = with_best_sentence(rows, passage, claim)
    return out.withColumn("premise", F.when(F.col("overlap") <= 0, F.col(passage)).otherwise(F.get("every", F.col("at")))).drop("every", "overlap", "at")


def stand_in_nli(rows: DataFrame, premise: str, hypothesis: str) -> DataFrame:
    """Stand-in for an entailment model: adds ``entailment, neutral, contradiction`` from word coverage; they sum to 1.

    A negation on one side alone swaps entailment and contradiction.
    """
    negations = F.array(F.lit("not"), F.lit("no"), F.lit("never"))
    out = rows.withColumn("p", T.word_list(F.col(premise))).withColumn("h", T.word_list(F.col(hypothesis)))
    out = out.withColumn("c", T.coverage(F.array_distinct("h"), F.array_distinct("p"))).withColumn("odd", F.arrays_overlap("p", negations) != F.arrays_overlap("h", negations))
    yes, no = F.col("c") * F.col("c"), (1 - F.col("c")) * 0.1
    out = out.withColumn("entailment", F.when(F.col("odd"), no).otherwise(yes)).withColumn("contradiction", F.when(F.col("odd"), yes).otherwise(no))
    return out.withColumn("neutral", 1 - F.col("entailment") - F.col("contradiction")).drop("p", "h", "c", "odd")


def scored_once(rows: DataFrame, scorer: Scorer, premise: str, hypothesis: str) -> DataFrame:
    """``scorer`` over distinct pairs, joined back: a pair that stands in several rows is scored once."""
    pairs = scorer(rows.select(premise, hypothesis).distinct(), premise, hypothesis)
    return rows.join(pairs, [premise, hypothesis])


def with_support(rows: DataFrame) -> DataFrame:
    return rows.withColumn("support", T.support_score(F.col("entailment"), F.col("contradiction")))


def verify(parts: DataFrame, sources: DataFrame, scorer: Scorer = stand_in_nli) -> DataFrame:
    """One row a segment and cited source: scores, support and verdict; marks out of range are ignored."""
    cited = parts.select("query_id", "segment", "claim_text", F.explode("citations").alias("source"))
    pairs = cited.join(sources.select("query_id", "source", "doc_id", "question", "passage"), ["query_id", "source"])
    scored = with_support(scorer(with_local_premise(pairs), "premise", "claim_text"))
    return scored.select("query_id", "segment", "source", "doc_id", "claim_text", "entailment", "neutral", "contradiction", "support", T.verdict(F.col("support")).alias("verdict"), T.citation_id(F.col("question"), F.col("source"), F.col("segment")).alias("citation_id"))


def verification_status(verified: DataFrame) -> DataFrame:
    """One row: PASS if any pair was verified."""
    return verified.agg(F.when(F.count("*") > 0, "PASS").otherwise("FAIL").alias("status"), F.count("*").alias("pairs"))


def self_check(passage: DataFrame, scorer: Scorer = stand_in_nli) -> DataFrame:
    """``kind, support, verdict, expected`` of a true and a false claim about a passage (one row ``passage, true_claim, false_claim``)."""
    rows = passage.select("passage", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("claim_text"), F.lit(e).alias("expected")) for k, c, e in (("true", "true_claim", "Supported"), ("false", "false_claim", "Unsupported"))])))
    return with_support(scorer(rows, "passage", "claim_text")).select("kind", "support", T.verdict(F.col("support")).alias("verdict"), "expected")


def best_supported(claims: DataFrame, sources: DataFrame, scorer: Scorer = stand_in_nli, most: int = MOST_CITATIONS) -> DataFrame:
    """``query_id, claim, better``: up to ``most`` sources that support a claim well enough, best first, ties by number."""
    pairs = claims.select("query_id", "claim", F.col("text").alias("claim_text")).join(sources.filter(F.length("passage") > 0).select("query_id", "source", "passage"), "query_id")
    good = with_support(scorer(with_gate_premise(pairs), "premise", "claim_text")).filter(F.col("support") >= SUPPORT_LOW)
    order = F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("less"), "source")))
    return good.groupBy("query_id", "claim").agg(F.transform(F.slice(order, 1, most), lambda s: s["source"]).alias("better"))


def repaired(claims: DataFrame, sources: DataFrame, scorer: Scorer = stand_in_nli) -> DataFrame:
    """``query_id, claim, text, citations, changed`` of grounded claims, cited as an entailment model sees it.

    A claim whose best supported sources are others than it cites takes those, and counts as grounded; others must be
    covered by a source that they cite.
    """
    out = covered(claims, sources).join(best_supported(claims, sources, scorer), ["query_id", "claim"], "left")
    changed = F.coalesce(F.array_sort("better") != F.array_sort("citations"), F.lit(False))
    out = out.withColumn("changed", changed).filter(F.col("changed") | enough(F.col("coverage"), F.col("claim")))
    return out.select("query_id", "claim", "text", F.when(F.col("changed"), F.col("better")).otherwise(F.col("citations")).alias("citations"), "changed")


def generated_claims(raw: DataFrame, sources: DataFrame, scorer: Scorer = stand_in_nli) -> DataFrame:
    """``query_id, claim, text, citations`` from a model's answers, rows ``query_id, raw``.

    Claims are parsed, cleaned of marks, numbered, grounded and repaired; a query with none left, or with more than an
    answer may have, gets extractive claims.
    """
    n = sources.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    parsed = raw.select("query_id", F.posexplode(parse_claims("raw")).alias("pos", "c")).join(n, "query_id")
    clean = parsed.select("query_id", "pos", T.sanitized_claim(F.col("c.text")).alias("text"), T.claim_citations(F.col("c.text"), F.col("c.citations"), F.col("n"), MOST_CITATIONS).alias("citations"))
    clean = clean.filter((F.col("text") != "") & (F.size("citations") > 0))
    order = Window.partitionBy("query_id").orderBy("pos")
    kept = repaired(clean.withColumn("claim", F.row_number().over(order)), sources, scorer)
    usable = kept.groupBy("query_id").agg(F.count("*").alias("k")).filter(F.col("k").between(LEAST_CLAIMS, MOST_CLAIMS)).select("query_id")
    own = kept.join(usable, "query_id", "left_semi").withColumn("claim", F.row_number().over(Window.partitionBy("query_id").orderBy("claim")))
    rest = extractive_claims(sources.join(usable, "query_id", "left_anti"))
    return own.select("query_id", "claim", "text", F.col("citations").cast("array<int>").alias("citations")).union(rest.select("query_id", "claim", "text", F.col("citations").cast("array<int>")))


def best_support(answers: DataFrame, sources: DataFrame, scorer: Scorer) -> DataFrame:
    """``query_id, best``: the best support that any cited source gives a sentence of the answer, as the gate sees it."""
    cited = segments(answers).select("query_id", "claim_text", F.explode("citations").alias("source"))
    pairs = cited.join(sources.filter(F.length("passage") > 0).select("query_id", "source", "passage"), ["query_id", "source"])
    return with_support(scorer(with_gate_premise(pairs), "premise", "claim_text")).groupBy("query_id").agg(F.max("support").alias("best"))


def gate(claims: DataFrame, answers: DataFrame, sources: DataFrame, scorer: Scorer = stand_in_nli) -> DataFrame:
    """``query_id, decision, answer``: keep, rescue, extract or refuse.

    An answer stays if any citation is supported, or nothing can be verified; else if every claim is covered by some
    source whose best sentence does not contradict it; else extractive claims that share a word with the question
    replace it if any of theirs is supported; else it is refused.
    """
    state = stored(answers.join(best_support(answers, sources, scorer), "query_id", "left").withColumn("held", (F.col("answer") != REFUSAL) & F.coalesce(F.col("best") >= SUPPORT_LOW, F.lit(True))), "gate-state")
    failing = state.filter((F.col("answer") != REFUSAL) & ~F.col("held")).select("query_id")
    wide = claims.join(failing, "query_id", "left_semi").select("query_id", "claim", F.col("text").alias("claim_text")).join(sources.select("query_id", "source", "passage"), "query_id")
    cover = T.coverage(T.word_set(F.col("claim_text")), T.word_set(F.col("passage")))
    top = wide.groupBy("query_id", "claim", "claim_text").agg(F.max_by(F.struct("passage", cover.alias("cover")), F.struct(cover, -F.col("source"))).alias("t")).select("query_id", "claim", "claim_text", "t.passage", "t.cover")
    judged = scorer(with_gate_premise(top), "premise", "claim_text")
    sound = (F.col("cover") >= RESCUE) & (F.col("contradiction") < CONTRADICTED)
    rescued = judged.groupBy("query_id").agg(F.bool_and(sound).alias("rescued")).filter("rescued")
    rest = stored(failing.join(rescued, "query_id", "left_anti"), "gate-rest")
    left = sources.join(rest, "query_id", "left_semi")
    asked = left.select("query_id", T.word_set(F.col("question")).alias("wanted")).distinct()
    own = extractive_claims(left).join(asked, "query_id").filter(F.arrays_overlap(T.word_set(F.col("text")), "wanted")).drop("wanted")
    fallback = stored(render(own), "gate-fallback")
    # what has no pair to verify counts as supported, as above
    poor = best_support(fallback, left, scorer).filter(F.col("best") < SUPPORT_LOW)
    usable = fallback.filter(F.col("answer") != REFUSAL).join(poor, "query_id", "left_anti").select("query_id", F.col("answer").alias("extracted"))
    out = state.join(rescued, "query_id", "left").join(usable, "query_id", "left")
    decision = F.when(F.col("answer") == REFUSAL, "refuse").when(F.col("held"), "keep").when(F.coalesce("rescued", F.lit(False)), "rescue").when(F.col("extracted").isNotNull(), "extract").otherwise("refuse")
    text = F.when(decision.isin("keep", "rescue"), F.col("answer")).when(decision == "extract", F.col("extracted")).otherwise(REFUSAL)
    return out.select("query_id", decision.alias("decision"), text.alias("answer"))


def answers(sources: DataFrame, claims: DataFrame, scorer: Scorer = stand_in_nli) -> DataFrame:
    """``query_id, decision, answer, citations, cited``: claims rendered and gated, for every query that has a source.

    ``citations`` are the marks of the final answer in order; ``cited`` are the distinct sources among them.
    """
    final = gate(claims, render(claims, sources), sources, scorer)
    marks = T.citation_numbers(F.col("answer"))
    return final.select("query_id", "decision", "answer", marks.alias("citations"), F.array_sort(F.array_distinct(marks)).alias("cited"))


def source_references(sources: DataFrame, final: DataFrame) -> DataFrame:
    """``query_id, source, doc_id, extracted``: whether the final answer cites the source."""
    return sources.join(final.select("query_id", "cited"), "query_id").select("query_id", "source", "doc_id", F.array_contains("cited", F.col("source")).alias("extracted"))


def prompts(sources: DataFrame, instructions: str, most: int = 1200) -> DataFrame:
    """``query_id, prompt``: context, question and instructions; sources need ``page_start, page_end`` beside the usual columns."""
    block = T.source_block(F.col("source"), F.col("doc_id").cast("string"), F.col("page_start"), F.col("page_end"), F.col("passage"), most)
    rows = sources.groupBy("query_id", "question").agg(F.array_sort(F.collect_list(F.struct("source", block.alias("block")))).alias("blocks"))
    context = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    return rows.select("query_id", F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion:\n"), F.col("question"), F.lit(f"\n\nInstructions:\n{instructions}")).alias("prompt"))


def generation_summary(final: DataFrame, latency: str | None = None) -> DataFrame:
    """One row over all answers: queries, citations, their mean, and the latencies' mean and largest if a column has them."""
    ms = F.col(latency) if latency else F.lit(None).cast("double")
    return final.agg(F.count("*").alias("queries"), F.sum(F.size("citations")).cast("long").alias("total_citations"), F.round(F.avg(F.size("citations")), 2).alias("mean_citations_per_answer"), F.round(F.avg(ms), 2).alias("mean_generation_ms"), F.max(ms).alias("max_generation_ms"))
