"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of the lexical index.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but "
    "by can did do does doing down during each few for from further had has have having he her here hers him his how i "
    "if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own "
    "same she should so some such than that the their theirs them then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with would you your yours"
).split()

# Title keywords of each theme.
THEME_KEYWORDS = {
    "agents": ["agent", "tool", "plan", "reason", "react", "llm", "multi-agent", "environment", "action", "collaborat"],
    "fine_tuning": ["fine-tun", "finetun", "lora", "peft", "adapter", "instruction tun", "parameter-efficient", "pretrain", "transfer", "gradient"],
    "rag": ["rag", "retriev", "passage", "rerank", "query", "generation", "knowledge", "retriever", "corpus", "index", "fact"],
}

# Fixed value: namespace of chunk ids.
CHUNK_NAMESPACE = "6fae14c2-9e8a-4b0b-9b9b-2b0d0b1a6c01"

# Beginnings of sentences that are captions or matter outside the text.
CAPTIONS = ("figure", "table", "abstract", "fig. ", "tab. ", "algorithm ", "acknowledg", "references")


# Beginnings of lines that a model adds around its answer, and what stands at the end of a text cut short.
NOISE_LINES = ("sources", "[/", "[/inst", "assistant")
CUT_MARK = " [...]"

# Display names of metrics, those shown in percent, and those where less is better.
METRIC_NAMES = {
    "recall_at_3": "Recall@3", "recall_at_5": "Recall@5", "recall_at_10": "Recall@10", "mrr": "MRR", "faithfulness": "Faithfulness",
    "citation_accuracy": "Citation Accuracy", "avg_latency_ms": "Average Latency", "p95_latency_ms": "P95 Latency",
}
COSTS = ("avg_latency_ms", "p95_latency_ms")

#: White space, also beyond ASCII and with the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"


def double_encoded() -> str:
    """Pattern of UTF-8 that was read as Windows-1252: a lead byte's character and those of its continuation bytes, for
    the leads that Western text has, and the replacement character."""
    leads = {0xC2: 1, 0xC3: 1, 0xE2: 2}
    return "|".join(["\ufffd", *(f"{chr(lead)}[\x80-\xbf]{{{n}}}" for lead, n in leads.items())])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also where ``use`` refers to it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Trim all white space, also beyond ASCII."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def normal_form(text: Column) -> Column:
    """Lower case, every run of other than ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def word_list(text: Column) -> Column:
    """ASCII words in order, with repetitions."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def index_tokens(text: Column, stopwords: bool = True) -> Column:
    """Words of the lexical index; repetitions count."""
    found = word_list(text)
    return F.filter(found, lambda w: ~w.isin(STOPWORDS)) if stopwords else found


def word_set(text: Column) -> Column:
    return F.array_distinct(word_list(text))


def token_estimate(text: Column) -> Column:
    """A quarter of the length, half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / F.lit(4.0), 0)).cast("long")


def sentences(text: Column, marks: str = ".!?") -> Column:
    """Trimmed sentences that are not empty; ``marks`` end one if white space follows."""
    return F.filter(F.transform(F.split(text, rf"(?<=[{marks}])(?U)\s+"), strip), lambda s: s != "")


def shingle_set(text: Column, width: int = 8) -> Column:
    """Distinct word shingles; a shorter text is one shingle, an empty one none."""
    def of(words: Column) -> Column:
        whole = F.array(F.array_join(words, " "))
        many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)])))
        return F.when(F.size(words) == 0, words).when(F.size(words) <= width, whole).otherwise(many)

    return let(F.filter(F.split(normal_form(text), " "), lambda w: w != ""), of)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(of: Column, by: Column) -> Column:
    """Share of the words of ``of`` that ``by`` holds; both are sets."""
    return F.when(F.size(of) == 0, 0.0).otherwise(F.size(F.array_intersect(of, by)) / F.size(of))


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def is_noisy_sentence(text: Column, shortest: int = 40, longest: int = 160) -> Column:
    """Sentences that make no claim: references, links, captions, too short, too long, few letters."""
    out = text.contains("arXiv:") | text.contains("http") | ~F.length(text).between(shortest, longest) | (letters(text) / F.greatest(F.length(text), F.lit(1)) < 0.55)
    for head in CAPTIONS:
        out = out | F.lower(text).startswith(head)
    return out


def preview(text: Column, size: int = 160) -> Column:
    """The first characters, line feeds as spaces."""
    return F.translate(F.substring(text, 1, size), "\n", " ")


def file_slug(title: Column, paper_id: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(paper_id, F.lit("_"), F.substring(slug, 1, 60), F.lit(".pdf"))


def base_id(raw: Column) -> Column:
    """Id without its version."""
    return F.regexp_replace(F.lower(F.trim(raw)), r"v\d+$", "")


def version_key(raw: Column) -> Column:
    """Comparable (year-month, number, version); zeros where the id has another form."""
    form = r"^(\d{4})\.(\d{4,5})(?:v(\d+))?$"
    part = lambda k: F.regexp_extract(F.lower(F.trim(raw)), form, k)
    good = F.lower(F.trim(raw)).rlike(form)
    number = lambda k, default: F.when(good, F.when(part(k) == "", default).otherwise(part(k).cast("int"))).otherwise(0)
    return F.struct(number(1, 0).alias("month"), number(2, 0).alias("number"), number(3, 1).alias("version"))


def distinct_names(names: Column) -> Column:
    """Names without repetitions in other case, in order of first appearance: sorted by name, heads of runs, sorted back."""
    clean = F.filter(F.transform(names, collapse_space), lambda n: n != "")
    keyed = F.array_sort(F.transform(clean, lambda n, k: F.struct(F.lower(n).alias("key"), k.alias("place"), n.alias("name"))))
    heads = let(keyed, lambda s: F.filter(s, lambda x, k: (k == 0) | (x["key"] != F.get(s, k - 1)["key"])))
    return F.transform(F.array_sort(F.transform(heads, lambda x: F.struct(x["place"], x["name"]))), lambda x: x["name"])


def keyword_hits(title: Column, theme: str) -> Column:
    return F.filter(F.array(*map(F.lit, THEME_KEYWORDS[theme])), lambda k: F.contains(F.lower(title), k))


def uuid5(name: Column, namespace: str = CHUNK_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def citation_id(query: Column, source_index: Column, segment_index: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", query, source_index, segment_index)), 1, 12)


def pair_key(premise: Column, hypothesis: Column) -> Column:
    return F.md5(F.concat_ws("||", premise, hypothesis))


def citation_numbers(text: Column) -> Column:
    """Numbers of ``[N]`` marks in order, with repetitions."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda n: n.cast("int"))


def valid_citations(text: Column, most: int | Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(citation_numbers(text), lambda n: n.between(1, most))))


def source_lines(text: Column) -> Column:
    """Map from the number of each ``[N] ...`` line behind a line that begins with "sources" to that line's text; the last
    of a number's lines counts."""
    block = F.regexp_extract(text, r"(?isU)(?:^|\n)\s*sources[^\n]*\n(.*)$", 1)
    rows = F.filter(F.transform(F.split(block, "\n"), strip), lambda s: s.rlike(r"(?U)^\[\d+\]\s+.+$"))
    pairs = F.transform(rows, lambda s: F.struct(F.regexp_extract(s, r"^\[(\d+)\]", 1).cast("int").alias("n"), F.regexp_extract(s, r"(?U)^\[\d+\]\s+(.+)$", 1).alias("line")))
    last = F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.size(pairs)), lambda q: q["n"] == p["n"]))
    return F.map_from_entries(last)


def clean_answer(raw: Column) -> Column:
    """A model's answer without the lines that it adds around it."""
    noise = lambda line: F.exists(F.array(*map(F.lit, NOISE_LINES)), lambda head: F.startswith(strip(F.lower(line)), head))
    return strip(F.array_join(F.filter(F.split(raw, "\r\n|\r|\n"), lambda line: ~noise(line)), "\n"))


def source_block(number: Column, document: Column, first: Column, last: Column, text: Column, most: int = 1200) -> Column:
    """One source of a prompt: its number, document, pages and text, cut at ``most`` characters."""
    shown = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT_MARK))).otherwise(text)
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), document, F.lit(" p."), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(":\n"), shown)


def prompt_question(prompt: Column) -> Column:
    """The line behind ``Question:`` of a prompt; "this question" without one."""
    found = strip(F.regexp_extract(prompt, r"(?mU)^Question:\s*(.+)$", 1))
    return F.when(found == "", "this question").otherwise(found)


def prompt_sources(prompt: Column) -> Column:
    """Texts of the numbered sources in a prompt's context, each line trimmed."""
    context = F.regexp_extract(prompt, r"(?s)(?:^|\n)[ \t]*Context:[^\n]*\n(.*?)(?:\n[ \t]*Question:|$)", 1)
    lines = F.array_join(F.transform(F.split(context, "\n"), strip), "\n")
    parts = F.split(lines, r"(?m)^\[\d+\]\s[^\n]*$")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\n|\n$", "")), lambda p: strip(p) != "")


def sanitized_claim(text: Column) -> Column:
    """A claim without citation marks and without the punctuation and the one connector that they leave at its end."""
    plain = strip(F.regexp_replace(F.regexp_replace(text, r"\[\d+\]", ""), r"(?U)\s{2,}", " "))
    return F.regexp_replace(plain, r"(?iU)[\s.,;:]*(?:\b(?:and|or)\b[\s.,;:]*)?$", "")


def claim_citations(text: Column, own: Column, most: Column, kept: int = 2) -> Column:
    """The first ``kept`` of a claim's citations, its own and those marked in its text, that are among ``most`` sources."""
    every = F.array_union(F.coalesce(own, F.array().cast("array<int>")), citation_numbers(text))
    return F.slice(F.array_sort(F.filter(every, lambda n: n.between(1, most))), 1, kept)


def support_score(entailment: Column, contradiction: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), entailment * entailment / (entailment + contradiction + 1e-6)), 4)


def verdict(score: Column) -> Column:
    return F.when(score >= 0.70, "Supported").when(score >= 0.40, "Weak Support").otherwise("Unsupported")


def percent_gain(old: Column, new: Column) -> Column:
    """Relative change in percent to one decimal; null where it is undefined."""
    return F.when(old != 0, F.bround((new - old) / old * 100, 1))


def shown_metric(metric: Column, value: Column) -> Column:
    """A metric for display: milliseconds of costs, percent of the others, N/A for null."""
    return F.when(value.isNull(), "N/A").when(metric.isin(*COSTS, *[METRIC_NAMES[c] for c in COSTS]), F.concat(F.format_number(value, 1), F.lit(" ms"))).otherwise(F.format_string("%.1f%%", value))
