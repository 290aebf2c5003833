"""Operators' cores against brute-force versions, without Spark."""

import random

import numpy as np
import pytest

from lexiforge.llm import decontamination, html_text, langid, minhash, packing, sharding, substrings, toxicity, warc
from lexiforge.llm.textvec import hash_word


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_vocabulary())
    library.encode_special_tokens = True
    own = packing.ByteLevelTokenizer(packing.default_vocabulary())
    rng = random.Random(3)
    texts = ["", "don't we'll 'tis 'sam x's I'm he'd", "  a\n\n b  \n", "'", " 's", "a's", "x''s", "tab\t\tx  y ", "12 3a é ñ日本 語. ... --x <|endoftext|> ok", "end  ", "\n\nx", "éa 'é"]
    texts += ["".join(rng.choice("ab'stre lvd \n\t1é.日") for _ in range(rng.randrange(80))) for _ in range(300)]
    ids, of = own.encode(texts)
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[of[i] : of[i + 1]].tolist() == e.ids, texts[i]


def test_token_ids_with_added_tokens_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_vocabulary())
    own = packing.ByteLevelTokenizer(packing.default_vocabulary(), added=True)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "", "x<|endoftext|", "plain text", "end <|endoftext|>", " 's<|endoftext|>'s  <|endoftext|>  \n\n<|endoftext|>z"]
    for _ in range(2):
        ids, of = own.encode(texts)
        for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
            assert ids[of[i] : of[i + 1]].tolist() == e.ids, texts[i]
        own.clear()
        monkeypatch.setattr(packing, "span_hashes", lambda cps, start, end: (cps[start] % 3).astype(np.uint64) + np.uint64(1))  # equal hashes of different words


def test_sum_of_squares_fills_bins():
    lengths = np.random.default_rng(1).integers(1, 2049, 3000)
    bins, offsets = packing.sum_of_squares(lengths, 2048)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()] and lengths[own].sum() <= 2048
    assert bins.max() + 1 <= lengths.sum() / 2048 * 1.02 + 2


def test_longest_first():
    placed = sharding.longest_first([(7, "a"), (6, "b"), (5, "c"), (4, "d"), (3, "e")], 2)
    loads = [sum(n for n, k in ((7, "a"), (6, "b"), (5, "c"), (4, "d"), (3, "e")) if placed[k] == s) for s in (0, 1)]
    assert sorted(loads) == [11, 14] and placed["a"] != placed["b"]


def removed(docs):
    first, out = {}, {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        out[i] = gone
    return out


@pytest.mark.parametrize("seed", range(8))
def test_substrings_against_all_windows(seed):
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"ab c") for _ in range(rng.randrange(30, 300))) for _ in range(6)]
    docs = []
    for i in range(rng.randrange(2, 22)):
        parts = (rng.choice(base)[rng.randrange(20) : rng.randrange(60, 300)] + rng.choice([b"", b"zz q"]) + (b"ab" * rng.randrange(40) if rng.random() < 0.3 else b"") for _ in range(rng.randrange(5)))
        docs.append((rng.randrange(1000) * 1000 + i, b"".join(parts)))
    got = {i: np.zeros(len(t), bool) for i, t in docs}
    blobs: dict = {}
    for part in (docs[::2], docs[1::2]):
        dealt = [x for x in [substrings.deal(np.array([i for i, _ in part]), np.zeros(len(part), np.int64), [t for _, t in part], 7)] if x]
        for k, blob in substrings.send(dealt, 7):
            blobs.setdefault(k, []).append(blob)
    for some in blobs.values():
        for r in substrings.judge(some):
            got[r["doc_id"]][r["begin"] : r["end"]] = True
    want = removed(docs)
    assert all((got[i] == want[i]).all() for i in want)


def test_blind_tries_sort_and_their_leaves_are_equal_strings():
    rng = random.Random(5)
    texts = [b"same" + bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(300)]
    raw = b"".join(t + b"....." for t in texts) + bytes(64)
    data, places = np.frombuffer(raw, np.uint8), np.arange(300) * 17
    index, bounds = substrings.blind_tries(data, substrings.words_at(data.data), places, np.arange(300), np.arange(300), np.array([0, 300]), 4, 12)
    leaves = [[texts[i] for i in index[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    want = {t: texts.count(t) for t in texts}
    assert all(len(set(x)) == 1 for x in leaves) and {x[0]: len(x) for x in leaves} == {t: n for t, n in want.items() if n > 1}


def test_multikey_quicksort_orders_shared_prefixes():
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab") for _ in range(2)) * 12 for _ in range(200)]
    data = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
    index, bounds = substrings.multikey_quicksort(substrings.words_at(data.data), np.arange(200) * 24, np.arange(200), np.array([0, 200]), 24)
    groups = [[texts[i] for i in index[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert all(len(set(x)) == 1 for x in groups) and sorted(len(x) for x in groups) == sorted(n for t in set(texts) if (n := texts.count(t)) > 1)


def test_without_tries_the_result_is_wrong(monkeypatch):
    head = b"the first thirty bytes of these texts are all the same, "
    docs = [(i, head[:30] + bytes(f"{i:020d}", "ascii") + head[:8]) for i in range(9)]

    def hits():
        dealt = [substrings.deal(np.array([i for i, _ in docs]), np.zeros(len(docs), np.int64), [t for _, t in docs], 1)]
        return sum(len(substrings.judge([blob])) for _, blob in substrings.send(dealt, 1))

    assert hits() == 0
    monkeypatch.setattr(substrings, "blind_tries", lambda data, view, places, owners, index, bounds, *_: (index, bounds))
    assert hits() > 0


def test_equal_hashes_remove_nothing(monkeypatch):
    rng = random.Random(8)
    docs = [(i, bytes(rng.choice(b"abcdefgh ") for _ in range(300))) for i in range(6)]
    monkeypatch.setattr(substrings, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    for repeated in (None, substrings.Repeated()):
        dealt = [substrings.deal(np.array([i]), np.zeros(1, np.int64), [t], 3, 0, repeated) for i, t in docs] + [substrings.deal(np.arange(6), np.zeros(6, np.int64), [t for _, t in docs], 3, 0, repeated)]
        assert not any(len(d.ranges) for d in dealt)


def test_a_task_remembers_what_it_has_sent():
    rng = random.Random(9)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(200))
    repeated = substrings.Repeated()
    first = substrings.deal(np.array([5, 6, 7]), np.zeros(3, np.int64), [passage] * 3, 3, 0, repeated)
    later = substrings.deal(np.array([9, 2]), np.zeros(2, np.int64), [passage] * 2, 3, 0, repeated)
    assert set(first.ranges["doc_id"]) == {6, 7} and set(later.ranges["doc_id"]) == {9} and set(later.doc_ids[later.rows["doc"]]) == {2}


def test_alignment_follows_order():
    a = np.arange(1, 101, dtype=np.uint64)
    assert minhash.alignment(a, a) == 1
    assert minhash.alignment(a, np.concatenate([a[50:], a[:50]])) == 0.0  # the same symbols in another order
    b = np.delete(a, 10)
    assert minhash.alignment(a, b) == pytest.approx(0.99)
    assert minhash.alignment(a[:0], a) == 0.0


def test_maximal_segments_against_definition():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 30)
        scores = np.array([rng.uniform(-1, 1) for _ in range(n)])

        def best(a, b, scores=scores):  # recursively: the best segment, then what is left and right of it
            if a >= b:
                return []
            s, i, j = max((scores[i:j].sum(), i, j) for i in range(a, b) for j in range(i + 1, b + 1))
            return [] if s <= 0 else [*best(a, i), (i, j - 1, round(s, 6)), *best(j, b)]

        assert [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(scores)] == best(0, n)
    assert toxicity.maximal_segments(np.zeros(0)) == toxicity.maximal_segments(np.full(3, -1.0)) == []


def test_extremes_are_found_again():
    rng = np.random.default_rng(4)
    n = rng.integers(20, 900, 20_000)
    largest = (np.log(0.03 * n) - np.log(-np.log(rng.uniform(size=len(n))))) / 1.7
    lam, k = toxicity.fit_extremes(largest, n, 1.0)
    assert lam == pytest.approx(1.7, rel=0.03) and k == pytest.approx(0.03, rel=0.1)


def test_lambda_balances_scores():
    scores, shares = np.array([2.0, -1.0, -0.5]), np.array([0.1, 0.5, 0.4])
    lam = toxicity.solve_lambda(shares, scores)
    assert lam > 0 and shares @ np.exp(lam * scores) == pytest.approx(1)


def test_word_counts_by_hand():
    texts = ["a b a", "b c", "a", "", "b b"]
    toxic, fold = np.array([1, 0, 0, 1, 0]), np.array([0, 0, 1, 1, 1], np.int32)
    name = {hash_word(w): w for w in "abc"}
    got = {(name[int(w)], int(f)): (int(x), int(y), int(z)) for w, f, x, y, z in zip(*toxicity.count_words(texts, toxic, fold), strict=True)}
    assert got == {("a", 0): (1, 0, 0), ("b", 0): (1, 1, 1), ("c", 0): (0, 1, 1), ("a", 1): (0, 1, 1), ("b", 1): (0, 1, 2)}
    assert all(len(c) == 0 for c in toxicity.count_words(["", ""], np.zeros(2, int), np.zeros(2, np.int32)))


def test_log_odds_lean_both_ways_and_shrink():
    got = toxicity.log_odds(np.array([60, 0, 1, 50]), np.array([0, 60, 0, 500]), 100, 1000)
    assert got[0] > 3 and got[2] == 0 and abs(got[3]) < 0.01 and got[1] <= 0


def kneser_ney(texts, order):
    """Interpolated Kneser-Ney over strings: a function from n-gram to probability, by the textbook's recursion."""
    counts = [{} for _ in range(order + 1)]
    for text in texts:
        chars = "\0" * (order - 1) + " " + " ".join(text.lower().split(" "))
        for i in range(order, len(chars)):
            g = chars[i - order + 1 : i + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for g in {g[-(n + 1) :] for g in counts[order]}:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    discount, total, kinds = [0] * (order + 1), [{} for _ in range(order + 1)], [{} for _ in range(order + 1)]
    for n in range(1, order + 1):
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        discount[n] = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        for g, c in counts[n].items():
            total[n][g[:-1]] = total[n].get(g[:-1], 0) + c
            kinds[n][g[:-1]] = kinds[n].get(g[:-1], 0) + 1

    def p(g):
        n = len(g)
        if not n:
            return 1 / 4096
        if g[:-1] not in total[n]:
            return p(g[1:])
        t = total[n][g[:-1]]
        return max(counts[n].get(g, 0) - discount[n], 0) / t + discount[n] * kinds[n][g[:-1]] / t * p(g[1:])

    return p


def test_language_model_against_the_recursion():
    own = {0: ["the cat sat on the mat", "a cat and a rat", "the hat"], 1: ["der hund und die katze", "das ist der hut"]}
    counts = langid.count_ngrams([t for v in own.values() for t in v], np.array([k for k, v in own.items() for _ in v]))
    counts = counts.groupby(["n", "gram", "context", "suffix", "language"], as_index=False)["count"].sum()
    model = langid.build(counts, ["en", "de"])
    for text in ("the cat", "die hat sat", "zq", "a"):
        grams, bounds, _ = langid.ngrams([text])
        got = model.log_probabilities(grams)[1:]
        for lang, texts in own.items():
            p = kneser_ney(texts, langid.ORDER)
            chars = "\0" * (langid.ORDER - 1) + " " + text
            want = [np.log(p(chars[i - langid.ORDER + 1 : i + 1])) for i in range(langid.ORDER, len(chars))]
            assert got[:, lang] == pytest.approx(want, abs=1e-4), (text, lang)


def test_wand_finds_all_above_threshold():
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 90)))) for i in range(150)]
    index = decontamination.BlockMaxIndex(items)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.vocabulary)), rng.randrange(1, len(index.vocabulary))))
        threshold = rng.choice([0.05, 0.2, 0.5])
        scores: dict = {}
        for t in terms:
            for p, w in zip(index.postings[t], index.weights[t], strict=True):
                scores[p] = scores.get(p, 0) + w
        got = [p for p, _ in index.retrieve(terms, threshold)]
        assert len(set(got)) == len(got) and {p for p, v in scores.items() if v >= threshold + 1e-9} <= set(got) and all(scores[p] >= threshold - 1e-9 for p in got)


def test_leak_is_found_anywhere():
    words = [f"w{i}" for i in range(3000)]
    item = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu nu xi."
    index = decontamination.BlockMaxIndex([(7, item), (8, "one two three four five six seven eight nine ten")])
    for at in range(0, 200, 13):
        text = " ".join(words[:at]) + " " + item.upper() + " " + " ".join(words[at : at + 150])
        assert [list(x) for x in index.search([text, "", " ".join(words)])] == [[(7, 1.0)], [], []]


def test_main_text():
    page = '<body><nav><a href=x>a</a></nav><header>Site</header><article><h1>T &amp; U</h1><p><b>First  words<br><p>Short.</p><script>if(a<b){"</p>"}</script><div class="comments"><p>A reader says a lot about this and that</p></div></article><aside>x</aside><footer>f</footer>'
    assert html_text.main_text(page) == "T & U\n\nFirst words\n\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""


LONG = "A sentence of the article that has quite a few words, so that its ratio of text to tags is high. " * 3
#: Pages by hand, and the text that a reader would call the article.
GOLD = [
    ('<article><p>Intro<p class="notice-board-story">Second<p>Third</article>', ["Intro", "Second", "Third"]),
    (f'<body><div class="related-work"><p>{LONG}</div><div class="related-links"><p>Other page</div>', [LONG]),
    (f"<body><article><h1>A</h1><p>{LONG}</article><article><h1>B</h1><p>{LONG}</article>", ["A", LONG, "B", LONG]),
    (f'<body><article><h2>Teaser</h2><p>Read <a href=x>more</a></article><article><h1>T</h1><p>{LONG}<p>{LONG}<p>So.</article>', ["T", LONG, LONG, "So."]),
    (f'<article><p>{LONG}<div class="comments-list"><article class="comment"><p>{LONG}</article></div><p>End</article>', [LONG, "End"]),
    (f'<article><p>{LONG}<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>End</article>', [LONG, "End"]),
    (f"<article><ul><li>first<li>second</ul><p>{LONG}<dl><dt>term<dd>meaning</dl></article>", ["first", "second", LONG, "term", "meaning"]),
    (f"<head><title>t</title><p>{LONG}<table><tr><td>{LONG}<td>{LONG}</table>", [LONG, LONG, LONG]),
    (f"<body><nav><a href=1>Home</a></nav><h1>Title</h1><p>{LONG}<p>{LONG}<p>Short end.</p><footer>Imprint</footer>", ["Title", LONG, LONG, "Short end."]),
    (f"<form><div><p>{LONG}</p><p>{LONG}</p></div></form>", [LONG, LONG]),
    (f"<main><header>Site</header><p>a &lt; b &amp; c&nbsp;d {LONG}</p><aside>x</aside><p hidden>gone</p><p>{LONG}</main>", [f"a < b & c d {LONG}", LONG]),
    (f"<article><p>{LONG}<span class='ad'>Buy</span></p><p>{LONG}<p>one<br>two</article></div></body></html>", [LONG, LONG, "one two"]),
    ("<p>", []),
    ("no markup at all", ["no markup at all"]),
]


@pytest.mark.parametrize("k", range(len(GOLD)))
def test_gold_pages(k):
    assert html_text.main_text(GOLD[k][0]) == "\n\n".join(" ".join(x.split()) for x in GOLD[k][1])


def test_long_headers_are_read():
    url = "http://a.b/" + "x" * (2 << 20)
    data = warc.gzip_member(warc.page_record(1, url, b"one", None)) + warc.gzip_member(warc.page_record(2, "http://c.d/", b"two", None))
    got = list(warc.salvage(data))
    assert [(g[0], g[3].get("warc-target-uri")) for g in got] == [("record", url), ("record", "http://c.d/")]


def test_salvage_goes_on_after_damage():
    records = [warc.page_record(i, f"http://x/{i}", (f"page {i} " * 200).encode(), None) for i in range(6)]
    members = [warc.gzip_member(r) for r in records]
    broken = bytearray(b"".join(members))
    at = len(members[0]) + len(members[1]) + 40
    broken[at : at + 20] = b"\0" * 20  # inside the third member
    found = list(warc.salvage(bytes(broken[:-30])))  # and the last is cut off
    ids = [f["warc-record-id"] for kind, _, _, f, *_ in found if kind == "record"]
    assert ids == ["<urn:page:0>", "<urn:page:1>", "<urn:page:3>", "<urn:page:4>"]
    gaps = [(o, n) for kind, o, n, *_ in found if kind == "gap"]
    assert gaps[0] == (len(members[0]) + len(members[1]), len(members[2])) and sum(n for kind, _, n, *_ in found) == len(broken) - 30
    plain = bytearray(b"".join(records))
    plain[len(records[0]) + 3] = 0
    assert [f["warc-record-id"] for kind, _, _, f, *_ in warc.salvage(bytes(plain)) if kind == "record"] == [f"<urn:page:{i}>" for i in (0, 2, 3, 4, 5)]
