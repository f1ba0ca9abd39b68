import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.helpers import WORDS, documents, odd_texts, prose
from trialspark.llm import bpe, decontaminate, extract, language, maxent, quality, urls
from trialspark.llm.common import crc_mod

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- byte-level BPE


def test_bpe_matches_the_library_and_decodes(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})
    rnd = random.Random(8)
    texts = odd_texts() + ["a" * 3000, "  \n\n  x", "it's <|endoftext|> we'll", "\x85\u3000 \u2028x", "١٢٣ Ⅷ ² ½"]
    texts += ["".join(rnd.choice(" \n\taab's1.é語\u00a0😀") for _ in range(rnd.randrange(80))) for _ in range(200)]
    docs = documents(spark, texts).select("doc_id", "text", bpe.encode("text", RANKS, public_tokenizers.PATTERN).alias("packed"))
    rows = docs.select("*", bpe.decode("packed", RANKS).alias("back")).collect()
    for r in rows:
        assert np.frombuffer(r["packed"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert bytes(r["back"]).decode() == (r["text"] or "")
    assert docs.limit(0).count() == 0


def test_bpe_small_word_tables_change_nothing(monkeypatch):
    texts = [prose(k, 60) for k in range(40)]
    merges = bpe.merges_of(RANKS)
    whole = bpe.Encoder(merges, public_tokenizers.PATTERN).encode(texts)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    small = bpe.Encoder(merges, public_tokenizers.PATTERN)
    assert [x for t in texts for x in small.encode([t])] == whole


def test_bpe_of_one_huge_word():
    """A word of 200,000 letters takes seconds; long words merge as the library merges them."""
    merges = bpe.merges_of(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdeinorst") for _ in range(n)) for n in (500, 513, 3000)] + ["a" * 2000, "ab" * 900, "é" * 700]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(merges, public_tokenizers.PATTERN).encode(texts)] == [library.encode_ordinary(t) for t in texts]
    huge = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(200_000))
    began = time.process_time()
    ids = bpe.Encoder(merges, public_tokenizers.PATTERN).encode([huge])[0]
    assert time.process_time() - began < 20
    assert bpe.text_bytes(ids, merges).decode() == huge


# --- main text


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="content"><article><h1>Head &amp; line</h1><p>First <b>bold</b>\n  text.<br>Second&nbsp;line.</p><!-- no -->
<div class="ad">Buy this now.</div><p>Third &lt;block&gt; &#8212; end.</p><aside><p>Related things to read.</p></aside>
<form><p>Sign up to our letter</p><input value="x"></form></article>
<section id="comments"><p>Nice article, thanks for it.</p></section></div><div class="sidebar"><p>Most read today.</p></div>
<footer>&copy; all rights</footer></body></html>"""


def test_main_text_without_the_rest():
    assert extract.main_text(PAGE) == "Head & line\nFirst bold text.\nSecond line.\nThird <block> — end."


def test_quotes_open_values_only_after_an_equals_sign():
    page = "<p title=don't>Hello there, this is the first one.</p><p>It's fine, and this is the second one.</p>"
    assert extract.main_text(page) == "Hello there, this is the first one.\nIt's fine, and this is the second one."
    page = "<p don't data-a=it's class=\"a>b\" id='c>d'>One full sentence stands here.</p><p x='y'z>Another full sentence stands here.</p>"
    assert extract.main_text(page) == "One full sentence stands here.\nAnother full sentence stands here."


def test_the_cut_overrules_the_sign_of_a_cost():
    """A short line between paragraphs of one container stays, a lone phrase among links goes."""
    page = ("<div><p>" + prose(1, 40).capitalize() + ".</p><p>Selah</p><p>" + prose(2, 40).capitalize() + ".</p></div>")
    blocks = extract.blocks_of(page)
    assert [extract.content_cost(b) > 0 for b in blocks] == [True, False, True]
    assert extract.main_text(page).split("\n")[1] == "Selah"
    link = "<li><a href='/x'>Some other page of this site</a></li>"
    page = f"<ul>{link * 3}<li>More of it here</li>{link * 3}</ul>"
    blocks = extract.blocks_of(page)
    assert extract.content_cost(blocks[3]) > 0 and extract.main_text(page) == ""


def test_cut_of_long_pages_takes_no_square():
    rnd = random.Random(2)
    n = 10_000
    costs = [rnd.uniform(-3, 3) for _ in range(n)]
    edges = [(i, i + 1, extract.NEXT_TO) for i in range(n - 1)] + [(i, i + 2, extract.SAME_PARENT) for i in range(0, n - 2, 2)]
    began = time.process_time()
    keep = extract.min_cut(costs, edges)
    assert time.process_time() - began < 3
    assert 0 < sum(keep) < n


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<div class='x", "</p></div>", "<script>var a=1;", "<!-- open", "<nav><a>x</a></nav>"])
def test_pages_without_main_text(page):
    assert extract.main_text(page) == ""


RAW_ELEMENTS = [
    "<script>for(i=0;i<n;i++){f(i)}</script>",
    """<script>if(a<b)s="<div class='x";t='</p>'</SCRIPT >""",
    "<style>a<b{}</style><title>i<n</title><textarea>x<y '</textarea>",
    "<svg><style>a<b{}</style><path d='M0'/></svg>",
    "<script><!-- document.write('<script src=x></script>') --></script>",
    "<script><!-- if(i<n)f() </script>",
]


@pytest.mark.parametrize("raw", RAW_ELEMENTS)
def test_raw_elements_end_at_their_closing_tag(raw):
    rest = "<article><p>The text of the article.</p></article><script>g()</script><footer>x</footer>"
    assert extract.main_text(f"<html><head>{raw}</head><body>{raw}{rest}") == "The text of the article."


SENTENCES = "<p>" + "A long sentence of the page that reads as main text, with many words in it. " * 3 + "</p>"
WRAPPED = [
    f"<div class='layout with-sidebar'><article>{SENTENCES}</article></div>",
    f"<main class='fixed-header'>{SENTENCES}</main>",
    f"<article class='post category-search comments-open'>{SENTENCES}</article>",
    f"<div id='side'><div class='page search'>{SENTENCES}</div></div>",
]
COMMENT = "<article class='comment-body'><p>Nice article, I have to say, and thanks for it to all of you who wrote it.</p></article>"
AROUND = [
    "",
    f"<div id='comments' class='comments-area'><ol class='comment-list'><li>{COMMENT}</li></ol></div>",
    "<div class='related-posts'><a href='/x'>More to read</a></div><div class='sidebar'><p>Most read today.</p></div>",
]


@pytest.mark.parametrize("after", AROUND)
@pytest.mark.parametrize("wrapped", WRAPPED)
def test_names_of_wrappers_lose_no_article(wrapped, after):
    page = f"<div class='header'><a href='/'>Home</a></div>{wrapped}{after}<div class='site-footer'>All rights reserved.</div>"
    assert extract.main_text(page) == SENTENCES[3:-4].strip()


def test_truncated_and_very_long_pages():
    assert extract.main_text("<article><p>One block here.</p><p>Cut &am") == "One block here.\nCut &am"
    long = "<body><article>" + "".join(f"<p>Paragraph number {k} of the text.</p>" for k in range(5000)) + "</article><footer>x</footer>"
    assert extract.main_text(long).count("\n") == 4999


def test_min_cut_is_the_cheapest_labelling():
    rnd = random.Random(2)
    for _ in range(60):
        n = rnd.randrange(1, 9)
        costs = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rnd.uniform(0, 2)) for i in range(n) for j in range(i) if rnd.random() < 0.4]
        price = lambda keep: sum(max(0, c) if not k else max(0, -c) for c, k in zip(costs, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023,E731
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert math.isclose(price(extract.min_cut(costs, edges)), best, abs_tol=1e-9)


def test_extract_column(spark):
    df = spark.createDataFrame([(1, PAGE), (1, PAGE), (2, None)], "page_id long, html string")
    assert [r[0] for r in df.select(extract.extract("html")).collect()] == [extract.main_text(PAGE)] * 2 + [""]


# --- quality


def junk(seed, n):
    return " ".join(w + random.Random(seed).choice(["###", "$$$"]) for w in prose(seed, n).split())


def test_quality_learns_from_positives_and_unlabelled(spark):
    texts = [junk(k, 60) if k % 6 == 0 else prose(k, 60) for k in range(400)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 6 != 0)) for k in range(400) if k % 5 < 2] + [(None, 1), (3, None), (9999, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, quality.training_fold(F.col("doc_id")))
    scored = docs.select("doc_id", quality.score(docs["text"], model).alias("p")).collect()
    assert all((r["p"] >= quality.THRESHOLD) == (r["doc_id"] % 6 != 0) for r in scored)
    odd = documents(spark, odd_texts()).select(quality.score("text", model).alias("p")).collect()
    assert all(0 <= r["p"] <= 1 for r in odd)
    assert not quality.fit(docs, labels.limit(0), quality.training_fold(F.col("doc_id"))).trained


def test_quality_risk_stays_non_negative():
    rng = np.random.default_rng(5)
    p, u = rng.normal(1, 1, (200, 3)), np.vstack([rng.normal(1, 1, (300, 3)), rng.normal(-3, 1, (100, 3))])
    model = quality.fit_features(p, u, 0.75)
    assert model.risk >= 0 and model.score(u[:300]).mean() > 0.9 and model.score(u[300:]).mean() < 0.2


# --- URLs


def expected_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.pattern), len(r.host), r.verdict, r.pattern), default=None)


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def test_url_rules_match_brute_force(spark):
    from trialspark.llm.queries import RULES

    rnd = random.Random(6)
    pick = rnd.choice
    found = [None, "", "nothing", "://", "http://", "https://EXAMPLE.org", "http://ÉX.ORG/a?b#c", "x://a.com?/fr/", "http://a\n.com/de/", "http://xorg/"]
    found += [f"http{pick(['', 's'])}://{pick(['', 'www.', 'a.b.'])}{pick(['example', 'Shop', 'ads-x'])}.{pick(['org', 'com', 'net'])}/{pick(['fr', 'de', 'es', 'en'])}/{rnd.randrange(200)}{pick(['', '?a=1&b=2', '#x'])}" for _ in range(300)]
    pages = spark.createDataFrame([(k // 2, u, "x") for k, u in enumerate(found)], "page_id long, url string, suffix string")
    rows = urls.judge(pages, RULES).collect()
    assert len(rows) == len(found)
    for r in rows:
        assert (r["host"], r["path"]) == parts(r["url"])
        rule = expected_rule(r["host"], r["path"], RULES)
        assert r["rule"] == (rule.pattern if rule else None)
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == rule.verdict)


def test_url_trees_learn_from_rules(spark):
    rules = [urls.Rule("block", "bad.com/"), urls.Rule("allow", "good.com/")]
    found = [f"http://bad.com/{'9' * (12 + k % 5)}?a=1&b={k}&c=2" for k in range(80)] + [f"http://good.com/story/{'abc' * (k % 4)}" for k in range(80)]
    new = ["http://other.com/" + "8" * 14 + "?x=1&y=2&z=3", "http://other.com/story/abcabc"]
    pages = spark.createDataFrame(list(enumerate(found + new)), "page_id long, url string")
    got = {r["url"]: r["verdict"] for r in urls.judge(pages, rules).collect()}
    assert [got[u] for u in new] == ["block", "allow"]
    one = urls.judge(pages, [urls.Rule("block", "bad.com/")])
    assert {r["verdict"] for r in one.collect()} == {"block"}
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), rules).count() == 0


# --- decontamination


def test_leaks_with_edits_are_found_and_others_not(spark):
    rnd = random.Random(11)
    items = [prose(900 + k, 25) for k in range(12)] + ["tiny", "", None]
    texts, want = odd_texts(), set()
    for k in range(60):
        item = k % 12
        chars = list(items[item])
        edits = rnd.randrange(0, int(len(chars) * decontaminate.EDITS) + 1) if k % 2 else 0
        for _ in range(edits):
            at = rnd.randrange(len(chars))
            chars[at] = rnd.choice(["", "q", chars[at] + "z"])
        want.add((len(texts), item))
        texts.append(f"{prose(k, 40)}\n{''.join(chars).upper()}  {prose(70 + k, 40)}")
    texts += [f"{prose(k, 30)} {items[k % 12][: len(items[k % 12]) // 2]} {prose(k + 50, 30)}" for k in range(12)]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)) + [(3, items[3]), (None, items[4])], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(texts) - len(want)
    several = set()
    for index in decontaminate.blocks(bench, block_chars=500):
        found = docs.select("doc_id", F.explode(decontaminate.leaks("text", index, spark)).alias("x"))
        several |= {(r[0], r[1]) for r in found.select("doc_id", "x.item_id").collect()}
    assert several == want
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_replaced_words_regions_and_short_items_leak(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    long = prose(41, 40)
    short = "seven paper lamps"
    bench = spark.createDataFrame([(1, item), (2, long), (3, short), (4, "garden"), (5, "a b")], "item_id long, text string")
    around = [prose(50 + k, 30) for k in range(20)]
    cut = lambda t, lo, hi: t[int(len(t) * lo) : int(len(t) * hi)]
    cases = {
        f"{around[0]} {item.replace('fox', 'panther')} {around[1]}": {1},  # a replaced word
        f"{around[2]} {item.replace('brown', 'red')} {around[3]}": {1},
        f"{around[4]} {cut(long, 0, 5 / 6)}": {2},  # five sixths, at the start, at the end, in the middle
        f"{cut(long, 1 / 6, 1)} {around[5]}": {2},
        f"{around[6]} {cut(long, 0.1, 0.9)} {around[7]}": {2},
        f"{around[8]} {cut(long, 0, 0.6)} {around[9]}": set(),  # under the stated region
        f"{around[10]} {cut(long, 0, 0.4)} {prose(60, 9)} {cut(long, 0.6, 1)}": set(),
        f"{around[11]} ({short.upper()}). {around[12]}": {3},
        f"{around[13]} {short}s {around[14]}": set(),  # not at a word bound
        f"garden {around[15]} a b": set(),  # one word, or too short to identify anything
        f"{around[16]} {item} {around[17]} {short}, {long}": {1, 2, 3},
        f"{around[18]} {' '.join(reversed(item.split()))}": set(),
    }
    docs = documents(spark, list(cases))
    rows = decontaminate.contaminated(docs, bench).collect()
    assert [{r["item_id"] for r in rows if r["doc_id"] == k} for k in range(len(cases))] == list(cases.values())
    whole = {r["item_id"]: r["covered"] for r in rows if r["doc_id"] == 10}
    assert whole == {1: len(item), 2: len(long), 3: len(short)}
    assert decontaminate.clean(docs, bench).count() == sum(not v for v in cases.values())


def test_every_region_of_the_stated_length_is_found():
    """Against the definition: any three quarters of an item, wherever they start, with or without edits."""
    rnd = random.Random(6)
    for k in range(120):
        item = prose(2000 + k, rnd.randrange(12, 60))
        text = decontaminate.normal(item)
        size = -(-3 * len(text) // 4) + 2
        start = rnd.randrange(0, len(text) - size + 1)
        part = bytearray(text[start : start + size])
        for _ in range(rnd.randrange(0, max(1, int(size * 0.7 * decontaminate.EDITS * 0.5)))):
            part[rnd.randrange(len(part))] = ord("#")
        found = decontaminate.Index([(7, item)]).find([f"{prose(k, 20)} {part.decode('utf-8', 'replace')} {prose(k + 1, 20)}"])[0]
        assert [f[0] for f in found] == [7]


def edit_distance(item, part):
    row = [0] * (len(part) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(part, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_banded_alignment_matches_the_full_one():
    rnd = random.Random(3)
    for _ in range(150):
        item = [rnd.randrange(97, 100) for _ in range(rnd.randrange(1, 15))]
        part = [rnd.randrange(97, 100) for _ in range(rnd.randrange(0, 20))]
        full = edit_distance(item, part)
        got = decontaminate.distance(np.array(item, np.uint8), np.array(part, np.uint8), 40, 40)
        assert got == full


# --- language model


def test_maxent_counts_match_brute_force_and_beat_the_base(spark):
    rnd = random.Random(1)
    texts = odd_texts() + [" ".join(f"{a} {a}partner" for a in rnd.choices(WORDS, k=60)) for _ in range(120)]
    docs = documents(spark, texts)
    rows = maxent.score(docs, crc_mod(F.col("doc_id"), 7) != 2, group_bytes=20_000).collect()
    tokens = {k: (t or "").encode().lower().split() + [b""] for k, t in enumerate(texts)}
    held = {k for k in tokens if zlib.crc32(str(k).encode()) % 7 == 2}
    count = {}
    for k, t in tokens.items():
        for w in t if k not in held else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["training"], r["n_tokens"], r["train_tokens"]) == (r["doc_id"] not in held, len(t), n)
        assert r["n_known"] == sum(w in count for w in t)
        assert math.isclose(r["base_score"], sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r["score"] < 0
    late = [r for r in rows if not r["training"] and r["doc_id"] >= len(odd_texts())]
    assert sum(r["score"] for r in late) > sum(r["base_score"] for r in late)


def _small_corpus(n=60):
    words = maxent.Words()
    tokens, sizes = maxent.tokenise([prose(k, 50) for k in range(n)], words)
    return tokens, sizes, words.hashes()


def _cells(tokens, hashes):
    c, s = maxent.kinds(hashes)
    return np.bincount(c[tokens] * maxent.SLOTS + s[tokens], minlength=maxent.CLASSES * maxent.SLOTS).reshape(maxent.CLASSES, maxent.SLOTS)


def test_maxent_is_a_distribution_over_slots():
    """The probabilities of all words that could come next add up to 1, whatever the context."""
    tokens, sizes, hashes = _small_corpus()
    model = maxent.Model.of(maxent.learn(tokens, sizes, hashes, 1024), _cells(tokens, hashes))
    context = maxent.contexts(tokens, sizes, hashes)[:, :50]
    total = np.zeros(50)
    logits = lambda table, rows, first: sum(table[f][rows[f]] for f in range(maxent.CONTEXTS)) + first
    for c in range(maxent.CLASSES):
        by_class, by_slot = maxent.rows_of(context, np.full(50, c), 1024)
        slots = np.exp(maxent.log_softmax(logits(model.slots, by_slot, np.log(model.share.slots[c])))).sum(axis=1)
        total += np.exp(maxent.log_softmax(logits(model.classes, by_class, np.log(model.share.classes))))[:, c] * slots
    assert np.allclose(total, 1, atol=1e-5)


def test_maxent_rows_and_gradient_equal_plain_sums():
    tokens, sizes, hashes = _small_corpus(12)
    learnt = maxent.learn(tokens, sizes, hashes, 1024)
    context = maxent.contexts(tokens, sizes, hashes)
    c, s = maxent.kinds(hashes)
    own = c[tokens]
    want = np.zeros((maxent.CONTEXTS, 1024, maxent.SLOTS), int)
    by_class, by_slot = maxent.rows_of(context, own, 1024)
    for f in range(maxent.CONTEXTS):
        for r, x in zip(by_slot[f], s[tokens]):
            want[f, r, x] += 1
    assert (learnt.counts[1] == want).all()
    # the slope is the derivative of the log-likelihood of the picked tokens, each left out of its rows
    share = maxent.Shares.of(_cells(tokens, hashes))

    def likelihood(weights):
        total = 0.0
        for t in range(0, len(tokens), maxent.UPDATE_EVERY):
            z = np.log(share.classes)
            for f in range(maxent.CONTEXTS):
                row = learnt.counts[0][f][by_class[f][t]].astype(float).copy()
                row[own[t]] -= 1
                k = f * maxent.STEPS + int(maxent.step_of(np.array([row.sum()]))[0])
                z = z + weights[k] * (np.log((row + maxent.KAPPA * share.classes) / (row.sum() + maxent.KAPPA)) - np.log(share.classes))
            total += z[own[t]] - np.log(np.exp(z).sum())
        return total

    start = maxent.start_weights()
    for k in np.flatnonzero(learnt.slope[0])[:6]:
        step = np.zeros_like(start)
        step[k] = 1e-5
        assert learnt.slope[0][k] == pytest.approx((likelihood(start + step) - likelihood(start - step)) / 2e-5, rel=1e-4, abs=1e-6)


def test_maxent_learns_without_copies_of_its_tables():
    """What learning holds at a time: both tables of counts, the values of one softmax, and little else."""
    import tracemalloc

    tokens, sizes, hashes = _small_corpus(400)
    rows = 1 << 16
    table = maxent.CONTEXTS * rows * maxent.CLASSES * 4
    tracemalloc.start()
    maxent.learn(tokens, sizes, hashes, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * table  # 8.9 tables with the values of both, made whole in double precision


def test_maxent_counts_survive_packing():
    x = np.array([[0, 1, 254], [255, 256, 10**12]])
    assert (maxent.unpack(maxent.pack(x)).reshape(2, 3) == x).all()


def test_maxent_learns_from_context(spark):
    """Held-out text of the given table: at least 0.15 a token above the base, in one group and in many."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for size in (maxent.GROUP_BYTES, 400_000):
        held = maxent.score(docs, crc_mod(F.col("doc_id"), 7) != 2, group_bytes=size).where("not training")
        model, base, n = held.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        assert (model - base) / n > 0.15


def test_maxent_of_repeated_rows_falls_into_many_groups(spark, tmp_path):
    """A third of the rows alike, ids null: the groups stay even, and every row is scored the same."""
    text = prose(3, 400)
    documents(spark, [text] * 200 + [prose(k, 400) for k in range(400)], [None] * 200 + list(range(400))).write.parquet(f"{tmp_path}/d")
    rows = maxent.score(spark.read.parquet(f"{tmp_path}/d"), F.lit(True), group_bytes=100_000).collect()
    same = [r for r in rows if r["doc_id"] is None]
    assert len(rows) == 600 and len(same) == 200 and len({round(r["score"], 6) for r in same}) == 1


def test_maxent_without_training_rows_and_empty_table(spark):
    docs = documents(spark, ["a b", None], [None, 1])
    rows = maxent.score(docs, F.lit(False)).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}
    assert maxent.score(docs.limit(0), F.lit(True)).count() == 0


def test_maxent_mixes_many_groups(spark, monkeypatch):
    monkeypatch.setattr(maxent, "FAN_IN", 2)
    docs = documents(spark, [prose(k, 50) for k in range(30)])
    assert maxent.score(docs, F.lit(True), group_bytes=1000).count() == 30


# --- language


LANGS = {"aa": "the and of with from into over", "bb": "der die und mit von auf über", "cc": "les des une avec pour dans être"}


def test_language_by_cross_parsing(spark):
    rnd = random.Random(7)
    rows = [(k, " ".join(rnd.choices(LANGS[lang].split(), k=40)), lang) for k in range(90) for lang in [sorted(LANGS)[k % 3]]]
    odd = [(100, None, "aa"), (101, "", None), (102, "123 ... 😀", "bb"), (103, "der und mit " * 20_000, None), (104, "語語語", None), (104, "x", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language.Model(language.sample(docs.where(crc_mod(F.col("doc_id"), 4) != 2)))
    got = {r["doc_id"]: (r["p"]["lang"], r["p"]["score"]) for r in docs.select("doc_id", language.predict("text", model, spark).alias("p")).collect()}
    assert all(got[k][0] == lang for k, _, lang in rows)
    assert [got[k] for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103][0] == "bb" and all(0 <= s <= 1 for _, s in got.values())
    none = language.Model({})
    assert docs.select(language.predict("text", none, spark).alias("p")).where("p.lang = 'und'").count() == len(rows + odd)


def test_a_language_of_few_letters_wins_no_text(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choices(LANGS[lang].split(), k=40)), lang) for k in range(60) for lang in [sorted(LANGS)[k % 3]]]
    docs = spark.createDataFrame(rows + [(k, "ok", "xx") for k in range(60, 80)], "doc_id long, text string, lang string")
    model = language.Model(language.sample(docs))
    assert model.langs == ["aa", "bb", "cc", "xx"]
    assert model.predict([t for _, t, _ in rows] + ["ok"])[0] == [lang for *_, lang in rows] + ["xx"]


def test_samples_have_one_size_whatever_the_length_of_texts(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefghij", k=4))
    short = [(" 1 " + word(), "short") for _ in range(4000)] + [("same", "short")] * 2000
    long = [(" ".join(word() for _ in range(6000)), "long")]
    few = [(x, "few") for x in ("one", "two", "two", "a b", "12", "")]
    docs = spark.createDataFrame(short + long + few, "text string, lang string")
    got = language.sample(docs, size=4000)
    for lang in ("short", "long"):
        assert 4000 <= len(" ".join(got[lang])) + 1 <= 4000 + language.SLICE_CHARS + 1
    assert sorted(got["few"]) == ["a b", "one", "two"]


def plain_phrases(sample, text):
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample and text[at : at + 1] in sample:
            size += 1
        at += size
        count += 1
    return count


@pytest.mark.parametrize("width", [1, 3, 8, 64])
def test_automaton_phrases_match_brute_force(width):
    """Whole texts, laid out in rows: a phrase that crosses rows counts once."""
    rnd = random.Random(9)
    sample = bytes(rnd.choice(b"abc") for _ in range(60)) + b"abababababababababab"
    automaton = language.Automaton(sample)
    texts = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 50))) for _ in range(40)] + [b"ab" * 30, b"d" * 20, sample]
    rows = [-(-len(t) // width) for t in texts]
    laid = np.frombuffer(b"".join(t.ljust(n * width, b"\0") for t, n in zip(texts, rows)), np.uint8).reshape(-1, width)
    owner = np.repeat(np.arange(len(texts)), rows)
    count = automaton.phrases(np.ascontiguousarray(laid.T), np.diff(owner, prepend=-1) == 0)
    padding = [n * width - len(t) for t, n in zip(texts, rows)]
    assert (np.bincount(owner, count) - padding).tolist() == [plain_phrases(sample, t) for t in texts]


def test_of_very_many_languages_the_commonest_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    rows = [(k, text, lang) for lang, text in LANGS.items() for k in range(20)] + [(k, "stray words", f"x{k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(language.sample(docs)) == sorted(LANGS)


def test_maxent_update_takes_every_training_token(monkeypatch):
    """The update's sums add up over the tokens whatever their place, in one batch or in many."""
    tokens, sizes, hashes = _small_corpus(12)
    whole = maxent.learn(tokens, sizes, hashes, 1024)
    assert maxent.UPDATE_EVERY == 1
    curve_of_all = np.trace(whole.curve[0])
    monkeypatch.setattr(maxent, "BATCH", 7)
    monkeypatch.setattr(maxent, "HELD", 50)
    parts = maxent.learn(tokens, sizes, hashes, 1024)
    assert np.allclose(whole.slope, parts.slope, atol=1e-3) and np.isclose(np.trace(parts.curve[0]), curve_of_all, rtol=1e-4)


def _plain_log_probability(tokens, sizes, hashes, model):
    """By each token's three rows and a softmax of double precision."""
    c, s = maxent.kinds(hashes)
    context = maxent.contexts(tokens, sizes, hashes)
    by_class, by_slot = maxent.rows_of(context, c[tokens], model.classes.shape[1])
    out = np.zeros(len(tokens))
    for table, row, share, right in (
        (model.classes, by_class, np.broadcast_to(model.share.classes, (len(tokens), maxent.CLASSES)), c[tokens]),
        (model.slots, by_slot, model.share.slots[c[tokens]], s[tokens]),
    ):
        z = np.log(share) + sum(table[f][row[f]].astype(float) for f in range(maxent.CONTEXTS))
        out += maxent.log_softmax(z)[np.arange(len(tokens)), right]
    return out


def test_maxent_scores_equal_a_plain_softmax_however_far_apart_the_values():
    tokens, sizes, hashes = _small_corpus(30)
    model = maxent.Model.of(maxent.learn(tokens, sizes, hashes, 1024), _cells(tokens, hashes))
    for factor in (1, 40, 400):  # at 400 products of exponentials leave single precision
        wide = maxent.Model(model.classes * np.float32(factor), model.slots * np.float32(factor), model.share)
        found = maxent.log_probability(tokens, sizes, hashes, np.zeros(len(hashes)), wide, batch=64)
        assert np.allclose(found, _plain_log_probability(tokens, sizes, hashes, wide), rtol=1e-5, atol=1e-4)


def test_maxent_curve_equals_plain_sums_and_spreads_no_number_over_its_outcomes(monkeypatch):
    """The curvature in full, and the exponentials of learning and scoring: one for each cell of the rows, none for each token and outcome."""
    tokens, sizes, hashes = _small_corpus(60)
    rows = 1024
    learnt = maxent.learn(tokens, sizes, hashes, rows)
    c, s = maxent.kinds(hashes)
    own, slot = c[tokens], s[tokens]
    share = maxent.Shares.of(_cells(tokens, hashes))
    found = maxent.rows_of(maxent.contexts(tokens, sizes, hashes), own, rows)
    start, many = maxent.start_weights(), maxent.CONTEXTS * maxent.STEPS
    for k, (right, shares) in enumerate(((own, np.broadcast_to(share.classes, (len(own), maxent.CLASSES))), (slot, share.slots[own]))):
        slope, curve = np.zeros(many), np.zeros((many, many))
        for t in range(len(tokens)):
            z, x = np.log(shares[t]), np.zeros((many, maxent.CLASSES))
            for f in range(maxent.CONTEXTS):
                row = learnt.counts[k][f][found[k][f][t]].astype(float).copy()
                row[right[t]] -= 1
                at = f * maxent.STEPS + int(maxent.step_of(np.array([row.sum()]))[0])
                x[at] = np.log1p(row / (maxent.KAPPA * shares[t]))
            z = z + start @ x
            p = np.exp(z - z.max())
            p /= p.sum()
            slope += x[:, right[t]] - x @ p
            curve += (x * p) @ x.T - np.outer(x @ p, x @ p)
        assert np.allclose(learnt.slope[k], slope, rtol=1e-4, atol=1e-2)
        assert np.allclose(learnt.curve[k], curve, rtol=1e-4, atol=1e-2)
    taken = []
    real = np.exp
    monkeypatch.setattr(np, "exp", lambda x, *args, **kwargs: (taken.append(np.size(x)), real(x, *args, **kwargs))[1])
    many_tokens, many_sizes = np.tile(tokens, 20), np.tile(sizes, 20)
    learnt = maxent.learn(many_tokens, many_sizes, hashes, rows)
    cells = 2 * maxent.CONTEXTS * rows * maxent.CLASSES
    assert sum(taken) <= cells + 2 * len(many_tokens)  # it was 32 a token
    taken.clear()
    model = maxent.Model.of(learnt, _cells(many_tokens, hashes))
    maxent.log_probability(many_tokens, many_sizes, hashes, np.zeros(len(hashes)), model)
    assert sum(taken) <= cells + 2 * len(many_tokens)
