"""The corpus operators against brute force, planted cases and odd tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contractlake.llm import bpe, graph, html_text, jaccard, langid, line_dedup, line_quality, mixing, permutation_index, quality_mil, toxicity
from contractlake.llm import queries as Q
from contractlake.llm.common import fold

from ..oracle import same

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, o long, th long, d string, kh long, id string, body string"


def docs(spark, rows, **extra):
    """Rows of (doc_id, text, source); the other columns clash with names that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "d", 3, "id", "b") for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n \t", None), (4, "one", "b"), (4, "one", "b"), (None, "null id here", "b"), (5, "x" * 70_000, "a"), (6, " ".join(f"w{i % 700}" for i in range(30_000)), "c")]


def prose(seed, n):
    r = random.Random(seed)
    return [f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.choice('bcdfglmnprst')}{r.randrange(5000)}" for _ in range(n)]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    same(spark, SF, Q.queries()[name], Q.oracle_sql()[name])


# --- n-gram Jaccard join


def brute_classes(rows, n=5, t=0.8):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    by_text = defaultdict(list)
    for k, text in rows:
        by_text[text or ""].append(k)
    texts = list(by_text)
    sets = []
    for x in texts:
        w = words.findall(x)
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, x in enumerate(texts):
        groups[find(i)] += by_text[x]
    degree = Counter(x for pair in links for x in pair)
    out = {}
    for i, x in enumerate(texts):
        for k in by_text[x]:
            out[k] = (min(groups[find(i)]), degree[i], len(by_text[x]) - 1) if sets[i] else (k, 0, 0)
    return out


def near_rows():
    rows, k = [], 0
    for seed in range(12):
        base = prose(seed, 150)
        for j in range(9):
            w = list(base)
            for p in range(j % 4):
                w[20 + 30 * p] = f"edit{seed}-{j}-{p}"
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k + i, " ".join(prose(100 + i, 60))) for i in range(40)] + [(k + 50, "a b c"), (k + 51, "a b c"), (k + 52, "a b"), (k + 53, None), (k + 54, "")]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_is_exact(spark, block):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard.jaccard_classes(df, block=block).collect()}
    assert got == brute_classes(rows)


def test_jaccard_odd_rows(spark):
    got = jaccard.jaccard_classes(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r["n_links"] for r in got} == {0}
    assert sorted(r["n_copies"] for r in got) == [0] * 6 + [1, 1]
    kept = jaccard.keep_first(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(ODD) - 1
    assert jaccard.jaccard_classes(docs(spark, [])).count() == 0 and jaccard.keep_first(docs(spark, [])).count() == 0


def test_prefixes_are_shortened_where_company_is_least():
    """Every text meets the recall over all trees, whatever crowds around it."""
    rng = np.random.default_rng(1)
    trees, texts = 32, 300
    owner = np.sort(rng.choice(texts * trees, 5000, replace=False)) // trees
    company = np.sort(rng.geometric(rng.choice([0.5, 0.05, 0.001], size=(5000, 1)), size=(5000, 5)), axis=1)[:, ::-1]
    ends = jaccard.shorten(company, owner, texts, trees, 0.8, 0.9999)
    for k in range(texts):
        own = ends[owner == k]
        miss = np.prod(1 - 0.8**own.astype(float)) * (1 - 0.8**4) ** (trees - len(own))
        assert miss <= 1e-4 * (1 + 1e-9) and ((own >= 4) & (own <= 8)).all()
    one = np.array([[900] * 5] * 16 + [[3, 2, 1, 1, 0]] * 16)
    crowded = jaccard.shorten(one, np.zeros(32, dtype=int), 1, 32, 0.8, 0.9999)
    assert crowded[:16].min() > crowded[16:].max()  # short where it is sparse
    assert (jaccard.shorten(one, np.zeros(32, dtype=int), 1, 32, 0.8, 0.999999) == 4).all()


def test_forest_finds_pairs_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.83: none of 300 is lost."""
    rows = []
    for k in range(300):
        w = prose(9000 + k, 104)
        v = list(w)
        v[30] = v[70] = "other"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_classes(df).collect()
    assert len({r["class_id"] for r in got}) == 300 and {r["n_links"] for r in got} == {1}


@pytest.mark.parametrize(("threshold", "changed"), [(0.7, (20, 60, 100)), (0.5, (15, 30, 45, 60, 75, 90))])
def test_low_thresholds_hold_their_recall(spark, threshold, changed):
    """Pairs a little above the threshold: none of 100 is lost."""
    rows = []
    for k in range(100):
        w = prose(20_000 + k, 104)
        v = [("other" if i in changed else x) for i, x in enumerate(w)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_classes(df, threshold=threshold).collect()
    assert len({r["class_id"] for r in got}) == 100 and {r["n_links"] for r in got} == {1}


def test_too_few_trees_are_refused(spark):
    df = docs(spark, ODD)
    for t in (0.7, 0.5, 0.8, 1.0):
        n = jaccard.least_trees(t, 0.99999)
        assert (1 - min(t, 1 - 1e-9) ** 4) ** n <= 1e-5 * (1 + 1e-9) and (n == 1 or (1 - t**4) ** (n - 1) > 1e-5)
    with pytest.raises(ValueError, match="42 trees"):
        jaccard.jaccard_classes(df, threshold=0.7, trees=32)
    with pytest.raises(ValueError, match="threshold"):
        jaccard.jaccard_classes(df, threshold=0)


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p>";</script></head><body>
<header><p>Site header words</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<aside class="sidebar"><p>Side words</p></aside><!-- <p>no</p> --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p>First&nbsp;para <b>bold</b> &lt;tag&gt;<br>more<p>Second
 para</p><div class="ad"><p>Buy more</p></div><p>Be.</p><form><input><p>Mail</p></form><ul><li>item</li></ul></article>
<section id="comments"><article class="comment"><p>A long reader comment that goes on and on and on and on and on</p></article></section><footer>&copy; x</footer></body>"""


def test_article():
    assert html_text.main_text(PAGE) == "Head & line\nFirst para bold <tag> more\nSecond para\nBe.\nitem"
    assert html_text.main_text("") == "" and html_text.main_text("<p>") == "" and html_text.main_text(PAGE[:900]).startswith("Head & line")


def test_unclosed_parts_end():
    page = '<body><div class="ad"><p>Buy<article><p class="ad">Buy<p>One.<p class="share">Share<div>Two.</div><ul><li class="ad">x<li>Three.</ul></article>'
    assert html_text.main_text(page) == "One.\nTwo.\nThree."


def test_without_an_article_the_surge_decides():
    body = "".join(f"<p>{' '.join(prose(i, 30))}</p>" for i in range(4))
    page = f"<body><div class='menu'><a>a</a></div><p>short</p><nav>x</nav>{body}<nav>y</nav><p>tail</p></body>"
    assert html_text.main_text(page).split("\n") == [" ".join(prose(i, 30)) for i in range(4)]


def test_an_advert_in_the_text_cuts_nothing_off():
    long = [" ".join(prose(i, 30)) for i in range(3)]
    inner = f"<h1>Head</h1><div class='ad'>Buy</div><p>{long[0]}</p><p>{long[1]}</p><div class='ad'>Buy</div><p>{long[2]}</p><aside>Buy</aside><p>The end.</p>"
    want = "\n".join(["Head", *long, "The end."])
    menu = "<div><ul><li><a href='/'>Home</a></li><li><a href='/b'>Other things to read</a></li></ul></div>"
    assert html_text.main_text(f"<body>{menu}<div>{inner}</div><div>Imprint</div></body>") == want
    assert html_text.main_text(f"<body><nav>x</nav>{inner}<footer>y</footer><p>tail</p></body>") == want
    assert html_text.main_text(f"<body>{menu}<div><h1>Head</h1><p>Short.</p></div></body>") == "Head\nShort."


def test_a_block_of_links_in_the_text_stays():
    long = [" ".join(prose(i, 30)) for i in range(2)]
    page = f"<body><div><ul><li><a>Home</a></li></ul><h1><a href='/x'>Head</a></h1><p>{long[0]}</p><ul><li><a href='/s'>A source of this</a></li></ul><p>{long[1]}</p><ul><li><a>Next</a></li></ul></div></body>"
    assert html_text.main_text(page) == "\n".join(["Head", long[0], "A source of this", long[1]])


def test_parts_of_a_main_part_are_one():
    assert html_text.main_text("<body><p>no</p><main><h1>Head</h1><p>Intro.</p><article><p>One, the longest part.</p></article><div class='ad'>Buy</div><article><p>Two.</p></article></main><p>no</p></body>") == "Head\nIntro.\nOne, the longest part.\nTwo."
    assert html_text.main_text("<body><div><p>no</p></div><div><h1>Head</h1><article><p>One, the longest part.</p></article><article><p>Two.</p></article></div></body>") == "Head\nOne, the longest part.\nTwo."


def test_a_class_that_tells_what_a_part_has_skips_nothing():
    for name in ("no-sidebar", "has-ads wide", "page with-header", "layout-without-nav", "no_ads"):
        assert html_text.main_text(f"<body><div class='{name}'><p>Text.</p></div></body>") == "Text."
        assert html_text.main_text(f"<body><article><div class='{name}'><p>Text.</p></div></article></body>") == "Text."
    assert html_text.main_text("<body><article><p>Text.</p><div class='ad has-image'>Buy</div></article></body>") == "Text."


def test_a_class_word_never_erases_a_page():
    long = [" ".join(prose(i, 30)) for i in range(3)]
    inner = "".join(f"<p>{x}</p>" for x in long)
    for wrap in ("div id='layout-with-sidebar'", "div class='content widget-area-right'", "article class='post share-enabled'", "section class='search-results-explained'", "div class='comments-on'"):
        for rest in ("", "<nav>x</nav><footer>y</footer>", "<p>Copyright and so on and on and on</p>" if "comments" not in wrap else ""):
            page = f"<body><{wrap}><div class='ad'>Buy</div>{inner}</{wrap.split()[0]}>{rest}</body>"
            assert html_text.main_text(page).startswith("\n".join(long)), page
    comments = f"<section class='comments'>{inner * 4}</section>"
    assert html_text.main_text(f"<body><div><p>{long[0]}</p></div>{comments}</body>") == long[0]
    assert html_text.main_text(f"<body><article><h1>Head</h1><p>Short.</p></article>{comments}<div class='sidebar'><p>Side</p></div></body>") == "Head\nShort."


def test_cut_tags_and_open_quotes_are_no_text():
    for end in ("<", "</", "</p", '<div class="fo', "<img src='a b", "<!-- x", "<a href=x"):
        assert html_text.main_text(f"<body><article><p>One.</p>{end}") == "One."
    assert html_text.main_text('<body><article><p>One. <a href="x>two</a></p></article>') == "One. two"
    assert html_text.main_text("<article><p>So <math><mi>x</mi> = 1</math> holds, 2 < 3 &lt; 4.</p></article>") == "So x = 1 holds, 2 < 3 < 4."


def brute_between(weights, window, surge):
    """Every pair of surge and dive point, by its definition."""
    total = lambda k: sum(weights[k : k + window])
    out = set()
    for a in range(len(weights)):
        if weights[a] and total(a) >= surge:
            for b in range(a, len(weights)):
                if total(b) == 0:
                    break
                out |= {b} if weights[b] else set()
    return out


def test_surges_and_dives():
    r = random.Random(5)
    for _ in range(3000):
        weights = [r.choice([0, 0, 0, r.randrange(60), r.randrange(200)]) for _ in range(r.randrange(30))]
        window, surge = r.randrange(1, 5), r.randrange(1, 200)
        assert html_text.between(weights, window, surge) == brute_between(weights, window, surge)


def test_what_surges_decides():
    """Article elements that hold no text to speak of don't win over the text beside them."""
    long = " ".join(prose(1, 60))
    cards = "".join(f"<article><h2><a href='/{i}'>Read {i}</a></h2></article>" for i in range(6))
    assert html_text.main_text(f"<body><div>{cards}</div><div><p>{long}</p></div></body>") == long
    assert html_text.main_text(f"<body><div><p>{long}</p></div><article><p>{long} x</p></article></body>") == f"{long} x"


P = [f"Paragraph number {i} tells at some length of what the {w} did in that year, and why." for i, w in enumerate("first second third fourth".split())]


def para(*which):
    return "".join(f"<p>{P[i]}</p>" for i in which)


@pytest.mark.parametrize(
    "page",
    [
        f"<article><h1>Head</h1>{para(0)}<section id='social-sciences'>{para(1, 2, 3)}</section></article>",
        f"<article><h1>Head</h1>{para(0)}<section class='ad-hoc-networks'>{para(1, 2)}</section>{para(3)}</article>",
        f"<article><h1>Head</h1>{para(0)}<div class='banner'>{para(1, 2, 3)}</div></article>",
        f"<main><h1>Head</h1>{para(0)}<div class='banner'>{para(1, 2, 3)}</div></main>",
        f"<article><h1>Head</h1><div class='skip-intro'>{para(0)}</div><div class='side-effects'>{para(1)}</div><section id='related-work'>{para(2, 3)}</section></article>",
        f"<body><form id='aspnetForm'><div class='menu'>Home</div><div><h1>Head</h1>{para(0, 1, 2, 3)}</div></form></body>",
        f"<body><form id='aspnetForm'><article><h1>Head</h1>{para(0, 1, 2, 3)}</article></form></body>",
        f"<article><h1>Head</h1>{para(0, 1)}<div class='widget-area'>Other posts</div><div class='cookie-notice-bar'>We use cookies</div><div id='ad_slot_3'>Buy this now</div>{para(2, 3)}<form>Your name <input></form></article>",
    ],
)
def test_names_of_subjects_are_no_furniture(page):
    assert html_text.main_text(page) == "\n".join(["Head", *P])


def test_the_threshold_decides_in_articles_too():
    short = "".join(f"<p>Note {i}.</p>" for i in range(6))
    page = f"<article><h1>Head</h1>{short}{para(0, 1, 2, 3)}{short}</article>"
    whole = html_text.main_text(page)
    assert whole.split("\n")[0] == "Head" and len(whole.split("\n")) == 17
    late = html_text.main_text(page, surge_chars=400)
    assert late.split("\n")[0] == "Note 5." and len(late) < len(whole)
    wide = html_text.main_text(page, surge_chars=400, window=6)
    assert len(late) < len(wide)


def planted(r):
    """A page around an article whose text is known."""
    word = lambda n: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(99)) for _ in range(n))
    furniture = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/x>{word(2)}</a></li>' for _ in range(6))}</ul></nav>", lambda: f"<div class='{r.choice(['sidebar left', 'site-footer', 'cookie-notice', 'ad', 'adslot-2', 'newsletter-box', 'social-share'])}'>{word(8)}</div>", lambda: f"<aside><p>{word(9)}</p></aside>",
        lambda: f"<script>var x = '<p>{word(4)}</p>';</script><style>p {{}}</style>", lambda: f"<form action=/s>{word(3)}<input><button>Go</button></form>", lambda: f"<!-- {word(3)} -->",
    ]
    some = lambda n: "".join(r.choice(furniture)() for _ in range(r.randrange(n)))
    text, body = [word(4)], []
    for _ in range(r.randrange(2, 9)):
        kind = r.choice(["p", "p", "p", "h2", "li", "quote"])
        t = word(3 if kind == "h2" else r.randrange(6, 40))
        text.append(f"{t} & so" if kind == "p" else t)
        body.append({"p": f"<p>{t} &amp; <b>so</b></p>", "h2": f"<h2>{t}</h2>", "li": f"<ul><li>{t}</li></ul>", "quote": f"<blockquote>{t}</blockquote>"}[kind] + (some(2) if r.random() < 0.3 else ""))
    comments = f"<div class='comments'><p>{word(30)}</p></div>" if r.random() < 0.5 else ""
    frame = r.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='content'><article>{}</article></div>"])
    return f"<html><head><title>{word(3)}</title></head><body><header>{word(5)}</header>{some(3)}{frame.format(f'<h1>{text[0]}</h1>' + ''.join(body))}{comments}{some(3)}<footer>{word(6)}</footer></body></html>", "\n".join(text)


def test_planted_articles(spark):
    r = random.Random(12)
    pages = [planted(r) for _ in range(400)]
    rows = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in html_text.extract(rows).collect()}
    wrong = [(pages[i], got[i]) for i in got if got[i] != pages[i][1]]
    assert not wrong, wrong[0]


def test_a_very_long_page():
    paragraphs = [" ".join(prose(i, 20)) for i in range(5000)]
    page = "<body><nav>x</nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body>"
    assert html_text.main_text(page) == "\n".join(paragraphs)


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (3, None, "")], "page_id long, url string, html string")
    got = html_text.extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert [len(r["text"]) for r in got] == [r["n_chars"] for r in got] and [bool(r["text"]) for r in got] == [True, False, False, False]
    assert html_text.extract(pages.limit(0)).count() == 0


# --- BPE


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in ids]


HARD = ["It's <|endoftext|>. we'll 're''s café é İstanbul ΑΣ ΑΣ. 12345 ½ x\u0085y a　b \x1cz\x1d", "漢字かな交じり文" * 300, "a" * 5000 + "'s" * 300, "🙂‍↔️ " * 50 + "word." * 200, "ﬁ ffi Ⅷ   tab\tnl\nend.,*!", "<|startoftext|>|<|endoftext|", "ſtraße ǅ ǆ " * 40]


@pytest.mark.parametrize(("long_chars", "leaf_chars"), [(50_000, 12_000), (40, 17), (10, 3)])
def test_bpe_is_exact(spark, long_chars, leaf_chars):
    rows = [(i, t, "s") for i, t in enumerate(HARD + [t for _, t, _ in ODD[:7]])]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_texts(docs(spark, rows), Q.tokenizer_path(), long_chars=long_chars, leaf_chars=leaf_chars, run=16).collect()}
    want = encoded([t for _, t, _ in rows])
    assert [i for i in range(len(rows)) if got[i] != want[i]] == []


def test_bpe_ids_and_empty_table(spark):
    r = bpe.encode_texts(docs(spark, [(1, "Hello world", "s")]), Q.tokenizer_path(), keep=["doc_id", "body"], out="ids").first()
    assert r["decoded"].replace("</w>", "").split() == ["hello", "world"] and len(r["ids"]) == 2 and r["body"] == "b"
    assert bpe.encode_texts(docs(spark, []), Q.tokenizer_path()).count() == 0


# --- quality rules


def test_quality_rules_odd_rows(spark):
    common = "this boilerplate line stands everywhere and says nothing " * 3
    rows = ODD + [(100 + i, f"{common}\n" + " ".join(prose(i, 15)), "h") for i in range(25)] + [(200 + i, f"{common}\n" + " ".join(prose(i, 90)), "h") for i in range(3)] + [(300 + i, "\n".join(" ".join(prose(77, 60)) for _ in range(1)), "k") for i in range(30)] + [(400 + i, " ".join(prose(78, 60)), "k") for i in range(20)]
    got = {r["doc_id"]: r for r in line_quality.quality(docs(spark, rows)).collect()}
    assert not any(got[100 + i]["kept"] for i in range(25))  # depleted, though not failed
    assert not any(got[100 + i]["base_failed"] for i in range(3) if got[100 + i]["n_words"] >= 50)
    assert all(got[200 + i]["kept"] for i in range(3))
    assert not any(got[300 + i]["kept"] for i in range(30))  # copies are documents: their lines stand in 30 of them
    assert all(got[400 + i]["kept"] for i in range(20))  # 20 are within the limit
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and got[6]["n_repeat_words"] == 30_000
    assert line_quality.quality(docs(spark, [])).count() == 0


# --- mixing


def test_targets_share_the_excess_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got["b"] == 200 and got[None] == 0 and got["c"] == pytest.approx(1665 - 220)


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, " ".join(prose(i, r.randrange(1, 60))), r.choice(["a", "b", "c", None])) for i in range(800)] + ODD
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["taken"] == x["copies"] * x["size"] and 0 <= x["copies"] <= 2
    by = defaultdict(lambda: [0, 0.0])
    for x, row in zip(sorted(got, key=lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["size"])), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, len((x[1] or "").split()))), strict=True):
        by[row[2]][0] += x["taken"]
        by[row[2]][1] = x["target"]
    largest = max(x["size"] for x in got if x["size"] < 1000)
    for source, (taken, target) in by.items():
        if source != "c":
            assert abs(taken - target) <= largest
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mixed(df).count() == sum(x["copies"] for x in got) and mixing.mixed(df).columns == df.columns
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [(1, None, "a")])).first()["taken"] == 0


def test_longer_documents_are_likelier_and_the_odds_change_the_order(spark):
    rows = [(i, " ".join(prose(i, 20 if i % 2 else 900)), "a") for i in range(1200)] + [(5000 + i, " ".join(prose(i, 300)), "b") for i in range(2500)]
    got = mixing.mix(docs(spark, rows)).collect()
    a = [r for r in got if r["source_size"] == got[0]["source_size"]] if got[0]["doc_id"] < 5000 else [r for r in got if r["doc_id"] < 5000]
    b = [r for r in got if r["doc_id"] >= 5000]
    side = b if any(r["target"] / r["source_size"] % 1 for r in b) else a
    assert abs(sum(r["taken"] for r in side) - side[0]["target"]) <= 450
    rows = [(i, " ".join(["w"] * (20 if i % 2 else 900)), s) for i in range(2000) for s in ("a", "b", "c")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("target % source_size > 0")
    mean = {r["size"]: r["m"] for r in got.groupBy("size").agg(F.avg(F.col("copies") - F.floor(F.col("target") / F.col("source_size"))).alias("m")).collect()}
    assert mean[900] > mean[20] + 0.03 > 0.03  # the short ones' share is lower, though the draw is alike
    by = got.groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert by and all(abs(r["t"] - r["target"]) <= 450 for r in by)


def test_repeated_rows_do_not_miss_the_target(spark):
    """A third of a source is one document, given again and again: some of the rows go in, some don't."""
    one = " ".join(prose(1, 40))
    rows = [(7, one, "a")] * 400 + [(100 + i, " ".join(prose(i, 30)), "a") for i in range(40)] + [(1000 + i, " ".join(prose(i, 50)), "b") for i in range(900)] + [(None, one, "c")] * 90
    df = docs(spark, rows).repartition(7)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for s in {r["source_size"] for r in got}:
        own = [r for r in got if r["source_size"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 25
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.coalesce(2)).collect()))
    assert mixing.mixed(df).count() == sum(r["copies"] for r in got)


# --- language


def test_language(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = Q.op6_language(spark, SF).join(df, "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
    model = langid.fit(df, F.lit(True))
    odd = langid.predict(docs(spark, [*ODD, (7, "123 !?", "a")]), model).collect()
    assert sorted(r["lang_pred"] for r in odd)[-4:] == ["und"] * 4 and all(0 <= r["score"] <= 1 for r in odd)
    most = [r["lang"] for r in df.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2).collect()]
    assert sorted(langid.fit(df, F.lit(True), languages=2)) == sorted(most)
    none = langid.fit(docs(spark, []), F.lit(True))
    assert none == {} and langid.predict(docs(spark, ODD), none).filter("lang_pred != 'und'").count() == 0
    assert langid.predict(docs(spark, []), model).count() == 0


# --- line dedup


def lines_of(*seeds, n=20):
    return [" ".join(prose(s, n)) for s in seeds]


def test_repeated_runs_go(spark):
    run = lines_of(1, 2, 3)
    rows = [(1, "\n".join(lines_of(10) + run + lines_of(11)), "a"), (2, "\n".join(lines_of(12) + run + lines_of(13)), "a"), (3, "\n".join([*lines_of(14), "", *run, *run]), "a"), (4, "\n".join(lines_of(1) + lines_of(15)), "a"), (5, rows_text := "\n".join(lines_of(*range(30, 40))), "a"), (6, rows_text, "a")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated(docs(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[5] == rows_text and got[6] == ""
    assert got[2] == "\n".join(lines_of(12) + lines_of(13))
    assert got[3] == "\n".join([*lines_of(14), ""])
    assert got[4] == rows[3][1]  # one line of 20 words is no run of 50


def test_a_single_long_line_is_a_run(spark):
    long = " ".join(prose(5, 51))
    rows = [(i, "\n".join([*lines_of(100 + i), long, *lines_of(200 + i)]), "a") for i in range(6)]
    got = {r["doc_id"]: r["n_deleted_lines"] for r in line_dedup.remove_repeated(docs(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


def test_runs_of_any_cut_are_found(spark):
    """Guarantee: a run of 50 words that repeats is found, however its lines are cut."""
    r = random.Random(8)
    rows, k = [], 0
    for case in range(30):
        words, run = prose(1000 + case, 60), []
        while words:
            n = r.randrange(1, 25)
            run.append(" ".join(words[:n]))
            words = words[n:]
        for _ in range(2):
            rows.append((k, "\n".join([*lines_of(5000 + k), *run, *lines_of(7000 + k)]), "a"))
            k += 1
    got = {x["doc_id"]: x["n_deleted_words"] for x in line_dedup.remove_repeated(docs(spark, rows)).collect()}
    assert got == {i: 60 * (i % 2) for i in range(k)}


def brute_repeated(rows, min_words=50):
    """Deleted words by id: all pairs of lines, compared onwards while they agree."""
    texts = {k: [line for line in t.split("\n") if line.split()] for k, t in sorted(rows)}
    at = [(k, i) for k, x in texts.items() for i in range(len(x))]
    gone = defaultdict(set)
    for n, (k, i) in enumerate(at):
        for k2, i2 in at[:n]:
            e = 0
            while i + e < len(texts[k]) and i2 + e < len(texts[k2]) and texts[k][i + e] == texts[k2][i2 + e]:
                e += 1
            if sum(len(x.split()) for x in texts[k][i : i + e]) >= min_words:
                gone[k].update(range(i, i + e))
    return {k: sum(len(x[i].split()) for i in gone[k]) for k, x in texts.items()}


def test_a_shorter_first_occurrence_hides_no_run(spark):
    """A fragment of 45 words comes first, in another text or in the same one; the run of 55 words that holds it comes later."""
    rows, k = [], 0
    for case in range(12):
        part, more = lines_of(case * 1000, case * 1000 + 1, case * 1000 + 2, n=15), lines_of(case * 1000 + 3, n=10)
        run = [*part, *more] if case % 2 else [*more, *part]
        once = [*lines_of(50_000 + k), *part, *lines_of(60_000 + k)]
        for n in range(4):
            own = [*lines_of(70_000 + 10 * k), *run, *lines_of(80_000 + 10 * k)]
            first = once if n == 0 and case < 6 else [*once[1:], *own] if case >= 6 and n < 2 else own
            rows.append((k, "\n".join(first)))
            k += 1
    r = random.Random(4)
    pool = lines_of(*range(900, 912), n=1) + [" ".join(prose(i, r.randrange(3, 60))) for i in range(912, 924)]
    for _ in range(40):
        rows.append((k, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 30)))))
        k += 1
    got = {x["doc_id"]: x["n_deleted_words"] for x in line_dedup.remove_repeated(docs(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == brute_repeated(rows)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert dict(con.execute(f"SELECT doc_id, n_deleted_words FROM ({line_dedup.SQL})").fetchall()) == got


def test_line_dedup_odd_rows(spark):
    df = docs(spark, ODD)
    got = line_dedup.remove_repeated(df)
    assert got.columns == [*df.columns, "n_lines", "n_deleted_lines", "n_deleted_words"]
    assert Counter(r["text"] for r in got.collect()) == Counter(t for _, t, _ in ODD)
    assert line_dedup.remove_repeated(docs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="fingerprint"):
        line_dedup.remove_repeated(df, min_words=30)


def test_keys_of_any_type_with_an_order(spark):
    body = "\n".join(lines_of(1, 2, 3))
    rows = [("b", body, "x"), ("a9", body, "x"), ("a10", body + "\nmore", "x"), (None, body, "x"), ("c", "alone", "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = {r["doc_id"]: r["n_deleted_lines"] for r in line_dedup.remove_repeated(df).collect()}
    assert got == {"a10": 0, "a9": 3, "b": 3, None: 3, "c": 0}


def test_a_line_repeated_through_a_text_goes_once(spark):
    line = " ".join(prose(9, 60))
    r = line_dedup.remove_repeated(docs(spark, [(1, "\n".join([line] * 400), "a")])).first()
    assert r["text"] == line and r["n_deleted_lines"] == 399


# --- nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    x[100:140] = x[100]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [None] * 24), (5200, [1.0, 2.0]), (50, [float(v) for v in x[50]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(dict)
    for r in permutation_index.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    norms = np.sqrt((x * x).sum(1))
    hit = 0
    for q in range(0, 3000, 50):
        score = (x * x[q]).sum(1) / (norms * norms[q])
        best = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and all(abs(score[i] - s) < 1e-12 for i, s in got[q].values())
        hit += len(set(best) & {i for i, _ in got[q].values()})
    assert len(got) == 60 and hit / 300 >= 0.9
    assert [got[100][k][0] for k in range(1, 6)] == [101, 102, 103, 104, 105]
    clash = df.select("vec_id", "embedding", *(F.lit(1).alias(c) for c in ("id", "v", "prefix", "pivot", "block", "asks", "copy", "score")))
    again = permutation_index.nearest(clash, F.col("vec_id") % 50 == 0)
    assert again.columns == ["query_id", "rank", "vec_id", "score"] and again.count() == 300
    few = permutation_index.nearest(df.filter("vec_id in (0, 1, 2, 5000)"), F.col("vec_id") == 0)
    assert few.count() == 2 and permutation_index.nearest(df.limit(0), F.lit(True)).count() == 0


# --- classifiers


@pytest.mark.parametrize(("name", "label"), [("op9_quality", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.1"
    got = Q.queries()[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter(f"{label} is not null")
    r = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("right"), F.count_if((F.col("predicted") == 1) & (F.col(label) == 0)).alias("false"), F.count("*").alias("n")).first()
    assert r["right"] >= 0.97 and r["false"] <= 0.01 * r["n"]


@pytest.mark.parametrize("kind", [toxicity, quality_mil])
def test_classifiers_odd_rows(spark, kind):
    label = "toxic" if kind is toxicity else "quality"
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, 1, 0), (6, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0), labels.filter(f"{label} = 1")):
        model = kind.fit(docs(spark, ODD), l, F.lit(True))
        got = kind.score(docs(spark, ODD), model, keep=["doc_id", "body"]).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert kind.score(docs(spark, []), model).count() == 0


def test_pairs_count_beyond_their_parts():
    """Neither word alone is toxic, both together are."""
    r = random.Random(1)
    rows, values, y = [], [], []
    for _ in range(1500):
        words = {100 + r.randrange(40) for _ in range(6)} | ({1} if r.random() < 0.5 else set()) | ({2} if r.random() < 0.5 else set())
        rows.append(np.array(sorted(words), dtype=np.int32))
        values.append(np.ones(len(words), dtype=np.uint8))
        y.append(int({1, 2} <= words))
    m = toxicity.train(rows, values, np.array(y), epochs=40)
    score = lambda *w: m.score(np.array([m.columns[x] for x in w if x in m.columns]), np.ones(sum(x in m.columns for x in w)))
    assert score(1, 2, 101) > 0.8 and score(1, 101) < 0.3 and score(2, 101) < 0.3


def test_term_counts_have_no_cap(spark):
    """A word of 300, 1,000 and 100,000 times has three scores, and keeps its count in training."""
    (bucket,) = toxicity.buckets("ab")
    m = toxicity.Machine({bucket: 0}, -3.0, np.array([0.2]), np.zeros((1, 6)))
    times = [0, 1, 255, 300, 1000, 100_000]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, [(n, "ab " * n, "s") for n in times]), m).collect()}
    assert all(abs(got[n] - 1 / (1 + np.exp(3 - 0.2 * np.log2(1 + n)))) < 1e-12 for n in times)
    assert abs(toxicity.logs(toxicity.Terms()("ab " * 100_000)[1]).view(np.float16)[0] - np.log2(100_001)) < 0.01


def test_attention_slopes():
    """Backward agrees with finite differences."""
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality_mil.FEATURES)).astype(np.float64) for n in (1, 3, 2)]
    model = quality_mil.train([b.astype(np.float32) for b in bags], np.array([1, 1, 1]))
    model.P = {k: rng.normal(0, 0.2, v.shape) for k, v in model.P.items()}
    x, starts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.sum(np.log(np.where(y == 1, (p := model.forward(x, starts)[0]), 1 - p)))
    p, cache = model.forward(x, starts)
    slopes = model.backward(p - y, cache, starts)
    for k in model.P:
        i = np.unravel_index(rng.integers(model.P[k].size), model.P[k].shape)
        old = model.P[k][i]
        model.P[k][i] = old + 1e-5
        up = loss()
        model.P[k][i] = old - 1e-5
        down = loss()
        model.P[k][i] = old
        assert slopes[k][i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_folds_follow_crc32(spark):
    import zlib

    got = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
