"""Page text on hand-made pages, and line dedup by brute force."""

import html
import random
import re
from collections import defaultdict

import pytest

from caremart.llm import html_extract as H
from caremart.llm import line_dedup as L
from caremart.llm.common import table

LONG = "This is the first of the paragraphs and it has all of the words that a text in English needs to be long enough."
MORE = "It was not until the end of the day that they had been able to see what he had done with the house on the hill."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""),
    (f"<body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p><b>Lead.<br><p>{LONG}</p><p>Yes.</p></article>"
     "<footer>&copy; x</footer>", f"Title & more\nLead.\n{LONG}\nYes."),
    (f"<div class='ad'>{MORE}</div><article><p>{LONG}</p><div class='ad-slot'>{MORE}</div><p>wo<b>r</b>d&nbsp;&#x41;\n\t b</p></article>",
     f"{LONG}\nword A b"),
    (f"<header><h1>Site</h1></header><div id='content'><h2>Head</h2><p>{LONG}<p>{MORE}</div><div class='sidebar'><p>{LONG}</p></div>",
     f"Head\n{LONG}\n{MORE}"),
    (f"<article><header><h1>Own head</h1></header><p>{LONG}</p><section id=comments><p>{MORE}</p></section></article>", f"Own head\n{LONG}"),
    (f"<main><script>var a='<p>{MORE}</p>';</script><style>p{{}}</style><!-- <p>{MORE}</p> --><p title='a > b'>{LONG}</p>"
     f"<form><label>{MORE}</label><input value=x></form></main>", LONG),
    (f"<article><p>{LONG}</p><ul><li><a href=a>{MORE}</a></li></ul><div class='cookie-notice'><p>{MORE}</p></div></article>", LONG),
    (f"<article><p>{LONG}</p><script>never closed <p>{MORE}", LONG),
    (f"<article><p>{LONG}</p><!-- never closed <p>{MORE}", LONG),
    (f"<article><p>{LONG}</p><p>a < b and c > d &lt;i&gt;</p></article", f"{LONG}\na < b and c > d <i>"),
    (f"<div class='has-sidebar'><p>{LONG}</p><p>{MORE}</p></div>", f"{LONG}\n{MORE}"),
    (f"<article><p>{LONG}</p></p></div></b><p>%%% ### qzx$$$ xkcd&&& wrt*** zzz### qqq%%% www$$$ rrr&&& ttt*** yyy### uuu%%% iii</p></article>",
     f"{LONG}\n%%% ### qzx$$$ xkcd&&& wrt*** zzz### qqq%%% www$$$ rrr&&& ttt*** yyy### uuu%%% iii"),
])
def test_pages(page, want):
    assert H.extract(page) == want


ITALIAN = "Nessuno dei presenti aveva mai visto una casa simile, costruita pietra dopo pietra sulla collina davanti al mare."
RUSSIAN = "Никто из жителей города прежде не видел такого большого дома, построенного на холме рядом с морем много лет назад."
CHINESE = "这座城市的居民从来没有见过这样的房子,它建在海边的山上已经很多年了。"
TERSE = "Copper tubing, brass fittings, rubber gaskets, steel bolts, nylon washers, silicone grease, spare valves included."
LIST = "<ul><li><a href=a>First of the other pages</a></li><li><a href=b>Second</a></li></ul>"
CITED = "It was <a href=x>the first of the houses on that hill</a> and also <a href=y>the last of them</a>, as all who had been there said at once."


@pytest.mark.parametrize("body", [[ITALIAN], [RUSSIAN], [CHINESE], [TERSE], [LONG, TERSE, MORE], [ITALIAN, "Sì.", RUSSIAN], [LONG, CITED],
                                  [CITED], [LONG, "See <a href=x>this</a>.", MORE], ["Title", CHINESE, CHINESE]])
@pytest.mark.parametrize("box", ["div", "section", "article", "main"])
def test_no_paragraph_is_lost_for_its_language_or_links(body, box):
    inner = "".join(f"<p>{x}</p>" for x in body)
    page = f"<body>{LIST}<nav>{MORE}</nav><{box}>{inner}</{box}><div class=ad>{ITALIAN}</div>{LIST}<footer>{RUSSIAN}</footer></body>"
    assert H.extract(page) == "\n".join(re.sub("<[^>]*>", "", x) for x in body)


def test_paragraphs_of_an_article_beside_links_stay():
    page = f"<article><p>{LONG}</p>{LIST}<p>{TERSE}</p>{LIST}<p>{ITALIAN}</p></article>"
    assert H.extract(page) == f"{LONG}\n{TERSE}\n{ITALIAN}"


NAMES = ["content-with-sidebar", "layout-sidebar", "side-by-side", "search-engine-news", "form-guide", "menu-review", "alert-systems"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("box", ["div class", "div id", "article class", "section class"])
def test_a_name_alone_drops_no_article(name, box):
    tag = box.split()[0]
    page = f"<body><nav>{MORE}</nav><{box}='{name}'><h2>Head</h2><p>{LONG}</p><p>{RUSSIAN}</p></{tag}><div class=ad>{ITALIAN}</div></body>"
    assert H.extract(page) == f"Head\n{LONG}\n{RUSSIAN}"


@pytest.mark.parametrize("page, want", [
    # a headline in a header of the article
    (f"<article><div class='article-header'><h1>Own head</h1></div><p>{LONG}</p></article>", f"Own head\n{LONG}"),
    (f"<article><header class='entry-header'><h1>Own head</h1></header><p>{LONG}</p></article>", f"Own head\n{LONG}"),
    # teasers and cards beside the real text
    (f"<div id=story><p>{LONG}</p><p>{MORE}</p></div><article class=teaser><p>Hi</p></article>", f"{LONG}\n{MORE}"),
    (f"<article class=teaser>Hi</article><div><p>{LONG}</p></div>", LONG),
    (f"<div id=story><p>{LONG}</p></div><article><a href=x>{MORE}</a></article>", LONG),
    # marks that stay firm
    (f"<div><p>{LONG}</p></div><div class='layout-sidebar'><p>{MORE[:80]}</p></div>", LONG),
    (f"<div><p>{LONG}</p></div><div class='sidebar'><p>{MORE}</p><p>{RUSSIAN}</p></div>", LONG),
    (f"<div><p>{LONG}</p></div><div id='comments'><p>{MORE}</p><p>{RUSSIAN}</p><p>{ITALIAN}</p></div>", LONG),
    (f"<div class='ad-unit-7'><p>{MORE}</p></div><p>{LONG}</p><div class='site-footer'>{MORE}</div><ul class='related-posts'><li>{MORE}</ul>", LONG),
    (f"<div class='widget'><h2>Head</h2><p>{LONG}</p></div>", f"Head\n{LONG}"),  # all text there is
    # inline adverts go, words of a sentence stay
    (f"<article><p>{LONG} <span class='ad'>BUY <b>NOW</b></span> and on.</p><p>{MORE} <span class='note'>Yes.</span></p></article>",
     f"{LONG} and on.\n{MORE} Yes."),
    (f"<article><p>{LONG} <em class='promo'>never closed</p><p>{MORE}</p></article>", f"{LONG}\n{MORE}"),
    (f"<article><pre><span class='comment'># why it is so</span> x = 1</pre><p>{LONG}</p></article>", f"# why it is so x = 1\n{LONG}"),
    # a short paragraph of an article between lists of links
    (f"<article>{LIST}<p>It is so.</p>{LIST}<p>{LONG}</p></article>", f"It is so.\n{LONG}"),
])
def test_marks_and_regions_are_weighed(page, want):
    assert H.extract(page) == want


def test_stop_words_speak_for_a_block_and_never_against_one():
    assert H.density("It was one of the things that they had") > 0.8 and H.density("Brass gaskets, nylon.") == 0
    assert H.density("Это было на холме") == 0
    short = "But it is not what they had said to him."
    page = "<div>{}</div><ul><li><a href=a>One of the links of this page</a></li></ul>"
    assert H.extract("<ul><li><a href=a>A link of the page</a></li></ul>" + page.format(short)) == short
    assert H.extract("<ul><li><a href=a>A link of the page</a></li></ul>" + page.format("Copper tubing, brass fittings, gaskets.")) == ""


@pytest.mark.parametrize("box", ["div", "section", "article", "div class='menu-review'", "div id='layout-sidebar'", "section class='content-with-sidebar'"])
def test_test_pages_keep_their_text_in_any_box(small, box):
    import pyarrow.parquet as pq

    for page in pq.read_table(small + "/pages.parquet")["html"].to_pylist():
        boxed = page.replace("<article>", f"<{box}>").replace("</article>", f"</{box.split()[0]}>")
        assert H.extract(boxed) == H.extract(page) != ""


@pytest.mark.parametrize("page, want", [
    (f"<html><head><meta charset=utf-8><title>x</title><link rel=y><body><article><p>{LONG}</p></article></body></html>", LONG),
    (f"<head><title>x</title><style>p{{}}</style><meta name=z>\n<div><p>{LONG}</p><p>{MORE}</p></div>", f"{LONG}\n{MORE}"),
    (f"<head><title>x</title><b>Bold</b> start.<p>{LONG}</p>", f"Bold start.\n{LONG}"),
    (f"<head><title>x</title>Plain start.<p>{LONG}</p>", f"Plain start.\n{LONG}"),
    (f"<head><title>x</title><script>1</script><nav>{MORE}</nav><main><p>{LONG}</p></main>", LONG),
    (f"<head><title>x</title></head><body><p>{LONG}</p></body>", LONG),
    (f"<article><p>{LONG}</p><svg class='icon' viewBox=\"0 0 1 1\" /><p>{MORE}</p></article>", f"{LONG}\n{MORE}"),
    (f"<svg/><math display=block/><div><p>{LONG}<svg title='a > b'/></p></div><SVG x=1/><p>{MORE}</p>", f"{LONG}\n{MORE}"),
    (f"<article><p>{LONG}</p><svg><text>drawn</text><path d='x'/></svg><p>{MORE}</p><svg-icon></svg-icon><p>{LONG}</p></article>",
     f"{LONG}\n{MORE}\n{LONG}"),
])
def test_open_heads_and_empty_drawings_hide_nothing(page, want):
    assert H.extract(page) == want


def test_hostile_pages_end():
    for page in ("<" * 50_000, "<a " * 20_000, "<p title='" * 2_000, "<div>" * 20_000 + "x", "&" * 50_000, "<!--" * 20_000):
        H.extract(page)
    assert len(H.extract("<article><p>" + LONG + " " + "word " * 200_000 + "</p></article>")) > 1_000_000


def test_main_text_rows(spark):
    rows = [(1, "u", "<article><p>" + LONG + "</p></article>", "x"), (None, None, None, "x"), (1, "u", "", "y")]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r["page_id"]), r["n_chars"], len(r["text"])) for r in got) == [
        ("1", 0, 0), ("1", len(LONG), len(LONG)), ("None", 0, 0)]
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_keeps_articles_and_nothing_else(spark, small):
    """The test pages hold their text in one article; plain parsing of it is the yardstick."""
    from caremart.llm.queries import op5_main_text

    pages = {r["page_id"]: r["html"] for r in table(spark, small, "pages").collect()}
    for r in op5_main_text(spark, small).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1|article)>", body)
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
        assert r["text"] == "\n".join(x for x in want if x)
        assert r["n_chars"] == len(r["text"])


def brute(rows, sites):
    seen = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                seen[x.strip(" ")].add(s)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n") if t else []
        kept = [x for x in lines if not x.strip(" ") or len(seen[x.strip(" ")]) < sites]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sites, part", [(1, 10), (2, 3), (3, 1000), (8, 1000)])
def test_lines(spark, sites, part):
    rng = random.Random(4)
    lines = ["", " ", "Menu", " Menu ", "© all", "tab\t"] + ["line %d" % i for i in range(40)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))), rng.choice(["a", "b", "c", "d", "e", "f", "g", "h", "", None]))
            for i in range(80)]
    rows += [(90, None, "a"), (91, "", None), (92, "Menu", "a"), (92, "Menu", "a"), (None, "Menu\nown", "z"), (93, "x\n" * 20_000, "a")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, n_lines int, key string").repartition(3)
    found = L.remove(df, L.boilerplate(df, sites=sites), ["doc_id", "key"], broadcast_keys=part)
    got = sorted(((r["doc"]["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()), key=str)
    assert got == brute(rows, sites)
    empty = df.limit(0)
    assert L.remove(empty, L.boilerplate(empty), ["doc_id"]).count() == 0
