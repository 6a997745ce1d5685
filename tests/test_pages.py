"""Parsing, scoring and extraction of single pages."""

import pytest

from corpusloom.functions import page
from corpusloom.functions.html import parse, tokens
from corpusloom.functions.page import Affixes, Options, extract
from corpusloom.operators.discover import page_hosts, page_links, resolve
from corpusloom.operators.robots import parse_robots


def show(n):
    return n if isinstance(n, str) else f"<{n.tag}>{''.join(map(show, n.children))}</{n.tag}>"


@pytest.mark.parametrize(
    "source, body",
    [
        ("<p>a<b>b<br><p>c", "<p>a<b>b<br></br></b></p><p><b>c</b></p>"),
        ("<b>1<i>2</b>3</i>4", "<b>1<i>2</i></b><i>3</i>4"),
        ("<b><p>x</b>y</p>", "<b></b><p><b>x</b>y</p>"),
        ("<a href=1>x<div>y<a href=2>z</a></div>", "<a>x</a><div><a>y</a><a>z</a></div>"),
        ("<table>foo<tr><td>a<td>b</table>c", "foo<table><tbody><tr><td>a</td><td>b</td></tr></tbody></table>c"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("x<script>if(a<b)'</p>'</script>y", "x<script>if(a<b)'</p>'</script>y"),
        ("</p>x", "<p></p>x"),
        ("x &lt; y <3 <", "x < y <3 <"),
        ("", ""),
    ],
)
def test_tree(source, body):
    assert show(parse(source).first("body")) == f"<body>{body}</body>"


def test_tokens_of_odd_markup():
    kinds = [(k, d) for k, d, _ in tokens("<!-- <p> --><P CLASS='a>b' x>t<!doctype html></P ><?php ?>&amp;&eacute;")]
    assert kinds == [("start", "p"), ("text", "t"), ("end", "p"), ("text", "&é")]
    assert next(a for k, _, a in tokens("<a HREF=\"u?a=1&amp;b\" hidden Title=x>")) == {"href": "u?a=1&b", "hidden": "", "title": "x"}
    assert list(tokens("<title>a</b></title>")) == [("start", "title", {}), ("text", "a</b>", {}), ("end", "title", {})]


SENTENCE = "The river ran past the old mill, and nobody spoke; it was late, very late. "
ARTICLE = f"<html><head><title>Mill - Daily</title></head><body><nav><a href=/>home</a></nav><div><div><h1>Mill</h1>{''.join(f'<p>{SENTENCE * 3}</p>' for _ in range(5))}</div></div><footer>x</footer></body></html>"
NAV = "<html><title>Menu</title><body><ul>" + "".join(f"<li><a href='/{i}'>entry number {i}</a></li>" for i in range(60)) + "</ul></body></html>"


def test_article_and_menu():
    r = extract(ARTICLE)
    assert not r["no_article"] and r["container_tag"] == "div" and r["real_title"] == "Mill" and r["meta_title"] == "Mill - Daily"
    assert r["main_content"].count("\n") == 4 and "home" not in r["main_content"] and not r["main_content"].startswith("Mill\n")
    menu = extract(NAV)
    assert menu["no_article"] and menu["main_content"] == "" and menu["page_chars"] > 0 and menu["page_link_rate"] == 1.0


def test_inline_links_stay_and_link_blocks_go():
    text = f"<div><p>{SENTENCE}See <a href=/x>this page</a> for more of it, please.{SENTENCE}</p><p><a href=/y>{SENTENCE}</a></p><p>{SENTENCE * 4}</p></div>"
    out = extract(f"<body>{text}</body>")["main_content"]
    assert "See this page for more" in out and len(out.split("\n")) == 2


def test_breaks_make_lines():
    out = extract(f"<body><div>{'<br>'.join([SENTENCE] * 6)}</div></body>")
    assert out["main_content"].split("\n") == [SENTENCE.strip()] * 6 and not out["no_article"]


def test_ablation_switches_change_scores():
    s = page.Stats(chars=100, punct=3, links=40, elements=1)
    full = page.block_score(s, Options())
    assert page.block_score(s, Options(no_punct=True)) > full < page.block_score(s, Options(no_link=True))
    assert page.block_score(page.Stats(chars=7), Options()) == 0


@pytest.mark.parametrize(
    "tag, rate, chars, want",
    [("div", 0.1, 500, True), ("article", 0.5, 80, True), ("div", 0.51, 500, False), ("div", 0.1, 79, False), ("body", 0.0, 900, False), ("html", 0.0, 900, False), ("", 0.0, 900, False), ("ul", 0.0, 900, False), ("dd", 0.0, 900, False), ("td", 0.0, 900, True), ("table", 0.0, 900, False), ("header", 0.0, 900, False), ("section", 0.0, 900, True)],
)
def test_verdict(spark, tag, rate, chars, want):
    assert page.is_article(tag, rate, chars) is want
    from pyspark.sql import functions as F

    from corpusloom.operators.extract import verdict

    assert spark.createDataFrame([(tag, rate, chars)], "t string, r double, c int").select(verdict(F.col("t"), F.col("r"), F.col("c"))).first()[0] is want


def test_hidden_and_noise():
    doc = parse('<div hidden>a</div><div hidden=x>b</div><p style="Display : NONE">c</p><p style="visibility:hidden">d</p><aside>e</aside><header>f</header><noscript>g</noscript>')
    page.prune(doc)
    assert doc.first("body").text() == "af"


def test_titles_from_metadata():
    page_of = lambda head: f"<head>{head}<title>x | Site Name Here</title></head><body><p>{SENTENCE * 6}</p>"
    assert extract(page_of('<meta property="OG:title" content=" Graph title ">'))["real_title"] == "Graph title"
    assert extract(page_of('<meta name="twitter:title" content="Card title">'))["real_title"] == "Card title"
    json_ld = '<script type="application/ld+json">{"@graph": [{"name": "n"}, {"mainEntity": {"headline": "Deep headline"}}]}</script>'
    assert extract(page_of(json_ld))["real_title"] == "Deep headline"
    assert page.headline('{"a": 1}') == page.headline("not json") == page.headline('"text"') == ""
    nested = '{"headline": "H"}'
    for _ in range(7):
        nested = f'{{"mainEntity": {nested}}}'
    assert page.headline(nested) == ""


def test_strip_and_leading_title():
    a = Affixes("Book - ", " - Site")
    assert a.strip("Book - Chapter 1 - Site") == "Chapter 1" and a.strip("Book - ") == "Book" and Affixes().strip(" | a – ") == "a"
    assert page.drop_leading_title("A B\nbody text", "a,b") == "body text"
    assert page.drop_leading_title("body text", "") == "body text"
    assert page.normalize("a\n by x http://y \n\n b  c") == "a\nb c" and page.normalize("http://y", True) == "http://y"
    assert page.is_attribution("www." + "x" * 116) and not page.is_attribution("www." + "x" * 117)
    assert [page.length_fit(n) for n in (3, 4, 60, 61, 120, 121)] == [0, 1, 1, 0.5, 0.5, 0]


@pytest.mark.parametrize("c, want", [*((c, True) for c in ",.!?;:，。！？；：、…—“”‘’（）《》～¿¡؟،।"), *((c, False) for c in "ab1 -_/()\"'@#中$+")])
def test_punctuation(c, want):
    assert bool(page.PUNCT.fullmatch(c)) is want


def test_links_and_hosts():
    html = '<a href="/a#x">1</a><a href="http://h.com/a">2</a><a href="#top">3</a><a href="https://other.org/z">4</a><a href="mailto:x@y">5</a><a href="b?q=1">6</a><a>7</a><a href="//h.com:81/c">8</a><a href="http://other.org:9/y">9</a>'
    assert page_links("http://h.com/d/e", html) == ["http://h.com/a", "http://h.com/d/b?q=1"]
    assert page_hosts("http://h.com/d/e", html) == ["other.org"]
    assert resolve("http://h.com/", "/ü x") == "http://h.com/%C3%BC%20x" and resolve("http://h.com/", "http://[bad") is None


def test_robots_text():
    groups, delay = parse_robots("Disallow: /lost\nUser-agent: A\nUser-Agent: B # two\nDisallow: /x\nAllow: /x/y\nCrawl-delay: 1\nUser-agent: *\nDisallow:\nCrawl-delay: 2.5\nCrawl-delay: -1\nnonsense")
    assert [g["agents"] for g in groups] == [["a", "b"], ["*"]] and delay == 2.5
    assert groups[0]["rules"] == [{"allow": False, "prefix": "/x"}, {"allow": True, "prefix": "/x/y"}]


def test_deep_nesting_takes_linear_time():
    """Opening and closing tags of each kind under many open elements; quadratic time would take minutes."""
    import time

    n = 30_000
    shapes = ["<div>" * n, "<b>x" + "<div>" * n + "</p>" * n, "<div>" * n + "<li>a</li>" * n, "<span>" * n + "</i>" * n, "<div>" * n + "</div>" * n + "<p>end"]
    begun = time.process_time()
    for s in shapes:
        doc = parse(s)
        assert sum(1 for _ in doc.elements()) > n
    assert time.process_time() - begun < 60
