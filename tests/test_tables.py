"""DataFrame operators on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import page, text, url
from corpusloom.operators import discover, extract, frontier, metrics, robots, sample, templates, titles
from corpusloom.plans import corpus
from corpusloom.sources import tables
from corpusloom.streaming import pages as stream


def column(spark, values, fn):
    return [r[1] for r in spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(1).select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_normalize(spark):
    given = ["HTTP://Ex.COM:80/a#f", "https://ex.com.:443/", "https://ex.com:8443/A?b=C", "http://[2001:db8::1]:80/x", "ftp://x.y/", "x.y", None, "http://ex.com"]
    assert column(spark, given, url.normalize) == ["http://ex.com/a", "https://ex.com/", "https://ex.com:8443/A?b=C", "http://[2001:db8::1]/x", None, None, None, "http://ex.com"]


def test_seed_hosts(spark):
    given = ["https://News.Example.com:8080/x", "example.com.", " a.b ", "", "# x", "ftp://a.b", "localhost", "www.zhihu.com", "notzhihu.com", None]
    assert column(spark, given, url.seed_host) == ["news.example.com", "example.com", "a.b", None, None, None, None, None, "notzhihu.com", None]
    assert len(url.BLOCKED) == 27 and len(url.FUNCTIONAL) == 46


def test_article_addresses(spark):
    good = ["http://a/news/2024/x", "http://a/a/12345.html", "http://a/s.php?id=99", "http://a/x/long-slug", "http://a/1999/ab"]
    bad = ["http://a/", "http://a/login/12345", "http://a/x/y.pdf", "http://a/x/page2", "http://a/x/p_1", "http://a/b/c", "http://a/s?id=9", "http://a/x/1.JPG", "http://a/search?q=123"]
    assert column(spark, good + bad, url.looks_like_article) == [True] * 5 + [False] * 9


def test_picks(spark):
    links = spark.createDataFrame([("h", f"http://h/n/{u}", i) for i, u in enumerate(["abcdefgh", "2024/123456.html", "a1", "b1", "login/1"])], "host string, url string, pos int")
    assert [r["url"][11:] for r in discover.pick_articles(links, 3).orderBy("rank").collect()] == ["2024/123456.html", "a1", "b1"]  # a digit weighs more than a long slug
    assert discover.pick_sections(links, 2).count() == 2
    html = "<a href='/x/y'>1</a><a href='/z'>2</a><a href='http://o.org'>3</a>"
    pages = spark.createDataFrame([(1, "http://d.com/", html), (2, "http://d.com/z", "<a href='https://p.org/q'>")], "page_id bigint, url string, html string")
    assert sorted(r[0] for r in discover.harvest_directories(spark.createDataFrame([("d.com",)], "host string"), pages).collect()) == ["o.org", "p.org"]


@pytest.mark.parametrize("n, want", [(2, ("", "")), (3, ("Book - ", " | Site")), (5, ("Book - ", " | Site"))])
def test_learning(spark, n, want):
    seen = [f"Book - {'abcdefgh'[i] * 6} | Site" for i in range(n)]
    df = spark.createDataFrame([(i, "h", t) for i, t in enumerate(seen)], "page_id int, host string, title string")
    out = titles.learn_affixes(df).collect()
    assert (tuple((out[0]["prefix"], out[0]["suffix"])) if out else ("", "")) == want == stream.learn(seen)


def test_learning_limits(spark):
    from corpusloom.operators.titles import CHECKPOINTS

    assert CHECKPOINTS == [3, 6, 12, 24, 48, 96, 192]
    seen = ["ab - one page | S"] * 3 + ["zz"] + ["ab - two page | S"] * 8
    df = spark.createDataFrame([(i, "h", t) for i, t in enumerate(seen)], "page_id int, host string, title string")
    r = titles.learn_affixes(df).first()
    assert (r["prefix"], r["suffix"]) == stream.learn(seen) and r["pages"] == 12


def test_templates(spark):
    tail = "shared-tail-of-the-site"
    rows = [(i, "h", f"{c * 24} own{i}\n{c * 3}{tail}") for i, c in enumerate("xyz")] + [(9, "two", tail), (10, "two", tail)] + [(20 + i, "same", "one and the same page") for i in range(3)] + [(30, "h", None), (31, "h", "")]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    out = {r["doc_id"]: r["stripped"] for r in templates.strip_templates(docs, templates.learn_templates(docs)).collect()}
    assert out[0] == "x" * 24 + " own0\nxxx" and out[9] == tail and out[20] == "one and the same page" and out[30] == out[31] == ""


def test_scheduling(spark):
    rows = [(i, h, f"2024-01-01 00:00:0{s}", e) for i, (h, s, e) in enumerate([("a", 0, "ok"), ("a", 1, "bad"), ("b", 0, "bad"), ("a", 3, "bad"), ("b", 1, "hit"), ("a", 5, "ok"), ("b", 4, "bad")])]
    log = spark.createDataFrame(rows, "i int, h string, t string, e string").withColumn("t", F.to_timestamp("t"))
    v = {r["h"]: (r["requests"], r["violations"], r["min_gap_s"]) for r in frontier.violations(log, "h", "t", "i", 2.0).collect()}
    assert v == {"a": (4, 1, 1.0), "b": (3, 1, 1.0)}
    left = frontier.before_abandoning(log, "h", ["t", "i"], F.col("e") == "bad", 2)
    assert sorted(r["i"] for r in left.collect()) == [0, 1, 2, 3, 4, 6]
    assert sorted(r["i"] for r in frontier.until_target(log, "h", ["t", "i"], F.col("e") == "hit", 1).collect()) == [0, 1, 2, 3, 4, 5]
    assert frontier.until_target(log, "h", ["t"], F.col("e") == "hit", 0).count() == 7
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.b/1", "HTTP://A.B/1#x", "http://a.b:80/1", "http://a.b/2", "http://a.b/3", "mailto:x"])], "page_id int, url string")
    assert frontier.dedupe(urls).count() == 3 and frontier.queue(urls, 2).count() == 2
    plan = frontier.schedule(frontier.queue(urls, 9), 1.5, spark.createDataFrame([("a.b", 1.0)], "host string, delay double"))
    assert [r["start_s"] for r in plan.orderBy("place").collect()] == [0, 1.5, 3.0] and frontier.next_wait(plan, 2.0).first()[0] == 1.0


def test_robots(spark):
    file = "User-agent: *\nDisallow: /\nUser-agent: mybot\nDisallow: /a\nAllow: /a/b\nDisallow: /c\nAllow: /c\nDisallow:\n"
    rules = robots.robots_rules(spark.createDataFrame([("h", file), ("slow", "User-agent: *\nCrawl-delay: 61"), ("other", "User-agent: zz\nDisallow: /"), ("void", None)], "host string, text string"))
    urls = ["http://h/a", "http://h/a/b", "http://h/c", "http://h", "http://h/%61", "http://h/x?/a", "http://slow/x", "http://other/x", "http://void/x", "http://none/x"]
    df = robots.decide(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string"), rules, "MyBot/1.0")
    assert [r["reason"] for r in df.orderBy("i").collect()] == ["robots", None, None, None, "robots", None, "delay", None, None, None]
    assert [r["reason"] for r in robots.decide(df.select("i", "url"), rules, "else").orderBy("i").collect()][:3] == ["robots"] * 3


@pytest.mark.parametrize("per_host, cap", [(0, 0), (1, 0), (3, 0), (4, 5), (50, 0), (50, 7)])
def test_samples(spark, per_host, cap):
    rows = [(i, "abc"[i % 3] if i < 25 else "d") for i in range(40)]

    def pick(items, n):
        if n <= 0 or len(items) <= n:
            return list(items) if n > 0 else []
        return [items[i] for i in sorted({round(i * (len(items) - 1) / (n - 1)) for i in range(n)})] if n > 1 else items[:1]

    want = [x for h in "abcd" for x in pick([r[0] for r in rows if r[1] == h], per_host)]
    want = pick(want, cap) if 0 < cap < len(want) else want
    df = spark.createDataFrame(rows, "i int, h string")
    assert sorted(r["i"] for r in sample.stratified(df, "h", ["i"], per_host, cap).collect()) == sorted(want)
    for n in (1, 7, 39, 40, 99):
        assert sorted(r["i"] for r in sample.every_nth(df, ["i"], n).collect()) == sorted({i * 40 // n for i in range(n)} if n < 40 else range(40))


def test_sources(spark, tmp_path):
    lines = [json.dumps({"url": "http://a.b/x", "html": "<p>", "title": "t", "more": 1}), "", "not json", '{"url": "http://c.d/y"}', '{"url": "torn']
    (tmp_path / "in").write_text("\n".join(lines))
    got = [tuple(r) for r in tables.read_pages(spark, f"{tmp_path}/in").collect()]
    assert len(got) == 4 and got[0] == ("http://a.b/x", "t", "<p>") and got[1] == ("", "", "")
    assert sorted(r[0] for r in tables.read_done(spark, f"{tmp_path}/in").collect()) == ["http://a.b/x", "http://c.d/y"]
    assert sorted(r[0] for r in tables.read_seed_json(spark, f"{tmp_path}/in").collect()) == ["a.b", "c.d"]
    assert tables.read_samples(spark, f"{tmp_path}/in").count() == 2
    (tmp_path / "seeds").write_text("b.c\n# no\n\nhttp://a.b/x\nb.c\n")
    assert [r[0] for r in tables.read_seed_lines(spark, f"{tmp_path}/seeds").collect()] == ["a.b", "b.c"]
    assert sorted(r[0] for r in tables.read_crawl_seeds(spark, f"{tmp_path}/seeds").collect()) == ["http://a.b/x", "http://b.c", "http://b.c"]
    tables.write_entries(spark.createDataFrame([("u", "c"), ("", "d"), (None, "e")], "url string, main_content string"), f"{tmp_path}/store")
    assert [r["url"] for r in spark.read.parquet(f"{tmp_path}/store").filter("fetched_at IS NOT NULL").collect()] == ["u"]


def test_retry_classes(spark):
    df = spark.createDataFrame([(s,) for s in (200, 404, 429, 500, 599, 301)], "s int")
    assert [r[0] for r in df.select(frontier.retryable(F.col("s"), F.lit(False))).collect()] == [False, False, True, True, True, False]


def html(title, body):
    return f"<title>{title}</title><body><div>{''.join(f'<p>{b}</p>' for b in body)}</div></body>"


@pytest.fixture(scope="module")
def site(spark):
    s = "It was late, very late; and nobody came. "
    rows = [(i, f"http://h.org/n/{i}", html(f"Story {w * 4} | The Site", [s.replace("late", w) * 4, "Sharedboilerplateofthesite"])) for i, w in enumerate(["ant", "bee", "cow", "dog"])]
    return spark.createDataFrame([*rows, (9, "http://k.org/", None)], "page_id bigint, url string, html string")


def test_corpus_plan(site):
    out = {r["page_id"]: r for r in corpus.build_corpus(site).collect()}
    assert out[0]["real_title"].endswith("antantantant") and "Sharedboilerplate" not in out[0]["main_content"] and out[9]["main_content"] == ""
    assert corpus.replay(site, per_host=2).filter("host = 'h.org'").count() == 4


def test_relational_container_is_that_of_the_parser(site):
    a = {r["page_id"]: r["container_tag"] for r in extract.containers(extract.dom_nodes(site)).collect()}
    b = {r["page_id"]: r["container_tag"] for r in extract.extract_pages(site).collect() if r["container_tag"]}
    assert a == b


def test_ablation_report(site):
    rows = metrics.ablation(site, ["full", "no-template", "no-link"]).orderBy("variant").collect()
    assert [r["variant"] for r in rows] == ["full", "no-link", "no-template"] and rows[0]["residue"] < rows[2]["residue"] and metrics.markdown(rows).count("\n") == 5


def test_columns_agree_with_plain_functions(spark):
    given = ["", "a", "Ab, c!  ", "日本語。テスト", "x　y\xa0z", "www.a.b", "Ａ～b", "a b\x85c"]
    assert column(spark, given, text.fold) == [page.fold(x) for x in given]
    assert column(spark, given, text.collapse) == [page.collapse(x) for x in given]
    assert column(spark, given, text.content_chars) == [page.content_chars(x) for x in given]
    assert column(spark, given, text.normalize) == [page.normalize(x) for x in given]


def test_streams_agree_with_batch(spark, site, tmp_path):
    site.write.parquet(f"{tmp_path}/pages.parquet")
    q = stream.extract_by_batch(stream.read_stream(spark, f"{tmp_path}/pages.parquet"), f"{tmp_path}/t", f"{tmp_path}/o", f"{tmp_path}/c")
    q.awaitTermination()
    batch = extract.extract_pages(site, titles.learn_affixes(metrics.with_titles(site)))
    key = lambda df: sorted((r["page_id"], r["real_title"], r["main_content"]) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/o")) == key(batch)


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_containers_climb_as_deep_as_the_page(spark):
    schema = "page_id bigint, node int, parent int, tag string, post int, chars int, links int, own double, total double"
    deep = [(1, k, k - 1 if k else None, "html" if k == 0 else "div", 2000 - k, 100, 0, 0.0 if k < 1500 else 9.0, 9.0) for k in range(1501)]
    flat = [(2, 0, None, "body", 3, 100, 0, 0.0, 20.0), (2, 1, 0, "section", 2, 100, 50, 9.0, 9.0), (2, 2, 1, "p", 1, 100, 0, 9.0, 10.0)]
    nodes = spark.createDataFrame([*deep, *flat], schema)
    assert sorted(tuple(r) for r in extract.containers(nodes).collect()) == [(1, 1, "div"), (2, 2, "p")]


@pytest.mark.parametrize("parts", [4, 200])
def test_samples_of_many_wide_rows(spark, parts):
    """Ranges that are drawn twice would differ; also a hot host, equal rows and nulls."""
    n = 120_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("i"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 40).cast("string"))).alias("h"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("wide"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(r["i"] for r in sample.every_nth(rows, ["i"], 997).select("i").collect()) == [k * n // 997 for k in range(997)]
        numbers = sample.numbered(rows.select("i"), ["i"], "p")
        assert numbers.filter("i <> p").count() == 0 and numbers.count() == n
        by = {}
        for r in rows.select("i", "h").collect():
            by.setdefault(r["h"], []).append(r["i"])
        picked = []
        for h in sorted(by):
            own = sorted(by[h])
            picked += [own[round(k * (len(own) - 1) / 49)] for k in range(50)]
        want = [picked[round(k * (len(picked) - 1) / 499)] for k in range(500)]
        assert sorted(r["i"] for r in sample.stratified(rows, "h", ["i"], 50, 500).select("i").collect()) == sorted(want)
        alike = spark.createDataFrame([(1, None)] * 5 + [(None, "x")] * 3, "i int, h string")
        assert sample.every_nth(alike, ["i"], 4).count() == 4 and sample.stratified(alike, "h", ["i"], 2).count() == 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_page_lines_of_other_types_are_empty(spark):
    lines = ['{"url": 5, "title": "t", "html": "h"}', '{"url": "u", "title": null, "html": "h"}', '{"url": "u", "html": ["x"]}', "[1]", "null", "", '"text"', '{"html": "h", "more": {"a": 1}}', "{torn"]
    out = tables.parse_page_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r) for r in out.collect()] == [("", "", ""), ("u", "", "h"), ("", "", ""), ("", "", ""), ("", "", ""), ("", "", ""), ("", "", "h"), ("", "", "")]


def brute_templates(rows):
    from collections import Counter

    by = {}
    for h, t in rows:
        flat = "".join(c for c in t or "" if c not in " \t\n\r\u00a0\u3000")
        if h is not None and len(flat) >= 5:
            by.setdefault(h, []).append({flat[i : i + 5] for i in range(len(flat) - 4)})
    return sorted((h, g) for h, pages in by.items() if len(pages) >= 3 for g, n in Counter(g for p in pages for g in p).items() if n >= max(2, -(-len(pages) // 2)))


@pytest.mark.parametrize("group_bytes", [16 << 20, 300])
def test_templates_of_hosts_in_groups(spark, monkeypatch, group_bytes):
    """One group for a host, and many; with nulls, empty and short texts, repeated rows and wide characters."""
    import random

    monkeypatch.setattr(templates, "GROUP_BYTES", group_bytes)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg\U0001f600é") for _ in range(rng.randint(2, 8)))
    rows = []
    for h in ["a", "b", "c", None]:
        for k in range({"a": 40, "b": 7, "c": 2}.get(h, 5)):
            tail = "\nAll rights reserved - \U0001f600 read more" if k % 5 else "\nsomething else"
            rows.append((h, " ".join(word() for _ in range(12)) + tail))
    rows += [("a", None), ("a", ""), ("b", "abcd"), rows[0], rows[0]]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, source string, text string")
    learned = templates.learn_templates(docs)
    assert sorted(tuple(r) for r in learned.collect()) == brute_templates(rows) and brute_templates(rows)
    out = {r["doc_id"]: r["stripped"] for r in templates.strip_templates(docs, learned).collect()}
    assert len(out) == len(rows) and "reserved" not in out[1] and out[len(rows) - 5] == "" and any("reserved" in t for i, t in out.items() if rows[i][0] == "c")
    assert templates.learn_templates(docs.limit(0)).count() == templates.strip_templates(docs.limit(0), learned).count() == 0


def test_copies_of_a_text_are_spread_over_groups(spark, monkeypatch):
    """Groups by text alone would put all copies into one task."""
    import glob
    import os
    from urllib.parse import urlparse

    from corpusloom.storage import shared_dir

    monkeypatch.setattr(templates, "GROUP_BYTES", 1000)
    docs = spark.createDataFrame([(i, "h", "one and the same page " * 3) for i in range(400)], "doc_id int, source string, text string")
    learned = {r["gram"] for r in templates.learn_templates(docs, key="doc_id").collect()}
    own = "oneandthesamepage" * 3
    assert learned == {own[i : i + 5] for i in range(len(own) - 4)}
    groups = spark.read.parquet(max(glob.glob(f"{urlparse(shared_dir(spark)).path}/templates-*/found"), key=os.path.getmtime)).filter("gram IS NULL")
    assert groups.agg(F.max("df")).first()[0] < 100


def test_grams_that_groups_leave_open_are_counted_again(spark, monkeypatch):
    """Shares around a half, so that a group's count alone tells too little."""
    import random

    monkeypatch.setattr(templates, "GROUP_BYTES", 200)
    rng = random.Random(4)
    rows = [("h", "".join(f"{w}{'!' * (rng.random() < p)}zzzz" for w, p in [("alpha", 0.45), ("beta", 0.5), ("gamma", 0.55), ("delta", 0.9), ("eps", 0.1)])) for _ in range(120)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, source string, text string")
    assert sorted(tuple(r) for r in templates.learn_templates(docs, key="doc_id").collect()) == brute_templates(rows)


def test_one_parse_tells_what_each_variant_does(site, monkeypatch):
    parsed = []
    parse = page.parse
    monkeypatch.setattr(page, "parse", lambda h: parsed.append(h) or parse(h))
    known = page.Affixes("Story ", " | The Site")
    ways = [(a, page.Options(**o)) for a in (known, page.Affixes()) for o in ({}, {"no_punct": True}, {"no_link": True}, {"no_propagate": True}, {"keep_attribution": True})]
    for r in site.collect():
        del parsed[:]
        told = page.extract_each(r["html"] or "", ways)
        assert len(parsed) == 1 and told == [page.extract(r["html"] or "", *w) for w in ways]


def test_request_rates_stay_out_of_the_driver(spark, tmp_path):
    """Two files, so two batches; rows of one window in both, and one eleven years late."""
    import duckdb

    from corpusloom import queries

    for k, days in enumerate([["2024-01-01 01:00:00", "2024-01-02 00:00:00"], ["2024-01-01 05:00:00", "2013-01-01 00:00:00"]]):
        rows = spark.createDataFrame([(k * 10 + i, t, 7) for i, t in enumerate(days)], "event_id bigint, ts string, user_id bigint").withColumn("ts", F.to_timestamp_ntz(F.col("ts")))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    read = stream.read_stream
    queries.stream.read_stream, was = (lambda s, p: read(s, p, 1)), stream.read_stream
    try:
        out = queries.QUERIES["stream_request_rates"](spark, str(tmp_path))
    finally:
        queries.stream.read_stream = was
    want = duckdb.sql(queries.SQL["stream_request_rates"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and len(want) == 3
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("rates_")]
