from __future__ import annotations

import html
import re
import tracemalloc
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stationlake.llm import html_template, queries


def plain(source):
    """The article of the test pages by plain replacements: their articles have no aside inside but what is removed here."""
    found = re.search(r"<article\b[^>]*>(.*)</article>", source, re.S)
    body = found[1] if found else ""
    body = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", body, flags=re.S)
    body = re.sub(r"</?(?:b|i|a|em|strong|span|code)\b[^>]*>", "", body)
    blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"<[^>]*>", body)]
    return "\n".join(b for b in blocks if b)


def test_articles_of_the_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    got = queries.op9_html_template(spark, sf_dir).collect()
    assert len(got) == len(sources)
    simple = 0
    for r in got:
        source = sources[r["page_id"]] or ""
        assert r["n_chars"] == len(r["text"])
        article = re.search(r"<article\b[^>]*>(.*)</article>", source, re.S)
        if article and not re.search(r"<(nav|aside|form|div|section|footer|header)\b", article[1]):
            simple += 1
            assert r["text"] == plain(source)
    assert simple > len(sources) / 3


def site(spark, pages):
    rows = [(i, f"http://{host}/p{i}", page) for i, (host, page) in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df):
    return [r["text"] for r in df.orderBy("page_id").collect()]


def test_template_without_an_article(spark):
    """Fixed text repeats on every page; what varies is found between it, though no name gives it away."""
    page = "<html><body><div class=a>Welcome to us</div><div class=x><p>{0} one</p><p>{0} two</p></div><div class=z>All rights kept</div></body></html>"
    pages = [("h.example", page.format(f"story{i}")) for i in range(8)]
    got = texts(html_template.extract(site(spark, pages)))
    assert got == [f"story{i} one\nstory{i} two" for i in range(8)]


def test_large_templates_are_dealt_out(spark):
    page = "<body><div class=a>Same</div><div class=x><p>text {0}</p></div><div class=z>End</div></body>"
    pages = [("one.example", page.format(i)) for i in range(10)]
    assert texts(html_template.extract(site(spark, pages), broadcast_bytes=0)) == texts(html_template.extract(site(spark, pages)))


def keyed(pages):
    return pages.select(F.regexp_extract("url", html_template.HOST, 1).alias("host"), "html")


def plain_classes(sources, least_pages=3, least_share=0.5):
    """Valid equivalence classes of one host's distinct pages, from whole vectors and by comparing all occurrences."""
    pages = [html_template.Page(s) for s in dict.fromkeys(sources)]
    counts = [Counter(p.tokens) for p in pages]
    vectors = defaultdict(set)
    for token in set().union(*counts):
        vector = tuple(c[token] for c in counts)
        if sum(map(bool, vector)) >= max(least_pages, least_share * len(pages)):
            vectors[vector].add(token)
    classes = [c for c in vectors.values() if len(c) >= 2]
    spans, orders = {}, defaultdict(set)
    for k, members in enumerate(classes):
        for n, page in enumerate(pages):
            at = [i for i, t in enumerate(page.tokens) if t in members]
            parts = [at[i : i + len(members)] for i in range(0, len(at), len(members))]
            seen = {tuple(page.tokens[i] for i in part) for part in parts}
            if len(seen) > 1 or any(set(s) != members for s in seen):
                orders[k].add(None)
                seen = set()
                parts = []
            orders[k] |= seen
            spans[k, n] = parts
    good, around = [], defaultdict(set)
    for n in range(len(pages)):
        kept = []  # a class goes where it straddles a token of one that stays and began earlier
        for k in sorted((k for k in range(len(classes)) if spans[k, n]), key=lambda k: spans[k, n][0][0]):
            if any(q[0] < part[0] and any(part[0] < i < part[-1] for i in q) for part in spans[k, n] for other in kept for q in spans[other, n]):
                around[k] = {1, 2}
            else:
                kept.append(k)
        for k in kept:
            for part in spans[k, n]:
                held = [(q[0], other, sum(i < part[0] for i in q)) for other in kept if other != k for q in spans[other, n] if q[0] < part[0] and part[-1] < q[-1]]
                around[k].add(max(held)[1:] if held else None)
    for k, members in enumerate(classes):
        if len(orders[k]) == 1 and None not in orders[k] and len(around[k]) == 1:
            good.append(frozenset(html_template._signed(t) for t in members))
    return set(good)


def deduced(df):
    found = {}
    for r in html_template.deduce_templates(keyed(df)).collect():
        classes = defaultdict(set)
        for token, c in zip(r["tokens"], r["classes"]):
            classes[c].add(token)
        found[r["host"]] = {frozenset(c) for c in classes.values()}
    return found


def test_templates_match_plain_ones(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    by_host = defaultdict(list)
    for r in keyed(pages).collect():
        by_host[r["host"]].append(r["html"])
    assert deduced(pages) == {h: c for h, s in by_host.items() if (c := plain_classes(s))}
    # the template is used for every page of a host with three distinct pages
    used = {r["url"]: r["slots"] for r in queries.op9_html_template(spark, sf_dir).collect()}
    large = {h for h, s in by_host.items() if len(set(s)) >= 3}
    assert large and all((n > 0) == (url.split("/")[2] in large) for url, n in used.items())


def test_order_and_nesting(spark):
    swapped = ["<body><h1>A</h1><h2>B</h2><p>x{0}</p></body>", "<body><h2>B</h2><h1>A</h1><p>x{0}</p></body>"]
    lists = "<body><ul><li>{0}<li>b<li>c{0}</ul><div><p>d</p></div></body>"
    wander = ["<body><div class=a>s</div><i></i><p>t{0}</p><p>t</p><div class=b>e</div></body>", "<body><p>t{0}</p><div class=a>s</div><p>t</p><div class=b>e</div></body>"]
    cross = ["<body><div class=a>1</div><div class=b>2</div><div class=a>3</div><div class=b>4</div><p>{0}</p></body>", "<body><div class=a>1</div><div class=b>2</div><p>{0}</p></body>"]
    sets = {"swapped": swapped, "lists": [lists], "wander": wander, "cross": cross}
    pages = [(h, s[i % len(s)].format(i)) for h, s in sets.items() for i in range(6)]
    assert deduced(site(spark, pages)) == {h: c for h in sets if (c := plain_classes([p for g, p in pages if g == h]))}


def test_slots_tell_asides_and_content(spark):
    """A block without a name, in a slot that is an advert elsewhere, goes; one in the slot of articles stays."""
    page = "<body><h1>Site</h1>{ad}<h3>Next</h3>{text}<h2>End</h2></body>"
    pages = [page.format(ad=f"<div class='ad ads n{i}'><p class=n{i}>buy {i}</p></div>", text=f"<article class=n{i}>story {i}</article>") for i in range(9)]
    pages.append(page.format(ad="<div class=x9>buy it</div>", text="<div class=x8>bare story</div>"))
    assert texts(html_template.extract(site(spark, [("h", p) for p in pages]))) == [f"story {i}" for i in range(9)] + ["bare story"]


def test_deep_pages_need_little(spark):
    deep = "<div class=ad-block>" * 50_000 + "text" + "<li><p>" * 20_000 + "</section>" * 20_000
    tracemalloc.start()
    page = html_template.Page(deep)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
    assert len(page.blocks) == 1
    assert texts(html_template.extract(site(spark, [("h", "<div>" * 50_000 + f"text {i}") for i in range(4)]))) == [f"text {i}" for i in range(4)]


def test_what_is_left_out(spark):
    page = """<html><head><title>T</title></head><body><header>Site</header><nav><a>Menu</a></nav><article><h1>A &amp; B&nbsp;&lt;c&gt;</h1>
    <p>One   two<br>three <b>bold</b>!<p>Four<!-- no --><script>x("</p>")</script><div class="ad">Buy</div><div class=comments>Nice</div>
    <form><input><p>Mail</p></form><ul><li>x<li>y</ul></article><aside>Side</aside><footer>Foot</footer></body></html>"""
    assert texts(html_template.extract(site(spark, [("h", page)]))) == ["A & B <c>\nOne two\nthree bold!\nFour\nx\ny"]


def test_edges(spark):
    pages = [("h", None), ("h", ""), ("h", "no markup at all"), ("h", "<p>open <b"), ("h", "<article>" + "<p>long text" * 50_000)]
    df = site(spark, pages).withColumns({"host": F.lit("x"), "key": F.lit(1), "fixed": F.lit(2), "slots": F.lit(3)})
    df = df.union(df.filter("page_id = 2")).union(df.filter("page_id = 2").withColumn("url", F.lit(None).cast("string")))
    got = html_template.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars", "slots"]
    rows = got.collect()
    assert len(rows) == 7 and [r["text"] for r in rows if r["page_id"] in (0, 1)] == ["", ""]
    assert [r["text"] for r in rows if r["page_id"] == 2] == ["no markup at all"] * 3
    assert next(r["n_chars"] for r in rows if r["page_id"] == 4) == 50_000 * len("long text") + 49_999
    assert html_template.extract(df.limit(0)).count() == 0


def test_copies_are_no_support(spark):
    page = "<body><div class=x><p>{0} one</p><p>{0} two</p></div><div class=z>End</div></body>"
    twin = site(spark, [("repeated", page.format("a"))])
    mirrored = site(spark, [("mirror", page.format("b"))] * 4 + [("mirror", page.format("c"))])
    assert texts(html_template.extract(twin.union(twin).union(twin))) == ["a one\na two\nEnd"] * 3
    assert texts(html_template.extract(mirrored)) == ["b one\nb two\nEnd"] * 4 + ["c one\nc two\nEnd"]
    near = [("near", f"<!-- {i} -->" + page.format("d")) for i in range(5)]
    assert texts(html_template.extract(site(spark, near))) == ["d one\nd two\nEnd"] * 5


def test_names_of_what_holds_the_content(spark):
    article = "<body><p>Site</p><div class='has-sidebar'><article class='post share'><h2 id='related-work'>A</h2><div class='alert'>B</div><section id='discussion'>C</section></article></div></body>"
    form = "<body><form id=f><div class=widget><p>all of the text</p></div></form><div class='sidebar-left'>Side</div></body>"
    remarks = "<body><div class=x>Post</div><div class=comments><article><p>a very long remark</p></article></div></body>"
    got = texts(html_template.extract(site(spark, [("a", article), ("b", form), ("c", remarks)])))
    assert got == ["A\nB\nC", "all of the text", "Post"]


def test_all_slots_with_varying_text(spark):
    page = "<body><div class=a>Welcome</div><div class=intro>intro {0}</div><div class=content>start {0}<div class=sub>long middle {0}</div></div><div class=two>end {0}</div></body>"
    got = texts(html_template.extract(site(spark, [("h", page.format(i)) for i in range(5)])))
    assert got == [f"intro {i}\nstart {i}\nlong middle {i}\nend {i}" for i in range(5)]


def test_fixed_text_within_articles(spark):
    page = "<body><article><h1>Title {0}</h1><p>Read our terms</p><p>story {0}</p><p>Tell your friends</p></article></body>"
    pages = [("h", page.format(i)) for i in range(5)] + [("few", page.format(9))]
    got = texts(html_template.extract(site(spark, pages)))
    assert got == [f"Title {i}\nRead our terms\nstory {i}" for i in range(5)] + ["Title 9\nRead our terms\nstory 9\nTell your friends"]


def test_fixed_headings_between_varying_blocks_stay(spark):
    page = "<body><article><p>Notice</p><p>intro {0}</p><h2>Introduction</h2><p>one {0}</p><h2>Method</h2><p>two {0}</p><p>Tell your friends</p></article></body>"
    got = texts(html_template.extract(site(spark, [("h", page.format(i)) for i in range(5)])))
    assert got == [f"intro {i}\nIntroduction\none {i}\nMethod\ntwo {i}" for i in range(5)]


def test_fixed_text_between_articles_goes(spark):
    page = "<body><article><p>a {0}</p><p>Share</p></article><p>More</p><article><p>Lead</p><p>b {0}</p></article></body>"
    got = texts(html_template.extract(site(spark, [("h", page.format(i)) for i in range(5)])))
    assert got == [f"a {i}\nb {i}" for i in range(5)]


def test_what_stays_within_an_article(spark):
    page = """<body><article><p>story {0}</p><aside><p>pull quote {0}</p></aside><figure class="banner"><img><figcaption>caption {0}</figcaption></figure>
    <div class="related"><p>related work {0}</p></div><p>then <math><mi>x</mi></math> holds {0}</p><div class="ad">buy {0}</div><aside><a href=x>other {0}</a></aside>
    <div class="related"><ul><li><a href=y>more of this {0}</a></ul></div><p>end {0}</p></article></body>"""
    want = "story {0}\npull quote {0}\ncaption {0}\nrelated work {0}\nthen\nx\nholds {0}\nend {0}"
    got = texts(html_template.extract(site(spark, [("h", page.format(i)) for i in range(4)] + [("few", page.format(9))])))
    assert [g.replace("\nx\n", "\nx\n") for g in got] == [want.format(i) for i in (0, 1, 2, 3, 9)]


def test_slots_of_links_go_without_a_name(spark):
    page = "<body><div class=c1><p>story {0}</p><p>and more of {0}</p></div><hr><div class=c2><a href=a>other story {0}</a></div><p class=c4>end</p></body>"
    got = texts(html_template.extract(site(spark, [("h", page.format(i)) for i in range(6)])))
    assert got == [f"story {i}\nand more of {i}" for i in range(6)]


def plain_extraction(sources, least_pages=3):
    """Texts of one host's pages with articles: the article's blocks, of which those that are in a valid class go at its edges."""
    fixed = set().union(*plain_classes(sources)) if len(set(sources)) >= least_pages else set()
    found = []
    for source in sources:
        page = html_template.Page(source)
        blocks = [(text, page.tokens[at] in fixed) for text, at, aside, article in page.blocks if article]
        varying = [k for k, (_, still) in enumerate(blocks) if not still]
        kept = blocks[varying[0] : varying[-1] + 1] if varying else blocks
        found.append("\n".join(text for text, _ in kept))
    return found


def test_extraction_matches_a_plain_one(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_template.extract(pages).collect()}
    by_host = defaultdict(list)
    for r in pages.select("page_id", F.regexp_extract("url", html_template.HOST, 1).alias("host"), "html").collect():
        by_host[r["host"]].append((r["page_id"], r["html"]))
    for rows in by_host.values():
        for (page_id, source), text in zip(rows, plain_extraction([s for _, s in rows]), strict=True):
            assert "<article>" in source and got[page_id] == text
