from quillspark.llm import site_style as S


def test_article_without_what_surrounds_it():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li>menu</li></ul></nav><div class="cookie-notice">cookies</div><main><article class="post"><header><h1>A &amp; B</h1></header>
    <p>One <b>bold</b>
       line&nbsp;here<br>after</p><script>var x = "</p><p>no</p>";</script><div class="ad">buy</div><p>Two<p>Three<ul><li>x<li>y</ul>
    <form><input><label>f</label></form><aside>side</aside></article><section id="comments"><article class="comment"><p>reader</p></article></section></main>
    <footer>foot</footer></body></html>"""
    assert S.extract(page) == ["A & B", "One bold line here after", "Two", "Three", "x", "y"]


def test_malformed_and_odd_markup():
    assert S.extract("") == [] and S.extract(None) == [] and S.extract("   ") == []
    assert S.extract("plain &lt;text&gt; &#233; &unknown;") == ["plain <text> é &unknown;"]
    assert S.extract("<p>a<!-- gone <p>b -->c") == ["ac"]
    assert S.extract("<p>a <!-- never closed <p>b") == ["a"]
    assert S.extract("1 < 2 <p>and <i>more") == ["1 < 2", "and more"]
    assert S.extract("<article><p><b>x<br><p>y</p></article>") == ["x", "y"]
    assert S.extract("<script>never closed") == []
    assert S.extract("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert S.extract('<div title="a > b">t</div>') == ["t"]
    for page in ("<div>" * 20000 + "deep" + "</div>" * 20000, "<div><b>" * 20000 + "deep", "</x>" * 20000 + "<p>deep"):
        assert S.extract(page) == ["deep"]
        assert len(S.observations(page)) > 0


def test_layouts_that_look_like_something_else():
    post = "<div class='post'><h1>Head</h1><p>Text one</p><p>Text two</p></div>"
    want = ["Head", "Text one", "Text two"]
    assert S.extract(f'<body><nav>n</nav><div class="layout with-sidebar">{post}</div><div class="main-sidebar">s</div></body>') == want
    assert S.extract(f'<body><form id="aspnetForm"><nav>n</nav>{post}<footer>f</footer></form></body>') == want
    inner = '<div class="search-results"><p>a</p></div><p class="alert-level">b</p><section id="related-work"><p>c</p></section><div class="related-posts">d</div><div class="ad-slot-3">e</div>'
    assert S.extract(f"<body><article><h1>Head</h1>{inner}</article></body>") == ["Head", "a", "b", "c"]
    assert S.extract(f"<body><header>top</header>{post}<footer>f</footer></body>") == want
    assert S.extract('<body><div class="sidebar"><p>all there is</p></div></body>') == ["all there is"]


def pages(spark, n=20):
    rows = []
    for i in range(n):
        rows.append((i, f"https://h.example.org/p{i}", f'<body><div class="x1">same words on all</div><div class="x2"><p>text number {i}</p><p>and more {i * i}</p></div><div class="x3">{["by us", "by them"][i % 2]}</div></body>'))
    rows.append((100, "http://other.example/", '<body><div class="x1">only here</div></body>'))
    rows.append((101, None, None))
    rows.append((102, "http://h.example.org:80/z", ""))
    return spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, _low string")


def test_tree_removes_what_a_site_repeats(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in S.query(pages(spark)).collect()}
    assert len(got) == 23
    assert got[3][0] == "text number 3\n\nand more 9"
    assert got[100] == ("only here", 9) and got[101] == ("", 0) and got[102] == ("", 0)


def test_few_pages_are_left_alone(spark):
    got = {r.page_id: r.text for r in S.query(pages(spark, 2)).collect()}
    assert got[1] == "same words on all\n\ntext number 1\n\nand more 1\n\nby them"


def brute_tree(htmls):
    """path -> (look, read, weight) of one host's distinct pages, in plain Python."""
    import math
    from collections import Counter, defaultdict

    distinct = list(dict.fromkeys(htmls))
    sequences, texts, shown = defaultdict(Counter), defaultdict(Counter), Counter()
    for page in distinct:
        rows = {o[:6] for o in S.observations(page)}
        for path in {r[0] for r in rows}:
            shown[path] += 1
        for path, _, _, kind, feature, words in rows:
            (sequences if kind == 0 else texts)[path][(feature, words)] += 1
    out = {}
    for path, n in shown.items():
        if 10 * n < len(distinct):
            continue
        look = read = None
        if sequences[path]:
            m = sum(sequences[path].values())
            look = -sum(c / m * math.log(c / m) for c in sequences[path].values()) / math.log(max(m, 2))
        weight = sum(w * c * (1 - math.log(c) / math.log(len(distinct))) for (_, w), c in texts[path].items())
        if texts[path]:
            read = weight / sum(w * c for (_, w), c in texts[path].items())
        out[path] = (look, read, weight / len(distinct))
    return out


def test_importance_against_brute_force(spark):
    from pyspark.sql import functions as F

    table = pages(spark)
    src = table.union(table).select("page_id", F.xxhash64(S.host(F.col("url"))).alias("_host"), F.expr("coalesce(html, '')").alias("_html"))
    tree = [r for r in S.style_tree(src).collect() if r.role != S.RARE]
    want = brute_tree([r.html or "" for r in table.collect() if r.url and "h.example" in r.url])
    assert {r.path for r in tree} == set(want) and len({r._host for r in tree}) == 1
    for r in tree:
        for x, y in zip((r["look"], r["read"], r["weight"]), want[r.path]):
            assert (x is None and y is None) or abs(x - y) < 1e-9


def shop(i, article, extra=""):
    menu = "".join(f"<li>m{i}{k}</li>" for k in range(5))
    return f'<body><div class="x"><ul>{menu}</ul></div><div class="y">buy this {i} now</div><div class="z">{article}</div><div class="w">mail {i} us</div>{extra}</body>'


def test_tree_decides_without_roles(spark):
    rows = []
    for i in range(12):
        article = f"<h1>Head {i}</h1>" + "".join(f"<p>{' '.join(f'w{i}_{j}_{k}' for k in range(20))}</p>" for j in range(1 + i % 4))
        rows.append((i, "http://shop.example/", shop(i, article)))
    got = {r.page_id: r.text for r in S.query(spark.createDataFrame(rows, "page_id long, url string, html string"), roles=False).collect()}
    for i in range(12):
        assert got[i].startswith(f"Head {i}\n\nw{i}_0_0") and "buy" not in got[i] and "m" not in got[i].split() and "mail" not in got[i]


def test_tree_keeps_a_form_round_the_page_and_unique_ids(spark):
    rows = []
    for i in range(12):
        name = "".join(chr(97 + int(c)) for c in str(1000 + i))
        text = " ".join(f"t{i}_{k}" for k in range(60))
        rows.append((i, "http://f.example/", f'<body><form id="aspnetForm"><nav>a{i} b{i}</nav><div id="{name}"><h1>H{i}</h1><p>{text}</p></div><footer>c{i}</footer></form></body>'))
    got = {r.page_id: r.text for r in S.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "H3\n\n" + " ".join(f"t3_{k}" for k in range(60))


def test_driver_pages(spark):
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = table.collect()
    want = {}
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in S.query(table).collect()} == want


def test_tree_alone_on_driver_pages(spark):
    """Without any role the tree still takes menus, adverts and footers from the pages of hosts that have one."""
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    right = {r.page_id: r.n_chars for r in S.query(table).collect()}
    tree = {r.page_id: r.n_chars for r in S.query(table, roles=False).collect()}
    assert sum(tree[p] == right[p] for p in right) > 0.95 * len(right)


def test_repeated_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    table = pages(spark).withColumns({"_host": F.lit("x"), "text": F.lit(1), "_spared": F.lit(None)})
    got = sorted((r.page_id, r.text) for r in S.query(table.union(table)).collect())
    assert got == sorted(2 * [(r.page_id, r.text) for r in S.query(pages(spark)).collect()])


def test_empty_table(spark):
    assert S.query(pages(spark).limit(0)).count() == 0


def test_broken_markup_takes_linear_time():
    import time

    n = 1 << 20
    broken = ["<p", '<a b="', "<a b='", "<!--", "<!", "<?", "<script>", "<script></script", "&", "<", "</", "</p", "<p ", "<p/", '<a "<b \'', "&#", "&am", "<title>", "<p><div ", "<b x=1"]
    for piece in broken:
        page = piece * (n // len(piece))
        start = time.process_time()
        S.extract(page)
        S.observations(page)
        assert time.process_time() - start < 20, piece
    deep = "<li><ul>" + "<b>" * 50_000 + "<li></li>" * 50_000 + "<p>x"
    start = time.process_time()
    assert S.extract(deep)[-1] == "x" and time.process_time() - start < 20


def test_broken_tags():
    assert S.extract("<a href='x>foo</a><p>bar") == ["foo", "bar"]
    assert S.extract('<p>one <a href="x') == ["one"]
    assert S.extract("<p>if a<b and b<c <i>then</i>") == ["if a<b and b<c then"]
    assert S.extract("<p>a<script>x</script >b<style>y</style\n>c") == ["abc"]
    assert S.extract("<script>a</scripts></script>b") == ["b"]


def test_formulas_are_text():
    assert S.extract("<p>E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><semantics><annotation>TeX</annotation></semantics></math> end") == ["E = mc2 end"]


def test_parts_named_after_the_article():
    for name in ("article-notice", "entry-footer", "article-footer", "wp-block-navigation", "articleShare"):
        assert S.extract(f'<article><h1>A</h1><p>text</p><div class="{name}">x</div></article>') == ["A", "text"]
    assert S.extract('<body><div class="entry-header"><h1>Title</h1></div><div class="entry-content"><p>text</p></div><div class="entry-footer">x</div></body>') == ["Title", "text"]


def test_an_article_on_many_pages_stays(spark):
    article = "<article><h1>Notice of terms</h1><p>All pages carry this legal article text.</p><div class='share'>Share</div></article>"
    rows = [(i, f"http://mirror.example/{i}", f"<body><nav>menu</nav>{article}<div>n{i}</div></body>") for i in range(20)]
    got = S.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.startswith("Notice of terms\n\nAll pages carry this legal article text.") and "Share" not in r.text and "menu" not in r.text for r in got)
