from lodestrata.llm import html_extract as m

PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li>B</ul></nav><!-- ad {n} -->
<div class="ad">Buy {n}</div><aside>Side</aside><article id="post-{n}"><h1>Title {n}</h1><p><b>First&amp;   &eacute; {n}<br><p>Second {n} &lt;b&gt; line
goes on<div class="share">Share this</div><ul><li>one {n}<li>two {n}</ul><form><input>Search</form></article>
<section id="comments"><p>Reader {n}</p></section><footer>&copy; all {n}</footer></body></html>"""
SCHEMA = "page_id long, url string, html string"


def texts(sources):
    return m.extract_group(sources)[0]


def test_article_only(spark):
    rows = [(n, "https://Host.example/x", PAGE.format(n=n)) for n in range(5)] + [(10, None, None), (11, "bad", ""), (12, "http://lone/", "plain & text <p>x"), (1, "https://host.example/x", PAGE.format(n=1))]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS text", "1 AS host", "2 AS part", "3 AS n_chars")
    got = {r.page_id: r for r in m.extract_pages(pages).collect()}
    assert len(got) == 8 and m.extract_pages(pages).count() == 9
    for n in range(5):
        assert got[n].text == f"Title {n}\nFirst& é {n}\nSecond {n} <b> line goes on\none {n}\ntwo {n}"
        assert got[n].n_chars == len(got[n].text)
    assert got[10].text == "" and got[11].text == "" and got[12].text == "plain & text\nx"
    assert m.extract_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_class_name_inside_the_article_drops_prose():
    inside = '<h2 id="search">Search {n}</h2><section id="side-effects"><p>Effects {n}</p></section><p class="alert">Mind {n}</p><section class="related work"><p>Others {n}</p></section><details class="notice"><p>More {n}</p></details><fieldset><p>Set {n}</p></fieldset>'
    pages = [f"<body><nav><a href=x>menu {n}</a></nav><article><h1>T {n}</h1>{inside.format(n=n)}</article><footer>f {n}</footer></body>" for n in range(6)]
    assert texts(pages)[3] == "T 3\nSearch 3\nEffects 3\nMind 3\nOthers 3\nMore 3\nSet 3"


def test_the_template_decides(monkeypatch):
    pages = [PAGE.format(n=n) for n in range(8)]
    whole = texts(pages)
    monkeypatch.setattr(m, "deduce", lambda pages, paths: m.Template(paths))
    bare = texts(pages)
    assert all(a != b and "Reader" in b and "Buy" in b for a, b in zip(whole, bare))


def test_equal_text_inside_the_article_is_template():
    pages = [f"<body><article><h1>T {n}</h1><p>Read our terms</p>{'<p>x %d</p>' % n * (n + 1)}</article></body>" for n in range(6)]
    assert texts(pages)[2] == "T 2\nx 2\nx 2\nx 2"


def test_no_article_tag():
    page = "<body><p>Site menu</p><div class=top><a href=a>go {n}</a> <a href=b>on {n}</a></div><div><h1>Head {n}</h1><p>body {n} words and more of them than anywhere</p></div><p>All rights</p></body>"
    got = texts([page.format(n=n) for n in range(6)])
    assert got == [f"Head {n}\nbody {n} words and more of them than anywhere" for n in range(6)]


def test_two_layouts_on_one_host():
    a = "<body><nav>m {n}</nav><article class=a><p>first {n}</p></article></body>"
    b = "<body><div class=menu>m {n}</div><main><p>second {n}</p></main><footer>f</footer></body>"
    got = texts([(a if n % 2 else b).format(n=n) for n in range(12)])
    assert got == [f"{'first' if n % 2 else 'second'} {n}" for n in range(12)]


def test_classes_and_nesting():
    paths = m.Paths()
    pages = [m.Page(f"<body><ul>{f'<li><a>x {n}</a></li>' * (n + 2)}</ul><p>y {n}</p></body>", paths) for n in range(5)]
    t = m.deduce(pages, paths)
    by = {}
    for p, c in t.elements.items():
        by.setdefault(c, set()).add(p)
    body, li = t.elements[1], t.elements[3]
    assert len(by) == 2 and len(by[body]) == 4 and len(by[li]) == 2 and t.nested[li] == body
    # two elements of one vector in no fixed order are no class
    paths = m.Paths()
    mixed = [m.Page("<body>" + "".join(f"<{x}>z {n}</{x}>" for x in (("div", "p") if n % 2 else ("p", "div"))) + "</body>", paths) for n in range(6)]
    assert not {2, 3} & set(m.deduce(mixed, paths).elements)


def test_cut_pages_and_references():
    one = lambda s: texts([s])[0]
    assert one("<article><p>a &am") == "a &am"
    assert one("<article><p>a<p cla") == "a"
    assert one("<article><p>x &amp;copy; &#233;&nbsp;y") == "x &copy; é y"
    assert one("<div class=ad>never closed<article><p>kept</article>") == "kept"
    assert one("<article>" + "<p>z</p>" * 20000).count("\n") == 19999


def test_long_groups_and_partitions_change_nothing(spark, monkeypatch):
    rows = [(n, f"http://h{n % 2}.example/{n}", PAGE.format(n=n)) for n in range(60)]
    pages = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(m, "GROUP", 8)
    a = sorted(map(tuple, m.extract_pages(pages.repartition(2)).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    b = sorted(map(tuple, m.extract_pages(pages.repartition(7)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b and len(a) == 60 and all("Title" in r[2] and "Reader" not in r[2] for r in a)
    whole = texts([r[2] for r in rows])
    monkeypatch.setattr(m, "HELD_BYTES", 0)
    assert texts([r[2] for r in rows]) == whole
