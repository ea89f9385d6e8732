"""HTML extraction on pages of several shapes."""

from leaksieve.llm import htmltext as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>one</a></li><li><a>two</a></li></ul></nav><div class="cookie-notice">Cookies</div>
<article><h1>Head &amp; {0}</h1>{1}</article><aside>side</aside><div id="comments"><p>first!</p></div>
<form><input><label>Mail</label></form><footer>&copy; end</footer></body></html>"""


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, host string, wrapper string")


def test_pages(spark):
    rows, want = [], {}
    for k in range(12):
        body = "".join(f"<p>block {i} of\n  <b>{k}</b>&nbsp;x" + "</p>" * (i % 2) for i in range(k % 5))
        rows.append((k, f"https://a.example/{k}", PAGE.format(k, body), "x", "y", "z"))
        want[k] = "\n".join([f"Head & {k}", *(f"block {i} of {k} x" for i in range(k % 5))])
    rows += [(20, None, None, "", "", ""), (21, "odd", "", "", "", ""), (22, "odd", "plain <text>", "", "", ""), (None, "https://a.example/", "<p>a<br>b<p>c", "", "", "")]
    rows.append(rows[3])
    want |= {20: "", 21: "", 22: "plain", None: "a b\nc"}
    got = h.extract_pages(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id
    assert h.extract_pages(table(spark, rows).where("false")).count() == 0


def test_wrapper_shape():
    streams = []
    for page in ("<ul><li>a<li>b<li>c</ul><p>x</p>", "<ul><li>a</ul><hr><p>y</p>"):
        symbols, _, repeated = h.fold(h.tokenise(page).symbols, 12)
        streams.append((symbols, repeated))
    assert h.expression(h.infer(streams)) == "ul ( li # )+ /ul ( hr )? p # /p"


def test_long_page_is_whole():
    page = "<article>" + "".join(f"<p>w{k}</p>" for k in range(5000)) + "</article>"
    stream = h.tokenise(page)
    symbols, places, _ = h.fold(stream.symbols, 12)
    keep = h._kept(symbols, h.infer([(symbols, [False] * len(symbols))]))
    assert h.main_text(stream, keep, places).split("\n") == [f"w{k}" for k in range(5000)]


def test_adverts_of_changing_classes(spark):
    """Outside parts whose class words differ by page leave the host's article alone."""
    page = "<div class=wrap><h1>T{0}</h1><div class={1}>buy {0}</div><p>one {0}</p><hr><p>two {0}</p></div>"
    kinds = ["promo-summer", "promo-winter", "ad-top", "sidebar-left"]
    rows = [(k, f"https://b.example/{k}", page.format(k, kinds[k % 4]), "", "", "") for k in range(8)]
    got = {r.page_id: r.text for r in h.extract_pages(table(spark, rows)).collect()}
    assert got == {k: f"T{k}\none {k}\ntwo {k}" for k in range(8)}


def texts_of(spark, pages):
    rows = [(k, "https://c.example/x", page, "", "", "") for k, page in enumerate(pages)]
    return [r.text for r in h.extract_pages(table(spark, rows)).orderBy("page_id").collect()]


def test_equal_texts_are_template(spark):
    """What is the same on all pages of a host goes without any word; its order and number of blocks may change."""
    page = "<body><div class=box>Best <b>site</b> of all</div><ul><li>one<li>two</ul><div class=x><h1>H{0}</h1>{1}<p>see {0}</p></div><div>Write to us</div>"
    got = texts_of(spark, [page.format(k, "<blockquote>same</blockquote><hr><i>{0}</i> words".format(k) * (k % 2)) for k in range(9)])
    assert got == ["\n".join([f"H{k}", *["same", f"{k} words"] * (k % 2), f"see {k}"]).replace("same\n", "") for k in range(9)]
    alike = "<div>all</div><p>of it</p>"
    assert texts_of(spark, [alike, alike]) == ["all\nof it"] * 2


def test_words_are_hints(spark):
    around = [
        '<body class="right-sidebar"><div><p>{0}</p></div>',
        '<body><div class="content has-comments"><article><h1>{0}</h1></article><div class=comments>no</div></div>',
        '<body><div class="content has-comments"><h1>{0}</h1><p>more of the text</p><div id=comments>no</div></div><p>end</p>',
        "<body><form><h1>{0}</h1><div class=ad>no</div></form>",
        '<body><div class="a b c d e f g h main"><p>{0}</p></div><div>no</div>',
        '<body><div class=related><article>no</article></div><div><h1>{0}</h1><p>more of the text</p></div>',
    ]
    for page in around:
        for k, text in enumerate(texts_of(spark, [page.format("text %d" % k) for k in range(1)])):
            assert "no" not in text.split() and f"text {k}" in text, page


def test_all_streams_of_a_host_make_its_wrapper(spark):
    """Rare streams are part of it however many are aligned at once."""
    frequent = [f"<body><main><p>News {k}</p></main></body>" for k in range(4)] + [f"<body><h1>Head {k}</h1><p>News {k}</p></body>" for k in range(4)]
    tags = ["blockquote", "pre", "ul", "ol", "dl", "table", "figure", "address", "fieldset", "center"]
    rare = [f"<body><section><p>Call us now</p></section><{t}><h3>Story {t}</h3></{t}><div>Text of {t}</div></body>" for t in tags]
    rows = [(k, "http://one.example/", page) for k, page in enumerate(frequent + rare)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    for most in (2, 64):
        made = h.infer_wrappers(pages, h.WrapperOptions(most_streams=most)).collect()
        assert [r.host for r in made] == ["one.example"]
        assert {t for t in (*tags, "main", "h1") if t in made[0].expression.split()} == {*tags, "main", "h1"}
