"""Pages that once lost text, kept too much of it, or took too long."""

import random
import time

import pytest

from leaksieve.llm import htmltext as h


def texts_of(spark, pages, host="c.example"):
    rows = [(k, f"https://{host}/{k}", page) for k, page in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    return [r.text for r in h.extract_pages(frame).orderBy("page_id").collect()]


def test_recurring_headings_stay(spark):
    page = "<body><div>Welcome all</div>{0}<h1>R{2}</h1><h2>Ingredients</h2><p>take {2}</p><h2>Method</h2><p>stir {2}</p>{1}<div>Write to us</div></body>"
    want = [f"R{k}\nIngredients\ntake {k}\nMethod\nstir {k}" for k in range(6)]
    for begin, end in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="wrap">', "</div>")):
        assert texts_of(spark, [page.format(begin, end, k) for k in range(6)]) == want


def test_a_banner_with_one_exception_goes(spark):
    page = "<body><div><p>{0}</p></div><div><h1>T{1}</h1><p>text {1}</p></div></body>"
    pages = [page.format("Now open all day" if k != 7 else "Closed today", k) for k in range(30)]
    want = [f"T{k}\ntext {k}" for k in range(30)]
    want[7] = "Closed today\n" + want[7]
    assert texts_of(spark, pages) == want


def test_a_banner_on_pages_of_many_shapes_goes(spark):
    rng = random.Random(2)
    pages, want = [], []
    for k in range(90):  # more shapes than streams of a wrapper
        body, lines = "", []
        for i in range(rng.randint(1, 12)):
            tag = rng.choice(["p", "blockquote", "h3", "pre", "div"])
            body += f"<{tag}>part {i} of {k}</{tag}>"
            lines.append(f"part {i} of {k}")
        pages.append(f"<body><div class=top><span>The best shop in town</span></div><div><h1>H{k}</h1>{body}</div><div><b>Call us</b> now</div></body>")
        want.append("\n".join([f"H{k}", *lines]))
    got = texts_of(spark, pages)
    assert sum(a == b for a, b in zip(got, want)) >= 88


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p class="x>Hello</p>', "Hello"),
        ('<p class="x>Hello</p><a href="y">link</a>', "Hello\nlink"),
        ("<p title='a > b'>Hello</p>", "Hello"),
        ('<p title="a > b" class=x>Hello</p>', "Hello"),
        ('<a href="x"class="y">Hello</a>', "Hello"),
        ("<p class='it>Hello</p><p>it's <b>so</b>", "Hello\nit's so"),
        ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_open_quotes(spark, page, want):
    assert texts_of(spark, [page]) == [want]


def test_containers_with_listed_words(spark):
    article = "<p>first long paragraph of the article</p><p>and a second one that goes on</p>"
    for name in ("content search-results", "share-wrapper", "page header", "related post"):
        assert texts_of(spark, [f'<body><div class="{name}">{article}</div><div><p>x</p></div></body>'])[0].startswith("first long")
    # what is listed and no container still goes
    assert texts_of(spark, [f"<body><div>{article}</div><div class=related><p>more to read</p></div><div class='search'>find</div>"])[0].endswith("goes on")
    comments = "<div class='comments content'>" + "<p>a long comment by a reader of the page</p>" * 9 + "</div>"
    assert "comment" not in texts_of(spark, [f"<body><div><p>short text</p></div>{comments}</body>"])[0]


def test_long_pages_align_in_time():
    rng = random.Random(4)

    def page(k):
        return "<body>" + "".join(f"<{t}>text {i} {k}</{t}>" for i, t in enumerate(rng.choices(["p", "h2", "div", "pre", "li", "td"], k=4000))) + "<div>the end of all</div></body>"

    one, two = (h._folded(page(k), h.WrapperOptions()) for k in range(2))
    begin = time.perf_counter()
    wrapper = h.infer([(x.symbols, x.repeated, x.marks, x.hashes, [1] * len(x.symbols), 1, 1) for x in (one, two)])
    h._fixed(one.symbols, one.marks, wrapper, one.hashes)
    assert time.perf_counter() - begin < 2 and len(wrapper["symbols"]) <= len(one.symbols) + len(two.symbols)


def test_alignment_is_a_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        one, two = ([(rng.choice("abcdefgh#"), 1) for _ in range(rng.randint(0, 120))] for _ in range(2))
        hashes = [[rng.randint(1, 40) if s == "#" else 0 for s, _ in x] for x in (one, two)]
        pairs = h.align(one, two, *hashes)
        assert all(one[i] == two[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    same = [(s, 1) for s in "abcab#c#"] * 50
    assert len(h.align(same, same, [0] * 400, [0] * 400)) == 400


def truth(rng, k, kind):
    """A page of a shape, with its article as it should come out."""
    paragraphs = [" ".join(rng.choices("the quick brown fox jumps over lazy dogs and cats in town".split(), k=rng.randint(4, 40))) + f" {k}." for _ in range(rng.randint(1, 7))]
    blocks = [f"Title {k}", *paragraphs]
    body = f"<h1>Title {k}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    nav = "<nav><a href=/>Home</a> <a href=/a>All</a></nav>"
    menu = "<ul><li>Home</li><li>Shop</li><li>About</li></ul>"
    foot = "<div class=foot><p>All rights reserved</p></div>"
    side = f"<div class='sidebar'><h3>Latest</h3><p>story {rng.randint(0, 99)}</p></div>"
    said = "<div id=comments>" + "".join(f"<p>comment {rng.randint(0, 9)}</p>" for _ in range(rng.randint(0, 5))) + "</div>"
    shapes = [
        f"{nav}<article>{body}</article>{side}{said}<footer>f</footer>",
        f"<header>Site</header>{menu}<div class=main>{body}</div>{foot}{said}",
        f"<div><div>Our shop</div>{menu}</div><div class=story>{body}</div>{side}{foot}",
        f"<div class=cookie-notice>We use cookies</div>{nav}<main>{body}</main><form><input><label>Mail</label></form>{said}",
    ]
    return f"<html><head><title>x</title></head><body>{shapes[kind]}</body></html>", "\n".join(blocks)


def test_against_known_articles(spark):
    """Recall and precision by words over pages of several hosts."""
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(160):
        page, text = truth(rng, k, k % 4)
        rows.append((k, f"https://h{k % 4}.example/{k}", page))
        want[k] = text
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    hit = got_words = want_words = 0
    for r in h.extract_pages(frame).collect():
        got, own = r.text.split(), want[r.page_id].split()
        both = sum(min(got.count(w), own.count(w)) for w in set(own))
        hit, got_words, want_words = hit + both, got_words + len(got), want_words + len(own)
    assert hit / want_words > 0.99 and hit / got_words > 0.97
