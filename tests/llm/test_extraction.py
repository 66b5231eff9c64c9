from __future__ import annotations

import random

import pytest
from haulcast.llm import extraction
from haulcast.llm.extraction import extract_text
from haulcast.llm.page_parse import parse

SHELLS = {
    "semantic": (
        "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p><article>x';</script></head><body>"
        "<header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><!-- <p>no</p> -->"
        "<aside class=sidebar><p>Side {0}</p></aside><article><h1>{1}</h1>{2}<div class='share-buttons'>Share this</div></article>"
        "<section id=comments><h2>Comments</h2><p>reader says {0}</p></section><form><p>Sign up</p><button>Go</button></form>"
        "<footer>&copy; us</footer></body></html>"
    ),
    "plain": (
        "<html><body><div class=top><a href=/>Home</a> <a href=/x>News</a></div><div>Welcome to our site</div><div class=body><h2>{1}</h2>{2}"
        "</div><div class='ad box'>Buy {0}</div><div>All rights reserved by the owners of this place</div></body></html>"
    ),
}


def pages(kind, n):
    draw = random.Random(5)
    out = []
    for i in range(n):
        blocks = [" ".join(f"w{draw.randrange(999)}" for _ in range(draw.randrange(5, 40))) for _ in range(draw.randrange(1, 6))]
        body = "".join(f"<p>{b}</p>\n" if k % 2 else f"<p>{b}<br>more &amp; <b>mo</b>re" for k, b in enumerate(blocks))
        text = " ".join(b if k % 2 else f"{b} more & more" for k, b in enumerate(blocks))
        out.append((i, f"http://{kind}.example/p{i}", SHELLS[kind].format(f"x{i}", f"Title {i}", body), f"Title {i} {text}"))
    return out


@pytest.mark.parametrize("kind", sorted(SHELLS))
@pytest.mark.parametrize("n", [1, 12])
def test_main_text(spark, kind, n):
    if kind == "plain" and n == 1:
        pytest.skip("one page has no template to deduce")
    rows = pages(kind, n)
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(df).collect()} == {r[0]: r[3] for r in rows}


def test_copies_of_an_article_are_no_template(spark):
    rows = pages("semantic", 1) * 9
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    out = extract_text(df).collect()
    assert len(out) == 9 and {r.text for r in out} == {rows[0][3]}


def test_edges(spark):
    rows = [
        (1, None, None),
        (2, "", ""),
        (3, "http://h/", "no markup &lt;at&gt; all"),
        (4, "http://h/", "<article><p>cut of"),
        (5, "http://h/", "<article><p>cut <a hre"),
        (6, "http://h/", "<p>a</p><script>never closed <p>b</p>"),
        (7, "http://h/", "<article>a<p>b<div>c</div>d &#233; &nbsp; e</article>" + "<p>x</p>" * 3000),
        (None, "http://h/", "<main><ul><li>one<li>two</ul></main>"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = {r.page_id: r.text for r in extract_text(df).collect()}
    assert out == {
        1: "", 2: "", 3: "no markup <at> all", 4: "cut of", 5: "cut", 6: "a", 7: "a b c d é e", None: "one two"
    }
    assert extract_text(df.limit(0)).collect() == []


def test_tokens_know_their_place():
    one, two = parse("<div><p>a</p></div>"), parse("<div class=x><p>a</p></div>")
    assert len(one.tokens) == len(two.tokens) and not set(one.tokens) & set(two.tokens)


@pytest.mark.parametrize(
    "html",
    [
        "<main class='has-sidebar'>{}</main>",
        "<div class='content no-sidebar'><article>{}</article></div>",
        "<div class='layout sidebar-right'><main>{}</main></div>",
        "<article class='post comments-open'>{}</article>",
        "<article id='legal-reform'>{}</article>",
        "<div class='post comments-open'><article>{}</article></div>",
    ],
)
def test_names_of_what_holds_the_article_do_not_reject_it(html):
    outside = "<div class=comments><article class=comment-body>said</article></div><article class=comment>so</article><nav><main>m</main></nav>"
    page = parse(html.format("<p>one<div class='share-buttons'>x</div><p>two") + outside)
    assert [b.text for b in page.blocks if b.main and not b.outside] == ["one", "two"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>if 5 < 6 then all <p", "if 5 < 6 then all"),
        ("a < b, and b < c: so it goes", "a < b, and b < c: so it goes"),
        ("<p>cut <a href='http", "cut"),
    ],
)
def test_text_after_a_stray_bracket_stays(html, text):
    assert [b.text for b in parse(html).blocks] == [text]


def test_short_slots_and_links_between_text_stay(spark):
    draw = random.Random(8)

    def words(n):
        return " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))

    rows, texts = [], {}
    for i in range(8):
        lead, link, body, end = words(20), words(6), words(900), words(3)
        html = (
            f"<div class=top><a href=/>{words(2)}</a></div><h1>T{i}</h1><p>{lead}</p><div class=ad>Buy</div><p>{body}</p>"
            f"<p><a href=/x>{link}</a></p><p>{end}</p><hr><h3>Read {i}</h3><div><a href=/y>{words(4)}</a></div>"
        )
        rows.append((i, "http://plain.example/", f"<html><body>{html}</body></html>"))
        texts[i] = f"T{i} {lead} {body} {link} {end}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(df).collect()} == texts


def article_of(html):
    return " / ".join(b.text for b in parse(html).blocks if b.main and not b.outside)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<form id=aspnetForm><article><p>one</p></article></form>", "one"),
        ("<article><header><h1>Title</h1><p>Lead</p></header><p>Body</p></article>", "Title / Lead / Body"),
        ("<main><div class='entry header'><h1>Title</h1></div><p>Body</p></main>", "Title / Body"),
        ("<article><div class=notice-board>a</div><div class=related-work>b</div><div class=login-guide-content>c</div></article>", "a / b / c"),
        ("<div class=related-work><article><p>one</p></article></div>", "one"),
        ("<article><p>one</p><div class=related-posts>x</div><div class='share-buttons'>y</div><div class=notice>z</div></article>", "one"),
        ("<article><p>one</p><form><p>Sign up</p><input><button>Go</button></form><p>two</p></article>", "one / two"),
        ("<article>super<wbr>long <x-term>wo</x-term>rd<img src=a>s and <nobr>more</nobr></article>", "superlong words and more"),
    ],
)
def test_article_text_is_kept(html, text):
    assert article_of(html) == text


def test_a_form_around_a_page_without_article(spark):
    draw = random.Random(3)
    rows, texts = [], {}
    for i in range(6):
        body = " ".join(f"w{draw.randrange(10**6)}" for _ in range(30))
        html = f"<form id=f><nav><a href=/>Home</a></nav><h1>T{i}</h1><div>{body}</div></form><form><p>Sign up {i}</p><input></form>"
        rows.append((i, "http://asp.example/", f"<html><body>{html}</body></html>"))
        texts[i] = f"T{i} {body}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(df).collect()} == texts


def test_text_that_pages_of_a_host_share_stays_in_their_articles(spark):
    """Whatever its share of the article; a last paragraph with links in it stays too."""
    rows, texts = [], {}
    for i in range(6):
        own = f"Number {i}. " * (1 + 20 * (i % 2))
        shared = "The same paragraph stands here on every page. " * 5
        rows.append((i, "http://same.example/", f"<article><p>{own}</p><p>{shared}</p><p>See <a href=/a>a much longer text of a link</a></p></article>"))
        texts[i] = " ".join(f"{own} {shared} See a much longer text of a link".split())
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(df).collect()} == texts


def deduced_plainly(htmls):
    """Template classes of one host from whole occurrence vectors: {tokens: once} of those that keep their order."""
    sequences = [parse(h).tokens for h in htmls]
    classes = {}
    for token in {t for s in sequences for t in s}:
        classes.setdefault(tuple(s.count(token) for s in sequences), set()).add(token)
    out = {}
    for vector, tokens in classes.items():
        on = sum(n > 0 for n in vector)
        if on < 2 or on < len(htmls) / 2 or len(tokens) < 2:
            continue
        orders = set()
        for s in sequences:
            mine = [t for t in s if t in tokens]
            rounds = {tuple(mine[i : i + len(tokens)]) for i in range(0, len(mine), len(tokens))}
            orders |= rounds if all(set(r) == tokens and len(r) == len(tokens) for r in rounds) else {(), (0,)}
        if len(orders) == 1:
            out[tuple(sorted(tokens))] = set(vector) == {1}
    return out


def test_classes_equal_a_plain_deduction_over_one_host(spark):
    draw = random.Random(4)
    htmls = []
    for i in range(9):
        items = "".join(f"<li><a href=/{k}>menu {k}</a><i>x</i></li>" for k in range(3))
        extra = "<div class=note><p>now and then</p></div>" if i % 3 else ""
        pairs = "".join(f"<dl><dt>name {draw.random()}</dt><dd>always</dd></dl>" for _ in range(1 + i % 2))
        turned = "<b>one</b><p>first</p><p>second</p>" if i % 2 else "<b>one</b><p>second</p><p>first</p>"
        turned = turned if i else "<b>none</b>"
        htmls.append(f"<body><ul>{items}</ul><h1>T {i}</h1>{extra}<section>{turned}</section>{pairs}<p>{draw.random()}</p><footer>f</footer></body>")
    want = deduced_plainly(htmls)
    assert len(want) >= 3 and set(want.values()) == {True, False}
    df = spark.createDataFrame([("h", i, h) for i, h in enumerate(htmls)], "host string, mark long, html string").repartition(3)
    got = extraction.valid_classes(df, extraction.candidate_classes(df)).collect()
    assert {tuple(sorted(r.tokens)): r.once for r in got} == want


def test_a_class_that_crosses_a_larger_one_by_chance_is_no_template(spark):
    """Ordered classes A B and S T: around other tokens of the template on other pages, and always around the same ones."""
    htmls = []
    for i in range(8):
        turned = "A f0 f1 B A f2 B" if i % 2 else "A f0 B f1 A f2 B"
        blocks = [f"<div class={b if b[1:] else 'x'}>{b}</div>" for b in f"{turned} S g0 T S g1 T S g2 T S g3 T g4".split()]
        htmls.append(f"<body>{''.join(blocks)}<p>{i}</p></body>")
    df = spark.createDataFrame([("h", i, h) for i, h in enumerate(htmls)], "host string, mark long, html string").repartition(3)
    page = parse(htmls[0])
    text = {page.tokens[b.token]: b.text for b in page.blocks}
    got = [sorted(text[t] for t in r.tokens if t in text) for r in extraction.valid_classes(df, extraction.candidate_classes(df)).collect()]
    assert sorted(t for t in got if t) == [["S", "T"], ["f0", "f1", "f2", "g0", "g1", "g2", "g3", "g4"]]
