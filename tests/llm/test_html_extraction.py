import json
import random

import pytest

from tidemark.llm import html_extraction as hx

FRAME = '<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>%s<aside>More</aside><footer>&copy; x</footer></body></html>'


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        (FRAME % "<article><h1>A &lt; B</h1><p>one\n two<br>three</p><p>four</article>", "A < B\none two three\nfour"),
        (FRAME % '<main><p>x<script>var a="</p>";</script> y</p><div class="comments"><p>rude</p></div><form>q</form></main>', "x y"),
        (FRAME % '<div><p>no article</p><div class="cookie-notice">We use</div><div id="ad-1">Buy</div></div>', "no article"),
        (FRAME % "<article><header><h1>Title</h1></header><ul><li>one<li>two</ul><table><tr><td>c</td></tr></table></article>", "Title\none\ntwo\nc"),
        ("<article><p><b>bold<br><p>next</p><!-- gone --><p>&eacute;&#233;&#xe9; a&nbsp;b</p>", "bold\nnext\nééé a b"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<p>a<p>b<noscript>js</noscript><div hidden>h</div><p class='share-bar'>s</p>", "a\nb"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ],
)
def test_extract(page, text):
    assert hx.extract(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ('<article><p style="overflow:hidden">visible</p></article>', "visible"),
        ('<article><p aria-hidden="false">visible</p></article>', "visible"),
        ('<article><h2 class="related-work">Work</h2></article>', "Work"),
        ('<article><p class="share-price">5.20</p></article>', "5.20"),
        ('<article><p class="reply-letter">Dear</p></article>', "Dear"),
        ('<div class="comments-off"><article>in</article></div>', "in"),
        ('<article>a<div class="comments-area">c</div><p style="color:red; DISPLAY : none">h</p><p aria-hidden=true>h</p><p hidden>h</p></article>', "a"),
        ('<div class="site-header">Site</div><div class="post-header">Title</div><p data-class="ad" title="hidden ad">x</p>', "Title\nx"),
        ('<article><ol class="commentlist"><li>x</ol><div id="comments"><article>rude</article></div></article>', "x"),
    ],
)
def test_roles_are_exact(page, text):
    assert hx.extract(page) == text


def test_nesting_takes_linear_time():
    deep = "<p>top</p>" + "<span><div>" * 20_000 + "<p>low</p>"
    assert hx.extract(deep) == "top\nlow"


def test_wrapper_finds_slots_optionals_and_repeats():
    page = lambda title, items, extra="": f"<body><h1>{title}</h1><ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>{extra}<p>Same words</p></body>"
    w = hx.infer([page("One", "ab"), page("Two", "abcd"), page("Three", "x", "<div>Note</div>")])
    assert w.expression() == "<html><h1>#</h1><ul><li>#+</li>+</ul><div>'Note'</div>?<p>'Same words'</p></html>"
    faq = lambda n, last="": "<div>Menu</div><dl>" + "".join(f"<dt>q{n}{k}</dt><dd>a{n}{k}</dd>" for k in range(n)) + "</dl>" + last
    w = hx.infer([faq(3), faq(1), faq(2, "<p>end</p>")])
    assert w.expression() == "<html><div>'Menu'</div><dl>(<dt>#+</dt><dd>#+</dd>)+</dl><p>'end'</p>?</html>"
    assert hx.Node.of(w.plain()).expression() == w.expression()


def test_expressions_stay_small():
    rng = random.Random(4)
    kinds = ["p", "ul", "table", "h2", "blockquote", "div", "pre"]
    w = hx.infer(["<article>" + "".join(f"<{k}>{rng.random()}</{k}>" for k in rng.choices(kinds, k=60)) + "</article>" for _ in range(200)])
    assert len(str(w.plain())) < 2_000 and "(?)" in str(w.plain())


def test_shared_boilerplate_outside_an_article_goes():
    page = lambda body: f"<body><div>Welcome to our site</div><div><p>{body}</p></div><div>All rights reserved</div></body>"
    w = hx.infer([page("first text"), page("second text")])
    assert hx.extract(page("third text"), w) == "third text" and hx.extract(page("third text")).startswith("Welcome")


def test_a_label_that_all_articles_share_goes():
    page = lambda i: FRAME % f'<article><div><span>Report</span></div><h1>Title {i}</h1><p>{f"own text {i} " * 3}</p></article>'
    w = hx.infer([page(i) for i in range(4)])
    assert hx.extract(page(9), w) == f"Title 9\n{('own text 9 ' * 3).strip()}" and hx.extract(page(9)).startswith("Report")


def generated(rng, host, n_pages):
    """Pages of one template, each with its content: blocks that vary, between literals, menus and frame by role."""
    rooted, menu, notice = rng.random() < 0.5, rng.random() < 0.7, rng.random() < 0.5
    order = rng.sample(["paragraphs", "faq", "table", "list", "quote"], 3)
    serial = iter(range(1 << 30))
    line = lambda: " ".join(rng.choice("stone river cloud amber field silent".split()) for _ in range(rng.randint(2, 9))) + f" {host}{next(serial)}"
    for _ in range(n_pages):
        own, body = [], []

        def say(tag):
            own.append(line())
            return f"<{tag}>{own[-1]}</{tag}>"

        body.append(say("h1"))
        for kind in order:
            for _ in range(rng.randint(0, 3)):
                if kind == "paragraphs":
                    body.append(say("p") + say("p"))
                elif kind == "faq":
                    body.append("<section>" + say("h2") + say("p") + "</section>")
                elif kind == "table":
                    body.append("<table>" + "".join("<tr>" + say("td") + say("td") + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>")
                elif kind == "list":
                    body.append("<ul>" + "".join(say("li") for _ in range(rng.randint(1, 4))) + "</ul>")
                else:
                    body.append(say("blockquote"))
        page = "<body>"
        if menu:
            page += "<div>" + "".join(f'<div><a href="/{x}">{x} {line()}</a></div>' for x in "abc") + "</div>" if not rooted else "<nav><a>x</a></nav>"
        page += f"<div>Welcome to {host}</div>"
        page += ("<article>%s</article>" if rooted else "<div>%s</div>") % "".join(body)
        if notice and rng.random() < 0.6:
            page += f"<div>{host} is closed on Monday</div>"
        page += '<div class="site-footer"><p>all rights</p></div></body>'
        yield page, "\n".join(own)


def test_generated_hosts(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for h in range(24):
        for page, text in generated(rng, f"h{h}", 12):
            want[len(rows)] = text
            rows.append((len(rows), f"https://h{h}.example.org/{len(rows)}", page))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = {r.page_id: r.text for r in hx.main_text(pages).collect()}
    assert got == want
    assert {r.page_id: r.text for r in hx.main_text(pages, broadcast_bytes=0).collect()} == want
    assert sum(hx.extract(r[2]) != want[r[0]] for r in rows) > 100  # what roles alone would get wrong


def test_expressions_fold_in_rounds(spark):
    rows = [(1, k, json.dumps(hx.infer([f"<body><div>Menu</div><p>text {k}</p></body>"]).plain())) for k in range(30)]
    learned = spark.createDataFrame(rows, "h long, part long, wrapper string")
    (row,) = hx.wrappers(learned, fan_in=3).collect()
    assert hx.Node.of(json.loads(row.wrapper)).expression() == "<html><div>'Menu'</div><p>#</p></html>"


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.example.org/{i}", FRAME % f"<article><p>text {i}</p></article>", "x") for i in range(20)]
    rows += [(20, None, None, None), (21, "no host", "<p>alone</p>", None), (21, "no host", "<p>alone</p>", None), (0, "http://h0.example.org/0", FRAME % "<article><p>other</p></article>", "x")]
    got = hx.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows)
    assert sorted(r.text for r in got if r.page_id == 0) == ["other", "text 0"]
    by = {r.page_id: r for r in got if r.text != "other"}
    assert all(by[i].text == f"text {i}" and by[i].n_chars == len(by[i].text) for i in range(20))
    assert by[20].text == "" and by[21].text == "alone"
    assert hx.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_very_long_page():
    body = "".join(f"<p>word {i}</p>" for i in range(30_000))
    assert hx.extract(FRAME % f"<article>{body}</article>").count("\n") == 29_999


def test_literals_are_counted_over_all_pages_and_whole_texts(spark):
    """A late notice on a third of a host's pages, and a line in most articles; near copies keep their text."""
    long = "<p>" + "word " * 15_000 + "%d</p>"
    rows = [(i, "http://a.org/x", "<body>" + long % i + ("<div>Late notice</div>" if i % 3 == 0 else "") + "</body>") for i in range(30)]
    rows += [(100 + i, "http://b.org/x", FRAME % f"<article><p>{f'own text {i} ' * 9}</p><p>Read more on b</p></article>") for i in range(30)]
    rows += [(200 + i, "http://c.org/x", FRAME % f"<article><p>the same long story in full</p><p>{i}</p></article>") for i in range(5)]
    got = {r.page_id: r.text for r in hx.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 65 and not any("Late notice" in t or "Read more" in t for t in got.values())
    assert all(got[i].endswith(f" {i}") for i in range(30)) and all(got[100 + i].startswith(f"own text {i} ") for i in range(30))
    assert all(got[200 + i] == f"the same long story in full\n{i}" for i in range(5))
