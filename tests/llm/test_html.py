import random
import re
from html import escape, unescape

from tallyframe.llm.html_text import extract, main_text

ARTICLE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="comments-off">
<header><h2>Site, name</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many, many, many of them.</p></div>
<div id="content"><div class="ad"><p>Buy this, now, please.</p></div>
<h1>A  title &amp; more</h1><p>First para, with commas, and <b>bold</b>&nbsp;words.
 Wrapped.<p>Second &lt;para&gt; a &gt; b &#233;<script>var x="</p><p>no";</script> end.
<ul><li>one<li>two <a href="#">link</a></ul><pre>x   y</pre><p>Tiny.</p>
<form><p>Name, please, now</p><input></form></div>
<aside><p>Sidebar, with, many, commas, and a lot of words that go on for long.</p></aside>
<section id="comments"><p>Reader, says, something, quite, long, and, full, of, commas, indeed.</p></section>
<footer>&copy; x</footer></body></html>"""
WANT = "A title & more\nFirst para, with commas, and bold words. Wrapped.\nSecond <para> a > b é end.\none\ntwo link\nx y\nTiny."


def test_article_without_its_surroundings():
    assert extract(ARTICLE) == WANT


def test_article_tag_with_sections_is_kept_whole():
    html = "<body><div class=menu><a href=1>x</a></div><article><h1>T</h1><section><p>a, b, c, d, e, f " + "w " * 200 + "</p></section><section><p>Short.</p></section></article><div class='related'><p>z</p></div></body>"
    assert extract(html) == "T\na, b, c, d, e, f " + " ".join("w" * 200) + "\nShort."


def test_siblings_of_the_best_container_are_kept():
    body = "".join(f"<div><p>Part {i}, has, commas, and words {'on and on ' * 20}</p></div>" for i in range(3))
    got = extract(f"<body><div id=wrap>{body}<div><a href=1>only,</a> <a href=1>a</a> <a href=1>link, list</a></div></div></body>")
    assert [x.split(",")[0] for x in got.split("\n")] == ["Part 0", "Part 1", "Part 2"]


PARAGRAPHS = "".join(f"<p>Part {i}, has, commas, and words {'on and on ' * 20}</p>" for i in range(5))


def parts(html):
    return [x.split(",")[0] for x in extract(html).split("\n")]


def test_a_word_of_a_name_does_not_lose_the_article():
    want = [f"Part {i}" for i in range(5)]
    around = "<div class='ad'><p>Buy this, now, please.</p></div>{}<div id=footer><p>Imprint, and, so on.</p></div>"
    for names in ("content has-sidebar", "no-sidebar", "long-form", "header-and-body", "comments-off", "page-header-wrap", "sidebar content", "widget"):
        for inner in (PARAGRAPHS, f"<article>{PARAGRAPHS}</article>"):
            assert parts("<body>" + around.format(f"<div class='{names}'>{inner}</div>") + "</body>") == want, names
            assert parts("<body>" + around.format(f"<section id='{names.split()[0]}'><div>{inner}</div></section>") + "</body>") == want, names
    sections = "".join(f"<div class='row no-sidebar'>{p}</p></div>" for p in PARAGRAPHS.split("</p>")[:-1])
    assert parts("<body>" + around.format(f"<div id=wrap>{sections}</div>") + "</body>") == want
    assert parts("<div class='comments'><article>" + PARAGRAPHS + "</article></div><p>Imprint.</p>") == want
    assert extract("<div class='sidebar'><p>All there is.</p></div>") == "All there is."


def test_parts_that_are_named_rightly_still_go():
    short = "<div><p>Short, but, the article.</p><p>All of it, really, is here.</p></div>"
    for tag in ("div", "article"):  # comments may be longer than the article, and articles themselves
        assert parts(f"<body>{short}<div id=comments><{tag} class=comment>{PARAGRAPHS}</{tag}></div></body>") == ["Short", "All of it"]
        assert parts(f"<body>{short}<ol class='comment-list'>{PARAGRAPHS}</ol></body>") == ["Short", "All of it"]
    assert parts(f"<body><div class='no-sidebar'>{PARAGRAPHS}<div class='share'><p>Share this, now.</p></div></div><div class=sidebar><p>Other, things.</p></div></body>") == [f"Part {i}" for i in range(5)]


def test_lists_of_links_in_the_article_are_kept():
    refs = "<ol>" + "".join(f"<li><a href={i}>Reference {i}, of some length</a></li>" for i in range(4)) + "</ol>"
    linked = "<p>" + " and ".join(f"<a href={i}>Linked {i}</a>" for i in range(4)) + "</p>"
    listed = [f"Reference {i}" for i in range(4)]
    assert parts(f"<body><article>{PARAGRAPHS}{linked}<section>{refs}</section></article></body>") == [f"Part {i}" for i in range(5)] + ["Linked 0 and Linked 1 and Linked 2 and Linked 3"] + listed
    assert parts(f"<body><div role=main>{PARAGRAPHS}{refs}</div></body>")[5:] == listed
    assert parts(f"<body><div id=wrap>{PARAGRAPHS}{linked}<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div></body>")[5:] == ["Linked 0 and Linked 1 and Linked 2 and Linked 3"]


def test_odd_pages():
    assert extract("") == "" and extract("   ") == "" and extract("<!-- x") == "" and extract("<nav><a>m</a></nav>") == ""
    assert extract("just text") == "just text"
    assert extract("<p>cut <b>off <a href='") == "cut off"
    assert extract("<p title='a > b'>x</p>") == "x"
    assert extract("<p>a < b</p>") == "a < b"
    assert extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert extract("<p>x" + " <i" * 20_000) == "x"
    assert extract("<p>" + "word, " * 50_000 + "</p>").count("word") == 50_000
    assert extract("<article><script>if (a</b) '</article>'") == ""


def test_a_table_of_pages(spark):
    rows = [(1, "u", ARTICLE, 9), (2, None, None, 9), (None, "v", "<p>x</p>", 9), (1, "u", ARTICLE, 9)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "v", 1), (1, "u", len(extract(ARTICLE))), (1, "u", len(extract(ARTICLE))), (2, "", 0)]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_an_article_keeps_its_own_header_boxes_and_notes():
    rest = "<p>Body, of, the text, which goes on for a while and more.</p>"
    for inner, want in (
        ("<header><h1>Headline</h1></header>", "Headline"), ("<div class='section-header'><h2>Title</h2></div>", "Title"), ("<div class=header><h2>Own</h2></div>", "Own"),
        ("<p class='search-results-note'>Note.</p>", "Note."), ("<p class=reply>Reply.</p>", "Reply."), ("<fieldset><p>Box.</p></fieldset>", "Box."),
        ("<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul>", "One\nTwo\nThree"),
        ("<p>a<script>x</script> b <button>no</button> c</p>", "a b c"), ("<noscript><p>x</noscript><p>After</p>", "After"),
        ("<div class='ad'><p>Buy.</p></div>", ""), ("<div class='share-buttons'>Share</div>", ""), ("<footer>By me</footer>", ""), ("<form><fieldset>Name</fieldset></form>", ""),
    ):
        got = extract(f"<body><header><h1>Site</h1></header><nav><a href=1>x</a></nav><article>{inner}{rest}</article></body>")
        assert got == (want + "\n" if want else "") + "Body, of, the text, which goes on for a while and more.", inner


def brute_article(html):
    """The blocks between article tags, for pages of headings, paragraphs and inline marks."""
    m = re.search(r"<article[^>]*>(.*?)(</article>|$)", html or "", re.S)
    body = re.sub(r"<br\s*/?>", " ", m[1]) if m else ""
    blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|div)[^>]*>", body)]
    return "\n".join(b for b in blocks if b)


def test_all_pages_against_a_plain_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, brute_article(r.html)) for r in pages.collect()}
    got = {r.page_id: r for r in main_text(pages).collect()}
    assert {i: (r.url, r.text) for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def made_page(rng):
    """A page of random parts, and the article's blocks."""
    words = lambda n: " ".join(rng.choice("lorem ipsum, dolor & sit <amet é ü consectetur; adipiscing".split()) for _ in range(n))
    inline = lambda t: rng.choice(["{}", "<b>{}</b>", "<span class=x>{}</span>", "<em>{}</em>", "<!-- no -->{}", "<a href='/x'>{}</a>"]).format(escape(t)) if rng.random() < 0.3 else escape(t)
    want, body = [], []
    for _ in range(rng.randint(3, 12)):
        text = words(rng.randint(15, 120))
        want.append(" ".join(text.split()))
        at = rng.randrange(len(text))
        at = text.find(" ", at) if text.find(" ", at) > 0 else len(text)
        tag = rng.choice(["p", "p", "p", "blockquote", "pre"])
        body.append(f"<{tag}>{escape(text[:at])}{inline(text[at:])}</{tag}>")
        if rng.random() < 0.2:
            body.append(rng.choice(["<script>var a = '<p>x</p>';</script>", "<aside>See, also, this.</aside>", "<form><p>Name, please</p></form>", "<div class='ad'><p>Buy, now</p></div>", "<div class=share>Share this</div>"]))
    title = words(3)
    head = f"<h1>{escape(title)}</h1>"
    inner = head + "\n".join(body)
    article = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div role=main>{}</div>", "<div id=content>{}</div>", "<div class='post-body'>{}</div>", "<article><section>{}</section></article>", "<main><article><header></header>{}</article></main>"]).format(inner)
    around = [f"<nav><ul>{''.join(f'<li><a href=/{i}>{escape(words(2))}</a></li>' for i in range(6))}</ul></nav>", f"<header><p>{escape(words(9))}</p></header>", f"<footer><p>{escape(words(20))}</p></footer>",
              f"<div class='cookie-notice'><p>{escape(words(30))}</p></div>", f"<aside><p>{escape(words(60))}</p></aside>", f"<section id=comments><p>{escape(words(40))}</p></section>", "<script>if (a<b) x('</p>');</script>", "<style>p{}</style>"]
    rng.shuffle(around)
    k = rng.randint(0, len(around))
    return f"<!DOCTYPE html><html><head><title>{escape(title)}</title></head><body>{''.join(around[:k])}{article}{''.join(around[k:])}</body></html>", "\n".join([" ".join(title.split()), *want])


def test_made_pages():
    rng = random.Random(11)
    for _ in range(400):
        html, want = made_page(rng)
        assert extract(html) == want, html
