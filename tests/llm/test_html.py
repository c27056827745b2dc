from slicer.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";x()</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Shop</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy this now.</div><div class="cookie-notice"><p>We use cookies here.</p></div>
<article><h1>Title &eacute;</h1><p>First   par<b>ag</b>raph<br>here, it is long enough.<p>Second &lt;one&gt; &#8364; with <a href="x>y">link</a>.</p>
<script>bad()</script><ul><li>item one.</li><li>item two.</li></ul><section class="comments"><p>I do not agree at all.</p></section></article>
<aside><p>Related things to read.</p></aside><form><label>Your mail</label><input></form><footer>&copy; me</footer></body></html>"""


def test_page():
    assert html.main_text(PAGE, html.trained()) == "Title é First paragraph here, it is long enough. Second <one> € with link. item one. item two."


def test_field_is_right_on_held_out_pages():
    for plain in (0.0, 1.0):  # with class names, and without any
        right = total = 0
        for page, labels in html.labelled_pages(100, seed=123, plain=plain):
            found = html.trained().decode(html.leaf_blocks(page))
            right += sum(a == b for a, b in zip(found, labels))
            total += len(labels)
        assert right / total > 0.97


LONG = "<p>This is a paragraph of an article, with some words in it. It goes on for a while.</p>"


def test_pages_that_name_nothing():
    plain = " ".join([LONG[3:-4]] * 3)
    text = lambda h: html.main_text(h, html.trained())
    assert text(f"<html><body><div><div>{LONG * 3}</div></div></body></html>") == plain
    assert text(f"<body><div class=container><div class=row><h1>A title of it</h1>{LONG * 3}</div></div></body>") == f"A title of it {plain}"
    assert text(f'<body><article class="social-science"><h1>A title</h1>{LONG * 3}</article></body>') == f"A title {plain}"
    assert text(f"<body><div><div><h1>A title</h1>{LONG * 3}</div><div><h3>3 Comments</h3><p>Nice one, thank you.</p><p>I do not agree.</p></div></div></body>") == f"A title {plain}"
    assert text(f"<body><article><h1>A title</h1><p>So <math><mi>x</mi></math> it is.</p>{LONG * 3}</article></body>") == f"A title So x it is. {plain}"
    assert text(f"<body><article><h1>A title</h1><p>One <object data=x>and two</object>.</p><video src=y>Three.</video>{LONG * 3}</article></body>").startswith("A title One and two")


def test_raw_text_ends_at_its_end_tag():
    plain = " ".join([LONG[3:-4]] * 2)
    text = lambda h: html.main_text(h, html.trained())
    for raw in ("<script>var a = \"it's < b </p> \" + '<!-- \"</script>", "<style>p::after{content:'\"<'}</style>", "<SCRIPT type=x>if (a<b && c>d) \"</Script >", "<noscript><p>Turn \"it on</noscript>", "<iframe><p></iframe >"):
        assert text(f"<body><article><h1>A title</h1>{LONG}{raw}{LONG}</article></body>") == f"A title {plain}"
    assert text(f"<body><article><h1>A title</h1><p don't>It's here.</p>{LONG}{LONG}</article></body>") == f"A title It's here. {plain}"
    blocks = lambda h: " ".join(b.text for b in html.leaf_blocks(h))
    assert blocks("<p>a</p><script>b <p>c") == "a" and blocks("<p>a</p><textarea>b <p>c") == "a b c" and blocks('<p a="x>y" b=\'<\'>z</p><!--> w -->') == "z w -->"
    assert html.names_of('class="main-nav topAds ad1 x" id=siteFooter') == "main- -nav top- -ads ad x site- -footer"


def test_extracted_text_is_the_article_element(spark):
    """The test tables' pages have an article element each; its blocks are the text."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r.page_id: " ".join(b.text for b in html.leaf_blocks(re.search("<article>(.*)</article>", r.html, re.S)[1])) for r in pages.collect()}
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == truth


def test_viterbi_is_the_best_path():
    from itertools import product

    field = html.trained()
    blocks = html.leaf_blocks(PAGE)[:9]
    s = [sum(field.weights.get(f, 0.0) for f in own) for own in html.features(blocks)]
    score = lambda y: sum(a * b for a, b in zip(s, y)) + sum(field.pairs[a][b] for a, b in zip(y, y[1:]))
    best = max(product((0, 1), repeat=len(blocks)), key=score)
    assert abs(score(field.decode(blocks)) - score(best)) < 1e-9


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>cut &amp; off <a hre"), (4, "u", "<p"), (5, "u", "<article>" + "<p>long text here.</p>" * 3000 + "</article>"), (5, "u", "<article><p>x y z."), (6, "", "<<>><!-- open")]
    got = {(r.page_id, r.html if False else r.n_chars): r for r in html.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")).collect()}
    assert len(got) == 7
    assert got[(None, 9)].text == "cut & off" and got[(1, 0)].text == "" and (5, 3000 * 16 - 1) in got
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_unclosed_silent_elements():
    body = "<article><h1>Title.</h1><p>First paragraph, it is long enough.</p>{}<p>Second paragraph, it is long enough too.</p></article>"
    whole = "Title. First paragraph, it is long enough. Second paragraph, it is long enough too."
    text = lambda page: " ".join(b.text for b in html.leaf_blocks(page))
    for start in ("<html><head><title>T</title><body>", "<head><meta charset=x><link rel=y><script>z()</script>", "<head><title>T</title><div>", "<head><title>T</title></head><body>"):
        assert text(start + body.format("")) == whole
    assert html.main_text("<html><head><title>T</title><body>" + body.format(""), html.trained()) == whole
    assert text("<head><title>T</title>plain words") == "plain words"
    for tag in "button select svg".split():
        assert text(body.format(f"<{tag}>hidden")) == whole
        assert text(body.format(f"<{tag}>hidden</{tag}>")) == whole
        assert text(body.format(f"<{tag}>hidden<p>fallback</p><div>more</div></{tag}>")) == whole  # closed: silent to its end
        assert text(body.format(f"<{tag}>a<p>kept</p><{tag}>b<p>c</p></{tag}>")) == whole.replace(" Second", " kept Second")
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>") == "so x=2 holds."
