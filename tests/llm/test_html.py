import html as entities

import pytest
from pyspark.sql import functions as F

from engramlake.llm import html, queries

W = {"word": 1.0, "p": -1.0, "h1": -1.0, "nav": -5.0, "noise": -8.0}


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words only here", "plain words only here"),
    ("<body><nav>Menu one two</nav><article><h1>Title</h1><p>First &amp; <b>bo</b>ld\n text.<p>Second<br>line</article><footer>f</footer>", "Title First & bold text. Second line"),
    ("<article><p>Text<aside>side bar</aside> more</p><div class='comments'><p>reader says</p></div><form><input>f</form></article>", "Text more"),
    ("<article><p>a</p><script>var t='</p>';</script><style>p{}</style><!-- c --><p>b</p></article>", "a b"),
    ("<div class=\"cookie-notice\">We use</div><div id='ad-1'>Buy</div><main><p>Real text here</p></main>", "Real text here"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one two x y"),
    ("<article><p>1 &lt; 2 &#233; &nbsp; x &unknown; &am</p></article>", "1 < 2 é x &unknown; &am"),
    ("<article><p>un<i>clo<p>sed", "unclo sed"),
    ("<html><body><header>h</header><div><p>A long enough body of words without any article element at all.</p><p>And more of the words.</p></div><footer>end</footer></body></html>", "A long enough body of words without any article element at all. And more of the words."),
])
def test_pages(page, text):
    assert html.main_text(page, W) == text


def test_best_run():
    assert html.best_run([1, -2, 3, 4, -1, 2, -9, 5]) == (2, 6) and html.best_run([-1, -2]) == (0, 0) and html.best_run([]) == (0, 0)


def test_weights_tell_content_from_frame(spark):
    w = html.learn_weights(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert w["word"] > 0 and w["noise"] < w["nav"] < w["p"] <= 0
    # with no article element the scan finds the same region
    for page in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        bare = page.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html.main_text(bare, w) == html.main_text(page.html, w) != ""


def test_link_lists_stay_outside(spark):
    w = html.learn_weights(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    links = "<div>" + "<a href='x'>some link</a> " * 12 + "</div>"
    body = "<p>" + "plain words of the page " * 20 + "</p>"
    assert html.main_text(links + body + links, w) == ("plain words of the page " * 20).strip()


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op7_main_text(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("want"))
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).cast("long").alias("doc_id"))
    joined = got.join(pages, "page_id").join(docs, "doc_id")
    assert got.columns == ["page_id", "url", "text", "n_chars"] and joined.count() == got.count()
    # a page's article is its title and the document's text
    titles = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_extract("html", r"<h1>(.*?)</h1>", 1).alias("title"))
    for r in joined.join(titles, "page_id").collect():
        assert r.text == " ".join(f"{entities.unescape(r.title)} {r.want}".split())
    assert joined.where("n_chars <> char_length(text)").count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "u", "x"), (2, "", None, "x"), (3, "<article>" + "<b>w</b> " * 30_000, "u", "x"), (3, "<p>a</p>", "u", "x"), (None, "<<<>>> <a", "u", "x")], "page_id long, html string, url string, text string")
    rows = html.extract(df, W).collect()
    assert len(rows) == 5 and {r.n_chars for r in rows if r.page_id in (1, 2)} == {0}
    assert html.extract(df.where("false")).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    ("<main><h1>Heading here</h1><p>The intro has words.</p><article><p>And the long nested article has many more words than that.</p></article></main>", "Heading here The intro has words. And the long nested article has many more words than that."),
    ("<article><p>One part of the outer article.</p><article><p>A nested article with rather more words inside than the outer one.</p></article><p>Its end.</p></article>", "One part of the outer article. A nested article with rather more words inside than the outer one. Its end."),
    ("<div><article><p>The first part of a text in two articles.</p></article><article><p>The second part of the same text, a bit longer.</p></article></div>", "The first part of a text in two articles. The second part of the same text, a bit longer."),
    ("<article><p>The long text of the page has these words.</p></article>" + "<div><a>x</a></div>" * 9 + "<article><a>Other thing</a></article>", "The long text of the page has these words."),
])
def test_article_elements_bound_the_run(page, text):
    assert html.main_text(page, W) == text


def test_nested_article_is_labelled():
    assert html.label_counts("<p>a</p><main>b c<article>d</article></main>")[("word", True)] == 3


def article(words, start=0):
    return " ".join(f"w{i}" for i in range(start, start + words))


@pytest.mark.parametrize("box", [
    "<aside>" + "<ul><li><a>text</a></li></ul>" * 6 + "</aside>", "<div class='related'>" + "<p><a>text</a></p>" * 6 + "</div>",
    "".join(f"<div class='ad'><b>{i}</b></div>" for i in range(9)),
])
def test_a_skipped_box_costs_once(box):
    a, b = article(30), article(12, 30)
    # paragraphs of one container, and of two
    assert html.main_text(f"<div><p>{a}</p>{box}<p>{b}</p></div>", W) == f"{a} {b}"
    if box.count("class='ad'") < 2:
        assert html.main_text(f"<div><p>{a}</p></div>{box}<div><p>{article(15, 30)}</p></div>", W) == f"{a} {article(15, 30)}"


def test_a_container_with_the_words_of_the_page_is_no_noise():
    a = article(40)
    assert html.main_text(f"<div class='page with sidebar'><p>{a}</p><div class='sidebar'>five words of the frame</div></div>", W) == a
    assert html.main_text(f"<p>{article(20)}</p><div class='comments'>{article(30, 50)}</div>", W) == article(20)
    assert html.main_text(f"<article>{article(5)}</article><div class='comments'>{article(60, 50)}</div>", W) == article(5)
    assert html.main_text(f"<div hidden class='menu'>{a}</div><p>{article(5)}</p>", W) == article(5)


def test_short_paragraphs_stay_without_labels():
    assert html.main_text("<div><p>Five words are in it.</p><p>" + article(30) + "</p><p>And five are in this.</p></div>", {}) == f"Five words are in it. {article(30)} And five are in this."


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p title=O'Brien>First part</p><p>Second part it's here</p></article>", "First part Second part it's here"),
    ("<article><p title=\"it's\" data-x='a>b'>One</p><p title = 'q\"'>Two</p></article>", "One Two"),
    ("<article><p>Body words here.</p><section id='legal'><p>On the legal side.</p></section></article>", "Body words here. On the legal side."),
    ("<article><p>Body words here.</p><div class='related-work'><p>Others did that.</p></div><div class='side'><p>A side note.</p></div></article>", "Body words here. Others did that. A side note."),
    ("<article><p>Body words here.</p><div class='related-posts'><p>x</p></div><div id='comments'><p>y</p></div><section class='comments-section'>z</section><div class='ShareBar'>s</div></article>", "Body words here."),
])
def test_quotes_and_names_inside_an_article(page, text):
    assert html.main_text(page, W) == text


def test_unknown_tags_are_one_kind(spark):
    pages = spark.createDataFrame([(f"<div>a</div><article><x-{i}-{'y' * 60}>w w w</x-{i}-{'y' * 60}></article>",) for i in range(1500)], "html string")
    weights = html.learn_weights(pages)
    assert "other" in weights and len(weights) <= len(html.KNOWN) + 3 and not any(k.startswith("x-") for k in weights)


BODY = "<p>Body words here.</p>"


@pytest.mark.parametrize("box", [
    "<section id='comments'><h2>Comments</h2><p>x</p></section>", "<ul id='comments'><li>x</li></ul>", "<div class='commentlist'><p>x</p></div>", "<div class='discussion'><p>x</p></div>",
    "<ol class='comment-list'><li class='comment'>x</li></ol>", "<div class='adsbygoogle'>x</div>", "<div class='ad-slot ad-300x250'>x</div>", "<div class='share-buttons'>x</div>", "<p class='advert-text'>x</p>",
    "<div id='disqus_thread'>x</div>", "<div class='article-comments'>x</div>", "<div class='newsletter-signup'>x</div>", "<div class='relatedposts'>x</div>",
])
def test_boxes_inside_an_article_go(box):
    assert html.main_text(f"<article>{BODY}{box}</article>", W) == "Body words here."


@pytest.mark.parametrize("box", [
    "<p class='share-price'>kept</p>", "<div class='social-policy'><p>kept</p></div>", "<section id='discussion'><p>kept</p></section>", "<section id='alerts'><p>kept</p></section>", "<h2 id='comments'>kept</h2>",
    "<pre><code><span class='comment'>kept</span></code></pre>", "<div class='commentary'>kept</div>", "<div class='content with-sidebar'>kept</div>", "<div class='cookie-recipe'>kept</div>", "<p class='address'>kept</p>",
])
def test_real_text_inside_an_article_stays(box):
    assert html.main_text(f"<article>{BODY}{box}</article>", W) == "Body words here. kept"


def test_a_teaser_bounds_nothing():
    assert html.main_text(f"<div><p>{article(40)}</p></div><article><a href='x'>Other thing</a></article>", W) == article(40)
    assert html.main_text(f"<article>{article(12)}</article><div><p>{article(40, 50)}</p></div>", W) == article(12)


def test_weights_from_a_sample_of_a_large_table(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    whole = html.learn_weights(pages)
    monkeypatch.setattr(html, "SAMPLE_PAGES", pages.count() // 2)
    part = html.learn_weights(pages)
    assert part.keys() == whole.keys() and html.learn_weights(pages.repartition(5)) == part
    monkeypatch.setattr(html, "SAMPLE_PAGES", 40)
    assert [html.main_text(r.html, part) for r in pages.limit(50).collect()] == [html.main_text(r.html, whole) for r in pages.limit(50).collect()]


def brute(page_tokens, score):
    """The greatest sum over all contiguous runs, by trying each."""
    best = (0.0, 0, 0)
    for i in range(len(page_tokens)):
        total = 0.0
        for j in range(i, len(page_tokens)):
            total += score[j]
            if total > best[0] + 1e-12:
                best = (total, i, j + 1)
    return best


def test_runs_equal_all_runs_tried():
    import random

    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.choice([-3, -1, -0.5, 0.5, 1, 2]) for _ in range(rng.randint(0, 25))]
        total, _, _ = brute(scores, scores)
        a, b = html.best_run(scores)
        assert abs(sum(scores[a:b]) - total) < 1e-9


def test_the_scan_decides(spark, monkeypatch):
    monkeypatch.setattr(html, "best_run", lambda scores: (0, 0))
    assert html.main_text("<article><p>Some words</p></article>", W) == "" and html.main_text("<p>Some words</p>", W) == ""
