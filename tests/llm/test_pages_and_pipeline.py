"""Wrappers on pages with known articles; the pipeline stage by stage."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from areaflow.llm import html_wrappers as hw  # noqa: E402
from areaflow.llm import mixing  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def page(k, parts, extra=""):
    body = "".join(parts)
    return (f"<!DOCTYPE html><html><head><title>t{k}</title><script>var t='</p>{k}'</script></head><body><header>Site</header>"
            f"<nav><ul><li><a href='/{k}'>Go {k}</a></li><li><a href=/x>Home</a></ul></nav><!-- {k} <p>no</p> -->"
            f"<div class=\"ad-box\">Buy {k}</div><article><h1>Title {k} &amp; more</h1>{body}"
            f"<div class='share'>Share this</div></article>{extra}<div id='comments'><p>Nice {k}</p></div>"
            f"<form>Mail <input></form><footer>&copy; Site</footer>")


def test_articles(spark):
    rows, want = [], {}
    for k in range(40):
        parts = [f"<p>First <b>bold{k}\n\t words<br>go  on" + ("</p>" if k % 2 else ""), f"<p>Second {k} &lt;x&gt;</p>"]
        parts += [f"<ul><li>item {j}<li>last</ul>" for j in range(k % 3)]
        blocks = [f"Title {k} & more", f"First bold{k} words go on", f"Second {k} <x>"]
        blocks += [x for j in range(k % 3) for x in (f"item {j}", "last")]
        rows.append((k, f"http://h{k % 3}.example/{k}", page(k, parts, "<aside>Side</aside>" if k % 4 == 0 else ""), "x"))
        want[k] = "\n\n".join(blocks)
    rows += [(100, None, None, "x"), (101, "http://h1.example/z", "", "x"), (None, "nonsense", "plain text only", "x"),
             (0, "http://h0.example/0", rows[0][2], "x")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string").repartition(6)
    got = hw.main_texts(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    for r in got.collect():
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] in want:
            assert r["text"] == want[r["page_id"]], r
    assert hw.main_texts(frame.where("page_id < 0")).count() == 0


def test_wrapper_without_article_element_takes_the_part_with_most_text():
    pages = [f"<body><div class=menu><a href=1>one</a><a href=2>two</a></div><div class=c1><p>{'words of the text ' * 20}{k}</p>"
             f"<p>and more {k} of it</p></div><div class=c2><a href=x>link {k}</a></div><div class='cookie-notice'>We use</div>"
             for k in range(9)]
    wrapper = hw.page_expression(pages[0])
    for p in pages[1:]:
        wrapper = hw.align(wrapper, hw.page_expression(p))
    text = hw.extract(pages[3], *hw.main_slots(wrapper))
    assert text.startswith("words of the text") and text.endswith("and more 3 of it") and "link" not in text


def main_of(page):
    return hw.extract(page, *hw.main_slots(hw.page_expression(page)))


def test_main_part_without_article_holds_lists_quotations_and_sections():
    items = "".join(f"<li>an item with many words of the text {k}</li>" for k in range(9))
    text = main_of(f"<div class=menu><a href=1>one</a></div><div id=c><h1>Head</h1><p>Short text.</p><ul>{items}</ul>"
                   "<blockquote><p>Quoted.</p></blockquote><table><tr><td>Cell</table></div><div class=c2><a href=x>link</a></div>")
    assert text.startswith("Head\n\nShort text.\n\nan item") and text.endswith("text 8\n\nQuoted.\n\nCell")
    body = "words of the body " * 40
    for wrap in ("<div class=wrap>", "<body>"):
        text = main_of(f"{wrap}<section class=intro><p>Intro.</p></section><section class=body><h2>Two</h2><p>{body}</p>"
                       "</section><blockquote>Last words</blockquote>")
        assert text == f"Intro.\n\nTwo\n\n{body.strip()}\n\nLast words"


def test_raw_elements_end_where_they_end():
    for odd in ("<svg-icon name=x></svg-icon>", "<svg width='1' d=\"a>b\"/>", "<math/>", "<video-js class=v></video-js>",
                "<template-x>", "<svg><svg/><path d='x'/>no text</svg>"):
        assert main_of(f"<article><p>First</p>{odd}<p>Second</p></article>") == "First\n\nSecond", odd
    assert main_of("<article><p>First</p><script src=x>'</p>'</script><svg >no</svg ><p>Second</p>") == "First\n\nSecond"


def test_marks_of_layouts_and_comments():
    page = ("<body class='page sidebar-right'><div class='layout with-sidebar'><article class='post'><header><h1>T</h1></header><p>Text"
            "<div class='notice'>Note</div></article><section><article class='comment'><p>Nice</article></section></div>")
    assert hw.extract(page, *hw.main_slots(hw.page_expression(page))) == "T\n\nText"


def test_a_page_of_another_template_is_judged_by_itself():
    wrapper = hw.page_expression("<nav>x</nav><article><p>a text</p></article>")
    other = "<div class='menu'><a href=1>m</a></div><div id=x1><p>Other text of a page</p></div>"
    assert hw.extract(other, *hw.main_slots(wrapper)) == "Other text of a page"
    assert hw.extract("<nav>only</nav>", *hw.main_slots(wrapper)) == ""


def test_mismatches_become_optional_or_repeated():
    a, b = hw.page_expression("<ul><li>a<li>b<li>c</ul><p>x</p>"), hw.page_expression("<ul><li>a</ul><h2>n</h2><p>x</p>")
    nodes = hw.align(a, b)
    assert [(n.path.rpartition("/")[2], n.plus, n.optional) for n in nodes] == [
        ("li", True, False), ("h2", False, True), ("p", False, False)]
    assert nodes[2].text is not None and nodes[0].text is None
    group = hw.page_expression("<h3>a</h3><p>b</p><h3>c</h3><p>d</p><h3>e</h3><p>f</p>")
    assert len(group) == 1 and group[0].plus and len(group[0].nodes) == 2


def test_wrapper_merges_do_not_depend_on_partitions(spark):
    frame = spark.read.parquet(f"{FOLDER}/pages.parquet")
    one = {r["page_id"]: r["text"] for r in hw.main_texts(frame.coalesce(1)).collect()}
    assert one == {r["page_id"]: r["text"] for r in hw.main_texts(frame.repartition(7)).collect()}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    kept = corpus_pipeline.quality(spark, docs, FOLDER).cache()
    base = {r["doc_id"] for r in docs.collect() if not brute.rule_counts(r["text"])[5]}
    assert {r["doc_id"] for r in kept.collect()} <= base
    once = corpus_pipeline.exact(spark, kept, FOLDER).cache()
    groups = brute.equal_groups([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert {r["doc_id"] for r in once.collect()} == {k for k, _ in groups.values()}
    near = corpus_pipeline.near(spark, once, FOLDER).cache()
    prints = {r["doc_id"]: brute.simhash(r["text"]) for r in once.collect()}
    assert {r["doc_id"] for r in near.collect()} == set(brute.components(prints, 4).values())
    mixed = corpus_pipeline.mixed(spark, near, FOLDER).cache()
    copies = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in mixing.mix(near).collect():
        assert copies.get(r["doc_id"], 0) == int(r["taken"] / r["size"] + 0.5)
    ids = corpus_pipeline.encoded(spark, mixed, FOLDER)
    assert ids.count() == mixed.count()
    for stage in (kept, once, near, mixed):
        assert stage.columns == docs.columns


@pytest.mark.parametrize("n", [7, 8, 40])
def test_text_that_all_pages_share_stays(n):
    pages = [f"<nav>Menu</nav><article id=title-of-page-{'abcdefgh'[k % 8] * (k + 1)}><h1>Head {k}</h1><p class=lead>Standing first paragraph.</p><p>Body {k}</p></article>"
             for k in range(n)]
    wrapper = hw.page_expression(pages[0])
    sizes = []
    for page in pages[1:]:
        wrapper = hw.align(wrapper, hw.page_expression(page))
        sizes.append(sum(1 for node in wrapper for _ in node.slots()))
    slots = hw.main_slots(wrapper)
    assert [hw.extract(p, *slots) for p in pages] == [f"Head {k}\n\nStanding first paragraph.\n\nBody {k}" for k in range(n)]
    assert len(set(sizes)) == 1  # slugs do not make the expression grow


def test_marks_of_slugs_keep_their_judged_words():
    assert [hw.template_mark(m) for m in ("Content", "col-12", "how-to-cook-rice", "site-nav-left-bar", "no-side-bar-menu", "article_body")] == [
        "content", "col-0", "", "nav", "", "article_body"]
