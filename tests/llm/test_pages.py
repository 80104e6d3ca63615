"""Main text and WARC derivatives of pages."""

import base64
import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tests.compare import TESTDATA
from tideline.llm import mainhtml, markup, warc
from tideline.llm.common import prepare, table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy now</div>
<article><h1>A&amp;B</h1><p><b>First  line.<br>Second&nbsp;one.<p>Short.</p><form><input name=q><button>Go</button></form>
<ul><li>one</li><li>two</li></ul></article><section class="comments"><h3>Comments</h3><p>Nice text!</p></section>
<aside class="sidebar">Related</aside><footer>&copy; 2024 somebody</footer></body></html>"""


def test_the_article_is_left():
    assert mainhtml.main_texts([PAGE], mainhtml.train()) == ["A&B\n\nFirst line. Second one.\n\nShort.\n\none\n\ntwo"]


def test_generated_pages_it_was_not_trained_on():
    maker, right = mainhtml._PageMaker(random.Random(424242)), 0
    for _ in range(150):
        marked = maker.page()
        page = markup.read(marked)
        own = {e for e, t in page.texts if maker.MARK in t}
        want = "".join(markup.blocks(page, [i in own for i in range(len(page.elements))])).replace(maker.MARK, "")
        got = mainhtml.main_texts([marked.replace(maker.MARK, "")], mainhtml.train())[0]
        right += re.sub(r"\s", "", got) == re.sub(r"\s", "", want)
    assert right >= 140


def test_no_element_is_kept_under_a_dropped_one():
    import numpy as np

    page = markup.read("<div><p>a</p><div><p>b</p></div></div>" * 5)
    rng = np.random.default_rng(1)
    for _ in range(50):
        keep = mainhtml.decode(page, rng.normal(size=len(page.elements)))
        assert all(keep[e.parent] for e, k in zip(page.elements[1:], keep[1:], strict=True) if k)


def test_drawings_and_formulas_cut_nothing():
    article = "<article><h1>Title</h1><p>First line of it.</p><p>Second line, some more words here.</p></article>"
    want = "Title\n\nFirst line of it.\n\nSecond line, some more words here."
    icons = ["<svg class='i' viewBox='0 0 1 1'/>", "<math/>", "<svg><title/><style/><path d='M0'/></svg>", "<svg><use href='#a'></svg>",
             "<svg class='i'><g><path d='M0 0'>", "<svg><title>Icon</title><path d='M0'/>", "<svg/><svg><path/></svg>", "<math><mrow>"]
    for icon in icons:
        for page in (f"<html><body>{icon}{article}</body></html>", f"<html><body><header class='site-header'>{icon}<a href='/'>Home</a></header>{article}",
                     f"<html><body><div>{icon}</div>{article}<svg></svg><footer>&copy; 2024</footer></body></html>"):
            assert mainhtml.main_texts([page], mainhtml.train()) == [want], page
            assert markup.plain_text(page).replace("\n", "\n\n").find(want) >= 0, page


def test_text_of_formulas_objects_and_drawings_is_read():
    inside = ("<p>So <math><mi>E</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><mi>m</mi></math> holds.</p>"
              "<object data='a.swf'><p>A fallback text.</p></object><noscript><p>Plain reading.</p></noscript>"
              "<p>See <svg><title>no</title><text>left</text><text>right</text><foreignObject><b>Note</b></foreignObject></svg> above.</p>")
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1>{inside}</article><footer>&copy; x</footer></body></html>"
    parts = ["Title", "So E= 1 2m holds.", "A fallback text.", "Plain reading.", "See left rightNote above."]
    assert markup.blocks(markup.read(f"<h1>Title</h1>{inside}")) == parts
    assert mainhtml.main_texts([page], mainhtml.train()) == ["\n\n".join(parts)]


def test_given_pages(spark):
    prepare(spark)
    pages = table(spark, f"{TESTDATA}/sf0.001", "pages")
    got = {r.page_id: r.text for r in mainhtml.extract(pages, ["page_id"]).collect()}
    for row in pages.collect():
        inside = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>|\Z)", row.html).group(1)
        want = markup.blocks(markup.read(inside))
        assert got[row.page_id] == "\n\n".join(want)


def test_odd_pages(spark):
    odd = [(1, None), (2, ""), (3, "plain text"), (4, "<p>" * 3000), (5, "<div <a =\"'>x"), (6, "<script>never closed"), (6, "&#x41;&bogus;"),
           (7, "<article><p>" + "word " * 300_000 + "</article>")]
    table_ = spark.createDataFrame([(i, h, "t") for i, h in odd], "page_id long, html string, text string")
    got = mainhtml.extract(table_, ["page_id"]).collect()
    assert len(got) == len(odd) and all(r.text is not None for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert max(len(r.text) for r in got) == 5 * 300_000 - 1
    assert mainhtml.extract(table_.limit(0), ["page_id"]).count() == 0


def test_warc_files_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", PAGE), (2, None, None), (2, None, None), (None, "http://b", "<p>é</p>")],
                                  "page_id long, url string, html string").withColumn("record", F.lit(1))
    responses = warc.responses_of(pages)
    records = warc.derivatives(responses, ["page_id"])
    assert records.count() == 8
    warc.write(records, str(tmp_path / "out"))
    back = {(r.warc_type, r.record_id): r for r in warc.read(spark, str(tmp_path / "out")).collect()}
    given = {r.record_id: r for r in responses.collect()}
    for r in records.collect():
        b = back[(r.warc_type, r.record_id)]
        assert (b.refers_to, b.block_digest, b.payload_digest, b.content_length) == (
            r.refers_to, r.block_digest, r.payload_digest, r.content_length)
        assert b.block == r.block and r.refers_to in given
        sha1 = hashlib.sha1(r.block.encode(), usedforsecurity=False).digest()
        assert r.block_digest == "sha1:" + base64.b32encode(sha1).decode()
        assert "Content-Type: text/html" in r.source_headers
    texts = {r.block for r in records.where("warc_type = 'conversion'").collect()}
    assert "é" in texts and "" in texts
    assert warc.derivatives(responses.limit(0)).count() == 0


def test_a_response_without_a_head():
    record = dict(block="just text", target_uri=None, date=None, record_id=None, payload_digest=warc.sha1_digest(b"just text"))
    conversion, metadata = warc.derive(record)
    assert conversion["block"] == "just text" and "payload-digest-agrees: true" in metadata["block"]


def test_source_headers_come_back_from_the_files(spark, tmp_path):
    headers = [("Server", "WARC/1.1"), ("Last-Modified", "Mon, 01 Jan 2024 00:00:00 GMT"), ("ETag", '"a:b"'), ("Content-Language", "fr"),
               ("Set-Cookie", "a=1"), ("Set-Cookie", "b=2; Path=/"), ("X-Empty", ""), ("X-Accent", "caf\u00e9\u2028x"), ("WARC-Type", "response")]
    head = "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "X-Folded: one\r\n  two\r\n\r\n"
    rows = [("<urn:uuid:1>", "http://a/", warc.PAGE_DATE, "sha1:GIVEN", head + "<p>Text</p>"),
            ("<urn:uuid:2>", "http://b/", warc.PAGE_DATE, None, "HTTP/1.0 404 Gone\nServer: x\n\n<p>No</p>"),
            ("<urn:uuid:3>", "http://c/", warc.PAGE_DATE, None, "no head")]
    responses = spark.createDataFrame(rows, "record_id string, target_uri string, date string, payload_digest string, block string")
    records = warc.derivatives(responses)
    warc.write(records.coalesce(1), str(tmp_path / "out"))
    back = warc.read(spark, str(tmp_path / "out")).collect()
    assert len(back) == 6
    want = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("X-Folded", "one two")])
    assert {r.refers_to: (r.source_headers, r.given_digest) for r in back if r.warc_type == "metadata"} == {
        "<urn:uuid:1>": (want, "sha1:GIVEN"), "<urn:uuid:2>": ("Server: x\r\n", None), "<urn:uuid:3>": ("", None)}
    assert {(r.source_headers, r.given_digest) for r in back if r.warc_type == "conversion"} == {(None, None)}
    written = {r.record_id: r for r in records.collect()}
    assert all(r.block == written[r.record_id].block for r in back)


def test_the_head_ends_at_its_first_empty_line():
    body = "<p>a</p>\r\n\r\n<p>b</p>"
    for head in ("HTTP/1.1 200 OK\nContent-Type: text/html\n\n", "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"):
        assert warc.http_parts(head + body) == ("HTTP/1.1 200 OK", [("Content-Type", "text/html")], body)
    assert warc.http_parts("HTTP/1.1 204 None") == ("HTTP/1.1 204 None", [], "")


def test_a_block_may_hold_what_looks_like_a_record(spark, tmp_path):
    inner = "one\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\nWARC/1.1\r\n\u00e9"
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n"
    rows = [(f"<urn:uuid:{i}>", "http://a/", warc.PAGE_DATE, None, head + text) for i, text in enumerate([inner, "x", inner * 2, ""])]
    responses = spark.createDataFrame(rows, "record_id string, target_uri string, date string, payload_digest string, block string")
    records = warc.derivatives(responses)
    warc.write(records.coalesce(1), str(tmp_path / "out"))
    back = warc.read(spark, str(tmp_path / "out")).collect()
    assert sorted((r.record_id, r.block) for r in back) == sorted((r.record_id, r.block) for r in records.collect())
    assert len(back) == 8 and {r.block for r in back} >= {inner, inner * 2, "x", ""}


def test_deep_pages_are_read_in_one_pass():
    deep = 50_000
    began = time.perf_counter()
    page = markup.read("<b>" * deep + "x" + "</i>" * deep)
    assert len(page.elements) == deep + 1
    markup.read("<i><table><tr><td>" + "<b>" * deep + "</i>" * deep)
    markup.read("<b>" * deep + "<div>y</div><p>z" * 2000 + "</ul>" * deep)
    markup.read("<svg>" + "<g>" * deep + "<p>" + "</g>" * deep)
    assert time.perf_counter() - began < 4


def test_tags_close_as_by_a_walk_over_the_open_elements():
    """The places kept by tag against a search from the innermost element."""
    rng = random.Random(6)
    tags = ["b", "i", "p", "div", "ul", "li", "table", "tr", "td", "svg", "g", "math", "section", "dl", "dt", "dd", "span", "foreignobject"]
    for _ in range(400):
        source = "".join(rng.choice(["<{}>", "</{}>", "<{}>t"]).format(rng.choice(tags)) for _ in range(rng.randrange(1, 60)))
        page = markup.read(source)
        want = _walked(source)
        assert [(e.tag, e.parent, e.end) for e in page.elements] == want, source


def _walked(source):
    """Elements of a page of plain tags, each tag looking through the open ones."""
    out, stack, texts, solid = [["#root", -1, 0, 0]], [0], 0, -1

    def close(k):
        nonlocal texts
        while len(stack) > k:
            i = stack.pop()
            if out[i][0] in markup.FOREIGN and solid < out[i][3]:
                texts = out[i][3]
                del out[i + 1:]
            out[i][2] = len(out)

    for slash, tag, text in re.findall(r"<(/?)(\w+)>([^<]*)", source):
        foreign = any(out[i][0] in markup.FOREIGN for i in stack)
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if out[stack[k]][0] == tag:
                    close(k)
                    break
                if out[stack[k]][0] in markup._SCOPE and tag not in markup.BLOCKS:
                    break
            continue
        if foreign and tag in markup._ENDS_FOREIGN:
            for k in range(len(stack) - 1, 0, -1):
                name = out[stack[k]][0]
                if name in markup.FOREIGN:
                    close(k)
                    break
                if name in markup._HOLDS_HTML or name in markup._ENDS_FOREIGN:
                    break
        ends = markup._SAME.get(tag, set()) | ({"p"} if tag in markup._ENDS_P else set())
        for k in range(len(stack) - 1, 0, -1) if ends else ():
            name = out[stack[k]][0]
            if name in ends:
                close(k)
                break
            if name in markup._SCOPE:
                break
        out.append([tag, stack[-1], 0, texts])
        stack.append(len(out) - 1)
        if text:
            solid = texts
            texts += 1
    close(0)
    return [(t, p, e) for t, p, e, _ in out]
