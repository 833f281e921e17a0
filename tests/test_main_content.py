"""Main content against a twin that builds the page's tree from a regular expression and looks every element over anew."""

import html
import re

from groundwork.operators.main_content import page_content
from groundwork.plans import catalogue

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style)\b.*?</\1\s*>|<(/?)([a-z][a-z0-9]*)[^>]*>|([^<]+)", re.S | re.I)
AWAY = {"nav", "header", "footer", "aside", "noscript", "form"}
HEADS = {"title", "h1", "h2", "h3", "h4", "h5", "h6"}
ELEMENTS = {"html", "body", "main", "article", "section", "div"}
CUTS = HEADS | ELEMENTS | {"p", "br", "li", "ul", "ol", "dl", "dt", "dd", "tr", "table", "blockquote", "pre"}


def twin(source):
    """Each block is (path of elements, text, solid, linked, heading, table); pages here close their links, or end them in a paragraph."""
    blocks, path, made = [], (0,), 0
    names = {0: ""}
    text, solid, linked, away, link, inner, par, head, deep, tables = "", 0, 0, 0, False, False, False, False, 0, 0

    def cut():
        nonlocal text, solid, linked
        if solid:
            blocks.append((path, " ".join(text.split()), solid, linked, head, tables if deep else None))
        text, solid, linked = "", 0, 0

    for m in TOKEN.finditer(source):
        end, tag, data = m[2], (m[3] or "").lower(), m[4]
        if data is not None and not away:
            data = html.unescape(data)
            text, n = text + data, len(re.sub(r"\s", "", data))
            solid, linked = solid + n, linked + n * link
        if m[1]:
            cut()
        if not tag:
            continue
        if tag in AWAY or tag in CUTS:
            cut()
            head = not end and tag in HEADS if tag in CUTS else head and not end
            par = tag == "p" if not end else par
        away = max(0, away + (-1 if end else 1)) if tag in AWAY else away
        if tag == "a":
            link, inner = not end, par
        if end and (tag in ("li", "tr", "table") or (tag == "p" and inner)):
            link = False
        if tag == "table":
            tables += not end and deep == 0
            deep = max(0, deep + (-1 if end else 1))
        if tag in ("td", "th") and not end:
            text += " | "
        if tag in ELEMENTS and not end:
            made += 1
            names[made] = tag
            path = (*path, made)
        elif tag in ELEMENTS and tag in [names[e] for e in path]:
            path = path[: max(k for k, e in enumerate(path) if names[e] == tag)]
    cut()

    def menu(b):
        same = [b] if b[5] is None else [c for c in blocks if c[5] == b[5]]
        return sum(c[3] for c in same) > 0.5 * sum(c[2] for c in same)

    good = lambda b: len(b[1]) >= 80 and b[3] <= 0.33 * b[2]
    kept = [b for b in blocks if not menu(b)]
    total = sum(b[2] for b in kept if good(b))
    if total:
        main = max(e for e in range(made + 1) if sum(b[2] for b in kept if good(b) and e in b[0]) >= 0.9 * total)
        kept = [b for b in kept if main in b[0] or b[4] or b[5] is not None or good(b)]
    return "\n".join(b[1] for b in kept)


def test_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in catalogue.queries()["q_main_text"](spark, SF).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        assert got[i] == (None if page is None else twin(page)), i
    assert any(got.values())


LONG = "A sentence about opening an account with a passport and a certificate, long enough to count. "
PAGE = f"""<html><head><title>Accounts</title></head><body>
<div class=menu><a href=/>Home</a> <a href=/a>All of the pages of this site in one very long line of links that is no content at all</a></div>
<div class=teaser>Open now!</div>
<div id=main><h2>Opening</h2><p>{LONG * 3}</p><p>Short.</p><div><p>{LONG}</p>
<table><tr><th>Fee</th><th>Won</th></tr><tr><td>Card</td><td>100</td></tr></table></div>
<ul><li><a href=/x>Read more about it</a></li></ul></div>
<table><tr><td>Branch</td><td>Seoul</td></tr></table>
<table><tr><td><a href=/1>One</a></td><td><a href=/2>Two</a></td></tr></table>
<div><a href=/y><h3>Teaser in a link</h3><p>{LONG}</p></a></div>
<div>Call us.</div><footer>{LONG}</footer></body></html>"""


def test_boilerplate_goes_and_tables_stay():
    got = page_content(PAGE)
    assert got == twin(PAGE)
    assert got.split("\n") == ["Accounts", "Opening", (LONG * 3).strip(), "Short.", LONG.strip(), "| Fee | Won", "| Card | 100", "| Branch | Seoul"]


def test_odd_pages(spark):
    for page in ("", "plain words", "<p><a href=x>open link</p><p>" + LONG, "</div></div>" + LONG, "<nav>never closed " + LONG, "<div>" * 3000 + LONG, "<td>a<td>b", "<table><tr><td>x</table>y", "Short<br>lines<br>only"):
        assert page_content(page) == twin(page), page[:60]
    assert page_content("Short<br>lines<br>only") == "Short\nlines\nonly"
    from groundwork.operators.main_content import main_text

    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x</p>" * 60_000)], "id int, html string")
    got = {r.id: r.text for r in rows.select("id", main_text("html").alias("text")).collect()}
    assert got == {1: None, 2: "", 3: "\n".join("x" * 60_000)}
