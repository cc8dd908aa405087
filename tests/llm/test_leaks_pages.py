import random
import re

import numpy as np
import pytest

from lithoscan.llm.decontaminate import ItemIndex, _codes, banded_alignment, drop_leaks, find_leaks, normalised, qgrams, regions
from lithoscan.llm.html_extract import Template, extract_main_text, host_templates, main_text, names_a_box, nested, page_tokens

from .data import SCHEMA, clashing, empty, frame, rows, sentence


def fewest_edits(item, text):
    """Whole item against any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at, what = rng.randrange(len(chars)), rng.randrange(3)
        chars[at : at + 1] = [[], ["q"], [chars[at], "z"]][what]
    return "".join(chars)


@pytest.mark.parametrize("seed", range(6))
def test_banded_alignment_equals_the_full_table(seed):
    rng = random.Random(seed)
    item = sentence(rng, 6)
    text = sentence(rng, 4) + edited(rng, item, rng.randrange(6)) + sentence(rng, 4)
    edits, end = banded_alignment(_codes(item), _codes(text), -len(text), len(text))
    assert edits == fewest_edits(item, text) and 0 <= end <= len(text)


def test_qgrams_are_equal_only_for_equal_windows():
    text = "abcabcabcabdabcabcab"
    grams = qgrams(_codes(text), 8)
    for i in range(len(grams)):
        for j in range(len(grams)):
            assert (grams[i] == grams[j]) == (text[i : i + 8] == text[j : j + 8])


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.randrange(8, 30))) for i in range(12)] + [(90, "tiny"), (91, None), (92, ""), (0, "Zq")]
    rows_of_short = [(2000, "a tiny thing", None, None, 0), (2001, "zq", None, None, 0), (2002, "atiny zqs", None, None, 0)]
    data = [*rows(), *rows_of_short]
    for i in range(40):
        _, item = items[rng.randrange(12)]
        budget = len(item) * 8 // 100
        own = edited(rng, item.upper().replace(" ", " \n"), rng.choice([0, 1, budget // 2, budget, 3 * budget + 9]))
        data.append((1000 + i, sentence(rng, rng.randrange(0, 200)) + " " + own + " " + sentence(rng, 20), None, None, 0))
    want = set()
    index = ItemIndex(8, [n for n, t in items], [normalised(t or "") for _, t in items], 0.08)
    for d, text, *_ in data:
        if d is not None and d < 1000 and len(text or "") > 9000:
            continue
        for k, (n, t) in enumerate(items):
            if t and len(t) < 8:  # as whole words only
                found = f" {normalised(t)} " in f" {normalised(text or '')} "
            else:
                found = t and fewest_edits(normalised(t), normalised(text or "")) <= index.budget[k]
            if found:
                want.add((d, n))
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(clashing(df, "item_id", "edits"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 20
    small = find_leaks(df, bench, block_chars=300).collect()  # many blocks
    assert sorted(map(str, small)) == sorted(map(str, got))
    kept = {r.doc_id for r in drop_leaks(df, bench).collect()}
    assert not kept & {d for d, _ in want} and kept | {d for d, _ in want} == {r[0] for r in data}
    for r in got:
        item = normalised(next(t for n, t in items if n == r.item_id and t))
        spans = [normalised(t or "")[r.start : r.end] for d, t, *_ in data if d == r.doc_id]
        assert r.edits in [fewest_edits(item, span) for span in spans] or r.item_id == 0


def test_parts_of_long_items_and_every_place_of_short_ones():
    rng = random.Random(3)
    item, fill = sentence(rng, 140), lambda n: " ".join(f"z{rng.randrange(10**6)}" for _ in range(n))
    ids = [1] * len(regions(item, 50)) + [2]
    index = ItemIndex(8, ids, [*regions(item, 50), "tiny"], 0.08)
    parts = item.split(" ")
    for a, b in ((0, 140), (7, 82), (30, 105), (65, 140)):
        (found,) = index.leaks(f"{fill(40)} {' '.join(parts[a:b])} {fill(30)}")
        assert found[0] == 1 and found[2] - found[1] >= len(" ".join(parts[a : a + 50])) // 2
    assert not index.leaks(" ".join(parts[60:85])) and not index.leaks(fill(300))
    assert index.leaks("tiny a tiny b xtiny") == [(2, 0, 4, 0), (2, 7, 11, 0)]
    assert [" ".join(item.split(" ")[25:75])] == regions(item, 50)[1:2] and regions(item, 50)[-1].endswith(parts[-1])


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(frame(spark), none).count() == 0 and drop_leaks(frame(spark), none).count() == len(rows())
    some = spark.createDataFrame([(1, "a benchmark item of some length")], "item_id long, text string")
    assert find_leaks(empty(spark), some).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=x>Home</a><li>Menu {n}</ul></nav><!-- ad <p>no</p> -->
<div class="ad box">Buy {n}</div><div class=cookie-notice>We use cookies</div>{body}
<div id="comments"><p>Reader says {n}</div><form><label>Mail</label><button>Go</button></form>
<aside>Side</aside><footer>&copy; {n}</footer></body></html>"""


def pages(spark):
    article = "<article><h1>Title &amp; {n}</h1><p>First   <b>bo</b>ld<br>text {n}<p>Second &lt;b&gt; &#233;&nbsp;x<ul><li>one<li>two</ul><div class='related'>More</div></article>"
    loose = "<div class=content><p>Welcome to our site</p><p>Loose {n}</p></div>"
    data = [(i, f"https://a.example/{i}", PAGE.format(n=i, body=article.format(n=i))) for i in range(6)]
    data += [(100 + i, f"http://b.example:80/{i}", PAGE.format(n=i, body=loose.format(n=i))) for i in range(5)]
    data += [(200, "http://b.example/cut", PAGE.format(n=9, body=loose.format(n=9))[:-900] + "<p>cut &am"), (201, None, None), (202, "x", "")]
    data += [(203, "https://c.example/", "only text &amp; <i>more</i>"), (0, "https://a.example/0", data[0][2]), (None, "https://a.example/q", "<p>x<!-- open")]
    return data, spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)


def test_pages(spark):
    data, df = pages(spark)
    got = {}
    for r in extract_main_text(clashing(df, "text", "host")).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert sum(map(len, got.values())) == len(data)
    for i in range(6):
        assert set(got[i]) == {f"Title & {i}\nFirst bold text {i}\nSecond <b> é x\none\ntwo"}
    for i in range(5):  # the line that all pages of the host have is template
        assert got[100 + i] == [f"Loose {i}"]
    assert got[201] == got[202] == [""] and got[203] == ["only text & more"] and got[None] == ["x"]
    assert extract_main_text(df.limit(0)).count() == 0


def test_templates_are_nested():
    assert nested(["", "/html", "/html/body", "/x/y", "/html/body/p.a"]) == {"", "/html", "/html/body", "/html/body/p.a"}


def brute_template(pages, min_support=0.05, min_text_support=0.8):
    """Tags and texts of one host's different pages, from whole occurrence vectors."""
    pages = sorted(set(pages))
    vectors = {}
    for i, page in enumerate(pages):
        for token, (n, _, _) in page_tokens(page).items():
            vectors.setdefault(token, {})[i] = n
    classes = {}
    for token, vector in vectors.items():
        least = (min_text_support if token.startswith("#") else min_support) * len(pages)
        if len(vector) >= max(2, least):
            classes.setdefault(tuple(sorted(vector.items())), []).append(token)
    kept = [t for c in classes.values() for t in c if len(c) > 1 or not t.startswith("#")]
    return nested([t for t in kept if not t.startswith("#")]), {t for t in kept if t.startswith("#")}


def test_host_templates_against_brute_force(spark):
    rng, data = random.Random(8), []
    blocks = ["<nav><a href=x>Menu</a></nav>", "<div class=ad>{}</div>", "<p>{}</p>", "<p>same on many</p>", "<div class=box><p>{}</p></div>"]
    for host in range(6):
        fixed = rng.sample(blocks, 3)
        for i in range(rng.choice([2, 5, 12])):
            parts = fixed + rng.sample(blocks, rng.randrange(3))
            body = "".join(b.format(rng.randrange(4)) for b in parts)
            data += [(f"h{host}", f"<html><body>{body}</body></html>")] * rng.randrange(1, 3)
    df = spark.createDataFrame(data, "_host string, _html string").selectExpr("_host", "xxhash64(_html) AS _page", "_html").repartition(4)
    got = {r._host: (set(r._tags), set(r._texts)) for r in host_templates(df, 0.05, 0.8, 4).collect()}
    large = 0
    for host in {h for h, _ in data}:
        own = [p for h, p in data if h == host]
        if len(set(own)) >= 4:
            large += 1
            assert got[host] == brute_template(own)
    assert large >= 2


def test_the_template_decides(spark):
    """What is site text, and which boxes are beside the article, is seen on many pages."""
    body = "<div class=ad>Buy {n}</div><div class=text><p>Story {n}<p class='social impact'>Impact {n}</div><p>All rights reserved</p>"
    data = [(i, f"http://h.example/{i}", f"<html><body>{body.format(n=i)}</body></html>") for i in range(8)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert got == {i: f"Story {i}\nImpact {i}" for i in range(8)}
    none = Template(set(), set(), set())
    assert all(main_text(page, none) != got[i] for i, _, page in data)
    copies = [(i, "http://c.example/", data[0][2]) for i in range(9)]  # equal pages count once: no template
    got = extract_main_text(spark.createDataFrame(copies, df.schema)).collect()
    assert {r.text for r in got} == {"Story 0\nImpact 0\nAll rights reserved"}


def test_the_article_is_the_slot_that_differs(spark):
    """Boxes without telling names go where the template shows where the article is."""
    shape = "<html><body><div class=x1>Trending {n}</div><h1>Title {n}</h1><div class=w-1/2><p>Story {n} goes on for {n} more words<p>Next {n}</div><div class=x9>Also read {n}</div></body></html>"
    data = [(i, "http://h.example/", shape.format(n=i)) for i in range(6)]
    data.append((9, "http://h.example/", "<html><body><div class=x1>Another kind of page</div></body></html>"))
    data += [(20 + i, f"http://small{i}.example/", f"<body><div class=cookie-notice>We use cookies {i}</div><p>Story {i}<div class=comments>Reader {i}</div>") for i in range(12)]
    data += [(40 + i, "http://rare.example/", f"<body><div class=text><p>Story {i}</div>" + "<div class=promo>Buy now</div>" * (i in (3, 50))) for i in range(60)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == [f"Title {i}\nStory {i} goes on for {i} more words\nNext {i}" for i in range(6)]
    assert got[9] == "Another kind of page"
    assert [got[20 + i] for i in range(12)] == [f"Story {i}" for i in range(12)]
    assert [got[40 + i] for i in range(60)] == [f"Story {i}" for i in range(60)]


def test_forms_around_articles_and_comments_in_them():
    assert main_text("<form id=f><label>x</label><main><p>a<form>b</form></main></form>", None) == "a"
    assert main_text("<article>a<div class=comment-list>b</div></article><section id=comments><article class=comment>c</article></section><form>d</form>", None) == "a"
    assert main_text("<article class=comment>c</article><aside><article>d</article></aside><p>e", None) == "e"


def test_nothing_goes_by_class_inside_an_article():
    page = "<article><p class='social impact'>a<section id=share-of-market>b</section><p>c <math><mi>x</mi></math></article><div class=content>d</div><div class='site-footer'>e</div>"
    assert main_text(page, None) == "a\nb\nc x\nd"
    assert names_a_box("cookie-notice") and names_a_box("adBox") and not names_a_box("share-of-market") and not names_a_box("content")


def test_long_and_broken_pages():
    body = "".join(f"<p>block {i} of a long page</p>" for i in range(20000))
    assert main_text(f"<article>{body}", None).count("\n") == 19999
    for broken in ("<", "<p", "</", "<!--", "<script>", "<a href='x", "<p><b></p></b></i>", "&#x110000; &bogus; &"):
        assert isinstance(main_text(broken, None), str)
    assert re.fullmatch("a b", main_text("<div><p>a\n\t b", None))
    assert np.all([main_text(x, None) == "" for x in ("", "<p></p>", "<nav>x</nav>")])
