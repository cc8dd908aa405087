"""Main-text extraction by equivalence-class template deduction.

A page is a sequence of tokens: structural tags, told apart by their path, and
blocks of text, told apart by path and words; menus and articles are no
exception.  Tokens of a host's pages with the same occurrence vector (how often
on which page) form an equivalence class.  Classes that occur on enough of the
host's pages are valid; nested by path they make the host's template.  Text
tokens of the template are site text, unless they stand in an article.  What
lies between template tags are slots.  The article is sought in the slot that
holds most of what the pages do not share: the innermost box of the template,
once on a page, with more than half of the host's text that is neither site
text nor in links.  On pages that have this box, the template's other boxes
stand beside the article; so do, on all pages, what its tags and names say to
be menus, notices, adverts or comments.

Vectors are never held: a class is known by its support and by the sum of
hashes of (page, count), which partial aggregation computes for hosts of any
size.  Equal pages count once.  Where a host has too few pages for a template,
names of tags and classes decide on each page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_hexdigest, xxh64_hexdigest

from .common import materialize, prepare, text_or_empty

# Element names of HTML by what they mean for text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike "
    "strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|svg|iframe|object|textarea|select|canvas"
#: Elements that are no part of an article wherever they stand, by name or role.
ASIDE = frozenset("head title nav footer aside button menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert menu".split())
#: The same, but for an article inside: some sites wrap the whole body in one.
WRAPS = frozenset("form dialog fieldset".split())
MAIN = frozenset(("article", "main"))
CLOSES = {  # an opening tag that ends an open element of these names
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "body": ("head",),
}
# Words that name a slot beside the article; a class or id that
# consists of them, and of words that only say where or how, is such a name.
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu sidebar footer comment comments respond reply replies disqus cookie cookies notice consent gdpr newsletter "
    "subscribe subscription share sharing social related breadcrumb breadcrumbs popup modal toolbar pager pagination".split()
)
PLACES = frozenset("site page main top bottom left right box bar wrap wrapper container list area block section widget item links".split())
#: Those of them that name what readers wrote, inside articles too.
REMARKS = frozenset("comment comments respond reply replies disqus".split())
#: Elements that class names are looked up for.
BOXES = frozenset("div section ul ol dl table details center".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

#: Share of characters in links from which a slot outside an article is a menu.
LINKED = 0.8


def words_of(name: str) -> set[str]:
    return {p.lower() for p in _PARTS.split(name) if p}


def names_a_box(name: str) -> bool:
    """Whether a class or an id says that a box is no part of the article."""
    parts = words_of(name)
    return bool(parts & NAMES) and parts <= NAMES | PLACES


class Element:
    """``aside``: it or one above is no part of an article by tag or role;
    ``wrapped``: in a form or the like, with no article between; ``named``: no
    part by class or id; ``remark``: in readers' comments; ``main``: it or one
    above is an article."""

    __slots__ = ("above", "aside", "main", "name", "named", "own", "path", "remark", "wrapped")

    def __init__(self, name: str = "", above: Element | None = None, attrs: dict | None = None):
        attrs = attrs or {}
        self.name, self.above = name, above
        marks = attrs.get("class", "").split()
        boxes = name in BOXES or name == "article"
        marked = [m for m in [*marks, attrs.get("id", "")] if names_a_box(m)] if boxes else []
        self.remark = any(words_of(m) & REMARKS for m in marked) or bool(above and above.remark)
        article = name in MAIN and not self.remark
        self.main = article or bool(above and above.main)
        role = attrs.get("role", "").lower()
        self.aside = name in ASIDE or name == "header" and not self.main or role in ROLES or bool(above and above.aside)
        self.wrapped = not article and (name in WRAPS or role in WRAPS or bool(above and above.wrapped))
        #: Its own class or id names a box.
        self.own = bool(marked) and name in BOXES
        self.named = self.own or bool(above and above.named)
        place = ".".join([name, *sorted({*marks, *marked})]).replace("/", "|")
        self.path = f"{above.path}/{place}" if above else ""


def walk(page: str) -> Iterator[tuple[Element, str | None, int]]:
    """``(element, None, 0)`` for structural tags; for blocks of text the element
    they stand in, the text (references decoded, white space as single blanks)
    and how many of its characters are in links."""
    top = Element()
    stack, run, linked, link = [top], [], 0, False

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        told, linked = min(linked, len(text)), 0
        return [(stack[-1], text, told)] if text else []

    at = 0
    for m in _TOKEN.finditer(page):
        piece = page[at : m.start()]
        if piece:
            run.append(piece)
            linked += len(piece) if link else 0
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            link = not m["end"]
        if name == "br":
            run.append(" ")
        if name in INLINE or name in VOID and name != "hr":
            continue
        yield from flush()
        if name in VOID:
            continue
        # A paragraph ends where any block begins or ends.
        if name != "p" or not m["end"]:
            while stack[-1].name == "p":
                stack.pop()
        if m["end"]:
            if any(e.name == name for e in stack):
                while stack.pop().name != name:
                    pass
            continue
        for closed in CLOSES.get(name, ()):
            if stack[-1].name == closed:
                stack.pop()
        element = Element(name, stack[-1], {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m["attrs"])})
        stack.append(element)
        yield element, None, 0
    run.append(page[at:])
    linked += len(page) - at if link else 0
    yield from flush()


def text_token(path: str, text: str) -> str:
    return f"#{xxh32_hexdigest(path)}{xxh64_hexdigest(f'{path}\n{text}')}"


def page_tokens(page: str) -> dict[str, list[int]]:
    """``token -> [occurrences, characters of text, of these in links]``; the
    characters are those directly in a tag, or of a text.  The empty token is the page."""
    found: dict[str, list[int]] = {"": [1, 0, 0]}
    for element, text, linked in walk(page):
        own = found.setdefault(element.path, [0, 0, 0])
        if text is None:
            own[0] += 1
        else:
            own[1] += len(text)
            own[2] += linked
            block = found.setdefault(text_token(element.path, text), [0, 0, 0])
            block[0] += 1
            block[1] += len(text)
            block[2] += linked
    return found


def nested(tags: list[str]) -> set[str]:
    """The tags whose enclosing tags are in the template too."""
    kept = {""}
    for tag in sorted(tags, key=len):
        if tag.rpartition("/")[0] in kept:
            kept.add(tag)
    return kept


def _beside(step: str) -> bool:
    """Whether a step of a path is no part of an article by its tag or class."""
    name, *marks = step.split(".")
    return name in ASIDE or name in WRAPS or name == "header" or name in BOXES and any(map(names_a_box, marks))


def article_slot(tokens: list[dict], tags: set[str]) -> str:
    """The path of the innermost box, once on a page, that holds more than half of
    the text that differs between pages; empty if there is none."""
    site: Counter = Counter()
    for t in tokens:
        if t["token"].startswith("#"):
            site[t["token"][1:9]] += t["chars"] - t["linked"]
    mass: Counter = Counter()
    for t in tokens:
        path = t["token"]
        own = t["chars"] - t["linked"] - site[xxh32_hexdigest(path)]
        if path in tags and own > 0 and not any(map(_beside, path.split("/"))):
            while path:
                mass[path] += own
                path = path.rpartition("/")[0]
            mass[""] += own
    names = BOXES | MAIN
    able = [
        t["token"] for t in tokens
        if t["once"] and 2 * mass[t["token"]] > mass[""] and t["token"].rpartition("/")[2].partition(".")[0] in names
    ]
    return max(able, key=len, default="")


class Template:
    """``tags`` by path, ``texts`` by token, the ``menus`` among the tags, and the
    path of the ``article``."""

    def __init__(self, tags: set[str], texts: set[str], menus: set[str], article: str = ""):
        self.tags, self.texts, self.menus, self.article = tags, texts, menus, article

    def holds(self, element: Element, text: str, article: str) -> bool:
        """Whether the text is content: no site text, and in no slot beside the
        article, which is ``article`` on this page.  Inside articles the class of
        a box that the page alone has does not count."""
        if not element.main and (element.named or text_token(element.path, text) in self.texts):
            return False
        at: Element | None = element
        while at is not None:
            if at.path in self.tags:
                if at.own or at.path in self.menus:
                    return False
                if article and not element.main and at.name in BOXES and not f"{article}/".startswith(f"{at.path}/") and not at.path.startswith(f"{article}/"):
                    return False
            at = at.above
        return True


def main_text(page: str, template: Template | None) -> str:
    """The text in the page's content slots; without a template, what tags and
    the classes outside articles leave."""
    blocks = list(walk(page))
    article = template.article if template else ""
    if not any(element.path == article for element, text, _ in blocks if text is None):
        article = ""  # a page of another kind
    found = []
    for element, text, _ in blocks:
        if text is None or element.aside or element.wrapped or element.remark:
            continue
        if template.holds(element, text, article) if template else element.main or not element.named:
            found.append(text)
    return "\n".join(found)


TOKENS = "_host string, _page long, _tokens array<struct<token: string, n: int, chars: int, linked: int>>"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int32()), ("chars", pa.int32()), ("linked", pa.int32())]))
    for batch in batches:
        found = []
        for text in batch.column("_html"):
            found.append([{"token": t, "n": n, "chars": c, "linked": k} for t, (n, c, k) in page_tokens(text.as_py()).items()])
        cols = [batch.column("_host"), batch.column("_page"), pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays(cols, names=["_host", "_page", "_tokens"])


def _nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for tokens in batch.column("_tokens").to_pylist():
            tags = nested([t["token"] for t in tokens if not t["token"].startswith("#")])
            texts = sorted(t["token"] for t in tokens if t["token"].startswith("#"))
            menus = [
                t["token"] for t in tokens
                if t["token"] in tags and t["chars"] and t["linked"] >= LINKED * t["chars"]
                and not any(s.partition(".")[0] in MAIN for s in t["token"].split("/"))
            ]
            rows.append((sorted(tags), texts, sorted(menus), article_slot(tokens, tags)))
        cols = [pa.array([r[i] for r in rows], pa.list_(pa.string()) if i < 3 else pa.string()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("_host"), *cols], names=["_host", "_tags", "_texts", "_menus", "_article"])


def host_templates(pages: DataFrame, min_support: float, min_text_support: float, min_pages: int) -> DataFrame:
    """``pages (_host, _page, _html)`` to ``(_host, _tags, _texts, _menus, _article)``
    of the hosts with ``min_pages`` different pages or more."""
    told = pages.mapInArrow(_tokens, TOKENS).dropDuplicates(["_host", "_page"])
    rows = told.select("_host", "_page", F.explode("_tokens").alias("t"))
    vectors = rows.groupBy("_host", F.col("t.token").alias("_token")).agg(
        F.count(F.lit(1)).alias("_support"),
        F.sum(F.xxhash64("_page", "t.n").cast("decimal(20,0)")).alias("_vector"),
        F.sum(F.col("t.n").cast("long")).alias("_n"),
        F.sum(F.col("t.chars").cast("long")).alias("_chars"),
        F.sum(F.col("t.linked").cast("long")).alias("_linked"),
    )
    vectors = materialize(vectors, "occurrence_vectors")
    total = vectors.where((F.col("_token") == "") & (F.col("_support") >= min_pages)).select("_host", F.col("_support").alias("_pages"))
    least = F.when(F.startswith("_token", F.lit("#")), min_text_support).otherwise(min_support) * F.col("_pages")
    frequent = vectors.join(total, "_host").where(F.col("_support") >= F.greatest(least, F.lit(2)))
    # Equivalence classes: equal support and vector.  A text is valid only in a
    # class with other tokens, a tag always.
    token = F.struct(
        F.col("_token").alias("token"), F.col("_chars").alias("chars"), F.col("_linked").alias("linked"),
        (F.col("_n") == F.col("_support")).alias("once"),
    )
    classes = frequent.groupBy("_host", "_support", "_vector").agg(F.collect_list(token).alias("_class"))
    is_text = F.startswith(F.col("_class")[0]["token"], F.lit("#"))
    valid = classes.where((F.size("_class") >= 2) | ~is_text)
    lists = valid.groupBy("_host").agg(F.flatten(F.collect_list("_class")).alias("_tokens"))
    return lists.mapInArrow(_nest, "_host string, _tags array<string>, _texts array<string>, _menus array<string>, _article string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, template = None, None
    for batch in batches:
        texts = []
        cols = [batch.column(c) for c in ("_html", "_host", "_tags", "_texts", "_menus", "_article")]
        for page, host, tags, site, menus, article in zip(*cols, strict=True):
            own = host.as_py()
            if own != last:
                last = own
                template = Template(set(tags.as_py()), set(site.as_py()), set(menus.as_py()), article.as_py()) if tags.is_valid else None
            texts.append(main_text(page.as_py(), template))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], names=["_id", "_url", "text"]
        )


def extract_main_text(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_support: float = 0.05,
    min_text_support: float = 0.8,
    min_pages: int = 4,
) -> DataFrame:
    """``(id, url, text)`` of every page.

    Pages are grouped by the host of their address (null or none: together).
    Tags on ``min_support`` of a host's different pages (two at least), and texts
    on ``min_text_support`` of them, can be template.  Hosts of fewer than
    ``min_pages`` different pages have none.  Inside articles no text is
    dropped for its class, unless the host's template has a box of that class
    there or it names readers' comments; navigation, forms and the like are
    dropped by their tag or role, but for an article that a form encloses.

    Null or empty pages have the empty text; markup that is cut off ends where
    the page ends; repeated rows and null ids are treated like any other; an
    empty table gives an empty result; other columns are not carried.

    Templates meet pages in a join by host that Spark may broadcast if it finds
    the templates small, and whose hot hosts it splits otherwise."""
    prepare(df.sparkSession)
    page = text_or_empty(html_col)
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.col(url_col).alias("_url"),
        F.lower(F.regexp_extract(text_or_empty(url_col), _HOST, 1)).alias("_host"),
        page.alias("_html"),
    )
    keyed = rows.select("_host", F.xxhash64("_html").alias("_page"), "_html")
    templates = materialize(host_templates(keyed, min_support, min_text_support, min_pages), "templates")
    joined = rows.join(templates, "_host", "left").select("_id", "_url", "_html", "_host", "_tags", "_texts", "_menus", "_article")
    kind = df.schema[id_col].dataType.simpleString()
    done = joined.mapInArrow(_extract, f"_id {kind}, _url string, text string")
    return done.withColumnsRenamed({"_id": id_col, "_url": url_col})
