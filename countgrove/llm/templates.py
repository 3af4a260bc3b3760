"""Main text of web pages by template deduction from equivalence classes of tokens.

A token is an element with its place in the page (the path of block elements above it). Tokens
that occur equally often in every page of a host share an occurrence vector and form an
equivalence class. Classes with enough pages are valid if their tokens nest: the class that is
once in every page is the frame, and a class lies inside the class of the nearest path above
it. The nested classes are the template of the host; text belongs to the slot of the deepest
template path around it.

The names of elements (menus, headers, articles, ...) are marks, and the template decides what
becomes of them on a host: a layout name is void on an element that wraps half of the host's text
and a content element; an article that repeats beside one that is once in every page is no
content; a slot of one text in several different pages is template text, in content too, unless
most of the host's text is so (then its pages are copies); links outside content, and equally
many links in every page, are menus. Only paths outside the template go by their marks alone.

Occurrence vectors are compared by a sum of hashes of (page, count), so tokens are counted and
summed map-side and a host with a third of all pages needs no task of its own. The template of
a host is a few dozen hashed paths and meets the pages by a join.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import written
from .common import append_batches, fields, map_batches

MIN_SHARE = 0.5       # of a host's pages that a template token is in
DISTINCT_PAGES = 3    # different pages from which one text in all of them is template text
LINK_SHARE = 0.6      # of a slot's characters from which it is a menu
WRAP_SHARE = 0.5      # of a host's text from which an element is a wrapper, whatever its name
COPY_SHARE = 0.8      # of a host's text from which constant text means copies, not a template

# Chosen lists: elements and names by their usual part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript iframe template svg select".split())
LEFT_OUT = frozenset("head nav header footer aside button dialog menu".split())
CLOSES = {
    "p": frozenset("p".split()), "li": frozenset("li p".split()), "dt": frozenset("dt dd p".split()),
    "dd": frozenset("dt dd p".split()), "tr": frozenset("tr td th p".split()), "td": frozenset("td th p".split()),
    "th": frozenset("td th p".split()), "option": frozenset("option".split()),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main menu nav ol pre section table ul".split())
BARRIERS = frozenset("ul ol dl table article section div body".split())
LISTED = frozenset("li dd td".split())
WRAPPED = frozenset("h1 nav header footer".split())     # what a form around a page holds
LAYOUT_NAMES = frozenset("banner notice notices alert signup subscribe sidebar menu nav navbar navigation breadcrumb "
                         "breadcrumbs header footer masthead toolbar share sharing social related recommended "
                         "recommendations pagination pager widget login search copyright popup modal".split())
FOREIGN_NAMES = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo cookie cookies consent "
                          "newsletter comment comments discussion respond reply replies disqus".split())
LEFT_OUT_NAMES = LAYOUT_NAMES | FOREIGN_NAMES
HEADING_NAMES = frozenset("header masthead".split())    # a part of the article inside one
STATE_WORDS = frozenset("has with no without not is and category tag type format theme show hide open close".split())
CONTENT_NAMES = frozenset("article content post entry story main maincontent articlebody postbody entrycontent "
                          "body-text".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

# Marks of an element by its name alone.
FOREIGN, LAYOUT, ARTICLE, NESTED, CONTENT, PLAIN = "foreign", "layout", "article", "nested", "content", ""

# What the template says of a path: bits of its code.
SILENT, CLOSED, INSIDE, LINKS = 1, 2, 4, 8    # own text goes; all below goes; content begins; menu outside content

_PIECE = re.compile(
    r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|$)|([^<]+|<)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME_PART = re.compile(r"[a-z]+(?:-[a-z]+)*")
_MASK = (1 << 62) - 1


def _left_out_words(names) -> set[str]:
    """Left-out words that are a whole class word or its first or last part; state classes such as has-sidebar tell nothing."""
    words = set()
    for name in names:
        parts = name.split("-")
        if name in LEFT_OUT_NAMES:
            words.add(name)
        elif len(parts) > 1 and not STATE_WORDS & set(parts):
            words.update({parts[0], parts[-1]} & LEFT_OUT_NAMES)
    return words


@lru_cache(maxsize=4096)
def _key_of(tag: str, attributes: str, inside: bool, in_article: bool) -> tuple[str, str]:
    """Path component of an element (names without digits) and its mark."""
    names, roles = set(), set()
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        (roles if m[1].lower() == "role" else names).update(_NAME_PART.findall(re.sub(r"[_\s]+", " ", value)))
    words = (names & LEFT_OUT_NAMES) if tag in ("article", "main") else _left_out_words(names)
    if inside:
        words = words - HEADING_NAMES
    if tag in ("html", "body"):
        mark = PLAIN
    elif tag in LEFT_OUT and not (tag == "header" and inside and not words):
        mark = FOREIGN
    elif words & FOREIGN_NAMES:
        mark = FOREIGN
    elif tag == "form" or roles & LEFT_OUT_ROLES or words and (tag in ("article", "main") or not names & CONTENT_NAMES):
        mark = LAYOUT
    elif tag == "article":
        mark = NESTED if in_article else ARTICLE
    elif tag == "main" or "main" in roles or names & CONTENT_NAMES:
        mark = CONTENT
    else:
        mark = PLAIN
    return ".".join([tag, *sorted(names)]) + (f"|{mark}" if mark else ""), mark


class Place:
    """A path of a page: its hash, the place above it, tag and mark, and what is counted or decided there."""

    __slots__ = ("path", "above", "tag", "mark", "depth", "inside", "in_article", "foreign", "layout",
                 "n", "chars", "linked", "texts", "inner", "holds", "closed", "silent", "content")

    def __init__(self, path: int, above: Place | None, tag: str, mark: str):
        self.path, self.above, self.tag, self.mark = path, above, tag, mark
        self.depth = above.depth + 1 if above else 0
        self.inside = mark in (ARTICLE, CONTENT) or bool(above and above.inside)
        self.in_article = tag == "article" or bool(above and above.in_article)
        self.foreign = mark == FOREIGN or bool(above and above.foreign)
        self.layout = mark in (LAYOUT, NESTED) or bool(above and above.layout)
        self.n = self.chars = self.linked = self.inner = 0
        self.texts: list[str] = []
        self.holds = self.closed = self.silent = self.content = False


def pieces(page: str | None, enter=lambda place: None):
    """(place, text, in_link) of the page in order; `enter` is called for each new place.

    An element's start has text None; block ends and line breaks yield an empty text. Character
    references are decoded.
    """
    page = page or ""
    root = Place(0, None, "", PLAIN)
    enter(root)
    places: dict[int, Place] = {}
    stack = [root]
    opened: Counter = Counter()
    link = 0
    at, end = 0, len(page)

    def leave():
        opened[stack.pop().tag] -= 1

    while at < end:
        m = _PIECE.match(page, at)
        at = m.end()
        if m[4] == "<" and (page[at:at + 1].isalpha() or page[at:at + 1] in ("/", "!", "?")):
            close = page.find(">", at)     # a tag with an open quote ends here; a cut page ends inside it
            at = close + 1 if close >= 0 else end
            continue
        if m[4] is not None:
            yield stack[-1], html.unescape(m[4]), link > 0
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = 0
            if tag in INLINE:
                continue
            if opened[tag]:
                while stack[-1].tag != tag:
                    leave()
                leave()
                link = 0
            yield stack[-1], "", False
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            yield stack[-1], "", False
            continue
        if tag in INLINE:
            link += tag == "a"
            continue
        if tag in VOID:
            yield stack[-1], "", False
            continue
        closes = CLOSES.get(tag, frozenset(("p",)) if tag in ENDS_P else frozenset())
        while stack[-1].tag in closes and stack[-1].tag not in BARRIERS:   # as browsers do
            last = stack[-1].tag
            leave()
            if last == tag:
                break
        above = stack[-1]
        component, mark = _key_of(tag, m[3], above.inside, above.in_article)
        path = path_of(above.path, component)
        place = places.get(path)
        if place is None:
            place = places[path] = Place(path, above, tag, mark)
            enter(place)
        stack.append(place)
        opened[tag] += 1
        link = 0
        yield place, None, False
    yield root, "", False


def path_of(above: int, component: str) -> int:
    """Hash of the path `above` (0 at the top) and one more component."""
    return xxhash.xxh64_intdigest(component, above) >> 1


def _page_counts(page: str | None) -> list[Place]:
    """The places of a page with occurrences, characters, characters in links, texts, and what lies below."""
    places: list[Place] = []
    for place, text, in_link in pieces(page, places.append):
        if text is None:
            place.n += 1
        else:
            n = len(text.strip())
            place.chars += n
            place.linked += n if in_link else 0
            place.texts.append(text)
    for place in reversed(places):       # what is below comes later in the list
        place.inner += 0 if place.foreign else place.chars
        if place.above:
            place.above.inner += place.inner
            place.above.holds |= place.holds or place.mark in (ARTICLE, CONTENT) or place.tag in WRAPPED
    return places[1:]


def host_of(url_col: str = "url"):
    """Host of a URL, lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def token_counts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per (host, path): its parent, pages, occurrence vector, extremes, and text statistics.

    `different` is the number of different pages, 3 standing for more: a batch of pages lists its three
    smallest digests, and there are three if one listed anywhere is neither the least nor the greatest of all.
    """
    def work(ids, hosts, htmls):
        rows: dict[tuple, list] = {}
        for key, host, page in zip(ids, hosts, htmls):
            digest = xxhash.xxh64_intdigest(page or "") >> 1
            for p in _page_counts(page):
                same = xxhash.xxh64_intdigest(" ".join(" ".join(p.texts).split())) & _MASK
                vector = xxhash.xxh64_intdigest(f"{key}|{p.n}") & _MASK
                own = rows.setdefault((host, p.path), [
                    p.above.path, p.depth, p.mark, p.tag, p.holds, 0, 0, p.n, p.n, 0, 0, 0, 0, 0, same, same, []])
                own[4] |= p.holds
                own[5] += 1
                own[6] = (own[6] + vector) & _MASK
                own[7], own[8] = min(own[7], p.n), max(own[8], p.n)
                own[9] += p.chars
                own[10] += p.linked
                own[11] += p.inner
                own[12] += 0 if p.foreign else p.chars
                own[13] += 0 if p.foreign or p.layout else p.chars
                own[14], own[15] = min(own[14], same), max(own[15], same)
                if digest not in own[16]:
                    own[16] = sorted([*own[16], digest])[:3]
        flat = [(*key, *v) for key, v in rows.items()]
        return list(zip(*flat)) if flat else [[] for _ in range(19)]

    keyed = pages.select(F.col(id_col).cast("string").alias("_id"), host_of(url_col).alias("_host"),
                         F.col(html_col).alias("_html"))
    long, text = T.LongType(), T.StringType()
    partial = written(map_batches(keyed, ["_id", "_host", "_html"], fields(
        ("host", text), ("path", long), ("parent", long), ("depth", T.IntegerType()), ("mark", text), ("tag", text),
        ("holds", T.BooleanType()), ("pages", long), ("vector", long), ("fewest", long), ("most", long),
        ("chars", long), ("linked", long), ("inner", long), ("loose", long), ("open", long),
        ("text_low", long), ("text_high", long), ("digests", T.ArrayType(long))), work), "counts")
    vector = F.sum(F.col("vector").cast("decimal(38,0)")) % F.lit(_MASK + 1).cast("decimal(38,0)")
    first = {c: F.min(c) for c in ("parent", "depth", "mark", "tag", "fewest", "text_low")}
    last = {c: F.max(c) for c in ("holds", "most", "text_high")}
    total = {c: F.sum(c) for c in ("pages", "chars", "linked", "inner", "loose", "open")}
    summed = partial.groupBy("host", "path").agg(
        vector.cast("long").alias("vector"), F.min(F.array_min("digests")).alias("_least"), F.max(F.array_max("digests")).alias("_greatest"),
        *[how.alias(c) for c, how in {**first, **last, **total}.items()])
    listed = partial.select("host", "path", F.explode("digests").alias("_digest"))
    third = listed.join(summed.select("host", "path", "_least", "_greatest"), ["host", "path"]).filter(
        (F.col("_digest") != F.col("_least")) & (F.col("_digest") != F.col("_greatest"))).select("host", "path", F.lit(3).alias("_third")).distinct()
    return summed.join(third, ["host", "path"], "left").withColumn(
        "different", F.coalesce("_third", F.when(F.col("_least") != F.col("_greatest"), 2).otherwise(1)).cast("long")).drop("_least", "_greatest", "_third")


def deduce(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template, has_content): the nested valid classes of a host and its slots.

    `template` holds (path, code) of every path of a valid class. A class is valid if it is in
    MIN_SHARE of the pages and either has several tokens with one occurrence vector or is
    a repeated record inside one: a single token whose parent is in the template's reach.
    """
    tokens = written(token_counts(pages, id_col, url_col, html_col), "tokens")
    sizes = pages.groupBy(host_of(url_col).alias("host")).agg(F.count(F.lit(1)).alias("_all"))
    frequent = tokens.join(sizes, "host").filter(F.col("pages") >= MIN_SHARE * F.col("_all"))
    classes = frequent.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("_size"))
    classed = frequent.join(classes, ["host", "vector"])
    above = classed.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("_size").alias("_above"))
    nested = classed.join(above, (F.col("host") == F.col("_h")) & (F.col("parent") == F.col("_p")), "left")
    valid = nested.filter((F.col("_size") > 1) | F.col("_above").isNotNull() | (F.col("depth") == 1))

    same = ((F.col("text_low") == F.col("text_high")) & (F.col("chars") > 0)
            & (F.col("different") >= DISTINCT_PAGES))
    once = (F.col("fewest") == 1) & (F.col("most") == 1) & (F.col("pages") == F.col("_all"))
    hosts = valid.withColumn("_same", same).withColumn("_once", once).groupBy("host").agg(
        F.sum(F.when(F.col("_same"), F.col("open")).otherwise(0)).alias("_constant"),
        F.max(F.col("_once") & (F.col("mark") == ARTICLE)).alias("_framed")).join(
        tokens.groupBy("host").agg(F.sum("loose").alias("_loose"), F.sum("open").alias("_open")), "host")

    wraps = F.col("inner") >= WRAP_SHARE * F.greatest("_loose", F.lit(1))
    void = wraps & F.when(F.col("mark") == NESTED, once).otherwise(
        F.col("holds") | F.col("tag").isin("article", "main"))
    repeats = F.col("_framed") & (F.col("mark") == ARTICLE) & (F.col("most") > 1)
    closed = (F.col("mark") == FOREIGN) | F.col("mark").isin(LAYOUT, NESTED) & ~void | repeats
    inside = F.col("mark").isin(ARTICLE, CONTENT) | F.col("tag").isin("article", "main")
    linked = F.col("linked") > LINK_SHARE * F.col("chars")
    fixed_list = F.col("tag").isin(*LISTED) & (F.col("fewest") == F.col("most")) & (F.col("different") >= DISTINCT_PAGES)
    silent = same & (F.col("_constant") <= COPY_SHARE * F.col("_open")) | linked & fixed_list
    code = (silent.cast("int") * SILENT + closed.cast("int") * CLOSED + (inside & ~closed).cast("int") * INSIDE
            + linked.cast("int") * LINKS)
    return valid.join(hosts, "host").groupBy("host").agg(
        F.collect_list(F.struct("path", code.alias("code"))).alias("template"),
        F.max(inside & ~closed & (F.col("inner") > 0)).alias("has_content"))


def _slot_text(page: str | None, codes: dict[int, int], inside_only: bool, whole: bool) -> str:
    """Text of the kept slots of one page, white space collapsed; `whole` keeps constant and link slots."""
    def enter(place: Place) -> None:
        up = place.above
        if up is None:
            return
        code = codes.get(place.path)
        if up.closed or code is None:    # outside the template the mark decides, and the slot is the one above
            place.closed = up.closed or place.mark in (FOREIGN, LAYOUT, NESTED)
            place.content = up.content or place.mark in (ARTICLE, CONTENT)
            place.silent = up.silent and place.content == up.content
        else:
            place.closed = bool(code & CLOSED)
            place.content = up.content or bool(code & INSIDE)
            place.silent = not whole and bool(code & SILENT or code & LINKS and not place.content)

    out: list[str] = []
    for place, text, _ in pieces(page, enter):
        if text is None or text == "":
            out.append(" ")
        elif not (place.closed or place.silent or inside_only and not place.content):
            out.append(text)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            text_name: str = "text") -> DataFrame:
    """(id, url, text): the main text of every page.

    Where a host's template has content elements (article, main, or names for them) the slots
    inside them are the text, else all kept slots. Blocks are joined by one space; white space
    inside is one space. NULL and empty pages give an empty text, as do pages of nothing but
    left-out elements; a page that lacks its host's content elements is read without them, and one
    that constant or link slots would empty keeps these; pages without a host form one host; repeated
    rows are extracted each and count once as evidence of constant text; an empty table gives no
    rows; other columns are ignored. An element named for adverts or comments goes even if it wraps a page.
    """
    template = written(deduce(pages, id_col, url_col, html_col), "templates")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"),
                        host_of(url_col).alias("_host"))
    joined = rows.join(template, F.col("_host") == F.col("host"), "left").drop("host")

    def work(htmls, templates, has_content):
        texts = []
        for page, slots, content in zip(htmls, templates, has_content):
            codes = {s["path"]: s["code"] for s in slots or ()}
            tries = [(True, False), (True, True), (False, False), (False, True)] if content else [
                (False, False), (False, True)]
            texts.append(next(filter(None, (_slot_text(page, codes, *t) for t in tries)), ""))
        return [texts]

    done = append_batches(joined, ["_html", "template", "has_content"], fields(("_text", T.StringType())), work)
    return done.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_text").alias(text_name))
