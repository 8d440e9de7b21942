"""HTML -> article record as per-row Column expressions.

No DOM: each page is handled inside its own row with regexes and
higher-order array functions, so extraction is a narrow (shuffle-free)
projection over the crawl table. Meta tags become an array of structs per
page and every selector list is resolved with ``filter``/``element_at``.
"""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapse_ws, strip_ws
from .urls import ARTICLE_PATH_HINTS, let, normalize_url, resolved, slug_title, url_parts

# --- fixed values that must equal the reference -----------------------------
# Meta selectors for the title, in priority order: (attribute, value).
TITLE_META = [
    ("property", "og:title"), ("name", "og:title"), ("property", "twitter:title"),
    ("name", "twitter:title"), ("name", "citation_title"), ("name", "dc.title"),
    ("name", "DC.title"), ("itemprop", "headline"), ("itemprop", "name"),
]
# Meta selectors for the author, in priority order.
AUTHOR_META = [
    ("name", "author"), ("property", "article:author"), ("name", "citation_author"),
    ("name", "dc.creator"), ("name", "DC.Creator"), ("name", "byl"),
]
# Element selectors for the author when no meta tag has one, in priority order.
AUTHOR_CSS = [
    ("itemprop", "author"), ("rel", "author"), ("class", "author-name"),
    ("class", "byline-author"), ("class", "byline"), ("class", "post-author"),
    ("class", "article-author"), ("class", "authors"),
]
AUTHOR_MAX_CHARS = 500
# Meta selectors for the publication date, in priority order.
DATE_META = [
    ("property", "article:published_time"), ("property", "og:published_time"),
    ("property", "og:article:published_time"), ("name", "date"), ("name", "pubdate"),
    ("name", "publish-date"), ("name", "publication-date"), ("name", "publication_date"),
    ("name", "dc.date"), ("name", "dc.date.issued"), ("name", "DC.date.issued"),
    ("itemprop", "datePublished"), ("name", "citation_publication_date"),
    ("name", "sailthru.date"), ("name", "parsely-pub-date"),
]
# JSON-LD keys holding a publication date, in priority order.
JSONLD_DATE_KEYS = ["datePublished", "dateCreated", "uploadDate"]
# Container classes tried (with <main>) when a page has no <article>.
CONTENT_CLASSES = ["article-content", "post-content", "blog-post", "entry-content"]
# -----------------------------------------------------------------------------

_TAG_RE = r"</?[A-Za-z][^>]*>|<![^>]*>|<\?[^>]*>"
_DROP_RE = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
_META_RE = r"(?is)<meta\b[^>]*>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# Named characters from the standard library's table; numbers 128-159 mean Windows-1252.
_NAMES = json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})
_WINDOWS = json.dumps({str(c): bytes([c]).decode("cp1252") for c in range(128, 160) if c not in (129, 141, 143, 144, 157)})


def _character(m: Column) -> Column:
    """The text of one character reference; an unknown name stays as written."""
    table = lambda text: F.from_json(F.lit(text), "map<string,string>")
    number = F.regexp_extract(m, r"^&#[xX]?([0-9A-Fa-f]+);$", 1)
    code = F.when(m.rlike("^&#[xX]"), F.conv(number, 16, 10)).when(m.startswith("&#"), number).cast("long")
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    plain = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
    numeric = F.when(code.between(128, 159), F.coalesce(F.try_element_at(table(_WINDOWS), code.cast("string")), plain)).otherwise(plain)
    named = F.coalesce(F.try_element_at(table(_NAMES), F.regexp_extract(m, "^&([A-Za-z0-9]+);$", 1)), m)
    return F.when(m.startswith("&#"), numeric).otherwise(named)


def decode_entities(c) -> Column:
    """Character references decoded in one pass from left to right, so what one yields is not decoded again."""
    def body(x):
        between, found = F.split(x, _REFERENCE, -1), F.regexp_extract_all(x, F.lit(_REFERENCE), F.lit(0))
        joined = F.array_join(F.zip_with(between, F.transform(found, _character), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(x.contains("&"), joined).otherwise(x)

    return let(_col(c), body)


def strip_markup(c) -> Column:
    """Drop comments/script/style, turn tags into spaces (text stays raw)."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), _DROP_RE, " "), _TAG_RE, " ")


def element_text(inner_html) -> Column:
    """``get_text(' ', strip=True)`` + whitespace collapse."""
    return collapse_ws(decode_entities(strip_markup(inner_html)))


def element_text_nosep(inner_html) -> Column:
    """``get_text(strip=True)``: text nodes stripped and joined with no separator."""
    cleaned = F.regexp_replace(F.coalesce(_col(inner_html), F.lit("")), _DROP_RE, "\u0000")
    nodes = F.split(F.regexp_replace(cleaned, _TAG_RE, "\u0000"), "\u0000")
    return F.array_join(F.transform(nodes, lambda t: strip_ws(decode_entities(t))), "")


def _attr(tag: Column, name: str, decode: bool = True) -> Column:
    """Attribute value in a start tag (double, single or no quotes); null if absent."""
    rx = r"(?is)^<[a-z0-9]+\b(?:[^>]*?[\s\"'/])?" + name + r"\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    def value(raw):
        quoted = raw.startswith('"') | raw.startswith("'")
        val = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.when(raw != "", decode_entities(val) if decode else val)

    return let(F.regexp_extract(tag, rx, 1), value)


def meta_tags(html) -> Column:
    """array<struct<name, property, itemprop, content>> in document order."""
    tags = F.regexp_extract_all(F.coalesce(_col(html), F.lit("")), F.lit(_META_RE), 0)
    return F.transform(tags, lambda t: F.struct(
        _attr(t, "name", False).alias("name"), _attr(t, "property", False).alias("property"),
        _attr(t, "itemprop", False).alias("itemprop"), _attr(t, "content").alias("content")))


def _first_meta(metas: Column, kind: str, value: str) -> Column:
    return F.try_element_at(F.filter(metas, lambda m: m[kind] == value), F.lit(1))


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def meta_title(metas: Column) -> Column:
    return F.coalesce(*[_nonempty(strip_ws(_first_meta(metas, k, v)["content"])) for k, v in TITLE_META])


def title_tag(html) -> Column:
    inner = F.regexp_extract(F.coalesce(_col(html), F.lit("")), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return F.when(~inner.contains("<"), _nonempty(strip_ws(decode_entities(inner))))


def first_heading(html) -> Column:
    inner = F.regexp_extract(F.coalesce(_col(html), F.lit("")),
                             r"(?is)<h([1-3])\b[^>]*>(.*?)(?:</h\1\s*>|$)", 2)
    return _nonempty(element_text_nosep(inner))


def extract_title(url, html, metas: Column | None = None) -> Column:
    """meta selectors -> <title> -> first h1-h3 -> URL slug -> URL."""
    metas = meta_tags(html) if metas is None else metas
    return F.coalesce(meta_title(metas), title_tag(html), first_heading(html), slug_title(url), _col(url))


def extract_summary(metas: Column) -> Column:
    og = _first_meta(metas, "property", "og:description")
    desc = _first_meta(metas, "name", "description")
    return (F.when(og.isNotNull(), strip_ws(F.coalesce(og["content"], F.lit(""))))
             .when(desc.isNotNull(), strip_ws(F.coalesce(desc["content"], F.lit("")))))


_ANY_TAG = r"(?is)</?[a-z][a-z0-9]*\b[^>]*>"


def tag_stream(html) -> Column:
    """array<struct<tag, name, close, after>>: every tag of a page and the text up to the next one.

    Comments, scripts and styles are dropped first, so nothing in them counts.
    """
    def stream(clean):
        tags = F.regexp_extract_all(clean, F.lit(_ANY_TAG), F.lit(0))
        after = F.slice(F.split(clean, _ANY_TAG, -1), F.lit(2), F.lit(1 << 30))  # all from the second on
        return F.zip_with(tags, after, lambda t, x: F.struct(
            t.alias("tag"), F.lower(F.regexp_extract(t, "^</?([A-Za-z][A-Za-z0-9]*)", 1)).alias("name"),
            t.startswith("</").alias("close"), F.coalesce(x, F.lit("")).alias("after")))

    return let(F.regexp_replace(F.coalesce(_col(html), F.lit("")), _DROP_RE, " "), stream)


def inner_from(stream: Column, i: Column) -> Column:
    """Inner HTML text of the element that the i-th tag (from 1) opens, up to its own close tag or the page's end; tags become spaces.

    The element's end is found by counting depth over the tags of its name
    alone; its text is then one slice of the page, joined once.
    """
    rest = F.slice(stream, i, F.size(stream))

    def inside(tags):
        same = F.filter(F.transform(tags, lambda t, k: F.when(t["name"] == F.element_at(tags, 1)["name"], F.struct(
            F.when(t["close"], -1).otherwise(1).alias("step"), k.alias("at")))), lambda t: t.isNotNull())
        state = F.struct(F.lit(0).alias("depth"), F.size(tags).alias("end"))
        # Once the depth is 0 it stays there, and the end with it.
        end = F.aggregate(same, state, lambda s, t: F.when((s["depth"] == 0) & (t["at"] > 0), s).otherwise(F.struct(
            (s["depth"] + t["step"]).alias("depth"), F.when(s["depth"] + t["step"] == 0, t["at"]).otherwise(s["end"]).alias("end"))), lambda s: s["end"])
        return F.concat(F.lit(" "), F.array_join(F.transform(F.slice(tags, F.lit(1), end), lambda t: t["after"]), " "))

    return let(rest, inside)


def _openers(stream: Column, test) -> Column:
    """Positions (from 1) of the start tags that pass ``test``, in document order."""
    at = F.transform(stream, lambda t, i: F.when(~t["close"] & test(t), i + 1))
    return F.filter(at, lambda i: i.isNotNull())


def _has_token(tag: Column, attr: str, value: str) -> Column:
    """The attribute's value has ``value`` among its white-space separated tokens (itemprop: is it)."""
    got = _attr(tag, attr, False)
    return F.coalesce(got == value if attr == "itemprop" else F.array_contains(F.split(got, r"\s+"), value), F.lit(False))


def extract_author(html, metas: Column) -> Column:
    """First meta selector with any content (all its tags joined ', '; > 500
    chars -> null, no fallback), else the first element selector <= 500."""
    h = F.coalesce(_col(html), F.lit(""))
    def joined_for(k, v):
        tags = F.filter(metas, lambda m: (m[k] == v) & (F.coalesce(m["content"], F.lit("")) != ""))
        return F.array_join(F.transform(tags, lambda m: strip_ws(m["content"])), ", ")

    joined = [joined_for(k, v) for k, v in AUTHOR_META]
    meta_hit = F.coalesce(*[_nonempty(j) for j in joined])
    def by_css(stream):
        # All element selectors look for these words, so the other tags' attributes need not be read.
        words = F.filter(F.transform(stream, lambda t, i: F.when(~t["close"] & F.lower(t["tag"]).rlike("author|byline"), F.struct(
            t["tag"].alias("tag"), (i + 1).alias("at")))), lambda t: t.isNotNull())

        def places(tags):
            """The first element of each selector, in the selectors' order."""
            first = lambda a, v: F.try_element_at(F.filter(tags, lambda t: _has_token(t["tag"], a, v)), F.lit(1))
            return F.filter(F.array(*[first(a, v)["at"] for a, v in AUTHOR_CSS]), lambda i: i.isNotNull())

        texts = F.transform(let(words, places), lambda i: element_text(inner_from(stream, i)))
        return F.try_element_at(F.filter(texts, lambda x: (x != "") & (F.length(x) <= AUTHOR_MAX_CHARS)), F.lit(1))

    css = let(tag_stream(h), by_css)
    low = F.lower(h)
    maybe = low.contains("author") | low.contains("byline")
    return (F.when(meta_hit.isNotNull(), F.when(F.length(meta_hit) <= AUTHOR_MAX_CHARS, meta_hit))
             .when(maybe, css))


def _jsonld_date(html: Column) -> Column:
    rx = r"(?is)<script\b[^>]*?type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
    scripts = F.regexp_extract_all(html, F.lit(rx), 1)

    def entries(s):
        t = F.trim(s)
        return F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.array(t))

    def pick(e):
        return F.coalesce(*[_nonempty(F.get_json_object(e, f"$.{k}")) for k in JSONLD_DATE_KEYS])

    per_script = F.transform(scripts, lambda s: F.try_element_at(
        F.filter(F.transform(entries(s), pick), lambda v: v.isNotNull()), F.lit(1)))
    return strip_ws(F.try_element_at(F.filter(per_script, lambda v: v.isNotNull()), F.lit(1)))


def extract_published(html, metas: Column) -> Column:
    """15 meta selectors -> <time datetime> -> <time> text -> JSON-LD."""
    h = F.coalesce(_col(html), F.lit(""))
    meta = F.coalesce(*[(lambda m: F.when(F.coalesce(m["content"], F.lit("")) != "", strip_ws(m["content"])))(
        _first_meta(metas, k, v)) for k, v in DATE_META])
    time_dt_tag = F.regexp_extract(h, r"(?is)(<time\b[^>]*?[\s\"']datetime\s*=[^>]*>)", 1)
    time_dt = strip_ws(_nonempty(_attr(time_dt_tag, "datetime")))  # a blank one counts, as empty text
    time_txt = _nonempty(element_text(F.regexp_extract(h, r"(?is)<time\b[^>]*>(.*?)</time\s*>", 1)))
    has_time = h.rlike(r"(?is)<time\b")
    has_ld = F.lower(h).contains("ld+json")
    return F.coalesce(meta, F.when(has_time, F.coalesce(time_dt, time_txt)), F.when(has_ld, _jsonld_date(h)))


def extract_content(html) -> Column:
    """Main text: the whole first <article>; else every <main> and element of a content class, in
    document order, joined by a blank line; else every <p> (text joined without separator)."""
    h = F.coalesce(_col(html), F.lit(""))
    paras = F.regexp_extract_all(h, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p\s*>|<p\b|$)"), 1)
    p_text = F.array_join(F.transform(paras, element_text_nosep), "\n\n")

    def container(t):
        value = F.when(F.lower(t["tag"]).contains("class"), _attr(t["tag"], "class", False))
        classes = F.split(F.coalesce(value, F.lit("")), r"\s+")
        return (t["name"] == "main") | F.arrays_overlap(classes, F.array(*[F.lit(c) for c in CONTENT_CLASSES]))

    def text(stream):
        in_boxes = lambda boxes: F.when(F.size(boxes) > 0, F.array_join(
            F.transform(boxes, lambda i: element_text(inner_from(stream, i))), "\n\n")).otherwise(p_text)
        return let(_openers(stream, lambda t: t["name"] == "article"), lambda article: F.when(
            F.size(article) > 0, element_text(inner_from(stream, F.element_at(article, 1)))).otherwise(let(_openers(stream, container), in_boxes)))

    return collapse_ws(let(tag_stream(h), text))


def is_article_page(html) -> Column:
    """Lower-cased html contains '<article' or 'article:published_time'."""
    low = F.lower(F.coalesce(_col(html), F.lit("")))
    return (low.contains("<article") | low.contains("article:published_time")) & (low != "")


def anchors(html) -> Column:
    """array<struct<href, text>> of <a href> elements in document order."""
    rx = r"(?is)<a\b[^>]*?[\s\"']href\s*=[^>]*>.*?(?:</a\s*>|$)"
    tags = F.regexp_extract_all(F.coalesce(_col(html), F.lit("")), F.lit(rx), 0)
    return F.transform(tags, lambda t: F.struct(
        _attr(F.regexp_extract(t, r"(?is)^(<a\b[^>]*>)", 1), "href").alias("href"),
        element_text(F.regexp_extract(t, r"(?is)^<a\b[^>]*>(.*?)(?:</a\s*>)?$", 1)).alias("text")))


def looks_like_article_link(href_norm: Column, anchor_text: Column, source_url: Column,
                            hints=ARTICLE_PATH_HINTS) -> Column:
    """Same host (or under the source URL) and a hint in the path, or anchor
    text > 12 chars mentioning read/article/post."""
    return let(F.struct(url_parts(href_norm).alias("link"), url_parts(source_url).alias("page")), lambda p: _article_like(
        href_norm, p["link"], anchor_text, source_url, p["page"], hints))


def _article_like(href: Column, link: Column, anchor_text: Column, source_url: Column, page: Column, hints) -> Column:
    """The same with the ``url_parts`` of both URLs."""
    same = href.startswith(source_url) | (link["netloc"] == page["netloc"])
    hint = let(F.lower(link["path"]), lambda path: reduce(lambda x, h: x | path.contains(h), hints, F.lit(False)))
    text = let(F.lower(strip_ws(F.coalesce(anchor_text, F.lit("")))), lambda a: (
        (F.length(a) > 12) & (a.contains("read") | a.contains("article") | a.contains("post"))))
    return same & (hint | text)


def article_links(source_url, html, hints=ARTICLE_PATH_HINTS) -> Column:
    """Distinct harvested article links of one source page (empty if the page
    is itself an article page; the caller falls back to the source)."""
    src = _col(source_url)

    def harvested(page):
        links = F.transform(anchors(html), lambda a: F.struct(
            a["href"].alias("raw"), normalize_url(resolved(a["href"], src, page)).alias("href"), a["text"].alias("text")))
        keep = F.filter(links, lambda a: a["raw"].isNotNull() & ~a["raw"].startswith("mailto:")
                        & a["href"].isNotNull() & (a["href"] != src)
                        & let(url_parts(a["href"]), lambda link: link["scheme"].isin("http", "https")
                              & _article_like(a["href"], link, a["text"], src, page, hints)))
        return F.array_distinct(F.transform(keep, lambda a: a["href"]))

    return F.when(is_article_page(html) | (F.coalesce(_col(html), F.lit("")) == ""),
                  F.array().cast("array<string>")).otherwise(let(url_parts(src), harvested))


RECORD_FIELDS = ["url", "title", "summary", "author", "published_at", "content"]


def extract_records(df: DataFrame, url: str = "url", html: str = "html", fields: tuple[str, ...] = ("title", "summary", "author", "published_at", "content")) -> DataFrame:
    """Add the article ``fields`` (by default all five; url kept). Narrow
    projection: no shuffle. The meta array is materialised once per row and
    shared by all selector lists."""
    m = F.col("_metas")
    make = {"title": lambda: extract_title(F.col(url), F.col(html), m), "summary": lambda: extract_summary(m),
            "author": lambda: extract_author(F.col(html), m), "published_at": lambda: extract_published(F.col(html), m),
            "content": lambda: extract_content(F.col(html))}
    staged = df.withColumn("_metas", meta_tags(F.col(html)))
    return staged.select("*", *[make[f]().alias(f) for f in fields]).drop("_metas")
