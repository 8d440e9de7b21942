"""URL functions as native Column expressions (no Python UDFs).

Semantics follow the standard library's ``urllib.parse`` behaviour that the
reference relies on (urlparse / parse_qsl / urlencode / urljoin), expressed
with regexes and higher-order array functions so they stay in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, strip_ws

# --- fixed values that must equal the reference -----------------------------
# Query keys dropped during normalisation (exact names, compared lower-cased).
TRACKING_PARAMS = [
    "gclid", "fbclid", "dclid", "msclkid", "yclid", "twclid", "ttclid", "igshid",
    "_ga", "_gl", "ref", "ref_src", "ref_url", "hscta_tracking", "hsctatracking",
    "spm", "share", "share_source", "share_id",
]
# Query-key prefixes dropped during normalisation.
TRACKING_PREFIXES = ["utm_", "hsa_", "vero_", "mc_", "_hs", "ic_"]
# Words a slug title writes in capitals.
KNOWN_ACRONYMS = [
    "ai", "ml", "llm", "llms", "nlp", "rag", "mcp", "api", "apis", "sdk", "cli",
    "ui", "ux", "ide", "os", "io", "gpu", "gpus", "cpu", "tpu", "rl", "ir",
    "html", "css", "json", "xml", "yaml", "sql", "aws", "gcp", "gpt", "etl",
    "iot", "faq", "https", "http", "tcp", "udp", "rest", "ci", "cd", "vm",
    "saas", "paas", "iaas", "pdf", "p2p", "qa", "sre",
]
# Path words that mark a harvested link as an article.
ARTICLE_PATH_HINTS = ["article", "blog", "post", "paper", "research", "news", "note"]
# Schemes for which the standard library splits ``;params`` / writes ``//``.
USES_PARAMS = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
               "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel"]
USES_NETLOC = ["", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
               "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync",
               "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services"]
# Preprint pages (HTML, PDF) and the parts a slug leaves out.
PREPRINT_HTML = r"^(https?://arxiv\.org)/html/(.+?)(?:v\d+)?/?$"
PREPRINT_PDF = r"^(https?://arxiv\.org)/pdf/(.+?)(?:\.pdf)?(?:v\d+)?/?$"
SLUG_EXTENSION = r"(?i)\.(html?|php|aspx?|jsp|md|pdf|txt)$"
SLUG_VERSION = r"v\d+$"
SLUG_NUMERIC = r"^[\d.\-_v]+$"
# -----------------------------------------------------------------------------

_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_REST_RE = r"(?s)^(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#.*)?$"
_PARAMS_RE = r"(?s)^(.*/)?([^;]*)(;(.*))?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(value)`` (avoids re-inlining a
    large sub-expression at every reference)."""
    return F.transform(F.array(value), body)[0]


_BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"


def pct_decode(c) -> Column:
    """Form decoding: '+' -> space, %XX -> UTF-8; a '%' that starts no escape stays."""
    return F.try_url_decode(F.regexp_replace(_col(c), _BAD_ESCAPE, "%25"))


def pct_decode_path(c) -> Column:
    """Path decoding: the same, but '+' stays."""
    return pct_decode(F.replace(_col(c), F.lit("+"), F.lit("%2B")))


def form_encode(c) -> Column:
    """``quote_plus``: unreserved = letters, digits and ``_.-~``; space -> '+'."""
    enc = F.url_encode(_col(c))
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def is_tracking_param(key) -> Column:
    prefix_re = "^(" + "|".join(TRACKING_PREFIXES) + ")"
    return let(F.lower(_col(key)), lambda k: k.isin(*TRACKING_PARAMS) | k.rlike(prefix_re))


def url_parts(url) -> Column:
    """Split like ``urlparse``: struct(scheme, netloc, path, params, query, fragment).

    ``scheme`` is null when the URL has none.
    """
    def split(u):
        has_scheme = u.rlike(_SCHEME_RE)
        cut = F.when(has_scheme, F.regexp_replace(u, _SCHEME_RE, "")).otherwise(u)
        scheme = F.when(has_scheme, F.lower(F.regexp_extract(u, _SCHEME_RE, 1)))
        return let(cut, lambda rest: F.struct(
            scheme.alias("scheme"),
            F.regexp_extract(rest, _REST_RE, 2).alias("netloc"),
            F.regexp_extract(rest, _REST_RE, 3).alias("path_full"),
            F.regexp_extract(rest, _REST_RE, 4).alias("query_q"),
            F.regexp_extract(rest, _REST_RE, 6).alias("frag")))

    def finish(p):
        path_full = p["path_full"]
        split_params = F.coalesce(p["scheme"], F.lit("")).isin(*USES_PARAMS) & path_full.contains(";")
        path = F.when(split_params, F.concat(F.regexp_extract(path_full, _PARAMS_RE, 1),
                                             F.regexp_extract(path_full, _PARAMS_RE, 2))).otherwise(path_full)
        params = F.when(split_params, F.regexp_extract(path_full, _PARAMS_RE, 4)).otherwise(F.lit(""))
        return F.struct(p["scheme"].alias("scheme"), p["netloc"].alias("netloc"), path.alias("path"),
                        params.alias("params"), F.regexp_replace(p["query_q"], "^\\?", "").alias("query"),
                        F.regexp_replace(p["frag"], "^#", "").alias("fragment"))

    u = F.regexp_replace(strip_ws(_col(url)), r"[\t\r\n]", "")
    return let(let(u, split), finish)


def normalize_query(q) -> Column:
    """parse_qsl(keep_blank_values) -> drop tracking keys -> sort -> urlencode."""
    return let(_col(q), _normalized_query)


def _normalized_query(q: Column) -> Column:
    pieces = F.filter(F.split(q, "&"), lambda x: x != "")
    pairs = F.transform(pieces, lambda x: F.struct(
        pct_decode(F.when(x.contains("="), F.substring_index(x, "=", 1)).otherwise(x)).alias("k"),
        pct_decode(F.when(x.contains("="), F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1))
                   .otherwise(F.lit(""))).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~is_tracking_param(p["k"])))
    enc = F.transform(kept, lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"])))
    return F.when(q == "", F.lit("")).otherwise(F.array_join(enc, "&"))


def _unparse(scheme, netloc, path, params, query) -> Column:
    path_p = F.when(params != "", F.concat(path, F.lit(";"), params)).otherwise(path)  # all arguments are bound values
    with_netloc = F.concat(F.lit("//"), netloc,
                           F.when((path_p != "") & ~path_p.startswith("/"),
                                  F.concat(F.lit("/"), path_p)).otherwise(path_p))
    body = (F.when(netloc != "", with_netloc)
             .when(path_p.startswith("//"), F.concat(F.lit("//"), path_p))
             .when(scheme.isin(*USES_NETLOC) & ((path_p == "") | path_p.startswith("/")),
                   F.concat(F.lit("//"), path_p))
             .otherwise(path_p))
    return F.concat(scheme, F.lit(":"), body,
                    F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def normalize_url(url) -> Column:
    """Canonical URL: lower scheme/host, default port dropped, '' path -> '/',
    trailing slashes stripped, tracking params dropped and the rest sorted and
    re-encoded, fragment dropped. No scheme -> null."""
    def body(p):
        scheme, netloc0, path0 = p["scheme"], F.lower(p["netloc"]), p["path"]
        netloc = (F.when((scheme == "http") & netloc0.endswith(":80"), F.regexp_replace(netloc0, ":80$", ""))
                  .when((scheme == "https") & netloc0.endswith(":443"), F.regexp_replace(netloc0, ":443$", ""))
                  .otherwise(netloc0))
        path = (F.when(path0 == "", F.lit("/"))
                 .when((F.length(path0) > 1) & path0.endswith("/"), F.regexp_replace(path0, "/+$", ""))
                 .otherwise(path0))
        parts = F.struct(netloc.alias("netloc"), path.alias("path"), normalize_query(p["query"]).alias("query"))
        out = let(parts, lambda n: _unparse(scheme, n["netloc"], n["path"], p["params"], n["query"]))
        return F.when(scheme.isNotNull(), out)
    return let(url_parts(url), body)


def url_host(url) -> Column:
    """``urlparse(url).hostname`` lower-cased minus one leading ``www.``; else ''."""
    u = F.regexp_replace(F.lower(F.coalesce(_col(url), F.lit(""))), r"^[\x00-\x20]+|[\t\r\n]", "")
    raw = F.regexp_extract(u, r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    host = F.regexp_replace(raw, r"^\[|\]$", "")
    return F.regexp_replace(host, r"^www\.", "")


def host_suffixes(host) -> Column:
    """'a.b.c' -> ['a.b.c', 'b.c', 'c'] (label-boundary suffixes)."""
    h = _col(host)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    return F.when(h == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))


def canon_fetch_url(url) -> Column:
    """Preprint page rewrite before lookup: /html/ID[vN][/] and
    /pdf/ID[.pdf][vN][/] on arxiv.org -> /abs/ID."""
    u = _col(url)
    return (F.when(u.rlike(PREPRINT_HTML), F.regexp_replace(u, PREPRINT_HTML, "$1/abs/$2"))
             .when(u.rlike(PREPRINT_PDF), F.regexp_replace(u, PREPRINT_PDF, "$1/abs/$2"))
             .otherwise(u))


def slug_title(url) -> Column:
    """Readable title from the last path segment, or null."""
    p = url_parts(url)
    path = F.regexp_replace(p["path"], "/+$", "")
    seg = pct_decode_path(F.element_at(F.split(path, "/"), -1))
    seg = F.regexp_replace(seg, SLUG_EXTENSION, "")
    seg = F.regexp_replace(seg, SLUG_VERSION, "")
    cleaned = F.regexp_replace(strip_ws(F.regexp_replace(seg, "[-_+]+", " ")), WS + "+", " ")
    words = F.split(cleaned, " ")
    titled = F.transform(words, lambda w: F.when(
        F.lower(w).isin(*KNOWN_ACRONYMS), F.upper(w)).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))))
    out = F.array_join(titled, " ")
    bad = (path == "") | (path == "/") | seg.rlike(SLUG_NUMERIC) | (F.length(cleaned) < 3)
    return F.when((F.coalesce(_col(url), F.lit("")) != "") & ~bad, out)


_TIME = (r"([T ]([01]\d|2[0-3])(:?[0-5]\d(:?[0-5]\d([.,]\d{1,6})?)?)?"
         r"(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d(:?[0-5]\d)?)?)?)?$")
ISO_DAY = r"^(\d{4})-?(\d{2})-?(\d{2})" + _TIME
ISO_WEEK = r"^(\d{4})(?:-W(\d{2})(?:-([1-7]))?|W(\d{2})([1-7])?)" + _TIME


def date_key(c) -> Column:
    """ISO date, week date or datetime text -> 'yyyy-MM-dd' as written (offset not applied); else null."""
    s = _col(c)
    part = lambda pattern, i: F.regexp_extract(s, pattern, i)
    day = F.try_to_date(F.concat_ws("-", part(ISO_DAY, 1), part(ISO_DAY, 2), part(ISO_DAY, 3)), "yyyy-MM-dd")
    year = F.when(s.rlike(ISO_WEEK), part(ISO_WEEK, 1))
    week = F.when(s.rlike(ISO_WEEK), F.concat(part(ISO_WEEK, 2), part(ISO_WEEK, 4))).cast("int")
    offset = F.when(s.rlike(ISO_WEEK), F.concat(F.lit("0"), part(ISO_WEEK, 3), part(ISO_WEEK, 5))).cast("int")
    monday = F.date_add(F.trunc(F.try_to_date(F.concat(year, F.lit("-01-04")), "yyyy-MM-dd"), "week"), (week - 1) * 7)
    exists = (week >= 1) & (F.weekofyear(monday) == week)
    of_week = F.when(exists, F.date_add(monday, F.greatest(offset, F.lit(1)) - 1))
    return F.date_format(F.when(s.rlike(ISO_DAY), day).otherwise(of_week), "yyyy-MM-dd")


def query_augment(query, domains) -> Column:
    """query + ' -site:d' for each excluded domain."""
    q, d = _col(query), _col(domains)
    sites = F.array_join(F.transform(d, lambda x: F.concat(F.lit("-site:"), x)), " ")
    return F.when(F.coalesce(F.size(d), F.lit(0)) > 0, F.concat(q, F.lit(" "), sites)).otherwise(q)


def absolute_url(maybe_relative, base) -> Column:
    """Resolve a maybe-relative link against a deployed base URL ('' if unusable)."""
    m, b = _col(maybe_relative), _col(base)
    return (F.when(F.coalesce(m, F.lit("")) == "", F.lit(""))
             .when(m.startswith("http://") | m.startswith("https://"), m)
             .when(F.coalesce(b, F.lit("")) == "", F.lit(""))
             .otherwise(F.concat(F.regexp_replace(b, "/+$", ""), F.lit("/"),
                                 F.regexp_replace(m, "^/+", ""))))


def _remove_dots(segments: Column) -> Column:
    """Dot-segment removal over an array of path segments (urljoin's loop)."""
    def body(xs):
        folded = F.aggregate(
            xs, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                            .when(s == ".", acc)
                            .otherwise(F.concat(acc, F.array(s))))
        last = F.element_at(xs, -1)
        ended = let(folded, lambda f: F.when(last.isin(".", ".."), F.concat(f, F.array(F.lit("")))).otherwise(f))
        return let(F.array_join(ended, "/"), lambda joined: F.when(joined == "", F.lit("/")).otherwise(joined))

    return let(segments, body)


def resolve_url(href, base) -> Column:
    """``urljoin(base, href)`` for the common reference forms (RFC 3986)."""
    return let(url_parts(base), lambda bp: resolved(href, base, bp))


def resolved(href, base, bp: Column) -> Column:
    """``resolve_url`` with the base's ``url_parts``, for callers with many references to one base."""
    bscheme, bnetloc, bpath = bp["scheme"], bp["netloc"], bp["path"]
    bpath_p = F.when(bp["params"] != "", F.concat(bpath, F.lit(";"), bp["params"])).otherwise(bpath)
    origin = F.concat(bscheme, F.lit("://"), bnetloc)

    def rel_path(hpath):
        base_dir = let(F.split(bpath, "/"), lambda d: F.when(
            F.element_at(d, -1) != "", F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0)))).otherwise(d))
        segs = let(F.concat(base_dir, F.split(hpath, "/")), lambda xs: F.when(F.size(xs) <= 2, xs).otherwise(F.concat(
            F.slice(xs, 1, 1), F.filter(F.slice(xs, 2, F.size(xs) - 2), lambda s: s != ""),
            F.slice(xs, F.size(xs), 1))))
        return let(_remove_dots(segs), lambda r: F.when(r.startswith("/"), r).otherwise(F.concat(F.lit("/"), r)))

    def body(h):
        hquery_part = F.regexp_extract(h, r"(?s)^[^?#]*(\?[^#]*)?", 1)
        hfrag_part = F.regexp_extract(h, r"(?s)^[^#]*(#.*)?$", 1)
        bquery = F.when(bp["query"] != "", F.concat(F.lit("?"), bp["query"])).otherwise(F.lit(""))
        by_path = let(F.regexp_extract(h, r"(?s)^([^?#]*)", 1), lambda hpath: (
            F.when(hpath == "", F.concat(origin, bpath_p, F.when(hquery_part != "", hquery_part).otherwise(bquery), hfrag_part))
             .when(hpath.startswith("/"), F.concat(origin, _remove_dots(F.split(hpath, "/")), hquery_part, hfrag_part))
             .otherwise(F.concat(origin, rel_path(hpath), hquery_part, hfrag_part))))
        return (F.when(F.coalesce(h, F.lit("")) == "", _col(base))
                 .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
                 .when(h.startswith("//"), F.concat(bscheme, F.lit(":"), h))
                 .otherwise(by_path))

    return let(_col(href), body)
