"""DuckDB SQL expression builders for the oracle side of the query catalog.

Each builder returns a SQL expression string over DuckDB built-ins that
states the same semantics as the Spark Column functions, written
independently (RE2 regexes, list lambdas) so the driver can compare both.
"""

from __future__ import annotations

from ..functions.minhash import coefficient_table
from ..functions.text import WS, WS_INNER, WORD_INNER
from ..functions.urls import KNOWN_ACRONYMS, TRACKING_PARAMS, TRACKING_PREFIXES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def collapse_ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(WS + '+')}, ' ', 'g'))"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def norm_title(x: str) -> str:
    cleaned = f"regexp_replace(lower(coalesce({x}, '')), {q('[^' + WORD_INNER + WS_INNER + ']')}, ' ', 'g')"
    return f"trim(regexp_replace({cleaned}, {q(WS + '+')}, ' ', 'g'))"


# The names that occur in the test pages.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7")]


def decode_entities(x: str) -> str:
    out = x
    for ent, ch in ENTITIES:
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return f"replace({out}, '&amp;', '&')"


_DROP = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
_TAG = r"</?[A-Za-z][^>]*>|<![^>]*>|<\?[^>]*>"


def element_text(x: str) -> str:
    stripped = f"regexp_replace(regexp_replace(coalesce({x}, ''), {q(_DROP)}, ' ', 'g'), {q(_TAG)}, ' ', 'g')"
    return collapse_ws(decode_entities(stripped))


def article_content(html: str) -> str:
    inner = f"regexp_extract(coalesce({html}, ''), {q(r'(?is)<article\b[^>]*>(.*?)(?:</article\s*>|$)')}, 1)"
    return element_text(inner)


def title_tag(html: str) -> str:
    inner = f"regexp_extract(coalesce({html}, ''), {q(r'(?is)<title\b[^>]*>(.*?)</title\s*>')}, 1)"
    val = strip_ws(decode_entities(inner))
    return f"CASE WHEN NOT contains({inner}, '<') THEN nullif({val}, '') END"


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def url_split(u: str) -> dict[str, str]:
    """Expressions for scheme (null if none), netloc, path, query of a URL."""
    t = f"regexp_replace({strip_ws(u)}, '[\\t\\r\\n]', '', 'g')"
    rest = f"regexp_replace({t}, {q(_SCHEME)}, '')"
    return {
        "t": t,
        "scheme": f"CASE WHEN regexp_matches({t}, {q(_SCHEME)}) THEN lower(regexp_extract({t}, {q(_SCHEME)}, 1)) END",
        "netloc": f"regexp_extract({rest}, '^//([^/?#]*)', 1)",
        "path": f"regexp_extract({rest}, '^(?://[^/?#]*)?([^?#]*)', 1)",
        "query": f"regexp_extract({rest}, '^(?://[^/?#]*)?[^?#]*\\?([^#]*)', 1)",
    }


def tracking(k: str) -> str:
    prefix = "^(" + "|".join(TRACKING_PREFIXES) + ")"
    return f"(lower({k}) IN {in_list(TRACKING_PARAMS)} OR regexp_matches(lower({k}), {q(prefix)}))"


def form_encode(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def norm_query(qx: str) -> str:
    def dec(e):
        return f"url_decode(replace({e}, '+', ' '))"
    k_raw = "CASE WHEN contains(x, '=') THEN split_part(x, '=', 1) ELSE x END"
    v_raw = "CASE WHEN contains(x, '=') THEN regexp_extract(x, '^[^=]*=(.*)$', 1) ELSE '' END"
    pair = "{'k': " + dec(k_raw) + ", 'v': " + dec(v_raw) + "}"
    pairs = f"list_transform(list_filter(string_split({qx}, '&'), lambda x: x <> ''), lambda x: {pair})"
    kept = f"list_sort(list_filter({pairs}, lambda p: NOT {tracking('p.k')}))"
    enc = f"list_transform({kept}, lambda p: {form_encode('p.k')} || '=' || {form_encode('p.v')})"
    return f"CASE WHEN {qx} = '' THEN '' ELSE array_to_string({enc}, '&') END"


def norm_url(u: str) -> str:
    s = url_split(u)
    scheme, netloc0, path0 = s["scheme"], f"lower({s['netloc']})", s["path"]
    netloc = (f"CASE WHEN {scheme} = 'http' AND suffix({netloc0}, ':80') THEN regexp_replace({netloc0}, ':80$', '') "
              f"WHEN {scheme} = 'https' AND suffix({netloc0}, ':443') THEN regexp_replace({netloc0}, ':443$', '') "
              f"ELSE {netloc0} END")
    path = (f"CASE WHEN {path0} = '' THEN '/' WHEN length({path0}) > 1 AND suffix({path0}, '/') "
            f"THEN regexp_replace({path0}, '/+$', '') ELSE {path0} END")
    qn = norm_query(s["query"])
    return (f"CASE WHEN {scheme} IS NOT NULL THEN {scheme} || '://' || {netloc} || {path} || "
            f"CASE WHEN {qn} <> '' THEN '?' || {qn} ELSE '' END END")


def url_host(u: str) -> str:
    low = f"regexp_replace(lower(coalesce({u}, '')), '^[\\x00-\\x20]+|[\\t\\r\\n]', '', 'g')"
    raw = f"regexp_extract({low}, {q(r'^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)')}, 1)"
    return f"regexp_replace(regexp_replace({raw}, '^\\[|\\]$', '', 'g'), '^www\\.', '')"


def slug_title(u: str) -> str:
    s = url_split(u)
    path = f"regexp_replace({s['path']}, '/+$', '')"
    last = f"string_split({path}, '/')[-1]"
    seg = f"url_decode({last})"
    seg = f"regexp_replace({seg}, '(?i)\\.(html?|php|aspx?|jsp|md|pdf|txt)$', '')"
    seg = f"regexp_replace({seg}, 'v[0-9]+$', '')"
    seg2 = f"regexp_replace({seg}, '[-_+]+', ' ', 'g')"
    cleaned = f"regexp_replace({strip_ws(seg2)}, {q(WS + '+')}, ' ', 'g')"
    words = (f"list_transform(string_split({cleaned}, ' '), lambda w: CASE WHEN lower(w) IN {in_list(KNOWN_ACRONYMS)} "
             f"THEN upper(w) ELSE upper(substr(w, 1, 1)) || substr(w, 2) END)")
    bad = (f"({path} = '' OR {path} = '/' OR regexp_full_match({seg}, '[0-9.\\-_v]+') OR length({cleaned}) < 3)")
    return f"CASE WHEN coalesce({u}, '') <> '' AND NOT {bad} THEN array_to_string({words}, ' ') END"


def coeff_values() -> str:
    rows = ", ".join(f"({i}, {a}::UBIGINT, {b}::UBIGINT)" for i, (a, b) in enumerate(coefficient_table().tolist()))
    return f"(VALUES {rows}) AS coef(i, a, b)"


def minhash_cte(source: str, id_expr: str, text_expr: str, name: str = "sigs") -> str:
    """CTE text defining ``{name}(id, sig)`` with sig = list of 128 UBIGINT."""
    norm = collapse_ws(f"lower(coalesce({text_expr}, ''))")
    return f"""
{name}_norm AS (SELECT {id_expr} AS id, {norm} AS t FROM {source}),
{name}_sh AS (
  SELECT id, CASE WHEN length(t) <= 9 THEN t ELSE substr(t, g.i::BIGINT, 9) END AS s
  FROM {name}_norm, LATERAL (SELECT unnest(range(1, greatest(length(t) - 8, 1) + 1)) AS i) g
  WHERE length(t) > 0),
{name}_base AS (SELECT DISTINCT id, ('0x' || substr(sha1(s), 1, 8))::UBIGINT AS x FROM {name}_sh),
{name}_min AS (SELECT id, coef.i AS i, min((coef.a * x + coef.b) % 4294967296) AS m
  FROM {name}_base, {coeff_values()} GROUP BY id, coef.i),
{name} AS (SELECT id, list(m::BIGINT ORDER BY i) AS sig FROM {name}_min GROUP BY id)"""


def agree(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END))"
