"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Recognised values: e-mail addresses, US-style phone numbers, IPv4 addresses,
payment-card numbers that pass the Luhn check, social-security numbers, dates
(year-month-day, day.month.year, month/day/year) that exist, and secrets
assigned to a name such as token, client_secret or password, or after Bearer. Each is replaced by a value of
the same format, permuted within that format's valid values by a keyed Feistel
network; equal values get equal pseudonyms in all documents and different
values different ones. What only looks like such a value stays as it is.

A Feistel network works on a pair (A, B) from ranges of sizes (m, n): rounds
alternate A += f(round, B) mod m and B += f(round, A) mod n, where f is an
HMAC-like SHA-256 of the key, the kind, the length, the round and the other
half. Each round can be undone, so the whole is a permutation of the m * n
values, whatever m and n are; nothing has to be walked or rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Longest run of characters permuted as one value; 26^11, a half's range, is exact in a double.
BLOCK = 22

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Fixed patterns, tried in this order at each place (Java syntax; groups do not capture).
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
# A secret's name may be the end of a longer one (client_secret). Passwords run to white space or a quote, whatever they
# hold; tokens are of the characters that encodings use. Below the lengths given, what follows a name is mostly prose.
PASSWORD_MIN, TOKEN_MIN = 8, 12
PASSWORD_NAME = r"(?i:(?<![A-Za-z0-9])(?:password|passwd|passphrase|pwd)\"?\s{0,3}[=:]\s{0,3})[\"']?"
TOKEN_NAME = r"(?i:(?<![A-Za-z0-9])(?:token|secret|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key)\"?\s{0,3}[=:]\s{0,3})[\"']?"
BEARER = r"(?i:(?<![A-Za-z0-9])bearer\s{1,3})(?=[^\s0-9]{0,64}[0-9])"
SECRET = (r"(?:" + PASSWORD_NAME + r"[^\s\"']{%d,}[^\s\"'.,;:!?)]" % (PASSWORD_MIN - 1) + r"|(?:" + TOKEN_NAME + "|" + BEARER
          + r")[A-Za-z0-9_+/.~=-]{%d,}[A-Za-z0-9_+/~=-])" % (TOKEN_MIN - 1))
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
DATE_YMD = r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?!-?[0-9])"
DATE_DMY = r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}(?!\.?[0-9])"
DATE_MDY = r"(?<![0-9/])[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}(?!/?[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
PHONE = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
KINDS = {"email": EMAIL, "secret": SECRET, "ipv4": IPV4, "ymd": DATE_YMD, "dmy": DATE_DMY, "mdy": DATE_MDY,
         "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

DATE_START, DATE_HALVES = "1900-01-01", (17, 4297)  # 17 * 4297 days: to the end of 2099


def _round(key: str, kind: str, size: Column, r: int, half: Column) -> Column:
    """60 keyed pseudo-random bits from the other half."""
    inner = F.sha2(F.concat_ws(":", F.lit(f"{key}:{kind}:{r}"), size.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(F.sha2(F.concat(F.lit(key), inner), 256), 1, 15), 16, 10).cast("long")


def _let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once and bound to v."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, kind: str, size: Column) -> Column:
    """struct(a, b): the pair permuted within [0, m) x [0, n)."""
    state = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    for r in range(ROUNDS):
        if r % 2 == 0:
            state = _let(state, lambda s, r=r: F.struct(
                F.pmod(s["a"] + F.pmod(_round(key, kind, size, r, s["b"]), m), m).alias("a"), s["b"].alias("b")))
        else:
            state = _let(state, lambda s, r=r: F.struct(
                s["a"].alias("a"), F.pmod(s["b"] + F.pmod(_round(key, kind, size, r, s["a"]), n), n).alias("b")))
    return state


def _by_class(c: Column) -> Column:
    return F.when(c.between("0", "9"), DIGITS).when(c.between("a", "z"), LOWER).otherwise(UPPER)


def _hex_lower(c: Column) -> Column:
    return F.lit("0123456789abcdef")


def _hex_upper(c: Column) -> Column:
    return F.lit("0123456789ABCDEF")


def _permute_block(block: Column, key: str, kind: str, alphabet) -> Column:
    """Each character exchanged for one of its own alphabet."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    radix = lambda c: F.length(alphabet(c)).cast("long")

    def size(cs):
        return F.aggregate(cs, one, lambda p, c: p * radix(c))

    def number(cs):
        return F.aggregate(cs, zero, lambda v, c: v * radix(c) + F.instr(alphabet(c), c) - 1)

    def spell(cs, v):
        return F.aggregate(
            F.reverse(cs), F.struct(v.alias("v"), F.lit("").alias("s")),
            lambda t, c: F.struct(((t["v"] - t["v"] % radix(c)) / radix(c)).cast("long").alias("v"),
                                  F.concat(F.substr(alphabet(c), (t["v"] % radix(c) + 1).cast("int"), F.lit(1)), t["s"]).alias("s")),
            lambda t: t["s"])

    def whole(cs):
        cut = F.floor(F.size(cs) / 2).cast("int")
        pair = F.struct(F.slice(cs, F.lit(1), cut).alias("l"), F.slice(cs, cut + 1, F.size(cs)).alias("r"))
        shape = F.array_join(F.transform(cs, lambda c: radix(c).cast("string")), ",")
        return _let(pair, lambda p: _let(
            feistel(number(p["l"]), number(p["r"]), size(p["l"]), size(p["r"]), key, kind, shape),
            lambda s: F.concat(spell(p["l"], s["a"]), spell(p["r"], s["b"]))))

    return _let(F.filter(F.split(block, ""), lambda c: c != ""), whole)


def _replace(text: Column, pattern: str, body) -> Column:
    """Every match of ``pattern`` exchanged for ``body(match)``."""
    between = F.split(text, pattern, -1)
    new = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), body)
    return F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _permute(text: Column, key: str, kind: str, alphabet=_by_class) -> Column:
    return _replace(text, "[A-Za-z0-9]{1,%d}" % BLOCK, lambda b: _permute_block(b, key, kind, alphabet))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _pad(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _refill(text: Column, digits: Column) -> Column:
    """``text`` with its digits exchanged, in order, for those of ``digits``."""
    step = lambda t, c: F.when(c.between("0", "9"), F.struct(
        (t["i"] + 1).alias("i"), F.concat(t["s"], F.substr(digits, t["i"], F.lit(1))).alias("s"))).otherwise(
        F.struct(t["i"].alias("i"), F.concat(t["s"], c).alias("s")))
    return F.aggregate(F.split(text, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("s")), step, lambda t: t["s"])


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number's digits, the last one counted once."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda s, v: s + v)


def _email(v: Column, key: str) -> Column:
    at = r"^([^@]+)@(.+)(\.[^.]+)$"
    return F.concat(_permute(_part(v, at, 1), key, "local"), F.lit("@"), _permute(_part(v, at, 2), key, "domain"), _part(v, at, 3))


def _secret(v: Column, key: str) -> Column:
    cut = r"(?s)^(" + PASSWORD_NAME + "|" + TOKEN_NAME + r"|(?i:bearer\s{1,3}))(.*)$"
    name, value = _part(v, cut, 1), _part(v, cut, 2)
    new = F.when(value.rlike("^[0-9a-f]+$"), _permute(value, key, "hex", _hex_lower)) \
        .when(value.rlike("^[0-9A-F]+$"), _permute(value, key, "hex", _hex_upper)).otherwise(_permute(value, key, "secret"))
    return F.concat(name, new)


def _ipv4(v: Column, key: str) -> Column:
    octets = F.transform(F.split(v, "\\."), lambda o: o.cast("int"))
    new = lambda o: _let(feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4", F.lit("")),
                         lambda s: F.concat_ws(".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))
    return F.when(F.forall(octets, lambda o: o <= 255), _let(octets, new)).otherwise(v)


def _date(v: Column, key: str, order: str) -> Column:
    at = {"ymd": (1, 6), "dmy": (7, 4), "mdy": (7, 1)}[order]
    day = {"ymd": 9, "dmy": 1, "mdy": 4}[order]
    iso = F.concat_ws("-", F.substring(v, at[0], 4), F.substring(v, at[1], 2), F.substring(v, day, 2))
    count = F.datediff(iso.try_cast("date"), F.lit(DATE_START).cast("date"))
    m, n = DATE_HALVES
    style = {"ymd": "yyyy-MM-dd", "dmy": "dd.MM.yyyy", "mdy": "MM/dd/yyyy"}[order]
    new = lambda c: _let(feistel(F.floor(c / n), c % n, F.lit(m), F.lit(n), key, "date", F.lit("")),
                         lambda s: F.date_format(F.date_add(F.lit(DATE_START).cast("date"), (s["a"] * n + s["b"]).cast("int")), style))
    return F.when(count.isNotNull(), _let(count, new)).otherwise(v)


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.substring(v, *x).cast("int") for x in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    a = area - 1 - (area > 666).cast("int")
    new = _let(feistel(a, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", F.lit("")), lambda s: F.concat_ws(
        "-", _pad(s["a"] + 1 + (s["a"] >= 665).cast("int"), 3), _pad(F.floor(s["b"] / 9999) + 1, 2), _pad(s["b"] % 9999 + 1, 4)))
    return F.when(valid, new).otherwise(v)


def _phone(v: Column, key: str) -> Column:
    number = F.substring(_digits(v), -10, 10)
    ten = _let(feistel(F.substring(number, 1, 5), F.substring(number, 6, 5), F.lit(100000), F.lit(100000), key, "phone", F.lit("")),
               lambda s: F.concat(_pad(s["a"], 5), _pad(s["b"], 5)))
    return _let(ten, lambda t: _refill(v, F.concat(F.when(F.length(_digits(v)) > 10, F.lit("1")).otherwise(""), t)))


def _card(v: Column, key: str) -> Column:
    new = lambda body: _let(F.pmod(F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)),
                            lambda last: _refill(v, F.concat(body, last.cast("string"))))
    d = _digits(v)
    body = _permute_block(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", _by_class)
    return F.when(_luhn_sum(d) % 10 == 0, _let(body, new)).otherwise(v)


_MAKERS = {"email": _email, "secret": _secret, "ipv4": _ipv4, "ssn": _ssn, "phone": _phone, "card": _card,
           **{o: (lambda v, key, o=o: _date(v, key, o)) for o in ("ymd", "dmy", "mdy")}}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one recognised value; the value itself if it is not valid."""
    out = F.when(F.lit(False), value)
    for kind, pattern in KINDS.items():
        out = out.when(value.rlike(f"^(?:{pattern})$"), _MAKERS[kind](value, key))
    return out.otherwise(value)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and the column n_pseudonyms added (replaced, if there).

    Null texts stay null and empty ones empty, with 0 pseudonyms. Repeated
    rows are treated alike; all other columns pass through. Nothing is
    shuffled or remembered: the key alone links equal values, and who has it
    can undo the pseudonyms, so it must be given and not be empty.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(text_col)
    # Every pattern needs one of these characters: a digit, the @ of an address, or a secret's = or colon.
    hits = F.when(text.rlike("[0-9@=:]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    found = docs.withColumn("_hits", hits)
    found = found.withColumn("_new", F.transform("_hits", lambda v: pseudonym(v, key)))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip("_hits", "_new"), lambda z: z["_hits"] != z["_new"]))
    return (found.withColumn("n_pseudonyms", F.when(F.size("_hits") > 0, changed).otherwise(0))
            .withColumn(text_col, F.when(F.size("_hits") > 0, joined).otherwise(text)).drop("_hits", "_new"))
