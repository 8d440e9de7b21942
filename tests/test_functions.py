import hashlib

import pytest

from sieveworks.functions import minhash as M
from sieveworks.functions import text as T
from sieveworks.functions import urls as U

# URL -> canonical form, written out by hand from RFC 3986 (case of scheme and host, default
# ports, empty path) and the form-encoding rules (sorted pairs, + for a space, %XX upper case).
CANONICAL = [
    ("HTTP://News.Example:80/Über/?z=1&a=2#top", "http://news.example/Über?a=2&z=1"),
    ("https://shop.example:443", "https://shop.example/"),
    ("https://shop.example:8443/x/", "https://shop.example:8443/x"),
    ("http://shop.example:443/x", "http://shop.example:443/x"),
    ("https://shop.example/p?utm_campaign=may&id=7&UTM_Source=q", "https://shop.example/p?id=7"),
    ("https://shop.example/p?q=two+words&q=a%20b", "https://shop.example/p?q=a+b&q=two+words"),
    ("https://shop.example/p?blank=&&flag", "https://shop.example/p?blank=&flag="),
    ("https://shop.example/p?mail=a%40b~c*", "https://shop.example/p?mail=a%40b~c%2A"),
    ("https://shop.example/p?v=%C3%A9", "https://shop.example/p?v=%C3%A9"),
    ("https://shop.example/p?v=%20b%zz", "https://shop.example/p?v=+b%25zz"),
    ("https://shop.example/p?v=%4", "https://shop.example/p?v=%254"),
    ("shop.example/p", None),
]


@pytest.mark.parametrize("url,want", CANONICAL)
def test_normalize_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "url string").select(U.normalize_url("url").alias("n")).first().n == want


def test_slug_titles(spark):
    rows = [("https://site.example/notes/deep-sea-cables", "Deep Sea Cables"),
            ("https://files.site.example/a/Field%20Guide.pdf", "Field Guide"),
            ("https://site.example/x/2024.123v4", None)]
    df = spark.createDataFrame(rows, "url string, want string").select("want", U.slug_title("url").alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_title_key_unicode(spark):
    df = spark.createDataFrame([("  Héllo, WORLD!! — ça_va  ",), (None,)], "t string")
    got = [r.k for r in df.select(T.normalize_title("t").alias("k")).collect()]
    assert got == ["héllo world ça_va", ""]


def big_int_signature(text):
    t = " ".join(text.lower().split())
    if not t:
        return None
    grams = {t} if len(t) <= 9 else {t[i:i + 9] for i in range(len(t) - 8)}
    base = {int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "big") for g in grams}
    return [min((a * x + b) % (1 << 32) for x in base) for a, b in M.coefficient_table().tolist()]


def test_signature_kernel_matches_big_ints():
    for text in ["", "short", "exactly9!", "ten chars!", "Le café est très bon " * 20]:
        norm = " ".join(text.lower().split())
        got = M.signature_of(norm)
        assert (got if got is None else got.tolist()) == big_int_signature(text)


def test_band_layout_is_exact():
    bands = M.band_layout(0.5, 128)
    assert sum(w for _, w in bands) == 128 and len(bands) == 65


def test_kernels_equal_the_definition_on_any_text(monkeypatch):
    """Grams of one to four bytes a character, alphabets of over 128, texts around 9 characters and beyond a slab."""
    import hashlib
    import random

    import numpy as np

    rng = random.Random(4)
    alphabets = ["abc def", "\u00e4\u00f6\u00fc xyz", "\u65e5\u672c \u8a9e", "\U0001f600\U0001f601ab \u00e9", "".join(chr(i) for i in range(0x4E00, 0x4F00))]
    texts = [None, "", "a", "\u00e9", "12345678", "123456789", "1234567890", "x" * 3000]
    texts += ["".join(rng.choice(a) for _ in range(rng.randrange(1, top))) for a in alphabets for top in (12, 60, 2000)]
    coeffs = M.coefficient_table()
    for slab in (M._SLAB, 70):
        monkeypatch.setattr(M, "_SLAB", slab)
        for text, got in zip(texts, M.signatures_of(texts), strict=True):
            if not text:
                assert got is None
                continue
            base = np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "big") for g in M.shingle_set(text)], dtype=np.uint32)
            assert got.tolist() == (coeffs[:, :1] * base + coeffs[:, 1:]).min(axis=1).tolist()
    assert [M.n_shingles_of(t) for t in texts] == [len(M.shingle_set(t or "")) for t in texts]


def test_shingles_are_counted_by_the_kernel(spark):
    """The counter is the Arrow kernel: no array of strings a text is built in the row."""
    df = spark.createDataFrame([(None,), ("",), ("  A  b ",), ("abcdefghij" * 50,)], "text string")
    out = df.select(M.distinct_shingles("text").alias("k"))
    assert [r.k for r in out.collect()] == [0, 0, 1, 10]
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()


def test_a_reference_is_resolved_without_copies_of_its_parts(spark):
    """Shared parts are bound once, so the expression stays small (it held hundreds of regular expressions)."""
    df = spark.createDataFrame([("../b/./c?x=1#f", "http://h.example/a/d/e;p?q=2")], "href string, base string")
    out = df.select(U.resolve_url("href", "base").alias("u"))
    assert out.first().u == "http://h.example/a/b/c?x=1#f"
    assert out._jdf.queryExecution().analyzed().toString().lower().count("regexp_") < 25


def test_signatures_stay_in_the_jvm_and_equal_the_kernel(spark):
    """No Python in the plan (before, each text went through a pandas UDF); grams of 9 code points of one to four bytes."""
    from pyspark.sql import functions as F

    from sieveworks.functions import minhash as M
    from sieveworks.functions import text as T

    texts = [None, "", "  ", "a", "12345678", "x" * 9, "Äöü  éñ\t漢字𝄞𝄞", "𝄞" * 30, "nul\x00 inside of it", "ab" * 4000,
             "".join(chr(c) for c in range(0x7E0, 0x820)), "".join(chr(c) for c in range(0xFFF0, 0x10010) if c not in (0xFFFE, 0xFFFF))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.minhash_text("t").alias("n"), M.signature("t").alias("s"))
    for r in df.collect():
        want = M.signature_of(r.n)
        assert (r.s is None) == (want is None) and (want is None or r.s == want.tolist()), r.id
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "UDF" in plan
    keys = df.select(F.explode(M.band_keys("s", hits=2)).alias("k"))
    # as each key was written before
    at = M.key_layout(hits=2)
    plain = df.where("s is not null").select(F.explode(F.array(*[F.xxhash64(F.lit(i), *[F.get("s", F.lit(p)) for p in x]) for i, x in enumerate(at)])).alias("k"))
    assert keys.exceptAll(plain).count() == plain.exceptAll(keys).count() == 0 and keys.count() == 9 * len(at)
