import datetime
import random
import re

import pytest

from sieveworks.llm.pii import pseudonymise

KEY = "test-key"


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonymise(df, KEY).orderBy("doc_id").collect()]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def with_check(d):
    return next(d + c for c in "0123456789" if luhn(d + c))


RNG = random.Random(4)
VALUES = {
    "email": ([f"ann{i}.Lee@mail{i % 9}.example.com" for i in range(200)], r"[a-z]{3}\d+\.[A-Z][a-z]{2}@[a-z]{4}\d\.[a-z]{7}\.com"),
    "ipv4": ([f"{RNG.randrange(256)}.{RNG.randrange(256)}.{RNG.randrange(256)}.{RNG.randrange(256)}" for _ in range(200)], r"\d+\.\d+\.\d+\.\d+"),
    "phone": ([f"+1 ({RNG.randrange(1000):03}) 555-{i:04}" for i in range(200)], r"\+1 \(\d{3}\) \d{3}-\d{4}"),
    "card": ([with_check(f"{RNG.randrange(10**15):015}") for _ in range(200)], r"\d{16}"),
    "card4": ([re.sub(r"(\d{4})(?=\d)", r"\1 ", with_check(f"{RNG.randrange(10**15):015}")) for _ in range(50)], r"\d{4}( \d{4}){3}"),
    "ssn": ([f"{RNG.choice([1, 665, 667, 899, 123]):03}-{RNG.randrange(1, 100):02}-{RNG.randrange(1, 10000):04}" for _ in range(200)], r"\d{3}-\d\d-\d{4}"),
    "ymd": ([str(datetime.date(1900, 1, 1) + datetime.timedelta(days=RNG.randrange(73049))) for _ in range(200)], r"(19|20)\d\d-\d\d-\d\d"),
    "secret": ([f'token = "{RNG.getrandbits(160):040x}"' for _ in range(100)], r'token = "[0-9a-f]{40}"'),
}


@pytest.fixture(scope="module")
def mapped(spark):
    flat = [v for values, _ in VALUES.values() for v in values]
    out = run(spark, [f"aé {v} z\n{v}!" for v in flat])
    return dict(zip(flat, out, strict=True))


@pytest.mark.parametrize("kind", VALUES)
def test_formats_and_links(mapped, kind):
    values, shape = VALUES[kind]
    seen = {}
    for v in values:
        m = re.fullmatch(r"(?s)aé (.*) z\n(.*)!", mapped[v])
        assert m[1] == m[2] and re.fullmatch(shape, m[1]), (v, mapped[v])
        seen[v] = m[1]
    assert len(set(seen.values())) == len(seen)
    assert sum(a == b for a, b in seen.items()) <= 1
    for new in seen.values():
        if kind.startswith("card"):
            assert luhn(new.replace(" ", ""))
        if kind == "ipv4":
            assert max(map(int, new.split("."))) < 256
        if kind == "ymd":
            datetime.date.fromisoformat(new)
        if kind == "ssn":
            assert 1 <= int(new[:3]) <= 899 and new[:3] != "666" and new[4:6] != "00" and new[7:] != "0000"


def test_a_whole_format_is_permuted(spark):
    days = [str(datetime.date(1900, 1, 1) + datetime.timedelta(days=i)) for i in range(0, 73049)]
    df = spark.createDataFrame([(d,) for d in days], "text string").repartition(4)
    assert sorted(r.text for r in pseudonymise(df, KEY).collect()) == days


def test_invalid_values_and_edge_rows(spark):
    same = [None, "", "no pii here", "4929963689861572" if not luhn("4929963689861572") else "4929963689861570", "999.1.2.3", "2023-02-30",
            "666-12-1234", "1.2.3.4.5", "a @ b.c", "12345678901234567890123"]
    assert run(spark, same) == same
    long = "x" * 200_000 + " 31.12.1999 12/31/1999 " + "y@" * 1000
    out = run(spark, [long])[0]
    assert len(out) == len(long) and " 31.12.1999 12/31/1999 " not in out
    df = spark.createDataFrame([(1, "a@b.com", 9), (1, "a@b.com", 9)], "doc_id long, text string, n_pseudonyms int")
    rows = pseudonymise(df, KEY).collect()
    assert rows[0] == rows[1] and rows[0].n_pseudonyms == 1 and rows[0].text != "a@b.com"
    assert pseudonymise(df.limit(0), KEY).collect() == []


def test_secrets_without_digits(spark):
    texts = ["my password: correcthorsebattery today", "API_KEY=abcdefghijkl", 'secret = "correcthorsebattery"', "password correcthorsebattery: x"]
    out = run(spark, [*texts, texts[0] + " 1"])
    assert out[3] == texts[3]
    for a, b in zip(texts[:3], out[:3], strict=True):
        assert a != b and re.sub("[a-z]{12,}", "", a) == re.sub("[a-z]{12,}", "", b)
    value = out[0].split()[2]
    assert len(value) == 19 and out[4] == out[0] + " 1" and out[2] == f'secret = "{value}"'


def test_long_secrets_to_their_end(spark):
    rng = random.Random(6)
    for alphabet, size in (("0123456789abcdef", 240), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 5000)):
        value = "".join(rng.choice(alphabet) for _ in range(size))
        new, again = (x[len('token = "'):-len('" end')] for x in run(spark, [f'token = "{value}" end'] * 2))
        assert new == again and len(new) == size and set(new) <= set(alphabet)
        assert not any(value[i:i + 20] in new for i in range(size - 20)) and value[-20:] != new[-20:]
    assert run(spark, ["token=" + "/" * 100_000 + "a" * 100_000 + "!"])[0].endswith("!")


def test_secrets_of_many_kinds_to_their_end(spark):
    rng = random.Random(9)
    part = lambda n: "".join(rng.choice("abcdefghijkLMNOPQR0123456789") for _ in range(n))
    jwt = f"eyJ{part(20)}1.{part(60)}.{part(43)}"
    cases = [(f'token = "', jwt, '"'), ("password: ", "Tr0ub4dor&3xyzLong", " end"), ("password=", "hunter2pass", ""), ("client_secret: ", part(24) + "7", ","),
             ("Authorization: Bearer ", jwt, "\n"), ("pwd = '", "p4ss,word;", "' x"), ("x-api-key: ", part(32) + "==", ""), ("Passphrase: ", "aé7-long,er", "")]
    out = run(spark, [a + v + b for a, v, b in cases] + [a + v + "." for a, v, b in cases[4:5]])
    for (a, v, b), new in zip(cases, out, strict=False):
        got = new[len(a):len(new) - len(b)]
        assert new.startswith(a) and new.endswith(b) and len(got) == len(v)
        runs = [(x, y) for x, y in zip(re.findall("[A-Za-z0-9]+", v), re.findall("[A-Za-z0-9]+", got), strict=True)]
        assert any(x != y for x, y in runs) and all(x != y for x, y in runs if len(x) >= 4), (v, got)
    assert out[-1] == out[4][:-1] + "."  # the same secret at a sentence's end
    same = ["the token: short", "password: none", "a bearer of bad news-and-more", "pass the word: abcdefghijkl"]
    assert run(spark, same) == same
    amex = with_check("37828224631000")
    spaced = f"{amex[:4]} {amex[4:10]} {amex[10:]}"
    new = run(spark, [spaced])[0]
    assert new != spaced and re.fullmatch(r"\d{4} \d{6} \d{5}", new) and luhn(new.replace(" ", ""))


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        pseudonymise(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "")
