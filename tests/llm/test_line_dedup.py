import random

from sieveworks.llm.line_dedup import dedup_lines

from .brute import WORD


def brute(texts: dict, min_words=50) -> dict:
    """Every qualifying run at every place, looked up among all earlier places."""
    seen, gone = {}, {d: set() for d in texts}
    for d in sorted(texts):
        lines = texts[d].split("\n")
        size = [len(WORD.findall(x)) for x in lines]
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += size[b]
                if total >= min_words:
                    run = tuple(lines[a:b + 1])
                    if run in seen and seen[run] < (d, a):
                        gone[d].update(range(a, b + 1))
                    else:
                        seen.setdefault(run, (d, a))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in texts.items()}


def result(spark, texts, **kw):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in dedup_lines(df, **kw).collect()}


def test_random_runs_match_brute_force(spark):
    rng = random.Random(5)
    lines = [" ".join(f"w{i}x{j}" for j in range(rng.choice([0, 1, 2, 3, 6, 20]))) for i in range(25)]
    texts = {}
    for d in range(60):
        out = []
        for _ in range(rng.randrange(1, 8)):
            a = rng.randrange(20)
            out += lines[a:a + rng.randrange(1, 12)] if rng.random() < 0.7 else [lines[a]] * rng.randrange(1, 9)
        texts[d] = "\n".join(out)
    for words in (3, 12, 50):
        assert result(spark, texts, min_words=words) == brute(texts, words)


def test_edge_rows(spark):
    long = " ".join(["word"] * 50)
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (4, f"a\n{long}\nb", 0), (4, f"a\n{long}\nb", 0), (None, long, 0),
            (5, "x\n" * 5000 + "end", 0), (6, long.upper(), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines_removed int").selectExpr("*", "1 as stretch", "2 as k", "3 as gone2")
    got = sorted(((r.doc_id or 0, r.text, r.lines_removed) for r in dedup_lines(df).collect()), key=str)
    assert got == sorted([(0, long, 0), (1, None, 0), (2, "", 0), (3, "", 1), (4, "a\nb", 1), (4, "a\nb", 1),
                          (5, "x\nend", 4999), (6, long.upper(), 0)], key=str)
    assert dedup_lines(df.limit(0)).collect() == []
