from sieveworks.sources.lists import load_domains, load_terms


def test_line_numbers_over_files_and_splits(spark, tmp_path):
    """Numbers run on over the files in the order of their names, through splits far smaller than a file."""
    want = []
    for f in range(5):
        lines = [("   " if i % 11 == 3 else f" file {f} line {i} " + "x" * (i % 40)) for i in range(400 if f != 2 else 0)]
        (tmp_path / f"part-{f}.txt").write_text("".join(line + "\n" for line in lines))
        want += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "30000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r.pos, r.term) for r in load_terms(spark, str(tmp_path)).collect())
            assert got == [(i, line.strip()) for i, line in enumerate(want) if line.strip()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_domain_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "d.txt").write_text("# note\n B.example \n\na.example")
    assert sorted(map(tuple, load_domains(spark, str(tmp_path / "d.txt")).collect())) == [(1, "b.example"), (3, "a.example")]
    assert load_domains(spark, str(tmp_path / "none.txt")).collect() == []
