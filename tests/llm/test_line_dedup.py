import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagelens.llm import line_dedup
from pagelens.llm.line_dedup import Run, neighbours


def brute(rows, least_chars=20, least_docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < least_docs or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def sort(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(1)
    common = "This LINE stands in nearly every document"
    some = [f"line {i} which is shared by {'some' * (i % 3)} documents" for i in range(40)]
    rows = []
    for i in range(400):
        own = [rng.choice(some) if rng.random() < 0.4 else rng.choice(["", "short", "é" * 19, "É" * 20, "é" * 20, " \t" + "x" * 20 + "\x0b", " " + "x" * 20, f"only in {i} and nowhere else at all"]) for _ in range(rng.randint(0, 8))]
        if rng.random() < 0.9:
            own.insert(rng.randint(0, len(own)), rng.choice([common, common.lower() + " \r", "\t" + common.upper()]))
        rows.append((i // 2 if rng.random() < 0.2 else i, "\n".join(own)))
    return rows + rows[:5] + [(None, common), (None, None), (7, None), (1000, common + "\n" + common), (-5, "a" * 30 + "\n" + common), (3, "\n" * 50_000 + common)]


def test_line_dedup_equals_brute_force(spark, lines):
    frame = spark.createDataFrame(lines, "doc_id long, text string").repartition(6)
    want = sort(r[:4] for r in brute(lines))
    for n in ("4", "37"):  # few ranges, and so many that a common line spans several
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert sort(line_dedup.dedup_lines(frame).collect()) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sort(line_dedup.dedup_lines(frame, 5, 2).collect()) == sort(r[:4] for r in brute(lines, 5, 2))


def test_texts_and_bitmaps(spark, lines):
    frame = spark.createDataFrame(lines, "doc_id long, text string").repartition(3)
    for name in ("line", "row_key", "keep", "row", "a.b", "n_lines", "part"):
        frame = frame.withColumn(name, F.lit("x"))
    out = line_dedup.without_repeated_lines(frame)
    assert out.columns == frame.columns
    assert sort((r.doc_id, r.text or "") for r in out.select("doc_id", "text").collect()) == sort((r[0], r[4]) for r in brute(lines))
    assert out.where("text is null").count() == 2 and {r["a.b"] for r in out.collect()} == {"x"}
    long = [r for r in line_dedup.keep_bitmaps(frame).collect() if r.n_lines > 50_000]
    assert [r.n_dropped for r in long] == [1] and len(long[0].keep) < 100
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.without_repeated_lines(none).columns == ["doc_id", "text"]


def test_runs_over_several_ranges():
    a, b = b"a", b"b"
    edges = [(0, False, Run(b"0", 9, 9, 1), Run(a, 9, 9, 1)), (2, True, Run(a, 9, 5, 2), Run(a, 9, 5, 2)), (3, False, Run(a, 5, 4, 2), Run(b, 8, 8, 1)), (4, True, Run(b, 8, 8, 1), Run(b, 8, 8, 1))]
    got = neighbours(edges)
    assert got[0] == (None, Run(a, 9, 4, 3)) and got[2] == (Run(a, 9, 9, 1), Run(a, 5, 4, 2))
    assert got[3] == (Run(a, 9, 5, 2), Run(b, 8, 8, 1)) and got[4] == (Run(b, 8, 8, 1), None)
