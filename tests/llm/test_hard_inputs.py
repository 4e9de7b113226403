"""Inputs that earlier rounds got wrong: shared ids, odd column names, deep and broken pages, similarities at the threshold."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import common, components, mixing, near_dedup, substring_dedup, toxicity
from pagelens.llm.html_blocks import blocks


def words(rng, n):
    return [f"w{rng.randrange(50_000)}" for _ in range(n)]


def one_changed(text):
    return " ".join(["other", *text.split()[1:]])


def test_different_texts_under_one_doc_id(spark):
    rng = random.Random(1)
    a, b, c = (" ".join(words(rng, 200)) for _ in range(3))
    rows = [(5, a), (5, b), (9, one_changed(a)), (1, one_changed(b)), (7, c), (7, one_changed(c)), (7, c + "  "), (8, c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.text): r for r in near_dedup.near_duplicates(frame).join(frame.withColumn("text_key", F.xxhash64("text")), ["doc_id", "text_key"]).collect()}
    assert got[5, a].class_id == got[9, one_changed(a)].class_id == 5 and got[5, b].class_id == got[1, one_changed(b)].class_id == 1
    assert {k for k, r in got.items() if r.kept and k[0] != 7} == {(5, a), (1, one_changed(b))} and sum(r.kept for k, r in got.items() if k[0] == 7) == 1
    kept = near_dedup.keep_one_each(frame).collect()
    assert sorted(r.doc_id for r in kept) == [1, 5, 7] and [r.text for r in kept if r.doc_id == 5] == [a]


def test_column_names_with_dots(spark):
    rows = [(i, " ".join(f"x{i}y{k}" for k in range(30)), "en", "s", 1, "z") for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for stage in (lambda d: toxicity.without_toxic(d, labels), near_dedup.keep_one_each, substring_dedup.without_repeats, lambda d: mixing.take_mix(d, labels)):
        out = stage(frame)
        assert out.columns == frame.columns and {r["a.b"] for r in out.collect()} == {"z"}


def test_links_of_blocks_do_not_depend_on_precision():
    rng = np.random.default_rng(2)
    idf = np.ones(near_dedup.CELLS, np.float32)
    import pyarrow as pa

    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[: 60 - k], *(f"v{k}{i}" for i in range(k))]) for k in rng.integers(0, 20, 40)]

    class Held:
        value = idf

    made = [near_dedup._one_set(near_dedup.word_hashes(*found(t), lower=True), idf) for t in texts]
    for i in range(20):
        for j in range(20, 40):
            threshold = near_dedup.similarity(made[i], made[j])
            if threshold:
                table = pa.table({"query": [True, False], "id": [1, 2], "c": [1, 2], "text": pa.array([texts[i], texts[j]])})
                assert near_dedup._block_links(Held, threshold)(table).num_rows == 1
                assert near_dedup._block_links(Held, float(np.nextafter(threshold, 2)))(table).num_rows == 0


def found(text):
    import pyarrow as pa

    data, offsets = near_dedup.text_bytes(pa.array([text]))
    starts, ends, _ = near_dedup.find_words(data, offsets)
    return data, starts, ends


@pytest.mark.parametrize("piece", ['<div class="a b">x', "<b><h1>x", "<p><b>x", "<select>x", "<a href=x><i>y", "<table><tr><td>x", "</b>x", "<li>x", "<iframe/>x", "x<a ", 'x<div class="', "x<!-", "<svg>x</svg>x"])
def test_deep_and_broken_pages_take_linear_time(piece):
    times = []
    for n in (4_000, 32_000):
        began = time.process_time()
        got = blocks(piece * n)
        times.append(time.process_time() - began)
        assert sum(b.text.count("x") + b.text.count("y") for b in got) == n or piece == "x<!-"
        assert max(len(b.path) for b in got) <= 64 * 25
    assert times[1] < 8 * 3 * max(times[0], 0.05)


def test_elements_without_end_tag_leave_the_rest(spark):
    text = lambda page: [b.text for b in blocks(page)]
    for tag in ("select", "noscript", "iframe", "textarea", "template", "title", "object"):
        assert text(f"<article><p>one</p><{tag} a='1'><p>main text</p></article>")[-1] == "main text", tag
        assert text(f"<p>one</p><{tag}/><p>two</p>") == ["one", "two"], tag
        assert text(f"<p>one</p><{tag}>gone</{tag}><p>two</p>") == ["one", "two"], tag
    assert text('<p>one</p><textarea><a "</textarea><p>two</p><svg><!-- </svg><p>three "</p>') == ["one", "two", 'three "']
    assert text("<p>one</p><script>if (a < b) '<p>no</p>'") == ["one"]


def test_near_dedup_plans_stay_small(spark, documents, monkeypatch):
    """The driver holds and plans anew the whole of a query after each of its exchanges; what a query reads twice is written once."""
    lines = []

    def written(df, write=near_dedup.cut):
        lines.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return write(df)

    monkeypatch.setattr(near_dedup, "cut", written)
    monkeypatch.setattr(components, "cut", written)
    kept = near_dedup.keep_one_each(documents)
    lines.append(kept._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert max(lines) <= 70, sorted(lines)


def test_near_dedup_takes_the_driver_few_stages(spark, documents):
    """Each stage and each table that is broadcast takes a block of 4 MB of the driver's heap; 123 stages before."""
    context = spark.sparkContext
    context.setJobGroup("near", "near")
    near_dedup.keep_one_each(documents).collect()
    context.setJobGroup("other", "other")
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("near") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < sum(1 for s in stages if s and s.numCompletedTasks) <= 118


def test_key_like_the_row_of_no_key_is_joined_once(spark):
    left = spark.createDataFrame([(i % 2, i) for i in range(20)], "k long, x long")
    right = spark.createDataFrame([(0, "a", 10_000), (1, "b", 10_000)], "k long, y string, n long")
    listed = {r.k: r._parts for r in common.hot_keys(right, ["k"]).collect()}
    assert listed == {0: 1, 1: 20}
    got = common.spread_join(left, right, ["k"], deal=F.col("x")).collect()
    assert sorted((r.k, r.x, r.y) for r in got) == sorted((i % 2, i, "ab"[i % 2]) for i in range(20))
