import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagelens.llm import embedding_dedup, html_main, license_scan, media, mixing, near_dedup, packing, queries, substring_dedup, toxicity, url_filters
from pagelens.llm.components import components
from pagelens.llm.html_blocks import blocks
from pagelens.llm.token_ids import TokenIds

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(frame):
    return sorted(frame.collect(), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


# -- 1 -------------------------------------------------------------------------


def brute_classes(texts, idf):
    sets = {i: near_dedup._one_set(near_dedup.word_hashes(*_found(t), lower=True), idf) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if near_dedup.similarity(sets[a], sets[b]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def _found(text):
    data, offsets = near_dedup.text_bytes(pa.array([text]))
    starts, ends, _ = near_dedup.find_words(data, offsets)
    return data, starts, ends


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    texts, n = {}, 0
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((40, 120, 300)))]
        for _ in range(rng.choice((1, 2, 6, 25))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 2, 4, 9))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts[n] = " ".join(copy)
            n += 1
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    idf = near_dedup.word_weights(frame)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame).collect()} == brute_classes(texts, idf)


def test_near_duplicates_of_awkward_rows(documents, empty):
    got = by_id(near_dedup.near_duplicates(documents))
    classes = [(r.doc_id, r.class_id, r.kept) for r in got]
    assert len(got) == 18 and classes[:4] == [(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    assert [c for c in classes if c[0] in (5, 6, 7)] == [(5, 5, True), (6, 6, True), (7, 7, True)]  # no words: linked with nothing
    assert (8, 8, True) in classes and (9, 8, False) in classes and (14, 1, False) in classes and classes[-1] == (None, None, True)
    kept = near_dedup.keep_one_each(documents)
    assert kept.columns == documents.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 15, 16]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_blocks_find_what_pairs_find():
    rng = np.random.default_rng(0)
    pool = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    unit = rng.uniform(1, 2, len(pool)).astype(np.float32)
    make = lambda: (lambda at: (pool[at], unit[at] * rng.integers(1, 3, len(at))))(np.sort(rng.choice(len(pool), 80, replace=False)))
    left, right = [make() for _ in range(9)], [make() for _ in range(7)]
    got = near_dedup._overlaps(left, right)
    want = [[sum(min(float(x), dict(zip(b[0], b[1])).get(g, 0)) for g, x in zip(*a)) for b in right] for a in left]
    assert np.allclose(got, want, rtol=1e-4)


def test_samples_agree_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = (np.sort(pool[:300]), np.ones(300, np.float32)), (np.sort(pool[60:360]), np.ones(300, np.float32))
    both = near_dedup.samples(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 300]), 600)
    assert abs((both[0] == both[1]).mean() - near_dedup.similarity(a, b)) < 0.07


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (5, 6), (7, 7), (None, 1), (2, 1), *[(100 + i, 101 + i) for i in range(40)]]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, **{100 + i: 100 for i in range(41)}}


def test_one_of_each_group_keeps_columns_of_any_name(spark):
    from pagelens.llm import common

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(2, text, 77, "b"), (1, text, 88, "a"), (1, text, 66, "c"), (3, None, 5, "d"), (None, text, 4, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id long, _key string")
    assert sorted(tuple(r)[2:] for r in near_dedup.keep_one_each(frame).collect()) == [(4, "e"), (5, "d"), (66, "c")]
    assert common.cut(frame).count() == 5


def test_hot_keys_are_joined_over_several_tasks(spark, monkeypatch):
    from pagelens.llm import common

    monkeypatch.setattr(common, "HOT", 10)
    left = common.cut(spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("k"), "id"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    for deal in (None, F.col("id")):
        assert sorted(map(tuple, common.spread_join(left, right, ["k"], deal=deal).collect())) == sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    assert common.spread_join(left, right.where("k > 250"), ["k"], "left").count() == 300


# -- 2 -------------------------------------------------------------------------


def test_media_round_trip(spark, documents, rows, empty, tmp_path):
    uri = f"file://{tmp_path}/media"
    got = by_id(media.media_features(documents, uri))
    want = []
    for i, text, *_ in rows:
        raw = (text or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert [tuple(r)[:5] for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    assert got[0][5:] == got[1][5:]  # equal texts, equal stored forms and features
    assert media.read_media(spark, uri, 500).count() == len(rows)  # many small ranges read each member once
    assert media.media_features(empty, f"file://{tmp_path}/none").count() == 0


def test_members_are_read_again_alone(tmp_path):
    import zipfile

    class Flaky:
        def __init__(self, store, failures):
            self.store, self.failures = store, failures

        def open_input_file(self, path):
            if self.failures:
                self.failures -= 1
                raise OSError("lost")
            return self.store.open_input_file(path)

    png = media.to_png("héllo".encode())
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0/1.png", png)
    member = zipfile.ZipFile(tmp_path / "a.zip").infolist()[0]
    store = media.fs.LocalFileSystem()
    assert media.read_member(Flaky(store, 2), str(tmp_path / "a.zip"), member)[1] == (6, "héllo".encode().ljust(192))
    with pytest.raises(OSError):
        media.read_member(Flaky(store, 9), str(tmp_path / "a.zip"), member, 2)
    with pytest.raises(ValueError):
        media.from_png(png[:-20] + b"x" * 20)


def test_a_failed_request_leaves_members_to_be_read_alone(tmp_path):
    import zipfile

    class Broken:
        """The first request comes back damaged; later ones are whole."""

        def __init__(self, store):
            self.store, self.first = store, True

        def open_input_file(self, path):
            file, broken, self.first = self.store.open_input_file(path), self.first, False
            if broken:
                read = file.read_at
                file = type("File", (), {"__enter__": lambda f: f, "__exit__": lambda f, *_: None, "read_at": lambda f, n, at: read(n, at)[:-150]})()
            return file

    texts = [b"a" * 700, b"", "héllo".encode()]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i, t in enumerate(texts):
            z.writestr(f"{i}/{i}.png", media.to_png(t))
    members = zipfile.ZipFile(tmp_path / "a.zip").infolist()
    store = media.fs.LocalFileSystem()
    want = [(len(t), t + b" " * (192 - len(t) if not t else -len(t) % 192)) for t in texts]
    for reader in (store, Broken(store)):
        assert [payload for _, payload in media.read_members(reader, str(tmp_path / "a.zip"), members)] == want
    assert [len(part) for part in media.spans(members, 1)] == [1, 1, 1] and len(next(media.spans(members))) == 3


# -- 3 -------------------------------------------------------------------------


def test_labels_of_unseen_pages():
    source, model, right, total = random.Random(4321), html_main.trained(), 0, 0
    for _ in range(150):
        x, y = html_main.labelled_page(source)
        if len(x):
            padded, mask = html_main.padded([x])
            right += int(((html_main.probabilities(model, padded, mask)[0] >= 0.5) == (y > 0)).sum())
            total += len(y)
    assert right / total > 0.97


def test_extraction(spark):
    page = """<html><head><title>t</title></head><body><nav><a href=/a>Home</a><a href=/b>News</a></nav><div class="ad">Buy this fine thing now.</div><article><h1>A  title</h1><p>First &amp; long
    paragraph of the article.<p>Les.</p><script>var x="<p>no</p>"</script></article><div class="comments"><p>I read this and liked it.</p></div><footer>&copy; site</footer></body></html>"""
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<nav><a href=/>x</a></nav>"), (4, "z", page.replace("Les.", "x " * 50_000))]
    got = by_id(html_main.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))))
    want = "A title\nFirst & long paragraph of the article.\nLes."
    assert [r.text for r in got[:2]] == [want, want] and got[0].n_chars == len(want)
    assert got[2].text == "" and got[-1].text == "" and len(got[4].text) > 99_000
    assert html_main.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction_equals_the_article_of_whole_pages(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in html_main.extract_main_text(pages).collect()}
    for r in pages.collect():
        body = r.html[r.html.find("<article>") + 9 : r.html.find("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body))
        assert texts[r.page_id] == "\n".join(p for p in parts if p)


def test_broken_markup_does_not_crash():
    for page in ("<", "<p", "<!--", "</p>", "<a <b>>x", "<script>", "<p class='x>y</p>", "<td>" * 2000 + "x", "\x00<p>a"):
        blocks(page)


# -- 4 -------------------------------------------------------------------------


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for _ in range(60):
        base = rng.standard_normal(32)
        for _ in range(rng.integers(1, 9)):
            rows.append((n, (base + rng.standard_normal(32) * rng.choice([0, 0.2, 0.35, 0.5])).astype(np.float32).tolist()))
            n += 1
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [float("nan")] * 32), (1004, [None] + [1.0] * 31), (1005, [1.0] * 5), (None, rows[0][1])]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").withColumn("class", F.lit("clash")).repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    extra = lambda i: int(near[i][0] or i == 0)  # the row without id is a copy of vector 0
    assert all(got[i].n_links == near[i].sum() + extra(i) and got[i].component_id == label[i] and got[i].kept == (label[i] == i) for i in range(n))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1000, 1006)) and not got[None].kept
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_vectors_of_doubles_are_compared_in_doubles(spark):
    angle = math.acos(0.9) + 5e-9
    rows = [(1, [1.0, 0.0]), (2, [math.cos(angle), math.sin(angle)]), (3, [3.0, 0.0])]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 2, 1] and got[2].n_links == 0


def test_multiples_of_one_vector_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(i, (base * (1 + i / 7)).tolist()) for i in range(60)] + [(100 + i, rng.standard_normal(16).tolist()) for i in range(60)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i, _ in rows] == near.tolist()
    low, high = embedding_dedup.block_partners([-np.inf, 0.0, 1.0], [0.0, 1.0, np.inf], 0.5)
    assert low.tolist() == [0, 0, 1] and high.tolist() == [1, 2, 2]


# -- 5 -------------------------------------------------------------------------


def test_mix(documents, labels, empty, rows):
    got = by_id(mixing.mix_sources(documents, labels))
    again = by_id(mixing.mix_sources(documents.repartition(7), labels))
    assert got == again and len(got) == len(rows)
    sizes = [len(WORD.findall(t or "")) for _, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    assert [r.size for r in got] == sizes and all(0 <= r.taken <= 2 * r.size for r in got)
    per_source = defaultdict(int)
    for r in got:
        per_source[r.source_size, r.target] += r.taken
    assert all(abs(taken - target) <= 1 and target <= 2 * size for (size, target), taken in per_source.items())
    assert math.isclose(sum(t for _, t in per_source), 1.5 * sum(sizes))
    assert mixing.mix_sources(empty, labels).count() == 0 and mixing.mix_sources(documents).count() == len(rows)


def test_taken_mix_has_the_words(documents, labels):
    mixed = mixing.take_mix(documents, labels)
    counted = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert mixed.columns == documents.columns and counted == sum(r.taken for r in mixing.mix_sources(documents, labels).collect())




def test_self_closed_and_unclosed_elements_take_no_text():
    texts = lambda page: " ".join(b.text for b in blocks(page))
    assert texts('<p>a <svg class="i" aria-label="x>y"/> b</p><p>c</p><svg><text>no</text></svg><p>d</p>') == "a b c d"
    assert texts("<p>a</p><object data=x><p>b</p><canvas><p>c</p><SVG><p>d") == "a b c d"
    assert texts("<p>a</p><canvas><p>no</p></canvas><object>no</object ><p>b</p>") == "a b"
    digits = html_main.features(blocks(f"<p>{'word ' * 100}{'1' * 500}</p>"))[0, -html_main.MEASURES + 5]
    assert abs(digits - 0.5) < 1e-3


# -- 6 -------------------------------------------------------------------------


def test_toxicity(spark, documents, empty, labels):
    rng = random.Random(8)
    bad = ["grumblefoo", "snarkbar", "vilebaz"]
    rows, marks = [], []
    for i in range(1200):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 120))]
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    frame, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, given.where("doc_id < 800")).collect()}
    held_out = [(got[i].toxic, bool(t)) for i, t in marks if i >= 800]
    assert sum(a == b for a, b in held_out) / len(held_out) > 0.98
    assert np.mean([got[i].severity for i, t in marks if t]) > 1 > np.mean([got[i].severity for i, t in marks if not t])
    kept = toxicity.without_toxic(documents, given)
    assert kept.columns == documents.columns and kept.count() == documents.count()
    assert toxicity.score_toxicity(empty, given).count() == 0 and not any(r.toxic for r in toxicity.score_toxicity(documents, labels.limit(0)).collect())


def test_large_families_count_once(spark):
    rng = random.Random(9)
    text = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n)]
    copied, near = text(80), text(80)
    rows = [(i, " ".join(text(80))) for i in range(100)] + [(1000 + i, " ".join(copied)) for i in range(120)] + [(2000 + i, " ".join([*near[:79], f"own{i}"])) for i in range(120)] + [(3000 + i, "a b") for i in range(60)]
    sample = toxicity.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(1000 <= i < 2000)) for i, _ in rows], "doc_id long, toxic int"))
    weight = dict(zip(sorted(i for i, _ in rows), sample.weights.tolist()))
    assert all(weight[1000 + i] < 0.01 and weight[2000 + i] < 0.01 for i in range(120)) and all(weight[3000 + i] < 0.02 for i in range(60))
    assert sum(weight[i] == 1 for i in range(100)) >= 90  # chance words in common may join a few


# -- 7 -------------------------------------------------------------------------


def test_url_filters(spark):
    captures = [(1, "https://ads.bad.example/x", "2024-02-01"), (1, "https://ads.bad.example/x", "2024-02-01"), (2, "http://bad.example:80", "2024-01-01"), (3, "https://user@BAD.example./p", "2024-03-01"), (4, "https://notbad.example/", "2024-02-01"), (5, None, "2024-02-01"), (6, "https://ok.example/spam/x", "2024-02-01"), (7, "https://ok.example/fine", "2024-02-01"), (8, "", None), (None, "https://bad.example/", "2024-02-10")]
    entries = [("bad.example", "add", "malware", "2024-01-15"), ("bad.example", "remove", "malware", "2024-02-20"), ("ok.example/spam", "add", "spam", "2024-01-01"), ("ads.bad.example", "add", "ads", "2024-02-01"), (None, "add", "x", "2024-01-01"), ("late.example", "add", "x", None)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_on string").withColumn("fetched_on", F.to_date("fetched_on")).withColumn("pattern", F.lit("clash"))
    e = spark.createDataFrame(entries, "pattern string, action string, category string, listed_on string").withColumn("listed_on", F.to_date("listed_on"))
    got = [(r.page_id, r.blocked, r.category) for r in by_id(url_filters.filter_urls(c, e))]
    assert got == [(1, True, "ads"), (1, True, "ads"), (2, False, None), (3, False, None), (4, False, None), (5, False, None), (6, True, "spam"), (7, False, None), (8, False, None), (None, True, "malware")]
    assert url_filters.filter_urls(c, e.limit(0)).where("blocked").count() == 0 and url_filters.filter_urls(c.limit(0), e).count() == 0


def test_hosts_of_other_schemes_and_numeric_addresses(spark):
    rows = [("ftp://Example.com/a/b", "example.com", "a"), ("http://[2001:db8::1]:80/x", "[2001:db8::1]", "x"), ("example.com", "example.com", ""), ("//", "", "")]
    got = spark.createDataFrame(rows, "url string, host_ string, segment_ string").select("host_", "segment_", *url_filters.site_of()).collect()
    assert all((r.host, r.segment) == (r.host_, r.segment_) for r in got)


# -- 8 -------------------------------------------------------------------------


def test_packing(documents, rows, empty):
    got = packing.pack(documents, queries.tokenizer_path()).toPandas()
    tokens = TokenIds(queries.tokenizer_path())
    want = Counter()
    for i, text, *_ in rows:
        want[None if i is None else i, len(tokens._whole([text or ""])[0]) + 1] += 1
    assert got.length.sum() == sum(n * k for (_, n), k in want.items())
    size = got.groupby("sequence_id").length.sum()
    assert size.max() <= 1024 and ((size & (size - 1)) == 0).all()  # no padding at all
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.length.cumsum() - s.length == s.offset).all()
    one = got[got.doc_id == 4].sort_values("start")
    ids = np.append(tokens._whole([dict((r[0], r[1]) for r in rows)[4]])[0], 0).astype("<u4")
    assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(one.start, one.length)] == one.ids_crc32.tolist()
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0


def test_added_tokens_keep_their_id():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["a <|endoftext|> b", "no such", "<|endof", "text|>", "<|endoftext|><|endoftext|>", ""]
    ids, counts = TokenIds(queries.tokenizer_path()).ids(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[:4].tolist() == [64, 220, 50256, 275]


def test_pieces_that_share_a_name_go_through_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    from pagelens.llm import token_ids

    path, text = queries.tokenizer_path(), "one two three, it's 4 o'clock"
    plain = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    real = token_ids._piece_names
    monkeypatch.setattr(token_ids, "_piece_names", lambda values, *rest: real(values, *rest) % np.uint64(3) if values is token_ids._classes()[1][0] else real(values, *rest))
    got, counts = TokenIds(path).ids([text, ""])
    assert got.tolist() == plain and counts.tolist() == [len(plain), 0]


def test_tokens_equal_the_tokenizer():
    tokens, rng = TokenIds(queries.tokenizer_path()), random.Random(1)
    odd = ["", " ", "it's 'sfoo ''s x'll y'L  \n\n a\t\tb ", "日本語 test’s", "a'", "'", "'s", " 's", "\n'm  　b 12 3a!!", "<|endoftext|> hi", "  a", "'re're", "q'rx", "͸x"]
    odd += ["".join(rng.choice(" '\n\tsdtlrevm12é!.ß ") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    ids, counts = tokens.ids(odd)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.tolist() for x in tokens._whole(odd)]


def test_hilbert_neighbours_are_adjacent():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = grid[np.argsort(packing.hilbert_key(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# -- 9 -------------------------------------------------------------------------


def test_license_scan(documents, rows, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, text, *_ in rows:
        w = word.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
        places = [(p, label) for phrase, label in license_scan.BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in places]
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    got = by_id(license_scan.scan_licenses(documents))
    assert [tuple(r)[:6] for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got)
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_templates_need_their_key_phrase(spark):
    rows = [(1, "x Licensed under CC BY-NC 4.0."), (2, "licensed under cc"), (3, "Redistribution and use in source and binary forms, with or without modification, are permitted"), (4, "forms binary source and")]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "cc-by-nc", 2: "", 3: "bsd", 4: ""}


def test_license_of_long_texts_and_foreign_capitals(spark):
    rows = [(1, "released under the mit license " * 1600), (2, "mit \u212aicense MIT LICENSE"), (3, "\u0130 Apache License, Version 2.0"), (4, "wor\u212a mit license")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels, got[1].score) == (8000, 1600, 3, 7998, "mit", 1.0)
    assert [(got[i].n_words, got[i].base_labels) for i in (2, 3, 4)] == [(4, "mit"), (6, "apache"), (3, "mit")]


def test_license_of_every_template_beside_others(spark):
    texts = [t for _, t, _ in license_scan.TEMPLATES]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"{t} . licensed under cc by nc 4 0") for i, t in enumerate(texts)] + [(200, " x ".join(texts) * 3), (201, "nothing here")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, text, _) in enumerate(license_scan.TEMPLATES):
        assert label in got[i].labels.split(",") and abs(got[i].score - 1) < 1e-9
        assert {label, "cc-by-nc"} <= set(got[100 + i].labels.split(","))
    assert set(got[200].labels.split(",")) == {label for label, _, _ in license_scan.TEMPLATES}
    half = spark.createDataFrame([(1, "permission is hereby granted free of charge to nobody")], "doc_id long, text string")
    assert 0 < license_scan.scan_licenses(half).first().score < 1


# -- 10 ------------------------------------------------------------------------


def brute_repeats(rows):
    first, out = {}, []
    for i, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(text or "")
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def test_repeats_equal_brute_force(spark, documents, rows, empty):
    assert [tuple(r) for r in by_id(substring_dedup.remove_repeats(documents))] == brute_repeats(rows)
    assert substring_dedup.remove_repeats(empty).count() == 0
    rng = random.Random(6)
    more = []
    for i in range(60):  # few different words and lines: windows repeat inside and across documents, with shifts
        lines = [" ".join(rng.choice("abc") for _ in range(rng.choice((7, 26, 51, 60)))) for _ in range(2)]
        more.append((i, " ".join([*lines * rng.randint(1, 3), "z" * rng.randint(0, 2), more[rng.randrange(i)][1] if i and rng.random() < 0.7 else ""])))
    frame = spark.createDataFrame(more, "doc_id long, text string").repartition(5)
    assert [tuple(r) for r in by_id(substring_dedup.remove_repeats(frame))] == brute_repeats(more)
    out = substring_dedup.without_repeats(documents)
    assert out.columns == documents.columns and {r.doc_id: r.text for r in out.collect()}[1] == rows[0][1]


# -- pipeline --------------------------------------------------------------------


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.cut(stage(spark, kept, folder))
        assert kept.dtypes == docs.dtypes, name
        ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
        assert ids(kept) <= ids(before)
    tokens = TokenIds(queries.tokenizer_path())
    want = sum(len(x) + 1 for x in tokens._whole([r.text for r in kept.collect()]))
    assert corpus_pipeline.STAGES[-1][1](spark, kept, folder).agg(F.sum("length")).first()[0] == want
    assert corpus_pipeline.run(spark, folder).agg(F.sum("length")).first()[0] == want


def test_pipeline_of_awkward_rows(spark, documents, rows, empty, labels, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns pass every stage; so does an empty table."""
    for name, frame in (("some", documents), ("none", empty)):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.cut(stage(spark, kept, f"{tmp_path}/some"))
        assert kept.columns == documents.columns, name
        texts = [r.text for r in kept.collect()]
        if name == "toxicity":  # no toxic label, nothing goes
            assert len(texts) == len(rows)
        if name == "minhash_near_dedup":  # copies (2, 14), a near copy (3), a repeated row (12) and (9) go; rows without doc_id stay
            assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 15, 16] and kept.where("doc_id is null").count() == 1
        if name == "mixing":  # what has no word is not taken
            assert texts and all(WORD.search(t) for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, f"{tmp_path}/some")
    assert packed.agg(F.sum("length")).first()[0] == sum(len(x) + 1 for x in TokenIds(queries.tokenizer_path())._whole(texts))
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
