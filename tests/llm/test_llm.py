"""The training-data operators on small tables, against SQL, brute force and their own laws."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from prospecta.llm import fingerprint, language, lines, minhash, mixing, packing, queries, sharding, sitetree, urlrules, vectors
from tests.oracle import connect, differences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int"


def table(spark, rows):
    return spark.createDataFrame([(*row, 1, 2) for row in rows], SCHEMA)


EDGES = [
    (1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27),
    (None, "one two three four five six", None, None, None), (2, None, "en", "a", None), (3, "", "en", None, 0),
    (4, "word " * 5000, "en", "b", 25000), (5, "42 !", "en", "b", 4),
]


@pytest.mark.parametrize("name", sorted(queries.all_sql()))
def test_matches_sql(spark, folder, name):
    result = queries.all_queries()[name](spark, folder)
    assert differences(result, connect(folder), queries.all_sql()[name]) is None


@pytest.mark.parametrize("rows", [EDGES, []])
def test_edges(spark, rows):
    documents = table(spark, rows)
    assert sharding.documents_in_shards(documents).count() == len(rows)
    predicted = language.languages_of_documents(documents).collect()
    assert [row["lang_pred"] for row in predicted if row["doc_id"] in (2, 3, 5)] == ["und"] * 3 * bool(rows)
    assert lines.dedup_lines(documents).count() == len(rows)
    found = {row["doc_id"]: row for row in minhash.near_duplicates(documents).collect()}
    assert not rows or (found[1]["n_shingles"], found[3]["n_shingles"], found[None]["component_id"]) == (2, 0, None)
    assert mixing.mixed_documents(documents).count() == len(rows)
    assert fingerprint.fingerprint_documents(documents).count() == len(rows)
    assert packing.pack(documents).agg(F.countDistinct("doc_id", "piece")).first()[0] >= len(rows) - 2


def test_shards_are_even_and_gapless(spark, folder):
    rows = queries.all_queries()["op1_sharding"](spark, folder).collect()
    slots = {}
    for row in rows:
        slots.setdefault(row["shard"], []).append(row["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    _, owners = sharding.ring(4, 16)
    parts = sharding.allotted([1000] + [10] * 64, owners, 4, 0.0)
    loads = [sum(load for _, load, shard in parts if shard == s) for s in range(4)]
    assert sum(loads) == 1640 and max(loads) <= 411


def test_language_held_out(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    rows = language.languages_of_documents(documents).filter("held_out").join(
        documents.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([row["lang"] == row["lang_pred"] for row in rows]) > 0.95


def prose(seed, n):
    """Words of a language of its own: few letters, in few words."""
    random = np.random.default_rng(seed)
    letters = random.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:9]
    words = ["".join(random.choice(letters, random.integers(3, 9))) for _ in range(60)]
    return lambda: " ".join(random.choice(words, n))


@pytest.mark.parametrize("sizes", [[300, 6000], [6000, 6000]])
def test_language_of_long_texts(spark, sizes):
    """Languages are learned from long texts where there are no short ones."""
    rows = [(100 * i + k, text(), f"l{i}", "a", 1) for i, n in enumerate(sizes) for text in [prose(i, n)] for k in range(12)]
    assert sum(len(row[1]) > 8_000 for row in rows) == 12 * sizes.count(6000)
    found = {row["doc_id"]: (row["lang_pred"], row["score"]) for row in language.languages_of_documents(table(spark, rows)).collect()}
    assert all(found[row[0]][0] == row[2] and found[row[0]][1] > 0.9 for row in rows)


def test_many_languages(spark):
    """More languages than share tables, some of a single text many times; the sample keeps to its bytes."""
    rows = [(100 * i + k, text(), f"l{i:02}", "a", 1) for i in range(70) for text in [prose(i, 200)] for k in range(6)]
    strays = [(9002, "zz qq " * 100, "stray", "a", 1), (9004, "yy xx " * 100, "stray2", "a", 1), (9005, "ww vv " * 100, "stray3", "a", 1)]
    rows += strays * 3000  # ids that are not held out
    documents = table(spark, rows)
    samples = language.sample(documents)
    budget = min(language.LANGUAGE_BYTES, language.TOTAL_BYTES // 73)
    assert len(samples) == 73 and all(0 < sum(len(text.encode()) for text in own) <= budget for own in samples.values())
    found = {row["doc_id"]: row["lang_pred"] for row in language.languages_of_documents(documents).collect()}
    assert all(found[row[0]] == row[2] for row in rows)


@pytest.mark.parametrize("html,text", [
    ("<p>a &amp b &lt;i&gt; c<br>d</p>tail", "a & b <i> c d\n\ntail"),
    ("<article><h1>T</h1><p><b>x<br><p>y</p></article><div class=comment>no</div>", "T\n\nx\n\ny"),
    ("<article>q<section class='comments'><article class='comment'>n</article></section></article>", "q"),
    ("a&nbsp;b\n c<!-- x --><script>var a='<p>'</script>d", "a b cd"), ("", ""),
])
def test_main_text(html, text):
    assert sitetree.main_text(html, frozenset()) == text


def test_low_branches(spark):
    pages = spark.createDataFrame([
        (i, "http://h/x", f"<body><div>same on all</div><div class='x'><p>text {i}</p></div></body>") for i in range(20)],
        "page_id long, url string, html string")
    assert {row["text"] for row in sitetree.extract(pages).collect()} == {f"text {i}" for i in range(20)}


def test_copies_of_pages(spark):
    """Copies of a page count once, and an article is never cut."""
    def page(text, tag="article", around=""):
        return f"<body><div>same on all</div>{around}<{tag}><p>{text}</p></{tag}></body>"

    rows = [("one", page("copied", around=f"<nav>{i}</nav>" * (i % 2))) for i in range(20)]
    rows += [("bare", page("copied", "section")) for _ in range(20)]
    rows += [("most", page("copied" if i < 970 else f"own {i}")) for i in range(1000)]
    rows += [("nine", page(f"own {i}", "section")) for i in range(9)] + [("nine", page("copied", "section"))] * 500
    rows += [("two", f"<body><article class='k'>same</article><article><p>own {i}</p></article></body>") for i in range(10)]
    rows += [("around", f"<body><div class='a'>{i}<main><div>{i}</div></main></div></body>") for i in range(9)]
    pages = spark.createDataFrame([(i, f"http://{host}/x", html) for i, (host, html) in enumerate(rows)],
                                  "page_id long, url string, html string").repartition(7)
    found = {row["page_id"]: row["text"] for row in sitetree.extract(pages).collect()}
    for i, (host, html) in enumerate(rows):
        text = sitetree.main_text(html, frozenset())
        assert found[i] == (text.removeprefix("same on all\n\n") if host == "nine" else text) != "", (host, i)


def test_fingerprints():
    a, b = fingerprint.fingerprint("x\ny\nz"), fingerprint.fingerprint("z\nx\n\ny")
    assert (a == b).all() and (fingerprint.deleted(a, "y") == fingerprint.fingerprint("x\nz")).all()
    assert (fingerprint.inserted(a, "w") == fingerprint.fingerprint("w\nx\ny\nz")).all()


def test_edited_texts(spark, folder):
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    for row in queries.all_queries()["op7_fingerprints"](spark, folder).collect():
        text, cut = texts[row["doc_id"]], len(texts[row["doc_id"]]) // 3
        edited = text[:len(text) - cut] + texts[after[row["doc_id"]]][:cut]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_bitmaps_bound_the_difference():
    """Bits that differ are never more than the shingles that only one set has, and show them where the sets are large."""
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 62, 20_000, dtype=np.uint64)
    own = [rng.integers(0, 1 << 62, size, dtype=np.uint64) for size in (40, 25)]
    value = np.concatenate([shared, own[0], shared, own[1]])
    maps = minhash._bitmaps(value, np.array([0, 20_040, 40_065, 40_065])).view(np.uint64)
    apart = sum(int(x).bit_count() for x in maps[0] ^ maps[1])
    assert apart <= 65 and apart % 2 == 1 and apart >= 50
    assert not maps[2].any()


def test_ids_of_words_equal_the_tokenizers():
    path = packing.tokenizer_path()
    words = packing.Words(path, packing.ranked(path))
    assert words.encoding is not None
    draw = random.Random(5)
    letters = list("abc\u00e9 \u00f1\u4e2d'sdtrevmll.,!?019\t\n\r \u00a0\u3000\U0001f642-_<|>")
    for _ in range(5_000):
        text = "".join(draw.choices(letters, k=draw.randrange(40)))
        assert words.ids(text) == words.whole(text), text
    for text in ("", " " * 300_000 + "a", "x<|endoftext|>y", "ab" * 50_000):
        assert words.ids(text) == words.whole(text)


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    rows = queries.all_queries()["op9_packing"](spark, folder).collect()
    bins = {}
    for row in rows:
        bins.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= 1.02 * sum(row["length"] for row in rows) / 1024 + 1
    document = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").first()
    ids = Tokenizer.from_file(packing.tokenizer_path()).encode(document["text"], add_special_tokens=False).ids + [2]
    for row in rows:
        if row["doc_id"] == document["doc_id"]:
            own = ids[row["start"]: row["start"] + row["length"]]
            assert row["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())


def test_odd_vectors_and_urls(spark):
    rows = [Row(vec_id=1, embedding=[1.0, 0.0]), Row(vec_id=2, embedding=[2.0, 0.0]), Row(vec_id=3, embedding=None),
            Row(vec_id=4, embedding=[0.0, 0.0]), Row(vec_id=5, embedding=[float("nan"), 1.0]), Row(vec_id=None, embedding=[1.0, 0.0])]
    found = {row["vec_id"]: (row["n_links"], row["component_id"]) for row in vectors.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), None: (0, None)}
    pages = spark.createDataFrame([(1, "x://A.Net?q"), (2, None), (3, "http://a.example.net/en/x"), (4, "no")], "page_id long, url string")
    assert {row["page_id"]: (row["host"], row["path"], row["rule"]) for row in urlrules.judge(pages).collect()} == {
        1: ("a.net", "", None), 2: ("", "", None), 3: ("a.example.net", "/en/x", "example.net/en/"), 4: ("", "", None)}
