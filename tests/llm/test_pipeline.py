"""The stages of the corpus pipeline against plain Python."""

import numpy as np
import pytest

import corpus_pipeline
from prospecta.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, text, "en", "a", len(text)) for i, text in enumerate(texts)], SCHEMA)


def sets_of(text):
    words = text.split()
    return {tuple(words[i: i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def kept(texts, least):
    """The smallest of each component, by all pairs."""
    sets, parent = [sets_of(text) for text in texts], list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i for i in range(len(texts)) if top(i) == i}


def edited(name, shared, one, other):
    """Two texts with so many shingles in both, and so many in one or the other alone."""
    both = [f"w{name}x{i}" for i in range(shared + 4)]
    return [" ".join([*both, *[f"{end}{name}x{i}" for i in range(own)]]) for end, own in (("a", one), ("b", other))]


def test_near_copies_from_80_percent(spark):
    alike = [(80, 10, 10), (81, 10, 9), (82, 9, 9), (83, 9, 8), (84, 16, 0), (85, 8, 7), (79, 11, 10), (60, 20, 20), (160, 20, 20)]
    texts = [text for number, sizes in enumerate(alike * 3) for text in edited(number, *sizes)] + ["", "one two", "one two", "word"]
    for number in range(5000):  # of pairs of exactly 0.80, those whose signatures differ most
        pair = edited(1000 + number, 80, 10, 10)
        data = [text.encode() for text in pair]
        _, _, values = minhash.signatures(*minhash.shingles(
            np.frombuffer(b"".join(data), np.uint8), np.array([0, len(data[0]), sum(map(len, data))])))
        if 12 <= (values[0] != values[1]).sum() <= 13:
            texts += pair
    assert len(texts) > 2 * len(alike) * 3 + 4
    found = {row["doc_id"] for row in corpus_pipeline.one_of_each(spark, table(spark, texts), "").collect()}
    assert found == kept(texts, 80)


@pytest.mark.parametrize("percent", [95, 85, 80, 70, 50])
def test_miss_of_the_layout(percent):
    layout = minhash.layout(percent)
    draws = np.random.default_rng(1).random((200_000, layout.chunks, layout.per_chunk)) < 1 - percent / 100
    missed = ((draws.sum((1, 2)) > layout.radius) | (draws.sum(2) > layout.errors).all(1)).mean()
    assert missed <= 2 * minhash.MISS and layout.miss(percent) <= minhash.MISS
