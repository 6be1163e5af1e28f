"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

A signature has ``VALUES`` MinHash values of ``BITS`` bits in chunks; the distance of two signatures is the number of values
that differ. Every way of leaving ``errors`` values of a chunk out gives a key, so two signatures share a key if a chunk has
at most ``errors`` values that differ; those that share one are compared if they are at most ``radius`` apart. Chunks, errors
and radius follow from the least similarity that makes a link (``layout``): a pair of exactly that similarity, of which each
value differs with probability 1 - similarity, is missed with a probability of at most ``MISS``. At 0.85 that is 6 chunks,
radius 11 and 5.9e-5, at 0.80 the same chunks, radius 13 and 6.7e-5; more similar pairs are missed less often.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from prospecta.llm.common import connected_components, in_buckets, mixed, shared_keys, utf8
from prospecta.session import materialise

WORDS = 5
VALUES, BITS = 24, 15
#: Chunks and errors, the most selective keys first.
LAYOUTS = ((6, 1), (8, 1), (12, 1), (24, 0))
#: How probable it may be that a pair of exactly the least similarity is missed.
MISS = 1e-4
#: Bits of the map of a set by which pairs are sifted before their full sets are compared.
MAP_BITS = 1024
#: Maps of so many sets are made at once.
MAP_SETS = 1024
#: Texts are hashed in pieces of about so many bytes (a longer text is one piece), which bounds a task's memory.
PIECE = 1 << 21

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MINHASH = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Layout(NamedTuple):
    """How signatures are cut into chunks, how many values a key leaves out, and how far apart compared ones may be."""

    chunks: int
    errors: int
    radius: int

    @property
    def per_chunk(self) -> int:
        return VALUES // self.chunks

    def miss(self, percent: int) -> float:
        """The probability that two sets of exactly this similarity share no key or are further apart than the radius."""
        p, n = 1 - percent / 100, self.per_chunk
        share = np.array([comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        apart = np.where(np.arange(n + 1) > self.errors, share, 0)
        everywhere, keyless = np.ones(1), np.ones(1)
        for _ in range(self.chunks):
            everywhere, keyless = np.convolve(everywhere, share), np.convolve(keyless, apart)
        return float(everywhere[self.radius + 1:].sum() + keyless[: self.radius + 1].sum())


@cache
def layout(percent: int) -> Layout:
    """The most selective keys and the smallest radius that miss a pair of the least similarity with at most ``MISS``."""
    for chunks, errors in LAYOUTS:
        for radius in range(VALUES + 1):
            found = Layout(chunks, errors, radius)
            if found.miss(percent) <= MISS:
                return found
    raise ValueError(f"{VALUES} values are too few to find pairs of {percent} percent with a miss of at most {MISS}")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingles(data: np.ndarray, places: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text, sorted, and the n + 1 places where each text's begin.

    Words are runs of bytes other than blank and tab to carriage return, A to Z in lower case. A shingle is ``words``
    words in a row; a text with fewer words has its whole sequence as the one shingle, one without words has none.
    """
    n = len(places) - 1
    letter = ~((data == 32) | ((data >= 9) & (data <= 13)))
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    inner = places[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = letter[inner]  # a word ends with its text
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    own = np.cumsum(letter)
    lengths = np.diff(np.append(own[starts] - 1, own[-1]))
    value = _BYTE[lower[letter]]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    value = value * _powers(_BASE, int(lengths.max()))[np.arange(len(value)) - np.repeat(first, lengths)]
    word = mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64))

    text = np.searchsorted(places, starts, "right") - 1
    count = np.bincount(text, minlength=n)
    end = np.cumsum(count)
    begin = end - count
    index = np.arange(len(word))
    # A shingle starts at each word that has enough words after it, or at the first word of a short text.
    start = index[(index + words <= end[text]) | (index == begin[text])]
    text = text[start]
    value = np.zeros(len(start), np.uint64)
    factor = _powers(_STEP, words)
    for i in range(words):
        at = start + i
        inside = at < end[text]
        value[inside] += word[at[inside]] * factor[i]
    value = mixed(value)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, places = utf8(column)
    first, n = 0, len(places) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(places, places[first] + PIECE, "right")) - 1)
        yield first, last, data[places[first]: places[last]], places[first: last + 1] - places[first]
        first = last


def signatures(value: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each set (0 where it is empty) and its signature, a row of values of ``BITS`` bits."""
    n = len(places) - 1
    full = np.flatnonzero(np.diff(places))
    sums = np.zeros((2, n), np.uint64)
    out = np.zeros((n, len(_MINHASH)), np.uint64)
    if len(full):
        at = places[full]
        sums[0, full] = np.add.reduceat(value * _BASE, at)
        sums[1, full] = np.add.reduceat(mixed(value ^ _STEP), at)
        for i, factor in enumerate(_MINHASH):
            scrambled = value * factor
            least = np.minimum.reduceat(scrambled ^ (scrambled >> np.uint64(29)), at)
            out[full, i] = mixed(least) & np.uint64((1 << BITS) - 1)
    return sums[0], sums[1], out


def _bitmaps(value: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each set, the bits that an odd number of its shingles hash to, as a row of longs.

    Shingles that two sets share turn the same bits, so what they differ in shows however full the maps are.
    """
    n, bit = len(places) - 1, (value % np.uint64(MAP_BITS)).astype(np.int64)
    out = np.zeros((n, MAP_BITS // 64), np.int64)
    for first in range(0, n, MAP_SETS):
        ends = places[first: first + MAP_SETS + 1]
        sets = len(ends) - 1
        at = np.repeat(np.arange(sets) * MAP_BITS, np.diff(ends)) + bit[ends[0]: ends[-1]]
        odd = np.bincount(at, minlength=sets * MAP_BITS).astype(np.uint8).reshape(sets, MAP_BITS) & 1
        out[first: first + sets] = np.packbits(odd, axis=1).view(np.int64)
    return out


def _hashed(documents: DataFrame, cut: Layout) -> DataFrame:
    """doc_id, n_shingles, _s1, _s2 (hashes of the set), the signature (a long of values for each chunk)."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, s1, s2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sig = np.zeros((n, cut.chunks), np.uint64)
            for first, last, data, places in _pieces(batch.column(1)):
                value, at = shingles(data, places)
                sizes[first:last] = np.diff(at)
                s1[first:last], s2[first:last], values = signatures(value, at)
                for chunk in range(cut.chunks):
                    for i in range(cut.per_chunk):
                        sig[first:last, chunk] |= values[:, chunk * cut.per_chunk + i] << np.uint64(BITS * i)
            arrays = [pa.array(x.view(np.int64)) for x in (sizes, s1, s2, *np.ascontiguousarray(sig.T))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    slim = documents.select("doc_id", "text")
    schema = slim.select("doc_id").schema
    for name in ("n_shingles", "_s1", "_s2", *[f"_c{i}" for i in range(cut.chunks)]):
        schema = schema.add(name, LongType())
    return slim.mapInArrow(hashed, schema)


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_rep, _set, _bits) of the documents that stand for the wanted classes (_rep, _s1, _s2)."""
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, places in _pieces(batch.column(1)):
                value, at = shingles(data, places)
                s1, s2, _ = signatures(value, at)
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64))),
                     pa.array(list(_bitmaps(value, at)), pa.list_(pa.int64()))],
                    names=["_rep", "_set", "_bits"])
                own = (s1.view(np.int64) == batch.column(2).to_numpy()[first:last]) & (
                    s2.view(np.int64) == batch.column(3).to_numpy()[first:last])
                yield out.filter(pa.array(own))

    texts = in_buckets(documents.select(F.col("doc_id").alias("_rep"), "text"), "_rep", wanted).join(wanted, "_rep")
    texts = texts.select("_rep", "text", "_s1", "_s2")
    return texts.mapInArrow(
        built, texts.select("_rep").schema.add("_set", ArrayType(LongType())).add("_bits", ArrayType(LongType())))


def _keys(classes: DataFrame, cut: Layout) -> DataFrame:
    """Every class with each of its keys: a chunk with ``errors`` of its values left out."""
    masks = [[i for i in range(cut.per_chunk) if i not in out] for out in combinations(range(cut.per_chunk), cut.errors)]
    keys = []
    for chunk in range(cut.chunks):
        for number, kept in enumerate(masks):
            mask = sum(((1 << BITS) - 1) << (BITS * i) for i in kept)
            keys.append(F.xxhash64(F.lit(chunk * len(masks) + number), F.col(f"_c{chunk}").bitwiseAND(F.lit(mask))))
    return classes.filter("n_shingles > 0").withColumn("_key", F.explode(F.array(*keys)))


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(_rep, _shingle, _place): of each set, the rarest shingles that a linked one must share one of, if another has them,
    and how many of the set's shingles are rarer.

    A link takes percent of the union, so of either set itself, to be in both. So of the (100 - percent) percent
    rarest shingles of a set and one more, in an order that is the same for all sets, two linked sets share one.
    Shingles that no other of ``sets`` has count among the rarest, but meet nothing.
    """
    members = sets.select("_rep", F.explode("_set").alias("_shingle"))
    counts = members.groupBy("_shingle").agg(F.count("*").alias("_sets")).filter("_sets > 1")
    shared = members.join(counts, "_shingle").groupBy("_rep").agg(
        F.sort_array(F.collect_list(F.struct("_sets", "_shingle"))).alias("_shared"))
    size = F.col("_size")
    prefix = size - F.ceil(F.lit(percent) * size / 100) + 1 - (size - F.size("_shared"))
    return sets.select("_rep", F.size("_set").alias("_size")).join(shared, "_rep").select(
        "_rep", "_shared", prefix.cast("int").alias("_prefix"), (size - F.size("_shared")).alias("_alone")).filter("_prefix > 0").select(
        "_rep", "_alone", F.posexplode(F.slice("_shared", F.lit(1), F.col("_prefix"))).alias("_at", "_s")).select(
        "_rep", "_s._shingle", (F.col("_alone") + F.col("_at")).alias("_place"))


def _distance(a: str, b: str, cut: Layout) -> Column:
    """How many values of two signatures differ."""
    out = F.lit(0)
    for chunk in range(cut.chunks):
        apart = F.col(f"{a}._c{chunk}").bitwiseXOR(F.col(f"{b}._c{chunk}"))
        for i in range(cut.per_chunk):
            out = out + F.when(apart.bitwiseAND(F.lit(((1 << BITS) - 1) << (BITS * i))) == 0, 0).otherwise(1)
    return out


def _alike(a: str, b: str, percent: int) -> Column:
    """What signatures and set sizes allow: a distance within the radius, and sizes that can reach the similarity."""
    cut = layout(percent)
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (_distance(a, b, cut) <= cut.radius)


def _near_maps(a: str, b: str, percent: int) -> Column:
    """What bitmaps allow: every bit that differs takes a shingle of its own that only one of the sets has, and
    of linked sets, (100 - percent) of (100 + percent) shingles in both are not shared at most."""
    apart = F.lit(0)
    for i in range(MAP_BITS // 64):
        apart = apart + F.bit_count(F.col(f"{a}._bits")[i].bitwiseXOR(F.col(f"{b}._bits")[i]))
    return (100 + percent) * apart <= (100 - percent) * (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles"))


def _enough_left(a: str, b: str, percent: int) -> Column:
    """What places allow: two sets share no more than the first shingle they meet at and what is less rare in either.

    A link fulfils this at the rarest shingle that both have; pairs are dropped at the later ones that leave too few.
    """
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    left = F.least(na - F.col(f"_place_{a}"), nb - F.col(f"_place_{b}"))
    return (100 + percent) * left >= percent * (na + nb)


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles (long), component_id (long), kept (boolean).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of shingles; a component is
    what links connect, named by its smallest doc_id, which is kept. Documents without words are linked with nothing. A row
    with a null doc_id is compared with nothing: its component is null and it is kept. Rows of one doc_id are one node,
    which has all their links. Null texts count as empty; texts of any length are taken whole; an empty table gives an
    empty result; extra columns are left out.

    Documents of equal sets are one class from the start, so a large group of copies is one row. Classes that share a
    key are compared; those of one bucket are first compared with its smallest member only, and what that connects is not
    compared again: a large group of near copies costs its size, not its square. The classes that are still apart from
    others of a bucket are then compared with those that share one of their rarest shingles, as every link does, if the
    signatures are within the radius and a bitmap of their sets, which never rules out a link, allows one. So no
    link is lost but by the signatures (``MISS``), and neither variants too far apart nor documents that share a passage make
    pairs.
    Links are confirmed on the full sets, and neither links nor components pass through the driver.
    """
    cut = layout(percent)
    hashed = materialise(_hashed(documents, cut))
    classes = materialise(
        hashed.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "_s1", "_s2").agg(
            F.min("doc_id").alias("_rep"), *[F.first(f"_c{i}").alias(f"_c{i}") for i in range(cut.chunks)]))
    columns = ["_rep", "_s1", "_s2", "n_shingles", *[f"_c{i}" for i in range(cut.chunks)]]
    bucketed = materialise(shared_keys(_keys(classes, cut).select("_key", *columns), "_key", "_rep"))
    sets = materialise(_sets(documents, materialise(bucketed.select("_rep", "_s1", "_s2").distinct())))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of structs whose full sets are similar enough, as (a, b) of doc_ids."""
        pairs = materialise(pairs.select(F.col("a._rep").alias("a"), F.col("b._rep").alias("b")))
        paired = pairs.select(F.explode(F.array("a", "b")).alias("_rep"))
        needed = in_buckets(sets.select("_rep", "_set"), "_rep", paired)  # few sets are in a pair
        both = (
            pairs.join(needed.select(F.col("_rep").alias("a"), F.col("_set").alias("_set_a")), "a")
            .join(needed.select(F.col("_rep").alias("b"), F.col("_set").alias("_set_b")), "b")
        )
        common = F.size(F.array_intersect("_set_a", "_set_b"))
        union = F.size("_set_a") + F.size("_set_b") - common
        return both.filter(100 * common >= percent * union).select("a", "b")

    member = F.struct(*columns)
    # First every class with the smallest member of each of its buckets, the smallest such member alone.
    heads = bucketed.groupBy("_key").agg(F.min(member).alias("b"))
    first = (
        bucketed.select("_key", member.alias("a")).join(heads, "_key")
        .filter((F.col("b._rep") < F.col("a._rep")) & _alike("a", "b", percent))
        .groupBy("a").agg(F.min("b").alias("b"))
    )
    links = materialise(confirmed(first))
    components = materialise(connected_components(links))
    # Then the classes that are still apart from others of a bucket.
    labelled = materialise(
        bucketed.join(components, F.col("_rep") == F.col("node"), "left")
        .select("_key", member.alias("m"), F.coalesce("component", "_rep").alias("c")))
    apart = materialise(shared_keys(labelled, "_key", "c").select(F.col("m._rep").alias("_rep"), "m", "c").distinct())
    # The sieve alone, not an exact join, which would shuffle the sets: a set too many alters the order, not what is found.
    rarest = _rarest(in_buckets(sets, "_rep", apart), percent)
    met = materialise(apart.join(rarest, "_rep").join(sets.select("_rep", "_bits"), "_rep").select(
        "_shingle", "_place", F.struct("m.*", "_bits").alias("m"), "c"))
    left, right = (met.select("_shingle", F.col("_place").alias(f"_place_{side}"), F.col("m").alias(side), F.col("c").alias("c" + side))
                   for side in "ab")
    second = (
        left.join(right, "_shingle")
        .filter((F.col("ca") != F.col("cb")) & (F.col("b._rep") < F.col("a._rep")) & _enough_left("a", "b", percent)
                & _near_maps("a", "b", percent) & _alike("a", "b", percent))
        .select("a", "b").distinct()
    )
    links = links.union(materialise(confirmed(second)))
    components = materialise(connected_components(links))
    named = classes.join(components, F.col("_rep") == F.col("node"), "left").select(
        "n_shingles", "_s1", "_s2", F.coalesce("component", "_rep").alias("_component"))
    found = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("_component"))
    return hashed.select("doc_id", "n_shingles", "_s1", "_s2").join(named, ["n_shingles", "_s1", "_s2"], "left").select(
        "doc_id", "n_shingles", found.alias("component_id"),
        F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))
