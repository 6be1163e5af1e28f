"""Packing token sequences into bins by minimum bin slack.

For each bin, the fullest combination of the lengths that are left is found by a subset-sum over a bitset and taken out. Only
how many pieces there are of each length decides, so the plan is made from that histogram (at most as many entries as a
bin has tokens), a combination is used as often as its lengths last, and pieces find their bin by their rank
among those of their length.
"""

from __future__ import annotations

import json
import pickle
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType
from pyspark.sql.window import Window

from prospecta.session import materialise

CAPACITY = 1024
END = 2
#: So many texts are taken out of an Arrow batch at a time.
ROWS = 256
#: How the tokenizer cuts a text into words, which no merge crosses.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked(path: str) -> bytes | None:
    """The tokens and ids of the tokenizer in the file, pickled for ``tiktoken``; None if that would not give the same ids.

    It does where words are byte-level and cut by the usual pattern, nothing is put before or after them, and merges are in the
    order of their ids, each token being what its own letters merge to. Then it makes the same merges in a fifth of the time.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    model, words = described["model"], described["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE" and words.get("type") == "ByteLevel" and words.get("use_regex", True)
        and not words.get("add_prefix_space") and not described["normalizer"]
        and not any(model.get(name) for name in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    if not plain:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that are written as themselves
    hidden = [byte for byte in range(256) if byte not in shown]
    byte_of = {chr(byte): byte for byte in shown} | {chr(256 + place): byte for place, byte in enumerate(hidden)}
    special = {token["content"] for token in described["added_tokens"]}
    vocabulary = {token: number for token, number in model["vocab"].items() if token not in special}
    pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
    merged = [vocabulary.get(left + right, -1) for left, right in pairs]
    merge = Tokenizer.from_file(path).model.tokenize
    if merged != sorted(set(merged)) or not all(letter in vocabulary for letter in byte_of) or not all(
            len(merge(token)) == 1 for token in vocabulary):
        return None
    ranks = {bytes(byte_of[letter] for letter in token): number for token, number in vocabulary.items()}
    return pickle.dumps((ranks, sorted(special)))


class Words:
    """Ids of whole texts, as little-endian bytes; ``ranks`` comes from ``ranked``."""

    def __init__(self, path: str, ranks: bytes | None):
        self.path, self.encoding, self.special = path, None, []
        if ranks is not None:
            import tiktoken

            tokens, self.special = pickle.loads(ranks)
            self.encoding = tiktoken.Encoding("words", pat_str=WORD, mergeable_ranks=tokens, special_tokens={})

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.encoding is None or any(token in text for token in self.special):
            return self.whole(text)
        try:
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # its pattern gives up on very long runs of blanks
            return self.whole(text)


#: One tokenizer for each worker, of the size of its vocabulary.
_words: dict[str, Words] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its partition and its rank there among its length."""
    place = path or tokenizer_path()
    ranks = ranked(place)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words.get(place) or _words.setdefault(place, Words(place, ranks))
        part = TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                some = batch.slice(first, ROWS)
                rows = []
                for row, text in enumerate(some.column(1).to_pylist()):
                    ids = words.ids(text or "") + end
                    n = len(ids) // 4
                    lead, begin = (n - 1) % capacity + 1, 0
                    for number in range(-(-n // capacity)):
                        length = capacity if number else lead
                        rows.append((row, number, begin, length, zlib.crc32(ids[4 * begin: 4 * (begin + length)]), part, used[length]))
                        used[length] += 1
                        begin += length
                of, *columns = np.array(rows, np.int64).T
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(of)), *[pa.array(c).cast(kind) for c, kind in zip(columns, kinds, strict=True)]],
                    names=schema.names)

    schema = documents.select("doc_id").schema
    for name, kind in (("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids_crc32", LongType()),
                       ("__part", IntegerType()), ("__rank", LongType())):
        schema = schema.add(name, kind)
    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def fullest(counts: list[int], room: int) -> dict[int, int]:
    """How many of each length (``counts[length]`` there are) fill ``room`` best: a subset-sum over a bitset."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, copies = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << (length * copies) & mask
            left, copies = left - copies, copies * 2
        if reach >> room & 1:
            break
    filled, taken = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> filled & 1:
            filled -= length * copies
            taken[length] = taken.get(length, 0) + copies
    return taken


def plan(counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, combination): bins of equal content, each with how many pieces of each length. Every bin holds the longest
    piece that is left (else long ones would be left for last) and the fullest combination beside it."""
    left, out = list(counts), []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            left[longest] -= 1
            taken = fullest(left, capacity - longest)
            left[longest] += 1
            taken[longest] = taken.get(longest, 0) + 1
            bins = min(left[length] // n for length, n in taken.items())
            for length, n in taken.items():
                left[length] -= bins * n
            out.append((bins, taken))
    return out


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids (null: none) and the end id; longer ones are cut into pieces of ``capacity``, the first of
    which may be shorter. Documents of any length are tokenized whole; equal rows are documents of their own; a
    null doc_id stays null; an empty table gives an empty result; extra columns are left out.

    The text is read once and never shuffled. The driver sees one count per length; ranks are offset by counts per partition
    and length, joined by a shuffle unless Spark finds them small.
    """
    cut = materialise(pieces(documents, path, capacity))
    counts = cut.groupBy("__part", "length").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))))
    histogram = [0] * (capacity + 1)
    for length, rows in offsets.groupBy("length").agg(F.sum("__rows")).collect():
        histogram[length] = rows

    # Per length: from which rank on a combination holds its pieces, how many in a bin, its first bin, where they lie in it.
    entries: list[list[tuple[int, int, int, int]]] = [[] for _ in histogram]
    used, first_bin = [0] * len(histogram), 0
    for bins, taken in plan(histogram, capacity):
        offset = 0
        for length in sorted(taken, reverse=True):
            entries[length].append((used[length], taken[length], first_bin, offset))
            used[length] += bins * taken[length]
            offset += length * taken[length]
        first_bin += bins
    bounds = np.cumsum([0, *map(len, entries)])
    flat = np.array([entry for own in entries for entry in own] or [(0, 1, 0, 0)], np.int64)
    keys = np.repeat(np.arange(len(entries)), np.diff(bounds))
    span = int(max([1, *histogram])) + 1
    lookup = keys * span + flat[: len(keys), 0]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, before = (batch.column(name).to_numpy() for name in ("length", "__rank", "__before"))
            rank = rank + before
            entry = flat[np.searchsorted(lookup, length * span + rank, "right") - 1]
            at = rank - entry[:, 0]
            sequence, offset = entry[:, 2] + at // entry[:, 1], entry[:, 3] + at % entry[:, 1] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(offset)], names=schema.names)

    joined = cut.join(offsets.drop("__rows"), ["__part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "__rank", "__before")
    schema = joined.drop("__rank", "__before").schema.add("sequence_id", LongType()).add("offset", LongType())
    return joined.mapInArrow(placed, schema)
