"""Language identification by prediction by partial matching (PPM) over bytes, with frozen statistics.

For every language, a context tree holds how often each byte followed each context of 0 to ``ORDER`` bytes in that
language's sample. The code length of a byte is -log2 of its share in the longest context that was seen; where the byte was
not seen in that context, the escape probability of the context (method C: distinct bytes over occurrences plus
distinct bytes) is charged and the next shorter context is asked, down to a uniform order -1. A text's language is the one
under whose statistics the whole text has the shortest code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType
from pyspark.sql.window import Window

from prospecta.llm.common import mixed, utf8

ORDER = 4
#: The sample: at most so many bytes of each language, and so many of all, shared evenly but for at least ``LEAST_BYTES``.
LANGUAGE_BYTES, TOTAL_BYTES, LEAST_BYTES = 800_000, 16_000_000, 64
#: Texts of more bytes are long: windows of so many characters (so of no more bytes) are taken of them.
SHORT_BYTES = 8_000
WINDOW = SHORT_BYTES // 4
#: So many languages share tables, whose size is the product of their contexts and languages.
GROUP = 8
#: Texts are scored in pieces of about so many bytes, which bounds a task's memory.
PIECE = 1 << 17


class Table:
    """Rows by 64-bit key: open addressing, looked up for a whole array at once."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, np.uint64)
        self.used = np.zeros(size, bool)
        self.place = np.zeros(size, np.int32)
        self.rows = rows
        todo, slot, self.probes = np.arange(len(keys)), mixed(keys) & self.mask, 0
        while len(todo):
            self.probes += 1
            _, first = np.unique(slot[todo], return_index=True)
            first = first[~self.used[slot[todo[first]]]]
            put = todo[first]
            self.keys[slot[put]], self.place[slot[put]], self.used[slot[put]] = keys[put], put, True
            todo = np.delete(todo, first)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is absent."""
        slot = mixed(keys) & self.mask
        found = np.where(self.used[slot] & (self.keys[slot] == keys), self.place[slot], -1)
        todo = np.flatnonzero((found < 0) & self.used[slot])
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            at = slot[todo]
            hit = self.used[at] & (self.keys[at] == keys[todo])
            found[todo[hit]] = self.place[at[hit]]
            todo = todo[~hit & self.used[at]]
        return found


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """For every byte, the byte with the ``order`` bytes before it, as one number."""
    wide = data.astype(np.uint64)
    out = wide.copy()
    for back in range(1, order + 1):
        out[back:] |= wide[:-back] << np.uint64(8 * back)
    return out


def padded(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text after ``ORDER`` zero bytes, which stand for its beginning; and which bytes are the texts' own."""
    n = len(places) - 1
    own = np.ones(len(data) + ORDER * n, bool)
    begins = places[:-1] + ORDER * np.arange(n)
    for i in range(ORDER):
        own[begins + i] = False
    out = np.zeros(len(own), np.uint8)
    out[own] = data
    return out, own


class Group:
    """Code lengths of the union of some languages' contexts, so that one lookup serves all of them.

    ``costs[k]`` has a row for each k-byte context with its next byte that any language saw: the full PPM code
    length by language, escapes included. ``escapes[k]`` has a row for each context: what a byte that no language saw there
    costs before the next shorter context is asked (0 where the language never saw the context).
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        n = len(self.languages)
        counted: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for language in self.languages:
            texts = [text.encode("utf-8", "replace") for text in samples[language]]
            data = np.frombuffer(b"".join(texts), np.uint8)
            data, own = padded(data, np.concatenate([[0], np.cumsum([len(text) for text in texts])]).astype(np.int64))
            counted.append([np.unique(grams(data, order)[own], return_counts=True) for order in range(ORDER + 1)])
        self.costs: list[Table] = []
        self.escapes: list[Table] = []
        for order in range(ORDER + 1):
            union = np.unique(np.concatenate([counted[i][order][0] for i in range(n)]))
            contexts = np.unique(union >> np.uint64(8))
            escape = np.zeros((len(contexts), n), np.float32)
            cost = np.zeros((len(union), n), np.float32)
            for i in range(n):
                keys, counts = counted[i][order]
                own, first = np.unique(keys >> np.uint64(8), return_index=True)
                if not len(own):
                    cost[:, i] = self.shorter(union, order)[:, i]
                    continue
                distinct = np.diff(np.append(first, len(keys)))
                total = np.add.reduceat(counts, first) + distinct
                at = np.searchsorted(contexts, own)
                escape[at, i] = np.log2(total / distinct)
                seen = np.searchsorted(union, keys)
                cost[:, i] = escape[np.searchsorted(contexts, union >> np.uint64(8)), i] + self.shorter(union, order)[:, i]
                cost[seen, i] = np.log2(np.repeat(total, distinct) / counts)
            self.costs.append(Table(union, cost))
            self.escapes.append(Table(contexts, escape))

    def shorter(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Costs of the keys without their first byte, one order below; 8 bits below order 0."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), 8.0, np.float32)
        table = self.costs[order - 1]
        return table.rows[table.find(keys & np.uint64((1 << (8 * order)) - 1))]

    def code_lengths(self, data: np.ndarray) -> np.ndarray:
        """Bits of every byte by language, given the ``ORDER`` bytes before it."""
        bits = np.zeros((len(data), len(self.languages)), np.float32)
        todo, keys = np.arange(len(data)), grams(data, ORDER)
        for order in range(ORDER, -1, -1):
            slot = self.costs[order].find(keys)
            hit = slot >= 0
            bits[todo[hit]] += self.costs[order].rows[slot[hit]]
            todo, keys = todo[~hit], keys[~hit]
            if not len(todo):
                return bits
            slot = self.escapes[order].find(keys >> np.uint64(8))
            seen = slot >= 0
            bits[todo[seen]] += self.escapes[order].rows[slot[seen]]
            if order:
                keys = keys & np.uint64((1 << (8 * order)) - 1)
        bits[todo] += 8.0
        return bits

    def score(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Bits of every text by language. Long texts are scored in pieces that begin with the bytes before them."""
        total = np.zeros((len(places) - 1, len(self.languages)))
        first = 0
        while first < len(places) - 1:
            last = max(first + 1, int(np.searchsorted(places, places[first] + PIECE, "right")) - 1)
            if places[last] - places[first] <= 2 * PIECE:
                own = places[first: last + 1] - places[first]
                piece, mine = padded(data[places[first]: places[last]], own)
                bits = self.code_lengths(piece)
                bits[~mine] = 0
                begins = own[:-1] + ORDER * np.arange(last - first)
                total[first: last] = np.add.reduceat(bits, begins, axis=0, dtype=np.float64)
            else:  # one long text
                text = np.concatenate([np.zeros(ORDER, np.uint8), data[places[first]: places[last]]])
                for begin in range(ORDER, len(text), PIECE):
                    total[first] += self.code_lengths(text[begin - ORDER: begin + PIECE])[ORDER:].sum(0, dtype=np.float64)
            first = last
        return total


class Model:
    """Any number of languages by name, in groups. A language's code lengths do not depend on the others of its group."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.groups = [Group({language: samples[language] for language in self.languages[at: at + GROUP]})
                       for at in range(0, len(self.languages), GROUP)]

    def score(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Bits of every text by language."""
        return np.concatenate([group.score(data, places) for group in self.groups], axis=1)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(labelled: DataFrame) -> dict[str, list[str]]:
    """Texts of every language, by a hash of their ids and texts: whole short ones and, where those do not fill the language's
    share of bytes, windows of long ones. The last one is cut where the share ends.

    Texts are thinned by their hash to somewhat more than the share, and equal rows folded, before they are ranked, so that no
    task ranks a hot language's rows. A language of which nothing is left by that gives the beginning of one text.
    """
    size = F.octet_length("text")
    texts = labelled.filter(size > 0).select("lang", "text", F.xxhash64("doc_id", "text").alias("_hash"), (size > SHORT_BYTES).alias("_long"))
    sizes = texts.groupBy("lang").agg(
        F.sum(F.when(F.col("_long"), 0).otherwise(size)).alias("short"), F.sum(F.when(F.col("_long"), size).otherwise(0)).alias("long")).collect()
    if not sizes:
        return {}
    budget = min(LANGUAGE_BYTES, max(LEAST_BYTES, TOTAL_BYTES // len(sizes)))

    def limit(wanted: int, there: int) -> float:
        return (2.0 * wanted + 20 * SHORT_BYTES) / there if wanted > 0 and there else 0.0

    limits = labelled.sparkSession.createDataFrame(
        [(row["lang"], limit(budget, row["short"]), limit(budget - row["short"], row["long"])) for row in sizes],
        "lang string, _of_short double, _of_long double")

    def share(value):
        return F.pmod(value, F.lit(1 << 30)) / F.lit(float(1 << 30))

    windows = F.sequence(F.lit(0), F.ceil(F.length("text") / WINDOW).cast("int") - 1)
    chosen = F.filter(windows, lambda i: share(F.xxhash64("_hash", i)) <= F.col("_of_long"))
    pieces = F.when(F.col("_long"), F.transform(chosen, lambda i: F.struct(
        F.xxhash64("_hash", i).alias("_hash"), F.substring(F.col("text"), i * WINDOW + 1, F.lit(WINDOW)).alias("text")))).otherwise(
        F.filter(F.array(F.struct("_hash", "text")), lambda piece: share(piece["_hash"]) <= F.col("_of_short")))
    thinned = texts.join(F.broadcast(limits), "lang").select("lang", "_long", F.explode(pieces).alias("piece")).select(
        "lang", "_long", "piece.*").dropDuplicates(["lang", "_long", "_hash"])
    order = Window.partitionBy("lang").orderBy("_long", "_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(size).over(order) - size
    rows = thinned.withColumn("_before", before).filter(F.col("_before") < budget).select("lang", "text", "_before").collect()
    missing = {row["lang"] for row in sizes} - {row["lang"] for row in rows}
    if missing:
        least = F.min(F.struct("_long", "_hash", F.substring("text", 1, WINDOW).alias("text")))["text"]
        rows += texts.filter(F.col("lang").isin(*missing)).groupBy("lang").agg(least.alias("text"), F.lit(0).alias("_before")).collect()
    out: dict[str, list[str]] = {}
    for row in rows:
        text = row["text"].encode("utf-8", "replace")[: budget - row["_before"]].decode("utf-8", "ignore")
        out.setdefault(row["lang"], []).append(text)
    return out


def learn(documents: DataFrame) -> Model | None:
    """Fits on documents whose id is not held out and whose language and text are known; None if there are none."""
    labelled = documents.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    samples = sample(labelled)
    return Model(samples) if samples else None


def identify(documents: DataFrame, model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id alone, unless given), __lang_pred and __lang_score (0 to 1) of every row.

    The whole text is scored; score is the probability of the language if all were equally likely before, ties go to the
    first name. ``und`` with score 0 stands for a null text, a text without a letter, or a table to learn from that has no
    labelled row. Equal texts get equal predictions; other columns are never looked at; an empty table gives an empty result.
    """
    model = model or learn(documents)
    keep = keep or ["doc_id"]
    known = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    place = keep.index("text") if "text" in keep else len(keep)  # the text crosses to the task once

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            scored = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            languages, scores = np.full(len(scored), "und", object), np.zeros(len(scored))
            if model is not None and len(scored):
                bits = model.score(*utf8(batch.column(place)))
                best = bits.argmin(axis=1)
                odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                languages = np.where(scored, np.array(model.languages, object)[best], "und")
                scores = np.where(scored, 1 / odds, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:len(keep)], "__lang_pred", "__lang_score"])

    kept = [F.col(f"`{name}`") for name in keep]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters")
    slim = documents.select(*kept, *([] if "text" in keep else [F.col("text").alias("__text")]), letters)
    schema = documents.select(*kept).schema.add("__lang_pred", StringType()).add("__lang_score", DoubleType())
    return slim.mapInArrow(predicted, schema)


def languages_of_documents(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    return identify(documents).select(
        "doc_id", held_out().alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))


def accepted(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose language is known: not ``und`` and with a score of at least ``least``.

    The languages are learned from the documents themselves, their own labels being part of the sample only.
    """
    names = documents.columns
    sure = (F.col("__lang_pred") != "und") & (F.col("__lang_score") >= least)
    return identify(documents, keep=names).filter(sure).select(*[F.col(f"`{name}`") for name in names])
