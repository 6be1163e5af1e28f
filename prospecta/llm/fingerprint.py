"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is hashed to a vector of ``LANES`` signed numbers of 16 bits; a document's fingerprint is the sum of its paragraphs'
vectors modulo 2^32 in every lane. The order of paragraphs doesn't matter, and adding or taking out a paragraph adds
or subtracts its vector. As lanes only wrap beyond 32,768 paragraphs at the least, the cosine of two sums, read
as signed numbers, estimates the share of paragraphs that two documents have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from prospecta.llm.common import mixed

LANES = 128
#: Paragraphs expanded at once, which bounds memory: LANES * 8 bytes each.
AT_ONCE = 4096

_LANE = np.arange(1, LANES // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def vectors(paragraphs: list[str]) -> np.ndarray:
    """The sum of the paragraphs' vectors, modulo 2^32."""
    total = np.zeros(LANES, np.uint32)
    for first in range(0, len(paragraphs), AT_ONCE):
        digests = b"".join(
            [hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()
             for text in paragraphs[first: first + AT_ONCE]])
        seeds = np.frombuffer(digests, "<u8").reshape(-1, 2)
        wide = mixed((seeds[:, :1] + _LANE) ^ seeds[:, 1:])  # four lanes in each word
        lanes = wide.view("<i2").astype(np.int64)
        total += lanes.sum(axis=0).astype(np.uint32)
    return total


def paragraphs(text: str) -> list[str]:
    """Runs of text between line feeds that are not blank, without blanks at either end."""
    return [part for part in map(str.strip, text.split("\n")) if part]


def fingerprint(text: str) -> np.ndarray:
    return vectors(paragraphs(text))


def inserted(total: np.ndarray, paragraph: str) -> np.ndarray:
    return total + vectors([paragraph])


def deleted(total: np.ndarray, paragraph: str) -> np.ndarray:
    return total - vectors([paragraph])


def written(total: np.ndarray) -> str:
    return total.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else their cosine, 0 at least; 0 if only one is of a text without paragraphs."""
    if (a == b).all():
        return 1.0
    x, y = a.view(np.int32).astype(float), b.view(np.int32).astype(float)
    size = float(np.sqrt(x @ x) * np.sqrt(y @ y))
    return min(1.0, max(0.0, float(x @ y) / size)) if size else 0.0


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the text's code points replaced by the first as many (or all) of the next
    document: the one with the next smaller doc_id, and for the last the first. Equal doc_ids follow each other by a hash
    of their texts; null doc_ids are last; null texts are empty; a lone document follows itself; an empty table gives an empty
    result; extra columns are left out. Fingerprints are of whole texts, whatever their length, 8 hex digits a lane.

    Documents are dealt by ranges of doc_id, each in order to one task's stream, which holds two texts at a time. The
    document that a range's last one looks at is the first of the next range, whose id is that range's bound: it is sent
    to both. So every text is shuffled once, and a bounded number twice.
    """
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Not-x grows as x falls, so the stream ascends.
    slim = documents.select(
        F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit((1 << 63) - 1)).alias("__id"))
    # Bounds are ids of the table, each the first of its range.
    quantiles = F.percentile_approx("__id", F.array(*[F.lit(i / n) for i in range(n)]), F.lit(20 * n))
    found = slim.agg(quantiles.alias("q"), F.min("__id").alias("least")).first()
    bounds = np.array(sorted({found["least"], *(found["q"] or [])} - {None}), np.int64)
    count = max(1, len(bounds))

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        """The range of a row and, if it is a bound, the range before."""
        at = np.searchsorted(bounds, ids.to_numpy(), "right") - 1
        first = bounds[at] == ids.to_numpy()
        return pd.Series([[to, (to - 1) % count] if look else [to] for to, look in zip(at, first, strict=True)])

    sent = slim.select("*", F.posexplode(ranges("__id")).alias("__look", "__to"))
    order = ["__to", "__look", "__id", F.xxhash64("text"), "text"]
    dealt = (
        sent.repartition(count, "__to").sortWithinPartitions(*order).select("doc_id", "text", "__to", "__look")
    )

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (doc_id, text, fingerprint, range) of the row that waits for its next one
        for batch in batches:
            rows = []
            for doc_id, text, to, look in zip(batch["doc_id"], batch["text"], batch["__to"], batch["__look"], strict=True):
                own = None
                if held is not None and held[3] == to:
                    own = fingerprint(text)
                    rows.append(_compared(*held[:3], text, own))
                held = None if look else (doc_id, text, fingerprint(text) if own is None else own, to)
            out = pd.DataFrame(rows, columns=schema.names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = documents.select(F.col("doc_id").cast("long").alias("doc_id")).schema.add("n_chars", LongType())
    for name in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        schema = schema.add(name, StringType())
    schema = schema.add("near_edited", DoubleType()).add("near_next", DoubleType())
    return dealt.mapInPandas(compared, schema)


def _compared(doc_id, text: str, own: np.ndarray, after: str, next_one: np.ndarray) -> tuple:
    cut = len(text) // 3
    edited = text[: len(text) - cut] + after[:cut]
    changed = fingerprint(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), written(own), written(changed),
            likeness(own, changed), likeness(own, next_one))
