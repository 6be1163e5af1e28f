"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are at most one edit (a character replaced, inserted or deleted) apart exactly if
they become equal when the same place is deleted from both, or when one character is deleted from the longer one.
All lines' deletions would be as many as there are characters, so deletions are nested: first a whole block of a line
is deleted (a few blocks per line), and only lines that agree with another line outside such a block have
the characters of that block deleted one by one. Both levels emit hashed keys and join equal ones; no match is lost,
since the one edit lies in some block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import in_buckets, shared_keys
from prospecta.session import materialise

#: Shorter lines (trimmed characters) are always kept: list marks, page numbers and the like repeat by chance.
LEAST_CHARS = 10
#: Characters of a block, unless a line has so many that it would be cut into more than MOST_BLOCKS.
BLOCK, MOST_BLOCKS = 256, 64


def _lines(documents: DataFrame) -> DataFrame:
    """_doc, _version (hash of the text), _pos, _line (trimmed), _chars, _h1, _h2 of every line that is compared."""
    return (
        documents.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_version"),
                         F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
        .withColumn("_line", F.trim("_line"))
        .withColumn("_chars", F.length("_line"))
        .filter(F.col("_chars") >= LEAST_CHARS)
        .withColumn("_h1", F.xxhash64("_line"))
        .withColumn("_h2", F.xxhash64(F.lit(1), F.col("_line")))
    )


def _place() -> Column:
    """Where a line stands: earlier lines have smaller places. Null doc_ids come first."""
    return F.struct("_doc", "_version", "_pos")


def _without_block(lines: DataFrame) -> DataFrame:
    """A row for each block of a line, with a hash of the rest of the line.

    ``_base`` is the length of the shorter line of a pair: a line emits blocks as the shorter or equally long one
    (_longer 0) and as the one with one character more (_longer 1), whose block has that character too.
    """
    sides = F.explode(F.array(
        F.struct(F.col("_chars").alias("base"), F.lit(0).alias("longer")),
        F.struct((F.col("_chars") - 1).alias("base"), F.lit(1).alias("longer"))))
    blocks = F.when(F.col("_base") <= 2 * BLOCK, F.lit(2)).otherwise(
        F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("_base") / BLOCK))).cast("int")
    begin, end = F.col("_block") * F.col("_step"), F.col("_end")
    rest = [F.col("_line").substr(F.lit(1), begin), F.col("_line").substr(end + 1, F.col("_chars"))]
    return (
        lines.withColumn("_side", sides).withColumn("_base", F.col("_side.base")).withColumn("_longer", F.col("_side.longer"))
        .drop("_side")
        .withColumn("_step", F.ceil(F.col("_base") / blocks).cast("int"))
        .withColumn("_block", F.explode(F.expr("sequence(0, cast((_base - 1) div _step as int))")))
        .withColumn("_end", F.least((F.col("_block") + 1) * F.col("_step"), F.col("_base")) + F.col("_longer"))
        .withColumn("_rest", F.xxhash64("_base", "_block", *rest))
        .withColumn("_rest2", F.xxhash64(F.lit(2), F.col("_base"), *rest))
        .withColumn("_text", F.col("_line").substr(begin + 1, end - begin))
        .drop("_line", "_step", "_end", "_base", "_block")
    )


def _deletions(blocks: DataFrame) -> DataFrame:
    """A row for each character deleted from a block, and one for the whole block of a line as the shorter one.

    Rows with equal _variant: in kind "same", any two are one replaced character apart; in kind "cut", each row with
    _longer 1 is one inserted character apart from the (one) whole block.
    """
    size = F.length("_text")
    at = F.explode(F.expr("sequence(_longer, length(_text))"))  # 0 stands for the whole block
    variant = F.concat(F.col("_text").substr(F.lit(1), F.col("_at") - 1), F.col("_text").substr(F.col("_at") + 1, size))
    return (
        blocks.withColumn("_at", at)
        .withColumn("_kind", F.when((F.col("_at") > 0) & (F.col("_longer") == 0), "same").otherwise("cut"))
        .withColumn("_variant", F.xxhash64(
            "_rest", "_rest2", "_kind", F.when(F.col("_kind") == "same", F.col("_at")).otherwise(F.lit(0)),
            F.when(F.col("_at") > 0, variant).otherwise(F.col("_text"))))
        .withColumn("_role", F.when(F.col("_kind") == "same", 0).when(F.col("_at") == 0, 1).otherwise(2))
    )


def line_decisions(documents: DataFrame) -> DataFrame:
    """(_h1, _h2, _first, _near): of every line that is not unique, its first place and whether all of it goes.

    A line goes wholly if a line one edit away stands earlier; otherwise only its first place stays.
    """
    lines = _lines(documents)
    distinct = materialise(
        lines.groupBy("_h1", "_h2").agg(F.min(_place()).alias("_first"), F.max(_place()).alias("_last")))
    # Keys are hashed from all lines once; only the lines that have a shared one are cut into blocks again.
    keys = materialise(_without_block(lines).select("_rest", "_h1"))
    doubtful = materialise(shared_keys(keys, "_rest", "_h1").distinct())
    blocks = _without_block(in_buckets(lines, "_h1", doubtful)).join(doubtful, ["_rest", "_h1"], "left_semi").select(
        "_h1", "_h2", "_rest", "_rest2", "_longer", "_text").distinct()
    variants = shared_keys(_deletions(materialise(blocks)), "_variant", "_h1").select(
        "_h1", "_h2", "_variant", "_role", "_text").distinct()
    placed = materialise(in_buckets(distinct, "_h1", materialise(variants)).select("_h1", "_h2", "_first")
                         .join(variants, ["_h1", "_h2"]))
    # The earliest row of each role of a variant stands for all; a line is verified against that one.
    row = F.struct("_first", "_text")
    earliest = placed.groupBy("_variant").agg(
        F.min(F.when(F.col("_role") == 1, row)).alias("_whole"), F.min(F.when(F.col("_role") != 1, row)).alias("_other"))
    partner = F.when(F.col("_role") == 2, F.col("_whole")).otherwise(F.col("_other"))
    near = (
        placed.join(earliest, "_variant").withColumn("_partner", partner)
        .filter((F.col("_partner._first") < F.col("_first"))
                & (F.levenshtein("_text", F.col("_partner._text"), 1) == 1))
        .select("_h1", "_h2", F.lit(True).alias("_near")).distinct()
    )
    near = materialise(near)
    return materialise(
        distinct.join(near, ["_h1", "_h2"], "left")
        .filter("_near or _first <> _last")
        .select("_h1", "_h2", "_first", F.coalesce("_near", F.lit(False)).alias("_near")))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """All rows and columns of the documents, with repeated lines taken out of text, and __lines_removed (int).

    Lines are what stands between line feeds, compared without blanks at either end. A line of ``LEAST_CHARS`` characters
    or more is taken out where an equal line, or one at most one edit away, stands earlier: in an earlier document by
    doc_id (null first, then by a hash of the text) or further up in the same one. What stays is joined by line
    feeds as it was. Null and empty texts stay as they are; a document may become empty; rows of equal doc_id and text
    are one document, and lose the same lines; an empty table gives an empty result; extra columns pass through.

    A line's occurrences are folded per task before the shuffle; equal variants are reduced to their earliest row, so no
    pair of a large group is emitted. Texts are shuffled once, to meet their list of lines to remove; only lines that are
    in doubt have a block of their text shuffled.
    """
    decisions = line_decisions(documents)
    places = in_buckets(_lines(documents).select("_h1", "_h2", _place().alias("_here")), "_h1", decisions)
    removed = (
        places.join(decisions, ["_h1", "_h2"])
        .filter(F.col("_near") | (F.col("_here") != F.col("_first")))
        .select("_here.*").groupBy("_doc", "_version").agg(F.collect_set("_pos").alias("_removed"))
    )
    kept = F.expr("""array_join(transform(array_except(sequence(0, size(__lines) - 1), _removed), i -> __lines[i]), '\n')""")
    names = [F.col(f"`{name}`") for name in documents.columns]
    joined = documents.withColumn("__version", F.xxhash64("text")).join(
        materialise(removed),
        F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("__version") == F.col("_version")), "left")
    return joined.withColumn("__lines", F.split("text", "\n")).select(
        *[F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept).alias("text") if name == "text" else column
          for name, column in zip(documents.columns, names, strict=True)],
        F.coalesce(F.size("_removed"), F.lit(0)).alias("__lines_removed"))


def deduplicated_documents(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, text without repeated lines, lines_removed."""
    return dedup_lines(documents.select("doc_id", "text")).select(
        "doc_id", "text", F.greatest("__lines_removed", F.lit(0)).alias("lines_removed"))
