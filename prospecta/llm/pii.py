"""Personal data: generators propose overlapping spans, boosted trees score format and context, thresholds select redactions.

DataFrame functions and Spark's own trees only. The texts are read once; what follows works on the proposed spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospecta.session import materialise

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)

#: A task learns from about so many different cases (kind, label and features), each weighted by its spans.
CASES_PER_TASK = 100_000
#: A kind's threshold is the least score from which so large a share of the spans held out is right.
PRECISION = 0.98
#: Characters of context that are looked at, before and after a span.
BEFORE, AFTER = 40, 12

# The patterns of the base. Possessive quantifiers and the conditions in front change no match; they keep
# the time linear and the stack flat, for texts of a million digits as well.
LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
BASE = [
    (EMAIL, LOCAL + r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    (IP, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"),
    (CARD, r"[0-9](?:[\x20-]?[0-9])++"),
    (PHONE, r"\+[0-9][\x20().0-9-]+[0-9]"),
]
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: What the base swallows with its surroundings or does not write so. A pattern in a lookahead is tried at every place, so
#: its spans may overlap.
GENERATORS = [
    (EMAIL, LOCAL + r" ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(](?:dot|DOT)[\])] ?|\.)[A-Za-z0-9-]++)++"),
    (IP, rf"(?<![0-9])(?=({OCTET}(?:\.{OCTET}){{3}}(?![0-9])(?!\.[0-9])))"),
    (CARD, r"(?<![0-9])(?=((?:3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|[0-9]{4}(?:[ -]?[0-9]{4}){3}|[0-9]{14,19})(?![0-9])))"),
    (PHONE, r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
            r"|\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"),
    (PHONE, r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,4}?(?![0-9])"),
]
#: Words shortly before a span that speak for or against a kind.
CUES = [
    r"mail|contact|write|reach|kontakt|courriel|correo", r"\bip\b|host|server|address|client|login",
    r"card|visa|master|amex|credit|pay|karte|carte|tarjeta", r"tel|phone|call|fax|mobile|cell|dial|whatsapp|rufen|llam",
    r"version|\bv\b|isbn|order|invoice|serial|\bref\b|\bno\.|\bid\b|#|section|number",
]


#: (kind, whether of the base, pattern, whether in a lookahead, so that its matches have no length and are its first group).
PATTERNS = [(kind, found is BASE, pattern, "(?=(" in pattern) for found in (BASE, GENERATORS) for kind, pattern in found]


def proposed(documents: DataFrame) -> DataFrame:
    """(_row, doc_id, _found): every document with the matches of each pattern and the pieces between them, as a written table.

    Of a piece its length and its ends are kept. Patterns are tried only where a character that each of their matches holds
    is in the text. A card needs 14 digits, so texts without so long a match are left out there.
    """
    # A match is never at the very start, where splitting at one without length would drop the empty piece.
    padded = F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))
    text = F.col("_text")
    mails = text.contains("@") | text.contains("at]") | text.contains("at)") | text.contains("AT]") | text.contains("AT)")
    tried = {EMAIL: mails, IP: F.col("_numbers"), CARD: F.col("_numbers"), PHONE: text.contains("+")}
    looked = documents.select(F.monotonically_increasing_id().alias("_row"), "doc_id", padded.alias("_text")).withColumn(
        "_numbers", text.rlike("[0-9]{2}|[0-9][ .-][0-9]"))
    matched = looked.select("_row", "doc_id", "_text", *[
        F.when(tried[kind], F.regexp_extract_all("_text", F.lit(pattern), F.lit(int(ahead)))).alias(f"_m{g}")
        for g, (kind, _, pattern, ahead) in enumerate(PATTERNS)])

    def cut(g: int, kind: int, pattern: str):
        pieces = F.transform(F.split(text, pattern, -1), lambda piece: F.struct(
            F.length(piece).alias("n"), F.right(piece, F.lit(BEFORE)).alias("before"), F.left(piece, F.lit(BEFORE)).alias("after")))
        least = 14 if kind == CARD else 1
        return F.when(F.exists(f"_m{g}", lambda m: F.length(m) >= least), F.struct(
            F.lit(g).alias("g"), F.col(f"_m{g}").alias("matches"), pieces.alias("pieces")))

    found = F.array_compact(F.array(*[cut(g, kind, pattern) for g, (kind, _, pattern, _) in enumerate(PATTERNS)]))
    return materialise(matched.select("_row", "doc_id", found.alias("_found")))


def spans_of(proposals: DataFrame) -> DataFrame:
    """(_row, doc_id, kind, base, start, end, match, before, after) of every match, offsets in code points.

    Spark's functions give matches without their places; a running sum over the pieces between them gives the starts.
    """
    each = proposals.select("_row", "doc_id", F.explode("_found").alias("f")).select(
        "_row", "doc_id", "f.g", F.posexplode(F.arrays_zip(F.col("f.matches").alias("match"), F.col("f.pieces").alias("piece"))))
    each = each.select("_row", "doc_id", "g", "pos", "col.match", "col.piece.*")
    own = Window.partitionBy("_row", "g").orderBy("pos")
    kind, base, ahead = (
        F.array(*[F.lit(pattern[place]) for pattern in PATTERNS])[F.col("g")] for place in (0, 1, 3))
    wide = F.when(ahead, 0).otherwise(F.coalesce(F.length("match"), F.lit(0)))
    start = F.sum(F.col("n")).over(own) + F.coalesce(F.sum(wide).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1
    # Where a piece is shorter than the context, what stands before it counts too.
    earlier = F.coalesce(F.when(ahead, F.lag("before").over(own)).otherwise(F.lag("match").over(own)), F.lit(""))
    later = F.coalesce(F.lead("after").over(own), F.lit(""))
    skipped = F.when(ahead, F.length("match")).otherwise(0)
    placed = each.select(
        "_row", "doc_id", kind.alias("kind"), base.alias("base"), start.cast("int").alias("start"), "match",
        F.right(F.concat(earlier, F.col("before")), F.lit(BEFORE)).alias("before"),
        F.substring(later, skipped + 1, F.lit(AFTER)).alias("after"))
    return placed.filter(F.col("match").isNotNull() & ((F.col("kind") != CARD) | (F.length("match") >= 14))).withColumn(
        "end", F.col("start") + F.length("match"))


def luhn(digits: Column) -> Column:
    """Whether the check digit of 14 to 19 digits fits."""
    def value(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).when(digit < 5, digit * 2).otherwise(digit * 2 - 9)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i))
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def measured(proposals: DataFrame) -> DataFrame:
    """One row per proposed span with ``valid`` (the check of its kind), ``_x`` (features) and the place of what the base found.

    ``base`` holds where a base pattern matched and the check passed. ``covered`` tells whether another base span overlaps,
    ``beside`` whether another valid span does.
    """
    spans = spans_of(proposals)
    match, before, after = F.col("match"), F.lower("before"), F.col("after")
    # Digits alone; strings longer than any span are cut, which no check below passes anyway.
    digits = F.regexp_replace(F.substring(match, 1, 200), "[^0-9]", "")
    octets = match.rlike(r"\A0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}\z")
    spans = spans.withColumns({"digits": digits, "octets": octets})
    spans = spans.withColumn("luhn", luhn(F.col("digits")) & (F.length(match) <= 40))
    count = F.length("digits")
    valid = (
        F.when(F.col("kind") == EMAIL, True).when(F.col("kind") == IP, F.col("octets"))
        .when(F.col("kind") == CARD, F.col("luhn")).otherwise(count.between(10, 15) & (F.length(match) < 200)))
    letters = F.length(F.regexp_replace(F.substring(match, 1, 200), "[^A-Za-z]", ""))
    groups = F.transform(F.regexp_extract_all(F.substring(match, 1, 200), F.lit("[0-9]+"), F.lit(0)), lambda g: F.length(g))
    features = [
        F.col("kind"), F.length(match), count, letters, F.length(match) - count - letters, F.size(groups),
        F.coalesce(F.array_max(groups), F.lit(0)), F.size(F.array_distinct(F.split("digits", ""))),
        F.col("luhn"), F.col("octets"), match.startswith("+"), match.contains("("),
        F.length(F.regexp_extract(F.substring(match, -40, 40), r"\.([A-Za-z]+)\z", 1)),
        before.rlike(r"[A-Za-z]\z"), before.rlike(r"[0-9][ ().-]*\z"), after.rlike(r"\A[A-Za-z]"),
        after.rlike(r"\A[ ().-]*[0-9]"), *[before.rlike(cue) for cue in CUES],
    ]
    spans = spans.withColumn("valid", valid).withColumn("base", F.col("base") & F.col("valid")).withColumn(
        "_x", F.array(*[feature.cast("double") for feature in features]))
    # The same span from several patterns is one.
    spans = spans.groupBy("_row", "kind", "start", "end").agg(
        F.max("base").alias("base"), F.first("doc_id").alias("doc_id"), F.first("valid").alias("valid"), F.min("_x").alias("_x"))
    # Two orders, since a frame to the end of a partition takes the square of its rows.
    rows = Window.partitionBy("_row")
    up = rows.orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    down = rows.orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)

    def overlapped(flag: str) -> Column:
        ends, starts = F.when(F.col(flag), F.col("end")), F.when(F.col(flag), F.col("start"))
        earlier = F.max(ends).over(up)
        later = F.min(starts).over(down)
        return F.coalesce(earlier > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("end"), F.lit(False))

    return materialise(spans.withColumns({"covered": overlapped("base"), "beside": overlapped("valid")}))


@dataclass
class Detector:
    """Boosted trees with a threshold per kind; without trees (nothing to tell apart) every valid span is taken."""

    trees: GBTClassificationModel | None
    thresholds: list[float]

    def scored(self, spans: DataFrame) -> DataFrame:
        """Adds score, the trees' probability that a span is personal data."""
        if self.trees is None:
            return spans.withColumn("score", F.lit(1.0))
        names = spans.columns
        return self.trees.transform(spans.withColumn("_features", array_to_vector("_x"))).select(
            *names, vector_to_array("probability")[1].alias("score"))

    def chosen(self, spans: DataFrame) -> DataFrame:
        """Scored spans from their kind's threshold on."""
        least = F.array(*[F.lit(t) for t in self.thresholds])[F.col("kind")]
        return self.scored(spans).filter(F.col("score") >= least)


def learn(spans: DataFrame, precision: float = PRECISION) -> Detector:
    """Trees fitted to all spans whose truth is known, but for a third by hash, on all of which thresholds are calibrated.

    Base spans are personal data. A span that fails the check of its kind is not, unless it overlaps one that passes: it may be
    a fragment of that, or that with its surroundings. The rest is left to the trees. Spans with the same features are one case,
    weighted by their number.
    """
    label = F.when(F.col("base"), 1).when(~F.col("valid") & ~F.col("beside"), 0)
    place = F.xxhash64("doc_id", "start", "end", "kind")
    # Counted for each use: the spans are small beside the texts, and a table of many small files is spared.
    cases = (
        spans.withColumn("label", label).filter("label is not null")
        .groupBy("kind", "label", "_x", (F.pmod(F.xxhash64(place), F.lit(3)) == 0).alias("_held"))
        .agg(F.count("*").cast("double").alias("_weight")))
    fit = cases.filter("not _held")
    number, labels = fit.agg(F.count("*"), F.count_distinct("label")).first()
    if labels < 2:
        return Detector(None, [0.5] * len(KINDS))
    # In one order, so that the trees are the same each time where one task holds all cases.
    fit = materialise(fit.repartition(-(-number // CASES_PER_TASK)).sortWithinPartitions("kind", "_x", "label"))
    trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=20, maxDepth=4, maxBins=32, seed=7, checkpointInterval=-1).fit(
        fit.withColumn("_features", array_to_vector("_x")))
    detector = Detector(trees, [0.5] * len(KINDS))
    bins = detector.scored(cases.filter("_held")).groupBy("kind", F.floor(F.col("score") * 100).alias("bin")).agg(
        F.sum(F.col("label") * F.col("_weight")).alias("right"), F.sum("_weight").alias("all")).collect()  # at most 101 bins a kind
    for kind in range(len(KINDS)):
        own = sorted((row["bin"], row["right"], row["all"]) for row in bins if row["kind"] == kind and row["bin"] >= 50)
        for place, (least, *_) in enumerate(own):
            if sum(r[1] for r in own[place:]) >= precision * sum(r[2] for r in own[place:]):
                break
            detector.thresholds[kind] = (least + 1) / 100
    return detector


def found(documents: DataFrame, detector: Detector | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every document's _row and doc_id; the spans selected (_row, kind, start, end, base, score).

    Base spans are always selected. Of the others, those that pass the check of their kind, reach its threshold and overlap
    no base span are; where several of them overlap, the one with the best score, then the longest, then the first stays.
    """
    rows = proposed(documents)
    spans = measured(rows)
    detector = detector or learn(spans)
    more = detector.chosen(spans.filter("valid and not base and not covered"))
    # Chains of overlapping spans, each told by where it begins, are settled from their best span on.
    own = Window.partitionBy("_row").orderBy("start", "end", "kind")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    chain = F.sum(F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0)).over(own)
    entry = F.struct((-F.col("score")).alias("rank"), (F.col("start") - F.col("end")).alias("size"), "start", "kind", "end", "score")
    settled = F.aggregate(
        F.sort_array(F.collect_list(entry)), F.expr("cast(array() as array<struct<rank:double,size:int,start:int,kind:int,end:int,score:double>>)"),
        lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(
            F.array_append(kept, s)))
    added = (
        more.withColumn("_chain", chain).groupBy("_row", "_chain").agg(settled.alias("_kept"))
        .select("_row", F.explode("_kept").alias("s")).select("_row", "s.kind", "s.start", "s.end", F.lit(False).alias("base"), "s.score"))
    base = spans.filter("base").select("_row", "kind", "start", "end", "base", F.lit(1.0).alias("score"))
    return rows.select("_row", "doc_id"), base.union(added)


def _listed(spans: Column) -> Column:
    """kind:start:end of an array of (start, kind, end), in their order, comma-joined."""
    names = F.array(*[F.lit(name) for name in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def private_spans(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are those of the base spans, ``spans`` lists all that are selected; offsets are code points.
    A null text is empty and has none; texts are looked at whole, whatever their length. A doc_id may be null or repeat:
    each row is judged by itself, and equal texts have equal base spans and, the trees being the same, equal spans. An empty table
    gives an empty result. Extra columns are left out.
    """
    rows, spans = found(documents, detector)
    entry = F.struct("start", "kind", "end", "base")
    listed = spans.groupBy("_row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == kind)).alias(f"n_{name}") for kind, name in enumerate(KINDS)],
        F.sort_array(F.collect_list(entry)).alias("_all"))
    empty = F.lit("")
    return rows.join(listed, "_row", "left").select(
        "doc_id", *[F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}") for name in KINDS],
        F.sha2(F.coalesce(_listed(F.filter("_all", lambda s: s["base"])), empty), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("_all")), empty).alias("spans"))


def redacted(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """The documents, all columns, with every selected span replaced by its kind, as in ``<EMAIL>``; null texts stay null.

    Overlapping spans are cut at the end of the one before.
    """
    names = documents.columns
    whole = materialise(documents.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("_document")).withColumn(
        "_id", F.monotonically_increasing_id()))
    rows, spans = found(whole.select(F.col("_id").alias("doc_id"), "_document.text"), detector)
    own = Window.partitionBy("_row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.withColumn("start", F.greatest("start", F.coalesce(F.max("end").over(own), F.lit(0)))).filter("start < end")
    listed = cut.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_all")).join(
        rows, "_row").select(F.col("doc_id").alias("_id"), "_all")
    text, marks = F.col("_document.text"), F.array(*[F.lit(f"<{name.upper()}>") for name in KINDS])

    def piece(s: Column, j: Column) -> Column:
        begin = F.when(j > 0, F.col("_all")[j - 1]["end"]).otherwise(0)
        return F.concat(F.substring(text, begin + 1, s["start"] - begin), marks[s["kind"]])

    rest = F.substring(text, F.element_at("_all", -1)["end"] + 1, F.length(text))
    clean = F.when(F.col("_all").isNull(), text).otherwise(F.concat(F.array_join(F.transform("_all", piece), ""), rest))
    return whole.join(listed, "_id", "left").withColumn("_clean", clean).select(
        *[F.col("_clean").alias(name) if name == "text" else F.col(f"_document.`{name}`").alias(name) for name in names])
