"""SpotSigs fingerprints with DataFrame functions only.

A spot is a run of common words (anchors) and the content word it leads to; its signature is
the 64-bit hash of the spot and the next content word, a chain of two. The fingerprint of a
text is the set of its signatures. A text without any spot has one signature, the hash of the
whole text. A null text is empty. Equal texts have equal fingerprints; repeated rows are rows
of their own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import rows_of

# Common words of English, German, French and Spanish, the default anchors.
ANCHORS = (
    "a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "ist", "mit", "und", "von", "zu",
    "au", "avec", "dans", "de", "des", "du", "en", "et", "la", "le", "les", "par", "pour", "que", "qui", "sur", "un", "une",
    "con", "el", "los", "las", "para", "por", "se", "su", "y",
)
_BREAK = r"[\s\p{Punct}]+"
_GLUE = "\x01"
#: Rows of a range of ids in ``successors``, and the most ranges.
RANGE_ROWS, MOST_RANGES = 500, 20_000


def _pattern(words: tuple[str, ...]) -> str:
    """A pattern for the words that shares their beginnings."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [re.escape(letter) + written(below) for letter, below in sorted(node.items()) if letter]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)}){'?' if '' in node else ''}"

    return written(tree)


def _once(value: Column, use) -> Column:
    """An expression of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """The set of signatures of a text, as ``array<long>``."""
    glued = F.regexp_replace(F.lower(text), rf"(?<![^\s\p{{Punct}}])({_pattern(anchors)}){_BREAK}", f"$1{_GLUE}")

    def chain(x: Column, y: Column) -> Column:
        spot = F.contains(x, F.lit(_GLUE)) & ~F.endswith(x, F.lit(_GLUE)) & y.isNotNull() & (y != "")
        return F.when(spot, F.xxhash64(x, F.substring_index(y, _GLUE, -1)))

    chained = _once(F.split(glued, _BREAK), lambda words: F.zip_with(words, F.slice(words, 2, 1 << 30), chain))
    found = F.array_distinct(F.array_compact(chained))
    return _once(found, lambda sigs: F.when(F.size(sigs) > 0, sigs).otherwise(F.array(F.xxhash64(text))))


def fingerprint(sigs: Column) -> Column:
    """The set as text: its size and the SHA-256 of its sorted members, 128 bits of it."""
    listed = F.array_join(F.sort_array(sigs), ",")
    return F.concat(F.size(sigs).cast("string"), F.lit("-"), F.substring(F.sha2(listed, 256), 1, 32))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets; the intersection is left out where the ranges of their members do not meet."""
    shared = F.when(
        (F.array_max(a) < F.array_min(b)) | (F.array_max(b) < F.array_min(a)), F.lit(0)
    ).otherwise(F.size(F.array_intersect(a, b)))
    return shared / (F.size(a) + F.size(b) - shared)


def successors(rows: DataFrame) -> DataFrame:
    """``doc_id, text, bucket, guest``: rows dealt by ranges of ids, each range with the row that follows it.

    In the order of falling ids (null last; the first follows the last) every row but the guests
    has its successor in its own range. Ranges hold about ``RANGE_ROWS`` rows each.
    """
    count = rows.count()
    ranges = max(1, min(MOST_RANGES, math.ceil(count / RANGE_ROWS)))
    placed = rows.withColumn("key", F.col("doc_id").cast("double"))
    cuts = placed.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    cuts = [-math.inf, *sorted(set(cuts)), math.inf]
    if len(cuts) > 2:
        placed = Bucketizer(splits=cuts, inputCol="key", outputCol="bucket", handleInvalid="keep").transform(placed)
    else:
        placed = placed.withColumn("bucket", F.lit(0.0))
    placed = placed.select("doc_id", "text", F.when(F.col("key").isNull(), -1).otherwise(F.col("bucket").cast("int")).alias("bucket"))
    heads = placed.groupBy("bucket").agg(F.max("doc_id").alias("head"))  # MOST_RANGES + 1 rows at most
    order = Window.orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hosts = heads.select("head", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(whole)).alias("host"))
    guests = placed.join(F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    return placed.withColumn("guest", F.lit(False)).unionByName(guests).repartition("bucket")


def compare_edited(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text, sigs, edited, edited_sigs, next_sigs``.

    The edited text has its last third replaced by as many code points (or all) of the start of
    the next document in the order of falling ids. One exchange: ranges of ids.
    """
    rows = successors(rows_of(docs, id_column, text_column)).withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sigs", F.lead("sigs").over(order)).filter("not guest")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    return rows.select("doc_id", "text", "sigs", "edited", signatures(F.col("edited")).alias("edited_sigs"), "next_sigs")


def near_duplicates(docs: DataFrame, least: float = 0.8, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``a, b, likeness``: pairs of distinct fingerprints (by their least id, a < b) of Jaccard ``least`` or more.

    Sets are partitioned by length so that only neighbouring partitions can hold partners. Each
    set lists its rarest signatures, as many as leave no partner unseen, and lists are joined;
    pairs are then compared whole. Documents of equal fingerprints are one entry.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    num, den = Fraction(repr(float(least))).as_integer_ratio()  # whole numbers: no likeness is lost to a rounded product
    sets = rows_of(docs, id_column, text_column).withColumn("sigs", F.sort_array(signatures(F.col("text"))))
    sets = sets.groupBy("sigs").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("sigs").cast("long"))
    spread = sets.select("id", "n", F.explode("sigs").alias("sig"))
    rarity = spread.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = spread.join(rarity, "sig", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "sig")))
    listed = ranked.filter(F.expr(f"df > 1 and r <= n - (n * {num} + {den - 1}) div {den} + 1"))
    part = F.size(F.filter(F.array(*map(F.lit, _sizes(num, den))), lambda low: low <= F.col("n")))
    listed = listed.select("id", "n", "sig", part.alias("part"))
    near = listed.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    pairs = listed.withColumnRenamed("id", "a").join(near, ["sig", "part"]).filter(F.col("a") != F.col("b"))
    pairs = pairs.filter(F.expr(f"n <= n_b and n * {den} >= n_b * {num}"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("sigs").alias("x")), sets.select(F.col("id").alias("b"), F.col("sigs").alias("y"))
    compared = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    compared = compared.filter(F.expr(f"shared * {den}L >= (size(x) + size(y) - shared) * {num}L"))
    return compared.select("a", "b", (F.col("shared") / (F.size("x") + F.size("y") - F.col("shared"))).alias("likeness"))


def _sizes(num: int, den: int) -> list[int]:
    """The least size of each length partition: a set's partners are in its own partition or the one below."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] * den // num, out[-1] * 21 // 20) + 1)
    return out
