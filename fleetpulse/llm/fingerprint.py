"""Document fingerprints: bottom-k sketches of word shingles, in SQL functions only.

A sketch is the sorted array of the k smallest distinct 32-bit hashes of the five-word shingles of a
text (with fewer words, of the whole sequence; without words it is empty). Sketches of parts merge into
the sketch of the whole, and give estimates of resemblance, containment and the number of distinct shingles.
The hash depends on the text alone, so equal texts have equal sketches.

Edge cases: a null text counts as empty; an empty sketch resembles an empty one by 1 and others by 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import ascii_lower, pick
from fleetpulse.llm.order import next_keys

SIZE = 128
SHINGLE = 5
SPACE = r"[\x20\x09-\x0D]+"


def word_keys(text: Column) -> Column:
    """64-bit hashes of the words (runs without ASCII white space, A-Z lower-cased)."""
    parts = F.filter(F.split(ascii_lower(text), SPACE), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def shingle_keys(keys: Column, size: int = SHINGLE) -> Column:
    """32-bit hashes of the runs of `size` words, from an array of word hashes."""
    last = F.greatest(F.size(keys) - size, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.hash(*[F.get(keys, i + j) for j in range(size)]))
    return F.when(F.size(keys) > 0, runs).otherwise(F.array().cast("array<int>"))


def bottom(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def with_sketch(df: DataFrame, text: str, sketch: str) -> DataFrame:
    """Adds the sketch of a text column."""
    keyed = df.withColumn(f"{sketch}_words", word_keys(F.coalesce(F.col(text), F.lit(""))))
    return keyed.withColumn(sketch, bottom(shingle_keys(F.col(f"{sketch}_words")))).drop(f"{sketch}_words")


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of the shared part of all distinct shingles of two texts."""
    both = merge(a, b, size)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct_count(a: Column, size: int = SIZE) -> Column:
    """Estimate of the number of distinct shingles; exact below `size`."""
    span = (F.get(a, F.lit(size - 1)).cast("double") + 2.0**31) / 2.0**32
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / span)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of the part of a's distinct shingles that b has too."""
    shared = resemblance(a, b, size) * distinct_count(merge(a, b, size), size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, size)))


def merged(df: DataFrame, keys: list[str], sketch: str, size: int = SIZE) -> DataFrame:
    """One sketch for each group of parts: hashes are aggregated one by one, so a group may have any number of rows."""
    each = df.select(*keys, F.explode(sketch).alias("h")).distinct()
    salted = each.groupBy(*keys, F.pmod("h", F.lit(64)).alias("salt")).agg(
        F.slice(F.sort_array(F.collect_list("h")), 1, size).alias("part")
    )
    return salted.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("part"))), 1, size).alias(sketch))


def as_text(a: Column) -> Column:
    """Eight hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, containment.

    The edited text has the last quarter (floor) of its code points replaced by the first as many (or all)
    of the next document by ascending doc_id; after the last comes the first. Documents are compared by
    sketch with their edited text and with the next document; containment is that of the text in its edit.

    Rows with one doc_id are each judged on their own; the next document is then, of the rows with the next larger id,
    the one whose beginning sorts first. Rows without doc_id have no place in the order: they are nobody's next,
    and their next document is empty.

    Every text crosses one exchange (both joins by doc_id use the same one); the part that a neighbour needs, a quarter
    of its text at most, crosses a second one.
    """
    def texts(doc_id: str, text: str) -> DataFrame:
        body = F.coalesce(F.col("given"), F.lit(""))
        return pick(documents, key="doc_id", given="text").select(F.col("key").cast("long").alias(doc_id), body.alias(text))

    docs = texts("own_id", "text")
    ids = docs.select("own_id", F.floor(F.length("text") / 4).cast("int").alias("take"))
    links = next_keys(ids, "own_id")
    wanted = ids.groupBy("own_id").agg(F.max("take").alias("take")).join(links, "own_id")
    # both joins read the texts by id, so the exchange has nothing but the two columns and serves twice
    after = texts("next_id", "next_text").filter("next_id IS NOT NULL")
    wanted = wanted.select(F.col("own_id").alias("for_id"), F.col("next").alias("next_id"), "take")
    heads = (
        with_sketch(after.join(wanted, "next_id"), "next_text", "next_sketch")
        .groupBy("for_id")
        .agg(F.min(F.struct(F.expr("left(next_text, take)").alias("head"), "next_sketch")).alias("n"))
        .select("for_id", "n.*")
    )
    joined = docs.filter("own_id IS NOT NULL").join(heads, F.col("own_id") == F.col("for_id"), "left").drop("for_id")
    joined = joined.unionByName(docs.filter("own_id IS NULL"), allowMissingColumns=True).withColumnRenamed("own_id", "doc_id")
    joined = with_sketch(joined, "text", "sketch")
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - quarter), F.coalesce(F.substring("head", F.lit(1), quarter), F.lit(""))
    )
    none = F.array().cast("array<int>")
    out = with_sketch(joined.withColumn("edited", edited), "edited", "edited_sketch")
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.coalesce("next_sketch", none)).alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("containment"),
    )
