"""Line dedup by a deletion-neighbourhood join, in DataFrame and SQL functions only.

A line (between line feeds) is removed if an earlier line (by doc_id, then line number) has the same words. It also
goes if both have at least five words and differ by one: one replaced, inserted or left out; of shorter lines one word
is more than a fifth. Lines are judged on the input, so a line also goes if the earlier one goes too.

Equal lines are found first, by a hash of their words; only the first of them goes on. Two lines within one word
of each other share the words of their first or of their second half, so lines that share neither with any other
line are done. Each other line emits its deletion neighbourhood: for each place in the half that may differ, a
64-bit key of the line without that word (a modular sum over the words and where they stand; the keys of neighbouring
places differ in one word, so running sums give all of them), and its own key. Equal keys are joined by aggregation: the earliest line of a key stands for
it, so a key that many lines share gives one row a line and no pairs. Each link found is verified on the words.

Edge cases: a null text has no lines; lines without words are kept; rows without doc_id come last. Rows that
repeat both doc_id and text are one document and treated alike; rows that repeat a doc_id only are ordered by a
hash of their text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import pick, stored

SPACE = r"[\x20\x09-\x0D]+"
OTHER_SPACE = "\t\v\f\r"  # white space in a line besides blanks
LEAST_WORDS = 5  # of lines that are compared up to a word
MASK = (1 << 62) - 1
LAST = (1 << 63) - 1


def _documents(documents: DataFrame) -> DataFrame:
    """at, version, text: order of a document, and the hash that tells rows of one doc_id apart."""
    rows = pick(documents, doc_id="doc_id", text="text")
    return rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at"),
        F.xxhash64("text").alias("version"),
        "text",
    )


def _words(line: Column) -> Column:
    """The words of a line; lines with blanks only, the usual ones, are spared the pattern."""
    odd = reduce(or_, [line.contains(c) for c in OTHER_SPACE])
    return F.array_remove(F.when(odd, F.split(line, SPACE)).otherwise(F.split(line, " ")), "")


def _place() -> Column:
    return F.struct("at", "version", "line")


def keyed_lines(documents: DataFrame) -> DataFrame:
    """at, version, line, l1, l2, front, back: lines with words, hashes of the words and, of long lines, of their halves."""
    rows = _documents(documents).select("at", "version", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    rows = rows.select("at", "version", "line", _words(F.col("content")).alias("words")).filter(F.size("words") > 0)
    n = F.size("words")
    halves = lambda keys: F.when(n >= LEAST_WORDS, F.array(*keys)).otherwise(F.array().cast("array<bigint>"))
    a, b = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    front = [F.xxhash64(F.lit(0), F.slice("words", F.lit(1), x)) for x in (a, b)]
    back = [F.xxhash64(F.lit(1), F.slice("words", n - x + 1, x)) for x in (a, b)]
    return rows.select(
        "at", "version", "line", F.xxhash64("words").alias("l1"), F.xxhash64(F.lit(1), "words").alias("l2"),
        halves(front).alias("front"), halves(back).alias("back"),
    )


def distinct_lines(keyed: DataFrame) -> DataFrame:
    """l1, l2, first, front, back: each distinct line once, with its first place."""
    return keyed.groupBy("l1", "l2").agg(
        F.min(_place()).alias("first"), F.first("front").alias("front"), F.first("back").alias("back")
    )


def sharing_lines(lines: DataFrame) -> DataFrame:
    """l1, l2, front, back: long lines that share a half with another one, and which halves."""
    sides = F.explode(
        F.array_distinct(
            F.concat(
                F.transform("front", lambda k: F.struct(F.lit(0).alias("side"), k.alias("key"))),
                F.transform("back", lambda k: F.struct(F.lit(1).alias("side"), k.alias("key"))),
            )
        )
    )
    keys = lines.select("l1", "l2", sides.alias("s")).select("l1", "l2", "s.side", "s.key")
    shared = keys.groupBy("side", "key").agg(F.min("l1").alias("low"), F.max("l1").alias("high")).filter("low < high")
    found = keys.join(shared.select("side", "key"), ["side", "key"])
    return found.groupBy("l1", "l2").agg(
        F.max(F.expr("side = 0")).alias("front"), F.max(F.expr("side = 1")).alias("back")
    )


def _add(x: Column, y: Column) -> Column:
    return (x + y).bitwiseAND(F.lit(MASK))


def _minus(x: Column, y: Column) -> Column:
    return (x + (F.lit(MASK + 1) - y)).bitwiseAND(F.lit(MASK))


def _word_at(i: Column, h: Column) -> Column:
    return F.xxhash64(i, h).bitwiseAND(F.lit(MASK))


def _running_sums(values: Column, n: Column) -> Column:
    """The sums of the first 1, 2, ... of n values, in rounds that double the reach, so about n log n steps."""
    reach = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda r: r < n)
    return F.aggregate(
        reach, values, lambda sums, r: F.transform(sums, lambda x, i: F.when(i >= r, _add(x, F.get(sums, i - r))).otherwise(x))
    )


def neighbourhoods(lines: DataFrame) -> DataFrame:
    """place, gone, key: each line's own key (gone = -1) and its key without word `gone` (from 0)."""
    n = F.size("words")
    rows = lines.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", n)
    h = lambda i: F.get("h", i)
    total = lambda last, word: F.aggregate(
        F.sequence(F.lit(0), last), F.lit(0).cast("long"), lambda acc, i: _add(acc, _word_at(i, word(i)))
    )
    short = F.floor((F.col("n") - 1) / 2).cast("int")
    rows = rows.withColumn("start", F.when(F.col("back"), 0).otherwise(short))
    rows = rows.withColumn("stop", F.when(F.col("front"), F.col("n") - 1).otherwise(F.col("n") - 1 - short))
    rows = rows.withColumn("whole", total(F.col("n") - 1, h))
    rows = rows.withColumn("base", total(F.col("n") - 2, lambda i: h(F.when(i < F.col("start"), i).otherwise(i + 1))))
    # without word i instead of word i - 1: word i - 1 stands at i - 1 where word i stood
    step = lambda i: _minus(_word_at(i - 1, h(i - 1)), _word_at(i - 1, h(i)))
    places = F.sequence("start", "stop")
    rows = rows.withColumn("steps", F.transform(places, lambda i: F.when(i == F.col("start"), F.col("base")).otherwise(step(i))))
    rows = rows.withColumn("sums", _running_sums(F.col("steps"), F.size("steps")))
    without = F.transform(
        "sums", lambda x, i: F.struct((F.col("start") + i).alias("gone"), F.xxhash64(F.col("n") - 1, x).alias("key"))
    )
    own = F.array(F.struct(F.lit(-1).alias("gone"), F.xxhash64("n", "whole").alias("key")))
    return rows.select("place", F.explode(F.concat(own, without)).alias("k")).select("place", "k.*")


def _left_out(words: str, gone: str) -> str:
    return f"concat(slice({words}, 1, {gone}), slice({words}, {gone} + 2, size({words})))"


def near_lines(lines: DataFrame) -> DataFrame:
    """place: of the given distinct lines (place, words, front, back) those with an earlier one within one word."""
    keys = stored(neighbourhoods(lines), "line-neighbours")
    without, whole = keys.filter("gone >= 0"), keys.filter("gone < 0").select("key", F.col("place").alias("whole"))
    # lines with one key that left out the same place differ there only: the earliest stands for all
    first = without.groupBy("key", "gone").agg(F.min("place").alias("first"), F.count("*").alias("many")).filter("many > 1")
    replaced = without.join(first.select("key", "gone", "first"), ["key", "gone"]).filter("first < place").select(
        "place", "gone", F.col("first").alias("other"), F.col("gone").alias("other_gone")
    )
    # a line that is another one's key has a word less; there is one such line a key
    shorter = without.join(whole, "key")
    added = shorter.filter("whole < place").select("place", "gone", F.col("whole").alias("other"), F.lit(-1).alias("other_gone"))
    missing = shorter.filter("place < whole").select(
        F.col("whole").alias("place"), F.lit(-1).alias("gone"), F.col("place").alias("other"), F.col("gone").alias("other_gone")
    )
    links = stored(replaced.unionByName(added).unionByName(missing), "line-links")
    own = lines.select("place", F.col("words").alias("a"))
    others = lines.select(F.col("place").alias("other"), F.col("words").alias("b"))
    both = links.join(own, "place").join(others, "other")
    left = F.expr(f"CASE WHEN gone < 0 THEN a ELSE {_left_out('a', 'gone')} END")
    right = F.expr(f"CASE WHEN other_gone < 0 THEN b ELSE {_left_out('b', 'other_gone')} END")
    return both.filter(left == right).select("place").distinct()


def _words_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """place, words, front, back of the wanted lines (at, version, line, front, back), from their documents' texts."""
    held = wanted.groupBy("at", "version").agg(F.collect_list(F.struct("line", "front", "back")).alias("wanted"))
    texts = _documents(documents).join(held, ["at", "version"]).dropDuplicates(["at", "version"])
    rows = texts.select("at", "version", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    rows = rows.select("at", "version", "w.*", F.get("lines", F.col("w.line")).alias("content"))
    return rows.select(_place().alias("place"), _words(F.col("content")).alias("words"), "front", "back")


def removed_lines(documents: DataFrame) -> DataFrame:
    """at, version, gone: the numbers of the lines to remove, for documents that have any."""
    keyed = stored(keyed_lines(documents), "line-hashes")
    lines = stored(distinct_lines(keyed), "lines")
    sharing = sharing_lines(lines).join(lines.select("l1", "l2", "first.*"), ["l1", "l2"])
    chosen = stored(_words_of(documents, sharing.select("at", "version", "line", "front", "back")), "line-words")
    near = near_lines(chosen).withColumn("near", F.lit(True))
    judged = lines.select("l1", "l2", F.col("first").alias("place")).join(near, "place", "left")
    judged = judged.select("l1", "l2", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = keyed.select("l1", "l2", "at", "version", "line").join(judged, ["l1", "l2"]).filter(F.col("near") | (_place() != F.col("first")))
    return stored(gone.groupBy("at", "version").agg(F.collect_set("line").alias("gone")), "line-gone")


def dedup_lines(documents: DataFrame, result: str = "deduped") -> DataFrame:
    """documents with a struct column: text without the removed lines, n_lines, n_removed, n_left (lines not blank)."""
    gone = removed_lines(documents).select(F.col("at").alias("__at"), F.col("version").alias("__version"), F.col("gone").alias("__gone"))
    at = F.coalesce(documents["doc_id"].cast("long"), F.lit(LAST))
    rows = documents.withColumn("__own", at).withColumn("__hash", F.xxhash64("text"))
    rows = rows.join(gone, (F.col("__own") == F.col("__at")) & (F.col("__hash") == F.col("__version")), "left")
    rows = rows.withColumn("__lines", F.split("text", "\n"))
    numbers = F.sequence(F.lit(0), F.size("__lines") - 1)
    left = F.transform(F.array_except(numbers, F.col("__gone")), lambda i: F.get("__lines", i))
    rows = rows.withColumn("__left", F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(left))
    out = F.struct(
        F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join("__left", "\n")).alias("text"),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return rows.withColumn(result, out).drop("__at", "__version", "__gone", "__own", "__hash", "__lines", "__left")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 for every row of documents; a null text has no lines."""
    rows = dedup_lines(pick(documents, doc_id="doc_id", text="text"))
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("deduped.n_lines")).cast("long").alias("n_lines"),
        F.greatest("deduped.n_removed", F.lit(0)).alias("n_removed"),
        F.sha2(F.coalesce("deduped.text", F.lit("")), 256).alias("kept_sha256"),
    )


def without_repeated_lines(documents: DataFrame) -> DataFrame:
    """The rows of documents, all columns, with their remaining text; rows of which only blank lines remain go."""
    name = "__deduped"
    rows = dedup_lines(documents, name)
    new = F.col(f"{name}.text")
    rows = rows.filter((F.col(f"{name}.n_removed") <= 0) | new.rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": new}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col(f"{name}.n_removed") > 0, F.length(new).cast(kind)).otherwise(F.col("n_chars"))
    return rows.withColumns(changed).select(documents.columns)


ORACLE = r"""
WITH l AS (SELECT doc_id, line, list_filter(regexp_split_to_array(content, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
    FROM documents)),
c AS (SELECT w, len(w) AS n, min({'d': doc_id, 'l': line}) AS p FROM l WHERE len(w) > 0 GROUP BY w),
v AS (SELECT w, n, p, i, list_concat(w[1:i - 1], w[i + 1:n]) AS t FROM c, range(1, 20000) r(i) WHERE i <= n AND n >= 5),
a AS (SELECT t, i, min(p) AS m FROM v GROUP BY t, i),
x AS (SELECT v.w FROM v JOIN a ON v.t = a.t AND v.i = a.i WHERE a.m < v.p
  UNION SELECT v.w FROM v JOIN c ON v.t = c.w WHERE c.n >= 5 AND c.p < v.p
  UNION SELECT c.w FROM v JOIN c ON v.t = c.w WHERE c.n >= 5 AND v.p < c.p),
g AS (SELECT l.doc_id, l.line FROM l JOIN c ON l.w = c.w LEFT JOIN x ON l.w = x.w
  WHERE x.w IS NOT NULL OR c.p <> {'d': l.doc_id, 'l': l.line}),
r AS (SELECT doc_id, list(line) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(string_split(text, chr(10))) AS n_lines, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda s, i: gone IS NULL OR NOT list_contains(gone, i - 1)), chr(10)), ''))
    AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
