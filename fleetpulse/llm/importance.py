"""Importance resampling toward a target text distribution, on hashed n-gram features, with segment deduplication.

Features of a text are its runs of 1 to `longest` words, joined by one space; crc32 deals them to `buckets`. Buckets
that are relatively more frequent in the target than in the documents gain weight; a document's weight is the mean gain
of its features. Gumbel noise drawn from a hash of the doc_id turns the highest scores into a sample without replacement.

Separator line feeds cut texts into lines, which no word crosses. Equal lines are found by an exchange with map-side
combination, and only distinct lines are tokenized: their features are counted once, multiplied by the line's
occurrences for the corpus statistics, and their sums of gains are joined back to the documents that hold them. A line
with more than one in 10,000 of all occurrences, of which there are fewer than 10,000, reaches them by broadcast. Runs that cross lines
(longest > 1) are counted for each document and added. The statistics, one row a bucket, are all that the driver sees. The draw is a range-partitioned
sort; ranks come from the row counts of its partitions.

Edge cases: a null text has no words; weight is 0 without features. Rows without doc_id have no score and are not
drawn from. Rows that repeat a doc_id are scored by their own text with the same noise; rows that repeat both are drawn
one by one. Without features in documents or target, counts are 0 and the formula holds as it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import LETTER_OR_DIGIT, LOWER, flat, pick, skewed_join, slices, words
from fleetpulse.session import materialize

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
SLICE = 1 << 20
LONG_WORD = 64

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def _crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of the given words: all words advance together, one byte at a time."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    state, at, size = state[order], starts[order], size[order]
    long = int(np.searchsorted(-size, -LONG_WORD))
    for i in range(long):  # few; a step for each of their bytes would serve a word at a time
        state[i] = ~np.uint32(zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(~state[i])))
    live = np.searchsorted(-size, -np.arange(LONG_WORD))  # words with more than 0, 1, 2, ... bytes
    for step in range(LONG_WORD):
        stop = int(live[step])
        if stop <= long:
            break
        now = state[long:stop]
        state[long:stop] = _CRC[(now ^ data[at[long:stop] + step]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int, crossing: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, features per text and the bucket of each feature; of `crossing` features only, those over a line feed."""
    data = LOWER[data]
    starts, ends, counts = words(data, offsets, LETTER_OR_DIGIT)
    text = np.repeat(np.arange(len(counts)), counts)
    line = np.searchsorted(np.flatnonzero(data == 10), starts) if crossing else np.zeros(len(starts), np.int64)
    begin = np.arange(len(starts))
    state = _crc_on(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends)
    found, owner = [], []
    for length in range(1, longest + 1):
        if length > 1:
            inside = begin + length - 1 < len(starts)
            begin, state = begin[inside], state[inside]
            same = text[begin] == text[begin + length - 1]
            begin, state = begin[same], state[same]
            state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            last = begin + length - 1
            state = _crc_on(state, data, starts[last], ends[last])
        keep = line[begin] != line[begin + length - 1] if crossing else slice(None)
        found.append((~state[keep] % np.uint32(buckets)).astype(np.int32))
        owner.append(text[begin[keep]])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return counts, np.bincount(owner, minlength=len(counts)), found[order]


def _texts(documents: DataFrame) -> DataFrame:
    rows = pick(documents, doc_id="doc_id", text="text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("version"), "text")


def _line_keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def counted_lines(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """k1, k2, times, n_words, found: each distinct line of the texts with its occurrences and the buckets of its features."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "line", SLICE):
            counts, many, found = features(*flat(batch.column("line")), longest, buckets)
            ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), batch.column("times"), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(found))],
                ["k1", "k2", "times", "n_words", "found"],
            )

    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    rows = lines.select(*_line_keys(F.col("line")), "times", "line")
    return rows.mapInArrow(count, "k1 bigint, k2 bigint, times bigint, n_words bigint, found array<int>")


def crossing_runs(texts: DataFrame, longest: int, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, version, times (1), found: the buckets of each text's features over a line feed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            _, many, found = features(*flat(batch.column("text")), longest, buckets, crossing=True)
            ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(np.ones(len(many), np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(found))],
                ["doc_id", "version", "times", "found"],
            )

    return texts.mapInArrow(count, "doc_id bigint, version bigint, times bigint, found array<int>")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists end to end, and the size of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def histogram(counted: list[DataFrame], buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket; tasks add up on their own, so that a task sends a row a bucket at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found, many = _lists(batch.column("found"))
            times = np.repeat(batch.column("times").to_numpy(), many)
            total += np.bincount(found, weights=times, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for rows in counted:
        sums = rows.select("times", "found").mapInArrow(add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
        for bucket, n in sums.collect():  # at most one row a bucket
            out[bucket] += n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(...)) of the smoothed ratio of target and source frequencies."""
    buckets = len(source)
    above = (target + 1.0) * (float(source.sum()) + buckets)
    below = (source + 1.0) * (float(target.sum()) + buckets)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def _with_gains(counted: DataFrame, gains: np.ndarray) -> DataFrame:
    """counted with n_features and gain, the sum over its features, in the place of found."""
    names = [c for c in counted.columns if c != "found"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, many = _lists(batch.column("found"))
            sums = np.concatenate([[0], np.cumsum(gains[found])])
            ends = np.cumsum(many, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(many.astype(np.int64)), pa.array(sums[ends] - sums[ends - many])], [*names, "n_features", "gain"]
            )

    return counted.mapInArrow(add, ", ".join(f"{c} bigint" for c in [*names, "n_features", "gain"]))


def weighed(documents: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, version, copies, n_words, n_features, weight: a row for each doc_id and text, with the rows that have both."""
    texts = _texts(documents)
    goal = target.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("version"), F.coalesce(target[f"`{text}`"], F.lit("")).alias("text"))
    lines = materialize(counted_lines(texts, longest, buckets), "imp-lines")
    wanted = [counted_lines(goal, longest, buckets)]
    source = [lines]
    if longest > 1:
        runs = materialize(crossing_runs(texts, longest, buckets), "imp-runs")
        source.append(runs)
        wanted.append(crossing_runs(goal, longest, buckets))
    gains = bucket_gains(histogram(source, buckets), histogram(wanted, buckets))
    places = texts.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    places = places.select("doc_id", "version", (F.col("at") == 0).cast("long").alias("head"), *_line_keys(F.col("line")))
    sums = materialize(_with_gains(lines, gains), "imp-sums")
    parts = skewed_join(materialize(places, "imp-places"), sums, ["k1", "k2"], "times")
    parts = parts.select("doc_id", "version", "head", "n_words", "n_features", "gain")
    if longest > 1:
        runs = _with_gains(runs.select("doc_id", "version", "times", "found"), gains)
        parts = parts.unionByName(runs.select("doc_id", "version", F.lit(0).cast("long").alias("head"), F.lit(0).cast("long").alias("n_words"), "n_features", "gain"))
    whole = parts.groupBy("doc_id", "version").agg(
        F.sum("head").alias("copies"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")]
    )
    one = lambda c: F.expr(f"{c} DIV copies")  # noqa: E731  equal rows add up to a multiple
    return whole.select(
        "doc_id", "version", "copies", one("n_words").alias("n_words"), one("n_features").alias("n_features"),
        F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(F.lit(0).cast("long")).alias("weight"),
    )


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of the doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (`rank`, from 1) in the order, from a range-partitioned sort and the sizes of its partitions."""
    placed = materialize(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row a partition of the sort
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    out = placed.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("rank", F.col("__before") + inside + 1).drop("__at", "__part", "__before")


def resampled(
    documents: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of documents; rank is null for rows that are not drawn."""
    rows = weighed(documents, target, longest=longest, buckets=buckets)
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = materialize(rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), "imp-rows")
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = rows.filter(able).count() * percent // 100
    order = [F.desc("score"), F.col("doc_id"), F.col("version"), F.col("copy")]
    places = ranked(rows.filter(able), order, "imp-ranked")
    places = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return places.select(columns).unionByName(rest.select(columns))


ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS tab
  FROM range(256) r(b)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
x AS (SELECT doc_id, unnest(w) AS w FROM d),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM x UNION SELECT w FROM b)),
k AS (SELECT w, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
    lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS n FROM x JOIN k ON x.w = k.w GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN k ON b.w = k.w GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
    / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
p AS (SELECT doc_id, count(*) AS n, sum(gain) AS gain FROM x JOIN k ON x.w = k.w JOIN g ON k.bucket = g.bucket GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_features, coalesce(floor(gain::DOUBLE / n), 0)::BIGINT AS weight,
    ('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN p ON d.doc_id = p.doc_id),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM f),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, floor(count(*) OVER () * 10 / 100) AS drawn FROM c WHERE n_features >= 20)
SELECT c.doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM c LEFT JOIN r ON c.doc_id = r.doc_id
"""
