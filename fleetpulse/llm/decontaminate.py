"""Benchmark decontamination: every task keeps an FM-index over its shard of documents.

A shard's words become symbols of the benchmark's vocabulary; runs of such words that are long enough to hold
a test phrase are indexed (suffix array, Burrows-Wheeler transform, wavelet-tree ranks, sampled positions).
All test phrases are searched backwards at once, located, and merged to spans of the documents.

A test phrase is a window of 13 consecutive words of an item, or all words of a shorter item.

Edge cases: null texts, texts and items without words hit nothing; items and documents that repeat are judged
each; an item without item_id is searched, but named "null". Empty tables give empty or clean results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm.common import LETTER_OR_DIGIT, LOWER, flat, pick, slices, word_hashes, words
from fleetpulse.session import materialize, scratch_path

WINDOW = 13
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 32 << 20  # of benchmark text and names searched (and broadcast) at a time
GROUPS = 64  # of benchmark texts whose sizes are cumulated at once
SAMPLE = 8  # every eighth position of a shard is kept


@dataclass
class Phrases:
    """Distinct windows of a block of items: symbols[k] has all windows of length k as rows."""

    vocabulary: np.ndarray  # sorted word hashes; symbol i + 1 is vocabulary[i]
    symbols: dict[int, np.ndarray]
    items: dict[int, list[list[int]]]  # the texts of each window
    names: list[list[str]]  # the items of each text

    @property
    def shortest(self) -> int:
        return min(self.symbols, default=0)


def prepare(texts: list[str | None], names: list[list[str]]) -> Phrases:
    data, offsets = flat(pa.array(texts, pa.string()))
    data = LOWER[data]
    starts, ends, counts = words(data, offsets, LETTER_OR_DIGIT)
    hashes = word_hashes(data, starts, ends)
    vocabulary, symbol = np.unique(hashes, return_inverse=True)
    symbol = symbol.astype(np.int32) + 1
    held: dict[int, dict[tuple, set[int]]] = {}
    at = 0
    for text, count in enumerate(counts.tolist()):
        size = min(count, WINDOW)
        for i in range(at, at + count - size + 1 if count else at):
            held.setdefault(size, {}).setdefault(tuple(symbol[i : i + size].tolist()), set()).add(text)
        at += count
    return Phrases(
        vocabulary,
        {size: np.array(list(found), np.int32) for size, found in held.items()},
        {size: [sorted(x) for x in found.values()] for size, found in held.items()},
        names,
    )


class FmIndex:
    """An index of symbols > 0 with separators 0, which no pattern holds; the last symbol must be a separator."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        order = _suffix_order(text)
        self.last = text[order - 1]  # the Burrows-Wheeler transform
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])[:-1]
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[1:] = text[:-1] == 0  # walks to the left end here at the latest, before a separator
        sampled = (order % SAMPLE == 0) | starts[order]
        self.sampled, self.place = sampled, np.cumsum(sampled) - 1
        self.held = order[sampled]
        self.levels = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        row = self.last.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.size = n
        self.base = self._descend(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ((symbol >> (self.levels - 1 - depth)) & 1).astype(bool)
            right = ones[at]
            at = np.where(up, zeros + right, at - right)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before a row."""
        return self._descend(symbol, at) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns (rows) that occur, and their ranges of rows in suffix order."""
        live = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for i in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, i]
            low = self.first[symbol] + self.rank(symbol, low)
            high = self.first[symbol] + self.rank(symbol, high)
            some = low < high
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps to the left until a sampled one."""
        out = np.empty(len(rows), np.int64)
        left, steps, rows = np.arange(len(rows)), 0, rows.copy()
        while len(left):
            known = self.sampled[rows]
            out[left[known]] = self.held[self.place[rows[known]]] + steps
            left, rows = left[~known], rows[~known]
            symbol = self.last[rows]
            rows = self.first[symbol] + self.rank(symbol, rows)
            steps += 1
        return out


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; separators are distinct, in order of position, and below all symbols."""
    n = len(text)
    cuts = text == 0
    rank = text.astype(np.int64) + int(cuts.sum())
    rank[cuts] = np.arange(int(cuts.sum()))
    width = 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[:-width] = rank[width:]
        key = rank * (int(rank.max()) + 2) + ahead + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 or width >= n:
            return order


def find(phrases: Phrases, symbol: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, start (word of the shard) and window number of all occurrences, one length of windows at a time."""
    if not phrases.symbols or not len(symbol):
        return
    known = symbol > 0
    edge = np.zeros(len(symbol) + 1, bool)
    edge[np.cumsum(counts)] = True
    edge[0] = True
    begins = known & (edge[:-1] | ~np.concatenate([[False], known[:-1]]))
    ends = known & (edge[1:] | ~np.concatenate([known[1:], [False]]))
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = last - first >= phrases.shortest
    first, size = first[long], (last - first)[long]
    if not len(first):
        return
    # runs end to end, each with a separator behind it
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(size), np.int64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(begin, size) + inside] = symbol[np.repeat(first, size) + inside]
    index = FmIndex(text, len(phrases.vocabulary))
    for length, patterns in phrases.symbols.items():
        window, low, high = index.search(patterns)
        many = high - low
        rows = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        place = index.locate(rows)
        run = np.searchsorted(begin, place, "right") - 1
        yield length, first[run] + place - begin[run], np.repeat(window, many)


def scan(phrases: Phrases, texts: pa.Array) -> list[dict]:
    """What is found in each text: word count, removal spans (bytes) and their words, items."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, counts = words(data, offsets, LETTER_OR_DIGIT)
    hashes = word_hashes(data, starts, ends)
    symbol = np.zeros(len(hashes), np.int64)
    if len(phrases.vocabulary):
        at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
        symbol = np.where(phrases.vocabulary[at] == hashes, at + 1, 0)
    cover = np.zeros(len(hashes) + 1, np.int64)
    first_word = np.cumsum(counts) - counts
    items: dict[int, set[int]] = {}
    for length, begin, window in find(phrases, symbol, counts):
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + length, -1)
        row = np.searchsorted(first_word + counts, begin, "right")
        for r, w in np.unique(np.stack([row, window], 1), axis=0).tolist():
            items.setdefault(r, set()).update(phrases.items[length][w])
    hit = np.cumsum(cover[:-1]) > 0
    out = [{"n_words": int(c), "n_hit": 0, "items": [], "spans": []} for c in counts]
    for r, texts_of in items.items():
        own = hit[first_word[r] : first_word[r] + counts[r]]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        out[r]["n_hit"] = int(own.sum())
        out[r]["items"] = sorted({name for text in texts_of for name in phrases.names[text]})
        a, b = first_word[r] + edges[::2], first_word[r] + edges[1::2] - 1
        out[r]["spans"] = [
            {"first_word": int(i - first_word[r]), "last_word": int(j - first_word[r]), "start": int(starts[i] - offsets[r]), "end": int(ends[j] - offsets[r])}
            for i, j in zip(a, b, strict=True)
        ]
    return out


def merge_spans(spans: list[dict]) -> list[dict]:
    """Overlapping or touching word spans as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first_word"], s["last_word"])):
        if out and s["first_word"] <= out[-1]["last_word"] + 1:
            if s["last_word"] > out[-1]["last_word"]:
                out[-1] |= {"last_word": s["last_word"], "end": s["end"]}
        else:
            out.append(dict(s))
    return out


_LONG = T.LongType()
SPAN = T.StructType().add("first_word", _LONG).add("last_word", _LONG).add("start", _LONG).add("end", _LONG)
FOUND = (
    T.StructType().add("n_words", _LONG).add("n_hit", _LONG).add("items", T.ArrayType(T.StringType())).add("spans", T.ArrayType(SPAN))
)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark in blocks as search phrases; a block goes beyond block_bytes (texts, names) by one text at most.

    Each distinct text is in one block, with all its items. Sizes are cumulated in each of a few hashed groups at once.
    """
    items = pick(benchmark, name="item_id", text="text").filter("text IS NOT NULL")
    name = F.coalesce(F.col("name").cast("string"), F.lit("null"))
    texts = items.groupBy("text").agg(F.collect_set(name).alias("names"))
    texts = texts.withColumn("size", (F.octet_length("text") + F.octet_length(F.array_join("names", ""))).cast("long"))
    texts = materialize(texts.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(GROUPS)).cast("int")), "benchmark-texts")
    sizes = {r["part"]: r["size"] for r in texts.groupBy("part").agg(F.sum("size").alias("size")).collect()}
    before = np.cumsum([0, *[sizes.get(i, 0) for i in range(GROUPS)]]).tolist()
    blocks = max(1, -(-before[-1] // block_bytes))
    if blocks > 1:
        own = F.sum("size").over(Window.partitionBy("part").orderBy("text")) - F.col("size")
        start = F.get(F.array(*[F.lit(int(x)).cast("long") for x in before]), F.col("part"))
        block = F.floor((own + start) / block_bytes).cast("long")
        texts = materialize(texts.withColumn("block", block), "benchmark-blocks")
    for i in range(blocks):
        rows = (texts.filter(F.col("block") == i) if blocks > 1 else texts).select("text", "names").collect()
        if rows or not i:  # a text that is larger than a block leaves the next ones empty
            yield prepare([r["text"] for r in rows], [r["names"] for r in rows])


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def search(documents: DataFrame, benchmark: DataFrame, found: str = "found", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with a struct column: n_words, n_hit, items (names, sorted as text) and merged removal spans.

    No shuffle of documents: each is judged in the task that reads it. The benchmark goes to the tasks in blocks of a
    stated size, one pass over the rows for each block; later passes add to what the earlier ones found. A pass is
    stored before the next one begins, so that driver and tasks hold one block at a time.
    """
    out = documents
    spark = documents.sparkSession
    schema = T.StructType([f for f in documents.schema.fields if f.name != found]).add(found, FOUND)
    held, path = None, None
    for phrases in _blocks(benchmark, block_bytes):
        if held is not None:
            last, path = path, scratch_path(spark, "decontamination")
            out.write.option("compression", "zstd").parquet(path)
            out = spark.read.schema(schema).parquet(path)
            held.destroy()
            if last:
                _delete(spark, last)
        again, held = held is not None, spark.sparkContext.broadcast(phrases)

        def judge(batches: Iterator[pa.RecordBatch], held=held, again=again) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", SHARD_BYTES):
                results = scan(held.value, batch.column("text"))
                if again:
                    results = [_joined(a, b) for a, b in zip(batch.column(found).to_pylist(), results, strict=True)]
                columns = [batch.column(f.name) for f in schema.fields[:-1]]
                column = pa.array(results, _ARROW)
                yield pa.RecordBatch.from_arrays([*columns, column], [f.name for f in schema.fields])

        out = out.mapInArrow(judge, schema)
    return out


_ARROW_SPAN = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_ARROW_SPAN))])


def _joined(a: dict, b: dict) -> dict:
    spans = merge_spans([*a["spans"], *b["spans"]])
    hit = sum(s["last_word"] - s["first_word"] + 1 for s in spans)
    return {"n_words": a["n_words"], "n_hit": hit, "items": sorted({*a["items"], *b["items"]}), "spans": spans}


def contaminated(found: str = "found"):
    return F.expr(f"{found}.n_hit > 0 AND 20 * {found}.n_hit >= {found}.n_words")


def report(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans for every document."""
    rows = search(pick(documents, doc_id="doc_id", text="text"), benchmark, "found", block_bytes)
    return rows.select(
        "doc_id", "found.n_words", "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"), "found.spans",
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents, all columns, that are not contaminated."""
    name = "__found"
    return search(documents, benchmark, name).filter(~contaminated(name)).drop(name)


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


ORACLE = r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM s, range(1, 10000) r(i) WHERE i <= len(w) - n + 1),
sizes AS (SELECT DISTINCT n FROM q),
d AS (SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM w, sizes, range(1, 100000) r(i) WHERE i <= len(w) - n + 1),
h AS (SELECT d.id, d.i, d.n, q.item_id FROM d JOIN q ON d.n = q.n AND d.win = q.win),
c AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM h) GROUP BY id),
t AS (SELECT id, count(DISTINCT item_id) AS n_items,
    sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM h GROUP BY id)
SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN c ON c.id = w.id LEFT JOIN t ON t.id = w.id
"""
