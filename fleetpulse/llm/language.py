"""Language identification by partial matching: the language whose byte model codes a text shortest.

Each language has a context tree of order 3: counts of a byte after the three, two, one and no bytes before it.
A byte unseen in its longest context escapes to the next shorter one, with the bytes seen in the longer context
excluded (escape method C), down to equal shares of all bytes left. Statistics are frozen after training, so the
code length of a text is the sum over its bytes of a function of four bytes, and documents need no shuffle.

Training takes a bounded sample: about `rows` labelled rows of each language (chosen by a hash of doc_id, among
rows of at most `max_bytes` bytes), whole texts. The trees' size is bounded by rows x max_bytes a language.

Edge cases: a text that is null, empty or without a letter is `und` with score 0; so is every text if there is
nothing to learn from. Equal code lengths go to the language first in order of name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm.common import flat, pick, slices

ORDER = 3
ROWS = 400
MAX_BYTES = 1 << 16
SLICE = 1 << 18
UNKNOWN = "und"


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in its row (zero bytes before the start) as one 32-bit number."""
    out = data.astype(np.uint32)
    for back in range(1, ORDER + 1):
        before = np.zeros(len(data), np.uint32)
        before[back:] = data[:-back]
        begins = offsets[:-1][np.diff(offsets) > 0]
        for i in range(back):
            at = begins + i
            at = at[at < len(data)]
            before[at[np.searchsorted(offsets, at, "right") - 1 == np.searchsorted(offsets, at - i, "right") - 1]] = 0
        out |= before << np.uint32(8 * back)
    return out


@dataclass
class Tree:
    """Sorted contexts of one language by length: symbols after them, totals, and the lower-order count of these symbols."""

    gram: list[np.ndarray]
    count: list[np.ndarray]
    context: list[np.ndarray]
    total: list[np.ndarray]
    distinct: list[np.ndarray]
    excluded: list[np.ndarray]

    @classmethod
    def grow(cls, keys: np.ndarray, counts: np.ndarray) -> Tree:
        tree = cls([], [], [], [], [], [])
        for order in range(ORDER + 1):
            gram, inverse = np.unique(keys & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(inverse, weights=counts)
            context, begin, distinct = np.unique(gram >> np.uint32(8), return_index=True, return_counts=True)
            lower = np.zeros(len(gram))
            if order:
                short = gram & np.uint32((1 << 8 * order) - 1)
                lower = tree.count[-1][np.searchsorted(tree.gram[-1], short)]
            tree.gram.append(gram)
            tree.count.append(count)
            tree.context.append(context)
            tree.total.append(np.add.reduceat(count, begin))
            tree.distinct.append(distinct.astype(float))
            tree.excluded.append(np.add.reduceat(lower, begin))
        return tree

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each key after the three before it."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        gone = np.zeros(len(keys))  # count, at the present order, of symbols that longer contexts have excluded
        gone_distinct = np.zeros(len(keys))
        for order in range(ORDER, -1, -1):
            key = keys[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(self.context[order], key >> np.uint32(8)), len(self.context[order]) - 1)
            seen = self.context[order][at] == key >> np.uint32(8)
            total = np.where(seen, self.total[order][at] - gone, 0)
            distinct = np.where(seen, self.distinct[order][at] - gone_distinct, 0)
            place = np.minimum(np.searchsorted(self.gram[order], key), len(self.gram[order]) - 1)
            hit = self.gram[order][place] == key
            live = distinct > 0
            whole = np.where(live, total + distinct, 1)
            part = np.where(hit, self.count[order][place], np.where(live, distinct, 1))
            out[left] += np.log2(whole / part)
            go = ~hit
            gone = np.where(seen, self.excluded[order][at], 0)[go]
            gone_distinct = np.where(seen, self.distinct[order][at], 0)[go]
            left = left[go]
        out[left] += np.log2(256 - len(self.gram[0]))
        return out


@dataclass
class Model:
    """Trees of all languages, and their code lengths of every four bytes that any of them has seen, in a hash table."""

    languages: list[str]
    trees: list[Tree]
    slots: np.ndarray
    table: np.ndarray  # slot -> row of cost, -1 where free
    cost: np.ndarray  # language x known four bytes
    known: np.ndarray

    @classmethod
    def build(cls, counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        languages = sorted(counted)
        trees = [Tree.grow(*counted[name]) for name in languages]
        known = np.unique(np.concatenate([np.empty(0, np.uint32), *[t.gram[ORDER] for t in trees]]))
        cost = np.array([t.bits(known) for t in trees]).reshape(len(trees), len(known))
        size = 1 << max(4, int(len(known) * 4).bit_length())
        table = np.full(size, -1, np.int32)
        left, step = np.arange(len(known), dtype=np.int32), 0
        while len(left):
            slot = (_slot(known[left], size) + step) & (size - 1)
            free = table[slot] < 0
            table[slot[free]] = left[free]  # of keys that meet in a slot the last stays
            left = left[table[slot] != left]
            step += 1
        return cls(languages, trees, np.array([size]), table, cost, known)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of cost for each key; -1 for keys that no language has seen."""
        size = len(self.table)
        row = self.table[_slot(keys, size)]
        left = np.flatnonzero((row >= 0) & (self.known[row] != keys)) if len(self.known) else np.empty(0, np.int64)
        step = 1
        while len(left):
            again = self.table[(_slot(keys[left], size) + step) & (size - 1)]
            row[left] = again
            left = left[(again >= 0) & (self.known[again] != keys[left])]
            step += 1
        return row

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row's bytes under each language: language x row."""
        out = np.zeros((len(self.languages), len(offsets) - 1))
        full = np.flatnonzero(np.diff(offsets))
        if not len(full) or not self.languages:
            return out
        keys = grams(data, offsets)
        row = self.find(keys)
        new = np.flatnonzero(row < 0)
        rare, inverse = np.unique(keys[new], return_inverse=True)
        for i, tree in enumerate(self.trees):
            bits = self.cost[i][row]
            if len(new):
                bits[new] = tree.bits(rare)[inverse]
            out[i, full] = np.add.reduceat(bits, offsets[full])
        return out

    def judge(self, texts: pa.Array, letters: np.ndarray) -> pa.StructArray:
        """lang, score and bits per byte of each text; `letters` is false for texts without a letter."""
        data, offsets = flat(texts)
        bits = self.code_lengths(data, offsets)
        size = np.maximum(np.diff(offsets), 1)
        known = letters & (len(self.languages) > 0)
        best = bits.argmin(axis=0) if self.languages else np.zeros(len(size), np.int64)
        least = bits.min(axis=0) if self.languages else np.zeros(len(size))
        share = 1 / np.maximum(np.exp2(np.minimum(least - bits, 0)).sum(axis=0), 1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(np.where(known, least / size, 0.0))],
            ["lang", "score", "bits"],
        )


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Rows kept away from training: crc32 of the id as text, modulo 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def count_grams(sample: DataFrame) -> DataFrame:
    """lang, gram, n: how often each four bytes occur in the texts of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            names = np.array(batch.column("lang").to_pylist())
            for name in np.unique(names):
                data, offsets = flat(batch.column("text").filter(pa.array(names == name)))
                keys, n = np.unique(grams(data, offsets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(documents: DataFrame, rows: int = ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model of each language from a sample of the labelled documents that are not held out."""
    cut = pick(documents, doc_id="doc_id", text="text", lang="lang")
    usable = cut.filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.octet_length("text").between(1, max_bytes)
    )
    totals = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    place = F.pmod(F.xxhash64(F.lit("language sample"), F.col("doc_id")), F.lit(1 << 40))
    chosen = F.lit(False)
    for name, total in totals.items():
        limit = min(1 << 40, int((1 << 40) * rows / total) + 1)
        chosen = chosen | ((F.col("lang") == name) & (place < limit))
    counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    found = count_grams(usable.filter(chosen)).toPandas()
    for name, part in found.groupby("lang"):
        counted[name] = part["gram"].to_numpy().astype(np.uint32), part["n"].to_numpy().astype(float)
    return Model.build(counted)


FOUND = T.StructType().add("lang", T.StringType()).add("score", T.DoubleType()).add("bits", T.DoubleType())


def predict(documents: DataFrame, model: Model, found: str = "found") -> DataFrame:
    """documents with a struct column (lang, score, bits a byte), from the text alone."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    letters = f"{found}_letters"
    schema = T.StructType([f for f in documents.schema.fields if f.name != found]).add(found, FOUND)
    kept = [f.name for f in schema.fields[:-1]]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            has = batch.column(letters).to_numpy(zero_copy_only=False).astype(bool)
            result = held.value.judge(batch.column("text"), has)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], result], [*kept, found])

    flagged = documents.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return flagged.mapInArrow(judge, schema)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits for every document."""
    rows = predict(pick(documents, doc_id="doc_id", text="text"), learn(documents))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", "found.bits"
    )


def known_language(documents: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of documents, all columns, with a text in a learned language (a score of at least least_score)."""
    name = "__language"
    rows = predict(documents, learn(documents), name)
    return rows.filter((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= least_score)).drop(name)
