"""Near-dedup of embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors are linked if their labels are equal and their cosine, in double precision, reaches the least one. Equal
vectors of a label form a class that goes on once, with its size. Each class gets a key of `bits` signs in each of
`tables` tables; a pair at the least cosine agrees in a sign with probability p = 1 - angle / pi. bits grows with the
logarithm of the largest label, so that unrelated vectors seldom meet, and tables follows from it, so that a pair at the
least cosine meets in no table with probability `miss` at most (closer pairs: less), at every size.

Classes with equal keys meet in tasks; a key of more than BLOCK classes is cut into blocks, and each two of its blocks
meet in a task of their own. There all cosines are computed and only sums leave the task: links of each class, counted
in the first table in which a pair meets, and for each class one edge to the smallest one it is connected with. Links of
a dense group must be counted pair by pair, but no pairs are emitted.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, link
with nothing; so do vectors of different lengths. Rows that repeat a vec_id count as vectors of their own. Rows without
vec_id take part; component_id is the smallest vec_id present, null if there is none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import pick, skewed_join
from fleetpulse.llm.components import components
from fleetpulse.session import materialize

LEAST = 0.98
MISS = 1e-3
SEED = 20240613
BLOCK = 1024
SMALL = 64  # groups up to this size are compared by diagonals, all groups of a batch at once
PAIRS = 1 << 17

BUCKET = ["label", "dims", "table", "sign"]


def tables_for(largest: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """Signs a key and number of tables for labels of up to `largest` classes."""
    bits = min(60, max(8, math.ceil(math.log2(max(largest, 1))) + 4))
    agree = 1 - math.acos(least) / math.pi
    return bits, math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The components of all vectors in double precision, end to end, and the length of each vector."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def rows_and_classes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vec_id, k of every row (k null if it can't be linked), and the classes: k, label, dims, vector, vec_id, size."""
    rows = pick(embeddings, vec_id="vec_id", vector="embedding", label="label")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "vector")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("label").isNotNull() & F.coalesce(F.forall("vector", number) & F.exists("vector", lambda x: x != 0), F.lit(False))
    key = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), "label", "vector")), 16, "0") for i in range(2)])
    rows = rows.withColumn("k", F.when(good, key))
    classes = rows.filter("k IS NOT NULL").groupBy("k").agg(
        F.first("label").cast("string").alias("label"), F.first(F.size("vector")).alias("dims"), F.first("vector").alias("vector"),
        F.min("vec_id").alias("vec_id"), F.count("*").alias("size"),
    )
    return materialize(rows.select("vec_id", "k"), "vec-rows"), materialize(classes, "vec-classes")


def signed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """classes and signs: the key of each table."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            values, dims = _flat(batch.column("vector"))
            begins = np.cumsum(dims) - dims
            out = np.empty((len(dims), tables), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                planes = np.random.default_rng([SEED, int(d)]).standard_normal((int(d), tables * bits))
                above = unit(values[begins[at][:, None] + np.arange(d)]) @ planes > 0
                out[at] = above.reshape(len(at), tables, bits) @ weights
            ends = np.arange(len(dims) + 1, dtype=np.int32) * tables
            signs = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, signs], [*batch.schema.names, "signs"])

    return classes.mapInArrow(sign, classes.schema.simpleString()[len("struct<") : -1] + ",signs:array<bigint>")


def met(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """The signed classes that share a key with another one, once for each pair of blocks (i, j) of the key they belong to."""
    keys = materialize(classes.select("k", "label", "dims", F.posexplode("signs").alias("table", "sign")), "vec-keys")
    shared = materialize(keys.groupBy(*BUCKET).agg(F.count("*").alias("many")).filter("many > 1"), "vec-shared")
    members = skewed_join(keys, shared, BUCKET, "many")
    members = members.withColumn("blocks", F.ceil(F.col("many") / block)).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")))
    members = members.select("k", "table", "sign", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    members = members.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    return members.join(classes.select("k", "label", "dims", "vector", "size", "signs"), "k")


def _chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, from rows sorted by the keys, and the number of each row's group."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        group = _groups(rows, keys)
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield rows.slice(0, last), group[:last]
        held = rows.slice(last)
    if held is not None:
        yield held, _groups(held, keys)


def _groups(rows: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    for key in keys:
        values = rows.column(key).combine_chunks().dictionary_encode()
        values = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).indices.to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def linked_pairs(vectors: np.ndarray, group: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (a < b), in portions, whose cosine reaches the least one; vectors have length one."""
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[begins, len(group)])
    few = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, len(group))):
        a = np.flatnonzero(few[:-step] & (group[:-step] == group[step:]))
        if not len(a):
            break
        a = a[np.einsum("ij,ij->i", vectors[a], vectors[a + step]) >= least]
        yield a, a + step
    for begin, size in zip(begins[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        own = vectors[begin : begin + size]
        rows = max(1, PAIRS // int(size))
        for at in range(0, size, rows):
            a, b = np.nonzero(own[at : at + rows] @ own.T >= least)
            a += at
            yield begin + a[a < b], begin + b[a < b]


def judged(members: DataFrame, least: float = LEAST) -> DataFrame:
    """k, links, other: links of a class with vectors of other classes, to be added up, and an edge to a connected class."""
    keys = [*BUCKET, "i", "j"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _chunks(batches, keys):
            dims, i, j, block, table, size = (rows.column(c).to_numpy() for c in ("dims", "i", "j", "block", "table", "size"))
            signs = rows.column("signs").combine_chunks().flatten().to_numpy().reshape(len(group), -1)
            values, _ = _flat(rows.column("vector").combine_chunks())
            begins = np.cumsum(dims, dtype=np.int64) - dims
            links, root = np.zeros(len(group), np.int64), np.arange(len(group))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for x, y in linked_pairs(unit(values[begins[at][:, None] + np.arange(d)]), group[at], least):
                    a, b = at[x], at[y]
                    keep = (i[a] == j[a]) | (block[a] != block[b])
                    a, b = a[keep], b[keep]
                    while np.any(root[a] != root[b]):
                        low = np.minimum(root[a], root[b])
                        np.minimum.at(root, root[a], low)
                        np.minimum.at(root, root[b], low)
                        root = root[root]
                    new = (signs[a] == signs[b]).argmax(axis=1) == table[a]
                    np.add.at(links, a[new], size[b[new]])
                    np.add.at(links, b[new], size[a[new]])
            while np.any(root != root[root]):
                root = root[root]
            found = np.flatnonzero((links > 0) | (root != np.arange(len(group))))
            if len(found):
                k = rows.column("k").combine_chunks()
                other = k.take(pa.array(root[found], mask=root[found] == found))
                yield pa.RecordBatch.from_arrays([k.take(pa.array(found)), pa.array(links[found]), other], ["k", "links", "other"])

    dealt = members.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(judge, "k string, links bigint, other string")


def near_duplicates(embeddings: DataFrame, least: float = LEAST, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings."""
    rows, classes = rows_and_classes(embeddings)
    largest = classes.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 0
    classes = materialize(signed(classes, *tables_for(largest, least, miss)), "vec-signed")
    found = materialize(judged(met(classes, block), least), "vec-links")
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    merged = components(found.filter("other IS NOT NULL").select(F.col("k").alias("a"), F.col("other").alias("b")))
    judgement = classes.select("k", "vec_id", "size").join(links, "k", "left").join(merged.withColumnRenamed("node", "k"), "k", "left")
    judgement = judgement.withColumns({"n_links": F.col("size") - 1 + F.coalesce("links", F.lit(0)), "component": F.coalesce("label", "k")})
    judgement = materialize(judgement.select("k", "vec_id", "size", "n_links", "component"), "vec-judged")
    smallest = materialize(judgement.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("many")), "vec-components")
    judgement = skewed_join(judgement, smallest, ["component"], "many").select("k", "size", "n_links", "component_id")
    linked = skewed_join(rows.filter("k IS NOT NULL"), materialize(judgement, "vec-classes-judged"), ["k"], "size")
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    alone = rows.filter("k IS NULL").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    columns = ["vec_id", "n_links", "component_id", kept]
    return linked.select(columns).unionByName(alone.select(columns))


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
u AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM u GROUP BY a),
c AS (SELECT vec_id AS id, vec_id AS z FROM embeddings UNION SELECT c.id, u.b FROM c JOIN u ON u.a = c.z),
m AS (SELECT id, min(z) AS component_id FROM c GROUP BY id)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM m LEFT JOIN n ON n.a = id
"""
