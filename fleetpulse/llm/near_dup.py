"""MinHash near-dedup with odd sketches.

A document's set holds its distinct five-word shingles. Documents with equal sets form a class, and only one row
of a class goes on. 192 MinHash values of a class give 32 band keys of 6 values (a pair at similarity 0.85 shares
none with probability 3e-7) and are folded into an odd sketch: a parity bitmap of 512 bits, one flip a value.

Classes that share a band key form groups (connected components over star edges to the smallest class of each
key). A group's full sets then meet in tasks of bounded size: a group beyond the bound is cut into blocks. There,
population counts of XORed sketches choose what to compare, sets are intersected exactly, and only edges that join two
parts are emitted, so n classes give fewer than n edges a task and no pair of the final links is needed. In a group of
several blocks one set of each connected part meets the others of its kind, and only sets that are then still outside
the group's largest part are compared with all blocks: a group of near copies costs a copy of each set, not a
copy for each block. Components of all edges are the result.

Edge cases: a text without words has an empty set and is linked with nothing; with fewer than five words the whole
sequence is one shingle. Rows without doc_id take part in links; component_id is the smallest doc_id present, null
if there is none. Rows that repeat a doc_id are judged each by their text; if they fall into one component, `kept`
is true for all rows with its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import LOWER, NOT_SPACE, flat, mix, pick, shingles, skewed_join, slices, word_hashes, words
from fleetpulse.llm.components import components
from fleetpulse.session import materialize

SHINGLE = 5
LEAST = 85  # percent
BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
FAR_BITS = 128  # more differing sketch bits: below the least similarity (six deviations from what 0.85 gives)
SLICE = 1 << 20
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 21

_rng = np.random.default_rng(20240101)
FACTORS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and how many each has."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, counts = words(data, offsets, NOT_SPACE)
    hashes, many = shingles(word_hashes(data, starts, ends), counts, SHINGLE)
    row = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(many))


def set_keys(hashes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
        ends = np.cumsum(many)
        out.append(mix(sums[ends] - sums[ends - many] + many.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def signatures(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """MinHash values, sample x set; every set must have an element."""
    begins = np.cumsum(many) - many
    out = np.empty((SAMPLES, len(many)), np.uint64)
    for i in range(SAMPLES):
        out[i] = np.minimum.reduceat(hashes * FACTORS[i] + SHIFTS[i], begins)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Set x band: one 64-bit key for the values of a band, different from band to band."""
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], signature.shape[1], 1)
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + signature[i::ROWS])
    return out.T.view(np.int64)


def odd_sketches(signature: np.ndarray) -> np.ndarray:
    """Set x byte: the bit that a sample's value hashes to is flipped once for each sample."""
    n = signature.shape[1]
    salt = np.arange(SAMPLES, dtype=np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95)
    bit = (mix(signature ^ salt) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((bit + np.arange(n) * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)


def _list(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] if values.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))


def sketched(documents: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text), n, k1, k2, bands, sketch of every row; bands and sketch are zero for empty sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            hashes, many = shingle_sets(batch.column("text"))
            k1, k2 = set_keys(hashes, many)
            full = np.flatnonzero(many)
            bands = np.zeros((len(many), BANDS), np.int64)
            bits = np.zeros((len(many), SKETCH_BITS // 8), np.uint8)
            if len(full):
                signature = signatures(hashes, many[full])
                bands[full], bits[full] = band_keys(signature), odd_sketches(signature)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(many.astype(np.int64)), pa.array(k1), pa.array(k2), _list(bands),
                 pa.array([b.tobytes() for b in bits], pa.binary())],
                ["doc_id", "version", "n", "k1", "k2", "bands", "sketch"],
            )

    rows = pick(documents, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text"
    )
    return rows.mapInArrow(
        sketch, "doc_id bigint, version bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>, sketch binary"
    )


def set_classes(rows: DataFrame) -> DataFrame:
    """node, k1, k2, doc_id, version, n, bands, sketch: each distinct set once, with one of its documents.

    node is k1, but where sets with different k2 have one k1: all of them but one get another number.
    """
    one = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "version")).alias("one")
    classes = rows.groupBy("k1", "k2").agg(one, *[F.first(c).alias(c) for c in ("n", "bands", "sketch")])
    turn = F.row_number().over(Window.partitionBy("k1").orderBy("k2"))
    classes = classes.withColumn("node", F.when(turn == 1, F.col("k1")).otherwise(F.xxhash64("k1", "k2")))
    return classes.select("node", "k1", "k2", "one.doc_id", "one.version", "n", "bands", "sketch")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """node, label: classes that share a band key with another one, by group."""
    keys = classes.select("node", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head < last").select("key", "head")
    stars = keys.join(heads, "key").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return components(stars)


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (with doc_id, version, k1, k2) and its shingle hashes, worked out anew from the documents' texts.

    Rows that repeat doc_id and text, as rows without either may, come out once for each of them.
    """
    texts = pick(documents, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_version"), "text"
    )
    own = texts["id"].eqNullSafe(wanted["doc_id"]) & (texts["text_version"] == wanted["version"])
    rows = texts.join(wanted, own).drop("id", "text_version", "doc_id", "version")
    names = [c for c in rows.columns if c != "text"]
    schema = rows.drop("text").schema.simpleString()[len("struct<") : -1]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            hashes, many = shingle_sets(batch.column("text"))
            k1, k2 = set_keys(hashes, many)
            ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))
            same = (batch.column("k1").to_numpy() == k1) & (batch.column("k2").to_numpy() == k2)  # not so for other rows of a repeated id
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], column], [*names, "hashes"])
            yield out.filter(pa.array(same))

    return rows.mapInArrow(sets, schema + ",hashes:array<bigint>")


def link(
    ids: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], least: int = LEAST,
    part: np.ndarray | None = None, turns: np.ndarray | None = None, main: int | None = None,
) -> list[tuple[int, int]]:
    """Edges that join all linked sets of a group, fewer than there are sets.

    Sets are taken in turn, the one with the most common shingles first; each is compared with all others of
    which it isn't known yet that they are connected. Those inside the largest part need no turn of their own.
    With turns, only the marked sets are taken, and only part `main` (as numbered in part) needs no turn.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    if n < 2:
        return []
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(place, kind="stable")
    posting = row[order]
    ends = np.cumsum(np.bincount(place, minlength=len(values)))
    begins = np.concatenate([[0], ends[:-1]])
    first = np.cumsum(size) - size
    common = np.add.reduceat((ends - begins)[place].astype(float), first) / size
    part = np.arange(n) if part is None else part.copy()
    done, edges = np.zeros(n, bool) if turns is None else ~turns, []
    order = np.argsort(-common, kind="stable")
    while True:
        if turns is None:
            settled = np.bincount(part, minlength=n).argmax() if done.any() else -1
        else:
            settled = main
        turn = order[~done[order] & (part[order] != settled)]
        if not len(turn):
            return edges
        x = turn[0]
        done[x] = True
        other = np.flatnonzero(part != part[x])
        other = other[(size[other] * least <= size[x] * 100) & (size[x] * least <= size[other] * 100)]
        far = np.bitwise_count(sketches[other] ^ sketches[x]).sum(axis=1, dtype=np.int64)
        other = other[far <= FAR_BITS]
        if not len(other):
            continue
        if len(other) <= 8:
            shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in other])
        else:
            own = place[first[x] : first[x] + size[x]]
            many = ends[own] - begins[own]
            at = np.repeat(begins[own], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            shared = np.bincount(posting[at], minlength=n)[other]
        for y in other[100 * shared >= least * (size[x] + size[other] - shared)]:
            if part[x] != part[y]:
                edges.append((int(ids[x]), int(ids[y])))
                low, high = (part[y], part[x]) if part[y] == main else (part[x], part[y])
                part[part == high] = low


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _judged(met: DataFrame) -> DataFrame:
    """Edges (a, b) between the sets of each (label, i, j).

    met: node, label, i, j, sketch, hashes; rows with `turn` (null: all) are compared with the others, as in link().
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["label", "i", "j"]):
            ids, at = np.unique(group.column("node").to_numpy(), return_index=True)  # rows that take their turn come first
            group = group.take(pa.array(at))
            bits = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            column = group.column("hashes").combine_chunks()
            values, sizes = column.flatten().to_numpy().view(np.uint64), np.diff(column.offsets.to_numpy())
            ends = np.cumsum(sizes)
            sets = [values[b - n : b] for b, n in zip(ends, sizes, strict=True)]
            if group.column("turn").null_count:
                edges = link(ids, bits, sets)
            else:
                parts, part = np.unique(group.column("part").to_numpy(), return_inverse=True)
                largest = np.searchsorted(parts, group.column("main")[0].as_py())
                main = int(largest) if largest < len(parts) and parts[largest] == group.column("main")[0].as_py() else -1
                edges = link(ids, bits, sets, part=part, turns=np.array(group.column("turn").to_pylist()), main=main)
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = met.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", F.desc("turn"))
    return dealt.mapInArrow(judge, "a bigint, b bigint")


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """label, many, blocks: the rows of each label and the blocks they are cut into."""
    blocks = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    return materialize(rows.groupBy("label").agg(F.count("*").alias("many"), blocks.alias("blocks")), "near-blocks")


def _dealt(rows: DataFrame, block_rows: int, name: str) -> DataFrame:
    """rows with the blocks of their label and the block they fall into."""
    rows = skewed_join(rows, _blocks(rows, block_rows), ["label"], "many").drop("many")
    return materialize(rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), name)


def _parts(large: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label, n, part: what each of the sets is connected with by the edges."""
    merged = components(edges).select("node", F.col("label").alias("part"))
    found = large.select("node", "label", "n").join(merged, "node", "left")
    return materialize(found.withColumn("part", F.coalesce("part", "node")), "near-parts")


def links(documents: DataFrame, classes: DataFrame, groups: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Edges (a, b) between classes, enough to connect all linked ones.

    Sets meet the others of their block. Where a group has several blocks, one set of each part that this leaves meets
    the others of its kind, and what is then outside the group's largest part meets all blocks of the group.
    """
    block_rows = block_rows or BLOCK_ROWS
    members = groups.join(classes.drop("bands"), "node")
    wanted = _dealt(materialize(members, "near-members"), block_rows, "near-wanted")
    sets = materialize(_sets(documents, wanted).dropDuplicates(["node"]), "near-sets").select("node", "label", "n", "sketch", "hashes", "blocks", "block")
    all_turn = {"j": F.lit(0).cast("long"), "turn": F.lit(None).cast("boolean"), "part": F.lit(None).cast("long"), "main": F.lit(None).cast("long")}
    columns = ["node", "label", "i", "j", "sketch", "hashes", "turn", "part", "main"]
    edges = materialize(_judged(sets.withColumn("i", F.col("block")).withColumns(all_turn).select(columns)), "near-edges")
    large = sets.filter("blocks > 1")
    if large.isEmpty():
        return edges
    heads = _parts(large, edges).groupBy("label", "part").agg(F.min(F.struct("node", "n")).alias("head")).select("label", "head.*")
    heads = _dealt(materialize(heads, "near-heads"), block_rows, "near-heads")
    met = large.select("node", "sketch", "hashes").join(heads.select("node", "label", F.col("block").alias("i")), "node")
    edges = materialize(edges.unionByName(_judged(met.withColumns(all_turn).select(columns))), "near-edges")
    parts = _parts(large, edges)
    sizes = parts.groupBy("label", "part").agg(F.count("*").alias("many"))
    main = sizes.groupBy("label").agg(F.max(F.struct("many", "part")).alias("main"), F.sum("many").alias("many")).select("label", "main.part", "many")
    main = materialize(main.withColumnRenamed("part", "main"), "near-main")
    parts = materialize(skewed_join(parts, main, ["label"], "many").drop("many"), "near-parts")
    if parts.filter("part <> main").isEmpty():
        return edges
    rest = _dealt(materialize(parts.filter("part <> main"), "near-rest"), block_rows, "near-rest")
    blocks = rest.groupBy("label").agg(F.max("blocks").alias("rest_blocks"))
    heavy = large.drop("n").join(parts.drop("label", "n"), "node")
    number = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    own = heavy.drop("block").join(rest.select("node", F.col("block").alias("i")), "node").withColumn("j", number("blocks"))
    counted = materialize(large.groupBy("label").agg(F.count("*").alias("many")).join(blocks, "label"), "near-blocks")
    others = skewed_join(materialize(heavy, "near-heavy"), counted, ["label"], "many")
    others = others.withColumns({"i": number("rest_blocks"), "j": F.col("block"), "turn": F.lit(False)})
    met = own.withColumn("turn", F.lit(True)).select(columns).unionByName(others.select(columns))
    return edges.unionByName(_judged(met))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, component, version: a row for every row of documents.

    component is the key of the component (null for empty sets), version a hash of the row's text.
    """
    rows = materialize(sketched(documents), "near-rows")
    full = rows.filter("n > 0")
    classes = materialize(set_classes(full), "near-classes")
    edges = links(documents, classes, candidate_groups(classes))
    merged = components(edges)
    found = classes.select("node", "k1", "k2", "doc_id").join(merged.select("node", "label"), "node", "left")
    found = found.select("k1", "k2", "doc_id", F.coalesce("label", "node").alias("component"))
    smallest = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = found.join(smallest, "component").select("k1", "k2", "component", "component_id")
    columns = [
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "component", "version",
    ]
    empty = rows.filter("n = 0").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
    return full.join(found, ["k1", "k2"]).select(columns).unionByName(empty.select(columns))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of documents, all columns, that are kept: one of each component, and all without words.

    It is the one with the smallest doc_id; of rows that share that id, or of a component without any id, the one
    whose text has the smallest hash. Rows that repeat both doc_id and text stay once.
    """
    kept = materialize(near_duplicates(documents).filter("kept").select("doc_id", "component", "version"), "near-kept")
    first = kept.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("k")).select("k.*")
    wanted = first.unionByName(kept.filter("component IS NULL").select("doc_id", "version")).distinct()
    wanted = wanted.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"))
    same = documents["doc_id"].cast("long").eqNullSafe(wanted["__id"]) & (F.xxhash64(documents["text"]) == wanted["__version"])
    rows = documents.join(wanted, same, "left_semi")
    repeated = kept.groupBy("doc_id", "version").count().filter("count > 1")
    return rows if repeated.isEmpty() else rows.dropDuplicates(["doc_id", "text"])


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, range(1, 100000) r(i) WHERE i <= greatest(len(w) - 4, least(len(w), 1))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM k JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT doc_id AS id, doc_id AS z FROM documents UNION SELECT c.id, u.b FROM c JOIN u ON u.a = c.z WHERE u.b < c.id OR u.b > c.id),
m AS (SELECT id, min(z) AS component_id FROM c GROUP BY id)
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = id
"""
