"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.session import materialize

EDGES = 1 << 18  # that a task contracts at a time


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n nodes, 0 to n - 1, reaches by the edges."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while not np.array_equal(root[root], root):
            root = root[root]
        a, b = root[low], root[high]
        a, b = a[a != b], b[a != b]
    return root


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of `rows` rows; the last may have fewer."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, rows - count))
            batch = batch.slice(held[-1].num_rows)
            count += held[-1].num_rows
            if count == rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def _rooted(edges: DataFrame, rows: int) -> DataFrame:
    """node, roots: for every node of the edges (a, b) the first node it reaches in each piece of a task that has it.

    Nodes are in the order of their hashes, so that chains shorten whatever the order of their numbers.
    """

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, rows):
            ends = pa.concat_arrays([*piece.column("a").chunks, *piece.column("b").chunks]).dictionary_encode()
            nodes, code = ends.dictionary, ends.indices.to_numpy()
            hashes = np.empty(len(nodes), np.int64)
            hashes[code] = np.concatenate([piece.column("ha").to_numpy(), piece.column("hb").to_numpy()])
            order = np.lexsort((pc.rank(nodes).to_numpy(), hashes))
            place = np.empty(len(nodes), np.int64)
            place[order] = np.arange(len(nodes))
            found = order[forest(place[code[: len(piece)]], place[code[len(piece) :]], len(nodes))]  # of the nodes as ordered
            roots = pa.StructArray.from_arrays([pa.array(hashes[found]), nodes.take(pa.array(found))], ["hash", "id"])
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(order)), roots], ["node", "root"])

    kind = edges.schema["a"].dataType.simpleString()
    ends = edges.select("a", "b", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb"))
    found = ends.mapInArrow(root, f"node {kind}, root struct<hash:bigint,id:{kind}>")
    return found.groupBy("node").agg(F.collect_set("root").alias("roots"))


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, label (a node of its component, the same for all of them) for all nodes of the edges (a, b).

    The label is the node with the smallest hash, whatever edges connect the component. In each round tasks contract
    the edges that they hold, `rows` at a time, and a node takes the first of the roots it got. Where they differ,
    they are the edges of the next round, among fewer nodes. Rounds are written to the shared folder; nothing is
    collected.
    """
    rows = rows or EDGES
    edges = edges.filter("a <> b")
    rounds = []
    while True:
        rounds.append(materialize(_rooted(edges, rows).select("node", F.array_min("roots").alias("root"), "roots"), "labels"))
        apart = rounds[-1].filter(F.size("roots") > 1)
        left = apart.agg(F.sum(F.size("roots") - 1)).first()[0]
        if not left:
            break
        edges = apart.select(F.explode("roots.id").alias("a"), F.col("root.id").alias("b")).filter("a <> b").coalesce(math.ceil(left / rows))
    labels = rounds.pop().select("node", F.col("root.id").alias("label"))
    if not rounds:
        return labels
    for upper in reversed(rounds):
        below = labels.withColumnRenamed("node", "root")
        labels = upper.select("node", F.col("root.id").alias("root")).join(below, "root", "left").select("node", F.coalesce("label", "root").alias("label"))
    return materialize(labels, "labels")
