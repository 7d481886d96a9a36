"""Fill-in-middle transformation by a secondary sort of unit-chunk pieces.

A text is cut at two places drawn from a hash of its doc_id, and its parts change places: psm writes prefix, suffix,
middle, spm writes suffix, prefix, middle, each part behind its sentinel; plain leaves the text as it is. Units are code
points.

Every row emits pieces of at most UNITS code points, keyed by document and output position. One exchange by document,
sorted within partitions by that position (repartitionAndSortWithinPartitions, in DataFrame terms), lets a task stream
the pieces of an output one after the other into a digest, so no task holds a long output. The same stream reads the
sentinels back and gives each piece its place in the original; the rows stay in their partition and are sorted anew to
stream the restored text into a second digest.

Edge cases: a null text is empty; empty texts, texts that hold a sentinel, and rows without doc_id are plain. Rows that
repeat a doc_id are transformed each by their own text, rows that repeat both give equal rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import pick, slices

# The sentinels before prefix, suffix and middle, and the order of the parts in each form.
SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
ORIGINAL = ("prefix", "middle", "suffix")

UNITS = 1 << 14
SLICE = 1 << 20

KEY = ["doc_id", "version", "part"]
ABOUT = ["n", "form", "first", "second"]
PLANNED = "doc_id bigint, version bigint, part int, n bigint, form string, first bigint, second bigint"
_MARK = re.compile("|".join(map(re.escape, SENTINELS.values())))
_RANK = {mark: ORIGINAL.index(name) for name, mark in SENTINELS.items()}
_BEGUN = tuple(sorted({mark[:i] for mark in SENTINELS.values() for i in range(1, len(mark))}, key=len, reverse=True))


def draws(doc_id: Column, seed: int, count: int) -> list[Column]:
    """The first 8-digit groups of the hex sha256 of `seed:doc_id`, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def planned(documents: DataFrame, seed: int, plain: int, spm: int) -> DataFrame:
    """doc_id, version, part, n, form, first, second, text: where each text is cut (ends of prefix and middle) and its form.

    plain and spm are percentages: of the rows that stay plain, and of the others that become spm. version and part
    (the row's input partition) tell rows of one doc_id apart.
    """
    rows = pick(documents, doc_id="doc_id", text="text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.length("text").cast("long"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed, 4)
    ends = [h % (F.col("n") + 1) for h in (h1, h2)]
    stays = (F.col("n") == 0) | F.col("doc_id").isNull() | (h3 % 100 >= 100 - plain)
    for mark in SENTINELS.values():
        stays = stays | F.col("text").contains(mark)
    form = F.when(stays, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    return rows.select(
        "doc_id", F.xxhash64("text").alias("version"), F.spark_partition_id().alias("part"), "n", form.alias("form"),
        F.least(*ends).alias("first"), F.greatest(*ends).alias("second"), "text",
    )


def _rows(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about SLICE code points; a row's last value is its text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 100
        if size >= SLICE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_ABOUT_FIELDS = [("doc_id", pa.int64()), ("version", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("form", pa.string()), ("first", pa.int64()), ("second", pa.int64())]
_PIECES = pa.schema([*_ABOUT_FIELDS, ("at", pa.int64()), ("piece", pa.string())])
_SECTIONS = pa.schema([*_ABOUT_FIELDS, ("copies", pa.int64()), ("rank", pa.int32()), ("at", pa.int64()), ("piece", pa.string())])
_RESULTS = pa.schema([*_ABOUT_FIELDS, ("restored", pa.string()), ("output", pa.string())])


def _parts(text: str, form: str, first: int, second: int) -> Iterator[tuple[int, int, bool]]:
    """The output as (start, stop) of the text, or the text of a sentinel, in output order."""
    if form == "plain":
        yield text, 0, len(text)
        return
    span = {"prefix": (0, first), "middle": (first, second), "suffix": (second, len(text))}
    for name in FORMS[form]:
        yield SENTINELS[name], 0, len(SENTINELS[name])
        yield text, *span[name]


def pieces(plan: DataFrame, units: int = UNITS) -> DataFrame:
    """Pieces of all outputs, dealt by document and sorted by output position (`at`) within partitions."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in slices(batches, "text", SLICE):
                for *about, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    at = 0
                    for source, start, stop in _parts(text, *about[4:]):
                        for a in range(start, stop, units):
                            b = min(a + units, stop)
                            yield *about, at, source[a:b]
                            at += b - a
                    if not at:
                        yield *about, 0, ""

        return _rows(rows(), _PIECES)

    dealt = plan.mapInArrow(cut, f"{PLANNED}, at bigint, piece string").repartition(*KEY)
    return dealt.sortWithinPartitions(*KEY, "at")


class Whole:
    """Takes the bytes of a text like a digest and returns the text."""

    def __init__(self) -> None:
        self.held: list[bytes] = []

    def update(self, data: bytes) -> None:
        self.held.append(data)

    def hexdigest(self) -> str:
        return b"".join(self.held).decode()


def _sections(form: str) -> Callable[[str, bool], Iterator[tuple[int, str]]]:
    """A reader of output pieces that returns what they hold of prefix (0), middle (1) and suffix (2)."""
    rank, left = 0, ""

    def read(piece: str, last: bool) -> Iterator[tuple[int, str]]:
        nonlocal rank, left
        if form == "plain":
            yield 0, piece
            return
        text, begin = left + piece, 0
        for mark in _MARK.finditer(text):
            yield rank, text[begin : mark.start()]
            rank, begin = _RANK[mark.group()], mark.end()
        text = text[begin:]
        open_end = 0 if last else next((len(b) for b in _BEGUN if text.endswith(b)), 0)
        left = text[len(text) - open_end :]
        yield rank, text[: len(text) - open_end]

    return read


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def outputs(dealt: DataFrame, sink: Callable = hashlib.sha256) -> DataFrame:
    """A row with the sink's value of each output (rank -1), and the pieces by their place in the original."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(about: tuple, copies: int, whole, read, offsets: list[int]) -> Iterator[tuple]:
            yield from placed(about, copies, read("", True), offsets)
            yield *about, copies, -1, 0, whole.hexdigest()

        def placed(about: tuple, copies: int, found: Iterator[tuple[int, str]], offsets: list[int]) -> Iterator[tuple]:
            for rank, text in found:
                if text:
                    yield *about, copies, rank, offsets[rank], text
                    offsets[rank] += len(text)

        def rows() -> Iterator[tuple]:
            key = about = None
            for *now, at, piece in _read(batches):
                if now[:3] != key:
                    if key is not None:
                        yield from closed(about, copies, whole, read, offsets)
                    key, about, copies, done = now[:3], now, 0, -1
                    whole, read, offsets = sink(), _sections(now[4]), [0, 0, 0]
                if at == 0:
                    copies += 1
                if at <= done:  # a piece of a row that repeats this one
                    continue
                done = at
                whole.update(piece.encode())
                yield from placed(about, 1, read(piece, False), offsets)
            if key is not None:
                yield from closed(about, copies, whole, read, offsets)

        return _rows(rows(), _SECTIONS)

    return dealt.mapInArrow(stream, f"{PLANNED}, copies bigint, rank int, at bigint, piece string")


def restored(sections: DataFrame, sink: Callable = hashlib.sha256) -> DataFrame:
    """A row for every document: PLANNED, output (the value of rank -1) and the sink's value of the restored text."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key = None
            for *now, copies, rank, _, piece in _read(batches):
                if now[:3] != key:
                    if key is not None:
                        yield from [(*about, whole.hexdigest(), output)] * many
                    key, about, whole = now[:3], now, sink()
                if rank < 0:
                    output, many = piece, copies
                else:
                    whole.update(piece.encode())
            if key is not None:
                yield from [(*about, whole.hexdigest(), output)] * many

        return _rows(rows(), _RESULTS)

    return sections.sortWithinPartitions(*KEY, "rank", "at").mapInArrow(stream, f"{PLANNED}, restored string, output string")


def transformed(documents: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, units: int = UNITS, sink: Callable = Whole) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, restored for every row of documents.

    output and restored are the texts, or what another sink makes of them, such as hashlib.sha256.
    """
    plan = planned(documents, seed, plain, spm)
    rows = restored(outputs(pieces(plan, units), sink), sink)
    part = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select(
        "doc_id", "n", "form", part(F.col("first")).alias("prefix_chars"), part(F.col("second") - F.col("first")).alias("middle_chars"),
        "output", "restored",
    )


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for every row of documents."""
    return transformed(documents, sink=hashlib.sha256).withColumnsRenamed({"output": "output_sha256", "restored": "restored_sha256"})


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS p,
    ('0x' || h[25:32])::BIGINT % 100 AS q FROM d),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR p >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END
    AS form FROM u),
o AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END)
    AS output_sha256,
  sha256(text) AS restored_sha256 FROM o
"""
