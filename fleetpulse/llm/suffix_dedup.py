"""Exact substring dedup with longest-previous-factor arrays.

Every byte covered by a 100-byte string that also starts earlier (smaller doc_id, or the same document and an
earlier start) is removed; strings are judged on the input.

1. Every run of 100 bytes holds an anchor: a 24-byte string whose hash is smallest in some window of 77 places.
   Equal runs hold equal anchors at equal places, so only anchors that occur more than once matter; a bitmap of
   fixed size lets (nearly) only these pass. Each start of a 100-byte string belongs to the anchor of its window; the
   starts of one anchor with 100 bytes behind the last of them are its context.
2. Occurrences with equal contexts (compared by hash) repeat the first of them as a whole and are marked.
3. The first occurrences of different contexts of one anchor meet in a task. There the suffixes that begin at the
   starts are sorted by their first 100 bytes; the previous and next smaller position in that order gives each
   suffix its longest previous factor, and marks it if that has 100 bytes. Anchors of a task are sorted together.
4. An anchor with more contexts than fit into a task (a passage with very many different surroundings) is not
   sorted: its strings meet by hash, aggregated to the earliest start, which gives the same marks.

Edge cases: a null text counts as empty; texts under 100 bytes lose nothing. Rows without doc_id come last. Rows that
repeat a doc_id are ordered by a hash of their text; rows that repeat doc_id and text are one document: none of
them starts earlier than the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import flat, mix, pick, slices, stored, window_hashes

LENGTH = 100
ANCHOR = 24
SPAN = LENGTH - ANCHOR + 1  # places for an anchor in a string of LENGTH bytes
SLICE = 1 << 20
MOST_CONTEXTS = 5000  # of one anchor in one task
TASK_BYTES = 1 << 20  # of contexts sorted together
SLOT_BITS = 27  # the bitmap of anchors that occur more than once has 2^27 bits, 16 MB
LAST = (1 << 63) - 1


def _last_smallest(values: np.ndarray, size: int) -> np.ndarray:
    """For each window of `size` values the place of the smallest, the last one of equals.

    The place never goes back. It moves to a value that enters and is the smallest now, or on to another one when
    the smallest has left the window, which shows as a larger minimum.
    """
    low, width = values, 1
    while width * 2 <= size:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(values) - size + 1
    low = np.minimum(low[:n], low[size - width : size - width + n])
    place = np.zeros(n, np.int64)
    entered = np.flatnonzero(values[size - 1 :] == low)
    place[entered] = entered + size - 1
    left = np.concatenate([[0], np.flatnonzero(low[1:] > low[:-1]) + 1])
    for i in range(0, len(left), 1 << 12):
        begin = left[i : i + (1 << 12)]
        inside = values[begin[:, None] + np.arange(size - 1, -1, -1)] == low[begin][:, None]
        place[begin] = begin + size - 1 - inside.argmax(1)
    return np.maximum.accumulate(place)


def _chosen(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of text: first start and end of the starts of each anchor, and the anchor's hash."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = window_hashes(data, ANCHOR)
    chosen = _last_smallest(hashes, SPAN)[:n]
    valid = np.zeros(n + 1, bool)
    sizes = np.diff(offsets)
    valid[:n] = np.repeat(sizes >= LENGTH, sizes)[:n]
    for back in range(1, LENGTH):  # the last starts of a row have no LENGTH bytes behind them
        ends = offsets[1:] - back
        valid[ends[(ends >= offsets[:-1]) & (ends < n)]] = False
    new = np.ones(n + 1, bool)
    new[1:n] = chosen[1:] != chosen[:-1]
    begins = offsets[:-1]
    new[begins[begins < n]] = True
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero((new | ~valid)[1:] & valid[:-1]) + 1
    anchor = mix(hashes[chosen[first]] ^ np.uint64(0x6A09E667F3BCC909))  # smallest hashes are all small: spread them
    return first, stop, anchor.view(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, repeated: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The anchors of rows of text: row, first and last start that belong to each, hash of anchor and of context.

    Start s belongs to the anchor of its own window [s, s + SPAN): starts of an anchor follow one another. With a
    bitmap of slots, only the anchors in these slots.
    """
    first, stop, anchor = _chosen(data, offsets)
    if repeated is not None:
        slot = anchor.view(np.uint64) >> np.uint64(64 - SLOT_BITS)
        passed = (repeated[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
        first, stop, anchor = (x[passed.astype(bool)] for x in (first, stop, anchor))
    if not len(first):
        return {k: np.empty(0, np.int64) for k in ("row", "start", "last", "anchor", "context")}
    strings = window_hashes(data, LENGTH)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(strings, dtype=np.uint64)])
    context = mix(sums[stop] - sums[first] + mix(strings[first] ^ (stop - first).astype(np.uint64)) + strings[stop - 1])
    row = np.searchsorted(offsets, first, "right") - 1
    begin = offsets[row]
    return {"row": row, "start": first - begin, "last": stop - 1 - begin, "anchor": anchor, "context": context.view(np.int64)}


def _cuts(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, first byte in it, bytes, offsets) of texts in pieces of about `size` bytes.

    A cut in a long text only cuts a context.
    """
    data, offsets = flat(texts)
    if len(data) <= 2 * size:
        yield 0, 0, data, offsets
        return
    for row in range(len(texts)):
        own = data[offsets[row] : offsets[row + 1]]
        for begin in range(0, max(len(own) - LENGTH + 1, 0), size):
            part = own[begin : begin + size + LENGTH - 1]
            yield row, begin, part, np.array([0, len(part)])


def _pieces(texts: pa.Array, size: int = SLICE, repeated: np.ndarray | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of texts, looked for in pieces of about `size` bytes."""
    for row, begin, data, offsets in _cuts(texts, size):
        found = anchors(data, offsets, repeated)
        yield found | {"row": found["row"] + row, "start": found["start"] + begin, "last": found["last"] + begin}


def anchor_rows(documents: DataFrame, repeated: np.ndarray | None = None) -> DataFrame:
    """at, version, start, last, anchor, context: for each anchor its starts [start, last] and two hashes.

    With a bitmap of slots, only the anchors in these slots.
    """
    held = None if repeated is None else documents.sparkSession.sparkContext.broadcast(repeated)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            for found in _pieces(batch.column("text"), repeated=None if held is None else held.value):
                if len(found["row"]):
                    keys = batch.select(["at", "version"]).take(pa.array(found["row"]))
                    names = ["start", "last", "anchor", "context"]
                    yield pa.RecordBatch.from_arrays([*keys.columns, *[pa.array(found[k]) for k in names]], ["at", "version", *names])

    return documents.select("at", "version", "text").mapInArrow(
        rows, "at bigint, version bigint, start bigint, last bigint, anchor bigint, context bigint"
    )


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slot of every anchor of the texts."""
    for batch in slices(batches, "text", SLICE):
        for _, _, data, offsets in _cuts(batch.column("text")):
            anchor = _chosen(data, offsets)[2].view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((anchor >> np.uint64(64 - SLOT_BITS)).astype(np.int32))], ["slot"])


def repeated_slots(documents: DataFrame) -> np.ndarray:
    """Bitmap of the slots (first SLOT_BITS bits of an anchor's hash) that more than one anchor falls into.

    Spark builds it in chunks of 2^16 slots; the driver gets these, 16 MB altogether whatever the input.
    """
    slots = documents.select("text").mapInArrow(_slots, "slot int")
    several = slots.groupBy("slot").count().filter("count > 1").select("slot", F.shiftright("slot", 16).alias("chunk"))

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        slot = table.column("slot").to_numpy()
        bits[slot & 0xFFFF] = 1
        return pa.table({"chunk": [int(slot[0]) >> 16], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(1 << (SLOT_BITS - 6), np.uint64)
    for row in several.groupBy("chunk").applyInArrow(pack, "chunk bigint, bits binary").toLocalIterator():
        out[row["chunk"] << 10 : (row["chunk"] + 1) << 10] = np.frombuffer(row["bits"], "<u8")
    return out


def longest_previous(keys: np.ndarray, order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Longest-previous-factor array of suffixes in sorted order.

    keys: the time of each suffix (its place in the input); order: suffixes sorted; shared[i]: common prefix of the
    sorted suffixes i - 1 and i. The factor of a suffix is shared with the previous or next one of smaller time.
    """
    n = len(order)
    best = np.zeros(n, np.int64)
    time = keys[order].tolist()
    common = shared.tolist()
    stack: list[tuple[int, int]] = []  # sorted place, prefix shared with the one below in the stack
    for i in range(n):
        least = common[i] if i else 0
        while stack and time[stack[-1][0]] > time[i]:
            place, below = stack.pop()
            best[place] = max(below, least)  # i is its next smaller, the stack's next its previous smaller
            least = min(least, below)
        stack.append((i, least if stack else 0))
    while stack:
        place, below = stack.pop()
        best[place] = below
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def sort_suffixes(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes from `starts` by their first `length` bytes, and prefixes shared by neighbours.

    The text must go on for `length` bytes from every start.
    """
    n = -(-length // 8)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    at_byte = np.ndarray((len(text) + 1,), ">u8", padded, strides=(1,)).astype(np.uint64)
    words = [at_byte[starts + 8 * i] for i in range(n)]
    if length % 8:
        words[-1] >>= np.uint64(8 * (8 - length % 8))
        words[-1] <<= np.uint64(8 * (8 - length % 8))
    order = np.lexsort(words[::-1])
    shared = np.zeros(len(starts), np.int64)
    open_ = np.ones(max(len(starts) - 1, 0), bool)
    for word in words:
        sorted_word = word[order]
        differs = sorted_word[1:] ^ sorted_word[:-1]
        zero = np.where(differs == 0, 8, 0)
        lead = differs != 0
        if lead.any():
            top = differs[lead]
            equal = np.zeros(len(top), np.int64)
            for k in range(7, 0, -1):
                equal += (top < (np.uint64(1) << np.uint64(8 * k))).astype(np.int64)
            zero[lead] = equal
        shared[1:] += np.where(open_, zero, 0)
        open_ &= differs == 0
    return order, np.minimum(shared, length)


def repeats(contexts: list[bytes], time: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the context and start in it of every string that starts earlier in another (or the same) context.

    time orders the contexts; size[i] is the number of starts of context i, each with LENGTH bytes behind it.
    """
    text = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum([len(c) for c in contexts])
    begins = np.concatenate([[0], ends[:-1]])
    number = np.repeat(np.arange(len(contexts)), size)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    starts = begins[number] + inside
    # only strings with a hash that comes again can repeat; the order of the suffixes decides on those
    hashes = window_hashes(text, LENGTH)[starts]
    by_hash = np.argsort(hashes)
    again = np.flatnonzero(hashes[by_hash][1:] == hashes[by_hash][:-1])
    open_ = np.zeros(len(starts), bool)
    open_[by_hash[again]] = open_[by_hash[again + 1]] = True
    number, inside, starts = number[open_], inside[open_], starts[open_]
    if not len(starts):
        return number, inside
    order, shared = sort_suffixes(text, starts)
    rank = np.empty(len(contexts), np.int64)
    rank[np.argsort(time, kind="stable")] = np.arange(len(contexts))
    # a suffix whose neighbours both share less than LENGTH has a shorter factor; the others stand in runs
    near = shared >= LENGTH
    inner = near.copy()
    inner[:-1] |= near[1:]
    suffix = order[inner]
    time_of = rank[number[suffix]] * (int(size.max()) + 1) + inside[suffix]
    best = longest_previous(time_of, np.arange(len(suffix)), np.where(near[inner], shared[inner], 0))
    found = suffix[best >= LENGTH]
    return number[found], inside[found]


def _contexts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted rows (at, version, list of start, last, anchor, big) with the bytes of their contexts."""
    held = wanted.groupBy("at", "version").agg(F.collect_list(F.struct("start", "last", "anchor", "big")).alias("w"))
    rows = documents.select("at", "version", "text").join(held, ["at", "version"]).dropDuplicates(["at", "version"])
    schema = "at bigint, version bigint, start bigint, anchor bigint, big boolean, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            out = []
            for at, version, text, w in zip(*[batch.column(c).to_pylist() for c in ("at", "version", "text", "w")], strict=True):
                data = text.encode()
                out += [(at, version, x["start"], x["anchor"], x["big"], data[x["start"] : x["last"] + LENGTH]) for x in w]
            names = ["at", "version", "start", "anchor", "big", "bytes"]
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(cut, schema)


MARKS = "at bigint, version bigint, start bigint, stop bigint"


def _marks(at, version, start) -> Iterator[pa.RecordBatch]:
    """Marked starts as byte ranges [start, stop); neighbouring starts become one range."""
    at, version, start = (np.asarray(x, np.int64) for x in (at, version, start))
    order = np.lexsort((start, version, at))
    at, version, start = at[order], version[order], start[order]
    if len(start):
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (version[1:] != version[:-1]) | (start[1:] > start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(start)]]) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[first]), pa.array(version[first]), pa.array(start[first]), pa.array(start[last] + LENGTH)],
            ["at", "version", "start", "stop"],
        )


def _sorted_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of contexts that come sorted by anchor; whole anchors are put together up to TASK_BYTES."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, at, version, start, data = zip(*rows, strict=True)
        moment = np.empty(len(rows), np.int64)
        moment[sorted(range(len(rows)), key=lambda i: (at[i], version[i], start[i]))] = np.arange(len(rows))
        number, inside = repeats(list(data), moment, np.array([len(d) - LENGTH + 1 for d in data]))
        if len(number):
            yield from _marks(np.array(at)[number], np.array(version)[number], np.array(start)[number] + inside)

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "at", "version", "start", "bytes")], strict=True):
            if size > TASK_BYTES and row[0] != held[-1][0]:
                yield from flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield from flush(held)


def _hashed_strings(contexts: DataFrame) -> DataFrame:
    """at, version, start, h1, h2: every 100-byte string of the contexts by two hashes."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", SLICE >> 2):
            data, offsets = flat(batch.column("bytes"))
            count = np.diff(offsets) - LENGTH + 1
            row = np.repeat(np.arange(len(count)), count)
            inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            place = offsets[row] + inside
            h1 = window_hashes(data, LENGTH)[place]
            h2 = window_hashes(data, LENGTH, 1)[place]
            keys = batch.select(["at", "version", "start"]).take(pa.array(row))
            start = pa.array(keys.column("start").to_numpy() + inside)
            yield pa.RecordBatch.from_arrays(
                [keys.column("at"), keys.column("version"), start, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                ["at", "version", "start", "h1", "h2"],
            )

    return contexts.mapInArrow(strings, "at bigint, version bigint, start bigint, h1 bigint, h2 bigint")


def removal_ranges(documents: DataFrame) -> DataFrame:
    """at, version, start, stop: byte ranges to remove (they may overlap) from texts (at, version, text)."""
    place = F.struct("at", "version", "start")
    rows = stored(anchor_rows(documents, repeated_slots(documents)), "anchors")
    firsts = rows.groupBy("anchor", "context").agg(F.min(F.struct("at", "version", "start", "last")).alias("first"), F.count("*").alias("many"))
    firsts = stored(firsts, "anchor-contexts")
    # occurrences of a context behind its first one are repeated as a whole
    seen = firsts.filter("many > 1").select("anchor", "context", "first")
    copies = rows.join(seen, ["anchor", "context"]).filter(place != F.expr("struct(first.at, first.version, first.start)"))
    copies = stored(copies.select("at", "version", "start", (F.col("last") + LENGTH).alias("stop")), "marks")
    # contexts of one anchor meet
    several = firsts.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    wanted = firsts.join(several, "anchor").select("first.*", "anchor", (F.col("contexts") > MOST_CONTEXTS).alias("big"))
    contexts = stored(_contexts(documents, wanted), "contexts")
    dealt = contexts.filter("NOT big").repartition("anchor").sortWithinPartitions("anchor")
    marked = dealt.mapInArrow(_sorted_marks, MARKS)
    strings = _hashed_strings(contexts.filter("big"))
    earliest = strings.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("many")).filter("many > 1")
    hashed = strings.join(earliest, ["h1", "h2"]).filter(place != F.col("first"))
    hashed = hashed.select("at", "version", "start", (F.col("start") + LENGTH).alias("stop"))
    return copies.unionByName(marked).unionByName(hashed)


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, at, version, text: at orders documents; version is 0, or a hash of the text for doc_ids that repeat."""
    docs = pick(documents, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    repeated = docs.groupBy("at").agg(F.count("*").alias("many")).filter("many > 1").select("at", F.lit(True).alias("again"))
    if repeated.isEmpty():
        return docs.withColumn("version", F.lit(0).cast("long"))
    return docs.join(repeated, "at", "left").withColumn("version", F.when(F.col("again"), F.xxhash64("text")).otherwise(0)).drop("again")


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans for every row of documents.

    spans: the maximal removed byte ranges of the UTF-8 text, sorted.
    """
    keyed = _keyed(documents)
    ranges = removal_ranges(keyed.filter(F.octet_length("text") >= LENGTH))
    spans = ranges.groupBy("at", "version").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    spans = stored(spans, "spans")
    held = keyed.select("at", "version", "text", "doc_id").join(spans, ["at", "version"])
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            out = []
            for doc_id, text, ranges in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges")], strict=True):
                data = text.encode()
                merged = merge([(r["start"], r["stop"]) for r in ranges])
                left, at = hashlib.sha256(), 0
                for start, stop in merged:
                    left.update(data[at:start])
                    at = stop
                left.update(data[at:])
                gone = sum(stop - start for start, stop in merged)
                out.append({"doc_id": doc_id, "n_bytes": len(data), "n_removed": gone, "n_spans": len(merged), "kept_sha256": left.hexdigest(),
                            "spans": [{"start": a, "stop": b} for a, b in merged]})
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    changed = held.select("doc_id", "text", "ranges").mapInArrow(cut, schema)
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    narrow = keyed.select("doc_id", "at", "version", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))
    rest = narrow.join(spans.select("at", "version"), ["at", "version"], "left_anti").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", none.alias("spans")
    )
    return changed.unionByName(rest)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges; those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out
