"""SentencePiece encoding and decoding with a batched Viterbi pass.

Text is cut into words where no piece can reach across (at character pairs that no piece contains; in usual models
before each space), and a batch's distinct words of equal length advance together: at each place the hashes of all
substrings that end there probe the sorted hashes of the pieces, and a vectorised maximum stores, for each word, the
piece that ends its best path there. Walking back from the end gives the pieces.

For a unigram model the maximum is over the sum of piece scores. For a BPE model the paths are those whose
neighbouring pieces stay apart when merges run in order of score: a prefix of a word has one such path, so the pass
finds the segmentation of the merges themselves, and ids equal those of the public library. Characters without
a piece become byte pieces, or the unknown piece if a model has none.

A model is read from its file by a small reader of the published format. Only models without text normalisation
(identity) are taken; a space becomes the mark U+2581, and one is put before a text that is not empty.

Edge cases: a null text has null ids and decodes to null, an empty one has none and decodes to the empty text. The mark
itself is a space to the format, so a text that has it does not come back unchanged; decoding gives spaces there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm.common import mix, slices

MARK = 0x2581
SLICE = 2 << 20
MOST_WORDS = 80_000  # of the words that a generation of a worker's memory takes before a new one begins
MOST_CHARS = 1 << 16  # of the words that advance together; a place of a character takes some hundred bytes
PAIR_BITS = 20
UNIGRAM, BPE = 1, 2  # model types of the format
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # piece types of the format
NEVER = np.iinfo(np.int64).max
BUCKET_BITS = 17

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol-buffer message; 4-byte values as bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        elif key & 7 == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    model_type: int
    byte_fallback: bool
    dummy_prefix: bool
    keep_spaces: bool

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, kinds = [], [], []
        model_type, fallback, prefix, squeeze, charsmap = UNIGRAM, False, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
                model_type, fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif field == 3:
                normalizer = dict(_fields(value))
                charsmap, prefix, squeeze = normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        if charsmap or model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with the identity normalisation are supported")
        return cls(pieces, np.array(scores, float), np.array(kinds), model_type, fallback, prefix, not squeeze)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Encoder:
    """Tables of a model for the Viterbi pass."""

    def __init__(self, model: Model):
        self.model = model
        usable = np.flatnonzero(np.isin(model.kinds, (NORMAL, USER, UNUSED)))
        codes = [_codes(model.pieces[i]) for i in usable]
        self.longest = max(map(len, codes), default=1)
        hashes = np.array([_hash(c) for c in codes], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], usable[order]
        self.buckets = np.searchsorted(self.keys >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64))
        pairs = [(int(a) << 32) | int(b) for c in codes for a, b in zip(c[:-1], c[1:], strict=True)]
        self.pairs = np.unique(np.array(pairs, np.int64))
        self.unknown = int(np.flatnonzero(model.kinds == UNKNOWN)[0]) if (model.kinds == UNKNOWN).any() else 0
        self.bytes = np.full(256, self.unknown)
        for i in np.flatnonzero(model.kinds == BYTE):
            self.bytes[int(model.pieces[i][3:5], 16)] = i
        self.floor = float(model.scores[usable].min(initial=0.0)) - 10.0  # score of a character without a piece
        self.lengths = np.array([len(_codes(p)) for p in model.pieces])
        if model.model_type == BPE:
            self._split()
        self.spelling = [self._spelling(i) for i in range(len(model.pieces))]
        self.pair_keys = np.full(1 << PAIR_BITS, -2)
        self.pair_ok = np.zeros(1 << PAIR_BITS, bool)
        self.numbers = list(range(len(model.pieces)))  # one object for each id, shared by all words that have it
        self.memory: dict[str, tuple[int, ...]] = {}  # ids of words met before, by any task of this worker
        self.older: dict[str, tuple[int, ...]] = {}

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 without one: the hash's first bits lead to its place among the sorted keys."""
        out = np.full(len(hashes), -1)
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        place, end = self.buckets[bucket], self.buckets[bucket + 1]
        left = np.flatnonzero(place < end)
        place, end, wanted = place[left], end[left], hashes[left]
        while len(left):
            hit = self.keys[place] == wanted
            out[left[hit]] = self.ids[place[hit]]
            place = place + 1
            more = ~hit & (place < end)
            left, place, end, wanted = left[more], place[more], end[more], wanted[more]
        return out

    def _split(self) -> None:
        """How merges build each piece: its two parts, and the order of merges (rank; a smaller one is earlier).

        A piece that its own characters do not merge to is no result of a merge; it can't end a path.
        """
        m = self.model
        n = len(m.pieces)
        where = {p: i for i, p in enumerate(m.pieces) if m.kinds[i] in (NORMAL, USER, UNUSED)}
        _, rank = np.unique(-m.scores, return_inverse=True)
        self.rank = rank.astype(np.int64)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.reached = np.zeros(n, bool)
        for piece, i in where.items():
            parts = list(piece)
            cut = len(parts[0]) if parts else 0
            while len(parts) > 1:
                options = [(self.rank[where[a + b]], k) for k, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in where]
                if not options:
                    break
                _, k = min(options)
                cut = len(parts[0]) if len(parts) == 2 else cut
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.reached[i] = len(parts) == 1
            if self.reached[i] and len(piece) > 1:
                self.left[i], self.right[i] = where.get(piece[:cut], -1), where.get(piece[cut:], -1)
        joined = [(a, b, i) for p, i in where.items() for a, b in _parts(p, where)]
        keys = np.array([a * n + b for a, b, _ in joined], np.int64)
        order = np.argsort(keys)
        self.join_keys, self.join_rank = keys[order], self.rank[np.array([i for *_, i in joined], np.int64)[order]] if joined else keys

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that two neighbouring pieces merge to; NEVER without one."""
        if not len(self.join_keys):
            return np.full(len(a), NEVER)
        key = a * len(self.model.pieces) + b
        at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        return np.where((self.join_keys[at] == key) & (a >= 0) & (b >= 0), self.join_rank[at], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where merges over the text of both pieces end with exactly these two; -1 stands for no piece.

        The merges inside a and inside b run side by side. Undoing them, latest first, shows which symbols meet at
        the border at each time: the last symbol of a's part and the first of b's. If such two would have merged
        before the earlier of their own next merges, the border does not hold. At equal ranks the leftmost merge
        is first, so a's own merge wins over the border's, and the border's over b's.
        """
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[live], b[live]
        next_x, next_y = np.full(len(live), NEVER), np.full(len(live), NEVER)
        while len(live):
            rank = self._merged(x, y)
            bad = (rank < next_x) & ((rank < next_y) | ((rank == next_y) & (rank != NEVER)))
            ok[live[bad]] = False
            # the later one of the two last merges is undone
            made_x = np.where(self.left[x] >= 0, self.rank[x], -1)
            made_y = np.where(self.left[y] >= 0, self.rank[y], -1)
            more = ~bad & ((made_x >= 0) | (made_y >= 0))
            live, x, y, next_x, next_y, made_x, made_y = (v[more] for v in (live, x, y, next_x, next_y, made_x, made_y))
            undo_y = made_y >= made_x  # of equal ranks the left merge ran first
            next_x, next_y = np.where(undo_y, next_x, made_x), np.where(undo_y, made_y, next_y)
            x, y = np.where(undo_y, x, self.right[x]), np.where(undo_y, self.left[y], y)
        return ok

    def known_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """apart(), with the answers of pairs met before in a table of 2^PAIR_BITS places; a new pair takes its place over."""
        key = a * len(self.model.pieces) + b
        place = (mix(key.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_ok[place]
        new = np.flatnonzero(self.pair_keys[place] != key)
        if len(new):
            out[new] = self.apart(a[new], b[new])
            self.pair_keys[place[new]] = -2  # of new pairs with one place either may stand there, but key and answer go together
            order = new[np.unique(place[new], return_index=True)[1]]
            self.pair_keys[place[order]], self.pair_ok[place[order]] = key[order], out[order]
        return out

    def _words(self, codes: np.ndarray) -> list[list[int]]:
        """Pieces of equally long words (rows of codes), by dynamic programming from left to right."""
        n, length = codes.shape
        unigram = self.model.model_type == UNIGRAM
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last = np.full((length + 1, n), -1)  # piece that ends the best path at a place
        back = np.zeros((length + 1, n), np.int64)  # and its length in characters
        hashes = np.zeros((self.longest, n), np.uint64)  # of the substrings that end here, by start
        for end in range(1, length + 1):
            code = codes[:, end - 1].astype(np.uint64)
            sizes = min(end, self.longest)
            # substrings one shorter, from the same starts, go on by one character
            hashes[1:sizes] = _step(hashes[: sizes - 1], code)
            hashes[0] = _step(np.zeros(n, np.uint64), code)
            found = self.probe(hashes[:sizes].ravel()).reshape(sizes, n)
            hit = found >= 0
            before = best[end - sizes : end][::-1]  # row k: of the place k + 1 characters back
            if unigram:
                value = np.where(hit, before + self.model.scores[found], -np.inf)
                value[0] = np.where(hit[0], value[0], before[0] + self.floor)
            else:
                value = np.full((sizes, n), -np.inf)
                size, word = np.nonzero(hit & (before > -np.inf) & self.reached[found])
                fits = self.known_apart(last[end - 1 - size, word], found[size, word])
                value[size[fits], word[fits]] = 0  # at most one path holds
                value[0] = np.where(hit[0], value[0], before[0])
            word = np.arange(n)
            chosen = value.argmax(axis=0)
            best[end] = value[chosen, word]
            last[end] = np.where(best[end] > -np.inf, found[chosen, word], -1)
            back[end] = chosen + 1
        out: list[list[int]] = [[] for _ in range(n)]
        at = np.full(n, length)
        rows = np.arange(n)
        while len(rows):
            for row, piece, place in zip(rows.tolist(), last[at, rows].tolist(), (at - 1).tolist(), strict=True):
                out[row].append(piece if piece >= 0 else -2 - int(codes[row, place]))
            at = at - back[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        return [x[::-1] for x in out]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Pieces of words; words of one length together, in parts of MOST_CHARS characters or a single word."""
        lengths = np.array([len(w) for w in words])
        out: list[tuple[int, ...]] = [()] * len(words)
        for length in np.unique(lengths):
            group = np.flatnonzero(lengths == length)
            for part in np.array_split(group, -(-len(group) * int(length) // MOST_CHARS) or 1):
                codes = np.stack([_codes(words[k]) for k in part])
                for i, pieces in zip(part.tolist(), self._words(codes), strict=True):
                    out[i] = tuple(self.numbers[p] for piece in pieces for p in self._spelled(piece))
        return out

    def _spelled(self, piece: int) -> list[int]:
        """A piece itself; for a character (below -1) without a piece, its bytes or the unknown piece."""
        if piece >= 0:
            return [piece]
        if not self.model.byte_fallback:
            return [self.unknown]
        return [int(self.bytes[b]) for b in chr(-2 - piece).encode()]

    def prepared(self, text: str) -> str:
        if not self.model.keep_spaces:
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", chr(MARK))

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of each text. Words met before are remembered in two generations; those in use move to the younger one."""
        cut = [None if t is None else self._cut(self.prepared(t)) for t in texts]
        if len(self.memory) > MOST_WORDS:
            self.memory, self.older = {}, self.memory
        memory, older = self.memory, self.older
        unknown = set(chain.from_iterable(words for words in cut if words)).difference(memory)
        known = unknown.intersection(older)
        memory.update(zip(known, map(older.__getitem__, known), strict=True))
        new = list(unknown.difference(known))
        memory.update(zip(new, self.encode_words(new), strict=True))
        return [None if words is None else list(chain.from_iterable(map(memory.__getitem__, words))) for words in cut]

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        codes = _codes(text).astype(np.int64)
        pair = (codes[:-1] << 32) | codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        apart = self.pairs[at] != pair if len(self.pairs) else np.ones(len(pair), bool)
        cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _spelling(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " \u2047 ".encode()
        return b"" if kind == CONTROL else piece.replace(chr(MARK), " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; byte pieces that are no UTF-8 give replacement characters."""
        text = b"".join([self.spelling[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _parts(piece: str, where: dict[str, int]) -> Iterator[tuple[int, int]]:
    for k in range(1, len(piece)):
        a, b = where.get(piece[:k]), where.get(piece[k:])
        if a is not None and b is not None:
            yield a, b


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(h * _FACTOR + code + np.uint64(1))


def _hash(codes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in codes:
        h = _step(h, np.array([c], np.uint64))
    return h[0]


def load(spark: SparkSession, path: str) -> Model:
    """A model file (of a few MB at most): a path with a scheme is read by Spark, another one by the driver."""
    if "://" in path:
        return Model.parse(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    return Model.parse(Path(path).read_bytes())


def encode(documents: DataFrame, model: Model, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """documents with the ids of a text column; with `decoded`, also what decoding these ids gives. No shuffle."""
    held = documents.sparkSession.sparkContext.broadcast(Encoder(model))
    added = [ids, *([decoded] if decoded else [])]
    kept = [f for f in documents.schema.fields if f.name not in added]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held.value
        for batch in slices(batches, text, SLICE):
            found = encoder.encode(batch.column(text).to_pylist())
            columns = [*[batch.column(f.name) for f in kept], pa.array(found, pa.list_(pa.int32()))]
            if decoded:
                columns.append(pa.array([None if x is None else encoder.decode(x) for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return documents.mapInArrow(run, schema)


def report(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, same (the decoded text is the text) for every row of documents."""
    rows = encode(documents.select(documents["doc_id"], documents["text"]), model, decoded="decoded")
    return rows.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"), F.col("text").eqNullSafe(F.col("decoded")).alias("same"),
    )
