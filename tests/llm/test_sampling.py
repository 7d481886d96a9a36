"""Importance resampling, fill-in-middle and embedding near-dedup against plain versions, with edge cases in the rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from fleetpulse.llm import embedding_dup, fill_in_middle, importance
from test_documents import frame, prose

LOWER = brute.LOWER
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    line = prose(rng, 9)
    out = [(i, "\n".join([prose(rng, rng.randint(1, 30)), line, "Élan ß Ünï 数据 " + prose(rng, rng.randint(0, 40))])) for i in range(40)]
    out += [(100, None), (101, ""), (102, " \n\n\t"), (103, "one two"), (104, out[3][1]), (104, out[3][1]), (104, out[4][1]), (None, out[5][1]), (None, None)]
    out += [(105, "x" * 200 + " " + "y" * 65 + " " + "z" * 64 + "\n" + "é" * 70), (106, prose(rng, 9000)), (-7, "\n".join([line] * 60)), (107, "a\nb\nc")]
    return out + [(108, None), (108, None)]


TARGET = ["Élan vital, " + "one two three", None, "", "x y\nz a b c"]


def weigh(rows, target, longest, buckets):
    def found(text):
        words = WORD.findall((text or "").translate(LOWER))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    source = Counter(b for _, t in rows for b in found(t)[1])
    goal = Counter(b for t in target for b in found(t)[1])
    s, t = sum(source.values()), sum(goal.values())
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in source}
    out = []
    for doc_id, text in rows:
        n, own = found(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, n, len(own), weight, score))
    return out


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 500)])
def test_resampled_equals_the_plain_version(spark, rows, longest, buckets):
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = importance.resampled(frame(spark, rows), goal, longest=longest, buckets=buckets, percent=30).collect()
    want = weigh(rows, TARGET, longest, buckets)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((i, n, w, s) for i, _, n, w, s in want)
    able = sorted(((-s, i) for i, n, _, _, s in want if n >= 20 and i is not None))
    drawn = able[: len(able) * 30 // 100]
    ranked = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank is not None)
    assert ranked == [(k + 1, i, -s) for k, (s, i) in enumerate(drawn)]


def test_crc_registers_equal_zlib():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 2, 63, 64, 65, 300, 5])
    ends = np.cumsum(sizes)
    data = rng.integers(0, 256, int(ends[-1]), dtype=np.uint8)
    got = ~importance._crc_on(np.full(len(sizes), 0xFFFFFFFF, np.uint32), data, ends - sizes, ends)
    assert [int(v) for v in got] == [zlib.crc32(data[e - n : e].tobytes()) for n, e in zip(sizes, ends, strict=True)]


def test_resampling_of_empty_tables(spark, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resampled(frame(spark, []), none).count() == 0
    got = importance.resampled(frame(spark, rows[:3]), none).collect()
    assert Counter((r.doc_id, r.weight) for r in got) == Counter((i, w) for i, _, _, w, _ in weigh(rows[:3], [], 1, 10_000))


def test_a_line_in_most_documents_is_joined_by_broadcast(spark):
    rows = [(i, f"the common line of all\n{i} {i * 7}") for i in range(300)]
    goal = spark.createDataFrame([(0, "common line")], "item_id long, text string")
    got = importance.resampled(frame(spark, rows), goal).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((i, n, w, s) for i, _, n, w, s in weigh(rows, ["common line"], 1, 10_000))


def fim(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.fixture(scope="module")
def odd_texts(rows):
    rng = random.Random(5)
    tricky = [(200 + i, "".join(rng.choice("<PSM>é😀") for _ in range(rng.randint(1, 12)))) for i in range(120)]
    return rows + tricky + [(400, "see <M> there"), (401, "<"), (402, "<S"), (403, "a<P")]


@pytest.mark.parametrize("units", [1, 3, 1 << 14])
def test_fill_in_middle_round_trip(spark, odd_texts, units):
    got = fill_in_middle.transformed(frame(spark, odd_texts), units=units).collect()
    want = [(i, *fim(i, t), t or "") for i, t in odd_texts]
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_fill_in_middle_report(spark, odd_texts):
    got = fill_in_middle.report(frame(spark, odd_texts)).collect()
    want = [(i, n, form, a, b, brute.sha(out), brute.sha(t or "")) for i, t in odd_texts for n, form, a, b, out in [fim(i, t)]]
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert fill_in_middle.report(frame(spark, [])).count() == 0


def test_a_long_text_is_streamed_in_pieces(spark):
    text = "".join(random.Random(2).choice("abc é\n") for _ in range(600_000))
    rows = [(i, text) for i in range(3)]
    pieces = fill_in_middle.pieces(fill_in_middle.planned(frame(spark, rows), 1, 10, 20))
    assert max(len(r.piece) for r in pieces.select("piece").collect()) <= fill_in_middle.UNITS
    got = fill_in_middle.report(frame(spark, rows)).collect()
    assert all(r.restored_sha256 == brute.sha(text) for r in got) and {r.output_sha256 for r in got} == {brute.sha(fim(i, t)[4]) for i, t in rows}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    out = []
    for label in range(3):
        centres = rng.standard_normal((12, 16))
        for c in range(12):
            out += [(label, centres[c] + s * rng.standard_normal(16)) for s in rng.choice([0.02, 0.05, 0.11], 9)]
    out += [(0, out[0][1])] * 5 + [(1, out[0][1]), (None, out[0][1]), (0, out[0][1] * 3.5), (0, np.zeros(16)), (0, np.full(16, np.nan))]
    out += [(0, np.r_[out[0][1][:15], np.inf]), (0, None), (0, np.r_[out[0][1], 0.0]), (0, np.empty(0)), (2, out[-20][1] * 1e-300), (2, out[-20][1] * 1e300)]
    made = [(i, None if v is None else [float(x) for x in v], label) for i, (label, v) in enumerate(out)]
    made += [(None, made[3][1], made[3][2]), (7, made[20][1], made[20][2]), (900, [None, *made[0][1][1:]], 0)]
    random.Random(1).shuffle(made)
    return made


def links_of(rows):
    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = []
    for _, v, label in rows:
        v = np.array(v) / np.abs(v).max() if label is not None and good(v) else None
        units.append(None if v is None else v / np.linalg.norm(v))
    n, part = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = units[a], units[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y >= 0.98:
                n[a] += 1
                n[b] += 1
                part = [part[a] if p == part[b] else p for p in part]
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if part[k] == part[i] and rows[k][0] is not None]
        out.append((vec_id, n[i], min(ids, default=None), vec_id == min(ids, default=None)))
    return Counter(out)


def vector_frame(spark, rows):
    """Embeddings with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, label, "x", 3, "s") for i, v, label in rows], "vec_id long, embedding array<double>, label int, k string, size int, vector string").repartition(3)


def test_pairs_of_small_and_large_groups():
    rng = np.random.default_rng(6)
    sizes = [1, 2, 64, 65, 3, 200, 1]
    vectors = embedding_dup.unit(rng.standard_normal((sum(sizes), 4)))
    group = np.repeat(np.arange(len(sizes)), sizes)
    got = Counter((int(a), int(b)) for x, y in embedding_dup.linked_pairs(vectors, group, 0.9) for a, b in zip(x, y, strict=True))
    close = vectors @ vectors.T >= 0.9
    assert got == Counter((a, b) for a in range(len(group)) for b in range(a + 1, len(group)) if group[a] == group[b] and close[a, b])


@pytest.mark.parametrize("block", [1024, 4])
def test_embedding_links(spark, vectors, block):
    got = embedding_dup.near_duplicates(vector_frame(spark, vectors), miss=1e-7, block=block).collect()
    assert Counter(tuple(r) for r in got) == links_of(vectors)


def test_embeddings_of_an_empty_table(spark):
    assert embedding_dup.near_duplicates(vector_frame(spark, [])).count() == 0
    assert [tuple(r) for r in embedding_dup.near_duplicates(vector_frame(spark, [(4, None, 1)])).collect()] == [(4, 0, 4, True)]


def test_recall_at_the_least_cosine(spark):
    """Pairs at a cosine barely above the least one, each alone in its direction: 0.99 or more of them are found."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        u = rng.standard_normal(64)
        u /= np.linalg.norm(u)
        v = rng.standard_normal(64)
        v -= (v @ u) * u
        v /= np.linalg.norm(v)
        rows += [(2 * i, u.tolist(), 0), (2 * i + 1, (0.98002 * u + math.sqrt(1 - 0.98002**2) * v).tolist(), 0)]
    got = embedding_dup.near_duplicates(vector_frame(spark, rows)).collect()
    assert sum(r.n_links == 1 and r.component_id == r.vec_id // 2 * 2 for r in got) >= 0.99 * 800


def test_tables_grow_with_the_logarithm_of_the_largest_label():
    small, large = embedding_dup.tables_for(1_000), embedding_dup.tables_for(10**9)
    assert small[0] < large[0] <= small[0] + 20 and large[1] < 6 * small[1]
    agree = 1 - math.acos(0.98) / math.pi
    for bits, tables in (small, large, embedding_dup.tables_for(1)):
        assert (1 - agree**bits) ** tables <= 1e-3
