"""Operators on documents against plain versions, with edge cases in the rows."""

from __future__ import annotations

import random
from collections import Counter

import brute
import pytest
from fleetpulse.llm import decontaminate, fingerprint, line_dedup, near_dup, suffix_dedup
from pyspark import Broadcast
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score double, at long, k1 string, found string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 0.5, 3, "x", "y") for i, t in rows], SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


_rng = random.Random(7)
WORDS = ["".join(_rng.choice("aeioulnrst") for _ in range(_rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(12)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i % 3]) for i in range(6)]  # copies
    for i in range(12):  # near copies of one text, some linked through others only
        words = base[0].split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = "edit"
        out.append((200 + i, " ".join(words)))
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "one two"), (304, "One  two"), (305, "a"), (None, base[5]), (306, "é" * 150), (307, "a" * 400)]
    out += [(308, base[1][:130] + "\n" + base[1][20:150] + "\n" + base[2]), (309, prose(rng, 4000)), (-5, base[4].upper())]
    return out


def test_suffix_dedup(spark, rows, monkeypatch):
    want = brute.repeated_bytes(rows)
    for most in (5000, 1):  # sorted contexts; contexts by hash
        monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(frame(spark, rows)).collect()}
        assert got == want


def test_suffix_dedup_cuts_long_texts(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    from fleetpulse.llm.common import flat  # noqa: F401
    import pyarrow as pa

    whole = suffix_dedup.anchors(*flat(pa.array([rows[-2][1]])))
    parts = list(suffix_dedup._pieces(pa.array([rows[-2][1]]), 500))
    starts = lambda found: {s for f in found for a, b in zip(f["start"], f["last"]) for s in range(a, b + 1)}
    assert starts([whole]) == starts(parts) and len(parts) > 5


def test_repeated_rows_of_suffix_dedup(spark):
    text = prose(random.Random(11), 50)
    got = suffix_dedup.dedup(frame(spark, [(1, text), (1, text), (2, text), (2, "short"), (2, text + "!")])).collect()
    assert sorted((r.doc_id, r.n_removed > 0) for r in got) == [(1, False), (1, False), (2, False), (2, True), (2, True)]


def test_near_dup(spark, rows, monkeypatch):
    want = Counter(brute.near_components(rows))
    for block in (near_dup.BLOCK_ROWS, 3):  # whole groups; groups cut into blocks
        monkeypatch.setattr(near_dup, "BLOCK_ROWS", block)
        monkeypatch.setitem(near_dup.links.__globals__, "BLOCK_ROWS", block)
        got = near_dup.near_duplicates(frame(spark, rows)).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_near_dup_links_blocks(spark, rows):
    docs = frame(spark, rows)
    marked = near_dup.materialize(near_dup.set_classes(near_dup.sketched(docs).filter("n > 0")), "classes")
    groups = near_dup.candidate_groups(marked)
    whole, parts = (near_dup.components(near_dup.links(docs, marked, groups, n)).collect() for n in (1000, 2))
    assert sorted(whole) == sorted(parts)


def test_near_dup_compares_the_rest_of_a_large_group_with_all_its_blocks(spark):
    """Chains of sets, each linked with its neighbours only, some of them in one group with a dense part."""
    rng = random.Random(9)
    base, docs = prose(rng, 90).split(), []
    for i in range(60):  # a chain: 4 words change from one text to the next
        docs.append((i, " ".join(base)))
        base[(i * 7) % 90] = f"new{i}"
    dense = prose(rng, 80).split()
    for i in range(60, 100):
        words = list(dense)
        words[rng.randrange(80)] = f"edit{i}"
        docs.append((i, " ".join(words)))
    rng.shuffle(docs)
    docs = frame(spark, docs)
    marked = near_dup.materialize(near_dup.set_classes(near_dup.sketched(docs).filter("n > 0")), "classes")
    groups = near_dup.materialize(near_dup.candidate_groups(marked), "groups")
    one = near_dup.materialize(groups.withColumn("label", F.lit(1).cast("long")), "groups")  # all sets in one group
    want = sorted(near_dup.components(near_dup.links(docs, marked, groups, 1000)).collect())
    assert len({r.label for r in want}) > 1
    for some, n in ((groups, 7), (one, 7), (one, 3)):
        assert sorted(near_dup.components(near_dup.links(docs, marked, some, n)).collect()) == want


def test_near_dup_reads_a_text_once_for_each_row_without_id(spark):
    rng = random.Random(4)
    rows = [(None, prose(rng, 30)) for _ in range(40)] + [(None, None)] * 3
    marked = near_dup.materialize(near_dup.set_classes(near_dup.sketched(frame(spark, rows)).filter("n > 0")), "classes")
    assert near_dup._sets(frame(spark, rows), marked).count() == 40


def test_sets_with_one_first_key_stay_apart(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "one two three four five six")]
    same = near_dup.sketched(frame(spark, rows)).withColumn("k1", F.lit(5).cast("long"))
    classes = near_dup.set_classes(same).collect()
    assert len(classes) == 2 and len({r.node for r in classes}) == 2 and sorted(r.doc_id for r in classes) == [1, 3]


def test_one_of_each(spark, rows):
    repeated = [*rows, rows[0], rows[0], (301, "")]
    got = near_dup.one_of_each(frame(spark, repeated))
    assert got.columns == frame(spark, rows[:1]).columns
    kept = {d for d, _, _, k in brute.near_components(rows) if k}
    assert Counter(r.doc_id for r in got.collect()) == Counter({d: 1 for d in kept})


def test_odd_sketch_estimates(rows):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1840], rng.integers(0, 1 << 63, 160, dtype=np.uint64)])  # similarity 0.85
    sketches = near_dup.odd_sketches(near_dup.signatures(np.concatenate([a, b]), np.array([2000, 2000])))
    far = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
    assert 20 < far < near_dup.FAR_BITS
    assert near_dup.shingle_sets(pa.array([None, "", "a b"]))[1].tolist() == [0, 0, 1]


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = [prose(rng, n) for n in (5, 6, 7, 8, 9, 12, 20, 40) for _ in range(4)]
    docs = []
    for i in range(30):
        own = []
        for line in rng.sample(lines, 6):
            words = line.split()
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice(([], ["new"], [words[k], "more"]))
            own.append((" ", "  ", "\t")[i % 3].join(words))
        docs.append((i, "\n".join([*own, "short line", ""])))
    docs += [(50, None), (51, ""), (52, "\n\n"), (None, docs[0][1]), (53, "a a a a a a\na a a a a\na a a a a a a"), (54, prose(rng, 3000)), (55, "é é é é é é\né é é é é b\nb é é é é é")]
    want = brute.kept_lines(docs)
    got = line_dedup.report(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.kept_sha256 for r in got} == {d: brute.sha(t or "") for d, t in want.items()}
    full = line_dedup.without_repeated_lines(frame(spark, [*docs, docs[3]]))
    assert full.columns == frame(spark, docs[:1]).columns
    left = {r.doc_id: (r.text, r.n_chars) for r in full.collect()}
    assert left == {d: (t, len(t or "")) for d, t in want.items() if t == dict(docs)[d] or t.strip()}
    assert full.filter("doc_id = 3").count() == 2  # a repeated row is the same document


def test_line_dedup_tells_swapped_words_apart(spark):
    """Lines with the same pairs of neighbouring words in another order don't stand for one another."""
    lines = ["| yes | no | z", "| yes | no | a", "| no | yes | b", "| no | yes | c", "the a the b the x", "the b the a the x", "the b the a the y"]
    docs = list(enumerate(lines))
    want = brute.kept_lines(docs)
    assert [i for i, t in want.items() if not t] == [1, 3, 6]
    got = line_dedup.report(frame(spark, docs)).collect()
    assert {r.doc_id: r.kept_sha256 for r in got} == {d: brute.sha(t) for d, t in want.items()}
    words = frame(spark, [(0, "0 1 2 3 4 5 6")]).selectExpr("struct(doc_id) AS place", "split(text, ' ') AS words")
    for n in (5, 6, 7):
        for front, back in ((True, True), (True, False), (False, True)):
            line = words.selectExpr("place", f"slice(words, 1, {n}) AS words", f"{front} AS front", f"{back} AS back")
            keys = {r.gone: r.key for r in line_dedup.neighbourhoods(line).collect()}
            assert set(keys) == {-1, *range(0 if back else (n - 1) // 2, n if front else n - (n - 1) // 2)}
            for gone in set(keys) - {-1}:
                left = line.selectExpr("place", f"filter(words, w -> w <> '{gone}') AS words", "front", "back")
                assert line_dedup.neighbourhoods(left).filter("gone < 0").first().key == keys[gone]


def test_fingerprints(spark, rows):
    docs = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, (doc_id, text) in enumerate(docs):
        own, after = text or "", docs[(i + 1) % len(docs)]
        quarter = len(own) // 4
        edited = own[: len(own) - quarter] + (after[1] or "")[:quarter]
        row = got[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(own), brute.sha(edited))
        assert prints.setdefault(own, row.fingerprint) == row.fingerprint
        a, b, c = (brute.shingle_set(t) for t in (own, edited, after[1]))
        for estimate, x, y in ((row.near_edited, a, b), (row.near_next, a, c)):
            true = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(estimate - true) < (0.2 if len(x | y) > fingerprint.SIZE else 1e-6)
        if len(a) < fingerprint.SIZE:
            assert row.n_shingles == len(a)
        else:
            assert abs(row.n_shingles / len(a) - 1) < 0.4
    assert len(set(prints.values())) == len({brute.shingle_set(t) for t in prints})


def test_fingerprints_merge(spark):
    from pyspark.sql import functions as F

    parts = spark.createDataFrame([(1, list(range(0, 900, 3))), (1, list(range(0, 900, 2))), (2, []), (2, [5, 1])], "k int, s array<int>")
    got = {r.k: r.s for r in fingerprint.merged(parts, ["k"], "s").collect()}
    assert got[1] == sorted({*range(0, 900, 3), *range(0, 900, 2)})[: fingerprint.SIZE] and got[2] == [1, 5]
    both = parts.groupBy("k").agg(F.min("s").alias("a"), F.max("s").alias("b")).select("k", fingerprint.merge(F.col("a"), F.col("b")).alias("s"))
    assert {r.k: r.s for r in both.collect()}[2] == [1, 5]


def test_decontamination(spark, rows):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 13, 12, 3, 1, 14))] + [(3, prose(rng, 20)), (7, None), (8, ""), (9, " .,-"), (None, prose(rng, 15)), (10, rows[2][1])]
    text = dict(items)
    docs = [*rows, (400, text[0]), (401, prose(rng, 500) + " " + text[1].upper().replace(" ", ", ")), (402, text[2] + " " + text[2]), (403, f"x {text[4]} y"),
            (404, text[5] + "\n" + text[5][5:]), (405, items[-2][1]), (400, text[0])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    want = Counter(brute.hits(docs, items))
    for block in (1 << 20, 100):  # the benchmark at once and in many blocks
        got = decontaminate.report(frame(spark, docs), bench, block).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    left = decontaminate.without_contaminated(frame(spark, docs), bench)
    assert left.columns == frame(spark, docs[:1]).columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, *_, bad in brute.hits(docs, items) if not bad)
    none = decontaminate.report(frame(spark, docs), bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)


def test_decontamination_blocks_of_a_skewed_benchmark(spark, monkeypatch):
    rng = random.Random(11)
    often = prose(rng, 30)
    items = [(i, often) for i in range(40)] + [(100 + i, prose(rng, 20)) for i in range(60)]
    docs = [(1, often), (2, f"x {items[45][1]} y {items[70][1]}"), (3, prose(rng, 50))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sizes, held, prepare = [], [], decontaminate.prepare
    monkeypatch.setattr(decontaminate, "prepare", lambda texts, names: (sizes.append(sum(map(len, texts))), prepare(texts, names))[1])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value, f=type(spark.sparkContext).broadcast: (held.append(f(self, value)), held[-1])[1])
    gone = []
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, f=Broadcast.destroy, **b: (gone.append(self), f(self, *a, **b))[1])
    got = decontaminate.report(frame(spark, docs), bench, 3000).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter(brute.hits(docs, items))
    assert len(sizes) > 1 and max(sizes) <= 3000 + max(len(t) for _, t in items)
    assert gone == held[:-1]


def test_spans_are_byte_ranges(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    row = decontaminate.report(frame(spark, [(1, "Ünï, ALPHA  beta\ngamma! rest")]), items).first()
    span = row.spans[0]
    assert "Ünï, ALPHA  beta\ngamma! rest".encode()[span.start : span.end] == b"ALPHA  beta\ngamma"


@pytest.mark.parametrize("run", [suffix_dedup.dedup, near_dup.near_duplicates, line_dedup.report, fingerprint.edited_fingerprints, near_dup.one_of_each, line_dedup.without_repeated_lines])
def test_empty_tables(spark, run):
    empty = frame(spark, [(1, "x")]).limit(0)
    assert run(empty).count() == 0
