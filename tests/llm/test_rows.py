"""Language ID, URL filter, WARC archives, chat formatting, SentencePiece: against plain versions and public libraries."""

from __future__ import annotations

import json
import random
from collections import Counter
from math import log2
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from fleetpulse.llm import chat, language, queries, sentence_piece, url_filter, warc
from fleetpulse.llm.common import flat
from fleetpulse.llm.order import next_keys

SMALL = "/root/testdata/sf0.001"


def test_next_keys(spark):
    ids = random.Random(1).sample(range(-(1 << 40), 1 << 40), 300)
    table = spark.createDataFrame([(i,) for i in [*ids, ids[0], None]], "k long").repartition(5)
    got = {r.k: r.next for r in next_keys(table, "k").collect()}
    ids.sort()
    assert got == dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    assert next_keys(table.limit(0), "k").count() == 0


# --- language ID


def coded(text: bytes, training: list[bytes]) -> float:
    """Code length by a dictionary of contexts, symbol by symbol."""
    counts: dict[bytes, Counter] = {}
    pad = b"\0\0\0"
    for t in training:
        t = pad + t
        for i in range(3, len(t)):
            for k in range(4):
                counts.setdefault(t[i - k : i], Counter())[t[i]] += 1
    total, text = 0.0, pad + text
    for i in range(3, len(text)):
        gone: set[int] = set()
        for k in (3, 2, 1, 0):
            seen = counts.get(text[i - k : i], Counter())
            left = {s: n for s, n in seen.items() if s not in gone}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if text[i] in left:
                total -= log2(left[text[i]] / whole)
                break
            total -= log2(len(left) / whole)
            gone |= set(seen)
        else:
            total += log2(256 - len(counts[b""]))
    return total


def test_code_lengths_are_exact():
    training = {"a": ["the cat sat on the mat", "that hat"], "b": ["el gato está aquí", "la rata", ""]}
    counted = {}
    for name, texts in training.items():
        counted[name] = tuple(np.unique(language.grams(*flat(pa.array(texts))), return_counts=True))
    model = language.Model.build({k: (a, n.astype(float)) for k, (a, n) in counted.items()})
    texts = ["the rat", "", "q", "aquí, the cat", "\0\0x", "la la la", None, "ttttt"]
    got = model.code_lengths(*flat(pa.array(texts)))
    for i, name in enumerate(model.languages):
        want = [coded((t or "").encode(), [x.encode() for x in training[name]]) for t in texts]
        assert np.allclose(got[i], want)


def test_language_accuracy_and_edges(spark):
    docs = queries.table(spark, SMALL, "documents")
    rows = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows[rows.held_out].lang == rows[rows.held_out].lang_pred).mean() > 0.97
    edges = [(None, None, "en"), (900, "", "en"), (901, "12 34!", None), (902, "the and of that", None), (903, "the and of that", "xx"), (None, "the and", "fr")]
    extra = spark.createDataFrame([(i, t, n, "s", 0) for i, t, n in edges], docs.schema)
    more = docs.unionByName(extra).withColumns({"found": docs["text"], "score": docs["doc_id"]})
    got = {(r.doc_id, r.lang_pred): r.score for r in language.report(more).filter("doc_id >= 900 OR doc_id IS NULL").collect()}
    assert {k for k in got if k[1] == "und"} == {(None, "und"), (900, "und"), (901, "und")}
    assert got[900, "und"] == 0 and 0 < got[902, next(n for i, n in got if i == 902)] <= 1
    assert language.known_language(more).columns == more.columns
    nothing = language.report(docs.withColumn("lang", docs["lang"].substr(0, 0)).filter("false")).count()
    unlabelled = language.report(docs.limit(5).selectExpr("doc_id", "text", "cast(null AS string) AS lang"))
    assert nothing == 0 and {(r.lang_pred, r.score) for r in unlabelled.collect()} == {("und", 0.0)}


def test_prediction_uses_the_text_only(spark):
    docs = queries.table(spark, SMALL, "documents")
    model = language.learn(docs)
    plain = {r.text: r.found for r in language.predict(docs.select("text"), model).collect()}
    for r in language.predict(docs.selectExpr("doc_id + 5 AS doc_id", "'de' AS lang", "text"), model).collect():
        assert plain[r.text] == r.found


# --- URL filter


URLS = [None, "", "no scheme/path", "http://", "http://A.Example.NET/en/x?q", "https://example.net", "ftp://sub.example.net/de#x", "x://net/a", "x://xnet/a", "http://www.bad.org/",
        "http://bad.org", "HTTP://BAD.org/?a=1", "http://bad.org/fr/1", "http://a.example.com/de/", "http://example.com/de", "http://b.org/x", "http://?q", "http://h#f://x/y", "http://É.net/ü"]


def test_url_filter(spark):
    rules = [url_filter.parse_rule(*r) for r in queries.URL_RULES]
    pages = spark.createDataFrame([(i, u, "z", True, "c") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, rule string, listed boolean, canonical string")
    lists = spark.createDataFrame([("bad.org",), ("bad.org",), (None,), ("",), ("nowhere.org/a",)], "canonical string")
    rows = url_filter.filter_urls(pages, rules, lists).collect()
    assert len(rows) == 2 * len(URLS)

    def plain(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = rest
        for c in "/?#":
            host = host.partition(c)[0]
        path = rest[len(host) :].partition("?")[0].partition("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        listed = (host.removeprefix("www.") + path.rstrip("/")) == "bad.org"
        return host, path, best and best.text, best.verdict if best else "block" if listed else "allow"

    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain(URLS[r.page_id % len(URLS)])
    assert url_filter.filter_urls(pages, rules, lists.limit(0)).filter("listed").isEmpty()
    assert url_filter.filter_urls(pages.limit(0), rules, lists).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(20000).selectExpr("xxhash64(id) AS h")
    held = np.array([r.h for r in keys.collect()])
    for most in (url_filter.MAX_BLOCKS, 64):  # also a filter far too small for its keys
        table = url_filter.build_bloom(keys, max_blocks=most)
        assert url_filter.probe(table, held).all() and len(table) <= most
    table = url_filter.build_bloom(keys)
    others = np.array([r.h for r in spark.range(20000, 60000).selectExpr("xxhash64(id) AS h").collect()])
    assert url_filter.probe(table, others).mean() < 0.01


# --- WARC


def pages(spark):
    inner = warc.MAGIC + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + warc.MAGIC + "x"
    rows = [(1, "u", inner), (2, None, None), (3, "a\r\nb", ""), (4, "x", inner), (5, "y", "é" * 70000 + warc.MAGIC + "Content-Length: 9\r\n\r\n"), (6, "z", "WARC/1.0\r"),
            (7, "z", "\r\n\r\n"), (8, "z", "WARC/1.0\r\n\r\n"), (9, "z", "tail\r\n\r\nWARC/1.0"), (-3, "v", "x" * 50), (11, "v", "x" * 50)] + [(20 + i, "u", f"{i}" * (i * 97)) for i in range(60)]
    return spark.createDataFrame([(i, u, h, "extra", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, record int").repartition(3)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, compression):
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # many byte ranges a file
    try:
        got = warc.round_trip(pages(spark), compression=compression).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    con = duckdb.connect()
    con.register("pages", pages(spark).toPandas())
    want = con.execute(warc.ORACLE).df()
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).where(f.notna(), None).values.tolist()), key=str)
    assert [tuple(float(x) if isinstance(x, (int, float)) else x for x in r) for r in key(got)] == [tuple(float(x) if isinstance(x, (int, float)) else x for x in r) for r in key(want)]


def test_warc_reads_texts_and_headers(spark):
    path = warc.scratch_path(spark, "warc-test")
    warc.write_archives(pages(spark), path, min_bytes=10)
    rows = {r.page_id: r for r in warc.parse(warc.read_archives(spark, path)).collect()}
    for r in pages(spark).collect():
        read = rows[r.page_id]
        assert read.record_type == "revisit" or bytes(read.payload).decode() == (r.html or "")
    assert {i for i, r in rows.items() if r.record_type == "revisit"} == {4, 11} and rows[3].url == "a%0D%0Ab"


def test_warc_edges(spark):
    schema = "page_id long, url string, html string"
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    got = warc.round_trip(spark.createDataFrame([(None, None, "a"), (None, "u", "a"), (3, "u", "a"), (3, "u", "a"), (4, "u", "a"), (None, "u", "b")], schema))
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got.collect()) == Counter(
        {(None, "revisit", 3): 2, (3, "response", None): 2, (4, "revisit", 3): 1, (None, "response", None): 1}
    )


def test_words_and_pairs_remembered_or_forgotten_give_equal_ids(monkeypatch):
    model = sentence_piece.Model.parse(Path(queries.TOKENIZER).read_bytes())
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(60)]
    whole = sentence_piece.Encoder(model).encode(texts)
    monkeypatch.setattr(sentence_piece, "MOST_WORDS", 50)
    monkeypatch.setattr(sentence_piece, "PAIR_BITS", 4)
    encoder = sentence_piece.Encoder(model)
    assert [x for _ in range(2) for i in range(0, 60, 5) for x in encoder.encode(texts[i : i + 5])] == whole * 2


# --- chat


def test_chat_links(spark):
    call = "conv_id long, turn long, call_id string, name string, arguments string, after string, level long, json string"
    calls = [(1, 0, "a", "measure", '{"chars": 3.0}', None), (1, 2, "b", "measure", '{ "unit":"word","chars":1}', "a"), (1, 4, "c", "search", "{}", "b"), (1, 6, "c", "search", "{}", "x"),
             (1, 8, "d", "measure", "nonsense", "nowhere"), (2, 0, "a", "none", '{"z":[1,{"y":null,"b":"é"}]}', "b"), (2, 2, "b", "measure", "[]", "a"), (2, 3, "e", "measure", None, "b"),
             (2, 4, "s", "measure", '{"chars":-1}', "s"), (None, 1, "a", "measure", '{"chars":1,"q":2}', None), (3, 1, None, "translate", '{"text":"t"}', "a"), (3, 1, None, "translate", '{"text":"t"}', "a")]
    calls += [(9, i, f"n{i}", "measure", '{"chars":1}', f"n{i - 1}") for i in range(40)]
    calls = spark.createDataFrame([(*c, 5, "j") for c in calls], call)
    results = spark.createDataFrame([(1, 1, "a", "later"), (1, 1, "a", "first"), (1, 3, "b", None), (2, 9, "zz", "lost"), (None, 1, "a", "lost"), (4, 1, "a", "lost")], "conv_id long, turn long, call_id string, content string")
    rows = chat.link_calls(calls, results, chat.SCHEMAS).collect()
    by = {(r.conv_id, r.call_id): r for r in rows if r.kind == "call"}
    assert json.loads(by[1, "a"].json) == {"arguments": {"chars": 3}, "id": "a", "name": "measure", "result": "first", "valid": True}
    assert by[1, "b"].json == '{"arguments":{"chars":1,"unit":"word"},"id":"b","name":"measure","result":null,"valid":true}'
    assert [(by[1, k].level, by[1, k].status) for k in "abcd"] == [(0, "linked"), (1, "linked"), (2, "unanswered"), (0, "unanswered")]
    assert by[1, "c"].copies == 2 and by[1, "c"].turn == 4 and by[1, "c"].error == "limit: missing"
    assert {k: (by[2, k].level, by[2, k].status) for k in "abes"} == dict.fromkeys("abes", (None, "cycle"))
    assert by[2, "a"].json.startswith('{"arguments":{"z":[1,{"b":"é","y":null}]}') and by[2, "a"].error == "tool: unknown"
    assert by[2, "s"].error == "chars: out of range" and by[None, "a"].error == "q: unknown" and by[1, "d"].error == "arguments: not object"
    assert sum(r.kind == "call" and r.call_id is None for r in rows) == 2 and by[9, "n39"].level == 39
    assert Counter(r.status for r in rows if r.kind == "result") == {"orphan": 3}
    assert chat.link_calls(calls.limit(0), results.limit(0), chat.SCHEMAS).count() == 0


def test_chat_refuses_what_json_cannot_hold(spark):
    texts = ['{"query":"\\ud800","limit":1}', "[" * 5000 + "]" * 5000, '{"query":"q","limit":NaN}', '{"query":"q","limit":1e999}', '{"query":"q","limit":' + "9" * 5000 + "}",
             '{"a":' * 150 + "1" + "}" * 150, '{"query":"q","limit":-Infinity}', "{", "", '{"query":"\\ud83d\\ude00 \\u0000","limit":3.0}', '{"query":"' + "x" * 300_000 + '","limit":2}',
             '{"query":"q","query":"r","limit":4}']
    calls = spark.createDataFrame(
        [("c", i, f"k{i}", "search", t, None, "kept", 1) for i, t in enumerate(texts)],
        "conv_id string, turn long, call_id string, name string, arguments string, after string, status string, copies int",
    )
    results = spark.createDataFrame([("c", 20, "k0", "r", "x")], "conv_id string, turn long, call_id string, content string, json string")
    rows = {r.turn: r for r in chat.link_calls(calls, results, chat.SCHEMAS).collect()}
    for i in range(9):
        assert not rows[i].valid and json.loads(rows[i].json)["arguments"] is None and rows[i].error.endswith("not object")
    assert all(rows[i].valid for i in (9, 10, 11))
    assert json.loads(rows[9].json)["arguments"] == {"limit": 3, "query": "😀 \0"} and len(rows[10].json) > 300_000
    assert json.loads(rows[11].json)["arguments"]["query"] == "r"


def test_chat_refuses_unknown_schema_types(spark):
    calls = spark.createDataFrame([], "conv_id string, turn long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([], "conv_id string, turn long, call_id string, content string")
    with pytest.raises(ValueError, match="date"):
        chat.link_calls(calls, results, {"t": {"type": "object", "properties": {"x": {"type": "array", "items": {"type": "date"}}}}})
    assert chat.violation("text", {"minimum": 3}) is None


def test_chat_keeps_repeated_calls_and_results(spark):
    calls = [(1, 0, "a", "measure", '{"chars":1}', None), (1, 2, "a", "measure", '{"chars":2}', None), (1, 2, "a", "measure", '{"chars":2}', None),
             (1, 0, "b", "measure", '{"chars":3}', None), (1, 0, "b", "measure", '{"chars":3}', None)]
    results = [(1, 1, "a", "first"), (1, 1, "a", "later"), (1, 3, "a", None), (1, 3, "a", None), (1, 1, "b", "only"), (1, 1, "z", "lost"), (1, 1, "z", "lost")]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    rows = chat.link_calls(calls, results, chat.SCHEMAS).collect()
    got = Counter((r.kind, r.status, r.turn, r.call_id, r.copies, json.loads(r.json).get("content"), (json.loads(r.json).get("arguments") or {}).get("chars")) for r in rows)
    assert got == Counter({
        ("call", "linked", 0, "a", 3, None, 1): 1, ("repeated_call", "repeated", 2, "a", 2, None, 2): 1,
        ("call", "linked", 0, "b", 2, None, 3): 1, ("repeated_call", "repeated", 0, "b", 1, None, 3): 1,
        ("repeated_result", "repeated", 1, "a", 1, "later", None): 1, ("repeated_result", "repeated", 3, "a", 2, None, None): 1,
        ("result", "orphan", 1, "z", 0, "lost", None): 2,
    })


# --- SentencePiece


@pytest.fixture(scope="module")
def model():
    return sentence_piece.Model.parse(open(queries.TOKENIZER, "rb").read())


def test_encoding_equals_the_library(model):
    import sentencepiece

    rng = random.Random(2)
    words = "The quick brown fox isn't   trivial, 12345.67 & 日本語 Привет мир! def f(x):\n    return x**2\t# naïve 🎉🎉 aaaaaaaaaaaaaaaa ==== \x00".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["".join(rng.choice("abcdehilnorst ") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    texts += ["", " ", "   x  y   ", "a" * 300, "ab" * 200, "\n\n", " " * 50, "=" * 160]
    texts += pd.read_parquet(f"{SMALL}/documents.parquet").text.tolist()[:60]
    encoder = sentence_piece.Encoder(model)
    got = [x for i in range(0, len(texts), 150) for x in encoder.encode(texts[i : i + 150])]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    assert got == library.encode(texts)
    assert [encoder.decode(x) for x in got] == texts == library.decode(got)


def test_unigram_path_is_the_best():
    rng = random.Random(4)
    pieces = ["<unk>", *sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)} - {"c"})]
    scores = np.array([0.0, *[-rng.random() * 9 for _ in pieces[1:]]])
    model = sentence_piece.Model(pieces, scores, np.array([2] + [1] * (len(pieces) - 1)), sentence_piece.UNIGRAM, False, False, True)
    encoder = sentence_piece.Encoder(model)

    def best(text):
        table = {p: s for p, s in zip(pieces[1:], scores[1:])}
        out = [0.0]
        for end in range(1, len(text) + 1):
            options = [out[b] + table[text[b:end]] for b in range(end) if text[b:end] in table]
            if text[end - 1] not in table:
                options.append(out[end - 1] + encoder.floor)
            out.append(max(options))
        return out[-1]

    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
        ids = encoder.encode([text])[0]
        got = sum(encoder.floor if i == 0 else scores[i] for i in ids)
        assert abs(got - best(text)) < 1e-9


def test_encoding_rows(spark, model):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 30000), (4, "\n")]
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, ids string, decoded int")
    got = sentence_piece.report(docs, model).collect()
    assert len(got) == len(rows) and all(r.same for r in got)
    assert Counter((r.doc_id, r.n_tokens) for r in got if r.doc_id in (1, 2)) == {(1, 0): 1, (2, 0): 2}
    assert sentence_piece.report(docs.limit(0), model).count() == 0


def test_few_words_advance_together_and_equal_ids_are_one_object(monkeypatch):
    letters = "abcdefghijklmnop"
    pieces = [(c, 0.0, 1) for c in letters]
    encoder = sentence_piece.Encoder(
        sentence_piece.Model([p for p, *_ in pieces], np.zeros(16), np.ones(16, int), sentence_piece.UNIGRAM, False, False, True)
    )
    sizes, step = [], encoder._words
    monkeypatch.setattr(encoder, "_words", lambda codes: sizes.append(codes.size) or step(codes))
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters]
    found = encoder.encode_words(words)
    assert max(sizes) <= 1 << 16 and sum(sizes) == 4 * len(words)
    assert found[0] == (0, 0, 0, 0) and found[-1] == (15, 15, 15, 15)
    assert all(isinstance(ids, tuple) for ids in found)
