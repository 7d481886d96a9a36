"""The pipeline's stages and its whole run against plain versions."""

from __future__ import annotations

import brute
import corpus_pipeline
import pandas as pd
import pytest
import sentencepiece
from fleetpulse.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A part of the small tables with planted cases, in files of their own."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs = pd.read_parquet(f"{SMALL}/documents.parquet").head(110)
    bench = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    first = docs.text[0]
    words = first.split(" ")
    planted = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !!", "en"), (1003, first, "fr"), (1004, " ".join([*words[:20], "edit", *words[21:]]), "fr"),
               (1005, bench.text[0], "en"), (1006, docs.text[1] + "\n" + bench.text[1], "en"), (1007, docs.text[2] + "\nune ligne de plus pour ce texte", None)]
    docs = pd.concat([docs, pd.DataFrame([(i, t, n, "src0", len(t or "")) for i, t, n in planted], columns=docs.columns)])
    docs = docs.assign(extra="x")
    for name, frame in (("documents", docs), ("benchmark", bench)):
        spark.createDataFrame(frame.astype(object).where(frame.notna(), None), schema=None if name == "benchmark" else "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{path}/{name}.parquet")
    return path


def test_stages_are_named_in_order_and_keep_the_columns(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"
    ]
    docs = queries.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name


def test_run_equals_the_plain_version(spark, folder):
    docs = queries.table(spark, folder, "documents")
    items = [tuple(r) for r in queries.table(spark, folder, "benchmark").select("item_id", "text").collect()]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, docs, folder).collect()]
    assert {i for i, _ in ((r.doc_id, 0) for r in docs.collect())} - {i for i, _ in kept} == {1000, 1001, 1002}
    lines = brute.kept_lines(kept)
    left = [(i, lines[i]) for i, t in kept if lines[i] == t or lines[i].strip(" \t\n\r\f\v")]
    left = [(i, t) for (i, t), (_, _, _, keep) in zip(left, brute.near_components(left), strict=True) if keep]
    left = [(i, t) for (i, t), (*_, bad) in zip(left, brute.hits(left, items), strict=True) if not bad]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    want = {i: (library.encode(t), brute.sha(t)) for i, t in left}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: (list(r.ids), r.decoded_sha256) for r in got} == want
    assert all(r.same for r in got) and 1003 not in want


def test_empty_documents(spark, folder, tmp_path):
    queries.table(spark, folder, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    queries.table(spark, folder, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
