"""The registered queries of the text operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import (
    chat, decontaminate, embedding_dup, fill_in_middle, fingerprint, importance, language, line_dedup, near_dup, sentence_piece, suffix_dedup,
    url_filter, warc,
)
from fleetpulse.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Path of the tokenizer model of op1 and the pipeline.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_piece.report(table(spark, sf_dir, "documents"), sentence_piece.load(spark, TOKENIZER))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("component", "version")


# Fixed values of the contract: rules of the URL filter.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# First host labels (without www., m. or blog.) of the sites whose pages make up the list of blocked URLs.
LISTED_SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def listed_pages(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages of the listed sites."""
    host, path = url_filter.split_url(F.col("url"))
    cut = pages.select(host.alias("host"), path.alias("path"))
    label = F.substring_index(F.regexp_replace("host", r"^(www|m|blog)\.", ""), ".", 1)
    return cut.filter(label.isin(*LISTED_SITES)).select(url_filter.canonical(F.col("host"), F.col("path")).alias("canonical"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = [url_filter.parse_rule(*r) for r in URL_RULES]
    return url_filter.filter_urls(pages, rules, listed_pages(pages)).drop("listed")


OP5_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM s),
l AS (SELECT DISTINCT canonical FROM c WHERE split_part(regexp_replace(host, '^(www|m|blog)\.', ''), '.', 1)
    IN ('adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm')),
m AS (SELECT c.*, l.canonical IS NOT NULL AND c.canonical <> '' AS listed,
    CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM c LEFT JOIN l ON c.canonical = l.canonical)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM m
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.report(table(spark, sf_dir, "documents"))


def op13_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_language_id": op2_language_id,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_near_dup": op4_near_dup,
        "op5_url_filter": op5_url_filter,
        "op6_line_dedup": op6_line_dedup,
        "op7_chat_format": op7_chat_format,
        "op8_warc": op8_warc,
        "op9_fingerprints": op9_fingerprints,
        "op10_decontamination": op10_decontamination,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_embedding_near_dup": op13_embedding_near_dup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_near_dup": near_dup.ORACLE,
        "op5_url_filter": OP5_SQL,
        "op6_line_dedup": line_dedup.ORACLE,
        "op7_chat_format": chat.ORACLE,
        "op8_warc": warc.ORACLE,
        "op10_decontamination": decontaminate.ORACLE,
        "op11_importance_resampling": importance.ORACLE,
        "op12_fill_in_middle": fill_in_middle.ORACLE,
        "op13_embedding_near_dup": embedding_dup.ORACLE,
    }
