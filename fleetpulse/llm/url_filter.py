"""URL filter: host and path rules, and a list of URLs held in a blocked Bloom filter.

The filter's blocks are built by Spark aggregation and only say which rows may be listed; these
rows are then joined with the list itself, so a false positive costs a join row and no wrong verdict.

Edge cases: a null URL or one without `://` has an empty host and path, fits no rule and is not
listed, so it is allowed. Rows that repeat are judged alike. An empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import ascii_lower, pick

WORDS = 8  # 32-bit words of a block; a key sets one bit in each
SALTS = tuple((0x3C6EF372 + 0x05491333 * i) % (1 << 31) | 1 for i in range(WORDS))  # one odd multiplier a word
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 18  # 8 MB


@dataclass(frozen=True)
class Rule:
    """`block` or `allow` for a host with all its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    """`example.net/en/` is host `example.net` and path `/en/`."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    start = F.instr(url, "://")
    rest = F.coalesce(F.when(start > 0, url.substr(start + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """The form in which URLs are listed: no scheme, `www.`, query, fragment or closing slash."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equally long ones the last by text); else null."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def build_bloom(keys: DataFrame, bits_per_key: int = BITS_PER_KEY, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """The filter over a column `h` of 64-bit keys: an array of at most max_blocks x 8 words.

    Spark sets the bits, by aggregation. Only the blocks reach the driver, 32 bytes each, however
    long the list; beyond max_blocks the filter passes more false positives to the exact join.
    """
    blocks = min(max_blocks, -(-keys.count() * bits_per_key // (32 * WORDS)))
    table = np.zeros((blocks, WORDS), np.uint32)
    if blocks:
        bit = "shiftleft(1L, cast(shiftrightunsigned(((h & 4294967295L) * {}L) & 4294967295L, 27) AS int))"
        rows = keys.groupBy(F.expr(f"shiftrightunsigned(shiftrightunsigned(h, 32) * {blocks}L, 32)").alias("block")).agg(
            *[F.bit_or(F.expr(bit.format(salt))).alias(f"w{i}") for i, salt in enumerate(SALTS)]
        )
        for row in rows.toLocalIterator():
            table[row["block"]] = [row[f"w{i}"] for i in range(WORDS)]
    return table


def probe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where a key may have been added; never false for one that was."""
    if not len(table) or not len(keys):
        return np.zeros(len(keys), bool)
    u = keys.astype(np.int64).view(np.uint64)
    block = ((u >> np.uint64(32)) * np.uint64(len(table))) >> np.uint64(32)
    low = u & np.uint64(0xFFFFFFFF)
    bits = ((low[:, None] * np.array(SALTS, np.uint64)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    return ((table[block.astype(np.int64)] >> bits.astype(np.uint32)) & 1).all(axis=1)


def listed(urls: DataFrame, lists: DataFrame) -> DataFrame:
    """Adds `listed` to rows with a string column `canonical`; lists: canonical URLs in a column of that name.

    `urls` is read twice: rows that the filter rejects are done, the others meet the list in a join.
    """
    spark = urls.sparkSession
    lists = lists.filter("canonical IS NOT NULL").select("canonical").distinct()
    bloom = spark.sparkContext.broadcast(build_bloom(lists.select(F.xxhash64("canonical").alias("h"))))

    @F.pandas_udf("boolean")
    def maybe(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in parts:
            yield pd.Series(probe(bloom.value, h.to_numpy()))

    tested = urls.withColumn("maybe", F.coalesce(F.col("canonical") != "", F.lit(False)) & maybe(F.xxhash64("canonical")))
    hits = tested.filter("maybe").join(lists.withColumn("listed", F.lit(True)), "canonical", "left")
    rest = tested.filter("NOT maybe").withColumn("listed", F.lit(False))
    columns = [*[F.col(c) for c in urls.columns], F.coalesce("listed", F.lit(False)).alias("listed")]
    return hits.select(columns).unionByName(rest.select(columns))


def filter_urls(pages: DataFrame, rules: list[Rule], lists: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of pages.

    A rule that fits decides; else a listed URL is blocked and any other allowed.
    """
    cut = pick(pages, page_id=page_id, url=url)
    host, path = split_url(F.col("url"))
    cut = cut.select("page_id", host.alias("host"), path.alias("path"))
    cut = cut.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    text, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return listed(cut, lists).select(
        "page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed"
    )
