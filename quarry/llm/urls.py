"""URL filters: a blocked Bloom filter in front of an exact hash join.

What is listed are canonical keys: a rule's host and path prefix, or a whole canonical URL. Each URL
proposes its own keys (each suffix of its host with each prefix of its path whose length some rule
has, and its canonical form). A blocked Bloom filter passes the possible hits, and an exact hash join
with the list removes its false positives. The longest rule that fits decides, else a listed URL, else
the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

#: Bits of a key in its block of 8 words of 64 bits, and bits of the filter for each key.
PROBES, WORDS, BITS_A_KEY = 5, 8, 12
#: A filter of at most so many blocks (2 MB) and a list of at most so many keys are broadcast; larger ones are joined by block
#: and by key, with candidates of one block or key dealt to SALTS parts.
BROADCAST_BLOCKS, BROADCAST_KEYS, SALTS = 1 << 15, 20_000, 8


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www., default port, fragment, tracking parameters or a closing slash; null without ://."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_\w+|ref|fbclid|gclid)="))), "&")
    whole = F.concat(host, F.regexp_replace(url_path(url), r"/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(url.contains("://"), whole)


def _probes(key: Column, blocks: int) -> tuple[Column, Column]:
    """A key's block, and its mask: an array of 8 words with its bits set."""
    block = F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")
    h = F.xxhash64(key, F.lit("bits"))
    bits = [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511)) for i in range(PROBES)]
    return block, F.array(*bits)


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """The blocked Bloom filter of column key: block, words array<bigint>; at most ``blocks`` rows."""
    block, bits = _probes(F.col("key"), blocks)
    set_bits = keys.select(block.alias("block"), F.explode(bits).alias("bit"))
    word = F.floor(F.col("bit") / 64).cast("int")
    words = set_bits.groupBy("block", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("w"))
    folded = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "w"))).alias("m"))
    return folded.select("block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("words"))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def possible_hits(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``candidates`` (with columns url and key) that the filter passes."""
    block, bits = _probes(F.col("key"), blocks)
    asked = candidates.withColumns({"_block": block, "_bits": bits, "_salt": F.pmod(F.xxhash64("url"), F.lit(SALTS))})
    held = bloom.select(F.col("block").alias("_block"), F.col("words").alias("_words"))
    joined = asked.join(F.broadcast(held), "_block") if blocks <= BROADCAST_BLOCKS else asked.join(_salted(held), ["_block", "_salt"])
    return joined.where(F.expr("forall(_bits, b -> (shiftrightunsigned(element_at(_words, cast(b div 64 as int) + 1), cast(b % 64 as int)) & 1L) = 1L)")).drop("_block", "_bits", "_words")


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Each row of ``pages`` (page_id, url; other columns are ignored) with host, path, rule, listed and verdict.

    ``rules``: rule (host with a path prefix, as in ``example.org/es/``, or a host alone) and verdict. ``listed``: url,
    blocked in canonical form where no rule fits. A rule fits its host and all subdomains; the longest
    rule wins, ties to the smaller string. Null URLs and URLs without :// have empty host and path, and
    get the default. URLs are judged once each and joined back, so repeated rows and null ids are kept.
    """
    known = rules.select(F.col("rule").alias("key"), F.col("verdict").alias("rule_verdict"), F.lit(True).alias("is_rule")).where("key is not null")
    if listed is not None:
        known = known.unionByName(listed.select(canonical_url(F.col("url")).alias("key")).where("key is not null").distinct().select(F.concat(F.lit("="), "key").alias("key"), F.lit("block").alias("rule_verdict"), F.lit(False).alias("is_rule")))
    facts = known.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("is_rule"), F.when(F.col("key").contains("/"), F.length("key") - F.instr("key", "/") + 1).otherwise(0))).alias("lengths")).first()
    blocks = max(1, 1 << (facts["n"] * BITS_A_KEY // (64 * WORDS)).bit_length())

    urls = pages.select("url").where("url is not null").distinct().select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), canonical_url(F.col("url")).alias("whole"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(int(x)) for x in sorted(facts["lengths"])]).cast("array<int>"), lambda n: n <= F.length("path"))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    own = F.when(F.col("whole").isNotNull(), F.array(F.concat(F.lit("="), "whole"))).otherwise(F.array().cast("array<string>"))
    candidates = urls.select("url", F.explode(F.array_distinct(F.concat(pairs, own))).alias("key"))
    hits = possible_hits(candidates, bloom_filter(known, blocks), blocks)
    exact = hits.join(F.broadcast(known), "key") if facts["n"] <= BROADCAST_KEYS else hits.join(_salted(known), ["key", "_salt"])
    ranked = exact.groupBy("url").agg(
        F.min(F.when(F.col("is_rule"), F.struct((-F.length("key")).alias("n"), F.col("key").alias("rule"), F.col("rule_verdict").alias("verdict")))).alias("best"),
        F.max(~F.col("is_rule")).alias("on_list"),
    )
    return pages.select("page_id", "url").join(ranked, "url", "left").select(
        "page_id",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("on_list"), "block"), F.lit(default)).alias("verdict"),
        F.coalesce("on_list", F.lit(False)).alias("listed"),
    )


RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Pages on hosts with one of these words as a label, or as a part of one between hyphens, are listed.
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def listed_urls(pages: DataFrame) -> DataFrame:
    """url of ``pages`` on hosts with a listed word: the block list."""
    return pages.select("url").where(url_host(F.col("url")).rlike(rf"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges the url of every page by RULES, and by the list of canonical URLs of ``listed_urls`` where no rule fits."""
    rules = spark.createDataFrame(list(RULES), "rule string, verdict string")
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, rules, listed_urls(pages))


OP6_SQL = r"""
WITH parts AS (
    SELECT page_id, url,
        coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
        regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's') AS query
    FROM pages
), judged AS (
    SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule,
        regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/$', '') AS bare,
        array_to_string(list_sort(list_filter(string_split(coalesce(query, ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_\w+|ref|fbclid|gclid)='))), '&') AS kept
    FROM parts
), named AS (
    SELECT *, bare || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS whole FROM judged
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM (SELECT *, contains(url, '://') IS TRUE AND coalesce(whole IN (SELECT whole FROM named WHERE contains(url, '://') AND regexp_matches(host, '(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)')), false) AS listed
    FROM named)
"""
