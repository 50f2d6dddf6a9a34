"""Operator 2: URL filters, with DataFrame functions only.

A list of canonical rules (host, path, verdict) judges every URL: a rule fits its host and all subdomains if the URL's
path starts with the rule's. Each URL has few possible rules: the suffixes of its host by labels, each with the
prefixes of its path by the lengths that occur in the list. A blocked Bloom filter of the listed rules (one 64-bit
block per key, four bits set in it) passes the possible hits to a hash join with the list, which drops false hits. The
filter's size follows the number of rules, up to 2**MOST blocks (1 MB), so it is sent with the plan; beyond, more false
hits pass it. The list itself is joined by key and may be large.

Only distinct hosts and paths that have a possible hit are joined, so neither URLs without a rule nor malformed ones
are one hot key. Null URLs and URLs without `://` have an empty host and path, fit no rule and get the default verdict.
URLs are judged as they stand (no decoding). Rows are kept as they are, repeated rows and other columns included, but
for columns named host, path, rule or verdict, which the operator's own replace.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two of 64-bit blocks of the filter, at least and at most; and blocks for each rule.
LEAST, MOST, PER_RULE = 10, 17, 2


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _mask(key: Column) -> Column:
    """Four bits of a block, from four groups of bits of a second hash."""
    h = F.xxhash64(key, F.lit(7))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, s).bitwiseAND(F.lit(63)).cast("int")) for s in (0, 12, 24, 36)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


class BlockedBloom:
    """Built with one aggregate; holds(column) is an expression over its blocks, a literal of `blocks` longs."""

    def __init__(self, keys: DataFrame, column: str, blocks: int = 1 << LEAST):
        self.blocks = blocks
        rows = keys.groupBy(_block(F.col(column), blocks).alias("block")).agg(F.bit_or(_mask(F.col(column))).alias("bits")).collect()
        words = [0] * blocks
        for row in rows:
            words[row.block] = row.bits
        self.words = F.from_json(F.lit(json.dumps(words)), "array<bigint>")

    def holds(self, key: Column) -> Column:
        mask = _mask(key)
        return F.get(self.words, _block(key, self.blocks)).bitwiseAND(mask) == mask


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\x00"), path)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds host, path, rule (host and path of the longest rule that fits, else null) and verdict to the pages.

    rules: host, path, verdict; of rules with equal host and path the first verdict by alphabet holds.
    """
    rules = rules.filter("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("rule_verdict"))
    rules = rules.withColumn("key", _key(F.col("host"), F.col("path"))).withColumn("rule", F.concat("host", "path")).select("key", "rule", "rule_verdict", F.length("path").alias("size"))
    counts = {r.size: r.n for r in rules.groupBy("size").agg(F.count("*").alias("n")).collect()}
    sizes = sorted(counts)
    bloom = BlockedBloom(rules, "key", 1 << min(max((PER_RULE * sum(counts.values())).bit_length(), LEAST), MOST))

    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("page"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sizes] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _key(s, p))))
    possible = F.filter(keys, lambda k: bloom.holds(k))

    split = split.withColumn("hit", F.size(possible) > 0)
    sites = split.filter("hit").select("host", "path").distinct()
    hits = sites.select("host", "path", F.explode(possible).alias("key")).join(rules.drop("size"), "key")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.length("key"), F.col("key"))).alias("best"))
    found = split.filter("hit").join(best, ["host", "path"], "left")
    rest = split.filter(~F.col("hit")).withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    out = [F.col("page").getField(c).alias(c) for c in names]
    verdict = F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    return found.unionByName(rest).select(*out, "host", "path", F.col("best.rule").alias("rule"), verdict)
