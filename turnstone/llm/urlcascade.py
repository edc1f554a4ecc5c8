"""URL verdicts by Bloom filter cascades, DataFrame operations only.

A cascade answers "is this key listed?" without error for every key of a known
universe. Level 1 holds the listed keys; level 2 holds the other keys of the
universe that level 1 wrongly passes; level 3 the listed keys that level 2 wrongly passes,
and so on until nothing passes wrongly. The first level that rejects a key
decides. The universe here is every key that any row of the corpus asks for, so
the answers are exact and no row is joined with a list.

The keys that a url asks for are its host's suffixes (whole labels), alone for
the list of blocked hosts, and followed by the beginnings of its path for rules.

Size: level 1 takes about 1.44 log2(1/p) bits a listed key, later levels
1.44 bits a key that passed wrongly; a filter above MOST_BYTES is refused with an error, as it
goes to every task. All else is grouped by key with partial sums.

Defined cases: a null url or one without ``://`` has an empty host and path and
asks for the empty host alone; null ids and equal rows are kept as rows; empty
tables and lists give empty results and the default verdict.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MOST_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ://, up to / ? # with A-Z lower-cased; then up to ? #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffix(host: Column, labels: int) -> Column:
    """The host's last labels, null if it has fewer."""
    parts = F.split(host, r"\.", -1)
    return F.when(F.size(parts) >= labels, F.array_join(F.slice(parts, -labels, labels), "."))


@dataclass(frozen=True)
class Cascade:
    """filters: a table of level and words; sizes: bits and hashes of each level."""

    filters: DataFrame | None
    sizes: tuple[tuple[int, int], ...]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed; false for null."""
        out = F.lit(len(self.sizes) % 2 == 1)
        for level in range(len(self.sizes), 0, -1):
            words = self.filters.filter(F.col("level") == level).select("words").scalar()
            out = F.when(self._passes(key, level, words), out).otherwise(F.lit(level % 2 == 0))
        return F.coalesce(key.isNotNull() & out, F.lit(False))

    def _passes(self, key: Column, level: int, words: Column) -> Column:
        bits, hashes = self.sizes[level - 1]
        return reduce(lambda a, b: a & b, (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1 for at in positions(key, level, bits, hashes)))


def positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * 64 + j), key), F.lit(bits)) for j in range(hashes)]


def build(universe: DataFrame, listed: DataFrame) -> Cascade:
    """universe, listed: tables of key; both may repeat keys, and listed keys outside the universe do no harm."""
    rows = universe.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    keys = stored(rows.filter("key is not null").groupBy("key").agg(F.bool_or("listed").alias("listed")))
    counts = {r.listed: r["count"] for r in keys.groupBy("listed").count().collect()}
    inside, others = counts.get(True, 0), counts.get(False, 0)
    sizes: list[tuple[int, int]] = []
    made: DataFrame | None = None
    cascade = Cascade(None, ())
    held = keys.filter("listed")
    n, other = inside, keys.filter("not listed")
    while n:
        level = len(sizes) + 1
        p = min(0.5, max(inside / max(others, 1) * math.sqrt(0.5), 2.0**-20)) if level == 1 else 0.5
        hashes = max(1, math.ceil(math.log2(1 / p)))
        bits = 64 * math.ceil(max(64, n * hashes / math.log(2)) / 64)
        if bits > MOST_BYTES * 8:
            raise ValueError(f"a filter of {bits // 8} bytes for {n} keys is more than {MOST_BYTES}")
        sizes.append((bits, hashes))
        at = held.select(F.explode(F.array(*positions(F.col("key"), level, bits, hashes))).alias("at"))
        ones = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
        dense = ones.unionByName(keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
        words = dense.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
        one = stored(words.select(F.lit(level).alias("level"), "words"))
        made = one if made is None else made.unionByName(one)
        cascade = Cascade(made, tuple(sizes))
        # those of the other kind that came this far and pass this level too are held by the next
        wrong = stored(other.filter(cascade._passes(F.col("key"), level, one.select("words").scalar())))
        held, other, n = wrong, held, wrong.count()
    return cascade


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], blocked_hosts: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict for each row.

    rules: verdict (allow or block), host, beginning of the path. A rule fits its host and all
    subdomains; the longest wins, of equally long ones the one with the longer
    host. Where none fits, a host or a parent of it that blocked_hosts (a column
    ``host``) lists is blocked, and all else gets the default.
    """
    rules = list(rules)
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    blocked = blocked_hosts.select(F.col("host").alias("key")).filter("key is not null").distinct()
    depth = blocked.agg(F.max(F.size(F.split("key", r"\.", -1)))).first()[0] or 0
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})

    def rule_key(labels: int, length: int) -> Column:
        return F.when(F.length("path") >= length, F.concat(suffix(F.col("host"), labels), F.substring(F.col("path"), 1, length) if length else F.lit("")))

    of_rules = [rule_key(*s) for s in shapes]
    of_hosts = [suffix(F.col("host"), k) for k in range(1, depth + 1)]
    asked = rows.select("host", *[F.lit(None).cast("string").alias("none")], *[k.alias(f"r{i}") for i, k in enumerate(of_rules)], *[k.alias(f"h{i}") for i, k in enumerate(of_hosts)])
    universe = lambda names: asked.select(F.explode(F.array_distinct(F.array("none", *names))).alias("key"))
    rule_keys = universe([f"r{i}" for i in range(len(of_rules))])
    lists = {v: spark.createDataFrame([(h + p,) for w, h, p in rules if w == v], "key string") for v in ("allow", "block")}
    by_verdict = {v: build(rule_keys, keys) for v, keys in lists.items()}
    hosts = build(universe([f"h{i}" for i in range(len(of_hosts))]), blocked)

    found = [F.when(c.contains(key), F.struct(F.length(key).alias("n"), F.lit(labels).alias("labels"), key.alias("rule"), F.lit(v).alias("verdict"))) for v, c in by_verdict.items() for (labels, _), key in zip(shapes, of_rules)]
    best = F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("struct<n:int,labels:int,rule:string,verdict:string>")
    listed = reduce(lambda a, b: a | b, [hosts.contains(k) for k in of_hosts], F.lit(False))
    return rows.withColumn("_best", best).select(F.col("page_id").alias(id_col), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.when(listed, F.lit("block")).otherwise(F.lit(default))).alias("verdict"))
