"""URL rules and an exact host list kept as a cascade of Bloom filters (operator 2). DataFrame functions only.

Verdicts come from rules first; a URL that no rule fits is blocked if its host, or a domain above it, is listed. The list is a
cascade: level 1 encodes the listed keys; level 2 the keys of the universe (all domains of all pages) that level 1 takes
for listed though they are not; level 3 the listed keys that level 2 takes in; and so on until a level errs on nothing.
Membership is then exact for every key of the universe, with no join. Levels are literal bit arrays: level 1 has
BITS_A_KEY bits for each listed key, later levels a few hundredths of that for each key of the universe. If they would
exceed MAX_BITS, keys are joined instead, with the same result.

Defined results: a null url, or one without ://, has empty host and path, no rule, and verdict allow; repeated rows
are judged alike; a null page_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host, path): fits the host and its subdomains where the path starts with the rule's; the longest rule wins.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Listed domains: each name under each of the top domains.
LISTED = [f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x") for top in ("com", "net", "org")]

BITS_A_KEY, HASHES = 10, 4
MAX_BITS = 1 << 26

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(found(1), UPPER, LOWER), found(2)


def domains(host: Column) -> Column:
    """The host and the domains above it, of two labels at least (or all of the host)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))


def _bit(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * 31 + j)), F.lit(bits))


class Cascade:
    """levels: bit arrays as 64-bit words, level 1 first."""

    def __init__(self, levels: list[list[int]]):
        self.levels = levels

    def _within(self, key: Column, level: int) -> Column:
        words = self.levels[level]
        array = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded into one literal
        hit = F.lit(True)
        for j in range(HASHES):
            at = _bit(key, level, j, 64 * len(words))
            word = F.get(array, F.floor(at / 64).cast("int"))
            hit = hit & (F.expr("1L") == F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)))
        return hit

    def holds(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            out = F.when(self._within(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def _words(keys: DataFrame, n: int, level: int) -> list[int]:
    words = max(1, -(-n * BITS_A_KEY // 64))
    at = F.explode(F.array(*[_bit(F.col("key"), level, j, 64 * words) for j in range(HASHES)])).alias("at")
    rows = keys.select(at).groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("b")).collect()
    out = [0] * words
    for r in rows:
        out[r["w"]] = r["b"]
    return out


def build(universe: DataFrame, listed: DataFrame) -> Cascade | None:
    """universe, listed: distinct keys. None if the filters would be too large."""
    listed = listed.select("key")
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    levels: list[list[int]] = []
    while True:
        n = inside.count()
        if (sum(map(len, levels)) * 64 + n * BITS_A_KEY) > MAX_BITS:
            return None
        level = len(levels)
        if not n:
            break
        levels.append(_words(inside, n, level))
        wrong = outside.filter(Cascade(levels)._within(F.col("key"), level))
        inside, outside = stored(wrong, f"level{level}"), inside
    return Cascade(levels)


def judge(pages: DataFrame, listed: DataFrame | None = None, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page."""
    spark = pages.sparkSession
    rules = sorted(RULES if rules is None else rules, key=lambda r: -len(r[1] + r[2]))
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    if listed is None:
        listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    listed = listed.distinct()
    universe = stored(parts.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct(), "universe")
    cascade = build(universe, listed)
    if cascade:
        parts = parts.withColumn("listed", F.exists(domains(F.col("host")), cascade.holds))
    else:
        hosts = parts.select("host").distinct().withColumn("key", F.explode(domains(F.col("host")))).join(listed, "key").select("host").distinct()
        parts = parts.join(hosts.withColumn("listed", F.lit(True)), "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    for said, h, p in reversed(rules):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")
