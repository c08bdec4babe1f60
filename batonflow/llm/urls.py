"""URL filters: host and path rules, then a Bloom filter cascade over the rest.

A cascade is exact for the universe that it was built over. Level 0 holds the
listed keys, level 1 the unlisted keys that level 0 lets through, level 2 the
listed keys that level 1 lets through, and so on until a level lets nothing wrong
through. A key is listed if the first level that rejects it is odd.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from batonflow.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host/path prefix); a rule fits its host and all subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A part's bits, all levels together, are broadcast; keys are cut into so many parts that each is about this size at most.
MAX_FILTER_BYTES = 64 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``; only A-Z lower-cased; '' for null or no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``? #``; '' for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; ties go to the earlier rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        of, _, start = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _spots(one: np.ndarray, two: np.ndarray, level: int, k: int, m: int):
    """The k bit numbers of each key at this level, from two 64-bit hashes."""
    one, two = one.astype(np.uint64), two.astype(np.uint64) | np.uint64(1)
    one = (one ^ np.full(1, level + 1, np.uint64) * _GOLDEN) * np.uint64(0xBF58476D1CE4E5B9)
    one ^= one >> np.uint64(29)
    for i in range(k):
        yield (one + np.uint64(i) * two) % np.uint64(m)


@dataclass
class Cascade:
    """A cascade for each part of the keys: levels of (bits as uint8 array, number of hashes, number of bits), each part broadcast on its own."""

    parts: list

    def mark(self, rows: DataFrame, key: str, column: str) -> DataFrame:
        """`rows` with `column`: exact membership of `key` for any key of the universe; a null key is not listed.

        With several parts, each is asked for its own rows only, so a task holds one part.
        """
        one, two = F.xxhash64(key), F.xxhash64(key, F.lit(1))

        def asked(shared):
            @F.pandas_udf("boolean")
            def test(one: pd.Series, two: pd.Series) -> pd.Series:
                return pd.Series(_walk(shared.value, one.to_numpy(), two.to_numpy()))

            return F.when(F.col(key).isNotNull(), test(one, two)).otherwise(False)

        if len(self.parts) == 1:
            return rows.withColumn(column, asked(self.parts[0]))
        found = [rows.where(_part(one, len(self.parts)) == p).withColumn(column, asked(shared)) for p, shared in enumerate(self.parts)]
        return reduce(DataFrame.union, found)


def _part(one: Column, parts: int) -> Column:
    return F.pmod(F.shiftrightunsigned(one, 17), F.lit(parts))


def _passes(level, number, one, two) -> np.ndarray:
    bits, k, m = level
    ok = np.ones(len(one), bool)
    for at in _spots(one, two, number, k, m):
        ok &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return ok


def _walk(levels, one, two) -> np.ndarray:
    inside, alive = np.zeros(len(one), bool), np.ones(len(one), bool)
    for number, level in enumerate(levels):
        ok = _passes(level, number, one, two)
        inside[alive & ~ok] = number % 2 == 1
        alive &= ok
    inside[alive] = len(levels) % 2 == 1
    return inside


def _level(keys: DataFrame, number: int, n: int, bits_per_key: float):
    """Bits of `keys` (one, two): each task ORs its own, Spark ORs the 64-bit words of all tasks."""
    m, k = max(64, int(n * bits_per_key + 63) // 64 * 64), max(1, round(bits_per_key * 0.69))

    def words(frames):
        for f in frames:
            at = np.concatenate([*_spots(f["one"].to_numpy(), f["two"].to_numpy(), number, k, m), np.empty(0, np.uint64)])
            word, place = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            unique, group = np.unique(word, return_inverse=True)
            bits = np.zeros(len(unique), np.uint64)
            np.bitwise_or.at(bits, group, place)
            yield pd.DataFrame({"word": unique.astype(np.int64), "bits": bits.view(np.int64)})

    rows = keys.mapInPandas(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(m // 64, np.uint64)  # toPandas: m / 64 rows at most, and m is bounded by the caller's parts
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8), k, m


def build_cascade(listed: DataFrame, universe: DataFrame, key: str = "key", bits_per_key: float = 4.0, max_bytes: int = MAX_FILTER_BYTES) -> Cascade:
    """A cascade for `listed` over `universe` (keys of the corpus, repeated or not), in as many parts as keep each within `max_bytes`.

    The keys are cut by their hash and each part has a cascade of its own. What a part
    weighs is known from the counts: its listed keys, and of the unlisted ones the
    share that a level lets through. Listed keys outside the universe may be given:
    they join it. Nulls are ignored.
    """
    spark = universe.sparkSession
    hashed = lambda df: df.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("one"), F.xxhash64(key, F.lit(1)).alias("two")).distinct()
    inside = stage(hashed(listed), "listed")
    rest = stage(hashed(universe).join(inside, ["one", "two"], "left_anti"), "unlisted")
    weight = (inside.count() + 0.2 * rest.count()) * 1.3 * bits_per_key / 8
    parts = max(1, int(-(-weight // max(1, max_bytes))))
    own = lambda df, p: df if parts == 1 else df.where(_part(F.col("one"), parts) == p)
    return Cascade([spark.sparkContext.broadcast(_levels(own(inside, p), own(rest, p), bits_per_key)) for p in range(parts)])


def _levels(encoded: DataFrame, other: DataFrame, bits_per_key: float) -> list:
    levels = []
    while (n := encoded.count()) or not levels:
        levels.append(level := _level(encoded, number := len(levels), n, bits_per_key))
        shared = encoded.sparkSession.sparkContext.broadcast(level)

        def through(frames, shared=shared, number=number):
            for f in frames:
                yield f[_passes(shared.value, number, f["one"].to_numpy(), f["two"].to_numpy())]

        encoded, other = stage(other.mapInPandas(through, other.schema), "through"), encoded
        shared.destroy()
        if len(levels) > 200:
            raise RuntimeError("two keys of the universe share both hashes")
    return levels


# Names of columns that exist in between; a caller's columns may have any other.
_HOST, _PATH, _IN = "batonflow__host", "batonflow__path", "batonflow__in"


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """`pages` with host, path, rule, listed and verdict; `listed` has the hosts of the block list as `key`.

    The rule that fits decides, else membership of the host. Null and malformed
    urls have an empty host, which is a key like any other. Columns of `pages`
    with these names are replaced.
    """
    # Under names of their own first: the names of the result may clash with columns of `pages`.
    seen = pages.withColumn(_HOST, host_of(F.col(url))).withColumn(_PATH, path_of(F.col(url)))
    seen = build_cascade(listed, seen.select(F.col(_HOST).alias("key")), max_bytes=max_bytes).mark(seen, _HOST, _IN)
    rule, verdict = rule_of(F.col(_HOST), F.col(_PATH), rules)
    made = {"host": F.col(_HOST), "path": F.col(_PATH), "rule": rule, "listed": F.col(_IN)}
    made["verdict"] = F.coalesce(verdict, F.when(F.col(_IN), "block").otherwise("allow"))
    return seen.withColumns(made).drop(_HOST, _PATH, _IN)
