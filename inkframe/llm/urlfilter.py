"""URL filters: path rules, then a Bloom filter cascade (DataFrame functions only)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm.store import Store

#: Bits of one bitmap that Spark's bitmap aggregate builds.
BITMAP_BITS = 8 * 4096
#: Keys are cut by a hash into ranges with a filter of at most so many bits each.
RANGE_BITS = 1 << 26
#: Filters together; beyond it pages are judged by a join with the key universe.
MAX_BITS = 1 << 31
MAX_LEVELS = 40


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """Allows or blocks paths that start with ``path`` on ``host`` and its subdomains."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        on_host = (host == F.lit(self.host)) | host.endswith(F.lit("." + self.host))
        return on_host & path.startswith(F.lit(self.path))


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def match_rules(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or nulls."""
    chosen = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        fits = rule.fits(host, path)
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return none if chosen is None else chosen.otherwise(none)


@dataclass(frozen=True)
class Level:
    """One Bloom filter per range of keys; bit positions are hashes seeded by the level and the probe.

    The bits are a written table with a row per range. Each reaches a query as
    a scalar subquery, so plans do not carry them.
    """

    depth: int
    bits: int
    probes: int
    ranges: int
    table: DataFrame | None = field(repr=False, default=None)

    def range_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("range"), F.lit(self.depth), key), F.lit(self.ranges))

    def positions(self, key: Column) -> list[Column]:
        """Bit positions in the filter of the key's range."""
        return [F.pmod(F.xxhash64(F.lit(self.depth), F.lit(i), key), F.lit(self.bits)) for i in range(self.probes)]

    def _holds(self, content: Column, key: Column) -> Column:
        found = F.lit(True)
        for position in self.positions(key):
            byte = F.conv(F.hex(F.substring(content, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10)
            found = found & (F.call_function("shiftright", byte.cast("int"), F.pmod(position, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found

    def has(self, key: Column) -> Column:
        """Whether the filter holds the key; false hits are possible."""
        answer = F.lit(False)
        for i in range(self.ranges):
            mine = self._holds(self.table.filter(F.col("range") == i).select("content").scalar(), key)
            answer = mine if self.ranges == 1 else F.when(self.range_of(key) == i, mine).otherwise(answer)
        return answer


def level_bits(count: int, rate: float) -> int:
    """Bits of a filter over so many keys, in whole bitmaps."""
    return math.ceil(max(64, -max(1, count) * math.log(rate) / math.log(2) ** 2) / BITMAP_BITS) * BITMAP_BITS


def build_level(keys: DataFrame, key: str, count: int, depth: int, rate: float, store: Store, range_bits: int = RANGE_BITS) -> Level:
    """A filter over ``keys``; its bits are written and never reach the driver."""
    ranges = math.ceil(level_bits(count, rate) / range_bits)
    bits = level_bits(math.ceil(count / ranges), rate)
    empty = Level(depth, bits, max(1, round(-math.log2(rate))), ranges)
    spots = keys.select(empty.range_of(F.col(key)).cast("int").alias("range"), F.explode(F.array(*empty.positions(F.col(key)))).alias("p"))
    maps = spots.groupBy("range", F.floor(F.col("p") / BITMAP_BITS).cast("int").alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("p"), F.lit(BITMAP_BITS))).alias("map")
    )
    cells = keys.sparkSession.range(ranges * (bits // BITMAP_BITS)).select(
        F.expr(f"CAST(id DIV {bits // BITMAP_BITS} AS INT)").alias("range"), F.expr(f"CAST(id % {bits // BITMAP_BITS} AS INT)").alias("bucket")
    )
    every = cells.join(maps, ["range", "bucket"], "left").select("range", "bucket", F.coalesce(F.hex("map"), F.lit("00" * (BITMAP_BITS // 8))).alias("map"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "map"))), lambda x: x["map"])
    content = every.groupBy("range").agg(F.unhex(F.array_join(ordered, "")).alias("content"))
    return Level(depth, bits, empty.probes, ranges, store.put(f"level{depth}", content))


@dataclass(frozen=True)
class Cascade:
    """Levels that hold, in turn, listed keys and the false hits of the level before."""

    levels: tuple[Level, ...]

    def lists(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            # A key the level lacks is on the other side of what the level holds.
            answer = F.when(~level.has(key), F.lit(level.depth % 2 == 1)).otherwise(answer)
        return answer


def build_cascade(
    universe: DataFrame, key: str, listed: str, first_rate: float = 0.02, rate: float = 0.5, range_bits: int = RANGE_BITS, max_bits: int = MAX_BITS
) -> Cascade | None:
    """A cascade over ``universe`` (one row per key; ``listed`` says if it is on the list).

    None if its filters would pass ``max_bits``, which every task holds.

    Level 0 holds the listed keys; each later level holds those keys of the
    other side that every level so far let through, until none is left.
    """
    frame = universe.select(F.col(key).alias("key"), F.col(listed).alias("listed"))
    levels: list[Level] = []
    side = True
    left = {True: frame.filter("listed"), False: frame.filter("NOT listed")}
    count = left[True].count()
    store = Store(universe.sparkSession, "cascade")
    total = 0
    while count:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end: a key is listed and not listed")
        chosen = first_rate if not levels else rate
        total += level_bits(count, chosen)
        if total > max_bits:
            return None
        level = build_level(left[side], "key", count, len(levels), chosen, store, range_bits)
        levels.append(level)
        side = not side
        left[side] = left[side].filter(level.has(F.col("key")))
        count = left[side].count()
    return Cascade(tuple(levels))


def filter_pages(pages: DataFrame, listed: Column, rules: tuple[Rule, ...] = RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """Judge every url: the longest path rule that fits, else the host list.

    ``listed`` is a condition over column ``host`` that defines the list. It is
    evaluated once per distinct host, the complete key universe, to build the
    cascade; pages are then judged by the cascade without a join. Only a list
    whose filters would pass ``max_bits`` (hundreds of millions of hosts) is
    joined by host instead, with the same result. Null urls and urls without
    ``://`` have an empty host and path; an empty host is a key of the universe
    like any other. Urls of any length are judged whole. Repeated pages are
    judged alike, an empty table gives an empty result, and other columns are
    not read.
    """
    parsed = pages.select(F.col("page_id").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = parsed.select("host").distinct().withColumn("listed", F.coalesce(listed, F.lit(False)))
    universe = Store(pages.sparkSession, "hosts").put("universe", universe)
    cascade = build_cascade(universe, "host", "listed", max_bits=max_bits)
    if cascade is None:
        parsed, on_list = parsed.join(universe, "host"), F.col("listed")
    else:
        on_list = cascade.lists(F.col("host"))
    hit = match_rules(F.col("host"), F.col("path"), rules)
    return parsed.withColumn("hit", hit).select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(on_list, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
