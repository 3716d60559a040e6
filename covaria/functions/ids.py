"""Subject ids, edge names and look-ups of nodes in domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_id(sid: Column, trim: bool = True, lower: bool = False, upper: bool = False, prefix: str = "", suffix: str = "") -> Column:
    """Trim, lower or upper, then strip one prefix and one suffix, in this order."""
    out = sid.cast("string")
    out = F.trim(out) if trim else out
    out = F.lower(out) if lower else out
    out = F.upper(out) if upper else out
    if prefix:
        out = F.when(out.startswith(prefix), F.substring(out, len(prefix) + 1, 1 << 30)).otherwise(out)
    if suffix:
        out = F.when(out.endswith(suffix), F.substring(out, F.lit(1), F.char_length(out) - len(suffix))).otherwise(out)
    return out


def collisions(ids: DataFrame, original: str, normalized: str) -> DataFrame:
    """Normalized ids that two or more original ones share, with their number."""
    return ids.groupBy(normalized).agg(F.count_distinct(original).alias("originals")).where("originals > 1")


def assert_no_collisions(ids: DataFrame, original: str, normalized: str) -> None:
    bad = collisions(ids, original, normalized).limit(5).collect()
    if bad:
        raise ValueError(f"ids collide after normalization: {[r[normalized] for r in bad]}")


def edges(spark, n: int, first: str = "IC_", between: str = "--") -> DataFrame:
    """Edges i < j of n nodes in row-major order: edge (place), i, j and name."""
    i, j = F.col("i"), F.col("j")
    base = spark.range(n).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(i, F.lit(n - 1)))).where("j > i")
    return base.select((i * n - (i * (i + 1) / 2).cast("long") + j - i - 1).alias("edge"), "i", "j", F.concat(F.lit(first), i.cast("string"), F.lit(between + first), j.cast("string")).alias("name"))


def parse_edge(name: Column, first: str = "IC_", between: str = "--") -> Column:
    """(i, j) of an edge's name; null parts where it doesn't have that form."""
    ends = F.split(name, between)
    part = lambda k: F.regexp_extract(F.get(ends, F.lit(k)), f"^{first}(\\d+)$", 1).try_cast("int")
    return F.struct(part(0).alias("i"), part(1).alias("j"))


def range_domain(rows: DataFrame, node: str, domains: DataFrame, other: str = "Other") -> DataFrame:
    """Add `domain` from (lo, hi, domain) ranges, lo inclusive and hi not; nodes outside all get `other`.

    Domains are a small fixed table, so the range join is a broadcast one.
    """
    d = F.broadcast(domains.select("lo", "hi", "domain"))
    return rows.join(d, (F.col(node) >= d["lo"]) & (F.col(node) < d["hi"]), "left").drop("lo", "hi").withColumn("domain", F.coalesce("domain", F.lit(other)))


def domain_case(node: Column, ranges: Sequence[tuple[int, int, str]], other: str = "Other") -> Column:
    """The same as an expression, for ranges that are known when the plan is made."""
    out = F.lit(other)
    for lo, hi, name in reversed(ranges):
        out = F.when((node >= lo) & (node < hi), F.lit(name)).otherwise(out)
    return out


# Components by functional domain (first, last + 1), and domains by tier.
DOMAINS = [(0, 5, "SC"), (5, 7, "AUD"), (7, 16, "SM"), (16, 25, "VS"), (25, 42, "CC"), (42, 49, "DM"), (49, 53, "CB")]
TIERS = {"SM": "sensorimotor", "VS": "sensorimotor", "AUD": "sensorimotor", "CC": "heteromodal", "CB": "heteromodal", "DM": "transmodal", "SC": "transmodal"}
#: Short names of tiers, in the order in which a pair of them is named.
SHORT = {"sensorimotor": "SM", "heteromodal": "HM", "transmodal": "TM"}


def tier(domain: Column, cerebellum: str = "heteromodal") -> Column:
    """Tier of a domain, null for others; `cerebellum` is the tier of CB, which one analysis moves to sensorimotor."""
    known = TIERS | {"CB": cerebellum}
    return F.coalesce(*[F.when(domain == d, F.lit(t)) for d, t in known.items()])


def tier_groups(tier_i: Column, tier_j: Column) -> Column:
    """Groups of an edge between two tiers: its tier and within_all, or between_all and the pair of tiers."""
    short = lambda t: F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in SHORT.items()])
    place = lambda t: F.coalesce(*[F.when(t == k, F.lit(i)) for i, k in enumerate(SHORT)])
    pair = F.when(place(tier_i) < place(tier_j), F.concat(short(tier_i), F.lit("-"), short(tier_j))).otherwise(F.concat(short(tier_j), F.lit("-"), short(tier_i)))
    return F.when(tier_i == tier_j, F.array(tier_i, F.lit("within_all"))).otherwise(F.array(F.lit("between_all"), pair))
