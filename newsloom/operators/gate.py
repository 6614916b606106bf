"""Which stories a publish policy lets through, and why it holds others back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ["all", "audited", "bilingual", "verified"]


def _yes(name: str) -> Column:
    return F.coalesce(F.col(f"quality.{name}"), F.lit(False))


def publishable(policy: str) -> Column:
    """Whether a row passes; an unknown policy is "audited". Each policy admits a part of what the one before it does."""
    if policy not in POLICIES:
        policy = "audited"
    ok = F.lit(True)
    if policy != "all":
        ok = (F.coalesce("summary", F.lit("")) != "") & _yes("audited")
    if policy in ("bilingual", "verified"):
        ok = ok & _yes("bilingual")
    if policy == "verified":
        ok = ok & _yes("verified")
    return ok


def reason() -> Column:
    """Why a row is withheld, as far as its quality tells."""
    return F.when(F.coalesce("summary", F.lit("")) == "", "no body text").when(~_yes("audited"), "not audited").when(~_yes("bilingual"), "not bilingual").when(F.col("quality.verified").eqNullSafe(False), "failed verification").otherwise("not yet verified")


def withheld(df: DataFrame, policy: str) -> DataFrame:
    """(reason, n) of the rows that the policy holds back."""
    return df.where(~publishable(policy)).groupBy(reason().alias("reason")).agg(F.count("*").alias("n"))


def preview(df: DataFrame) -> DataFrame:
    """(policy, n): how many rows each policy would let through, in one pass."""
    counts = df.agg(*[F.count_if(publishable(p)).alias(p) for p in POLICIES])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(p) for p in POLICIES]), F.array(*POLICIES))).alias("policy", "n"))


def share_warnings(df: DataFrame, least: float = 0.25) -> DataFrame:
    """(policy, n, kept, warn): whether a policy lets less than ``least`` of the feed through, which looks like a feed that has stopped."""
    total = df.agg(F.count("*").alias("n"), *[F.count_if(publishable(p)).alias(p) for p in POLICIES])
    kept = total.select("n", F.explode(F.map_from_arrays(F.array(*[F.lit(p) for p in POLICIES]), F.array(*POLICIES))).alias("policy", "kept"))
    return kept.select("policy", "n", "kept", ((F.col("n") > 0) & (F.col("kept") < F.col("n") * least)).alias("warn"))
