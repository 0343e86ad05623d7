"""Relations across calls, balancing and splitting of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The relation that says nothing, the reciprocal pair and its representative.
NEUTRAL = "기타"
PAIR = ("부모", "자녀")
LEAST = 2
TEACHER, TEACHING = "교사", ("교육/공부", "교육")
BROAD = ("친구", "기타", "부모", "자녀", "배우자", "형제자매")


def consolidated(calls: DataFrame) -> DataFrame:
    """calls(peer_id, relation, call) -> peer_id, relation, confidence, source.

    Two levels of partial aggregation: counts per relation, then the first two of a peer with the pair merged. When
    all calls agree the most frequent relation is returned as it was said, otherwise the merged one.
    """
    peers = calls.select("peer_id").distinct()
    counts = calls.where((F.col("relation") != NEUTRAL) & F.col("relation").isNotNull()).groupBy("peer_id", "relation").agg(F.count("*").alias("n"), F.min("call").alias("first"))
    merged = counts.groupBy("peer_id", F.when(F.col("relation").isin(*PAIR), PAIR[0]).otherwise(F.col("relation")).alias("relation")).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min(F.struct((-F.col("n")).alias("m"), "first", "relation")).alias("said"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "relation", F.col("said.relation").alias("said"))))  # a peer has few relations
    p = merged.groupBy("peer_id").agg(ranked.alias("r"), F.sum("n").alias("total"))
    p = p.select("peer_id", "total", F.size("r").alias("kinds"), F.col("r")[0].alias("a"), (-F.coalesce(F.get("r", F.lit(1))["m"], F.lit(0))).alias("n2"))
    n1 = -F.col("a.m")
    strong = (n1 >= LEAST) & (n1 >= 2 * F.col("n2"))
    one, many = F.col("kinds") == 1, F.col("total") >= LEAST
    two = lambda c: F.round(c, 2)
    out = p.select(
        "peer_id",
        F.when(one, F.col("a.said")).when(strong, F.col("a.relation")).alias("relation"),
        F.when(one & many, two(F.least(F.lit(0.95), 0.6 + 0.1 * F.col("total")))).when(one, 0.5).when(strong, two(F.least(F.lit(0.9), 0.5 + n1 / F.col("total") * 0.4))).otherwise(0.0).alias("confidence"),
        F.when(one & many, "cross_call_consistent").when(one, "single_call").when(strong, "cross_call_dominant").otherwise("conflict").alias("source"),
    )
    return peers.join(out, "peer_id", "left").select("peer_id", "relation", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("source", F.lit("no_signal")).alias("source"))


def crossvalidated(rows: DataFrame) -> DataFrame:
    """rows(relation, topics): only the teacher needs a topic that supports it; adds validated and reason."""
    r = F.col("relation")
    supported = F.coalesce(F.arrays_overlap("topics", F.array(*map(F.lit, TEACHING))), F.lit(False))
    reason = F.when(r.isNull() | r.isin(*BROAD), "broad_or_none").when(r != TEACHER, "no_rule_keep").when(supported, "topic_supported").otherwise("topic_unsupported")
    return rows.withColumn("reason", reason).withColumn("validated", F.when(F.col("reason") != "topic_unsupported", r))


BUCKETS = 1 << 16  # of a seeded hash; a rank is the rows in earlier buckets and the place in its own


def seeded(key: str, seed: int) -> Column:
    """A number below 2^60 from the digest of a key and a seed; other engines can say it too."""
    return F.conv(F.left(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.lit(15)), 16, 10).cast("long")


def _ranked(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """rows with _rank, from 1, in the seeded order of their label. No task gets all rows of a label."""
    h = seeded(key, seed)
    marked = rows.withColumn("_b", F.coalesce(F.pmod(h, F.lit(BUCKETS)), F.lit(-1)))  # no key: before all others
    counts = marked.groupBy(F.col(label).alias("_label"), F.col("_b").alias("_bucket")).agg(F.count("*").alias("_n"))  # BUCKETS rows of a label at most
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("_label", "_bucket", before.alias("_before"))
    met = marked.join(base, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_b") == F.col("_bucket")))
    place = F.row_number().over(Window.partitionBy("_label", "_b").orderBy(h, key))
    return met.withColumn("_rank", F.col("_before") + place).select(*rows.columns, "_rank")


def balanced(rows: DataFrame, label: str, key: str, cap: int | None = None, seed: int = 42) -> DataFrame:
    """As many rows of each label as the rarest has (at most cap), picked by a seeded hash. No label counts as one of its own."""
    least = rows.groupBy(label).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    least = least.withColumn("_least", F.least("_least", F.lit(cap)) if cap else F.col("_least"))
    return _ranked(rows, label, key, seed).crossJoin(F.broadcast(least)).where("_rank <= _least").select(rows.columns)  # one row


def majority_capped(rows: DataFrame, label: str, major: str, ratio: float, key: str, seed: int = 42) -> DataFrame:
    """At most ratio of the result has the major label; rows without a label are no majority and stay."""
    is_major = F.col(label).eqNullSafe(F.lit(major))
    others = rows.where(~is_major)
    most = others.agg(F.floor(F.count("*") * ratio / (1 - ratio)).alias("_most"))
    return _ranked(rows.where(is_major), label, key, seed).crossJoin(F.broadcast(most)).where("_rank <= _most").select(rows.columns).unionByName(others)  # one row


def split(rows: DataFrame, key: str, val: float, seed: int = 42) -> DataFrame:
    """Exactly floor(n * (1 - val)) rows are train. The cut is a quantile of a seeded hash, found from counts of hash
    buckets, so no single task sorts all rows."""
    h = F.coalesce(F.pmod(seeded(key, seed), F.lit(1 << 16)), F.lit(-1))
    marked = rows.withColumn("_b", h)
    counts = marked.groupBy("_b").agg(F.count("*").alias("_n"))  # 65,536 rows at most
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(1))))
    at = F.row_number().over(Window.partitionBy("_b").orderBy(key)) + F.coalesce("_before", F.lit(0))
    joined = marked.join(before.drop("_n"), "_b").withColumn("_at", at)
    return joined.withColumn("part", F.when(F.col("_at") <= F.floor(F.col("_all") * (1 - val)), "train").otherwise("val")).select(*rows.columns, "part")


def group_split(rows: DataFrame, group: str, shares: tuple[float, float, float], seed: int = 42, stratum: str | None = None) -> DataFrame:
    """Train, val and test by whole groups, so that no group is in two parts. Groups of one stratum (a group's smallest value of it) are ranked by a seeded hash, and
    exactly floor(n * shares) of them end where the shares do, in each stratum."""
    label = F.min(stratum) if stratum else F.lit(0)
    groups = rows.groupBy(group).agg(label.alias("_stratum"))
    ranked = _ranked(groups, "_stratum", group, seed)
    total = groups.groupBy("_stratum").agg(F.count("*").alias("_n")).withColumnRenamed("_stratum", "_of")
    met = ranked.join(total, F.col("_stratum").eqNullSafe(F.col("_of")))
    upto = lambda share: F.floor(F.round(F.col("_n") * share, 9))
    part = F.when(F.col("_rank") <= upto(shares[0]), "train").when(F.col("_rank") <= upto(shares[0] + shares[1]), "val").otherwise("test")
    parts = met.select(F.col(group).alias("_group"), part.alias("part"))
    return rows.join(parts, F.col(group).eqNullSafe(F.col("_group"))).select(*rows.columns, "part")
