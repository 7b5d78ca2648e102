"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight; a source's documents in the order of their keys
are a weighted sample without replacement, cut where the running sum of tokens reaches the source's budget. Budgets
above one epoch take complete epochs first and sample only the fraction that is left.

The running sum needs no sort of a whole source: keys fall into ``BUCKETS`` ordered buckets between the quantiles of the
source's own keys (a mergeable sketch), whatever the weights are; the sums of the buckets are accumulated, and only the
one bucket in which the budget ends, about a 512th of the source, is put in order.

Defined results: T is the sum of all sizes, of sources outside the mix and of a null source too; a null or negative size
counts as 0 and such a document is taken with those of its key; a null source matches no target; equal keys go by id;
a mix row with a null weight or cap counts as 0; a source without documents gives a row with 0 tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from komagrid.session import cut

#: A power of two: the buckets of a source's keys, found in as many steps as it has bits.
BUCKETS = 512
MAX_TARGETS = 10_000


def quality_weight(n_chars: str = "n_chars") -> Column:
    """The default weight of a document: from 0.25 for a scrap to 1 at 400 characters and more."""
    return F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.coalesce(F.col(n_chars), F.lit(0)) / F.lit(400.0)))


def sample_key(item: str, seed: int, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1] from a hash of the id: the same draw on every run and every cluster."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(item).cast("string")), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))
    return -F.log(u) / F.greatest(weight, F.lit(1e-6))


def checked_targets(targets: DataFrame) -> DataFrame:
    """The targets, a dimension of at most ``MAX_TARGETS`` rows: more is an error, as their plan is broadcast."""
    if targets.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"a mix has more than {MAX_TARGETS} targets; its plan cannot be held by each worker")
    return targets


def _sized(docs: DataFrame, targets: DataFrame, item: str, size: str, weight: Column | None, seed: int) -> DataFrame:
    """(item, source, size, key, bucket) of all documents; the bucket is 0 for sources outside the mixes."""
    key = sample_key(item, seed, weight if weight is not None else quality_weight())
    sized = docs.select(F.col(item).alias("item"), "source", F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size"), key.alias("key"))
    sources = checked_targets(targets).select("source").where("source is not null").distinct()
    parts = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    bounds = cut(sized.join(F.broadcast(sources), "source").groupBy("source").agg(F.percentile_approx("key", parts, 10 * BUCKETS).alias("bounds")))
    # how many bounds lie below the key, by bisection
    steps = F.array(*[F.lit(BUCKETS >> i) for i in range(1, BUCKETS.bit_length())])
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("bounds", at + step - 1) < F.col("key"), at + step).otherwise(at))
    return sized.join(F.broadcast(bounds), "source", "left").withColumn("bucket", F.when(F.col("bounds").isNull(), F.lit(0)).otherwise(bucket)).drop("bounds")


def plan_mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: what it should give and can give, and in which bucket its fraction ends."""
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
    by_source = sums.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    total = by_source.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("total_tokens")).scalar()
    wanted = targets.select(
        "mix_name", "source", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")
    )
    mix = wanted.join(by_source, "source", "left").withColumn("total_tokens", total).withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    target = F.col("weight") * F.col("total_tokens")
    most = F.col("max_repeats") * F.col("source_tokens")
    mix = mix.withColumn("target_tokens", target).withColumn("capped", target > most).withColumn("budget", F.least(target, most.cast("double")))
    epochs = F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.col("source_tokens"))).otherwise(F.lit(0)).cast("bigint")
    mix = mix.withColumn("epochs", epochs).withColumn("fraction_tokens", F.col("budget") - F.col("epochs") * F.col("source_tokens"))
    order = Window.partitionBy("source").orderBy("bucket")
    running = sums.withColumn("after", F.sum("tokens").over(order)).withColumn("before", F.col("after") - F.col("tokens"))
    ends = (
        mix.join(running, "source", "left")
        .where(F.col("before") <= F.col("fraction_tokens"))
        .groupBy("mix_name", "source")
        .agg(F.max(F.struct("bucket", "before")).alias("end"))
    )
    return mix.join(ends, ["mix_name", "source"], "left").select(
        *mix.columns, F.coalesce("end.bucket", F.lit(-1)).alias("end_bucket"), F.coalesce("end.before", F.lit(0)).alias("end_before")
    )


def _drawn(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(mix_name, source, item, size, copies) of the documents used at least once."""
    # the plan has a row for each target: at most MAX_TARGETS
    chosen = sized.where("source is not null").join(F.broadcast(plan), "source")
    border = chosen.where("bucket = end_bucket and fraction_tokens > 0")
    order = Window.partitionBy("mix_name", "source").orderBy("key", "item")
    border = border.withColumn("upto", F.col("end_before") + F.sum("size").over(order)).withColumn("taken", (F.col("upto") <= F.col("fraction_tokens")).cast("int"))
    rest = chosen.where("not (bucket = end_bucket and fraction_tokens > 0)").withColumn(
        "taken", ((F.col("bucket") < F.col("end_bucket")) & (F.col("fraction_tokens") > 0)).cast("int")
    )
    columns = ["mix_name", "source", "item", "size", (F.col("epochs") + F.col("taken")).alias("copies")]
    return rest.select(*columns).unionByName(border.select(*columns)).where("copies > 0")


def mix(docs: DataFrame, targets: DataFrame, item: str = "doc_id", size: str = "n_tokens", weight: Column | None = None, seed: int = 17) -> DataFrame:
    """The mixes: mix_name, source, ``item``, size, copies (how often the document is used, at least once)."""
    sized = _sized(docs, targets, item, size, weight, seed)
    return _drawn(sized, cut(plan_mix(sized, targets))).withColumnRenamed("item", item)


def mix_report(docs: DataFrame, targets: DataFrame, item: str = "doc_id", size: str = "n_tokens", weight: Column | None = None, seed: int = 17) -> DataFrame:
    """Per mix and source: target and actual tokens and shares, epochs, and whether the cap on repeats holds it back.

    ``exhausted``: all permitted epochs are in the mix and what it holds is still short of the target.
    """
    sized = _sized(docs, targets, item, size, weight, seed)
    plan = cut(plan_mix(sized, targets))
    got = _drawn(sized, plan).groupBy("mix_name", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("n_documents"))
    both = plan.join(got, ["mix_name", "source"], "left")
    share = F.col("actual_tokens") / F.nullif(F.sum("actual_tokens").over(Window.partitionBy("mix_name")), F.lit(0))
    both = both.withColumn("share", share).withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    used_up = (F.col("epochs") >= F.col("max_repeats")) | (F.col("source_tokens") == 0)
    return both.select(
        "mix_name", "source", F.col("weight").alias("target_share"), "target_tokens", "actual_tokens", F.coalesce("share", F.lit(0.0)).alias("actual_share"),
        "epochs", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "capped", (used_up & (F.col("actual_tokens") < F.col("target_tokens"))).alias("exhausted"),
    )
