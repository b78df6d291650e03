"""Mixing sources to target weights by Efraimidis-Spirakis sampling within each source."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.llm.common import WORD, cut, stored

#: Characters that prose rarely has; many of them make a document come late.
SYMBOLS = r"[#$%&*!@^~|<>{}\[\]\\]"
#: Keys a range holds, about; only one range a source is ever put in order.
RANGE_ROWS = 200_000
MIN_RANGES, MAX_RANGES = 16, 20_000


def words_of(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """Weight above 0, 1 at most: 1 / (1 + 100 times the share of symbols); empty and null: 1."""
    share = F.try_divide(F.regexp_count(text, F.lit(SYMBOLS)), F.char_length(text))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.lit(100.0) * F.nullif(share, F.lit(0.0))), F.lit(1.0))


def sampling_key(doc_id: Column, size: Column, weight: Column, seed: str) -> Column:
    """Exponential key: -ln(u) / weight, u in (0, 1) from the id and the size, so that reruns agree."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    return -F.log(u) / weight


def targets(sizes: dict[str | None, int], weights: list[int], share: Fraction, most: int) -> dict[str | None, float]:
    """Words wanted of each source: `share` of all words dealt by weight, `most` times its size at most.

    Sources in order of code points, null last, take the weights in turn. What is above the bound goes to the others by
    weight, until none is above; this ends at min(bound, level * weight) for one common level.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    bound = {s: Fraction(most) * sizes[s] for s in order}
    left, weighing = share * sum(sizes.values()), sum(weight.values())
    level = Fraction(0)
    for s in sorted(order, key=lambda s: bound[s] / weight[s]):
        level = left / weighing
        if bound[s] > level * weight[s]:
            break
        left, weighing = left - bound[s], weighing - weight[s]
    else:
        level = None
    return {s: round(float(bound[s] if level is None else min(bound[s], level * weight[s])), 6) for s in order}


def key_ranges(slim: DataFrame, ranges: int) -> DataFrame:
    """Words of each source and key in ranges of about equal rows: `_source`, `_key`, `_tied`, `_range`.

    Rows of one source and key are one first, so neither a hot source nor a document repeated any number of times makes
    a long range, whatever the weights do to the keys. Written once, so that a row keeps its range when an executor is lost.
    """
    tied = slim.groupBy("_source", "_key").agg(F.sum("_size").alias("_tied"))
    dealt = tied.repartitionByRange(ranges, "_source", "_key")
    return stored(dealt.withColumn("_range", F.spark_partition_id()), "keys")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: Fraction = Fraction(3, 2),
    most: int = 2,
    seed: str = "mix",
    max_sources: int = 100_000,
    keep_columns: bool = False,
) -> DataFrame:
    """Every document with `size`, `source_size`, `target` and `taken`, the words of it that the mix takes.

    A source is taken whole as often as its target holds it; the rest of the target goes to its documents in the order
    of their keys, until the words are used up: the last one gives just the words that are missing. Documents with the
    same key (repeated rows) share alike, rounded down. Words taken of a source are its target, rounded down.

    Null and empty texts have size 0 and give nothing, null sources form a source of their own, and an empty table
    gives no rows. With `keep_columns` the columns of `docs` come first; its column names do not matter unless they are
    those added here, which are replaced.

    Texts are not shuffled. A source may hold any share of the rows: keys are dealt to ranges of equal rows, sums per
    source and range find the range in which the target ends, and only that one is put in order. What reaches the driver
    are `max_sources` sums at most; more sources than that are refused.
    """
    spark = docs.sparkSession
    size = words_of(F.col(text))
    key = sampling_key(F.col(doc_id), size, quality_of(F.col(text)), seed)
    own = {"_source": F.col(source), "_size": size, "_key": key}
    slim = cut(docs.select(F.col(doc_id).alias("_id"), *[c.alias(n) for n, c in own.items()]))
    sums = slim.groupBy("_source").agg(F.sum("_size"), F.count("*")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {s: n for s, n, _ in sums}
    goal = targets(sizes, list(weights), share, most)
    plan = []
    for s, n in sizes.items():
        epochs = int(goal[s] // n) if n else 0
        plan.append((s, n, goal[s], epochs, int(goal[s]) - epochs * n))
    schema = "_of string, source_size long, target double, _epochs long, _rest long"
    per_source = spark.createDataFrame(plan, schema)

    rows = sum(c for _, _, c in sums)
    keyed = key_ranges(slim, min(MAX_RANGES, max(MIN_RANGES, rows // RANGE_ROWS)))
    counted = keyed.groupBy("_source", "_range").agg(F.sum("_tied").alias("_words"))
    running = F.sum("_words").over(Window.partitionBy("_source").orderBy("_range"))
    counted = counted.withColumn("_until", running)
    counted = counted.join(F.broadcast(per_source), F.col("_source").eqNullSafe(F.col("_of")))
    ends_in = counted.filter("_rest > 0 and _until >= _rest and _until - _words < _rest")
    ends_in = ends_in.select("_of", F.col("_range").alias("_last"), (F.col("_rest") - F.col("_until") + F.col("_words")).alias("_left"))
    ends_in = spark.createDataFrame(ends_in.collect(), "_of string, _last int, _left long")
    # Only the range in which a source's words run out is put in order.
    last = keyed.join(F.broadcast(ends_in), F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_last")))
    running = F.sum("_tied").over(Window.partitionBy("_of").orderBy("_key"))
    last = last.withColumn("_until", running).filter("_until >= _left and _until - _tied < _left")
    ends_at = last.select("_of", F.col("_key").alias("_end"), "_tied", (F.col("_left") - F.col("_until") + F.col("_tied")).alias("_words")).collect()
    ends_at = spark.createDataFrame(ends_at, "_of string, _end double, _tied long, _words long")

    known = per_source.join(ends_at.withColumnRenamed("_of", "_at"), F.col("_of").eqNullSafe(F.col("_at")), "left").drop("_at")
    added = ["size", "source_size", "target", "taken"]
    if keep_columns:
        base = docs.drop(*added).withColumns(own)
    else:
        base = slim.withColumnRenamed("_id", doc_id)
    joined = base.join(F.broadcast(known), F.col("_source").eqNullSafe(F.col("_of")))
    part = F.floor(F.col("_words") * F.col("_size") / F.col("_tied"))
    rest = F.when(F.col("_rest") == 0, 0).when(F.col("_key") < F.col("_end"), F.col("_size"))
    rest = rest.when(F.col("_key") == F.col("_end"), part).otherwise(0)
    taken = (F.col("_size") * F.col("_epochs") + rest).cast("long")
    joined = joined.withColumns({"size": F.col("_size"), "taken": taken})
    return joined.select(*(docs.drop(*added).columns if keep_columns else [doc_id]), *added)
