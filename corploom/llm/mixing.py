"""Mixing sources to target weights by capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import count_tokens

#: Records, about, in a bucket of seeded hashes: tokens are summed by bucket first, and only the bucket at the edge is put in order.
PER_BUCKET = 50_000


def corpus_key(c):
    """A corpus or source name in one spelling: trimmed, lower case, without a .yaml, .yml or .json suffix."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\.(ya?ml|json)$", "")


def water_fill(weights: list[int], capacity: list[int], planned: int) -> list[Fraction]:
    """Tokens of each source: proportional to weight, no more than capacity; what is cut off goes to the others by weight.

    Sources at their capacity are fixed and the rest is shared anew until nothing exceeds it; if all are at capacity
    the total stays below ``planned``.
    """
    given = [Fraction(0)] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0]
    rest = Fraction(planned)
    while open_ and rest > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] >= capacity[i] * total]
        if not full:
            for i in open_:
                given[i] = rest * weights[i] / total
            break
        for i in full:
            given[i] = Fraction(capacity[i])
        rest -= sum(given[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return given


def source_tokens(rows: DataFrame, path: str | None = None) -> DataFrame:
    """row_id, source, key and n_tokens of every row; a null text has 0 tokens."""
    counted = count_tokens(rows.select("row_id", "text", "source"), path=path)
    return counted.select("row_id", "source", corpus_key(F.col("source")).alias("key"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def _wanted(weights: DataFrame, stages: DataFrame) -> DataFrame:
    """stage, key, weight, max_repeats, of (sum of weights) and planned_tokens; one row per stage and source, whatever its spellings."""
    w = weights.where(F.col("weight") > 0).groupBy("stage", corpus_key(F.col("corpus")).alias("key"))
    w = w.agg(F.sum("weight").alias("weight"), F.max(F.greatest("max_repeats", F.lit(0))).alias("max_repeats"))
    of = w.groupBy("stage").agg(F.sum("weight").alias("of"))
    s = stages.select(F.col("name").alias("stage"), "planned_tokens", F.coalesce("seed", F.lit(0)).alias("seed"))
    return w.join(of, "stage").join(s, "stage")


def short_sources(rows: DataFrame, weights: DataFrame, stages: DataFrame, path: str | None = None) -> DataFrame:
    """stage, source of sources that cannot reach their share: max_repeats x tokens < weight / sum x planned_tokens.

    source is spelled as in rows (the first spelling if there are several). One without rows is named by its key: the
    name in weights without outer blanks, capitals and a suffix of a file, which is how the rows of a source are spelled.
    """
    have = source_tokens(rows, path).groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.min("source").alias("source"))
    wanted = _wanted(weights, stages).join(have, "key", "left")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    short = F.coalesce("tokens", F.lit(0)).cast("decimal(19,0)") * exact("max_repeats") * exact("of") < exact("weight") * exact("planned_tokens")
    return wanted.where(short).select("stage", F.coalesce("source", "key").alias("source"))


def plan(have: DataFrame, weights: DataFrame, stages: DataFrame) -> list[dict]:
    """The tokens each stage takes from each source. have: key, tokens. The weights table does not grow with the corpus."""
    found = _wanted(weights, stages).join(have, "key", "left").collect()
    plans = []
    for stage in sorted({r["stage"] for r in found}):
        part = sorted((r for r in found if r["stage"] == stage), key=lambda r: r["key"])
        capacity = [(r["tokens"] or 0) * r["max_repeats"] for r in part]
        for r, goal in zip(part, water_fill([r["weight"] for r in part], capacity, part[0]["planned_tokens"])):
            tokens = r["tokens"] or 0
            whole = int(goal // tokens) if tokens else 0
            plans.append(r.asDict() | {"tokens": tokens, "goal": int(goal), "whole": whole, "part": int(goal - whole * tokens)})
    return plans


def mix(rows: DataFrame, weights: DataFrame, stages: DataFrame, path: str | None = None, per_bucket: int = PER_BUCKET) -> DataFrame:
    """The mix: stage, source, row_id, copies (1 or more), n_tokens (of one copy).

    Every record of a source is used ``whole`` times; of the fraction left, records in the order of a hash of the
    stage's seed and row_id are used once more while more than half of them lies within it, so a source misses its
    goal by less than one record. No source is sorted whole: the fraction is first found among hash buckets, whose number
    follows that of the records, and only the bucket that it ends in is put in order. Rows without tokens are not used.
    """
    from ..session import checkpoint

    spark = rows.sparkSession
    counted = checkpoint(source_tokens(rows, path).where("n_tokens > 0"))
    buckets = max(64, counted.count() // per_bucket)
    plans = plan(counted.groupBy("key").agg(F.sum("n_tokens").alias("tokens")), weights, stages)
    schema = "stage string, key string, seed long, whole long, part long"
    goals = spark.createDataFrame([tuple(p[k] for k in ("stage", "key", "seed", "whole", "part")) for p in plans], schema)
    each = counted.join(F.broadcast(goals), "key").withColumn("h", F.xxhash64("seed", "stage", "row_id"))
    each = each.withColumn("b", F.pmod("h", F.lit(buckets)))
    sums = each.groupBy("stage", "key", "b", "part").agg(F.sum("n_tokens").alias("tokens"))
    from pyspark.sql import Window

    order = Window.partitionBy("stage", "key").orderBy("b")
    before = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    edge = sums.withColumn("before", before).where((F.col("before") <= F.col("part")) & (F.col("before") + F.col("tokens") > F.col("part")))
    edge = edge.select("stage", "key", F.col("b").alias("edge"), F.col("part") - F.col("before"))
    edge = edge.toDF("stage", "key", "edge", "left")
    placed = each.join(F.broadcast(edge), ["stage", "key"], "left")
    inside = placed.where(F.col("b") == F.col("edge"))
    run = Window.partitionBy("stage", "key").orderBy("h", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = inside.withColumn("extra", (F.sum("n_tokens").over(run) - F.col("n_tokens") / 2 <= F.col("left")).cast("long"))
    outside = placed.where(F.col("edge").isNull() | (F.col("b") != F.col("edge")))
    outside = outside.withColumn("extra", (F.col("edge").isNotNull() & (F.col("b") < F.col("edge"))).cast("long"))
    both = outside.unionByName(chosen).withColumn("copies", F.col("whole") + F.col("extra"))
    return both.where("copies > 0").select("stage", "source", "row_id", "copies", "n_tokens")


def mix_shares(mixed: DataFrame, weights: DataFrame, stages: DataFrame) -> DataFrame:
    """Target and actual shares of a mix: stage, source, records, tokens, target_share, actual_share (of planned_tokens)."""
    used = mixed.groupBy("stage", corpus_key(F.col("source")).alias("key")).agg(F.min("source").alias("source"), F.sum("copies").alias("records"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    w = _wanted(weights, stages).join(used, ["stage", "key"], "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return w.select("stage", F.coalesce("source", "key").alias("source"), F.coalesce("records", F.lit(0)).alias("records"), tokens.alias("tokens"), F.round(F.col("weight") / F.col("of"), 6).alias("target_share"), F.round(tokens / F.col("planned_tokens"), 6).alias("actual_share"))
