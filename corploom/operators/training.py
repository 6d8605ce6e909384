"""Training views: held-out sets, orders, packing, budgets, schedules and forecasts."""

from __future__ import annotations

from decimal import Decimal
from math import ceil, lcm

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def score(seed: int, name: Column) -> Column:
    """SHA-256 of the seed (eight bytes, big-endian) and a name, in hexadecimal."""
    return F.sha2(F.concat(F.lit(bytes((seed & MASK).to_bytes(8, "big"))), F.encode(name, "UTF-8")), 256)


def holdout(records: DataFrame, seed: int, fraction: float = 0.01, most: int = 256, budget: int = 1 << 20) -> DataFrame:
    """The held-out records: id, size of the records with the lowest scores; ids are unique, size is in bytes.

    n = min(ceil(fraction x N), most, N - 1), at least 1 for two records or more. Records that exceed what is left of
    the byte budget are passed over. Nothing is held out if fraction, most or budget is 0. Only ids and sizes of at
    most ``most`` x 8 candidates reach the one task that fills the budget; if they do not fill it, all are tried.
    """
    if not (fraction > 0 and most > 0 and budget > 0):
        return records.select("id", "size").limit(0)
    total = records.count()
    n = min(-(-int(total * fraction * 10**9) // 10**9), most, total - 1)
    if total >= 2:
        n = max(n, 1)
    scored = records.select("id", "size", score(seed, F.col("id")).alias("score")).where(F.col("size") <= budget)

    def fill(batches):
        left, count = budget, 0
        for pdf in batches:
            keep = []
            for size in pdf["size"]:
                ok = count < n and size <= left
                keep.append(ok)
                if ok:
                    left, count = left - size, count + 1
            yield pdf.loc[keep, ["id", "size"]]

    for candidates in (most * 8, None):
        ordered = scored.orderBy("score", "id")
        got = (ordered.limit(candidates) if candidates else ordered).coalesce(1).mapInPandas(fill, "id string, size long")
        if candidates is None or total <= candidates or got.count() >= n:
            return got
    return got


def stratified_holdout(records: DataFrame, seed: int, fraction: float = 0.01, most: int = 256, budget: int = 1 << 20) -> DataFrame:
    """The held-out records, corpora in turns: corpus, id, size; ids are unique, size is in bytes.

    n = min(ceil(fraction x N), most, N - 1), at least 1 for two records or more. Round by round, the corpora (in the
    order of their names) each give the record with the next lowest score; one that exceeds what is left of the byte
    budget is passed over. Only the ``most`` lowest scores of a corpus are candidates; if the first ``most`` x 8 do
    not fill the set, all are tried.
    """
    total = records.count()
    if not (fraction > 0 and most > 0 and budget > 0 and total >= 2):
        return records.select("corpus", "id", "size").limit(0)
    n = max(1, min(ceil(total * fraction), most, total - 1))
    w = Window.partitionBy("corpus").orderBy("score", "id")
    ranked = records.select("corpus", "id", "size", score(seed, F.col("id")).alias("score")).withColumn("round", F.row_number().over(w)).where(F.col("round") <= most)

    def fill(batches):
        left, count = budget, 0
        for pdf in batches:
            keep = []
            for size in pdf["size"]:
                ok = count < n and size <= left
                keep.append(ok)
                if ok:
                    left, count = left - size, count + 1
            yield pdf.loc[keep, ["corpus", "id", "size"]]

    for candidates in (most * 8, None):
        some = ranked.orderBy("round", "corpus").limit(candidates) if candidates else ranked
        got = some.repartition(1).sortWithinPartitions("round", "corpus").mapInPandas(fill, "corpus string, id string, size long")
        if candidates is None or total <= candidates or got.count() >= n:
            return got
    return got


def weighted_order(records: DataFrame, weights: dict[str, int]) -> DataFrame:
    """records (corpus, seq, tokens) with ``place``: corpora take turns so that each has its weight's share of tokens.

    A record comes by the tokens its corpus gave before it, divided by the weight, ties by corpus: a sort instead of a
    pull loop. The division is exact (weights are scaled to their least common multiple). Prefix sums are taken
    within hashed ranges first, so no corpus is summed in one task.
    """
    whole = lcm(*weights.values())
    scale = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, whole // w)])
    before = prefix_sums(records.where(F.col("corpus").isin(*weights)), ["corpus"], "seq", "tokens")
    key = F.col("before").cast("decimal(20,0)") * scale[F.col("corpus")].cast("decimal(18,0)")
    return before.withColumn("key", key)


def stage_order(records: DataFrame, weights: DataFrame) -> DataFrame:
    """weighted_order of every stage of weights (stage, corpus, weight; some rows in all): stage, corpus, seq, before, weight, key.

    The weights of one corpus in a stage add up; corpora with no weight in a stage are not in its order. The key is
    exact in 38 digits; one that does not fit is an error.
    """
    total: dict[str, dict[str, int]] = {}
    for r in weights.where("weight > 0").groupBy("stage", "corpus").agg(F.sum("weight").cast("bigint").alias("weight")).collect():
        total.setdefault(r["stage"], {})[r["corpus"]] = r["weight"]
    scales = [(stage, corpus, w, Decimal(lcm(*each.values()) // w)) for stage, each in total.items() for corpus, w in each.items()]
    scale = records.sparkSession.createDataFrame(scales, "stage string, corpus string, weight long, scale decimal(38,0)")
    both = prefix_sums(records, ["corpus"], "seq", "tokens").join(F.broadcast(scale), "corpus")
    return both.select("stage", "corpus", "seq", "before", "weight", (F.col("before").cast("decimal(20,0)") * F.col("scale")).alias("key"))


def balanced_order(records: DataFrame) -> DataFrame:
    """weighted_order of all corpora with the same weight: the key is what the corpus gave before."""
    return prefix_sums(records, ["corpus"], "seq", "tokens").withColumn("key", F.col("before"))


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, width: int = 100_000) -> DataFrame:
    """df with ``before``: the sum of ``value`` over the earlier rows (by the unique integer ``order``) of the same keys.

    Ranges of ``width`` order numbers are summed first; a row's sum is its range's start plus what is before it there.
    """
    block = F.floor(F.col(order) / width).cast("bigint")
    sums = df.groupBy(*keys, block.alias("_b")).agg(F.sum(value).cast("bigint").alias("_s"))
    start = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*keys, "_b", F.coalesce(start, F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    both = df.withColumn("_b", block).withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, [*keys, "_b"])
    return both.withColumn("before", (F.col("_start") + F.col("_in")).cast("bigint")).drop("_b", "_in", "_start")


def pack_windows(records: DataFrame, length: int) -> DataFrame:
    """window, targets: continuous packing of records (seq, tokens) with an end token each into windows of ``length`` targets.

    The token at place p (from 0) is a target for p >= 1 and belongs to window (p - 1) div length. Where records have
    ``silent`` (tokens at their beginning that are read but not learnt), those are no targets. Windows without a target
    are left out.
    """
    silent = F.coalesce("silent", F.lit(0)) if "silent" in records.columns else F.lit(0)
    placed = prefix_sums(records.withColumn("one", F.lit(1)).withColumn("t", F.col("tokens") + 1), ["one"], "seq", "t")
    first = F.greatest(F.col("before") + silent, F.lit(1))
    last = F.col("before") + F.col("t") - 1
    spans = placed.where(last >= first).select(first.alias("a"), last.alias("b"))
    each = spans.select("a", "b", F.explode(F.sequence(((F.col("a") - 1) / length).cast("bigint"), ((F.col("b") - 1) / length).cast("bigint"))).alias("window"))
    low, high = F.greatest("a", F.col("window") * length + 1), F.least("b", (F.col("window") + 1) * length)
    return each.groupBy("window").agg(F.sum(high - low + 1).cast("bigint").alias("targets"))


def epoch_order(records: DataFrame, seed: int, epochs: int, name: Column) -> DataFrame:
    """records once for each epoch (from 0) with ``order_key``: every epoch has an order of its own, by its seed."""
    key = F.sha2(F.concat(F.lit(bytes((seed & MASK).to_bytes(8, "big"))), F.encode(F.concat(F.col("epoch").cast("string"), F.lit(":"), name), "UTF-8")), 256)
    return records.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("order_key", key)


#: Objectives that a type of stage may have.
OBJECTIVES = {"pre-training": ("causal-language-modeling",), "fine-tuning": ("causal-language-modeling", "assistant-response-modeling")}


def stage_problems(stages: DataFrame, actual: DataFrame) -> DataFrame:
    """stage, problem of stages (name, type, objective, corpus_bom_sha256, files, docs, tokens, bytes) that cannot be run on what was selected.

    actual: stage, files, docs, tokens, bytes of the selected objects. A null declaration of a total is no problem, an
    unknown type, an objective that the type does not have, no pinned selection, no objects, and other totals are.
    """
    kinds = F.create_map(*[F.lit(x) for k, v in OBJECTIVES.items() for x in (k, ",".join(v))])
    j = stages.join(actual.select(F.col("stage").alias("name"), F.struct("files", "docs", "tokens", "bytes").alias("_a")), "name", "left")
    wrong = lambda c: F.when(F.col("_a").isNotNull() & F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_a.{c}")), F.lit(c))
    tests = F.array(
        F.when(kinds[F.col("type")].isNull(), "type"), F.when(kinds[F.col("type")].isNotNull() & ~F.coalesce(F.array_contains(F.split(kinds[F.col("type")], ","), F.col("objective")), F.lit(False)), "objective"),
        F.when(~F.coalesce(F.col("corpus_bom_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "selection"), F.when(F.col("_a").isNull(), "inputs"), *[wrong(c) for c in ("files", "docs", "tokens", "bytes")],
    )
    return j.select(F.col("name").alias("stage"), F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("problem"))


def steps_for_tokens(tokens: int, batch: int, length: int) -> int:
    """Steps of batch x length tokens that hold a budget."""
    return -(-tokens // (batch * length))


def byte_targets(texts: DataFrame, epochs: int = 1) -> DataFrame:
    """targets: byte tokens with an end token each, but for the first token of all; over several epochs in a row."""
    n = F.sum(F.octet_length("text") + 1)
    return texts.agg((n * epochs - 1).cast("bigint").alias("targets"))


class SplitMix:
    """The splitmix64 generator."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        return z ^ (z >> 31)


def record_bytes(selection: Column, record: Column, text: Column, *others: Column) -> Column:
    """What a record counts in a shuffle's buffer: seven string headers, its two ids, text, and other strings (source, licence, language, corpus)."""
    out = F.lit(7 * 16).cast("bigint")
    for c in (selection, record, text, *others):
        out = out + F.coalesce(F.octet_length(c), F.lit(0))
    return out


def bounded_shuffle(records: DataFrame, seed: int, epoch: int = 0, most: int = 1024, most_bytes: int = 64 << 20) -> DataFrame:
    """records (corpus, shard, row, size) with ``place``, a position in the corpus's bounded shuffle: sequential by definition, one corpus per task.

    Shards are permuted first; then rows pass a buffer bounded by records and bytes from which a random one is drawn.
    A record larger than the byte bound passes at once. For orders of any size use seeded_order. The seeds and the
    order of the draws are those of the named policy: another order would be another policy.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "row"], ignore_index=True)
        shards = list(dict.fromkeys(pdf["shard"]))
        a = SplitMix(seed + epoch * 0x9E3779B97F4A7C15)
        for i in range(len(shards) - 1, 0, -1):
            j = a.next() % (i + 1)
            shards[i], shards[j] = shards[j], shards[i]
        groups = {s: g for s, g in pdf.groupby("shard", sort=False)}
        b = SplitMix(seed ^ 0x6A09E667F3BCC909 ^ (epoch * 0xBF58476D1CE4E5B9 & MASK))
        out, buffer, held = [], [], 0

        def draw():
            nonlocal held
            k = b.next() % len(buffer)
            buffer[k], buffer[-1] = buffer[-1], buffer[k]
            item = buffer.pop()
            held -= item[1]
            out.append(item[0])

        for s in shards:
            for index, size in zip(groups[s].index, groups[s]["size"]):
                if size > most_bytes:
                    out.append(index)
                    continue
                while buffer and (len(buffer) >= most or held + size > most_bytes):
                    draw()
                buffer.append((index, size))
                held += size
        while buffer:
            draw()
        result = pdf.loc[out, ["corpus", "shard", "row"]]
        return result.assign(place=range(len(result)))

    return records.groupBy("corpus").applyInPandas(run, "corpus string, shard string, row long, place long")


def seeded_order(df: DataFrame, seed: int, name: Column) -> DataFrame:
    """df with ``order_key``: a hash of seed and name, by which any number of rows can be sorted in parallel."""
    return df.withColumn("order_key", score(seed, name))


def cosine_schedule(spark, steps: int, warmup: int, ratio: float = 0.1) -> DataFrame:
    """step, rate (relative to the peak): linear warm-up, then a cosine down to ``ratio``."""
    s = F.col("id")
    progress = (s - warmup) / F.lit(max(1, steps - warmup))
    rate = F.when(s < warmup, (s + 1) / F.lit(max(1, warmup))).otherwise(F.lit(ratio) + (1 - ratio) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))
    return spark.range(steps).select(s.alias("step"), F.round(rate, 9).alias("rate"))


#: Accelerators with memory (GiB) and effective TFLOPS of one device, and scaling by number of devices.
ACCELERATORS = [
    ("M4 Max 40-core GPU", 128, 18.0, {1: 1.0}),
    ("M5 Max GPU", 128, 27.0, {1: 1.0}),
    ("GeForce RTX 5090", 32, 125.0, {1: 1.0, 4: 0.60, 8: 0.45}),
    ("RTX PRO 6000 Blackwell", 96, 140.0, {1: 1.0, 4: 0.65, 8: 0.50}),
    ("H100 SXM", 80, 300.0, {1: 1.0, 4: 0.82, 8: 0.76}),
    ("H200 SXM", 141, 330.0, {1: 1.0, 4: 0.84, 8: 0.78}),
    ("GB10 Grace Blackwell", 128, 40.0, {1: 1.0, 2: 0.70, 4: 0.50}),
    ("Instinct MI325X", 256, 280.0, {1: 1.0, 4: 0.80, 8: 0.72}),
    ("Instinct MI350X", 288, 400.0, {1: 1.0, 4: 0.82, 8: 0.75}),
]

#: Share of time beside computing, share of memory that stays free, bytes of optimiser state per parameter, of activations and logits per element, and of the runtime.
OVERHEAD, FREE, STATE_BYTES, ACTIVATION_BYTES, LOGIT_BYTES, RUNTIME = 1.08, 10, 16, 72, 6, 4 << 30


def accelerators(spark) -> DataFrame:
    """device, gib, tflops (of all devices together), gpus."""
    rows = [(name, gib, float(t * n * s), n) for name, gib, t, scaling in ACCELERATORS for n, s in scaling.items()]
    return spark.createDataFrame(rows, "device string, gib int, tflops double, gpus int")


def forecast(stages: DataFrame, shape: dict, measured: DataFrame | None = None) -> DataFrame:
    """device, gpus, required (bytes a device), tflops, seconds, estimate of training all stages, on every accelerator that has the memory; slowest first.

    stages: planned_tokens, batch_size (null counts as 1), sequence_length. shape: vocabulary, hidden, layers and the
    arguments of decoder_parameters. A device holds its part of the sharded state (16 bytes a parameter), the
    activations and logits of a whole batch of the largest stage, and the runtime, within nine tenths of its memory.
    measured: device, gpus, tflops of observed runs (calibrations()), which replace the catalogue's throughput and need
    no overhead. Without planned tokens the seconds are -1, with any at least 1.
    """
    parameters = decoder_parameters(**shape)
    batch = F.coalesce("batch_size", F.lit(1)).cast("bigint") * F.col("sequence_length")
    work = batch * F.lit(shape["hidden"] * shape["layers"] * ACTIVATION_BYTES) + batch * F.lit(shape["vocabulary"] * LOGIT_BYTES)
    need = stages.agg(F.coalesce(F.sum("planned_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.max(work), F.lit(0)).alias("work"))
    each = accelerators(stages.sparkSession).join(need)  # need has one row
    if measured is not None:
        each = each.join(measured.select(accelerator_key(F.col("device")).alias("key"), "gpus", F.col("tflops").alias("seen")), [accelerator_key(F.col("device")) == F.col("key"), each["gpus"] == measured["gpus"]], "left").drop(measured["gpus"])
    else:
        each = each.withColumn("seen", F.lit(None).cast("double"))
    required = F.ceil(F.lit(parameters * STATE_BYTES) / F.col("gpus")).cast("bigint") + F.col("work") + F.lit(RUNTIME)
    memory = F.col("gib").cast("bigint") * (1 << 30)
    operations = F.lit(6.0 * parameters) * F.col("tokens")
    seconds = F.ceil(F.when(F.col("seen").isNull(), operations / (F.col("tflops") * 1e12) * OVERHEAD).otherwise(operations / (F.col("seen") * 1e12))).cast("bigint")
    seconds = F.when(F.col("tokens") > 0, F.greatest(seconds, F.lit(1).cast("bigint"))).otherwise(F.lit(-1).cast("bigint"))
    out = each.select("device", "gpus", required.alias("required"), F.coalesce("seen", "tflops").alias("tflops"), seconds.alias("seconds"), F.when(F.col("seen").isNull(), "catalog").otherwise("observed-runs").alias("estimate"), memory.alias("memory"))
    fits = F.col("required") <= F.col("memory") - F.floor(F.col("memory") / FREE)
    return out.where(fits).drop("memory").orderBy(F.desc("seconds"), "device", "gpus")


#: Families of accelerators by which spellings of a device are the same.
FAMILIES = ("m4 max", "m5 max", "rtx pro 6000", "rtx 5090", "h100", "h200", "mi325x", "mi350x")


def accelerator_key(device: Column) -> Column:
    """A device's family, or else its letters and digits in lower case."""
    low = F.lower(device)
    out = F.regexp_replace(low, r"[^\p{L}\p{N}]", "")
    for f in reversed(FAMILIES):
        out = F.when(low.contains(f), f.replace(" ", "")).otherwise(out)
    return out


def calibrations(runs: DataFrame) -> DataFrame:
    """device (the first spelling), gpus, runs, tflops of observed runs (device, gpus, flops, seconds): operations by time of all runs of a family and number."""
    g = runs.where("seconds > 0").groupBy(accelerator_key(F.col("device")).alias("key"), "gpus")
    g = g.agg(F.min("device").alias("device"), F.count(F.lit(1)).alias("runs"), F.sum("flops").alias("f"), F.sum("seconds").alias("s"))
    return g.select("device", "gpus", "runs", (F.col("f") / F.col("s") / 1e12).alias("tflops"))


#: Named shapes: context, vocabulary, hidden, intermediate, layers, heads, key and value heads; embeddings are tied.
PRESETS = (
    ("10m", 512, 259, 384, 1024, 6, 6, 2), ("35m", 1024, 259, 512, 1408, 12, 8, 2), ("90m", 2048, 259, 768, 2048, 12, 12, 4), ("300m", 2048, 100259, 1024, 2816, 24, 16, 4), ("1b", 4096, 100259, 2048, 8192, 16, 32, 8),
    ("3b", 4096, 100259, 3072, 8192, 28, 24, 8), ("7b", 4096, 100259, 4096, 14336, 32, 32, 8), ("13b", 4096, 100259, 5120, 16384, 40, 40, 8), ("34b", 4096, 100259, 8192, 22016, 48, 64, 8), ("70b", 4096, 100259, 8192, 28672, 80, 64, 8),
)


def presets(spark) -> DataFrame:
    """preset, parameters of the named shapes."""
    rows = [(n, decoder_parameters(v, h, layers, heads, kv, i, True)) for n, _, v, h, i, layers, heads, kv in PRESETS]
    return spark.createDataFrame(rows, "preset string, parameters long")


def recommended(budgets: DataFrame, per_parameter: int = 20) -> DataFrame:
    """budgets (tokens) with preset: the largest with ``per_parameter`` tokens a parameter or more, else the smallest; null without tokens."""
    ladder = sorted((decoder_parameters(v, h, layers, heads, kv, i, True), n) for n, _, v, h, i, layers, heads, kv in PRESETS)
    out = F.lit(ladder[0][1])
    for parameters, name in ladder:
        out = F.when(F.floor(F.col("tokens") / per_parameter) >= parameters, name).otherwise(out)
    return budgets.withColumn("preset", F.when(F.col("tokens") > 0, out))


def resolved(stages: DataFrame) -> DataFrame:
    """stages with their settings filled in: steps, warmup_steps, checkpoint_every, evaluate_every, capacity, data_order, held_out, weight_decay, shuffle_records, shuffle_bytes.

    stages: tokens, steps, epochs (at most one of tokens and the others), batch_size, sequence_length, weighted,
    balanced. The steps hold the tokens, or are given, or follow from the epochs later (then they are null and so is
    what hangs on them). What is contradictory or not positive has a message in ``error``.
    """
    one = F.coalesce("batch_size", F.lit(1)).cast("bigint") * F.col("sequence_length")
    tokens, given, epochs = (F.coalesce(c, F.lit(0)) for c in ("tokens", "steps", "epochs"))
    error = (
        F.when((tokens < 0) | (given < 0), "steps and tokens must not be negative")
        .when((tokens > 0) & ((given > 0) | (epochs > 0)), "tokens cannot be combined with steps or epochs")
        .when((tokens == 0) & (given == 0) & (epochs == 0), "one of tokens, epochs or steps is required")
        .when((one <= 0) | one.isNull(), "batch and sequence must be positive")
        .when((epochs < 0) | (epochs > 1_000_000), "epochs must be in 1..1000000")
    )
    steps = F.when(tokens > 0, F.ceil(tokens / one)).when(given > 0, given).cast("bigint")
    out = stages.withColumn("error", error).withColumn("steps", F.when(error.isNull(), steps))
    n = F.col("steps")
    # least() passes nulls over
    warm = F.when(n.isNotNull(), F.least(F.lit(100).cast("bigint"), F.floor(n / 10)))
    every = F.when(n.isNotNull(), F.least(F.lit(500).cast("bigint"), n))
    order = F.when(F.col("weighted"), "corpus-weighted-shuffle-v1").when(F.col("balanced"), "corpus-balanced-shuffle-v1").otherwise("bounded-shuffle-v1")
    return out.withColumns({
        "warmup_steps": F.when((n > 1) & (warm == 0), F.lit(1).cast("bigint")).otherwise(warm), "checkpoint_every": every, "evaluate_every": every, "capacity": n * one, "data_order": order,
        "held_out": F.when(F.col("weighted") | F.col("balanced"), "stratified-lowest-sha256-v1").otherwise("lowest-sha256-v1"), "weight_decay": F.lit(0.1), "shuffle_records": F.lit(1024), "shuffle_bytes": F.lit(64 << 20),
    })


def training_targets(texts: DataFrame, held: DataFrame, epochs: int = 1) -> DataFrame:
    """records, held_out (their bytes), targets: byte targets over the epochs of what is not held out, but for the first token of all.

    texts: id, text; held: id. The end token of a record is no target here, unlike in byte_targets.
    """
    flagged = texts.join(held.select("id", F.lit(True).alias("_held")), "id", "left").withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)))
    kept = F.sum(F.when(F.col("_held").isNull(), F.col("n")).otherwise(0))
    out = flagged.agg(F.count_if(F.col("_held").isNull()).alias("records"), F.coalesce(F.sum(F.when(F.col("_held"), F.col("n"))), F.lit(0)).cast("bigint").alias("held_out"), kept.cast("bigint").alias("kept"))
    return out.select("records", "held_out", F.when(F.col("kept") >= 2, F.col("kept") * epochs - 1).alias("targets"))


def epoch_steps(records: DataFrame, batch: int, length: int, epochs: int = 1) -> DataFrame:
    """sequences, steps of an epoch stream of records (tokens; each with an end token) packed continuously into windows of ``length`` targets.

    Every token but the first of all is a target, so a last window with any target counts, and a last batch that is not full.
    """
    n = F.coalesce(F.sum(F.col("tokens") + 1), F.lit(0)) * epochs
    sequences = F.when(n > 1, F.ceil((n - 1) / length)).otherwise(0).cast("bigint")
    return records.agg(sequences.alias("sequences")).select("sequences", F.ceil(F.col("sequences") / batch).cast("bigint").alias("steps"))


def consumption(records: DataFrame) -> DataFrame:
    """corpus, targets of a pass over records (corpus, seq, tokens) in the order of seq: every token and end token but the first of all."""
    least = records.agg(F.min("seq").alias("least"))  # one row
    each = records.join(F.broadcast(least)).withColumn("n", F.col("tokens") + 1 - (F.col("seq") == F.col("least")).cast("int"))
    return each.groupBy("corpus").agg(F.sum("n").cast("bigint").alias("targets"))


def rounds(records: DataFrame) -> DataFrame:
    """records (corpus, seq) with ``round`` from 0: the place in their corpus; ordered by round and corpus, the corpora take turns. No corpus is sorted whole."""
    return prefix_sums(records.withColumn("_one", F.lit(1)), ["corpus"], "seq", "_one").withColumnRenamed("before", "round").drop("_one")


def calibration_sample(rows: DataFrame, shards: DataFrame, budget: int, seed: int) -> DataFrame:
    """shard, row, take (bytes), cut: rows of the shards in a seeded order until ``budget`` bytes are taken, the last cut at a whole character.

    rows: shard, row, text; shards: shard, sha256. A digest of several shards counts once (its first shard). Rows that
    are empty are passed over. Shards are added up first, so only those that are reached have their rows put in order;
    a shard has a bounded size.
    """
    unique = shards.groupBy("sha256").agg(F.min("shard").alias("shard")).withColumn("score", F.sha2(F.concat(F.lit(bytes((seed & MASK).to_bytes(8, "little"))), F.encode("sha256", "UTF-8")), 256))
    sizes = rows.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("size")).join(unique, "shard").where("size > 0")
    before, total = [], 0
    for r in sizes.orderBy("score").select("shard", "size").toLocalIterator():  # stops at the budget
        if total >= budget:
            break
        before.append((r["shard"], total))
        total += r["size"]
    starts = rows.sparkSession.createDataFrame(before, sizes.select("shard").withColumn("start", F.lit(0).cast("bigint")).schema)
    inside = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    n = F.octet_length("text").cast("bigint")
    each = rows.where(n > 0).join(F.broadcast(starts), "shard").withColumn("before", F.col("start") + F.sum(n).over(inside) - n).where(F.col("before") < budget)
    left = F.lit(budget) - F.col("before")
    from ..functions.privacy import truncate_utf8

    take = F.when(n <= left, n).otherwise(F.octet_length(truncate_utf8(F.col("text"), left)).cast("bigint"))
    return each.select("shard", "row", take.alias("take"), (n > left).alias("cut")).where("take > 0")


def worker_lines(training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """place, line: what a training worker reads: begin, the evaluation records, the records, end, as JSON lines; texts are gone, their byte tokens are there.

    training and evaluation: place (from 0, in the order of reading), id, corpus, text.
    """
    from ..functions.text import byte_ids, json_string

    def lines(df: DataFrame, kind: str, shift) -> DataFrame:
        ids = F.concat(F.lit("["), F.array_join(byte_ids(F.col("text")), ","), F.lit("]"))
        body = F.concat(F.lit(f'{{"type":"{kind}","id":'), json_string(F.col("id")), F.lit(',"corpus":'), json_string(F.col("corpus")), F.lit(',"tokens":'), ids, F.lit("}"))
        return df.where("text is not null").select((F.col("place") + shift).cast("bigint").alias("place"), body.alias("line"))

    spark = training.sparkSession
    held, n = evaluation.count(), training.count()
    mark = lambda place, kind: spark.createDataFrame([(place, f'{{"type":"{kind}"}}')], "place long, line string")
    return mark(0, "begin").unionByName(lines(evaluation, "evaluation_record", 1)).unionByName(lines(training, "record", 1 + held)).unionByName(mark(1 + held + n, "end"))


def decoder_parameters(vocabulary: int, hidden: int, layers: int, heads: int, kv_heads: int, intermediate: int, tied: bool) -> int:
    """Parameters of a decoder without biases: embedding, attention with grouped keys and values, gated feed-forward, norms."""
    kv = hidden // heads * kv_heads
    block = 2 * hidden * hidden + 2 * hidden * kv + 3 * hidden * intermediate
    return vocabulary * hidden * (1 if tied else 2) + layers * block + (2 * layers + 1) * hidden
