"""Filling containers of fixed capacity: non-negative least squares over shallow combinations of lengths."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length classes at most; every length is its own class where the capacity allows it.
CLASSES = 192

#: Lengths that a combination of the least-squares problem holds at most, and the part of the capacity it may leave free.
DEPTH, WINDOW = 3, 1 / 64

#: Items of one class and salt that are numbered together.
PER_SALT = 200_000


def length_classes(sizes: dict[int, int], limit: int = CLASSES) -> list[int]:
    """Upper ends of length classes, ascending: of nearly equal numbers of lengths, and each end occurs."""
    lengths = sorted(sizes)
    if len(lengths) <= limit:
        return lengths
    cut = np.linspace(0, len(lengths), limit + 1).round().astype(int)[1:]
    return [lengths[i - 1] for i in cut]


def combinations(ends: list[int], capacity: int, depth: int = DEPTH, window: float = WINDOW) -> list[tuple[int, ...]]:
    """Descending tuples of class numbers, up to ``depth`` long, whose ends fill the capacity but for the window."""
    least = capacity - max(1, int(capacity * window))
    found: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], top: int, used: int) -> None:
        for k in range(top, -1, -1):
            total = used + ends[k]
            if total > capacity:
                continue
            if total >= least:
                found.append((*chosen, k))
            elif len(chosen) + 1 < depth:
                if total + ends[k] * (depth - len(chosen) - 1) < least:
                    break
                grow((*chosen, k), k, total)

    grow((), len(ends) - 1, 0)
    return found


def nnls(found: list[tuple[int, ...]], b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method. Column j of a counts the classes of found[j].

    A column has a few entries only, so a itself is never made: gradients are sums of a few places of the residual, and
    the normal equations are those of the active columns.
    """
    depth = max(map(len, found))
    at = np.array([c + (len(b),) * (depth - len(c)) for c in found])  # the place behind b stands for nothing
    n = len(found)
    x, active = np.zeros(n), []
    full = np.zeros((len(b) + 1, 0))
    least = 1e-8 * max(1.0, np.abs(b).max())
    residual = np.append(b.astype(float), 0)
    for _ in range(rounds or 3 * len(b)):
        w = residual[at].sum(axis=1)
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= least:
            break
        column = np.zeros((len(b) + 1, 1))
        np.add.at(column, at[j], 1)
        column[-1] = 0
        active.append(j)
        full = np.hstack([full, column])
        while active:
            gram = full.T @ full
            try:
                z = np.linalg.solve(gram, full[:-1].T @ b)
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(full[:-1], b, rcond=None)[0]
            have = x[active]
            if (z > 0).all():
                x[:] = 0
                x[active] = z
                break
            low = z <= 0
            step = np.min(have[low] / np.maximum(have[low] - z[low], 1e-300))
            have = have + step * (z - have)
            drop = low & (have <= 1e-12)
            if not drop.any():
                drop = low
            x[active] = np.where(drop, 0, have)
            active = [k for k, d in zip(active, drop) if not d]
            full = full[:, ~drop]
        residual = np.append(b - full[:-1] @ x[active], 0) if active else np.append(b.astype(float), 0)
    return x


def make_patterns(sizes: dict[int, int], capacity: int) -> tuple[list[int], list[tuple[int, tuple[int, ...]]]]:
    """Class ends, and (times, class numbers) of containers that hold every item of the histogram exactly once.

    The histogram has at most ``capacity`` lengths, so this runs on the driver whatever the number of items.
    """
    ends = length_classes(sizes)
    left = [0] * len(ends)
    for size, n in sizes.items():
        left[int(np.searchsorted(ends, size))] += n
    patterns: list[tuple[int, tuple[int, ...]]] = []
    found = combinations(ends, capacity)
    if found:
        for j in np.argsort(-(x := nnls(found, np.array(left, float))), kind="stable"):
            if x[j] < 0.5:
                break
            need = Counter(found[j])
            times = min(round(x[j]), *(left[k] // c for k, c in need.items()))
            if times > 0:
                patterns.append((times, found[j]))
                for k, c in need.items():
                    left[k] -= times * c
    while any(left):
        room, combo = capacity, []
        spare = list(left)
        for k in range(len(ends) - 1, -1, -1):
            take = min(spare[k], room // ends[k])
            combo += [k] * take
            room -= take * ends[k]
        need = Counter(combo)
        times = min(left[k] // c for k, c in need.items())
        patterns.append((times, tuple(combo)))
        for k, c in need.items():
            left[k] -= times * c
    return ends, patterns


def pieces(sized: DataFrame, capacity: int, item: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """item, piece, start, length: an item beyond the capacity is cut into full containers and a rest; others stay whole."""
    n = F.col(size)
    count = F.ceil(n / F.lit(capacity)).cast("long")
    out = sized.where(n > 0).select(F.col(item), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    start = F.col("piece") * capacity
    return out.select(item, "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("_n") - start).alias("length"))


def pack(sized: DataFrame, capacity: int, item: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Assigns items (unique ``item``, ``size`` > 0) to containers: item, piece, start, length, container.

    Containers are numbered from 0. Items without a size or of size 0 need no container and are left to the caller.
    The items are numbered within their length class by salted groups, whose counts are summed first, so no class is
    sorted in one task; the tables of lengths (at most ``capacity``) and patterns (a few per class) are broadcast.
    """
    if capacity < 1:
        raise ValueError("the capacity must be 1 or more")
    spark = sized.sparkSession
    parts = pieces(sized, capacity, item, size)
    sizes = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return parts.withColumn("container", F.lit(0).cast("long"))
    ends, patterns = make_patterns(sizes, capacity)
    slots, next_of, base = [], [0] * len(ends), 0
    for times, combo in patterns:
        for k, c in Counter(combo).items():
            slots.append((k, next_of[k], next_of[k] + times * c, base, c))
            next_of[k] += times * c
        base += times
    salts = max(1, -(-max(next_of) // PER_SALT))
    slot_table = spark.createDataFrame(slots, "class int, low long, high long, base long, each long")
    of = spark.createDataFrame([(n, int(np.searchsorted(ends, n))) for n in sizes], "length long, class int")
    classed = parts.join(F.broadcast(of), "length")
    classed = classed.withColumn("salt", F.pmod(F.xxhash64(item, "piece"), F.lit(salts)))
    sums = classed.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = sums.select("class", "salt", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("class", "salt").orderBy(item, "piece")) - 1
    ranked = classed.withColumn("_k", number).join(offsets, ["class", "salt"]).withColumn("_r", F.col("_k") + F.col("before"))
    s = F.broadcast(slot_table.withColumnRenamed("class", "_class"))
    fits = (F.col("class") == F.col("_class")) & (F.col("_r") >= F.col("low")) & (F.col("_r") < F.col("high"))
    joined = ranked.join(s, fits)
    return joined.select(item, "piece", "start", "length", (F.col("base") + F.expr("(_r - low) div each")).alias("container"))
