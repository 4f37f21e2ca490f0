"""Filling containers of fixed capacity with items of varying size.

Each group (a run, say) packs its own items. Sizes are laid on a grid of the
capacity, rounded up, and only the histogram over the grid is solved, by the
configuration linear program: how often each filling of a container is used so
that every size is covered. Multiplicative weights solve it: each step prices
the sizes, finds the best-paying filling with a knapsack dynamic program, uses
it a fraction of the times that it could be, and lowers the prices of the
sizes that it covered. The prices are a dual solution, so each step also gives
a bound that no packing can beat. The fractional solution is then rounded: its
whole parts are used, and the rest is filled under the last prices or by best
fit, whichever takes fewer. It ends where the rounded number is
within CLOSE of the bound, rounded up, or after ITERATIONS steps.

What all fits into one container by its exact bytes is the one filling of an
optimal program. Small items (up to SMALL steps) are poured by their exact
bytes into the room that the others leave, largest first, where that takes
fewer containers, so that each loses less than the item at its edge. Items
then take the places of their size by rank, found without sorting a group in
one task, so a group may hold any share of all rows.

Defined cases: a null or negative size counts 0; a repeated row counts once,
and of different sizes of an item the largest; an item above the capacity is
cut into pieces of the capacity, each alone in a container, and its rest is
packed like an item; a null capacity, or one below 1, is no limit; null group
or item values are values like others; an empty table has no containers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.heavy_keys import with_prefix

GRID = 2048
SMALL = 32  # steps of the grid up to which an item may be poured
POURED = -1  # class of the poured items in a plan; their places are bytes, not ranks
STEP = 0.25  # share of what its scarcest size needs that a step uses a filling for
ETA = 2.0  # how fast a size that is covered gets cheaper
ITERATIONS = 128
ROUNDED_AFTER = (1, 4, 16, 48, ITERATIONS)
CLOSE = 0.002  # a packing this near to the bound will do
PRICED = 128  # sizes that a step of the rounding prices at once
BLOCK = 1024  # ranks that share a key of the join with the plan


def best_filling(sizes: np.ndarray, most: np.ndarray, prices: np.ndarray, room: int) -> np.ndarray:
    """How many of each size to put into one container for the highest total price.

    Bounded knapsack: copies of a size are taken in bundles of 1, 2, 4, ...
    """
    value, bundles, took = np.zeros(room + 1), [], []
    for k in np.flatnonzero(most > 0):
        left, bundle = int(min(most[k], room // sizes[k])), 1
        while left > 0:
            n = min(bundle, left)
            weight = int(n * sizes[k])
            better = value[:-weight] + n * prices[k]
            gain = better > value[weight:]
            value[weight:][gain] = better[gain]
            mark = np.zeros(room + 1, bool)
            mark[weight:] = gain
            bundles.append((k, n, weight))
            took.append(mark)
            left, bundle = left - n, bundle * 2
    counts, at = np.zeros(len(sizes), np.int64), room
    for (k, n, weight), mark in zip(reversed(bundles), reversed(took)):
        if mark[at]:
            counts[k] += n
            at -= weight
    return counts


@dataclass
class Program:
    """A fractional solution of the configuration program."""

    fillings: np.ndarray  # one row each: how many of each size
    times: np.ndarray  # how often each is used, scaled so that they add up to the bound
    prices: np.ndarray
    bound: float  # no packing takes fewer containers


def program(sizes: np.ndarray, need: np.ndarray, room: int) -> Iterator[Program]:
    """The solution by multiplicative weights, as it stands after ROUNDED_AFTER steps.

    A size weighs exp(-ETA * how often it was covered); its price is its weight
    over its need. Prices over the value of the best filling are a solution of
    the dual, which gives the bound, and so is their mean over the steps. They
    start at the sizes: the bound is then the volume.
    """
    base = sizes * need / float(np.dot(sizes, need))
    covered, bound, used, mean = np.zeros(len(sizes)), 0.0, {}, np.zeros(len(sizes))
    for step in range(1, ITERATIONS + 1):
        prices = base * np.exp(-ETA * (covered - covered.min())) / need
        counts = best_filling(sizes, need, prices, room)
        prices = prices / float(prices @ counts)
        bound, mean = max(bound, float(prices @ need)), mean + prices
        inside = counts > 0
        times = STEP * float((need[inside] / counts[inside]).min())
        covered = covered + counts * times / need
        used[counts.tobytes()] = used.get(counts.tobytes(), 0.0) + times
        if step in ROUNDED_AFTER:
            if step > 1:
                bound = max(bound, float(mean @ need) / float(mean @ best_filling(sizes, need, mean, room)))
            share = np.array(list(used.values()))
            fillings = np.frombuffer(b"".join(used), np.int64).reshape(len(used), -1)
            yield Program(fillings, share * bound / share.sum(), prices, bound)


def _priced(sizes: np.ndarray, need: np.ndarray, room: int, prices: np.ndarray) -> list[list]:
    """[filling, times] that pack `need`: again and again the filling that pays best, as often as half of what is left asks for it.

    Of many sizes PRICED are priced at a time, the largest and others evenly below it.
    """
    left, out = need.copy(), []
    while len(open_ := np.flatnonzero(left)):
        if len(open_) > PRICED:
            open_ = open_[np.unique(np.linspace(0, len(open_) - 1, PRICED).astype(np.int64))]
        part = best_filling(sizes[open_], left[open_], prices[open_], room)
        inside = part > 0
        times = max(1, int((left[open_][inside] // part[inside]).min()) // 2)
        counts = np.zeros(len(sizes), np.int64)
        counts[open_] = part
        left = left - counts * times
        out.append([counts, times])
    return out


def _best_fit(sizes: np.ndarray, need: np.ndarray, room: int) -> list[list]:
    """[filling, times] that pack `need`, largest first, each where the least room stays. `sizes` ascend."""
    left, out = need.copy(), []
    open_ = np.flatnonzero(left)
    while len(open_):
        some, free, below, taken = sizes[open_], room, len(open_), []
        while (k := int(np.searchsorted(some[:below], free, "right")) - 1) >= 0:
            n = min(int(left[open_[k]]), int(free // some[k]))
            taken.append((int(open_[k]), n))
            free, below = free - n * int(some[k]), k
        times = min(int(left[k]) // n for k, n in taken)
        counts = np.zeros(len(sizes), np.int64)
        for k, n in taken:
            counts[k] = n
            left[k] -= n * times
        out.append([counts, times])
        open_ = open_[left[open_] > 0]
    return out


def number_of(fillings: list[list]) -> int:
    return sum(times for _, times in fillings)


def rounded(sizes: np.ndarray, need: np.ndarray, room: int, solution: Program) -> list[list]:
    """[filling, times] that pack `need`: the whole parts of a solution, most used first, and a packing of the rest."""
    left, out = need.copy(), []
    for k in np.argsort(-solution.times, kind="stable"):
        counts = solution.fillings[k]
        inside = counts > 0
        times = int(min(np.floor(solution.times[k]), (left[inside] // counts[inside]).min()))
        if times > 0:
            left = left - counts * times
            out.append([counts, times])
    rest = _best_fit(sizes, left, room)
    if not near(number_of(out) + number_of(rest), solution.bound):
        rest = min(rest, _priced(sizes, left, room, solution.prices), key=number_of)
    return out + rest


def near(number: int, bound: float) -> bool:
    return number <= np.ceil(bound * (1 + CLOSE) - 1e-6)


def solve(sizes: np.ndarray, need: np.ndarray, room: int) -> tuple[list[list], float]:
    """([filling, times] that pack all of `need`, bound that no packing can beat)."""
    if int(np.dot(sizes, need)) <= room:
        return [[need.copy(), 1]], 1.0
    best, bound = None, 0.0
    for solution in program(sizes, need, room):
        bound, tried = solution.bound, rounded(sizes, need, room, solution)
        best = tried if best is None or number_of(tried) < number_of(best) else best
        if near(number_of(best), bound):
            break
    return best, bound


_PLAN = T.ArrayType(T.StructType([
    T.StructField("cls", T.IntegerType()), T.StructField("from", T.LongType()), T.StructField("to", T.LongType()),
    T.StructField("container", T.LongType()), T.StructField("each", T.LongType()),
]))


def _places(sizes: np.ndarray, fillings: list[list]) -> list[dict]:
    """Which ranks of a size go into which containers, numbered from 0."""
    taken, first, rows = np.zeros(len(sizes), np.int64), 0, []
    for counts, times in fillings:
        for k in np.flatnonzero(counts):
            n = int(counts[k]) * times
            rows.append({"cls": int(sizes[k]), "from": int(taken[k]), "to": int(taken[k]) + n, "container": first, "each": int(counts[k])})
            taken[k] += n
        first += times
    return rows


def poured(cells: list[dict], capacity: int, grid: int) -> tuple[list[dict], int]:
    """(plan, containers) with the small items by exact size, largest first, in what the others leave.

    An item belongs where its first byte falls; a room is less by the largest
    item that can begin in it, so that the last one to begin fits.
    """
    small = sorted((c for c in cells if c["cls"] <= SMALL), key=lambda c: -c["cls"])
    large = [c for c in cells if c["cls"] > SMALL]
    sizes = np.array([c["cls"] for c in large], np.int64)
    fillings = solve(sizes, np.array([c["n"] for c in large], np.int64), grid)[0] if large else []
    rows, first, at = _places(sizes, fillings), 0, 0
    ends = np.cumsum([c["sum"] for c in small]).tolist()
    total = ends[-1]
    free = [(capacity * (grid - int(counts @ sizes)) // grid, times) for counts, times in fillings]
    for space, times in [*free, (capacity, None)]:
        while at < total and times != 0:
            k = next(k for k, end in enumerate(ends) if at < end)
            largest, begin = small[k]["most"], ends[k - 1] if k else 0
            room = space - largest + 1
            if small[k]["least"] == largest and (at - begin) % largest == 0:
                room = space // largest * largest
            if room < largest:
                break
            # the last container takes what is left where all of it fits by bytes
            last = times is None and total - at <= space and at == begin
            n = 1 if last else -(-(ends[k] - at) // room)
            n = n if times is None else min(n, times)
            room = total - at if last else room
            rows.append({"cls": POURED, "from": at, "to": min(at + room * n, total), "container": first, "each": room})
            at, first, times = at + room * n, first + n, None if times is None else times - n
        first += times or 0
    return rows, first


def _planned(cells: list[dict], capacity: int | None, grid: int) -> tuple[list[dict], int]:
    """(plan, containers) of one group."""
    # each rest of a cut item has a class of its own size like the others; class 0 (nothing to hold) rides along
    free, cells = sum(c["n"] for c in cells if c["cls"] == 0), sorted((c for c in cells if c["cls"]), key=lambda c: c["cls"])
    rows, number = [], 0
    if cells:
        sizes, need = (np.array([c[k] for c in cells], np.int64) for k in ("cls", "n"))
        total = sum(c["sum"] for c in cells)
        if capacity and total <= capacity:
            rows, number = _places(sizes, [[need, 1]]), 1
        else:
            fillings, _ = solve(sizes, need, grid)
            rows, number = _places(sizes, fillings), number_of(fillings)
        if capacity and number > -(-total // capacity) and cells[0]["cls"] <= SMALL:
            other, fewer = poured(cells, capacity, grid)
            rows, number = (other, fewer) if fewer < number else (rows, number)
    if free:
        rows.append({"cls": 0, "from": 0, "to": free, "container": 0, "each": free})
    return rows, number or (1 if free else 0)


def _solved(histograms: DataFrame, groups: Sequence[str], grid: int, with_plan: bool) -> DataFrame:
    fields = [histograms.schema[g] for g in groups] + [T.StructField("n_containers", T.LongType()), T.StructField("__cap", T.LongType())]
    schema = T.StructType(fields + ([T.StructField("plan", _PLAN)] if with_plan else []))
    plan_type = pa.list_(pa.struct([("cls", pa.int32()), *((n, pa.int64()) for n in ("from", "to", "container", "each"))]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans, numbers = [], []
            for cells, capacity in zip(batch.column(len(groups)).to_pylist(), batch.column(len(groups) + 1).to_pylist()):
                rows, number = _planned(cells, capacity, grid)
                numbers.append(number)
                plans.append(rows)
            columns = [*batch.columns[: len(groups)], pa.array(numbers, pa.int64()), batch.column(len(groups) + 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(plans, plan_type)] if with_plan else columns, names=schema.names
            )

    return histograms.mapInArrow(work, schema)


def _laid_out(items: DataFrame, groups: Sequence[str], item: str, size: str, capacity: str, grid: int) -> DataFrame:
    """Distinct items: groups, item, __size, __cap (null: no limit), __full (containers of its own), __rest, __cls."""
    cap = F.when(F.col(capacity) >= 1, F.col(capacity).cast("long"))
    clean = items.select(*groups, item, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("__size"), cap.alias("__cap"))
    clean = clean.groupBy(*groups, item).agg(F.max("__size").alias("__size"), F.max("__cap").alias("__cap"))
    over = F.col("__size") > F.col("__cap")
    full = F.when(over, F.expr("__size div __cap")).otherwise(F.lit(0).cast("long"))
    rest = F.when(over, F.col("__size") % F.col("__cap")).otherwise(F.col("__size"))
    # rounded up, so that what fits on the grid fits; without a limit everything is class 0
    cls = F.coalesce(F.ceil(F.col("__rest").cast("decimal(20,0)") * grid / F.col("__cap")), F.lit(0)).cast("int")
    return clean.withColumn("__full", full).withColumn("__rest", rest).withColumn("__cls", cls)


def _histograms(laid: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per group: at most one cell per grid step, and the capacity if all rows have the same.

    What only fills containers of its own has no cell.
    """
    part = laid.where("NOT (__full > 0 AND __rest = 0)")
    cells = part.groupBy(*groups, F.col("__cls").alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__rest").alias("sum"), F.min("__rest").alias("least"), F.max("__rest").alias("most"),
        F.min("__cap").alias("__low"), F.max("__cap").alias("__high"),
    )
    return cells.groupBy(*groups).agg(
        F.collect_list(F.struct("cls", "n", "sum", "least", "most")).alias("cells"),
        F.when(F.min("__low") == F.max("__high"), F.max("__high")).alias("__cap"),
    )


def _same(groups: Sequence[str], prefix: str):
    out = F.lit(True)
    for g in groups:
        out = out & F.col(g).eqNullSafe(F.col(prefix + g))
    return out


def containers_needed(items: DataFrame, groups: Sequence[str], item: str, size: str, capacity: str, grid: int = GRID) -> DataFrame:
    """(groups, n_containers, total, capacity) that packing each group takes."""
    laid = _laid_out(items, groups, item, size, capacity, grid)
    solved = _solved(_histograms(laid, groups), groups, grid, with_plan=False)
    solved = solved.select(*[F.col(g).alias(f"__g_{g}") for g in groups], "n_containers")
    sums = laid.groupBy(*groups).agg(F.sum("__size").alias("total"), F.max("__cap").alias("capacity"), F.sum("__full").alias("__alone"))
    joined = sums.join(solved, _same(groups, "__g_"), "left")
    number = F.coalesce("n_containers", F.lit(0)) + F.col("__alone")
    return joined.select(*groups, number.alias("n_containers"), "total", "capacity")


def packed(items: DataFrame, groups: Sequence[str], item: str, size: str, capacity: str, grid: int = GRID) -> DataFrame:
    """(groups, item, piece, container, size): containers are numbered from 1 in each group.

    An item within the capacity is piece 0. Of a larger one pieces 1, 2, ...
    fill containers of their own and piece 0 is the rest, if any.
    """
    laid = _laid_out(items, groups, item, size, capacity, grid)
    solved = _solved(_histograms(laid, groups), groups, grid, with_plan=True)
    small = laid.where("NOT (__full > 0 AND __rest = 0)").select(*groups, item, "__rest", "__cls", "__cap")
    by_rank = with_prefix(small, [*groups, "__cls"], [item]).withColumn("__at", F.col("rank"))
    by_bytes = with_prefix(small.where(f"__cls BETWEEN 1 AND {SMALL}").withColumn("__down", -F.col("__rest")), list(groups), ["__down", item], weight="__rest")
    # a small item has a place of either kind; the plan of its group names one of them
    kinds = [by_rank.withColumn("__unit", F.lit(BLOCK).cast("long")), by_bytes.withColumn("__at", F.col("before")).withColumns({"__cls": F.lit(POURED), "__unit": F.col("__cap")})]
    kinds = [k.select(*groups, item, "__rest", "__cls", "__at", F.expr("__at div __unit").alias("__block")) for k in kinds]
    ranked = kinds[0].unionByName(kinds[1])
    # a stretch of places is cut at blocks, so that the join key splits even a size that a third of all items have
    plan = solved.select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.explode("plan").alias("p"), "__cap")
    plan = plan.withColumn("__unit", F.when(F.col("p.cls") == POURED, F.col("__cap")).otherwise(BLOCK)).select(
        "*", F.explode(F.expr("sequence(p.`from` div __unit, (p.`to` - 1) div __unit)")).alias("__b")
    ).drop("__cap", "__unit")
    inside = (F.col("__at") >= F.col("p.from")) & (F.col("__at") < F.col("p.to"))
    same = _same(groups, "__g_") & (F.col("__cls") == F.col("p.cls")) & (F.col("__block") == F.col("__b")) & inside
    container = F.col("p.container") + F.expr("(__at - p.`from`) div p.`each`") + 1
    shared = ranked.join(plan, same).select(
        *groups, item, F.lit(0).cast("long").alias("piece"), container.alias("container"), F.col("__rest").alias("size")
    )
    large = laid.where("__full > 0").select(*groups, item, "__full", "__cap")
    numbered = with_prefix(large, list(groups), [item], weight="__full")
    base = solved.select(*[F.col(g).alias(f"__g_{g}") for g in groups], "n_containers")
    alone = (
        numbered.join(base, _same(groups, "__g_"), "left")
        .withColumn("piece", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__full"))))
        .select(*groups, item, "piece", (F.coalesce("n_containers", F.lit(0)) + F.col("before") + F.col("piece")).alias("container"), F.col("__cap").alias("size"))
    )
    return shared.unionByName(alone)


def kept_rules(containers: DataFrame, items: DataFrame, groups: Sequence[str], item: str, size: str, capacity: str) -> DataFrame:
    """(groups, n_items, n_bytes, n_twice, n_lost, n_over, n_gaps) of what `packed` made of `items`: pieces that are
    there twice, bytes that are not there, containers above the capacity, numbers between 1 and the last that no container has."""
    given = _laid_out(items, groups, item, size, capacity, GRID).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("__size").alias("n_bytes"), F.max("__cap").alias("__cap")
    )
    loads = containers.groupBy(*groups, "container").agg(F.sum("size").alias("__load"), F.count(F.lit(1)).alias("__n"), F.count_distinct(item, "piece").alias("__d"))
    caps = given.select(*[F.col(g).alias(f"__g_{g}") for g in groups], "__cap")
    held = loads.join(caps, _same(groups, "__g_"), "left").groupBy(*groups).agg(
        F.sum("__load").alias("__bytes"), F.sum(F.col("__n") - F.col("__d")).alias("n_twice"), F.count_if(F.col("__load") > F.col("__cap")).alias("n_over"),
        (F.max("container") - F.count(F.lit(1))).alias("n_gaps"),
    )
    held = held.withColumnsRenamed({g: f"__g_{g}" for g in groups})
    return given.join(held, _same(groups, "__g_"), "left").select(
        *groups, "n_items", "n_bytes", "n_twice", (F.col("n_bytes") - F.col("__bytes")).alias("n_lost"), "n_over", "n_gaps"
    )
