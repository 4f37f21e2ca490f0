import random
from collections import defaultdict

import numpy as np
import pytest

from palimpsest.llm.packing import ITERATIONS, best_filling, containers_needed, number_of, packed, program, solve


def test_filling_is_best():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes, most, prices = rng.integers(1, 12, 4), rng.integers(0, 4, 4), rng.random(4)
        best = best_filling(sizes, most, prices, 20)
        assert (best <= most).all() and best @ sizes <= 20
        grid = np.array(np.meshgrid(*[np.arange(m + 1) for m in most])).reshape(4, -1).T
        top = (grid @ prices)[grid @ sizes <= 20].max()
        assert best @ prices == pytest.approx(top)


@pytest.mark.parametrize(("low", "high", "slack"), [(0.02, 0.3, 1.01), (0.15, 0.55, 1.01), (0.26, 0.33, 1.15), (0.51, 0.9, 1.6)])
def test_solutions_hold_and_are_tight(low, high, slack):
    rng = np.random.default_rng(2)
    sizes, need = np.unique(np.ceil(rng.uniform(low, high, 2000) * 512).astype(np.int64), return_counts=True)
    fillings, lower = solve(sizes, need, 512)
    assert sum(c * t for c, t in fillings).tolist() == need.tolist() and all(c @ sizes <= 512 for c, _ in fillings)
    bound = max(-(-int(sizes @ need) // 512), int(need[sizes > 256].sum()))
    assert lower <= number_of(fillings) + 1e-6 <= bound * slack + 1


def fewest(sizes, room):
    """Containers that an exact search needs."""
    best, sizes = len(sizes), sorted(sizes, reverse=True)

    def place(k, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if k == len(sizes):
            best = len(loads)
            return
        for i in range(len(loads)):
            if loads[i] + sizes[k] <= room and loads[i] not in loads[:i]:
                place(k + 1, [*loads[:i], loads[i] + sizes[k], *loads[i + 1 :]])
        place(k + 1, [*loads, sizes[k]])

    place(0, [])
    return best


def test_the_bound_holds_and_small_cases_are_best():
    rng, over = np.random.default_rng(5), 0
    for _ in range(40):
        items = rng.integers(8, 60, rng.integers(4, 11))
        sizes, need = np.unique(items, return_counts=True)
        fillings, lower = solve(sizes, need, 100)
        best = fewest(items.tolist(), 100)
        assert lower <= best + 1e-6 and number_of(fillings) >= best
        over += number_of(fillings) - best
    assert over <= 1


def test_the_program_comes_near_its_optimum():
    """Three sizes of which two fit together: the fractional optimum is known."""
    sizes, need = np.array([30, 35, 65]), np.array([700, 200, 900])
    last = list(program(sizes, need, 100))[-1]
    assert last.bound == pytest.approx(900, rel=0.02) and last.times.sum() == pytest.approx(last.bound)
    assert len(last.fillings) <= ITERATIONS and (last.fillings @ sizes <= 100).all()
    assert number_of(solve(sizes, need, 100)[0]) == 900


SCHEMA = "g string, i long, s long, cap long, container int, rank int"


def rows_of(rng):
    rows = [("hot", i, rng.choice([None, 0, 5, 90, 100, 101, 250, rng.randint(1, 60)]), 100) for i in range(900)]
    rows += [(g, i, rng.randint(1, 99), 100) for g in ("a", None, "c") for i in range(rng.randint(1, 20))]
    rows += [("free", i, 10**6, None) for i in range(4)] + [("zero", 1, 50, 0), ("none", 1, 0, 100), ("big", 1, 300, 100), ("a", None, 40, 100)]
    return [(*r, 1, 2) for r in rows + rows[:50]]


def test_everything_is_packed_once_and_fits(spark):
    rows = rows_of(random.Random(3))
    got = packed(spark.createDataFrame(rows, SCHEMA), ["g"], "i", "s", "cap").collect()
    size, cap = {}, {}
    for g, i, s, c, *_ in rows:
        size[g, i], cap[g] = max(s or 0, size.get((g, i), 0)), c
    by_item, load = defaultdict(list), defaultdict(int)
    for r in got:
        by_item[r["g"], r["i"]].append((r["piece"], r["size"]))
        load[r["g"], r["container"]] += r["size"]
    assert {k: sum(s for _, s in v) for k, v in by_item.items()} == size
    for (g, i), v in by_item.items():
        assert len({p for p, _ in v}) == len(v) and (len(v) == 1 or size[g, i] > cap[g])
    for (g, _), n in load.items():
        assert not cap[g] or n <= cap[g]
    for g in {g for g, _ in load}:
        numbers = sorted(c for h, c in load if h == g)
        assert numbers == list(range(1, len(numbers) + 1))
        total = sum(s for (h, _), s in size.items() if h == g)
        assert not cap[g] or len(numbers) <= 1.02 * total / cap[g] + 1


def test_numbers_needed(spark):
    rows = spark.createDataFrame(rows_of(random.Random(4)), SCHEMA)
    need = {r["g"]: r for r in containers_needed(rows, ["g"], "i", "s", "cap").collect()}
    made = {r["g"]: r["n"] for r in packed(rows, ["g"], "i", "s", "cap").groupBy("g").agg({"container": "max"}).toDF("g", "n").collect()}
    assert {g: r["n_containers"] for g, r in need.items()} == made
    assert (need["free"]["n_containers"], need["zero"]["n_containers"], need["none"]["n_containers"], need["big"]["n_containers"]) == (1, 1, 1, 3)
    assert need["big"]["total"] == 300
    assert containers_needed(rows.where("false"), ["g"], "i", "s", "cap").count() == 0 == packed(rows.where("false"), ["g"], "i", "s", "cap").count()


def test_small_items_are_packed_by_exact_size(spark):
    rng = random.Random(9)
    sizes = {"even": ([100] * 5000, 50_000), "fine": ([rng.randint(50, 400) for _ in range(20_000)], 1_000_000), "ones": ([1] * 600, 50_000), "mixed": ([rng.randint(1, 90) for _ in range(4000)] + [rng.randint(9000, 30_000) for _ in range(40)], 50_000)}
    rows = [(g, i, s, cap, 1, 2) for g, (all_, cap) in sizes.items() for i, s in enumerate(all_)]
    df = spark.createDataFrame(rows, SCHEMA)
    need = {r["g"]: r["n_containers"] for r in containers_needed(df, ["g"], "i", "s", "cap").collect()}
    load, held = defaultdict(int), defaultdict(list)
    for r in packed(df, ["g"], "i", "s", "cap").collect():
        load[r["g"], r["container"]] += r["size"]
        held[r["g"]].append((r["i"], r["size"]))
    for g, (all_, cap) in sizes.items():
        numbers = sorted(c for h, c in load if h == g)
        assert sorted(held[g]) == list(enumerate(all_)) and numbers == list(range(1, need[g] + 1))
        assert all(n <= cap for (h, _), n in load.items() if h == g)
        assert need[g] <= -(-sum(all_) // (cap * 0.99)) + (g == "mixed")
    assert need["ones"] == 1 and need["even"] == 10 and need["fine"] == -(-sum(sizes["fine"][0]) // 1_000_000)
