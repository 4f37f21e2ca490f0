import random

import pytest

from palimpsest.plans.boolean import formatted, ranked, relational, result_lines, search
from palimpsest.plans.query import Query, SearchConfig, parse
from tests.oracles import answer

INDEX = {
    1: {"apple", "apples", "fresh"}, 2: {"apple", "banana"}, 3: {"banana", "fruit", "freshness"},
    4: {"applesauce", "fruit", "tree"}, 5: {"catand", "theapple", "apples"}, 6: {"zebra", "zebras"},
}
VECTORS = {
    "apple": {1: 2, 2: 1, 4: 1, 5: 1}, '"apple"': {1: 1, 2: 1}, "appl": {}, "tree": {}, '"tree"': {4: 1},
    "apple banana": {1: 2, 2: 2, 3: 1, 4: 1, 5: 1}, "apple OR banana": {1: 2, 2: 2, 3: 1, 4: 1, 5: 1},
    "apple AND banana": {2: 2}, "apple NOT banana": {1: 2, 4: 1, 5: 1}, "apple OR NOT banana": {1: 2, 4: 1, 5: 1},
    "apple AND OR banana": {2: 2}, "NOT banana": {}, "AND apple": {}, "apple AND the": {1: 2, 2: 1, 4: 1, 5: 1},
    "apple NOT xyzzy": {1: 2, 2: 1, 4: 1, 5: 1}, "apple apple": {1: 4, 2: 2, 4: 2, 5: 2}, '"apple" apple': {1: 3, 2: 2, 4: 1, 5: 1},
    "(apple OR fruit) AND fresh": {1: 3, 3: 2}, '(fruit OR vegetable) AND "fresh"': {}, "apple AND banana OR fruit": {2: 2, 3: 1, 4: 1},
    "fruit OR apple AND banana": {2: 2, 3: 2}, "the apple": {5: 1}, "cat AND dogs": {5: 1}, "apple(banana)": {},
    "apple AND(banana)": {1: 2, 2: 1, 4: 1, 5: 1}, '"exact apple"': {1: 1, 2: 1}, "apple) (banana": {1: 2, 2: 1, 4: 1, 5: 1},
    "(apple AND the) OR banana": {1: 2, 2: 2, 3: 1, 4: 1, 5: 1}, "app-les": {1: 1, 4: 1, 5: 1}, '"or" apple': {1: 2, 2: 1, 4: 1, 5: 1},
    '"ab" apple': {}, "zebra": {6: 2}, "zebra zebras": {6: 3}, "": {}, "apple)": {}, "(apple": {}, ")apple(": {},
}


@pytest.fixture(scope="module")
def postings(spark):
    rows = [(w[0], w, d) for d, ws in INDEX.items() for w in ws]
    return spark.createDataFrame(rows, "letter string, word string, path_id long").cache()


def found(df):
    return {r["path_id"]: r["count"] for r in df.collect()}


@pytest.mark.parametrize("query", VECTORS)
def test_vectors(postings, query):
    assert found(search(postings, query)) == VECTORS[query]
    assert answer(INDEX, query) == VECTORS[query]


def test_exact_config(postings):
    assert found(search(postings, "apple", SearchConfig(exact_match=True))) == {1: 1, 2: 1}


def fold(query: Query | None, min_char: int = 4) -> dict[int, int]:
    """The parsed tree evaluated over plain sets."""
    if query is None:
        return {}

    def of(node):
        if not hasattr(node, "steps"):
            hit = {d: sum(w == node.word if node.exact else w.startswith(node.word) for w in ws) for d, ws in INDEX.items()}
            return {d: n for d, n in hit.items() if n and (node.exact or len(node.word) > min_char)}
        out: dict[int, int] = {}
        for op, operand in node.steps:
            r = of(operand)
            if op == "AND":
                out = {d: n + r[d] for d, n in out.items() if d in r}
            elif op == "NOT":
                out = {d: n for d, n in out.items() if d not in r}
            else:
                out = {d: out.get(d, 0) + r.get(d, 0) for d in out.keys() | r.keys()}
        return out

    return of(query.tree)


PIECES = ["apple", "banana", "fruit", "fresh", "the", "cat", "or", "and", "not", "AND", "OR", "NOT", "(", ")", '"', " ", " ", " ", "-", "a", "é"]


def test_random_queries_parse_like_two_passes():
    rng = random.Random(11)
    seen = 0
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14)))
        want = answer(INDEX, text.encode().decode("latin-1"))
        assert fold(parse(text)) == want, text
        seen += bool(want)
    assert seen > 1000


def test_plans_agree(postings):
    rng = random.Random(3)
    words = ["apple", '"apple"', "banana", "fruit", "fresh", "zebra"]
    for _ in range(6):
        text = words[0]
        for _ in range(3):
            text = f"({text}) {rng.choice(['AND', 'OR', 'NOT'])} {rng.choice(words)}"
        want = answer(INDEX, text)
        assert found(search(postings, text)) == found(search(postings, text, most_columns=1)) == found(relational(postings, text)) == want


def test_scan_is_pruned(spark, postings, tmp_path):
    path = str(tmp_path / "p")
    postings.write.partitionBy("letter").parquet(path)
    plan = search(spark.read.parquet(path).select("letter", "word", "path_id"), '(fruit OR "apple") NOT banana')._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((letter" in plan or "PartitionFilters: [(((letter" in plan
    assert "StringStartsWith" in plan and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_ranking(spark, postings):
    paths = spark.createDataFrame([(1, "/a"), (2, "/b"), (4, "/d")], "path_id long, path string")
    got = [tuple(r) for r in ranked(search(postings, "apple"), paths).orderBy("rank").collect()]
    assert got == [(0, 1, "/a", 2), (1, 2, "/b", 1), (2, 4, "/d", 1), (3, 5, "", 1)]
    assert [tuple(r)[:2] for r in ranked(search(postings, "apple"), paths, limit=2).orderBy("rank").collect()] == [(0, 1), (1, 2)]
    assert formatted(ranked(search(postings, "apple"), paths, limit=1)) == "\n 0. /a with 2 matches.\n"
    assert "No results" in formatted(ranked(search(postings, "nothing"), paths))


def test_every_hit_is_written(spark):
    postings = spark.range(1, 1502).selectExpr("'a' AS letter", "'apple' AS word", "id AS path_id")
    paths = spark.range(1, 1502).selectExpr("id AS path_id", "concat('/', id) AS path")
    lines = list(result_lines(ranked(search(postings, "apple"), paths)))
    assert lines == [f"\n {i}. /{i + 1} with 1 matches.\n" for i in range(1501)]
    assert formatted(ranked(search(postings, "apple"), paths)) == "".join(lines)
    assert formatted(ranked(search(postings, "apple"), paths), most=2) == "".join(lines[:2])
