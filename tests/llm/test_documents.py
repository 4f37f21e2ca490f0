import random
import re

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm.keyword_pages import chunks, keyword_pages, scored, train
from palimpsest.llm.leakage import leaked, prepare, search, search_depth, suffix_array, without_leaks
from palimpsest.llm.mixing import by_rejection, kept_rules, mixture, permuted, quotas, shards_of, shares
from palimpsest.llm.words import word_hashes

VOCABULARY = [f"{a}{b}" for a in ("wa", "ro", "mi", "tel", "ba", "shu") for b in ("ler", "din", "ko", "vas", "pe", "nost", "ti")]


def passage(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def plain_leak(doc, item, stretch=20):
    n = min(stretch, len(item))
    if not n:
        return False
    for i in range(len(item) - n + 1):
        for j in range(len(doc) - n + 1):
            same = [a == b for a, b in zip(item[i : i + n], doc[j : j + n])]
            if sum(same) >= n - n // 10:
                return True
    return False


def test_leaks_equal_plain(spark):
    rng = random.Random(1)
    items = [passage(rng, n) for n in (60, 45, 25, 20, 12, 10, 5, 30, 30)]
    docs = []
    for _ in range(60):
        item = rng.choice(items)
        part = item[(a := rng.randint(0, max(0, len(item) - 26))) : a + rng.randint(4, 40)]
        part = [rng.choice(VOCABULARY) if rng.random() < rng.choice([0, 0.08, 0.15]) else w for w in part]
        docs.append(passage(rng, rng.randint(0, 40)) + part + passage(rng, rng.randint(0, 40)))
    d = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(docs)] + [(0, " ".join(docs[0]), "x"), (90, None, "x"), (None, "a", "x"), (91, "", "x")], "doc_id long, text string, longest string")
    t = spark.createDataFrame([(i, " ".join(w), "en") for i, w in enumerate(items)] + [(0, " ".join(items[0]), "en"), (99, None, "en")], "item_id long, text string, longest string")
    want = {(i, j) for i, x in enumerate(docs) for j, y in enumerate(items) if plain_leak(x, y)}
    for size in (32_000_000, 300):
        found = leaked(d, "doc_id", "text", t, "item_id", "text", block_bytes=size)
        rows = [tuple(r)[:2] for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 10
    kept = {r["doc_id"] for r in without_leaks(d, "doc_id", found).collect()}
    assert kept == {*range(60), 90, 91, None} - {i for i, _ in want}
    assert leaked(d.where("false"), "doc_id", "text", t, "item_id", "text").count() == 0
    assert leaked(d, "doc_id", "text", t.where("false"), "item_id", "text").count() == 0


BASE = "The harbour dues of Ardvale were raised in March; nobody asked the smaller islands whether the ferries could bear it, and the museum paid."


@pytest.mark.parametrize(
    "text",
    [BASE.upper(), BASE.replace(" ", "\n"), BASE.replace("islands", "is-\nlands"), re.sub(r"\bthe\b", "the (Hear, hear!)", BASE), BASE.replace("March", "Ｍarch"), re.sub("[,;.]", "", BASE),
     BASE.replace("raised", "ráised"), BASE.replace("dues", "[Interruption.] dues"), BASE.replace("dues", "— An hon. Member: What about the ferries? — dues").replace("asked", "– Mr. Dane: Shame! – asked"), BASE.replace("nobody", "*** inaudible *** nobody"), BASE.replace("a", "а"), BASE.replace("ferries", "boats")],
)
def test_the_way_it_is_written_makes_no_difference(spark, text):
    d = spark.createDataFrame([(1, f"Some words before. {text} And after.")], "doc_id long, text string")
    t = spark.createDataFrame([(7, BASE)], "item_id long, text string")
    assert [tuple(r)[:2] for r in leaked(d, "doc_id", "text", t, "item_id", "text").collect()] == [(1, 7)]


def test_suffix_array_is_sorted_and_rows_do_not_run_together():
    rng = random.Random(5)
    few = VOCABULARY[:3]
    texts = [" ".join(rng.choice(few) for _ in range(n)) for n in (300, 7, 0, 1, 200)] + ["ro ro " * 50, "", "ro ro " * 50]
    words, row = word_hashes(pa.array(texts))
    shard = suffix_array(words, row)
    suffixes = [tuple(words[s : shard.end[s]].tolist()) for s in shard.suffixes]
    assert suffixes == sorted(suffixes) and sorted(shard.suffixes.tolist()) == list(range(len(words)))
    assert len(suffix_array(*word_hashes(pa.array([""]))).suffixes) == 0
    half = BASE.split()
    assert len(search(pa.array([" ".join(half[:12]), " ".join(half[12:])]), prepare([1], [BASE])).row) == 0


def test_depth_is_what_exchanges_leave():
    """The longest run of equal words that is certain, by trying all places of the exchanged words."""
    import itertools

    for n in range(1, 21):
        runs = []
        for changed in itertools.combinations(range(n), n // 10):
            cuts = [-1, *changed, n]
            runs.append(max(b - a - 1 for a, b in zip(cuts, cuts[1:])))
        assert 0 < search_depth(np.array([n]))[0] <= min(runs)


def test_longest_match_and_its_place(spark):
    item = passage(random.Random(3), 40)
    own = [f"own{i}" for i in range(50)]
    docs = [own[:5] + item[8:38] + own[5:9], own[:3] + item[:21] + own[3:6] + item[:25], item[:22]]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    t = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert sorted(map(tuple, leaked(d, "doc_id", "text", t, "item_id", "text").collect())) == [(0, 7, 30, 5, 8), (1, 7, 25, 27, 0), (2, 7, 22, 0, 0)]


@pytest.mark.parametrize("rows", [5, 200, 10_000])
def test_batches_make_no_difference(spark, rows):
    """One passage of one item in 9, 40 and 1,000 documents; a formula that four items share in all of them."""
    rng = random.Random(21)
    own = lambda n: [f"{rng.choice(VOCABULARY)}{rng.randint(0, 10**6)}" for _ in range(n)]
    formula = own(22)
    items = [own(80) for _ in range(3)] + [own(20) + formula + own(20) for _ in range(4)]
    parts, docs, want = [i[10:45] for i in items[:3]], {}, set()
    for number, times in enumerate((9, 40, 1000)):
        for i in range(times):
            part, changed = parts[number], rng.randrange(35) if i % 3 == 0 else -1
            part = [w if k != changed else "other" for k, w in enumerate(part)]
            docs[1000 * number + i] = own(8) + part + own(5) + formula + own(3)
            want.add((1000 * number + i, number))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        found = {tuple(r)[:2] for r in leaked(d, "doc_id", "text", t, "item_id", "text").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == want


def test_remarks_of_any_length(spark):
    remark = "(" + " ".join(passage(random.Random(9), 90)) + ")"
    words = BASE.split()
    rows = [(1, " ".join(words[:12]) + f" {remark} " + " ".join(words[12:])), (2, f"He read out ({BASE}) and sat down. [Laughter.]"), (3, f"open ( {BASE}"), (4, remark)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    t = spark.createDataFrame([(7, BASE), (8, remark)], "item_id long, text string")
    assert {tuple(r)[:2] for r in leaked(d, "doc_id", "text", t, "item_id", "text").collect()} == {(1, 7), (1, 8), (2, 7), (3, 7), (4, 8)}


def test_a_passage_in_many_copies_is_found_and_a_formula_is_not(spark):
    rng = random.Random(11)
    own = lambda n: [f"{rng.choice(VOCABULARY)}{rng.randint(0, 10**6)}" for _ in range(n)]
    formula = own(24)
    items = [own(60), *(own(20) + formula + own(20) for _ in range(3))]
    part = items[0][5:27]  # less than half of its item
    docs = {i: own(30) + part + own(30) for i in range(30)} | {30: part * 12}
    docs |= {i: own(30) + formula + own(30) for i in range(100, 130)} | {200: items[1], 201: items[1][12:46]}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] * 2, "doc_id long, text string")
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    want = {(i, 0) for i in range(31)} | {(200, 1), (201, 1)}
    for frame, size in ((d, 32_000_000), (d.coalesce(1), 300)):
        assert {tuple(r)[:2] for r in leaked(frame, "doc_id", "text", t, "item_id", "text", block_bytes=size).collect()} == want
    few = d.where("doc_id < 108")  # as many texts as a formula may not have
    assert {r["doc_id"] for r in leaked(few, "doc_id", "text", t, "item_id", "text").collect()} == set(range(31)) | set(range(100, 108))


PROSE = ["The council met in {0} and the members agreed that the {1} should be kept. It was said that the {2} could not wait, and nobody spoke against it.",
         "I am told that the {0} near {1} will be closed in the spring. We have asked the minister about the {2}, but the answer is still not here."]


def prose(rng, n=4):
    names = ["Ardvale", "bridge", "harbour", "school", "Norby", "library", "ferry", "market", "budget", "station"]
    return " ".join(rng.choice(PROSE).format(*rng.sample(names, 3)) for _ in range(n))


def spam(rng, kind):
    words = ["sofa", "lamp", "boots", "tyre", "kit"]
    pick = lambda: rng.choice(words)
    return {
        "tags": " ".join(f"#buy{pick().title()}{rng.randint(1, 99)}" for _ in range(60)),
        "links": "\n".join(f"https://shop.{pick()}{rng.randint(1, 999)}.example/{pick()}?id={rng.randint(1, 99)}" for _ in range(30)),
        "words": " ".join(f"{rng.choice(['buy', 'cheap', 'best'])} {pick()}" for _ in range(80)),
        "commas": ", ".join(f"{pick()} {rng.choice(['price', 'sale', 'online'])}" for _ in range(60)),
        "capitals": " ".join(pick().upper() for _ in range(100)),
        "markup": "\n".join(f"* [{pick()} sale](www.{pick()}{i}.test/p/{i})" for i in range(40)),
        "menu": " » ".join(rng.choice(["Home", "Shop", "Cart", "Tags"]) for _ in range(70)),
    }[kind]


KINDS = ["tags", "links", "words", "commas", "capitals", "markup", "menu"]


def test_pages_held_out(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for i in range(600):
        rows.append((i, prose(rng)))
    for i, kind in enumerate(KINDS * 3, 1000):
        rows.append((i, spam(rng, kind) + ("" if i % 2 else "\n" + prose(rng, 1))))
        want.add(i)
    refrain = "We will not close the school, and we will not close the library."
    for i in range(2000, 2010):
        rows.append((i, f" {refrain} ".join(prose(rng, 1) for _ in range(5))))
        rows.append((i + 20, prose(rng, 6) + "\n[1] https://www.papers.example/1\n[2] https://papers.test/2\n#harbour"))
        rows.append((i + 40, "Division 12. Ayes: " + ", ".join(f"{a}{b}, {c}." for a, b, c in zip(rng.sample(VOCABULARY, 30), rng.sample(VOCABULARY, 30), "ABCDEFGHIKLMNOPRSTUVWABCDEFGHI")) + "."))
    edge = [(3000, ""), (3001, None), (3002, "   \n"), (3003, "one"), (None, spam(rng, "tags")), (1000, rows[600][1])]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows + edge], "doc_id long, text string, keywords double")
    got = [r["doc_id"] for r in keyword_pages(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert scored(df.where("false"), "doc_id", "text").count() == 0


def test_a_keyword_page_on_a_third_of_the_rows(spark):
    rng = random.Random(6)
    names = rng.sample(VOCABULARY, 40)
    said = [w for i in range(0, 40, 4) for w in (*names[i : i + 4], names[i])]  # one word in five a moment ago
    page = " ".join(said * 4)
    rows = [(i, prose(rng)) for i in range(400)] + [(i, page) for i in range(1000, 1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in keyword_pages(df, "doc_id", "text").collect()} == set(range(1000, 1200))


@pytest.mark.parametrize("share", [0.05, 0.3, 0.5, 0.8])
def test_the_share_of_such_pages_makes_no_difference(spark, share):
    """Held out: neither the prose nor the pages were seen in training."""
    rng = random.Random(int(share * 100))
    rows, want = [], set()
    for i in range(300):
        if i < 300 * share:
            rows.append((i, spam(rng, KINDS[i % len(KINDS)])))
            want.add(i)
        else:
            rows.append((i, prose(rng, rng.randint(2, 8))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in keyword_pages(df, "doc_id", "text").collect()} == want


def test_the_prose_is_an_argument(spark):
    rng = random.Random(3)
    own = [prose(rng, 5) for _ in range(60)]
    df = spark.createDataFrame([(1, prose(rng, 4)), (2, spam(rng, "words")), (3, spam(rng, "tags"))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in keyword_pages(df, "doc_id", "text", prose=own).collect()) == [2, 3]


def test_very_long_page(spark):
    rng = random.Random(8)
    long = " ".join(prose(rng) for _ in range(5000))
    df = spark.createDataFrame([(1, long), (2, "#sofa #lamp " * 100_000), *[(i, prose(rng)) for i in range(3, 200)]], "doc_id long, text string")
    assert [r["doc_id"] for r in keyword_pages(df, "doc_id", "text").collect()] == [2]


def test_chunk_shapes():
    c = chunks(pa.array(["The NATO #tag www.a-site.example/x 12 — J.Smith K489, sofa SOFA.", "", "Ä ä"]))
    assert c.row.tolist() == [0] * 10 + [2, 2] and c.shape.tolist() == [1, 2, 5, 4, 3, 6, 1, 1, 0, 2, 1, 0]
    assert c.mixed.tolist()[7] and c.closing.tolist()[7:] == [1, -1, 0, -1, -1] and c.hash[8] == c.hash[9] and c.hash[10] == c.hash[11]
    assert train([]).middle == train([""]).middle == (0.0, 0.0, 0.0)


def test_quotas_reach_the_shares():
    plan = quotas({"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4), "gone": (0.4, 9), "zero": (0.0, 1)}, {"a": 1000, "b": 200, "c": 30})
    total = sum(q.want for q in plan)
    assert [q.source for q in plan] == ["a", "b", "c"] and total == 600
    for q in plan:
        assert q.want / total == pytest.approx(q.share, abs=0.002) and q.passes * q.size + q.rest == q.want
    assert quotas({}, {"a": 1}) == [] == quotas({"a": (1.0, 1)}, {})
    assert sum(q.want for q in quotas({"a": (1.0, 1)}, {"a": 500}, total=100)) == 100


def quota_table(units, shards, seed):
    return np.stack([np.bincount(shards_of(i, np.arange(n), units, shards, seed), minlength=shards) for i, n in enumerate(units.tolist())], axis=1)


def test_splitting_tree_is_exact_and_even():
    units = np.array([700, 300, 24])
    out = quota_table(units, 13, 1)
    assert out.sum(0).tolist() == units.tolist() and np.ptp(out.sum(1)) <= 4
    draws = np.stack([quota_table(units, 4, s)[0] for s in range(400)])
    assert np.allclose(draws.mean(0), units / 4, rtol=0.06)
    n, k, total = 300, 256, 1024  # the spread, too, is that of a hypergeometric draw
    assert draws[:, 1].var() == pytest.approx(k * (n / total) * (1 - n / total) * (total - k) / (total - 1), rel=0.3)
    assert shards_of(1, np.array([5, 200]), units, 13, 1).tolist() == shards_of(1, np.arange(300), units, 13, 1)[[5, 200]].tolist()


def test_units_walk_a_very_large_tree():
    units = np.array([9 * 10**11, 4 * 10**10, 3])
    place = np.array([0, 10**10, 10**10 + 1, 4 * 10**10 - 1])
    out = shards_of(1, place, units, 25_000_000, 7)
    assert (np.diff(out) >= 0).all() and 0 <= out.min() and out.max() < 25_000_000 and abs(out[1] / 25_000_000 - 0.25) < 1e-4


@pytest.mark.parametrize(("good", "bad", "take"), [(300, 700, 200), (5, 2000, 900), (40_000, 60_000, 30_000), (3, 2, 4), (900, 30, 400)])
def test_rejection_draws_the_same(good, bad, take):
    rng = np.random.default_rng(3)
    own = np.array([by_rejection(good, bad, take, rng) for _ in range(4000)])
    plain = rng.hypergeometric(good, bad, take, 4000)
    spread = max(plain.std(), 0.2)
    assert abs(own.mean() - plain.mean()) < 5 * spread / 4000**0.5 + 1e-9 and own.std() == pytest.approx(plain.std(), rel=0.08, abs=0.02)
    assert own.min() >= max(0, take - bad) and own.max() <= min(good, take)
    assert np.abs(np.quantile(own, [0.1, 0.5, 0.9]) - np.quantile(plain, [0.1, 0.5, 0.9])).max() <= 1 + 0.1 * spread


def test_permutation_is_one_and_looks_random():
    for count in (1, 2, 3, 10, 1000, 4097):
        assert sorted(permuted(np.arange(count), count, 5).tolist()) == list(range(count))
    one, other = (permuted(np.arange(4000), 4000, k) for k in (1, 2))
    assert (one != other).mean() > 0.99 and abs(np.corrcoef(np.arange(4000), one)[0, 1]) < 0.06
    steps = np.diff(one) % 4000
    assert np.unique(steps).size > 2000 and abs(np.corrcoef(one, other)[0, 1]) < 0.06


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.randint(1, 3)), s, 1, 2) for i, s in enumerate(["big"] * 400 + ["mid"] * 80 + ["low"] * 12 + ["other"] * 20)]
    docs += docs[:30] + [(900, None, "mid", 1, 2), (901, "", "mid", 1, 2), (None, "lost text", "big", 1, 2), (902, "no source", None, 1, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int, rank int")
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("low", 0.2, 3), ("absent", 0.1, 1)], "source string, target_share double, max_repeats long")
    out = mixture(d, t, "doc_id", "source", "text", block_tokens=200, shard_tokens=1000).cache()
    rows = out.collect()
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    most = {"big": 1, "mid": 2, "low": 3}
    assert all(r["copy"] < most[r["source"]] for r in rows)
    got = {r["source"]: r for r in shares(out, t).collect()}
    for s, aim in (("big", 0.5), ("mid", 0.3), ("low", 0.2)):
        assert got[s]["share"] == pytest.approx(aim, abs=0.02)
    assert got["absent"]["tokens"] == 0 and got["low"]["most_copies"] == 3
    shards = {r["shard"] for r in rows}
    assert len(shards) > 2
    for s in shards:
        assert sorted(r["place"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    rules = {r["source"]: tuple(r)[2:] for r in kept_rules(out, t, 0.02).collect()}
    assert rules == {"big": (True, True, 0), "mid": (True, True, 0), "low": (True, True, 0), "absent": (False, True, 0)}
    again = mixture(d.repartition(7), t, "doc_id", "source", "text", block_tokens=200, shard_tokens=1000)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}
    assert mixture(d.where("false"), t, "doc_id", "source", "text").count() == 0 == mixture(d, t.where("false"), "doc_id", "source", "text").count()


def test_remarks_equal_plain():
    from palimpsest.llm.codepoints import to_codes
    from palimpsest.llm.words import in_remarks

    rng = random.Random(12)
    texts = ["".join(rng.choice(["a", "b", " ", "(", ")", "[", "]", "*", "*", " — ", ":"]) for _ in range(rng.randint(0, 30))) for _ in range(500)] + [""]
    codes, offsets, _ = to_codes(pa.array(texts))
    inside = in_remarks(codes, offsets)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        plain, left = [False] * len(text), text
        for pattern in (r"[(\[][^()\[\]]*[)\]]",) * 2 + (r"\*{2,}[^*]*\*{2,}",):
            for m in re.finditer(pattern, text if "{2,}" in pattern else left):
                plain[m.start() : m.end()] = [True] * (m.end() - m.start())
            left = re.sub(pattern, lambda m: "_" * len(m[0]), left)
        for m in re.finditer(r"(?<![^ ])— [^—]*:[^—]*(?<= )—(?![^ ])", text):
            plain[m.start() : m.end()] = [True] * (m.end() - m.start())
        letters = [i for i, c in enumerate(text) if c in "ab"]
        assert [inside[a + i] for i in letters] == [plain[i] for i in letters], text
