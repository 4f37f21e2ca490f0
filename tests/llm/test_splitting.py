import random

import pytest

from pyspark.sql import functions as F

from palimpsest.llm.splitting import BLOCK, pieces, prefix_sums, rejoined

SCHEMA = "k long, content binary, limit long, start int"


def cut(spark, *rows):
    df = spark.createDataFrame([(i, None if c is None else bytearray(c), n, 7) for i, (c, n) in enumerate(rows)], SCHEMA)
    out = {}
    for r in pieces(df, "content", "limit").collect():
        out.setdefault(r["k"], []).append((r["piece_no"], r["start"], r["overlap"], bytes(r["piece"])))
    return {k: sorted(v) for k, v in out.items()}


def check(content, limit, found):
    assert b"".join(p[o:] for _, _, o, p in found) == content
    assert [n for n, *_ in found] == list(range(len(found)))
    end = 0
    for (_, s, o, p), before in zip(found, [None, *found]):
        assert len(p) <= limit and s == end and o <= 255
        if before:
            assert before[3].endswith(p[:o]) and (o >= min(252, (limit - 4) // 2 - 3, s) or limit < 16)
        end = s + len(p) - o


TEXT = "Der Höhlenbär schläft. ".encode()


@pytest.mark.parametrize("limit", [9, 40, 300, 600, 1000, 5000])
def test_random_contents(spark, limit):
    rng = random.Random(limit)
    parts = [b"word ", b"\n", b"\n\n", b"\r\n", b"\r\n\r\n", "ö".encode(), "漢字".encode(), b"x" * 50, TEXT, "　".encode()]
    rows = [(b"".join(rng.choice(parts) for _ in range(rng.randint(0, 400))), limit) for _ in range(12)]
    got = cut(spark, *rows)
    for i, (content, _) in enumerate(rows):
        check(content, limit, got.get(i, []))
        for _, _, _, p in got.get(i, []):
            p.decode()


def test_boundaries_in_order_of_strength(spark):
    para, line, word, solid = b"a " * 300 + b"\n\n" + b"b " * 300, b"a " * 300 + b"\n" + b"b " * 300, b"a " * 600, b"a" * 1300
    got = cut(spark, (para, 1000), (line, 1000), (word, 1000), (solid, 1000), ("ö".encode() * 700, 1001))
    assert got[0][0][3].endswith(b"\n\n") and got[1][0][3].endswith(b"\n")
    assert got[2][0][3].endswith(b" ") and len(got[2][0][3]) == 744
    assert len(got[3][0][3]) == 745 and all(p.decode() for _, _, _, p in got[4])


def test_edges(spark):
    got = cut(spark, (None, 10), (b"", 10), (b"short", 10), (b"exactly ten"[:10], 10), (b"no limit" * 9, None), (b"zero" * 9, 0), (b"abcdefgh", 1), (b"\xff\x80\x80\x80\x80" * 20, 12))
    assert 0 not in got and 1 not in got and [len(got[i]) for i in (2, 3, 4, 5)] == [1, 1, 1, 1]
    assert [p for *_, p in got[6]] == [bytes([c]) for c in b"abcdefgh"]
    check(b"\xff\x80\x80\x80\x80" * 20, 12, got[7])


def test_very_long_and_repeated(spark):
    long = (TEXT * 3 + b"\n") * 20_000
    got = cut(spark, (long, 6000), (long[:7000], 6000), (long[:7000], 6000))
    check(long, 6000, got[0])
    assert got[1] == got[2] and len(got[1]) == 2


def test_prefix_sums_across_blocks(spark):
    for n in (0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 7):
        values = [(7 * i) % 11 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<bigint>")
        assert df.select(prefix_sums(F.col("v"))).first()[0] == [sum(values[:i]) for i in range(n)]


def test_many_pieces(spark):
    content = b"one two three four\n" * 20_000
    found = cut(spark, (content, 40))[0]
    check(content, 40, found)
    assert len(found) > 9 * BLOCK
    df = spark.createDataFrame([(1, bytearray(content), 40), (2, bytearray(b"short"), 40), (3, bytearray(b""), 40), (4, None, 40), (5, bytearray(b"x" * 90), None)], "k long, content binary, limit long")
    got = {r["k"]: tuple(r)[1:] for r in rejoined(df, ["k"], "content", "limit").collect()}
    import hashlib

    whole = lambda c, n: (len(c), hashlib.md5(c).hexdigest(), 0, 0, 0, n)
    assert got == {1: whole(content, True), 2: whole(b"short", False), 5: whole(b"x" * 90, False)}
