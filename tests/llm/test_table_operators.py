"""Preference pairs, exact top-k and the URL filter on small hard cases, and the registered queries."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from check import TABLES, plain
from understory.llm import chat, topk, urls
from understory.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TURN = "pair_id long, turn long, role string, text string"


def test_preference_pairs(spark):
    shared = [(1, 0, "user", "hi"), (1, 4, "assistant", "yes")]
    chosen = shared + [(1, 7, "user", "so?"), (1, 9, "assistant", "good"), (2, 0, "user", None), (3, 0, "user", "a"), (None, 0, "user", "x"), (4, None, "user", "x")]
    rejected = shared + [(1, 8, "user", "so?"), (1, 9, "assistant", "bad"), (1, 10, None, "é"), (2, 0, "user", ""), (3, 0, "user", "b"), (3, 0, "user", "a"), (5, 1, "assistant", "alone")]
    make = lambda rows: spark.createDataFrame(rows, TURN).selectExpr("*", "'x' AS prompt", "1 AS place", "2 AS said")
    got = {r.pair_id: r for r in chat.preference_pairs(make(chosen), make(rejected)).collect()}
    assert set(got) == {1, 2, 3, 5}
    one = got[1]
    assert one.prompt_turns == 3 and one.prompt.count("<|end|>") == 3 and "good" not in one.prompt
    a, b = map(int, one.chosen_mask.split(":"))
    assert one.chosen[a:b] == "good\n"
    a, b = map(int, one.rejected_mask.split(":"))
    assert one.rejected[a:b] == "bad\n" and one.rejected.endswith("<||>\né\n<|end|>\n")
    assert got[2].prompt_turns == 1 and got[2].chosen == got[2].rejected == ""
    assert got[3].prompt_turns == 1  # of two rows for one turn the least stands
    assert got[5].prompt == got[5].chosen == "" and got[5].rejected_mask == "14:20"
    assert chat.preference_pairs(make(chosen[:0]), make(rejected[:0])).collect() == []


@pytest.mark.parametrize("width", [64, 5])
def test_top_k_equals_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(width)]) for i in range(300)]
    rows += [(i + 400, rows[7][1]) for i in range(30)] + [(500, None), (501, []), (502, [float("nan")] * width), (None, rows[1][1]), (503, [1.0])]
    rows += [(7, rows[7][1]), (8, rows[9][1])]
    rows.append((504, [None] + rows[3][1][1:]))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS score", "4 AS width")
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows
            if i is not None and v and len(v) == width and None not in v and not np.isnan(v).any()]
    for ask in (vectors.filter("vec_id % 50 = 7 or vec_id = 405"), vectors.limit(0)):
        got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(ask, vectors).collect()]
        want = []
        for q in sorted({r.vec_id for r in ask.collect()} & {i for i, _ in good}):
            best = {}
            for own in [v for i, v in good if i == q]:
                for i, v in good:
                    if i != q:
                        best[i] = max(best.get(i, -10 ** 9), int(own @ v))
            want += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
        assert sorted(got) == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_top_k_of_large_values_is_exact(spark):
    rows = [(i, [float(10 ** 6 + i * 7 % 11), float(3 - i)]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(vectors.filter("vec_id = 0"), vectors, k=3).collect()
    whole = {i: int(256 * v[0]) * int(256 * rows[0][1][0]) + int(256 * v[1]) * int(256 * rows[0][1][1]) for i, v in rows if i}
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == sorted(whole.items(), key=lambda x: (-x[1], x[0]))[:3]


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"host{i}.example" for i in range(4000)]
    listed = keys[::37] + ["elsewhere.example", None]
    universe = spark.createDataFrame([(k,) for k in keys + keys[:5] + [None]], "key string")
    levels = urls.cascade(universe, spark.createDataFrame([(k,) for k in listed], "key string"))
    assert len(levels) > 1
    got = {r["key"] for r in universe.filter(urls.listed_in(universe["key"], levels)).collect()}
    assert got == set(keys[::37])
    assert urls.cascade(universe, spark.createDataFrame([], "key string")) == []


def test_urls(spark):
    rules = [("org", "/", "allow"), ("a.org", "/x", "block"), ("com", "/fr/", "block")]
    rows = ["http://A.org/x?y", "https://sub.a.org/xy#z", "http://ba.org/x", "http://a.org", "http://b.com/fr/", "http://b.com?fr/", "no url",
            None, "", "://", "x://bad.net/p", "http://www.bad.net", "http://notbad.net/", "http://É.NET/\n/q://w", "http://a.org/x?y"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").selectExpr("*", "'h' AS host", "'r' AS rule", "1 AS hit")
    got = {r.page_id: tuple(r)[1:] for r in urls.verdicts(pages, rules, spark.createDataFrame([("bad.net",)], "key string")).collect()}
    assert got[0] == ("a.org", "/x", "a.org/x", "block") == got[14] and got[1] == ("sub.a.org", "/xy", "a.org/x", "block")
    assert got[2][2:] == ("org/", "allow") and got[3] == ("a.org", "", None, "allow")
    assert got[4][2:] == ("com/fr/", "block") and got[5] == ("b.com", "", None, "allow")
    assert got[6] == got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][3] == got[11][3] == "block" and got[12][3] == "allow" and got[13] == ("É.net", "/\n/q://w", None, "allow")


def test_a_list_in_shards_is_exact(spark):
    """Domains and addresses on one list, with so few bits allowed that it is cut into shards."""
    urls_ = [f"http://h{i % 300}.site{i % 40}.net/p{i}" for i in range(3000)]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    listed = {u[7:] for u in urls_[::17]} | {"site3.net", "h8.site8.net", "elsewhere.net"}
    blocked = spark.createDataFrame([(k,) for k in sorted(listed)], "key string")
    got = {r.page_id for r in urls.verdicts(pages, [], blocked, most_bits=500).collect() if r.verdict == "block"}
    assert got == {i for i, u in enumerate(urls_) if u[7:] in listed or ".site3.net/" in u or "h8.site8.net/" in u}


@pytest.mark.skipif(not os.path.isdir(FOLDER.replace("0.001", "0.01")), reason="test tables are absent")
def test_the_query_list_takes_several_levels(spark):
    """All addresses of the pages and those of the blocked families: the levels alternate and end exactly."""
    pages = spark.read.parquet(FOLDER.replace("0.001", "0.01") + "/pages.parquet")
    keys = pages.select(F.concat(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("key"))
    listed = keys.filter(F.col("key").rlike("casino-win|spam-farm|free-bets|ads-track|adult-x|cheap-pills"))
    levels = urls.cascade(keys, listed)
    assert len(levels) > 1 and sum(bits for _, bits, _ in levels) > 64
    got = {r.key for r in keys.filter(urls.listed_in(F.col("key"), levels)).collect()}
    assert got and got == {r.key for r in listed.collect()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cur = con.execute(SQL[name])
    places = {d[0]: i for i, d in enumerate(cur.description)}
    assert columns == sorted(places)
    want = sorted(tuple(plain(w[places[c]]) for c in columns) for w in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_ten_operators_and_the_pipeline_are_registered():
    names = list(driver.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
