"""Ordered scans against plain Python, with slices of a few rows so that every border case occurs."""

import random

import pytest
from pyspark.sql import functions as F

from parley import ordered


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(5)
    data = []
    for m in ("a", "b", "c"):
        pos = 0
        for _ in range({"a": 40, "b": 7, "c": 1}[m]):
            pos += rnd.choice([1, 1, 1, 9])
            data.append((m, pos, rnd.choice([None, 1, 2, 3]), rnd.choice("xyz")))
    return data, spark.createDataFrame(data, "m string, p long, v long, l string")


def per_key(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: r[1]) for k, v in out.items()}


@pytest.mark.parametrize("width", [2, 5, 1000])
def test_scan(table, width):
    data, df = table
    got = ordered.scan(df, ["m"], "p", prev={"pv": F.col("v")}, last={"lv": F.col("v")}, following={"nv": F.col("v")},
                       sums={"s": F.coalesce("v", F.lit(0))}, width=width).collect()
    want = {}
    for k, rs in per_key(data).items():
        for i, r in enumerate(rs):
            known = [x[2] for x in rs[:i] if x[2] is not None]
            after = [x[2] for x in rs[i + 1:] if x[2] is not None]
            upto = [x[2] for x in rs[:i + 1] if x[2] is not None]
            want[(k, r[1])] = (known[-1] if known else None, upto[-1] if upto else None, after[0] if after else None, sum(x[2] or 0 for x in rs[:i + 1]))
    assert {(r.m, r.p): (r.pv, r.lv, r.nv, r.s) for r in got} == want


@pytest.mark.parametrize("width", [2, 5, 1000])
def test_runs_and_numbers(table, width):
    data, df = table
    got = ordered.runs(df, ["m"], "p", ["l", "p"], lambda b, r: (b["l"] != r["l"]) | (r["p"] - b["p"] > 5), width=width)
    got = {(r.m, r.p): r.run for r in got.collect()}
    num = {(r.m, r.p): r.i for r in ordered.number_rows(df, ["m"], "p", name="i", width=width).collect()}
    for k, rs in per_key(data).items():
        begin = None
        for i, r in enumerate(rs):
            if i == 0 or rs[i - 1][3] != r[3] or r[1] - rs[i - 1][1] > 5:
                begin = r[1]
            assert got[(k, r[1])] == begin
            assert num[(k, r[1])] == i


def test_one_exchange_per_scan(table):
    """The slice summaries read the exchange the windows read."""
    _, df = table
    out = ordered.scan(df.repartition(2), ["m"], "p", sums={"s": F.col("v")})
    out = ordered.scan(out, ["m"], "p", prev={"q": F.col("s")})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 2
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1


def test_next_match_and_overlaps(spark):
    rnd = random.Random(3)
    left = [("k", i, rnd.uniform(0, 50)) for i in range(40)]
    right = [("k", j, 5.0 * j) for j in range(9)]
    l = spark.createDataFrame(left, "m string, i long, t double")
    r = spark.createDataFrame(right, "m string, j long, u double")
    got = {x.i: (x.match.j if x.match else None) for x in ordered.next_match(l, r, ["m"], "t", "u", ["j"], tie="j", width=7.0).collect()}
    for _, i, t in left:
        hit = [j for _, j, u in right if u >= t]
        assert got[i] == (hit[0] if hit else None)
    a = [("k", i, s, s + rnd.uniform(0, 9)) for i, s in enumerate(rnd.uniform(0, 60) for _ in range(30))]
    b = [("k", i, s, s + rnd.uniform(0, 9)) for i, s in enumerate(rnd.uniform(0, 60) for _ in range(30))]
    da = spark.createDataFrame(a, "m string, i long, start double, end double")
    db = spark.createDataFrame(b, "m string, j long, r_start double, r_end double")
    pairs = [(x.i, x.j) for x in ordered.overlapping(da, db, ["m"], bucket=4.0).collect()]
    assert sorted(pairs) == sorted((x[1], y[1]) for x in a for y in b if max(x[2], y[2]) < min(x[3], y[3]))


def test_equal_values_are_spread(spark):
    """Numbers by (value, tie) where almost all rows share a key and a value; no range holds much more than its share."""
    data = [("hot", 1.0 if i % 50 else float(i), i) for i in range(20_000)] + [(f"k{i % 30}", float(i % 3), i) for i in range(600)] + [(None, 2.0, 1), (None, 1.0, 2)]
    df = spark.createDataFrame(data, "k string, v double, i long").repartition(5)
    out = ordered.place_rows(df, ["k"], "v", ties=("i",), name="n", start=1)
    want = {}
    for k, v, i in sorted(data, key=lambda r: (r[0] or "", r[1], r[2])):
        want[k, i] = want.get(("last", k), 0) + 1
        want["last", k] = want[k, i]
    got = out.collect()
    assert len(got) == len(data) and all(r.n == want[r.k, r.i] for r in got)
    ranges = df.repartitionByRange(4, "k", "v", "i").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < 0.5 * len(data)
    assert ordered.place_rows(df.limit(0), ["k"], "v", ties=("i",)).count() == 0
