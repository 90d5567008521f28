import random

from pyspark.sql import functions as F

from screenlens.functions.rounding import exact_round
from screenlens.operators import ordered as O
from screenlens.operators.clusters import with_leaders
from screenlens.operators.intervals import overlap_pairs, stretches


def test_scans_cross_chunks_of_one_huge_key(spark, both_ways):
    rng = random.Random(1)
    values = [(("hot" if i % 3 else f"k{i % 5}"), i, rng.randint(0, 9) if rng.random() < 0.4 else None) for i in range(500)]
    df = spark.createDataFrame(values, "k string, i int, v int")
    got = O.Ordered.of(df, ["k"], ["i"]).scan(
        n=O.running_sum(F.lit(1)),
        top=O.running_max(F.col("v")),
        prev=O.latest(F.col("v"), inclusive=False),
        following=O.upcoming(F.col("v"), inclusive=False),
    ).rows().collect()
    by_key = {}
    for k, i, v in values:
        by_key.setdefault(k, []).append((i, v))
    for r in got:
        mine = by_key[r.k]
        at = [x[0] for x in mine].index(r.i)
        seen = [v for _, v in mine[: at + 1] if v is not None]
        before = [v for _, v in mine[:at] if v is not None]
        after = [v for _, v in mine[at + 1 :] if v is not None]
        assert r.n == at + 1
        assert r.top == (max(seen) if seen else None)
        assert r.prev == (before[-1] if before else None)
        assert r.following == (after[0] if after else None)


def test_neighbours_across_chunk_edges(spark, both_ways):
    df = spark.range(25).select(F.lit("v").alias("k"), F.col("id").alias("i"))
    got = O.neighbours(df, ["k"], "i", {"p": F.col("i")}, {"n": F.col("i")})
    for r in got.collect():
        assert r.p == (r.i - 1 if r.i else None) and r.n == (r.i + 1 if r.i < 24 else None)


def test_neighbours_whatever_numbers_are_missing(spark, both_ways):
    rng = random.Random(8)
    rows = [(k, i, rng.choice([None, rng.random()])) for k in "abc" for i in sorted(rng.sample(range(100_000), 200))]
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    got = O.neighbours(df, ["k"], "i", {"p": F.col("v"), "pi": F.col("i")}, {"n": F.col("v"), "ni": F.col("i")})
    found = {(r.k, r.i): (r.p, r.pi, r.n, r.ni) for r in got.collect()}
    for k in "abc":
        mine = [(None, None), *[(v, i) for kk, i, v in rows if kk == k], (None, None)]
        for before, (_, i), after in zip(mine, mine[1:], mine[2:]):
            assert found[k, i] == (*before, *after)


def test_no_job_while_a_plan_is_built(spark):
    spark.sparkContext.setJobGroup("plan", "no job")
    df = spark.range(1000).select(F.lit("v").alias("k"), F.col("id").alias("i"), (F.col("id") * 1.5).alias("t"))
    O.number_rows(O.neighbours(df, ["k"], "i", {"p": F.col("t")}), ["k"], ["t"], "no").schema
    pairs = overlap_pairs(df, df.withColumnsRenamed({"i": "j", "t": "u"}), ["k"], ("t", "t"), ("j", "u"), F.lit(True))
    with_leaders(df.withColumnRenamed("i", "idx"), ["k"], 3.0).schema, pairs.schema
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_asof_directions_and_ties(spark, both_ways):
    left = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 1.0)], "k string, at double")
    right = spark.createDataFrame([("a", 2.0, 1), ("a", 2.0, 2), ("a", 5.0, 3)], "k string, t double, n int")

    def found(**kw):
        out = O.asof(left, right, ["k"], F.col("at"), F.col("t"), {"n": F.col("n")}, tie=F.col("n"), **kw)
        return {(r.k, r.at): r.n for r in out.collect()}

    assert found() == {("a", 1.0): None, ("a", 2.0): 2, ("a", 9.0): 3, ("b", 1.0): None}
    assert found(forward=True) == {("a", 1.0): 1, ("a", 2.0): 1, ("a", 9.0): None, ("b", 1.0): None}
    assert found(strict=True)[("a", 2.0)] is None
    assert found(forward=True, strict=True)[("a", 2.0)] == 3


def test_a_long_text_is_one_row(spark):
    df = spark.range(100_000).select(F.lit("d").alias("k"), F.col("id").alias("i"), F.format_string("%0100d", "id").alias("s"))
    rows = O.joined_text(df, ["k"], ["i"], F.col("s"), "\n").collect()
    assert [r.text for r in rows] == ["\n".join(f"{i:0100d}" for i in range(100_000))]


def test_rounding_equals_correct_rounding(spark):
    rng = random.Random(3)
    xs = [rng.choice([1, -1]) * round(rng.uniform(0, 5000), rng.randint(1, 5)) for _ in range(2000)]
    xs += [i / 8 for i in range(200)] + [2.675, 0.35, 6.25, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (1, 2, 3, 4):
        assert all(r.r == round(r.x, d) for r in df.select("x", exact_round(F.col("x"), d).alias("r")).collect())


def test_overlap_pairs_equal_all_pairs(spark, both_ways):
    rng = random.Random(4)

    def spans(n):
        out = [(rng.choice("hhhhab"), round(rng.uniform(0, 50), 1), rng.choice([0, 0.1, 1, 3, 40]), i) for i in range(n)]
        out = [(k, s, round(s + d, 1), i) for k, s, d, i in out]
        # broken ends, ends before starts, nulls
        return [*out, ("h", 3.0, 1e12, n), ("h", 9.0, 2.0, n + 1), ("a", None, 4.0, n + 2), ("a", 1.0, None, n + 3), ("h", -1e9, -5.0, n + 4)]

    a, b = spans(120), spans(150)
    left = spark.createDataFrame(a, "k string, ls double, le double, l int")
    right = spark.createDataFrame(b, "k string, rs double, re double, r int")
    got = overlap_pairs(left, right, ["k"], ("ls", "le"), ("rs", "re"), F.col("l") != F.col("r"))
    whole = lambda rows: [(k, s, max(s, e), i) for k, s, e, i in rows if s is not None and e is not None]
    expected = [
        (i, j) for k, s, e, i in whole(a) for m, u, v, j in whole(b) if k == m and u <= e and s <= v and i != j
    ]
    assert sorted((r.l, r.r) for r in got.collect()) == sorted(expected)


def test_a_broken_end_costs_a_row_per_cut_of_its_own_key(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    points = spark.range(2000).select(F.lit("v").alias("k"), (F.col("id") * 1.0).alias("p"), "id")
    one = spark.createDataFrame([("v", 5.0, 1e300, 1), ("v", 1.0, 2.0, 2)], "k string, a double, b double, n int")
    got = overlap_pairs(points, one, ["k"], ("p", "p"), ("a", "b"), F.lit(True)).groupBy("n").count().collect()
    assert {r.n: r["count"] for r in got} == {1: 1995, 2: 2}


def brute_leaders(rows, window):
    found, lead = {}, {}
    for k, i, t in sorted(rows):
        if k not in lead or t - lead[k][1] > window:
            lead[k] = (i, t)
        found[k, i] = lead[k][0]
    return found


def test_leaders_equal_brute_force(spark, both_ways):
    rng = random.Random(6)
    rows = [("hot", i, round(i * 0.1, 1)) for i in range(900)]  # one train without a gap
    for k in "ab":
        t = 0.0
        for i in range(150):
            t = round(t + rng.choice([0.0, 0.1, 0.2, 0.5, 0.6, 3.0]), 1)
            rows.append((k, 7 * i, t))
    got = with_leaders(spark.createDataFrame(rows, "k string, idx bigint, t double"), ["k"], 0.5)
    assert {(r.k, r.idx): r.leader for r in got.collect()} == brute_leaders(rows, 0.5)


def test_an_endless_train_is_spread_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr("screenlens.operators.ordered.CHUNK_BYTES", 1)
    n, step = 400_000, 0.125  # exact in binary; every fifth sample leads
    train = spark.range(n).select(F.lit("v").alias("k"), F.col("id").alias("idx"), (F.col("id") * step).alias("t"))
    led = with_leaders(train, ["k"], 0.5)
    found = led.agg(F.count("*"), F.count_if(F.col("leader") != F.col("idx") - F.col("idx") % 5)).first()
    assert tuple(found) == (n, 0)
    table, is_cut = O.cut(train, ["k"], ["idx"])
    sizes = [r["count"] for r in table.groupBy(O.CHUNK).count().collect()]
    assert is_cut and len(sizes) == 4 and max(sizes) < n / 2


def test_chunks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """However many rows a partition or a key has, a task works through chunks of the stated size; results stay the same."""
    monkeypatch.setattr("screenlens.operators.ordered.CHUNK_BYTES", 1)
    monkeypatch.setattr("screenlens.operators.ordered.CHUNK_BITS", 4)
    df = spark.range(1000).select(F.when(F.col("id") < 900, "a").otherwise("b").alias("k"), F.col("id").alias("n"))
    staged, is_cut = O.cut(df, ["k"], ["n"])
    assert is_cut
    sizes = staged.groupBy(O.CHUNK).agg(F.count("*").alias("c"), F.count_if(O.FIRST).alias("f")).collect()
    assert max(r.c for r in sizes) <= 16 and {r.f for r in sizes} == {1}
    scans = {"total": O.running_sum(F.col("n")), "ahead": O.upcoming(F.when(F.col("n") % 300 == 7, F.col("n")))}
    got = O.Ordered.of(df, ["k"], ["n"]).scan(**scans).rows().collect()
    for r in got:
        begin, end = (0, 900) if r.k == "a" else (900, 1000)
        assert r.total == sum(range(begin, r.n + 1))
        assert r.ahead == next((m for m in range(r.n, end) if m % 300 == 7), None)
    assert len(got) == 1000


def test_stretches_of_an_interval_join_are_bounded(spark, monkeypatch):
    monkeypatch.setattr("screenlens.operators.ordered.CHUNK_BYTES", 1)
    monkeypatch.setattr("screenlens.operators.ordered.CHUNK_BITS", 4)
    spans = spark.range(1000).select(F.lit("v").alias("k"), F.col("id").cast("double").alias("_s"))
    (row,) = stretches(spans, ["k"], 4).collect()
    edges = [*row["_cuts"], 1000.0]
    assert max(b - a for a, b in zip(edges, edges[1:])) <= 16
    left = spans.select("k", F.col("_s").alias("a"), (F.col("_s") + F.when(F.col("_s") % 100 == 5, 300).otherwise(2)).alias("b"))
    right = spans.where("_s % 7 = 0").select("k", F.col("_s").alias("p"), (F.col("_s") + 3).alias("q"))
    got = overlap_pairs(left, right, ["k"], ("a", "b"), ("p", "q"), F.lit(True)).select("a", "p").collect()
    want = [(float(i), float(p)) for i in range(1000) for p in range(0, 1000, 7) if i <= p + 3 and p <= i + (300 if i % 100 == 5 else 2)]
    assert sorted(map(tuple, got)) == want
