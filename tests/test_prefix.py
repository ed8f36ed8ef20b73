"""Running sums and neighbours in ranges against plain windows."""

import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import context, prefix


def rows_of(spark, n=900):
    random.seed(31)
    data = [(random.choice(["hot"] * 8 + ["a", "b", None]), i, random.choice([None, 1, 5, 1 << 40]), Decimal(i) / 100, [f"v{i}"]) for i in range(n)]
    random.shuffle(data)
    return spark.createDataFrame(data, "k string, o long, v long, m decimal(12,2), g array<string>").repartition(5)


def test_running_sums(spark):
    rows = rows_of(spark)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = sorted(map(tuple, rows.select("o", F.sum(F.coalesce("v", F.lit(0))).over(w), F.sum("m").over(w), F.row_number().over(Window.partitionBy("k").orderBy("o"))).collect()))
    for ranges in (1, 7, 40):
        got = prefix.running(rows, "k", "o", ranges, s=F.col("v"), t=F.col("m"), n=F.lit(1)).select("o", "s", "t", "n")
        assert sorted(map(tuple, got.collect())) == want
    assert prefix.running(rows.limit(0), "k", "o", s=F.col("v")).count() == 0


def test_no_range_holds_a_hot_key(spark):
    placed = prefix.ranged(rows_of(spark, 4000).select("k", "o"), "k", "o", 8)
    most = placed.groupBy("plumb_range").count().agg(F.max("count")).first()[0]
    assert most < 1200 and placed.where("k = 'hot'").select("plumb_range").distinct().count() >= 5


def test_previous_rows(spark):
    rows = rows_of(spark)
    before = F.lag("g").over(Window.partitionBy("k").orderBy("o"))
    want = sorted(map(tuple, rows.select("o", before.alias("h"), F.lag("v").over(Window.partitionBy("k").orderBy("o")).alias("u")).collect()), key=str)
    for ranges in (1, 9, 300):
        got = prefix.with_previous(rows, "k", "o", ranges, h="g", u="v").select("o", "h", "u")
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_budgets_agree(spark):
    rows = rows_of(spark).select("k", "o", F.lit(3).alias("c")).where("k is not null")
    plain = context.within_budget(rows, "k", "o", F.col("c"), F.lit(500))
    spread = context.within_budget(rows, "k", "o", F.col("c"), F.lit(500), spread=True)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))
