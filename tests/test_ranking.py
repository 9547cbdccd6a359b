from pyspark.sql import functions as F

from strandweave.operators.ranking import placed, rank_by_count


def test_places_follow_the_order(spark, rows):
    orders = [-(2**40), -5, 0, 1, 2, 3, 10**15, 10**15 + 1]
    d = spark.createDataFrame([(o, "ab"[i % 2]) for i, o in enumerate(orders)], "ord long, k string")
    assert rows(placed(d, [], "ord"), "ord", "place") == sorted(((o, i) for i, o in enumerate(orders)), key=repr)
    assert rows(placed(d, ["k"], "ord"), "ord", "place") == sorted(((o, i // 2) for i, o in enumerate(orders)), key=repr)
    assert placed(d.limit(0), ["k"], "ord").count() == 0
    many = spark.range(5000).select((F.col("id") * 7 % 5003).alias("ord"), F.lit("x").alias("k"))
    got = placed(many, ["k"], "ord").orderBy("ord").select("place").collect()
    assert [r.place for r in got] == list(range(5000))


def test_ranks_by_size(spark, rows):
    d = spark.createDataFrame([("c", 2), ("a", 2), ("b", 7), ("d", 1)], "name string, n long")
    assert rows(rank_by_count(d, "name"), "rank", "name") == [(0, "b"), (1, "a"), (2, "c"), (3, "d")]
    assert rank_by_count(d.limit(0), "name").count() == 0
