"""Set operations on rows that differ."""

from churnlake.operators import setops as so


def test_unseen_categories_lists_each_new_value_once(spark):
    train = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "c string, n int, e string")
    test = spark.createDataFrame([("a", 1, "y"), ("z", 3, "y"), ("z", None, None), ("b", 2, "x")], "c string, n int, e string")
    got = sorted(map(tuple, so.unseen_categories(train, test, ["c", "n", "e"]).collect()))
    assert got == [("c", "z"), ("e", "y"), ("n", "3")]
    assert so.unseen_categories(test, test, ["c", "n", "e"]).count() == 0
    assert so.unseen_categories(train.limit(0), train, ["e"]).collect() == [("e", "x")]


def test_id_overlap_and_population(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",)], "customer_id string")
    b = spark.createDataFrame([("2",), ("3",)], "customer_id string")
    assert so.id_overlap(a, b).first()[0] == 1 and so.population_total(a, b).first()[0] == 5
