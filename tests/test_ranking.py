import random

from wardlake.operators.ranking import Pager, order, paginate, top_n


def people(spark):
    return spark.createDataFrame(
        [("b", 2, 1), ("a", 2, 2), (None, 2, 3), ("c", None, 4), ("d", 5, 5)],
        "name string, score int, id int",
    )


def test_nulls_come_last_in_both_directions(spark):
    df = people(spark)
    assert [r.id for r in df.orderBy(*order("-score", "name")).collect()] == [5, 2, 1, 3, 4]
    assert [r.id for r in df.orderBy(*order("score", "-name")).collect()] == [1, 2, 3, 5, 4]


def test_top_n_keeps_n_rows_per_task(spark):
    top = top_n(people(spark), 2, "-score", "name")
    assert [r.id for r in top.collect()] == [5, 2]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_pages(spark):
    df = people(spark)
    assert [r.id for r in paginate(df, 2, 2, "-score", "name").collect()] == [1, 3]
    assert [r.id for r in paginate(df, 3, 2, "-score", "name").collect()] == [4]
    assert paginate(df, 4, 2, "-score", "name").collect() == []


def test_pager_serves_every_page_once(spark):
    rng = random.Random(7)
    values = [(None if n % 10 == 0 else rng.randrange(50), n) for n in range(503)]
    df = spark.createDataFrame(values, "v int, id int").repartition(7)
    expected = [r.id for r in df.orderBy(*order("-v", "id")).collect()]
    pager = Pager(df, 60, "-v", "id")
    assert (pager.total, pager.pages) == (503, 9)
    pages = [[r.id for r in pager.page(k).collect()] for k in range(1, 10)]
    assert [len(page) for page in pages] == [60] * 8 + [23]
    assert [n for page in pages for n in page] == expected
    assert pager.page(10).collect() == []


def test_pager_of_nothing(spark):
    pager = Pager(people(spark).where("id > 99"), 25, "id")
    assert (pager.total, pager.pages, pager.page(1).collect()) == (0, 1, [])
