"""Lookups with keys that most rows bear, with null keys and without matches."""

import pytest

from siltrace.operators.joins import looked_up


@pytest.mark.parametrize("hot_keys", [3, 1000])
def test_looked_up_is_a_left_join(spark, hot_keys):
    rows = [(1, "a", i) for i in range(60)] + [(2, "b", i) for i in range(30)] + [(i, "c", i) for i in range(3, 40)] + [(None, "a", 0), (1, None, 1)] * 20
    table = [(1, "a", "x"), (3, "c", None), (4, "c", "y"), (9, "z", "unused")]
    df = spark.createDataFrame(rows, "k long, l string, v long").repartition(3)
    found = looked_up(df, spark.createDataFrame(table, "k long, l string, w string"), ["k", "l"], hot_keys)
    known = {(k, x): w for k, x, w in table}
    assert found.columns == ["k", "l", "v", "w"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((k, x, v, known.get((k, x))) for k, x, v in rows), key=repr)
    assert looked_up(df.limit(0), found.select("k", "l", "w").limit(0), ["k", "l"]).count() == 0


def test_written_tables_are_cleared(spark):
    from siltrace.sources.stored import cleared, dropped, exists, written

    cleared(spark)
    a, b = written(spark.range(3), "one"), written(spark.range(4), "two")
    dropped(a)
    paths = [f.rsplit("/", 1)[0] for f in b.inputFiles()]
    assert b.count() == 4 and all(exists(spark, p) for p in paths)
    assert cleared(spark) == 2 and not any(exists(spark, p) for p in paths) and cleared(spark) == 0
