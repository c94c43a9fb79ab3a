"""Written tables and the scopes that drop them."""

import os

from tabulens.plans.workspace import Scratch, written


def there(df):
    return os.path.exists(df._scratch_path.removeprefix("file://"))


def test_tables_of_a_block_go_when_it_ends(spark):
    before = written(spark.range(3))
    with Scratch(spark) as outer:
        a = outer.keep(written(spark.range(5)))
        early = written(spark.range(9))
        outer.drop(early)
        assert not there(early)
        with Scratch(spark) as inner:
            b, c = inner.keep(written(a.selectExpr("id * 2 AS id"))), written(spark.range(4))
            assert there(c)
        assert not there(c) and b.count() == 5
    assert there(a) and a.count() == 5 and not there(b)
    assert there(before) and there(written(spark.range(1)))
