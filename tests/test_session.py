import os
from concurrent.futures import ThreadPoolExecutor

from querylight.session import scratch, stage


def test_scratch_deletes_all_but_what_is_kept(spark):
    outside = stage(spark.range(3), "outside")
    with scratch(spark) as keep:
        gone = stage(spark.range(5), "gone")
        with scratch(spark) as keep_inner:
            inner = stage(gone.selectExpr("id + 1 as id"), "inner")
            twice = keep_inner(stage(inner.filter("id > 2"), "twice"))
        assert not os.path.exists(inner._staged_at) and os.path.exists(gone._staged_at)
        kept = keep(stage(twice.selectExpr("id * 2 as id"), "kept"))
    assert not os.path.exists(gone._staged_at) and not os.path.exists(twice._staged_at)
    assert [r["id"] for r in kept.orderBy("id").collect()] == [6, 8, 10]
    assert outside.count() == 3


def test_scratch_deletes_after_an_error(spark):
    made = []
    try:
        with scratch(spark):
            made.append(stage(spark.range(2), "lost")._staged_at)
            raise KeyError
    except KeyError:
        pass
    assert made and not os.path.exists(made[0])


def test_scratch_blocks_of_two_threads_are_apart(spark):
    def other():
        with scratch(spark) as keep:
            stage(spark.range(2), "others")
            return keep(stage(spark.range(4), "others-kept"))

    with scratch(spark), ThreadPoolExecutor(1) as pool:
        own = stage(spark.range(3), "own")
        kept = pool.submit(other).result()
        assert own.count() == 3 and kept.count() == 4
    assert not os.path.exists(own._staged_at) and kept.count() == 4
