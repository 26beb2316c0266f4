"""The plumbing: what workers keep, where tables go."""

import pytest

from braidline.llm import common


def test_a_worker_keeps_the_tables_of_one_kind():
    common.free()
    made = []
    make = lambda name: lambda: made.append(name) or {name: 1}
    a = common.kept(("a", 1), make("a"))
    assert common.kept(("a", 1), make("again")) is a and made == ["a"]
    common.kept(("b",), make("b"))
    assert list(common._kept) == [("b",)]
    assert common.kept(("a", 1), make("anew")) == {"anew": 1} and made == ["a", "b", "anew"]
    common.free()
    assert not common._kept


def test_the_shared_folder_is_the_sessions(spark):
    assert common.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")

    class Other:
        """A session on a cluster without the setting."""

        class conf:
            get = staticmethod(lambda key, default=None: default if key == "spark.checkpoint.dir" else "/warehouse/")

        class sparkContext:
            master = "yarn"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError):
        common.shared_folder(Other)
    Other.sparkContext.master = "local[2]"
    assert common.shared_folder(Other) == "/warehouse/.braidline"


def test_settled_tables_are_read_back_and_forgotten(spark):
    df = common.settle(spark.range(5), "test")
    assert df.count() == 5
    common.forget(df)
    with pytest.raises(Exception):  # noqa: B017
        df.collect()


def test_executors_give_back_what_an_operator_took(spark):
    def keep(batches):
        for batch in batches:
            common.kept(("taken",), lambda: [0] * 1000)
            yield batch

    def look(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._kept)], pa.int64())], ["id"])

    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 4 * cores, 1, 4 * cores).mapInArrow(keep, "id long").collect()
    assert common.give_back(spark) == 2 * cores
    # A worker that idled meanwhile may still keep something; those that answered don't.
    kept = [r.id for r in spark.range(0, 1, 1, 1).mapInArrow(look, "id long").collect()]
    assert kept == [0]
