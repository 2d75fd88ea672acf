import threading

from sluice.llm.common import tidied, written


def test_tables_of_another_thread_stay(spark):
    """Two queries at once in one driver: each removes its own tables only."""
    inside, done, found = threading.Event(), threading.Event(), {}

    def other():
        with tidied() as keep:
            table = written(spark.range(50), "other")
            inside.set()
            done.wait(60)
            found["rows"] = table.count()
            keep(table)
        found["kept"] = table.count()

    thread = threading.Thread(target=other)
    with tidied():
        mine = written(spark.range(5), "mine")
        thread.start()
        assert inside.wait(60)
    done.set()
    thread.join(60)
    assert found == {"rows": 50, "kept": 50}
    assert not spark._jvm.org.apache.hadoop.fs.Path(mine.written_to).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(mine.written_to))


def test_kept_tables_belong_to_the_block_outside(spark):
    with tidied():
        with tidied() as keep:
            inner = keep(written(spark.range(3), "inner"))
            gone = written(spark.range(3), "gone")
        assert inner.count() == 3
    fs = spark._jvm.org.apache.hadoop.fs.Path(gone.written_to).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(d.written_to)) for d in (inner, gone))
