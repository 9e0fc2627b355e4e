"""Written intermediates live in a folder of the application and can be deleted."""

from pathlib import Path

from windowlark import session


def test_release_leaves_nothing(spark):
    kept = dict(session._opened)
    session._opened.clear()
    try:
        df = session.materialize(spark.range(10))
        folder = Path(session.session_folder(spark))
        mine = folder / Path(df.inputFiles()[0].removeprefix("file:")).parent.name
        assert df.count() == 10 and mine.exists()
        # delete this table only: other tests of the session still read theirs
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(mine))
        session._opened.clear()
        session._opened[str(mine)] = (path, spark.sparkContext._jsc.hadoopConfiguration())
        session.release()
        assert not mine.exists() and not session._opened
    finally:
        session._opened.update(kept)
