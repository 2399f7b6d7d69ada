import os

import pytest

from shelfmark import session


def test_written_tables_go_when_released(spark):
    kept = session.materialise(spark.range(5))
    path = session._written[-1][1]
    assert kept.count() == 5 and os.path.exists(path.removeprefix("file:"))
    session.release()
    assert not os.path.exists(path.removeprefix("file:")) and not session._written


def test_small_tables_are_marked_and_large_ones_are_not(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "ResolvedHint" in session.small(spark.range(5))._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in session.small(spark.range(5), 4)._jdf.queryExecution().analyzed().toString()
    assert plan(session.small(spark.range(5), 4))


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

        class _jsc:
            class sc:
                def getCheckpointDir(self):
                    class Empty:
                        isDefined = staticmethod(lambda: False)

                    return Empty

    class Session:
        conf, sparkContext = Conf(), Context

    with pytest.raises(RuntimeError):
        session.shared_folder(Session)
