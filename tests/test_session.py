import os

import pytest

from lodestrand import session


def test_tables_are_removed_by_sweep_scratch_and_release(spark):
    path = lambda df: df._lodestrand_path.removeprefix("file://")
    session.sweep(spark)
    first = session.durable(spark.range(3))
    with session.scratch(spark):
        inner = session.durable(spark.range(4))
        assert inner.count() == 4
    assert not os.path.exists(path(inner)) and first.count() == 3
    second = session.durable(spark.range(5))
    session.release(second)
    assert not os.path.exists(path(second))
    assert session.sweep(spark) == 1 and not os.path.exists(path(first))


def test_no_machine_local_folder_off_local_mode(spark, monkeypatch):
    monkeypatch.setattr(session, "_is_local", lambda s: False)
    class Bare:
        class conf:
            get = staticmethod(lambda k, d=None: d)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Bare)
