"""Scratch storage: shared on a cluster, removed after use."""

import os

import pytest

from ticksmith import session
from ticksmith.operators import rolling
from ticksmith.plans import fixtures

from sf_paths import SF_SMALL


class _Cluster:
    """A session on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://head:7077"

        class _Conf:
            @staticmethod
            def get(key, default=None):
                return default

        @staticmethod
        def getConf():
            return _Cluster.sparkContext._Conf


def test_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(_Cluster)


def test_no_scratch_remains(spark):
    with session.scratch_scope(spark):
        before = len(session._SCRATCH)
        assert rolling.sma(fixtures.ticks(spark, SF_SMALL), 20).count() == 1000
        made = session._SCRATCH[before:]
        assert made and all(os.path.isdir(p.removeprefix("file:")) for p in made)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in made)
