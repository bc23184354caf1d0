from __future__ import annotations

import pytest

from lakemart.session import SETTINGS, cluster_settings, shared_folder, work_folder


class Conf(dict):
    """A session that has these settings only."""

    @property
    def conf(self):
        return self


def test_the_setting_is_used(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        pytest.skip("no folder configured here")
    assert shared_folder(spark) == configured.rstrip("/")
    assert work_folder(spark, "a").startswith(configured) and work_folder(spark, "a") != work_folder(spark, "a")


def test_the_warehouse_serves_without_the_setting(spark):
    assert shared_folder(Conf({"spark.sql.warehouse.dir": "hdfs://x/warehouse/"})) == "hdfs://x/warehouse/work"
    assert shared_folder(spark).startswith(spark.conf.get("spark.sql.warehouse.dir")) or spark.conf.get("spark.checkpoint.dir", None)


def test_some_folder_must_be_named():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Conf())


def test_cluster_settings_keep_the_base():
    assert SETTINGS.items() <= cluster_settings(1000).items()
    assert cluster_settings(1000)["spark.sql.shuffle.partitions"] == "4000"
