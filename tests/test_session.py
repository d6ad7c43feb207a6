from types import SimpleNamespace

import pytest

from cairn.session import qualified, remove_path, scratch_path, shared_dir


def fake(master, **conf):
    """A session of which only the master and the settings are known."""
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=conf.get), getCheckpointDir=lambda: None)
    return SimpleNamespace(sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake(master))


def test_a_folder_stays_on_its_file_system(spark):
    """A path without a scheme lies on the session's default file system, whatever that is; one with a scheme stays there."""
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert qualified(spark, "/shared/ck") == "file:/shared/ck" and qualified(spark, "file:///shared/ck") == "file:/shared/ck"
    try:
        conf.set("fs.defaultFS", "nowhere://host/")
        with pytest.raises(Exception, match="nowhere"):
            qualified(spark, "/shared/ck")
        assert qualified(spark, "file:///shared/ck") == "file:/shared/ck"
    finally:
        conf.set("fs.defaultFS", before or "file:///")


def test_scratch_is_below_the_shared_folder(spark):
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != two and one.startswith(shared_dir(spark))
    spark.range(3).write.parquet(one)
    remove_path(spark, one)
    spark.range(3).write.parquet(one)
    remove_path(spark, one)
