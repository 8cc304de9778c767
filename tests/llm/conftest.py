import pytest


@pytest.fixture(scope="session", autouse=True)
def checkpoint_folder(spark, tmp_path_factory):
    """A checkpoint folder for the session; a cluster names its own in spark.checkpoint.dir."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
