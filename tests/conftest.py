import shutil

import pytest

from foliant.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(cores=4, memory="4g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    folder = tmp_path_factory.mktemp("checkpoints")
    s.sparkContext.setCheckpointDir(str(folder))
    yield s
    s.stop()
    shutil.rmtree(folder, ignore_errors=True)
