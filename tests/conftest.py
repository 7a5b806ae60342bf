import pytest

from tessaly.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tessaly-tests", cores=4, checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
