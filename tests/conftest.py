import pytest

from tests.sessions import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session()
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
    yield session
