import pytest

from palimpsest.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
