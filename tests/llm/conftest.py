import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from loomtext.cluster import ship

    ship(spark)
