import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def package_on_workers(spark):
    from cadence.llm.common import ship
    ship(spark)
