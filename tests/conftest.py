import pytest

from factloom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("factloom-tests", cpus=4, **{"spark.driver.memory": "4g"})
