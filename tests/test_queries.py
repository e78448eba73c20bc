"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from lotlens.plans import cases, catalogue, more  # noqa: F401  (cases and more register their queries)

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module", autouse=True)
def small_plans(spark):
    """Compiling generated code costs more than it saves on some hundred rows."""
    told = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in told}
    for k, v in told.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE_SQL:
        assert not differences(df, con, catalogue.ORACLE_SQL[name])
    else:
        assert df.count() > 0
