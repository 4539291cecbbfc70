"""Every registered query against its SQL, and the driver's entry point."""

import pytest

import oracle
from drawfield import plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(name, spark, sf_dir, duck):
    message = oracle.compare(plans.queries()[name](spark, sf_dir), duck, plans.oracle_sql()[name])
    assert message is None, message


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(name, spark, sf_dir):
    assert plans.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract
    from drawfield.schema import published_columns
    table = contract.entry(spark)
    assert table.columns == published_columns() and len(table.columns) == 45
    assert table.count() > 0


def test_published_order_of_bounds(spark, sf_dir):
    """50 inside 90 inside 95 around the point estimate; exceedance falls with the threshold."""
    table = plans.queries()["bulk_table"](spark, sf_dir)
    for s in ("sb", "ns", "os"):
        order = [f"{s}_hdi95_lower", f"{s}_hdi90_lower", f"{s}_hdi50_lower", f"{s}_map",
                 f"{s}_hdi50_upper", f"{s}_hdi90_upper", f"{s}_hdi95_upper"]
        broken = " or ".join(f"{a} > {b}" for a, b in zip(order, order[1:]))
        assert table.filter(broken).count() == 0
        assert table.filter(f"{s}_p_gt25 < {s}_p_gt100 or {s}_p_gt100 < {s}_p_gt1000").count() == 0
