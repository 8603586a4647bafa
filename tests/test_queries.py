import pytest

from terrane.plans import registry
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, sf, name):
    assert differences(spark, sf, name, registry.QUERIES[name], registry.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_without_sql(spark, sf, name):
    """Rows that hold what every one of them must; what they are is tested in test_small."""
    rows = registry.QUERIES[name](spark, sf).collect()
    assert len(rows) > 1 and all(None not in (r[c] for c in r.__fields__ if c.startswith("p") or c in ("sharpe", "expected_best")) for r in rows)
    shares = [r[c] for r in rows for c in r.__fields__ if c in ("p", "p_linear", "p_trees", "deflated", "p_hazard", "p_survival") and r[c] is not None]
    assert all(0 <= x <= 1 for x in shares)
    assert shares or all(r["low"] <= r["mean"] <= r["high"] for r in rows)
