import pytest

from terrane.llm import entries
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(entries.ORACLE))
def test_against_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.01", name, entries.QUERIES[name], entries.ORACLE[name]) == ""
