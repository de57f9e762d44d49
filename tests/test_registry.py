import os

import pytest

from fareindex.checks import load
from tools_check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ("a1_jevons_index", "a4_national_partial", "a6_contributions", "c1_classify_raw", "d4_mark_outliers", "x4_confirm_sources", "v6_all_metrics")


def test_every_query_has_checking_sql():
    registry = load()
    assert set(registry.ORACLE) == set(registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    registry = load()
    verdict, _ = compare(spark, connect(SF), name, registry.QUERIES[name], registry.ORACLE[name], SF)
    assert verdict.startswith("ok"), verdict
