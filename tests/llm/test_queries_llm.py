"""The queries that have check SQL against it."""

import oracle
import pytest

from ledgerproof.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op6_decontamination"])
def test_check_sql(spark, name):
    assert oracle.compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE[name]) is None


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
