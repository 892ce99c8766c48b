"""Rows by document, term and bin are summed where they are made, never shuffled."""

import pytest

from tideline.operators import scorers as SC
from tideline.operators.collection import Collection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [SC.divergent_bins, SC.document_bin_weights])
def test_no_exchange_above_the_rows_by_bin(spark, make):
    plan = make(Collection(spark, SF))._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Generate posexplode" in line)
    assert not [line for line in plan[:at] if "Exchange" in line]
