"""Every way of grouping windows into fits gives the same rules on the driver's tables."""

import math
from pathlib import Path

import pytest
from driver_checks import queries
from driver_checks.oracles import ORACLES
from driver_checks.queries import QUERIES
from factdrift import mine_triples, plan_windows

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no driver tables")
@pytest.mark.parametrize("facts, width", [("customer_facts", 2), ("user_facts", 26), ("order_facts", 2)])
def test_fits_agree(spark, facts, width):
    triples = getattr(queries, facts)(spark, SF_DIR)
    plan = plan_windows(triples, width)
    results = []
    for ratio in (0, 2.0, math.inf):
        itemsets, rules = mine_triples(triples, plan, 0.2, 0.5, cut_ratio=ratio)
        results.append((sorted(map(str, itemsets.collect())), sorted(map(str, rules.collect()))))
    assert results[0][0] and results[0] == results[1] == results[2]


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
