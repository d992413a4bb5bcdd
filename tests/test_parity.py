"""Every core query that SQL can express against its SQL, over whole tables."""

import pytest

from stratafold import queries
from tests import parity

QUERIES, ORACLES = queries.all_queries(), queries.all_oracles()


def test_every_sql_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    parity.check(spark, QUERIES[name], ORACLES[name])


#: Rows and checksum of the queries without SQL, whose operators are tested by brute force or round trips elsewhere.
KNOWN = {
    "a25_fingerprints": (600, 285296000),
    "g06_contour_lines": (265, 305872411),
    "g10_palette": (12, 3866794158),
    "g12_ribbons": (150, 1677955237),
    "u05_booleans": (8, 3074454886),
    "p4_unified_jobs": (148, 331249834),
    "p4_unified_setups": (149, 1034890452),
    "p4_unified_versions": (149, 611013124),
    "w10_kriging": (150, 4102679138),
    "x04_pavement": (1, 3844380673),
}


def test_every_query_has_sql_or_a_known_answer():
    assert QUERIES.keys() - ORACLES.keys() == KNOWN.keys()


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_query_gives_its_known_answer(spark, name):
    assert parity.digest(QUERIES[name](spark, parity.DATA)) == KNOWN[name]
