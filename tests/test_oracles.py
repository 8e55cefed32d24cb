"""Each core query against its DuckDB oracle on the smallest data."""

import pytest

from kvist.plans.catalogue import CATALOGUES
from oracle import DATA, compare

CASES = [(n, c) for c in CATALOGUES for n in c.queries]


@pytest.mark.parametrize("name,catalogue", CASES, ids=[n for n, _ in CASES])
def test_query(spark, name, catalogue):
    if name in catalogue.oracles:
        compare(spark, catalogue.queries[name], catalogue.oracles[name])
    else:
        df = catalogue.queries[name](spark, DATA)
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_names_are_unique():
    names = [n for c in CATALOGUES for n in c.queries]
    assert len(names) == len(set(names))
