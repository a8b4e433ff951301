"""The document, KPI and review rules on small tables whose rows are stated."""

from __future__ import annotations

import duckdb
import pytest
from rule_cases import EXPECTED, RULES


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return tuple(plain(v) for v in value) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(RULES))
def test_rule(spark, name):
    df = RULES[name](spark, "")
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duckdb.connect().execute(EXPECTED[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
