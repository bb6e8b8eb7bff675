"""Driver contract: every oracle belongs to a registered query, and the
registered keys name operators, not numbered steps."""

import re

import __spark_entry__ as entry
from quarry.plans.catalog import QUERIES


def test_oracles_belong_to_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
    assert all(isinstance(sql, str) and sql.strip() for sql in o.values())


def test_keys_are_operator_names():
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", k) for k in entry.queries())
    assert not any(re.match(r"op\d", k) for k in QUERIES)
