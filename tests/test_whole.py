"""Reference operators over whole tables: one result per row of the table, whatever its key."""

import pytest
from pyspark.sql import functions as F

from quern.plans import catalog
from quern.session import load


@pytest.mark.parametrize(
    ("name", "table", "key"),
    [
        ("hydrate_parts", "orders", "o_orderkey"),
        ("star_auth_join", "orders", "o_orderkey"),
        ("constant_key_join", "orders", "o_orderkey"),
        ("cursor_and_hash", "orders", "o_orderkey"),
        ("left_join_never", "customer", "c_custkey"),
        ("identifier_times", "events", "event_id"),
    ],
)
def test_no_key_is_left_out(spark, data, name, table, key):
    got = sorted(r[0] for r in catalog.queries()[name](spark, data).select(key).collect())
    assert got == sorted(r[0] for r in load(spark, data, table).select(key).collect())


def test_the_subtree_goes_to_its_leaves(spark, data):
    keys = {r[0] for r in load(spark, data, "orders").select("o_orderkey").collect()}
    want, level = set(), {3}
    while level:
        level = {k for k in keys if k // 2 in level and k not in want}
        want |= level
    got = {r[0] for r in catalog.queries()["subtree"](spark, data).filter(F.col("depth") > 0).collect()}
    assert got == want and max(got) >= 700
