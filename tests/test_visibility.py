"""Rows and open columns for all roles at once, against the governed view of each role alone."""

from pyspark.sql import functions as F

from streamlake.operators import access
from streamlake.policy import Grant, Policy


def test_bit_maps_equal_each_roles_view(spark):
    rows = spark.range(500).select(F.col("id").alias("n"), (F.col("id") % 7).alias("k"),
                                   F.concat(F.lit("user_"), F.col("id") % 5).alias("owner"))
    roles = {f"r{i}": () for i in range(70)} | {"boss": ("r1", "r2"), "nobody": ()}
    grants = [Grant("t.x", (f"r{i}",), ("select",), row_filter=f"n >= {i}") for i in range(70)]
    grants += [Grant("t.x", ("r1", "r2"), ("select",), {"owner": "hash"}, "k <> 3"),
               Grant("t.x", ("r3",), ("select",), row_filter="owner = current_user"),
               Grant("t.x", ("boss",), ("insert",))]
    policy = Policy(roles, {}, {}, tuple(grants), ())
    got = {r.role: r for r in access.visible_by_role(rows, policy, "t.x").collect()}
    assert set(got) == set(roles)
    for role in roles:
        try:
            view = access.secure_view(rows, policy, "t.x", [role], role)
            expected = (True, view.count())
        except access.AccessDenied:
            expected = (False, 0)
        assert (got[role].allowed, got[role].visible_rows) == expected, role
    assert got["r1"].open_columns == "k,n" and got["r5"].open_columns == "k,n,owner"
    assert got["nobody"].allowed is False and got["boss"].allowed is True  # boss holds r1 and r2
