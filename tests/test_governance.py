import itertools

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from streamlake.functions import rowfilter
from streamlake.functions.masks import apply_masks
from streamlake.operators import access, drift, graph, lint, privileges
from streamlake.policy import SHIPPED, Grant, Policy, from_mapping, split_resource

REQUEST = """
    context STRUCT<identity: STRUCT<user: STRING, groups: ARRAY<STRING>>>,
    action STRUCT<operation: STRING, resource: STRUCT<
        table: STRUCT<catalogName: STRING, schemaName: STRING, tableName: STRING>,
        column: STRUCT<catalogName: STRING, schemaName: STRING, tableName: STRING, columnName: STRING>,
        schema: STRUCT<catalogName: STRING, schemaName: STRING>,
        catalog: STRUCT<name: STRING>,
        catalogSessionProperty: STRUCT<catalogName: STRING, propertyName: STRING>>>"""


def request(groups, operation, user="someone", **resource):
    parts = [resource.get(k) for k in ("table", "column", "schema", "catalog", "property")]
    return ((user, groups),), (operation, tuple(parts))


def decide(spark, function, requests, *args, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], "id INT, " + REQUEST)
    return [r.allowed for r in function(df, *args, **options).orderBy("id").collect()]


def table(name, catalog="iceberg"):
    return {"table": (catalog, "lake", name)}


# --- deny-override -------------------------------------------------------------------------

@pytest.mark.parametrize("groups, user, operation, resource, allowed", [
    (["analyst"], "x", "SelectFromColumns", table("orders"), True),
    (["analyst"], "x", "SelectFromColumns", table("customers"), False),
    (["analyst"], "x", "SelectFromColumns", {"column": ("any", "any", "customers", "c")}, False),
    (["analyst"], "x", "SelectFromColumns", table("customers_v2"), True),
    (["analyst"], "x", "InsertIntoTable", table("orders"), False),
    (["analyst"], "x", "UpdateTableColumns", table("orders"), True),    # not in the write list
    ([], "analyst", "DropTable", table("orders"), False),               # by user name
    (["engineer"], "x", "InsertIntoTable", table("orders"), True),
    (["engineer"], "x", "InsertIntoTable", table("t", "system"), False),
    (["engineer"], "x", "CreateSchema", {"schema": ("system", "s")}, False),
    (["engineer"], "x", "ExecuteProcedure", {"catalog": ("system",)}, False),
    (["engineer"], "x", "AddColumn", {"column": ("system", "s", "t", "c")}, False),
    (["engineer"], "x", "SelectFromColumns", table("t", "system"), True),
    (["engineer"], "x", "SelectFromColumns", table("customers"), True),
    (["admin"], "x", "DropTable", table("customers", "system"), True),
    (["admin", "analyst"], "x", "DropTable", table("orders"), False),   # deny overrides
    ([], "x", "DropTable", table("orders"), True),
    (None, "x", "SelectFromColumns", table("customers"), False),
    (["analysts"], "x", "DropTable", table("orders"), True),            # plural is unknown
    (["analysts"], "x", "SelectFromColumns", table("customers"), False),
    (["engineers"], None, "ExecuteQuery", {}, True)])
def test_deny_rules(spark, groups, user, operation, resource, allowed):
    assert decide(spark, access.decide_deny, [request(groups, operation, user, **resource)]) == [allowed]


def test_deny_options(spark):
    update = request(["analyst"], "UpdateTableColumns", **table("orders"))
    plural = request(["analysts"], "DropTable", **table("orders"))
    assert decide(spark, access.decide_deny, [update],
                  access.WRITE_OPERATIONS + ["UpdateTableColumns"]) == [False]
    assert decide(spark, access.decide_deny, [plural], plural_groups=True) == [False]


def test_topic_rules(spark):
    schema = ("id INT, requestContext STRUCT<principal: STRUCT<name: STRING, groups: ARRAY<STRING>>, "
              "groups: ARRAY<STRING>>, action STRUCT<operation: STRING, resourceType: STRING>")
    cases = [(("User:analyst", None), None, "Write", False), (("User:svc-analyst", None), None, "Create", False),
             (("analyst", None), None, "AlterConfigs", False), (("u", ["analyst"]), None, "Alter", False),
             ((None, None), ["analyst"], "ClusterAction", False), (("analyst", None), None, "Read", True),
             (("User:engineer", None), None, "Delete", True), (("x", None), None, "Write", True)]
    df = spark.createDataFrame([(i, (p, g), (op, "topic")) for i, (p, g, op, _) in enumerate(cases)], schema)
    assert [r.allowed for r in access.decide_topic(df).orderBy("id").collect()] == [c[3] for c in cases]


# --- allow-by-grant ------------------------------------------------------------------------

CATALOG_SHAPES = {"catalog": {"catalog": ("iceberg",)}, "schema": {"schema": ("iceberg", "lake")},
                  "table": table("events_enriched"), "none": {},
                  "catalogSessionProperty": {"property": ("iceberg", "p")}}


def test_catalog_operations_by_shape(spark):
    permissions = access.catalog_permissions(spark, SHIPPED)
    operations = list(access.CATALOG_OPERATION_SHAPES.items())
    good = [request(["analysts"], op, **CATALOG_SHAPES[shape]) for op, shape in operations]
    assert decide(spark, access.decide_catalog, good, permissions) == [True] * len(good)
    inherited = [request(["admins"], op, **CATALOG_SHAPES[shape]) for op, shape in operations]
    assert all(decide(spark, access.decide_catalog, inherited, permissions))
    nobody = [request(["nobody"], op, **CATALOG_SHAPES[shape]) for op, shape in operations]
    assert not any(decide(spark, access.decide_catalog, nobody + [
        request(None, "ExecuteQuery"), request(["analysts"], "ShowTables", schema=("evil", "lake")),
        request(["analysts"], "ShowTables", catalog=("iceberg",)),
        request(["analysts"], "DropTable", **table("orders"))], permissions))


@pytest.fixture(scope="module")
def permissions(spark):
    return access.table_permissions(spark, SHIPPED)


def test_table_grants(spark, permissions):
    select = "SelectFromColumns"
    cases = [(["analysts"], select, table("orders"), True), (["analysts"], select, table("customers"), False),
             (["engineers"], select, table("customers"), True), (["admins"], "UpdateTableColumns", table("orders"), True),
             (["analysts"], "DeleteFromTable", table("orders"), False),
             (["analysts"], select, table("events_enriched", "evil"), False),
             (["nobody"], select, table("orders"), False), ([], select, table("orders"), False),
             (None, select, table("orders"), False), (["nobody", "engineers"], "InsertIntoTable", table("customers"), True),
             (["admins"], "DropTable", table("orders"), False), (["analysts"], select, {}, False),
             (["engineers"], select, table("customers_v2"), False)]
    got = decide(spark, access.decide_allow, [request(g, op, **r) for g, op, r, _ in cases], permissions)
    assert got == [c[3] for c in cases]


def test_listing_keeps_what_may_be_seen(spark):
    rows = [request(["analysts"], "FilterTables", **table("orders")),
            request(["nobody"], "FilterTables", **table("orders")),
            request(["analysts"], "FilterTables", **table("orders", "evil")),
            request(["admins"], "FilterSchemas", schema=("iceberg", "lake")),
            request(["admins"], "FilterCatalogs", catalog=("iceberg",)),
            request(["admins"], "ShowTables", schema=("iceberg", "lake"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id INT, " + REQUEST)
    seen = access.visible_objects(df, access.catalog_permissions(spark, SHIPPED)).collect()
    assert sorted(r.id for r in seen) == [0, 3, 4]


def test_decisions_keep_every_request(spark, permissions):
    hot = [request(["analysts"], "SelectFromColumns", **table("orders"))] * 500
    assert decide(spark, access.decide_allow, hot + hot[:3], permissions) == [True] * 503


def test_resource_is_split_at_its_last_dot(spark):
    schema, name = split_resource(F.col("r"))
    row = spark.createDataFrame([("a.b.c",)], "r STRING").select(schema.alias("s"), name.alias("t")).first()
    assert (row.s, row.t) == ("a.b", "c")


def test_app_roles(spark):
    users = spark.createDataFrame([("admins",), ("engineers",), ("analysts",), ("x",), (None,)], "group_name STRING")
    got = {r.group_name: r.app_role for r in access.app_roles(users).collect()}
    assert got == {"admins": "Admin", "engineers": "Alpha", "analysts": "Gamma", "x": "Gamma", None: "Gamma"}


# --- masks, filters, governed views --------------------------------------------------------

def test_masks(spark):
    df = spark.createDataFrame([("alice@example.com", 7, "ab"), (None, None, None)], "email STRING, n INT, s STRING")
    full, empty = apply_masks(df, {"email": "hash", "n": "null", "s": "partial"}).collect()
    assert full.email == "FF8D9819FC0E12BF0D24892E45987E249A28DCE836A85CAD60E28EAAA8C6D976"
    assert (full.n, full.s) == (None, "ab***")
    assert (empty.email, empty.n, empty.s) == (None, None, None)
    assert apply_masks(df, {"n": "null"}).dtypes == df.dtypes


ACCEPTED = ["branch = 'north'", "floor IN (3, 5)", "signed_by = CURRENT_USER", "x.y >= -2.5", "  k<>''  ",
            "k = 1 and l = 2 and m != 3", "k = 1 OR l in ('p', current_user)", "k\tIN\n( 1 ,2 )",
            "k = 'p OR q' AND l = 2", "_k1 <= 07", "in = 1", "and in (1)"]
REJECTED = ["", " ", "k", "k =", "k = l", "k = 1 AND", "AND k = 1", "k = 1 AND l = 2 OR m = 3", "(k = 1)", "k IN ()",
            "k IN (1", "k IN (1,)", "k IN 1", "k = 'p''q'", "k = 'p\\q'", "k = 'p", "k = 1;", "k = 1 -- l", "k = 1x",
            "k = 1AND l = 2", "k = 1 ANDl = 2", "k = 'p'AND l = 2", "k = - 1", "k = 1.", "k = .5", "k == 1", "k => 1",
            "x.y.z = 1", "x. y = 1", "1 = 1", "k = (SELECT 1)", "k LIKE 'p'", "k = current_users",
            "k\u00a0= 1", "\u212a = 1", "k = \u0661", "k = " + "1" * 197]


@pytest.mark.parametrize("text", ACCEPTED + REJECTED)
def test_filter_texts_are_judged_alike_on_both_sides(spark, text):
    column = spark.createDataFrame([(text,)], "f STRING").select(rowfilter.accepted(F.col("f")).alias("ok"))
    assert column.first().ok == rowfilter.is_accepted(text) == (text in ACCEPTED)
    if text in REJECTED:
        with pytest.raises(ValueError):
            rowfilter.to_column(text, "u")


WORDS = ["k", "x.y", "_a1", "=", "<>", "<=", "!", "IN", "in", "(", ")", ",", "1", "-2.5", "3.", "'p'", "'", "''", "\\",
         "AND", "or", "current_user", " ", " ", " ", "\t", "\n", "\u00a0", "\u212a", ";", "--"]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=1, max_size=14).map("".join), min_size=50, max_size=50),
       st.lists(st.sampled_from(["k = 1", "l IN ('p', 2)", "m <> current_user"]), min_size=1, max_size=4),
       st.sampled_from([" AND ", " or ", "\tOR\n", "AND"]))
def test_both_sides_judge_any_text_alike(spark, texts, terms, joint):
    texts = [*texts, joint.join(terms), *(t + joint + t for t in terms)]
    rows = spark.createDataFrame([(t,) for t in texts], "f STRING")
    for row in rows.select("f", rowfilter.accepted(F.col("f")).alias("ok")).collect():
        assert row.ok == rowfilter.is_accepted(row.f), repr(row.f)


@pytest.mark.parametrize("text, want", [
    ("a = 1 AND s <> 'x'", [0]), ("a >= 2 OR s = 'x'", [1, 2]), ("a IN (1, 3)", [0, 2]),
    ("s = current_user", [0]), ("s IN ('x', current_user)", [0, 1]), ("a <= 1.5", [0]),
    ("s = 'y OR z'", [2]), ("a != 1 and a < 3", [1])])
def test_filters_select_rows(spark, text, want):
    df = spark.createDataFrame([(0, 1, "it's \\me"), (1, 2, "x"), (2, 3, "y OR z")], "id INT, a INT, s STRING")
    assert [r.id for r in df.where(rowfilter.to_column(text, "it's \\me")).orderBy("id").collect()] == want


def view_policy(*grants):
    return Policy(SHIPPED.roles, SHIPPED.groups, {"lake.t": ("pii", ("email",))}, grants, ())


def people(spark):
    return spark.createDataFrame([("a@x", "KR", 1), ("b@x", "US", 2)], "email STRING, region STRING, n INT")


def test_view_filters_and_masks_only_the_grants_own_roles(spark):
    policy = view_policy(
        Grant("lake.t", ("analysts",), ("select",), {"email": "hash"}, "region = 'KR'"),
        Grant("lake.t", ("engineers",), ("select", "insert"), allow_unmasked=True))
    masked = access.secure_view(people(spark), policy, "lake.t", ["analysts"], "u").collect()
    assert len(masked) == 1 and len(masked[0].email) == 64
    plain = access.secure_view(people(spark), policy, "lake.t", ["engineers"], "u").collect()
    assert sorted(r.email for r in plain) == ["a@x", "b@x"]
    inherited = access.secure_view(people(spark), policy, "lake.t", ["admins"], "u")
    assert inherited.count() == 2
    both = access.secure_view(people(spark), policy, "lake.t", ["engineers", "analysts"], "u")
    assert both.count() == 1


def test_view_denies_and_reports_conflicts(spark):
    with pytest.raises(access.AccessDenied):
        access.secure_view(people(spark), view_policy(), "lake.t", ["admins"], "u")
    with pytest.raises(access.AccessDenied):
        access.secure_view(people(spark), view_policy(Grant("lake.t", ("engineers",), ("select",))),
                           "lake.t", ["analysts"], "u")
    clash = view_policy(Grant("lake.t", ("analysts",), ("select",), {"email": "hash"}),
                        Grant("lake.t", ("analysts",), ("select",), {"email": "null"}))
    with pytest.raises(access.ConflictingMask):
        access.secure_view(people(spark), clash, "lake.t", ["analysts"], "u")


def test_view_filter_reaches_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    policy = Policy(SHIPPED.roles, {}, {}, (Grant("lake.o", ("analysts",), ("select",),
                                                  row_filter="o_orderstatus = 'F'"),), ())
    view = access.secure_view(orders, policy, "lake.o", ["analysts"], "u").select("o_orderkey")
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


# --- declarations --------------------------------------------------------------------------

def declaration(resources=(), roles=None, groups=()):
    return from_mapping({"roles": roles or [{"name": "analyst"}, {"name": "engineer", "includes": ["analyst"]}],
                         "groups": list(groups), "resources": list(resources)})


def codes(spark, policy):
    found = lint.policy_lint(policy.roles_frame(spark), policy.groups_frame(spark),
                             policy.resources_frame(spark), policy.grants_frame(spark))
    return sorted(r.code for r in found.collect())


def pii(*grants, columns=("email",)):
    entry = {"resource": "lake.customers", "classification": "pii", "grants": list(grants)}
    return [{**entry, "sensitiveColumns": list(columns)} if columns else entry]


def grant(**options):
    return {"roles": ["analyst"], "privileges": ["select"], **options}


def internal(**options):
    return [{"resource": "lake.t", "classification": "internal", "grants": [grant(**options)]}]


def exposure(masked, wanted, reads, sensitive):
    """A declaration with one grant on personal data, and the code it must raise."""
    grants_ = [grant(privileges=["select" if reads else "insert"], allowUnmasked=wanted,
                     columnMask={c: "hash" for c in masked})]
    if not sensitive:
        want = ["PII_NO_SENSITIVE_COLUMNS"]
    else:
        want = ["PII_UNMASKED"] if reads and not wanted and not set(sensitive) <= set(masked) else []
    return declaration(pii(*grants_, columns=sensitive)), want


EXPOSURES = [exposure(masked, wanted, reads, sensitive)
             for masked in ((), ("email",), ("email", "phone")) for wanted in (False, True)
             for reads in (False, True) for sensitive in ((), ("email",), ("email", "phone"))]
CHAIN = [{"name": f"r{n}", "includes": [f"r{n + 1}"]} for n in range(6)] + [{"name": "r6"}]


@pytest.mark.parametrize("policy, want", [
    *EXPOSURES,
    (declaration(internal(roles=["analyst", "nobody"])), ["UNKNOWN_ROLE"]),
    (declaration(groups=[{"name": "g", "roles": ["nobody", "analyst"]}]), ["UNKNOWN_ROLE"]),
    (declaration(roles=[*CHAIN, {"name": "q", "includes": ["r0", "nobody"]}]), ["UNKNOWN_ROLE"]),
    (declaration(roles=[*CHAIN[:-1], {"name": "r6", "includes": ["r2"]}]), ["CYCLIC_INHERITANCE"] * 5),
    (declaration(roles=[{"name": "s", "includes": ["s"]}]), ["CYCLIC_INHERITANCE"]),
    (declaration(internal(rowFilter="k = 1 AND l = 2")), []),
    (declaration(internal(rowFilter="k = 1 AND l = 2 OR m = 3")), ["ROW_FILTER_REJECTED"]),
    (SHIPPED, [])])
def test_lint(spark, policy, want):
    assert codes(spark, policy) == want


@pytest.mark.parametrize("document", [
    {"roles": [{"name": "a", "extra": 1}]}, {"groups": [{"name": "a"}]}, {"unknown": []},
    {"resources": [{"resource": "r", "classification": "secret", "grants": []}]},
    {"resources": [{"resource": "r", "classification": "pii", "grants": [
        {"roles": ["a"], "privileges": ["drop"]}]}]},
    {"roles": [{"name": "a", "includes": ["b"]}, {"name": "a"}]}, {"roles": [{"name": ""}]},
    {"groups": [{"name": "g", "roles": ["a"]}, {"name": "g", "roles": ["b"]}]},
    {"groups": [{"name": "g", "roles": []}]}, {"groups": [{"name": "g", "roles": "a"}]},
    {"resources": [{"resource": "r", "classification": c, "grants": []} for c in ("pii", "public")]},
    {"resources": [{"resource": "r", "classification": "pii", "grants": [
        {"roles": [], "privileges": ["select"]}]}]},
    {"resources": [{"resource": "r", "classification": "pii", "grants": [
        {"roles": ["a"], "privileges": []}]}]},
    {"resources": [{"resource": "r", "classification": "pii", "grants": [
        {"roles": ["a"], "privileges": ["select"], "columnMask": {"email": "hsah"}}]}]},
    {"catalogGrants": [{"catalog": "c", "roles": ["a"], "operations": []}]}])
def test_declarations_are_strict(document):
    with pytest.raises(ValueError):
        from_mapping(document)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_role_expansion(spark):
    edges = graph.role_edges(SHIPPED.roles_frame(spark))
    assert pairs(graph.expand_roles(edges)) == sorted(
        (r, e) for r in SHIPPED.roles for e in SHIPPED.effective_roles(r))
    assert pairs(graph.role_holders(edges)) == pairs(SHIPPED.holders(spark))
    groups = SHIPPED.groups_frame(spark)
    assert ("admin", "analysts") in pairs(graph.group_roles(groups, edges))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25))
def test_closure_of_any_graph(spark, edges):
    want = set(edges)
    while True:
        more = {(a, d) for (a, b), (c, d) in itertools.product(want, want) if b == c} | want
        if more == want:
            break
        want = more
    df = spark.createDataFrame(edges, "src INT, dst INT")
    assert pairs(graph.closure(df, "src", "dst")) == sorted(want)


def test_closure_of_a_long_chain(spark):
    df = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.closure(df, "src", "dst").count() == 40 * 41 // 2


def test_privileges_and_default_deny(spark):
    relations = spark.createDataFrame(
        [("public", "orders", False, False), ("public", "customers", False, True),
         ("public", "probe", True, False)],
        "schema_name STRING, table_name STRING, is_new BOOLEAN, is_pii BOOLEAN")
    effective = privileges.relation_privileges(relations, SHIPPED)
    held = {(r.role, r.privilege, r.table_name) for r in effective.collect()}
    assert {t for r, p, t in held if r == "analysts"} == {"orders"}
    assert all((r, p, t) in held for r in ("engineers", "admins") for p in privileges.PRIVILEGES
               for t in ("orders", "customers", "probe"))
    for role, table, want in (("analysts", "public.probe", False), ("engineers", "public.probe", True),
                              ("analysts", "public.orders", True), ("ghost", "public.orders", False)):
        assert privileges.has_privilege(effective, role, table, "select").first()[0] is want
    lists = {(r.role, r.table_name): r.privileges for r in privileges.privilege_lists(effective).collect()}
    assert lists["analysts", "orders"] == "select" and ("analysts", "probe") not in lists
    assert lists["admins", "customers"] == "select, insert, update, delete"
    probe = privileges.default_deny_probe(relations, SHIPPED).collect()
    assert [tuple(r) for r in probe] == [("public", "probe", False, True, True)]
    with pytest.raises(Exception, match="unknown privilege: truncate"):
        privileges.privilege_lists(effective.withColumn("privilege", F.lit("truncate"))).collect()


def test_grants_and_revokes_as_tables_agree_with_the_decision_in_the_row(spark):
    relations = spark.createDataFrame(
        [("s", f"t{n}", n % 2 == 0, n % 3 == 0) for n in range(12)],
        "schema_name STRING, table_name STRING, is_new BOOLEAN, is_pii BOOLEAN")

    def table(rows, granted):
        listed = [(r, p) for r, privileges_ in granted.items() for p in privileges_]
        return rows.select("schema_name", "table_name", F.explode(F.array(*[
            F.struct(F.lit(r).alias("role"), F.lit(p).alias("privilege")) for r, p in listed])).alias("g")) \
            .select("g.role", "g.privilege", "schema_name", "table_name")

    grants = table(relations.where("is_new"), privileges.DEFAULT_GRANTS).union(
        table(relations.where("NOT is_new"), privileges.SCHEMA_GRANTS))
    revokes = table(relations.where("is_pii AND NOT is_new"), privileges.PII_REVOKES)
    by_tables = privileges.effective_privileges(grants, revokes, SHIPPED.holders(spark))
    assert pairs(by_tables) == pairs(privileges.relation_privileges(relations, SHIPPED))


def test_all_privileges_are_spelled_out_by_kind(spark):
    objects = spark.createDataFrame(
        [("table", "t", False, True), ("sequence", "q", False, False), ("sequence", "late", True, False),
         ("schema", "s", False, False), ("database", "d", False, False)],
        "kind STRING, name STRING, is_new BOOLEAN, is_pii BOOLEAN")
    held = {(r.role, r.name): set() for r in privileges.object_privileges(objects, SHIPPED).collect()}
    for r in privileges.object_privileges(objects, SHIPPED).collect():
        held[r.role, r.name].add(r.privilege)
    assert ("analysts", "t") not in held and ("engineers", "late") not in held
    assert held["engineers", "t"] == set(privileges.ALL_PRIVILEGES["table"])
    assert held["admins", "d"] == {"create", "connect", "temporary"} and held["engineers", "d"] == {"connect"}
    assert held["analysts", "s"] == {"usage"} and held["engineers", "q"] == {"usage", "select", "update"}
    with pytest.raises(Exception, match="unknown kind of object: view"):
        privileges.object_privileges(objects.withColumn("kind", F.lit("view")), SHIPPED).collect()


def test_names_grants_and_masks_that_collide(spark):
    names = spark.createDataFrame([("Team-a",), ("team_a",), ("team-b",), ("team-b",)], "name STRING")
    assert pairs(lint.role_name_collisions(names)) == [("team_a", 2, "Team-a", "team_a")]
    grants = spark.createDataFrame([("c", ["b", "a"]), ("c", ["a", "b", "a"]), ("c", ["a"])],
                                   "catalog STRING, roles ARRAY<STRING>")
    assert pairs(lint.duplicate_catalog_grants(grants)) == [("c", "a,b", 2)]
    masks = spark.createDataFrame(
        [("t", ["r"], {"x": "hash"}), ("t", ["r", "q"], {"x": "null", "y": "hash"}), ("t", ["q"], None)],
        "resource STRING, roles ARRAY<STRING>, column_mask MAP<STRING, STRING>")
    assert pairs(lint.conflicting_masks(masks)) == [("t", "r", "x", "hash, null")]


def test_drift(spark):
    schema = "object STRING, name STRING, roles ARRAY<STRING>"

    def side(*rows):
        return spark.createDataFrame(list(rows), schema)

    desired = side(("role", "analyst", []), ("group", "analysts", ["a", "b"]))
    same = side(("role", "analyst", []), ("group", "analysts", ["b", "a"]), ("group", "other", ["x"]))
    assert drift.drift(desired, same).count() == 0
    nothing = drift.drift(desired, same.limit(0)).collect()
    assert sorted((r.kind, r.target) for r in nothing) == [
        ("unapplied", "group/analysts"), ("unapplied", "role/analyst")]
    other = side(("role", "analyst", []), ("role", "ghost", []), ("group", "analysts", []))
    found = drift.drift(desired, other)
    assert sorted((r.kind, r.target) for r in found.collect()) == [
        ("manual", "role/ghost"), ("mismatch", "group/analysts")]
    assert pairs(drift.drift_summary(found)) == [("manual", 1), ("mismatch", 1)]
