"""The registered queries once more, as SQL for an independent engine over the same tables."""

from __future__ import annotations

# --- shared inputs -------------------------------------------------------------------------

CLICKS = """clicks AS (
  SELECT event_id, user_id, event_type AS action, ts, CAST(FLOOR(value) AS INTEGER) AS duration_ms
  FROM events)"""

MINUTES = f"""{CLICKS}, minutes AS (
  SELECT user_id, date_trunc('minute', ts) AS window_start,
         date_trunc('minute', ts) + INTERVAL 1 MINUTE AS window_end,
         COUNT(event_id) AS event_count, CAST(SUM(duration_ms) AS BIGINT) AS total_duration_ms
  FROM clicks GROUP BY user_id, date_trunc('minute', ts))"""

SHOP_ORDERS = """shop_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount, o_orderstatus AS status,
         o_orderdate AS updated_at
  FROM orders)"""

SHOP_CUSTOMERS = """shop_customers AS (
  SELECT c_custkey AS customer_id, c_name AS name,
         lower(replace(c_name, '#', '.')) || '@example.com' AS email, n_name AS city,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

ORDER_CHANGES = f"""{SHOP_ORDERS}, changes AS (
  SELECT order_id, customer_id, total_amount, status, updated_at, 'r' AS op,
         epoch_ms(updated_at) AS ts_ms, CAST(0 AS BIGINT) AS seq
  FROM shop_orders
  UNION ALL
  SELECT order_id, customer_id, total_amount, 'X', updated_at + INTERVAL 1 DAY, 'u',
         epoch_ms(updated_at + INTERVAL 1 DAY), 1
  FROM shop_orders WHERE order_id % 3 = 0
  UNION ALL
  SELECT order_id, customer_id, total_amount,
         CASE WHEN order_id % 3 = 0 THEN 'X' ELSE status END,
         CASE WHEN order_id % 3 = 0 THEN updated_at + INTERVAL 1 DAY ELSE updated_at END, 'd',
         epoch_ms(updated_at + INTERVAL 2 DAY), 2
  FROM shop_orders WHERE order_id % 10 = 0)"""

ORDER_HISTORY = f"""{ORDER_CHANGES}, timed AS (
  SELECT *, make_timestamp(ts_ms * 1000) AS valid_from,
         lead(make_timestamp(ts_ms * 1000)) OVER (PARTITION BY order_id ORDER BY seq, ts_ms) AS valid_to
  FROM changes),
history AS (SELECT * FROM timed WHERE op <> 'd')"""

CUSTOMER_CHANGES = f"""{SHOP_CUSTOMERS}, changes AS (
  SELECT customer_id, name, email, city, created_at, 'r' AS op, epoch_ms(created_at) AS ts_ms,
         CAST(0 AS BIGINT) AS seq
  FROM shop_customers
  UNION ALL
  SELECT customer_id, name, email, 'MOVED', created_at, 'u',
         epoch_ms(created_at + INTERVAL 1 DAY), 1
  FROM shop_customers WHERE customer_id % 4 = 0
  UNION ALL
  SELECT customer_id, name, email, CASE WHEN customer_id % 4 = 0 THEN 'MOVED' ELSE city END,
         created_at, 'd', epoch_ms(created_at + INTERVAL 2 DAY), 2
  FROM shop_customers WHERE customer_id % 9 = 0)"""

MERGED_ORDERS = f"""{ORDER_CHANGES}, merged AS (
  SELECT order_id, customer_id, total_amount, status, updated_at FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) AS rn FROM changes)
  WHERE rn = 1 AND op <> 'd')"""


def _requests(suffix: str) -> str:
    a, e, m = (f"'{n}{suffix}'" for n in ("analyst", "engineer", "admin"))
    return f"""picked AS (
  SELECT event_id AS request_id, ts, user_id,
         CASE WHEN user_id % 40 = 7 THEN 'analyst' ELSE 'user_' || user_id END AS "user",
         CASE WHEN user_id % 11 <> 0 THEN
           ([CAST([] AS VARCHAR[]), [{a}], [{e}], [{m}], [{a}, {e}], ['nobody']])[user_id % 6 + 1]
         END AS groups,
         (['SelectFromColumns', 'InsertIntoTable', 'UpdateTableColumns', 'DeleteFromTable',
           'DropTable', 'AddColumn', 'ExecuteQuery', 'AccessCatalog', 'ShowSchemas',
           'FilterCatalogs', 'ShowTables', 'FilterSchemas', 'ShowFunctions', 'ShowColumns',
           'ShowCreateTable', 'FilterTables', 'SetCatalogSessionProperty'])
         [event_id % 17 + 1] AS operation,
         CASE WHEN event_id % 5 = 0 THEN 'system' WHEN event_id % 19 = 0 THEN 'evil'
              ELSE 'iceberg' END AS named_catalog,
         (['customers', 'orders', 'events_enriched', 'customers_v2'])
         [(event_id // 7) % 4 + 1] AS named_table
  FROM events),
requests AS (
  SELECT *, CASE
    WHEN operation = 'ExecuteQuery' THEN 'none'
    WHEN operation IN ('AccessCatalog', 'ShowSchemas', 'FilterCatalogs') THEN 'catalog'
    WHEN operation IN ('ShowTables', 'FilterSchemas', 'ShowFunctions') THEN 'schema'
    WHEN operation = 'SetCatalogSessionProperty' THEN 'property'
    WHEN operation = 'SelectFromColumns' AND request_id % 2 = 1 THEN 'column'
    ELSE 'table' END AS shape
  FROM picked)"""


def _in_group(name: str) -> str:
    return f"""(COALESCE(list_contains(groups, '{name}'), FALSE) OR "user" = '{name}')"""


ORDERS_AFTER_CLICKS = """WITH clicks AS (
  SELECT 'evt_' || event_id AS event_id, 'user_' || user_id AS user_id, ts AS clicked_at FROM events),
placements AS (
  SELECT o_orderkey AS order_id, 'user_' || o_custkey AS user_id,
         CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds((o_orderkey * 7919) % 2592000) AS placed_at
  FROM orders)
SELECT c.event_id, c.user_id, c.clicked_at, p.order_id, p.placed_at, p.total_amount
FROM clicks c JOIN placements p ON c.user_id = p.user_id AND p.placed_at >= c.clicked_at
  AND p.placed_at <= c.clicked_at + INTERVAL 1 HOUR"""

DECISIONS = f"""{_requests('')}, flags AS (
  SELECT *, {_in_group('analyst')} AS analyst, {_in_group('engineer')} AS engineer,
         {_in_group('admin')} AS admin,
         shape IN ('table', 'column') AND named_table = 'customers' AS customers,
         shape IN ('table', 'column', 'schema', 'catalog') AND named_catalog = 'system' AS system,
         operation IN ('InsertIntoTable', 'DeleteFromTable', 'DropTable', 'AddColumn') AS write
  FROM requests),
decisions AS (
  SELECT *, analyst AND customers AS deny_analyst_pii, analyst AND write AS deny_analyst_write,
         engineer AND system AND write AS deny_engineer_system,
         NOT (analyst OR engineer OR admin) AND customers AS deny_unknown_pii
  FROM flags)"""

DENIED = ("(deny_analyst_pii OR deny_analyst_write OR deny_engineer_system "
          "OR deny_unknown_pii)")

TOPIC_REQUESTS = """asked AS (
  SELECT event_id AS request_id, user_id % 5 AS form,
         (['analyst', 'engineer', 'admin', 'guest'])[user_id % 4 + 1] AS role, user_id,
         (['Read', 'Write', 'Describe', 'Delete', 'Alter', 'AlterConfigs', 'Create'])
         [event_id % 7 + 1] AS operation,
         (['topic', 'group', 'cluster'])[event_id % 3 + 1] AS resource_type
  FROM events)"""

CATALOG_DECISIONS = f"""{_requests('s')}, catalog_decisions AS (
  SELECT *, operation IN (
           'SelectFromColumns', 'InsertIntoTable', 'UpdateTableColumns', 'DeleteFromTable',
           'DropTable', 'AddColumn') AS on_data,
    CASE WHEN NOT on_data AND operation <> 'ExecuteQuery' THEN named_catalog END AS catalog,
    NOT on_data AND (operation = 'ExecuteQuery' OR named_catalog = 'iceberg')
    AND COALESCE(list_has_any(groups, ['analysts', 'engineers', 'admins']), FALSE) AS allowed
  FROM requests)"""

ROLE_EDGES = """edges AS (
  SELECT 'c-' || c_custkey AS role, 's-' || c_nationkey || '-' || lower(c_mktsegment) AS parent
  FROM customer
  UNION
  SELECT 's-' || c_nationkey || '-' || lower(c_mktsegment), 'n-' || c_nationkey FROM customer
  UNION
  SELECT 'n-' || n_nationkey, 'r-' || n_regionkey FROM nation
  UNION
  SELECT 'r-' || n_regionkey, 'engineers' FROM nation
  UNION
  SELECT 'engineers', 'analysts'
  UNION
  SELECT 'admins', 'engineers')"""

ROLE_REACH = f"""RECURSIVE {ROLE_EDGES}, reach AS (
  SELECT role, role AS effective_role FROM edges
  UNION
  SELECT parent, parent FROM edges
  UNION
  SELECT reach.role, edges.parent FROM reach JOIN edges ON reach.effective_role = edges.role)"""

RELATIONS = """relations AS (
  SELECT lower(replace(p_brand, '#', '_')) AS schema_name, 'part_' || p_partkey AS table_name,
         p_partkey % 5 = 0 AS is_new, p_size > 40 AS is_pii
  FROM part)"""

EFFECTIVE = f"""{RELATIONS}, effective AS (
  SELECT 'analysts' AS role, 'select' AS privilege, schema_name, table_name
  FROM relations WHERE NOT is_new AND NOT is_pii
  UNION ALL
  SELECT role, privilege, schema_name, table_name
  FROM relations, (VALUES ('engineers'), ('admins')) AS r(role),
       (VALUES ('select'), ('insert'), ('update'), ('delete')) AS p(privilege))"""

DECLARED_GRANTS = """grants AS (
  SELECT 'lake.part_' || l_partkey AS resource, l_orderkey || '-' || l_linenumber AS grant_id,
         CASE WHEN l_orderkey % 101 = 0 THEN 'ghost-' ELSE 's-' END || l_suppkey AS role,
         l_linenumber % 2 = 1 AS reads,
         CASE WHEN l_linenumber % 3 = 0 THEN ['email']
              WHEN l_linenumber % 3 = 1 THEN ['email', 'ssn'] ELSE [] END AS masked,
         l_linenumber % 3 AS mask_kind,
         CASE WHEN l_orderkey % 9 <> 0 THEN
           (['branch = ''north''', 'floor IN (3, 5, 8)', 'signed_by = current_user',
             'weight >= 2.5 AND state <> ''void''', 'branch = ''north'') OR (weight > 0',
             'floor IN (SELECT 3)', 'weight > 1 AND floor = 2 OR floor = 3', 'state = ''void'])
           [l_orderkey % 8 + 1] END AS row_filter,
         l_returnflag = 'A' AS allow_unmasked
  FROM lineitem)"""

DRIFT = """desired AS (
  SELECT 'role' AS object, 'c-' || c_custkey AS name, '' AS roles FROM customer
  UNION ALL
  SELECT 'group', 'team-' || c_custkey, 'c-' || c_custkey || ',viewers' FROM customer),
actual AS (
  SELECT 'role' AS object, 'c-' || c_custkey AS name, '' AS roles
  FROM customer WHERE c_custkey % 11 <> 0
  UNION ALL
  SELECT 'role', 'manual-' || c_custkey, '' FROM customer WHERE c_custkey % 17 = 0
  UNION ALL
  SELECT 'group', 'team-' || c_custkey, 'c-' || c_custkey ||
         CASE WHEN c_custkey % 19 = 0 THEN '' ELSE ',viewers' END
  FROM customer WHERE c_custkey % 13 <> 0),
items AS (
  SELECT 'unapplied' AS kind, object || '/' || name AS target,
         roles AS expected, CAST(NULL AS VARCHAR) AS found
  FROM desired d WHERE NOT EXISTS (
    SELECT 1 FROM actual a WHERE a.object = d.object AND a.name = d.name)
  UNION ALL
  SELECT 'manual', object || '/' || name, NULL, roles
  FROM actual a WHERE object = 'role' AND NOT EXISTS (
    SELECT 1 FROM desired d WHERE a.object = d.object AND a.name = d.name)
  UNION ALL
  SELECT 'mismatch', d.object || '/' || d.name, d.roles, a.roles
  FROM desired d JOIN actual a ON a.object = d.object AND a.name = d.name
  WHERE d.roles <> a.roles)"""

CLICK_RECORDS = """records AS (
  SELECT 'evt_' || event_id AS event_id, 'user_' || user_id AS user_id,
         '/' || event_type AS page, event_type AS action, ts AS "timestamp",
         CAST(FLOOR(value) AS INTEGER) AS duration_ms
  FROM events)"""

SESSIONS = f"""{CLICKS}, marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts
  FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (
  SELECT *, SUM(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM marked),
sessions AS (
  SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end,
         COUNT(event_id) AS event_count, CAST(SUM(duration_ms) AS BIGINT) AS total_duration_ms
  FROM numbered GROUP BY user_id, session_no)"""

PER_MINUTE = """SELECT window_start, CAST(SUM(event_count) AS BIGINT) AS event_count
FROM minutes GROUP BY window_start ORDER BY event_count DESC, window_start LIMIT 10000"""

_MERGE = f"WITH {MERGED_ORDERS} SELECT * FROM merged"

_CUSTOMERS = f"WITH {SHOP_CUSTOMERS} SELECT * FROM shop_customers"

_ORDERS = f"WITH {SHOP_ORDERS} SELECT * FROM shop_orders"


ORACLES: dict[str, str] = {
    "clickstream_tumble": f"WITH {MINUTES} SELECT * FROM minutes",
    "clickstream_sessions": f"WITH {SESSIONS} SELECT * FROM sessions",
    "daily_rollup": f"""WITH {MINUTES}
SELECT CAST(window_start AS DATE) AS day, COUNT(*) AS user_minutes,
       CAST(SUM(event_count) AS BIGINT) AS event_count,
       CAST(SUM(total_duration_ms) AS BIGINT) AS total_duration_ms
FROM minutes GROUP BY CAST(window_start AS DATE)""",
    "daily_rollup_incremental": f"""WITH {MINUTES}
SELECT CAST(window_start AS DATE) AS day, COUNT(*) AS user_minutes,
       CAST(SUM(event_count) AS BIGINT) AS event_count,
       CAST(SUM(total_duration_ms) AS BIGINT) AS total_duration_ms
FROM minutes GROUP BY CAST(window_start AS DATE)""",
    "events_orders_join": f"""WITH {CLICKS}, {SHOP_ORDERS}
SELECT order_id, customer_id, total_amount, status, event_count, total_duration_ms,
       last_seen
FROM shop_orders JOIN (
  SELECT user_id, COUNT(event_id) AS event_count,
         CAST(SUM(duration_ms) AS BIGINT) AS total_duration_ms,
         date_trunc('minute', MAX(ts)) + INTERVAL 1 MINUTE AS last_seen
  FROM clicks GROUP BY user_id) ON user_id = customer_id""",
    "events_to_json": f"""WITH {CLICK_RECORDS}
SELECT user_id AS key,
       '{{"event_id":"' || event_id || '","user_id":"' || user_id || '","page":"' || page ||
       '","action":"' || action || '","timestamp":"' ||
       strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '","duration_ms":' || duration_ms || '}}'
       AS value
FROM records""",
    "clickstream_decode": f"WITH {CLICK_RECORDS} SELECT * FROM records",
    "stream_clickstream_tumble": f"""WITH {MINUTES}
SELECT 'user_' || user_id AS user_id, window_start, window_end, event_count, total_duration_ms
FROM minutes WHERE window_end <= (SELECT MAX(ts) - INTERVAL 5 SECOND FROM events)""",
    "stream_clickstream_sessions": f"""WITH {SESSIONS}
SELECT 'user_' || user_id AS user_id, session_start, session_end, event_count, total_duration_ms
FROM sessions WHERE session_end <= (SELECT MAX(ts) - INTERVAL 5 SECOND FROM events)""",

    "stream_tumble_restart": f"""WITH {MINUTES}
SELECT 'user_' || user_id AS user_id, window_start, window_end, event_count, total_duration_ms
FROM minutes WHERE window_end <= (SELECT MAX(ts) - INTERVAL 5 SECOND FROM events)""",
    "events_orders_interval": ORDERS_AFTER_CLICKS,
    "stream_events_orders_join": ORDERS_AFTER_CLICKS,
    "orders_history": f"""WITH {ORDER_HISTORY}
SELECT order_id, customer_id, total_amount, status, valid_from, valid_to FROM history""",
    "events_with_order_state": f"""WITH {ORDER_HISTORY}
SELECT e.event_id, e.user_id, e.ts, h.order_id, h.status, h.total_amount
FROM events e JOIN history h ON h.customer_id = e.user_id AND h.valid_from <= e.ts
  AND (h.valid_to IS NULL OR e.ts < h.valid_to)""",
    "stream_late_rows": f"""WITH {CLICKS}, span AS (
  SELECT make_timestamp((epoch_us(MIN(ts)) + epoch_us(MAX(ts))) // 2) AS middle, MAX(ts) AS last FROM events)
SELECT 'user_' || user_id AS user_id, date_trunc('minute', ts) AS window_start,
       date_trunc('minute', ts) + INTERVAL 1 MINUTE AS window_end, COUNT(event_id) AS event_count,
       CAST(SUM(duration_ms) AS BIGINT) AS total_duration_ms
FROM clicks, span WHERE NOT (ts < middle AND event_id % 50 = 0)
GROUP BY user_id, date_trunc('minute', ts)
HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT last - INTERVAL 5 SECOND FROM span)""",

    "cdc_orders_normalize": f"""WITH {ORDER_CHANGES}
SELECT order_id, customer_id, CAST(total_amount AS VARCHAR) AS total_amount, status,
       strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS updated_at, op, ts_ms, seq
FROM changes""",
    "cdc_orders_mirror": f"WITH {ORDER_CHANGES} SELECT * FROM changes",
    "cdc_customers_mirror": f"WITH {CUSTOMER_CHANGES} SELECT * FROM changes",
    "cdc_bootstrap_union": f"""WITH {ORDER_CHANGES}
SELECT *, 'r' AS op, CAST(0 AS BIGINT) AS ts_ms, CAST(0 AS BIGINT) AS seq FROM shop_orders
UNION ALL SELECT * FROM changes WHERE op <> 'r'""",
    "cdc_orders_merge": _MERGE,
    "cdc_chunked_bootstrap": _MERGE,
    "orders_as_of": f"""WITH {ORDER_CHANGES}
SELECT order_id, customer_id, total_amount, status, updated_at, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) AS rn
  FROM changes WHERE ts_ms <= epoch_ms(TIMESTAMP '1998-01-01 00:00:00'))
WHERE rn = 1 AND op <> 'd'""",
    "stream_cdc_upsert": _MERGE,
    "stream_upsert_restart": _MERGE,
    "stream_cdc_upsert_customers": f"""WITH {CUSTOMER_CHANGES}
SELECT customer_id, name, email, city, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY seq DESC) AS rn FROM changes)
WHERE rn = 1 AND op <> 'd'""",

    "insert_ignore_conflict": f"""WITH {SHOP_CUSTOMERS}, incoming AS (
  SELECT customer_id, name, city, 'user' || (customer_id // 3) || '@example.com' AS email
  FROM shop_customers)
SELECT * FROM incoming WHERE customer_id % 6 = 0
UNION ALL
SELECT * FROM incoming i
WHERE customer_id = (SELECT MIN(customer_id) FROM incoming j WHERE j.email = i.email)
  AND NOT EXISTS (SELECT 1 FROM incoming t WHERE t.customer_id % 6 = 0 AND t.email = i.email)""",
    "seed_insert_if_empty": f"""WITH {SHOP_ORDERS}
SELECT customer_id, total_amount, status FROM shop_orders
UNION ALL
SELECT * FROM (VALUES (1, 12.50, 'OPEN'), (2, 7.25, 'PAID'), (2, 99.00, 'SENT'), (3, 0.75, 'OPEN'))
  AS seed(customer_id, total_amount, status)
WHERE NOT EXISTS (SELECT 1 FROM shop_orders)""",
    "seed_insert_into_empty": f"""WITH {SHOP_ORDERS}, target AS (
  SELECT customer_id, total_amount, status FROM shop_orders WHERE status = 'NONE')
SELECT * FROM target
UNION ALL
SELECT * FROM (VALUES (1, 12.50, 'OPEN'), (2, 7.25, 'PAID'), (2, 99.00, 'SENT'), (3, 0.75, 'OPEN'))
  AS seed(customer_id, total_amount, status)
WHERE NOT EXISTS (SELECT 1 FROM target)""",
    "unique_violations": """SELECT 'user' || (c_custkey // 3) || '@example.com' AS email,
       COUNT(*) AS row_count FROM customer GROUP BY c_custkey // 3 HAVING COUNT(*) > 1""",
    "duplicate_minutes": """SELECT user_id, date_trunc('minute', ts) AS window_start,
       CAST(2 AS BIGINT) AS row_count
FROM events WHERE event_type = 'purchase' GROUP BY user_id, date_trunc('minute', ts)""",
    "not_null_violations": """SELECT c_custkey AS customer_id, 'email' AS column_name
FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, 'city' FROM customer WHERE c_custkey % 9 = 0""",
    "length_violations": """SELECT c_custkey AS customer_id, 'city' AS column_name,
       CAST(10 * length(n_name) AS INTEGER) AS length
FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_custkey % 5 = 0 AND 10 * length(n_name) > 50""",
    "fk_violations": f"""WITH {SHOP_ORDERS}, child AS (
  SELECT order_id, total_amount, status, updated_at,
         CASE WHEN order_id % 50 = 0 THEN -customer_id - 1
              WHEN order_id % 70 <> 0 THEN customer_id END AS customer_id
  FROM shop_orders)
SELECT customer_id, order_id, total_amount, status, updated_at FROM child
WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT c_custkey FROM customer)""",

    "dash_events_per_minute": f"WITH {MINUTES} {PER_MINUTE}",
    "dash_orders_by_status": f"""WITH {MERGED_ORDERS}
SELECT status, COUNT(order_id) AS order_count FROM merged GROUP BY status
ORDER BY order_count DESC, status LIMIT 100""",
    "dash_orders_by_status_series": f"""WITH {MERGED_ORDERS}
SELECT status, status AS series, COUNT(order_id) AS order_count FROM merged GROUP BY status
ORDER BY order_count DESC, status LIMIT 100""",
    "table_row_count": "SELECT COUNT(*) AS row_count FROM lineitem",

    "compaction_rewrite": "SELECT * FROM orders",
    "retention_after_compaction": "SELECT * FROM orders",
    "create_if_absent_with_default": """
SELECT c_custkey AS customer_id, c_name AS name, TRUE AS stamped FROM customer""",
    "mask_hash": f"""WITH {SHOP_CUSTOMERS}
SELECT customer_id, name, upper(sha256(email)) AS email, city, created_at FROM shop_customers""",
    "mask_partial": f"""WITH {SHOP_CUSTOMERS}
SELECT customer_id, substr(name, 1, 2) || '***' AS name, substr(email, 1, 2) || '***' AS email,
       city, created_at
FROM shop_customers""",
    "mask_null": f"""WITH {SHOP_CUSTOMERS}
SELECT customer_id, name, CAST(NULL AS VARCHAR) AS email, city,
       CAST(NULL AS TIMESTAMP) AS created_at
FROM shop_customers""",
    "row_filter_compare": f"{_CUSTOMERS} WHERE customer_id >= 100 AND city <> 'NATION_3'",
    "row_filter_in": f"{_CUSTOMERS} WHERE city IN ('NATION_1', 'NATION_7')",
    "row_filter_current_user": f"{_CUSTOMERS} WHERE name = 'Customer#000000042'",
    "row_filter_and_chain":
        f"{_ORDERS} WHERE status = 'O' AND total_amount >= 1000.50 AND order_id > 7",
    "row_filter_or_chain":
        f"{_ORDERS} WHERE status = 'F' OR total_amount < 5000 OR customer_id IN (1, 2)",

    "authz_decide_deny": f"""WITH {DECISIONS}
SELECT request_id, operation, deny_analyst_pii, deny_analyst_write, deny_engineer_system,
       deny_unknown_pii, NOT {DENIED} AS allowed
FROM decisions""",
    "decisions_as_of_policy": f"""WITH {DECISIONS},
changes AS (
  SELECT event_id AS version, ts, (['customers', 'orders', 'events_enriched', 'customers_v2'])
         [(event_id // 50) % 4 + 1] AS table_name, (event_id // 50) % 3 <> 0 AS protected
  FROM events WHERE event_id % 50 = 0),
named AS (
  SELECT *, CASE WHEN shape IN ('table', 'column') THEN named_table END AS table_name FROM flags),
tagged AS (
  SELECT request_id, table_name, ts, 1 AS kind, NULL::BIGINT AS version FROM named
  UNION ALL
  SELECT NULL, table_name, ts, 0, version FROM changes),
carried AS (
  SELECT request_id, last_value(version IGNORE NULLS) OVER (
           PARTITION BY table_name ORDER BY ts, kind, version
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS policy_version
  FROM tagged WHERE kind = 1 OR (table_name IS NOT NULL AND ts IS NOT NULL)),
judged AS (
  SELECT n.*, c.policy_version,
         coalesce(p.protected, n.table_name = 'customers', FALSE) AS prot
  FROM named n JOIN carried c USING (request_id)
  LEFT JOIN changes p ON p.version = c.policy_version AND n.table_name IS NOT NULL AND n.ts IS NOT NULL)
SELECT request_id, table_name, CASE WHEN table_name IS NOT NULL AND ts IS NOT NULL THEN policy_version END
       AS policy_version, prot AS protected,
       NOT ((analyst AND prot) OR (analyst AND write) OR (engineer AND system AND write)
            OR (NOT (analyst OR engineer OR admin) AND prot)) AS allowed
FROM judged""",
    "visible_rows_by_role": """
SELECT 'admins' AS role, TRUE AS allowed, count(*) AS visible_rows,
       'customer_id,order_id,status,total_amount,updated_at' AS open_columns FROM orders
UNION ALL
SELECT 'analysts', TRUE, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey > 100),
       'customer_id,order_id,status,updated_at' FROM orders
UNION ALL
SELECT 'engineers', TRUE,
       count(*) FILTER (WHERE o_orderkey > 100 AND CAST(o_totalprice AS DECIMAL(10,2)) >= 1000.50),
       'order_id,status,total_amount,updated_at' FROM orders""",
    "authz_topic_decide": f"""WITH {TOPIC_REQUESTS}
SELECT request_id, operation, NOT (role = 'analyst' AND operation IN
       ('Write', 'Delete', 'Alter', 'AlterConfigs', 'Create')) AS allowed
FROM asked""",
    "topic_acl_matrix": f"""WITH {TOPIC_REQUESTS}, named AS (
  SELECT *, CASE WHEN form <= 2 THEN role ELSE 'u' || user_id END AS account FROM asked)
SELECT request_id, account, resource_type, operation,
       account = 'admin'
       OR (account = 'engineer' AND resource_type = 'topic'
           AND operation IN ('Read', 'Write', 'Describe'))
       OR (account = 'analyst' AND resource_type = 'topic' AND operation IN ('Read', 'Describe'))
       OR (account IN ('engineer', 'analyst') AND resource_type = 'group' AND operation = 'Read')
       AS allowed
FROM named""",
    "authz_decide_allow": f"""WITH {_requests('s')}, aimed AS (
  SELECT *, CASE WHEN shape = 'table' THEN named_catalog END AS catalog_name,
         CASE WHEN shape = 'table' THEN named_table END AS table_name
  FROM requests)
SELECT request_id, "user", operation, catalog_name, table_name,
       COALESCE(catalog_name = 'iceberg' AND (
         (table_name IN ('orders', 'events_enriched') AND operation = 'SelectFromColumns'
          AND list_has_any(groups, ['analysts', 'engineers', 'admins']))
         OR (table_name IN ('orders', 'events_enriched', 'customers')
             AND operation IN ('SelectFromColumns', 'InsertIntoTable', 'UpdateTableColumns',
                               'DeleteFromTable')
             AND list_has_any(groups, ['engineers', 'admins']))), FALSE) AS allowed
FROM aimed""",
    "authz_row_rules": f"""WITH {_requests('s')}, aimed AS (
  SELECT request_id, CASE WHEN shape IN ('table', 'column') THEN named_table END AS table_name,
         COALESCE(list_contains(groups, 'analysts'), FALSE) AS analyst,
         COALESCE(list_contains(groups, 'engineers'), FALSE) AS engineer
  FROM requests)
SELECT request_id, table_name,
       CASE WHEN table_name = 'orders' AND analyst THEN 'order_id > 0 and status = ''O'''
            WHEN table_name = 'orders' AND engineer THEN 'order_id > 0' ELSE '' END AS row_filters,
       CASE WHEN table_name = 'orders' AND analyst THEN 'total_amount:null'
            WHEN table_name = 'customers' AND engineer THEN 'email:hash,name:partial' ELSE '' END AS masks
FROM aimed""",
    "authz_catalog_ops": f"""WITH {CATALOG_DECISIONS}
SELECT request_id, "user", operation, catalog, allowed FROM catalog_decisions""",
    "authz_visible_tables": f"""WITH {CATALOG_DECISIONS}
SELECT request_id, "user", operation, catalog,
       CASE WHEN operation <> 'FilterCatalogs' THEN 'lake' END AS schema_name,
       CASE WHEN operation = 'FilterTables' THEN named_table END AS table_name
FROM catalog_decisions
WHERE operation IN ('FilterCatalogs', 'FilterSchemas', 'FilterTables') AND allowed""",
    "app_role_map": """WITH users AS (
  SELECT c_custkey AS customer_id,
         (['admins', 'engineers', 'analysts', 'guests'])[c_custkey % 4 + 1] AS group_name
  FROM customer)
SELECT group_name, customer_id, CASE group_name WHEN 'admins' THEN 'Admin'
       WHEN 'engineers' THEN 'Alpha' ELSE 'Gamma' END AS app_role
FROM users""",

    "role_closure": f"WITH {ROLE_REACH} SELECT * FROM reach",
    "role_holders": f"""WITH {ROLE_REACH}
SELECT effective_role AS role, role AS holder FROM reach""",
    "group_effective_roles": f"""WITH {ROLE_REACH}, teams AS (
  SELECT 'team-' || c_custkey AS group_name, 'c-' || c_custkey AS role FROM customer
  UNION ALL
  SELECT 'team-' || c_custkey, 'admins' FROM customer WHERE c_custkey % 7 = 0)
SELECT DISTINCT group_name, effective_role FROM teams JOIN reach USING (role)""",
    "effective_privileges": f"WITH {EFFECTIVE} SELECT * FROM effective",
    "privilege_lists": f"""WITH {EFFECTIVE}
SELECT role, schema_name, table_name, CASE WHEN role = 'analysts' THEN 'select'
       ELSE 'select, insert, update, delete' END AS privileges
FROM effective GROUP BY role, schema_name, table_name""",
    "object_privileges": """WITH objects AS (
  SELECT (['table', 'sequence', 'schema', 'database'])[p_partkey % 4 + 1] AS kind, p_partkey,
         p_partkey % 5 = 0 AS is_new, p_size > 40 AS is_pii
  FROM part),
spelled(kind, privilege) AS (VALUES
  ('table', 'select'), ('table', 'insert'), ('table', 'update'), ('table', 'delete'), ('table', 'truncate'),
  ('table', 'references'), ('table', 'trigger'), ('sequence', 'usage'), ('sequence', 'select'),
  ('sequence', 'update'), ('schema', 'usage'), ('schema', 'create'), ('database', 'create'),
  ('database', 'connect'), ('database', 'temporary')),
roles(role) AS (VALUES ('analysts'), ('engineers'), ('admins'))
SELECT role, privilege, kind, kind || '_' || p_partkey AS name
FROM objects JOIN spelled USING (kind), roles
WHERE CASE kind
  WHEN 'table' THEN role <> 'analysts' OR (privilege = 'select' AND NOT is_new AND NOT is_pii)
  WHEN 'sequence' THEN role <> 'analysts' AND NOT is_new
  WHEN 'schema' THEN privilege = 'usage' AND NOT is_new
  ELSE (privilege = 'connect' OR role = 'admins') AND NOT is_new END""",
    "default_deny_probe": f"""WITH {EFFECTIVE}
SELECT schema_name, table_name,
       COALESCE(bool_or(role = 'analysts'), FALSE) AS analyst_select,
       COALESCE(bool_or(role = 'engineers'), FALSE) AS engineer_select,
       COALESCE(bool_or(role = 'admins'), FALSE) AS admin_select
FROM relations LEFT JOIN (SELECT * FROM effective WHERE privilege = 'select')
     USING (schema_name, table_name)
WHERE is_new GROUP BY schema_name, table_name""",
    "policy_lint": f"""WITH {DECLARED_GRANTS}, includes AS (
  SELECT 's-' || s_suppkey AS name,
         CASE WHEN s_suppkey % 25 = 0 THEN 'twin-' || s_suppkey
              WHEN s_suppkey % 29 = 0 THEN 'ghost-' || s_suppkey
              ELSE 'n-' || s_nationkey END AS role
  FROM supplier
  UNION ALL
  SELECT 'twin-' || s_suppkey, 's-' || s_suppkey FROM supplier WHERE s_suppkey % 25 = 0),
known AS (
  SELECT name FROM includes UNION SELECT 'n-' || n_nationkey FROM nation),
refs AS (
  SELECT 'role/' || name AS subject, role FROM includes
  UNION ALL
  SELECT 'group/group-' || s_suppkey,
         CASE WHEN s_suppkey % 31 = 0 THEN 'lost-' ELSE 's-' END || s_suppkey FROM supplier
  UNION ALL
  SELECT resource || '/' || grant_id, role FROM grants),
resources AS (
  SELECT 'lake.part_' || p_partkey AS resource, p_size % 3 = 0 AS pii,
         CASE WHEN p_size % 9 = 0 THEN [] WHEN p_size % 2 = 0 THEN ['email']
              ELSE ['email', 'ssn'] END AS sensitive
  FROM part),
leaks AS (
  SELECT resource || '/' || grant_id AS subject,
         list_filter(sensitive, lambda c: NOT list_contains(masked, c)) AS open
  FROM grants JOIN resources USING (resource)
  WHERE pii AND reads AND NOT allow_unmasked)
SELECT 'UNKNOWN_ROLE' AS code, subject, role AS detail FROM refs
WHERE role NOT IN (SELECT name FROM known)
UNION ALL
SELECT 'CYCLIC_INHERITANCE', name, '' FROM includes i
WHERE EXISTS (SELECT 1 FROM includes j WHERE j.name = i.role AND j.role = i.name)
UNION ALL
SELECT 'PII_NO_SENSITIVE_COLUMNS', resource, '' FROM resources WHERE pii AND len(sensitive) = 0
UNION ALL
SELECT 'PII_UNMASKED', subject, array_to_string(open, ', ') FROM leaks WHERE len(open) > 0
UNION ALL
SELECT 'ROW_FILTER_REJECTED', resource || '/' || grant_id, row_filter FROM grants
WHERE row_filter IS NOT NULL AND row_filter NOT IN
  ('branch = ''north''', 'floor IN (3, 5, 8)', 'signed_by = current_user',
   'weight >= 2.5 AND state <> ''void''')""",
    "declared_exposure": f"""WITH {DECLARED_GRANTS}, resources AS (
  SELECT 'lake.part_' || p_partkey AS resource,
         CASE p_size % 3 WHEN 0 THEN 'pii' WHEN 1 THEN 'internal' ELSE 'public' END AS classification,
         CASE WHEN p_size % 9 = 0 THEN [] WHEN p_size % 2 = 0 THEN ['email']
              ELSE ['email', 'ssn'] END AS sensitive
  FROM part)
SELECT resource, grant_id, classification, array_to_string(sensitive, ',') AS sensitive_columns,
       CASE WHEN reads THEN array_to_string(
         list_filter(sensitive, lambda c: NOT list_contains(masked, c)), ',') ELSE '' END AS open_columns,
       allow_unmasked
FROM grants JOIN resources USING (resource)""",
    "role_name_collisions": """WITH names AS (
  SELECT CASE WHEN c_custkey % 6 = 0 THEN 'Team-' || (c_custkey // 2)
              WHEN c_custkey % 6 = 1 THEN 'team_' || (c_custkey // 2)
              ELSE 'team-' || c_custkey || '-x' END AS name
  FROM customer)
SELECT lower(replace(name, '-', '_')) AS folded, COUNT(DISTINCT name) AS spellings,
       MIN(name) AS first_name, MAX(name) AS last_name
FROM names GROUP BY lower(replace(name, '-', '_')) HAVING COUNT(DISTINCT name) > 1""",
    "duplicate_grants": """WITH grants AS (
  SELECT 'cat_' || o_custkey AS catalog, 'analysts,' || lower(o_orderstatus) AS role_set
  FROM orders)
SELECT catalog, role_set, COUNT(*) AS grant_count FROM grants
GROUP BY catalog, role_set HAVING COUNT(*) > 1""",
    "conflicting_masks": f"""WITH {DECLARED_GRANTS}
SELECT resource, role, 'email' AS column_name, 'hash, partial' AS masks
FROM grants WHERE mask_kind < 2
GROUP BY resource, role HAVING COUNT(DISTINCT mask_kind) = 2""",

    "drift_diff": f"WITH {DRIFT} SELECT * FROM items",
    "drift_summary": f"WITH {DRIFT} SELECT kind, COUNT(*) AS items FROM items GROUP BY kind",
    "audit_timeline": f"""WITH {DECISIONS}, {ORDER_CHANGES}
SELECT 'decision' AS source, ts, "user" AS principal, operation AS action,
       CASE WHEN {DENIED} THEN 'denied' ELSE 'allowed' END AS outcome,
       CAST(NULL AS VARCHAR) AS target
FROM decisions
UNION ALL
SELECT 'database', updated_at + to_days(CASE WHEN op <> 'd' THEN 0 WHEN status = 'X' AND
       order_id % 3 = 0 THEN 1 ELSE 2 END), NULL, op, NULL, 'orders/' || order_id
FROM changes
UNION ALL
SELECT 'query', ts, 'user_' || user_id, event_type, NULL, 'query/' || event_id
FROM events""",
    "recent_denials": f"""WITH {DECISIONS}
SELECT operation, COUNT(*) AS denials FROM decisions
WHERE {DENIED} AND ts > (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY GROUP BY operation""",
    "lineage_reach": """WITH RECURSIVE edges AS (
  SELECT 'topic/user_' || user_id AS src, 'job/tumble_' || event_type AS dst FROM events
  UNION
  SELECT 'job/tumble_' || event_type, 'table/' || event_type || '_minutes' FROM events
  UNION
  SELECT 'table/' || event_type || '_minutes', 'dashboard/activity' FROM events),
reach AS (
  SELECT src, dst FROM edges
  UNION
  SELECT reach.src, edges.dst FROM reach JOIN edges ON reach.dst = edges.src)
SELECT * FROM reach""",
}
