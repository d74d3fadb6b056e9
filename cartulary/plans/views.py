"""The bindings again, as SQL views for the checks."""

VIEWS = {
    "v_tables": """
        SELECT c_custkey AS custkey, lower(r_name || '/' || n_name || '/' || c_name) AS name,
               lower(r_name) AS catalog_name, lower(n_name) AS database_name, lower(c_name) AS table_name,
               'u' || (c_custkey % 50) AS owner,
               's3://wh/' || lower(r_name || '/' || n_name || '/' || c_name) AS uri,
               lower(c_mktsegment) AS segment
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_parts": """
        SELECT part_id, 'c' || o_custkey AS table_name,
               'dateint=' || d || '/status=' || coalesce(status, '__HIVE_DEFAULT_PARTITION__') AS part_name,
               create_time,
               's3://wh/c' || o_custkey || '/dateint=' || d || '/status='
                   || coalesce(status, '__HIVE_DEFAULT_PARTITION__') || '/batchid=' || (part_id % 5) AS uri,
               CAST(d AS BIGINT) AS dateint, d AS datetext, status, part_id % 5 AS batchid
        FROM (SELECT o_custkey, strftime(o_orderdate, '%Y%m%d') AS d,
                     CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE o_orderstatus END AS status,
                     min(o_orderkey) AS part_id, arg_min(o_orderdate, o_orderkey) AS create_time
              FROM orders GROUP BY 1, 2, 3)""",
    "v_audit": """
        SELECT part_id, table_name, CASE status WHEN 'P' THEN 'dateint=' || datetext || '/status=A' ELSE part_name END AS part_name,
               create_time, uri || '-audit' AS uri
        FROM v_parts WHERE status IN ('F', 'P')""",
    "v_new": """
        SELECT part_id, table_name, CASE status WHEN 'P' THEN 'dateint=' || datetext || '/status=N' ELSE part_name END AS part_name,
               create_time + INTERVAL 1 DAY AS create_time,
               CASE WHEN status IS NULL THEN '' WHEN status = 'O' THEN uri || '/v2' ELSE uri END AS uri
        FROM v_parts WHERE dateint >= 19960101""",
    "v_deletes": "SELECT table_name, part_name FROM v_parts WHERE dateint < 19960101",
    "v_defs": """
        SELECT custkey AS id, name, segment, owner,
               CASE segment WHEN 'machinery' THEN '{' WHEN 'furniture' THEN '{"owner":{"userId":""},'
                   ELSE '{"owner":{"userId":"' || owner || '","team":"' || segment || '"},' END
               || '"tags":["' || segment || '"],"custkey":' || custkey || '}' AS data,
               CAST(DATE '2024-01-01' + CAST(custkey % 365 AS INTEGER) AS TIMESTAMP) AS last_updated
        FROM v_tables""",
    "v_data": """
        SELECT user_id AS id, 's3://wh/u' || user_id AS uri, props AS data, event_type, ts AS date_created
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "v_tags": """
        SELECT 'prod/' || lower(p_brand) || '/p' || p_partkey AS name, unnest([p_brand, p_type]) AS tag FROM part""",
    "v_edges": """
        SELECT 'geo/' || catalog_name || '/' || database_name AS parent, 'n-' || database_name AS parent_uuid,
               'geo/customer/' || table_name AS child, 'c' || custkey AS child_uuid, segment AS relation_type
        FROM v_tables""",
    "v_log": """
        SELECT event_id, ts, 'u' || user_id AS name,
               CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'add' WHEN 'error' THEN 'delete'
                   ELSE 'update' END AS op, props AS payload
        FROM events""",
    "v_docs": """
        SELECT source || '/' || lang || '/d' || doc_id AS name, 'table' AS kind, text AS body, 'admin' AS "user",
               lang = 'fr' AS deleted, n_chars AS updated_at, source AS run, 's3://wh/' || source || '/' || lang AS uri,
               source, lang, doc_id
        FROM documents""",
}
