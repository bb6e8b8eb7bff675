"""DuckDB SQL equivalents of the registered queries (correctness oracle).

Each string runs against the driver tables registered as views. Helper
functions only assemble repetitive SQL text (per-column renderings); the
resulting statements are plain SQL.
"""

from __future__ import annotations

from quarry.plans.oracle_pages import parsed_queries, rendered_queries

# Column layout of the driver tables as stored: (name, kind) with kind in
# int / double / ts / str, used to render report text identically to
# ``quarry.plans.fixtures.text_column``.
TABLE_COLUMNS = {
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"),
               ("o_totalprice", "double"), ("o_orderdate", "ts"), ("o_orderpriority", "str")],
    "customer": [("c_custkey", "int"), ("c_name", "str"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "str")],
    "events": [("event_id", "int"), ("ts", "ts"), ("user_id", "int"), ("event_type", "str"),
               ("value", "double"), ("props", "str")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "str"),
                 ("l_linestatus", "str"), ("l_shipdate", "ts")],
}


# Report layout of orders as landed by ``write_order_report`` (dates
# without time, Japanese headers).
REPORT_LAYOUTS = {
    "orders_report": ("orders", [("o_orderkey", "int", "注文番号"), ("o_custkey", "int", "顧客番号"),
                                 ("o_orderstatus", "str", "状態"), ("o_totalprice", "double", "金額"),
                                 ("o_orderdate", "date", "注文日"), ("o_orderpriority", "str", "優先度")]),
    "events_uneven": ("""(SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN CAST(user_id AS VARCHAR)
           WHEN 2 THEN CAST(user_id + 100 AS VARCHAR) ELSE CAST(user_id AS VARCHAR) || '.5' END AS mixed,
         CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN '2024/01/0' || (event_id % 9 + 1)
           ELSE event_type END AS half FROM events) e""",
                      [("event_id", "int", "event_id"), ("mixed", "str", "mixed"), ("half", "str", "half")]),
    "events_gappy": ("""(SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN user_id || '.0' END AS points,
         CASE WHEN event_id % 3 = 0 THEN CAST(CAST(printf('%.2f', value) AS DOUBLE) AS VARCHAR) ELSE user_id || '.0' END AS amount
         FROM events) e""",
                     [("event_id", "int", "event_id"), ("points", "str", "points"), ("amount", "str", "amount"), ("event_type", "str", "event_type")]),
}


def _render(name: str, kind: str) -> str:
    if kind == "date":
        return f"strftime({name}, '%Y-%m-%d')"
    if kind == "double":
        return f"printf('%.2f', {name})"
    if kind == "ts":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({name} AS VARCHAR)"


def cells_sql(table: str, key: str) -> str:
    """Long table (col_pos, column_name, rn, value) of a table's report text."""
    if table in REPORT_LAYOUTS:
        src, cols = REPORT_LAYOUTS[table]
    else:
        src, cols = table, [(c, k, c) for c, k in TABLE_COLUMNS[table]]
    parts = [
        f"SELECT {i} AS col_pos, '{label}' AS column_name, {key} + 1 AS rn, {_render(c, k)} AS value FROM {src}"
        for i, (c, k, label) in enumerate(cols)
    ]
    return "\nUNION ALL\n".join(parts)


NUMBER_RE = r"^\s*[+-]?(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?\s*$"
SPECIAL_RE = r"^\s*[+-]?(?:inf|infinity|nan)\s*$"
DATE_RE = r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}$"
TS_RE = r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}[T\s]\d{1,2}:\d{1,2}"


def cell_type_sql(v: str = "value") -> str:
    s = f"trim({v})"
    nc = f"replace({s}, ',', '')"
    d = f"TRY_CAST(replace({nc}, '_', '') AS DOUBLE)"
    return f"""CASE
      WHEN {v} IS NULL OR {v} = '' THEN 'STR'
      WHEN lower({s}) IN ('true','false','0','1','yes','no') THEN 'BOOLEAN'
      WHEN regexp_matches({nc}, '{NUMBER_RE}') OR regexp_matches({nc}, '{SPECIAL_RE}', 'i') THEN
        CASE WHEN NOT contains({s}, '.') AND isfinite({d}) AND {d} = floor({d}) THEN 'INT' ELSE 'FLOAT' END
      WHEN regexp_matches({s}, '{DATE_RE}') THEN 'DATE'
      WHEN regexp_matches({s}, '{TS_RE}') THEN 'TIMESTAMP'
      ELSE 'STR' END"""


def profile_ctes(table: str, key: str) -> str:
    """CTEs cells / typed / votes / stats / bad shared by the T-queries."""
    return f"""
cells AS ({cells_sql(table, key)}),
typed AS (SELECT *, {cell_type_sql()} AS data_type FROM cells),
votes AS (
  SELECT col_pos, column_name, data_type, count(*) AS votes, min(rn) AS first_rn,
         count(*) FILTER (WHERE value IS NULL OR value = '') AS blank_votes
  FROM typed GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY col_pos ORDER BY votes DESC, first_rn) AS r,
         sum(votes) OVER (PARTITION BY col_pos) AS n_cells,
         sum(blank_votes) OVER (PARTITION BY col_pos) AS n_blank
  FROM votes),
samples AS (
  SELECT col_pos, arg_min(value, rn) AS sample_value FROM cells
  WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY col_pos),
stats AS (
  SELECT r.col_pos, r.column_name, r.data_type,
         coalesce(s.sample_value, '') AS sample_value, r.n_cells,
         CAST((r.n_cells - r.n_blank) - (r.votes - r.blank_votes) AS BIGINT) AS inconsistent_count,
         CASE WHEN r.n_cells = 0 THEN 1.0
              ELSE 1.0 - CAST((r.n_cells - r.n_blank) - (r.votes - r.blank_votes) AS DOUBLE) / CAST(r.n_cells AS DOUBLE)
         END AS consistency_rate
  FROM ranked r LEFT JOIN samples s USING (col_pos) WHERE r.r = 1),
bad AS (
  SELECT t.col_pos, t.column_name, t.rn, t.value
  FROM typed t JOIN stats s USING (col_pos)
  WHERE NOT (t.value IS NULL OR t.value = '') AND t.data_type <> s.data_type)"""


def schema_table_sql(table: str, key: str) -> str:
    return f"""WITH {profile_ctes(table, key)},
capped AS (
  SELECT col_pos, string_agg(value, '|' ORDER BY rn) AS samples FROM (
    SELECT *, row_number() OVER (PARTITION BY col_pos ORDER BY rn) AS k FROM bad) WHERE k <= 10
  GROUP BY col_pos)
SELECT s.column_name AS COLUMN_ORIGIN_NAME, s.data_type AS DATA_TYPE, '' AS COLUMN_AFTER_NAME,
       '' AS DESCRIPTION, s.sample_value AS SAMPLE_DATA, s.consistency_rate AS CONSISTENCY_RATE,
       s.inconsistent_count AS INCONSISTENT_COUNT, coalesce(c.samples, '') AS INCONSISTENT_SAMPLES
FROM stats s LEFT JOIN capped c USING (col_pos)"""


ORACLE: dict[str, str] = {}


def register(key: str, sql: str) -> None:
    ORACLE[key] = sql.strip()


# ---- T1-T10 ---------------------------------------------------------------
register("cell_types", f"""
WITH cells AS ({cells_sql('events', 'event_id')})
SELECT column_name, rn, value, {cell_type_sql()} AS data_type FROM cells""")

register("type_votes", f"""
WITH {profile_ctes('orders', 'o_orderkey')}
SELECT column_name, data_type, votes, first_rn FROM votes""")

register("dominant_type", f"""
WITH {profile_ctes('orders', 'o_orderkey')}
SELECT column_name, data_type FROM stats""")

register("sample_value", f"""
WITH {profile_ctes('customer', 'c_custkey')}
SELECT column_name, sample_value FROM stats""")

register("consistency", f"""
WITH {profile_ctes('orders', 'o_orderkey')}
SELECT column_name, data_type, consistency_rate, inconsistent_count FROM stats""")

register("inconsistent_cells", f"""
WITH {profile_ctes('orders', 'o_orderkey')}
SELECT column_name, rn, value FROM bad""")

register("schema_table", schema_table_sql("orders", "o_orderkey"))

register("schema_table_pandas", schema_table_sql("events_gappy", "event_id"))

register("low_consistency", f"""
SELECT * FROM ({schema_table_sql('events_uneven', 'event_id')}) WHERE CONSISTENCY_RATE < 0.9""")

register("type_census", f"""
SELECT DATA_TYPE, count(*) AS n_columns FROM ({schema_table_sql('lineitem', 'l_orderkey * 8 + l_linenumber')})
GROUP BY DATA_TYPE""")

register("table_profile", f"""
WITH {profile_ctes('events', 'event_id')}
SELECT CAST(6 AS BIGINT) AS header_count, CAST(max(n_cells) AS BIGINT) AS record_count,
       count(*) FILTER (WHERE consistency_rate < 0.9) AS low_consistency_columns
FROM stats""")


# ---- P1-P5 ----------------------------------------------------------------
register("add_report_date", """
SELECT '2024-01-20' AS "日付", event_id, event_type FROM events""")

register("date_range", """
SELECT event_id, event_type FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")

register("date_range_yesterday", """
SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-20'""")

register("traffic_filter", """
SELECT event_id, value FROM events WHERE event_type = 'click'""")

register("preview", """
SELECT event_id + 1 AS rn, CAST(event_id AS VARCHAR) AS event_id,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(user_id AS VARCHAR) AS user_id, event_type,
       printf('%.2f', value) AS value, props
FROM events ORDER BY rn LIMIT 5""")

REPORT_RUNS = """
runs AS (
  SELECT event_id,
         CASE WHEN event_type IN ('view','click') THEN 'detailed_analysis'
              WHEN event_type = 'purchase' THEN 'cv_attribute'
              WHEN event_type = 'signup' THEN 'conversion_attribute'
              ELSE 'unknown' END AS report_type,
         event_type <> 'error' AS success
  FROM events)"""

register("report_dispatch", f"""
WITH {REPORT_RUNS}
SELECT event_id, CASE WHEN report_type = 'conversion_attribute' THEN 'cv_attribute' ELSE report_type END AS report_type,
       success
FROM runs WHERE report_type IN ('cv_attribute', 'conversion_attribute')""")

# ---- S4, A1-A6 ----------------------------------------------------------------
RESULTS = """
ev AS (
  SELECT *, 'suite' || (user_id % 7) || '_test_results::test_event_' || (event_id % 4000) AS test_key
  FROM events),
latest AS (
  SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY test_key ORDER BY event_id DESC) = 1),
res AS (
  SELECT test_key,
    CASE WHEN event_type IN ('error','click') THEN 'object' WHEN event_type = 'view' THEN 'boolean'
         WHEN event_type = 'purchase' THEN 'number' ELSE 'other' END AS kind,
    CASE WHEN event_type IN ('click','view') THEN true WHEN event_type = 'purchase' THEN value <> 0
         ELSE false END AS passed,
    CASE WHEN event_type = 'signup' THEN 'ERROR'
         WHEN event_type IN ('click','view') OR (event_type = 'purchase' AND value <> 0) THEN 'PASS'
         ELSE 'FAIL' END AS status,
    CASE WHEN event_type IN ('error','click') THEN event_type || ' check ' || event_id
         WHEN event_type IN ('view','purchase') THEN 'No description available'
         ELSE 'Invalid data type: <class ''str''>' END AS description,
    CASE WHEN event_type = 'click' THEN 'clicks'
         WHEN event_type = 'error' AND user_id % 10 <> 0 THEN 'cat' || (user_id % 10)
         ELSE 'その他' END AS category,
    CASE WHEN event_type IN ('error','click') AND event_id % 2 = 0 THEN 'src/suite/suite' || (user_id % 7) || '.py'
         ELSE '不明' END AS source_file,
    CASE WHEN event_type IN ('error','click') THEN test_key ELSE '不明' END AS method,
    CASE WHEN event_type IN ('error','click') THEN value ELSE 0.0 END AS execution_time,
    '不明' AS execution_timestamp
  FROM latest)"""

register("results_load", f"WITH {RESULTS} SELECT * FROM res")

register("results_files", """
SELECT CAST(event_id % 40 AS BIGINT) AS run, count(*) AS n_lines FROM events WHERE event_id % 5 <> 0 GROUP BY 1""")

register("result_status", f"WITH {RESULTS} SELECT test_key, kind, passed, status FROM res")

register("pass_stats", f"""
WITH {RESULTS}
SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed,
       count(*) - count(*) FILTER (WHERE passed) AS failed,
       CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0
            ELSE 0.0 END AS pass_rate
FROM res""")

register("category_rollup", f"""
WITH {RESULTS}
SELECT category, count(*) FILTER (WHERE passed) AS n_passed, count(*) AS n_total FROM res GROUP BY category""")

register("summary_listing", f"""
WITH {RESULTS},
named AS (
  SELECT *, string_split(test_key, '::') AS parts FROM res),
disp AS (
  SELECT *, CASE WHEN len(parts) > 1
                 THEN replace(replace(parts[1], '_test_results', ''), '_', ' ') || ' > ' || parts[-1]
                 ELSE parts[-1] END AS dn
  FROM named)
SELECT test_key, CASE WHEN length(dn) > 57 THEN substr(dn, 1, 54) || '...' ELSE dn END AS display_name,
       status, description
FROM disp""")

register("timing_stats", f"""
WITH {RESULTS}
SELECT coalesce(CAST(sum(CAST(execution_time AS DECIMAL(38,9))) AS DOUBLE), 0.0) AS total_time,
       coalesce(CAST(sum(CAST(execution_time AS DECIMAL(38,9))) AS DOUBLE) / CAST(count(execution_time) AS DOUBLE), 0.0)
         AS avg_time,
       coalesce(max(execution_time), 0.0) AS max_time,
       (SELECT test_key FROM res ORDER BY execution_time DESC, test_key LIMIT 1) AS longest_test
FROM res""")

register("outcome_summary", f"""
WITH {REPORT_RUNS}
SELECT count(*) AS total, count(*) FILTER (WHERE success) AS success,
       count(*) - count(*) FILTER (WHERE success) AS failure,
       (count(*) - count(*) FILTER (WHERE success)) = 0 AND count(*) > 0 AS ok
FROM runs""")


# ---- S3, R1-R3 ---------------------------------------------------------------
REGISTRY_ROWS = """
rrows AS (
  SELECT lower(p_type) AS "group",
         CASE WHEN p_partkey % 10 = 0 THEN 'navbar' WHEN p_partkey % 10 = 1 THEN 'apply_button'
              ELSE replace(p_name, ' ', '_') END AS name,
         CASE p_size % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'css' ELSE 'xpath' END AS selector_type,
         CASE WHEN p_partkey % 17 <> 0 THEN '#part-' || p_partkey END AS selector_value,
         CASE WHEN p_size % 5 <> 0 THEN p_brand END AS description,
         p_partkey AS pos
  FROM part),
registry AS (
  SELECT "group", name, selector_type, selector_value, coalesce(description, '') AS description
  FROM rrows QUALIFY row_number() OVER (PARTITION BY "group", name ORDER BY pos DESC) = 1)"""

register("registry_load", f"WITH {REGISTRY_ROWS} SELECT * FROM registry")

register("registry_lookup", f"""
WITH {REGISTRY_ROWS},
req AS (
  SELECT p_partkey AS request_id,
         CASE WHEN p_partkey % 13 = 0 THEN 'nogroup' ELSE lower(p_type) END AS "group",
         CASE WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', '_') || '_v2' ELSE replace(p_name, ' ', '_') END AS name
  FROM part)
SELECT q.request_id, q."group", q.name,
       CASE WHEN r.name IS NOT NULL THEN 'found'
            WHEN q."group" IN (SELECT "group" FROM registry) THEN 'no_name' ELSE 'no_group' END AS status,
       r.selector_type, r.selector_value, r.description
FROM req q LEFT JOIN registry r ON q."group" = r."group" AND q.name = r.name""")

register("registry_repair", f"""
WITH {REGISTRY_ROWS}
SELECT coalesce("group", '') AS "group", coalesce(name, '') AS name, coalesce(selector_type, '') AS selector_type,
       coalesce(selector_value, '') AS selector_value,
       CASE name WHEN 'navbar' THEN 'ナビゲーションバー' WHEN 'apply_button' THEN '適用ボタン'
                 ELSE coalesce(description, '') END AS description
FROM rrows""")

register("registry_report", """
WITH sel AS (
  SELECT lower(p_type) AS "group", replace(p_name, ' ', '_') || '_' || p_partkey AS name,
         CASE p_size % 4 WHEN 0 THEN 'button' WHEN 1 THEN 'a' WHEN 2 THEN 'input' ELSE 'select' END AS element_type,
         '#part-' || p_partkey AS css, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS category,
         p_partkey AS pos
  FROM part)
SELECT min(pos) OVER (PARTITION BY "group") AS group_first_pos, "group", pos,
       "group" || ',' || name || ',' || element_type || ',' || css || ',' || coalesce(category, '') AS line
FROM sel""")

# ---- D3-D11 -------------------------------------------------------------------
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}"
NL = "chr(10)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _list_items(x: str) -> str:
    items = f"regexp_extract_all({x}, '(?m)^(?:[-*•]|[\\p{{Nd}}]+\\.)[{WS}]*(.+)$', 1)"
    paras = f"list_filter(list_transform(string_split({x}, {NL} || {NL}), lambda p: {_strip('p')}), lambda p: p <> '')"
    return f"(CASE WHEN len({items}) > 0 THEN {items} ELSE {paras} END)"


register("list_items", f"""
WITH l AS (SELECT conv_id, turn, {_list_items('text')} AS items FROM conversations)
SELECT conv_id, turn, CAST(unnest(generate_series(1, len(items))) AS INTEGER) AS item_pos, unnest(items) AS item
FROM l WHERE len(items) > 0""")

ANALYSIS = f"""
a AS (
  SELECT conv_id, turn,
         '## Summary' || {NL} || text || {NL} || '## Risks' || {NL} || '- role ' || role || {NL} || '* turn ' || turn
         || {NL} || '## Suggestions' || {NL} || text AS text
  FROM conversations),
s AS (
  SELECT conv_id, turn,
         list_filter(list_transform(regexp_split_to_array(text, '(?m)#+[{WS}]*|^[\\p{{Nd}}]+\\.[{WS}]+'),
                                    lambda x: {_strip('x')}), lambda x: x <> '') AS secs
  FROM a)"""

register("sections", f"""
WITH {ANALYSIS}
SELECT conv_id, turn, coalesce(secs[1], '分析結果なし') AS summary,
       CASE WHEN len(secs) > 1 THEN array_to_string({_list_items('secs[2]')}, {NL}) ELSE '' END AS risks,
       CASE WHEN len(secs) > 2 THEN array_to_string({_list_items('secs[3]')}, {NL}) ELSE '' END AS suggestions
FROM s""")

register("code_blocks", f"""
WITH f AS (
  SELECT conv_id, turn,
         CASE WHEN turn % 2 = 0 THEN role || ':' || {NL} || '```python' || {NL} || text || {NL} || '```' || {NL}
                                     || 'end of ' || role
              ELSE text END AS text
  FROM conversations)
SELECT conv_id, turn,
       CASE WHEN regexp_matches(text, '(?s)```(?:[\\p{{L}}\\p{{N}}_]+)?\\n(.*?)```')
            THEN regexp_extract(text, '(?s)```(?:[\\p{{L}}\\p{{N}}_]+)?\\n(.*?)```', 1) ELSE text END AS code,
       {_strip("regexp_replace(text, '(?s)```.*?```', '', 'g')")} AS explanation
FROM f""")

register("review_url", """
WITH u AS (
  SELECT page_id,
         CASE WHEN page_id % 3 = 0
              THEN 'https://github.com/' || regexp_extract(url, '^https?://([^/]+)', 1) || '/repo' || page_id || '/pull/' || page_id
              WHEN page_id % 3 = 1
              THEN 'https://github.com/' || regexp_extract(url, '^https?://([^/]+)', 1) || '/pull/x' || page_id
              ELSE url END AS url
  FROM pages),
c AS (
  SELECT *, starts_with(url, 'https://github.com/') AND contains(url, '/pull/') AS is_pr,
         regexp_matches(url, '^https://github\\.com/([^/]+)/([^/]+)/pull/(\\p{Nd}+)') AS ok
  FROM u)
SELECT page_id, url,
       CASE WHEN is_pr AND ok THEN regexp_extract(url, '^https://github\\.com/([^/]+)/([^/]+)/pull/(\\p{Nd}+)', 1) END AS owner,
       CASE WHEN is_pr AND ok THEN regexp_extract(url, '^https://github\\.com/([^/]+)/([^/]+)/pull/(\\p{Nd}+)', 2) END AS repo,
       CASE WHEN is_pr AND ok THEN regexp_extract(url, '^https://github\\.com/([^/]+)/([^/]+)/pull/(\\p{Nd}+)', 3) END AS number,
       CASE WHEN NOT is_pr THEN 'URLはGitHubのプルリクエストURLである必要があります。'
            WHEN NOT ok THEN 'PRのURL形式が正しくありません。' END AS error
FROM c""")

EXT_LIST = ("'.py','.js','.ts','.html','.css','.java','.c','.cpp','.cs','.php','.rb','.go','.rs','.swift',"
            "'.kt','.sh','.bat','.ps1','.sql','.md','.json','.yml','.yaml','.xml','.txt','.PY'")
LANG_CASE = """CASE ext WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript'
  WHEN '.html' THEN 'HTML' WHEN '.css' THEN 'CSS' WHEN '.java' THEN 'Java' WHEN '.c' THEN 'C' WHEN '.cpp' THEN 'C++'
  WHEN '.cs' THEN 'C#' WHEN '.php' THEN 'PHP' WHEN '.rb' THEN 'Ruby' WHEN '.go' THEN 'Go' WHEN '.rs' THEN 'Rust'
  WHEN '.swift' THEN 'Swift' WHEN '.kt' THEN 'Kotlin' WHEN '.sh' THEN 'Shell' WHEN '.bat' THEN 'Batch'
  WHEN '.ps1' THEN 'PowerShell' WHEN '.sql' THEN 'SQL' WHEN '.md' THEN 'Markdown' WHEN '.json' THEN 'JSON'
  WHEN '.yml' THEN 'YAML' WHEN '.yaml' THEN 'YAML' WHEN '.xml' THEN 'XML' ELSE 'プログラミング' END"""
FILES = f"""
files AS (
  SELECT doc_id, source,
         source || '/file' || doc_id || ([{EXT_LIST}])[CAST((doc_id * 7 + n_chars) % 26 AS BIGINT) + 1] AS path
  FROM documents),
fx AS (SELECT *, lower(regexp_extract(path, '^\\.*[^.].*(\\.[^.]*)$', 1)) AS ext FROM files)"""

register("language_of", f"""
WITH {FILES}
SELECT doc_id, path, ext, {LANG_CASE} AS language FROM fx""")

register("main_language", f"""
WITH {FILES},
c AS (SELECT source, ext, count(*) AS n, min(doc_id) AS first_pos FROM fx GROUP BY source, ext),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_pos) AS r,
             sum(n) OVER (PARTITION BY source) AS n_files FROM c)
SELECT source, ext AS main_ext, CAST(n_files AS BIGINT) AS n_files, {LANG_CASE} AS language FROM b WHERE r = 1""")

register("file_slug", f"""
WITH n AS (
  SELECT conv_id, turn,
         regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_{WS}]', '', 'g'), '[{WS}]+', '_', 'g') AS name,
         CASE turn % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.go' ELSE '.txt' END AS ext
  FROM conversations)
SELECT conv_id, turn,
       CASE WHEN length(name) > 30 AND len(string_split(name, '_')) > 3
            THEN array_to_string(string_split(name, '_')[1:3], '_') ELSE name END || ext AS file_name
FROM n""")

register("truncate_text", """
SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '...(以下省略)' ELSE text END AS truncated,
       CAST(length(CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '...(以下省略)' ELSE text END) AS INTEGER) AS n
FROM documents""")

register("clean_message", """
WITH q AS (
  SELECT conv_id, turn,
         CASE turn % 3 WHEN 0 THEN '"コミットメッセージ: ' || text || '`' WHEN 1 THEN '''' || text || '''' ELSE text END AS text
  FROM conversations)
SELECT conv_id, turn,
       regexp_replace(regexp_replace(text, '^["''`]+|["''`]+$', '', 'g'), '^コミットメッセージ[:：][\\s]*', '') AS message
FROM q""")


# ---- D1-D2 --------------------------------------------------------------------
def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _scan_sql(docs_cte: str) -> str:
    from quarry.operators.textscan import PATTERNS
    branches = "\nUNION ALL\n".join(
        f"SELECT doc_id, text, {i} AS pattern_id, {_sql_str(cat)} AS type, "
        f"regexp_split_to_array(text, {_sql_str('(?i)' + p)}) AS pieces, "
        f"regexp_extract_all(text, {_sql_str('(?i)' + p)}) AS matches FROM docs"
        for i, (cat, p) in enumerate(PATTERNS))
    nl = "(length({0}) - length(replace({0}, chr(10), '')))"
    return f"""
docs AS ({docs_cte}),
per AS ({branches}),
ex AS (SELECT doc_id, text, pattern_id, type, pieces, matches,
              unnest(generate_series(1, len(matches))) AS k FROM per WHERE len(matches) > 0),
loc AS (
  SELECT doc_id, text, pattern_id, type, matches[k] AS match,
         sum({nl.format('pieces[k]')} + {nl.format('matches[k]')}) OVER
           (PARTITION BY doc_id, pattern_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         - {nl.format('matches[k]')} + 1 AS line
  FROM ex),
found AS (
  SELECT doc_id, pattern_id, type, CAST(line AS BIGINT) AS line, match,
         string_split(text, chr(10))[CAST(line AS BIGINT)] AS context
  FROM loc)"""


SECRET_DOCS = """
SELECT c_custkey AS doc_id,
  '# settings for ' || c_name || chr(10) ||
  CASE c_custkey % 6
    WHEN 0 THEN 'api_key =' || chr(10) || '  "' || md5(c_name) || '"' || chr(10) || 'mode = 1'
    WHEN 1 THEN 'password: "' || substr(md5(c_name), 1, 8) || '"' || chr(10) || 'pwd=''' || substr(md5(c_name || 'x'), 1, 6) || ''''
    WHEN 2 THEN 'Authorization: "Bearer ' || md5(c_name) || '"' || chr(10) || 'auth_token="' || md5(c_name || 'x') || '"'
    WHEN 3 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'private_key = ''' || md5(c_name) || '''' || chr(10)
                || 'OPENAI_API_KEY="' || md5(c_name || 'x') || '"'
    WHEN 4 THEN '-----BEGIN CERTIFICATE-----' || chr(10) || 'ssn '
                || printf('%03d-%02d-%04d', c_custkey % 1000, c_custkey % 100, (c_custkey * 7) % 10000)
                || chr(10) || 'access_key: ''' || md5(c_name || 'x') || ''''
    ELSE 'card ' || printf('%04d-%04d-%04d-%04d', c_custkey % 10000, (c_custkey * 3) % 10000, (c_custkey * 7) % 10000,
                           (c_custkey * 11) % 10000)
         || chr(10) || 'contact ' || lower(replace(c_name, '#', '.')) || '@example.com' || chr(10) || 'key sk-'
         || md5(c_name) || substr(md5(c_name || 'x'), 1, 16) || chr(10) || 'api-secret="' || md5(c_name) || '"'
  END || chr(10) || '# end' || chr(10) AS text
FROM customer"""

register("sensitive_scan", f"WITH {_scan_sql('SELECT doc_id, text FROM documents')} SELECT * FROM found")
register("sensitive_scan_rt", f"WITH {_scan_sql(SECRET_DOCS)} SELECT * FROM found")


def _summary_sql(docs_cte: str) -> str:
    return f"""WITH {_scan_sql(docs_cte)},
per_doc AS (
  SELECT doc_id,
         count(*) FILTER (WHERE type = 'APIキー') AS api_key, count(*) FILTER (WHERE type = 'パスワード') AS password,
         count(*) FILTER (WHERE type = '認証情報') AS auth, count(*) FILTER (WHERE type = '秘密鍵') AS private_key,
         count(*) FILTER (WHERE type = '証明書') AS certificate, count(*) FILTER (WHERE type = '個人識別情報') AS pii
  FROM found GROUP BY doc_id),
j AS (
  SELECT d.doc_id, coalesce(api_key, 0) AS api_key, coalesce(password, 0) AS password, coalesce(auth, 0) AS auth,
         coalesce(private_key, 0) AS private_key, coalesce(certificate, 0) AS certificate, coalesce(pii, 0) AS pii
  FROM docs d LEFT JOIN per_doc p USING (doc_id))
SELECT doc_id, api_key + password + auth + private_key + certificate + pii AS n_issues,
       api_key, password, auth, private_key, certificate, pii,
       (api_key + password + auth + private_key + certificate + pii) = 0 AS safe,
       CASE WHEN (api_key + password + auth + private_key + certificate + pii) > 0
            THEN (api_key + password + auth + private_key + certificate + pii) || '件の機密情報の漏洩リスクが検出されました。'
            ELSE '機密情報の漏洩リスクは検出されませんでした。' END AS message
FROM j"""


register("sensitive_summary", _summary_sql("SELECT doc_id, text FROM documents"))
register("sensitive_summary_rt", _summary_sql(SECRET_DOCS))


# ---- H1-H31 --------------------------------------------------------------------
def _unescape(x: str) -> str:
    """Decode the entities the pages use. Legacy entities (amp, lt, gt,
    quot, copy) may lack the semicolon, as HTML5 parsers accept."""
    out = x
    for ent, ch in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&copy;?", "©"),
                    ("&middot;", "·"), ("&nbsp;?", "' || chr(160) || '"), ("&amp;?", "&")):
        out = f"regexp_replace({out}, '{ent}', '{ch}', 'g')"
    return out


def _count(html: str, pat: str) -> str:
    return f"CAST(len(regexp_extract_all({html}, '{pat}')) AS BIGINT)"


CLEAN_HTML = ("regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), "
              "'(?s)<script([^>]*)>.*?</script>', '<script\\1></script>', 'g'), "
              "'(?s)<style([^>]*)>.*?</style>', '<style\\1></style>', 'g')")

register("page_summary", f"""
WITH p AS (SELECT page_id, url, {CLEAN_HTML} AS h FROM pages)
SELECT page_id, url, {_strip(_unescape("regexp_extract(h, '(?s)<title[^>]*>(.*?)</title>', 1)"))} AS title,
       {_count('h', '<[a-zA-Z][a-zA-Z0-9]*')} AS n_elements,
       {_count('h', '<a[\\s>]')} AS n_links, {_count('h', '<h[1-6][\\s>]')} AS n_headings,
       {_count('h', '<form[\\s>]')} AS n_forms, {_count('h', '<img[\\s>/]')} AS n_images,
       {_count('h', '<table[\\s>]')} AS n_tables
FROM p""")

CUSTOMER_PAGE = """
c AS (SELECT c_custkey AS page_id, CAST(c_custkey AS VARCHAR) AS k, c_custkey % 2 = 0 AS even,
             c_custkey % 3 = 0 AS by3, printf('%.2f', c_acctbal) AS bal, c_acctbal < 0 AS neg, *
      FROM customer)"""

register("page_summary_rt", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, 'https://shop.example.com/c/' || k AS url, c_name AS title,
       CAST(CASE WHEN neg THEN 44 ELSE 42 END AS BIGINT) AS n_elements, CAST(1 AS BIGINT) AS n_forms,
       CAST(2 AS BIGINT) AS n_buttons, CAST(4 AS BIGINT) AS n_links, CAST(5 AS BIGINT) AS n_inputs,
       CAST(CASE WHEN neg THEN 5 ELSE 0 END AS BIGINT) AS n_errors, CAST(1 AS BIGINT) AS n_headings,
       CAST(1 AS BIGINT) AS n_images, CAST(2 AS BIGINT) AS n_tables
FROM c""")

register("headings", f"""
WITH p AS (SELECT page_id, {CLEAN_HTML} AS h FROM pages),
x AS (SELECT page_id, regexp_extract_all(h, '(?s)<h([1-6])[^>]*>.*?</h[1-6]>', 1) AS lv,
             regexp_extract_all(h, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS tx FROM p),
u AS (SELECT page_id, unnest(lv) AS level, unnest(tx) AS t FROM x)
SELECT page_id, CAST(level AS INTEGER) AS level,
       CAST(row_number() OVER (PARTITION BY page_id, level ORDER BY 1) AS INTEGER) AS ordinal,
       {_strip(_unescape("regexp_replace(t, '<[^>]*>', '', 'g')"))} AS text
FROM u""")

register("forms", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, CASE WHEN even THEN 'f' || k ELSE 'unnamed_form_0' END AS form_id, '/save/' || k AS action,
       CASE WHEN even THEN 'POST' ELSE 'GET' END AS method
FROM c""")

register("form_inputs", f"""
WITH {CUSTOMER_PAGE},
f AS (SELECT page_id, k, CASE WHEN even THEN 'f' || k ELSE 'unnamed_form_0' END AS form_id FROM c)
SELECT page_id, form_id, 'text' AS type, 'name' AS name, 'name' || k AS id, 'Name' AS placeholder, true AS required FROM f
UNION ALL SELECT page_id, form_id, 'hidden', 'k', '', '', false FROM f
UNION ALL SELECT page_id, form_id, 'text', 'bal', '', '', false FROM f
UNION ALL SELECT page_id, form_id, 'select', 'seg', '', '', false FROM f
UNION ALL SELECT page_id, form_id, 'textarea', 'note', '', '', false FROM f
UNION ALL SELECT page_id, form_id, 'button', '', '', '', false FROM f""")

register("inputs", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, 'input' AS tag, 'text' AS type, 'name' AS name, '' AS value, 'Name' AS placeholder, true AS required,
       CAST(NULL AS BIGINT) AS n_options FROM c
UNION ALL SELECT page_id, 'input', 'text', 'bal', bal, '', false, NULL FROM c
UNION ALL SELECT page_id, 'select', 'select-one', 'seg', '', '', false, 3 FROM c
UNION ALL SELECT page_id, 'textarea', 'textarea', 'note', '', '', false, NULL FROM c
UNION ALL SELECT page_id, 'input', 'button', '', 'Cancel', '', false, NULL FROM c""")

register("buttons", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, 'a' AS tag, '' AS id, 'Home' AS text, 'link-button' AS type FROM c
UNION ALL SELECT page_id, 'button', 'submit' || k, 'Save', 'submit' FROM c
UNION ALL SELECT page_id, 'input', '', 'Cancel', 'button' FROM c
UNION ALL SELECT page_id, 'a', '', 'Go', 'link-button' FROM c
UNION ALL SELECT page_id, 'a', '', 'Act', 'link-button' FROM c""")

register("links", f"""
WITH p AS (SELECT page_id, url, {CLEAN_HTML} AS h FROM pages),
x AS (SELECT page_id, url, regexp_extract_all(h, '(?s)<a\\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1) AS hr,
             regexp_extract_all(h, '(?s)<a\\s[^>]*href="[^"]*"[^>]*>(.*?)</a>', 1) AS tx FROM p),
u AS (SELECT page_id, url, unnest(generate_series(1, len(hr))) AS ordinal, unnest(hr) AS href0, unnest(tx) AS t FROM x),
v AS (SELECT page_id, url, ordinal, {_unescape('href0')} AS href, t FROM u)
SELECT page_id, CAST(ordinal AS INTEGER) AS ordinal,
       {_strip(_unescape("regexp_replace(t, '<[^>]*>', '', 'g')"))} AS text, href,
       starts_with(href, 'http') OR starts_with(href, '//') AS is_external,
       (starts_with(href, 'http') OR starts_with(href, '//')) AND NOT starts_with(href, url) AS is_external_page
FROM v""")

register("links_rt", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, 1 AS ordinal, 'Home' AS text, '/home' AS href, '' AS title, '' AS target, false AS is_external,
       false AS is_external_page FROM c
UNION ALL SELECT page_id, 2, 'Ext ' || k, 'https://ext.example.com/c/' || k, '', '', true, true FROM c
UNION ALL SELECT page_id, 3, 'Go', '#', '', '', false, false FROM c""")

register("images", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, '/img/' || k || '.png' AS src, c_name AS alt, '' AS title, CAST(c_nationkey AS VARCHAR) AS width,
       '' AS height FROM c""")

register("meta_tags", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, 'segment' AS name, c_mktsegment AS content FROM c
UNION ALL SELECT page_id, 'og:id', k FROM c""")

register("html_tables", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, CASE WHEN by3 THEN 't' || k ELSE 'unnamed_table_0' END AS table_id, 'Key|Balance' AS headers,
       CAST(2 AS BIGINT) AS n_rows, CAST(2 AS BIGINT) AS n_columns FROM c
UNION ALL SELECT page_id, 'unnamed_table_1', '', 2, 3 FROM c""")

register("error_messages", f"""
WITH {CUSTOMER_PAGE}, s AS (SELECT unnest([1, 2, 4, 6]) AS selector)
SELECT page_id, selector, 'Error ' || k || ': invalid balance' AS text FROM c, s WHERE neg
UNION ALL SELECT page_id, 5, 'failed to save ' || k FROM c WHERE neg""")

register("login_error_message", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, 'failed to save ' || k AS message FROM c WHERE neg""")

register("interactive", f"""
WITH {CUSTOMER_PAGE},
e AS (SELECT page_id, unnest([
  {{'n': 'Home', 'tag': 'a', 'text': 'Home', 'type': 'a'}}, {{'n': 'Ext', 'tag': 'a', 'text': 'Ext ' || k, 'type': 'a'}},
  {{'n': 'Go', 'tag': 'a', 'text': 'Go', 'type': 'a'}}, {{'n': 'Act', 'tag': 'a', 'text': 'Act', 'type': 'a'}},
  {{'n': 'Save', 'tag': 'button', 'text': 'Save', 'type': 'submit'}},
  {{'n': 'Cancel', 'tag': 'input', 'text': 'Cancel', 'type': 'button'}},
  {{'n': 'name', 'tag': 'input', 'text': '', 'type': 'text'}}, {{'n': 'bal', 'tag': 'input', 'text': bal, 'type': 'text'}},
  {{'n': 'note', 'tag': 'textarea', 'text': '', 'type': 'textarea'}},
  {{'n': 'seg', 'tag': 'select', 'text': 'AB' || c_mktsegment, 'type': 'select-one'}}]) AS e FROM c),
m(lists, kind, selector, n) AS (VALUES
  ('browser', 'clickable', 0, 'Home'), ('browser', 'clickable', 0, 'Ext'), ('browser', 'clickable', 0, 'Go'),
  ('browser', 'clickable', 0, 'Act'), ('browser', 'clickable', 1, 'Save'), ('browser', 'clickable', 2, 'Cancel'),
  ('browser', 'clickable', 5, 'Act'), ('browser', 'clickable', 6, 'Home'), ('browser', 'clickable', 6, 'Go'),
  ('browser', 'input', 0, 'name'), ('browser', 'input', 0, 'bal'), ('browser', 'input', 0, 'Cancel'),
  ('browser', 'input', 1, 'note'), ('browser', 'input', 2, 'seg'),
  ('page_tool', 'clickable', 0, 'Home'), ('page_tool', 'clickable', 0, 'Ext'), ('page_tool', 'clickable', 0, 'Go'),
  ('page_tool', 'clickable', 0, 'Act'), ('page_tool', 'clickable', 1, 'Save'), ('page_tool', 'clickable', 2, 'Cancel'),
  ('page_tool', 'clickable', 4, 'Act'), ('page_tool', 'clickable', 5, 'Home'), ('page_tool', 'clickable', 5, 'Go'),
  ('page_tool', 'input', 0, 'name'), ('page_tool', 'input', 0, 'bal'), ('page_tool', 'input', 0, 'Cancel'),
  ('page_tool', 'input', 1, 'note'), ('page_tool', 'input', 2, 'seg'),
  ('page_analyzer', 'clickable', 0, 'Save'), ('page_analyzer', 'clickable', 1, 'Home'), ('page_analyzer', 'clickable', 1, 'Ext'),
  ('page_analyzer', 'clickable', 1, 'Go'), ('page_analyzer', 'clickable', 1, 'Act'), ('page_analyzer', 'clickable', 2, 'Cancel'),
  ('page_analyzer', 'clickable', 6, 'Home'), ('page_analyzer', 'clickable', 6, 'Go'), ('page_analyzer', 'clickable', 7, 'Act'),
  ('page_analyzer', 'input', 0, 'name'), ('page_analyzer', 'input', 8, 'note'), ('page_analyzer', 'input', 9, 'seg'))
SELECT m.lists, e.page_id, m.kind, m.selector, e.e.tag AS tag, e.e.text AS text, e.e.type AS type FROM e JOIN m ON e.e.n = m.n""")

register("text_search", f"""
WITH p AS (SELECT page_id, {CLEAN_HTML} AS h FROM pages),
x AS (
  SELECT page_id, 'a' AS tag, unnest(regexp_extract_all(h, '<a\\s[^>]*>([^<]*)</a>', 1)) AS t FROM p
  UNION ALL SELECT page_id, 'h1', unnest(regexp_extract_all(h, '<h1[^>]*>([^<]*)</h1>', 1)) FROM p
  UNION ALL SELECT page_id, 'title', unnest(regexp_extract_all(h, '<title[^>]*>([^<]*)</title>', 1)) FROM p
  UNION ALL SELECT page_id, 'div', unnest(regexp_extract_all(h, '<div[^>]*>([^<]*)</div>', 1)) FROM p)
SELECT page_id, tag, {_unescape('t')} AS own_text FROM x WHERE contains(lower({_unescape('t')}), 'th')""")

register("text_search_ancestor", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, 2 AS stage, 'main' AS tag FROM c WHERE neg""")

register("text_search_best", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, 1 AS stage, 'button' AS tag, 'Save' AS own_text FROM c""")

# every element of the rendered page: id, else a class set that no other element holds, else
# up to four levels that stop at an ancestor's id
register("css_selector", f"""
WITH {CUSTOMER_PAGE},
f AS (SELECT *, CASE WHEN even THEN '#f' || k ELSE 'body > main > form' END AS fp,
             CASE WHEN even THEN '#f' || k ELSE 'main > form' END AS fq,
             CASE WHEN by3 THEN '#t' || k ELSE 'body > main > table' END AS tp,
             CASE WHEN by3 THEN '#t' || k ELSE 'main > table' END AS tq FROM c),
e AS (SELECT page_id, unnest([
  ['html', 'html'], ['head', 'html > head'], ['meta', 'html > head > meta'], ['title', 'html > head > title'],
  ['meta', 'html > head > meta:nth-child(2)'], ['meta', 'html > head > meta:nth-child(3)'],
  ['meta', 'html > head > meta:nth-child(4)'], ['body', 'html > body'], ['header', '.navbar.top'], ['a', '.btn.nav-link'],
  ['div', '#sidebar'], ['a', '#sidebar > a'], ['main', '.content'], ['h2', 'html > body > main > h2'],
  ['form', CASE WHEN even THEN '#f' || k ELSE 'html > body > main > form' END], ['input', '#name' || k],
  ['input', fp || ' > input:nth-child(2)'], ['input', fp || ' > input:nth-child(3)'], ['select', fp || ' > select'],
  ['option', fq || ' > select > option'], ['option', fq || ' > select > option:nth-child(2)'],
  ['option', fq || ' > select > option:nth-child(3)'], ['textarea', fp || ' > textarea'], ['button', '#submit' || k],
  ['input', fp || ' > input:nth-child(4)'], ['table', CASE WHEN by3 THEN '#t' || k ELSE 'html > body > main > table' END],
  ['tr', tp || ' > tr'], ['th', tq || ' > tr > th'], ['th', tq || ' > tr > th:nth-child(2)'], ['tr', tp || ' > tr:nth-child(2)'],
  ['td', tq || ' > tr:nth-child(2) > td'], ['td', tq || ' > tr:nth-child(2) > td:nth-child(2)'],
  ['table', 'html > body > main > table:nth-child(2)'], ['tr', 'body > main > table:nth-child(2) > tr'],
  ['td', 'main > table:nth-child(2) > tr > td'], ['td', 'main > table:nth-child(2) > tr > td:nth-child(2)'],
  ['td', 'main > table:nth-child(2) > tr > td:nth-child(3)'], ['tr', 'body > main > table:nth-child(2) > tr:nth-child(2)'],
  ['td', 'main > table:nth-child(2) > tr:nth-child(2) > td'], ['img', 'html > body > main > img'],
  ['a', 'html > body > main > a'], ['a', 'html > body > main > a:nth-child(2)']]) AS e FROM f
  UNION ALL SELECT page_id, unnest([['div', '.alert.alert-danger'], ['p', '.error-message']]) FROM f WHERE neg)
SELECT page_id, e[1] AS tag, e[2] AS css FROM e""")

NAV_LINKS = f"""
p AS (SELECT page_id, {CLEAN_HTML} AS h FROM pages),
x AS (SELECT page_id, regexp_extract_all(h, '<a\\s[^>]*>([^<]*)</a>', 1) AS tx FROM p),
u AS (SELECT page_id, unnest(generate_series(1, len(tx))) AS k, unnest(tx) AS t FROM x),
n AS (SELECT page_id, k, {_unescape('t')} AS t,
             'html/body/nav/ul/li' || CASE WHEN k > 1 THEN '[' || k || ']' ELSE '' END || '/a' AS steps FROM u)"""

register("dedup_elements", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, 'clickable' AS kind, 0 AS selector, '/html/body/header/a' AS xpath, 'a' AS tag, 'Home' AS text FROM c
UNION ALL SELECT page_id, 'clickable', 0, '/html/body/div/a', 'a', 'Ext ' || k FROM c
UNION ALL SELECT page_id, 'clickable', 0, '/html/body/main/a', 'a', 'Go' FROM c
UNION ALL SELECT page_id, 'clickable', 0, '/html/body/main/a[2]', 'a', 'Act' FROM c
UNION ALL SELECT page_id, 'clickable', 1, '//*[@id=''submit' || k || ''']', 'button', 'Save' FROM c
UNION ALL SELECT page_id, 'clickable', 2, '/html/body/main/form/input[4]', 'input', 'Cancel' FROM c
UNION ALL SELECT page_id, 'input', 0, '//*[@id=''name' || k || ''']', 'input', '' FROM c
UNION ALL SELECT page_id, 'input', 0, '/html/body/main/form/input[3]', 'input', bal FROM c
UNION ALL SELECT page_id, 'input', 0, '/html/body/main/form/input[4]', 'input', 'Cancel' FROM c
UNION ALL SELECT page_id, 'input', 1, '/html/body/main/form/textarea', 'textarea', '' FROM c
UNION ALL SELECT page_id, 'input', 2, '/html/body/main/form/select', 'select', 'AB' || c_mktsegment FROM c""")

register("data_attributes", f"""
WITH {CUSTOMER_PAGE} SELECT page_id, 'track_id' AS key, k AS value FROM c""")

register("page_structure", f"""
WITH {CUSTOMER_PAGE}
SELECT page_id, 'top_bar' AS region, 'header' AS tag FROM c
UNION ALL SELECT page_id, 'side_bar', 'div' FROM c
UNION ALL SELECT page_id, 'main_content', 'main' FROM c""")

register("page_slug", """
WITH u AS (
  SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS (SELECT *, regexp_replace(replace(regexp_replace(path, '^/+|/+$', '', 'g'), '/', '_'), '[^\\p{L}\\p{N}_.-]', '', 'g') AS part
      FROM u)
SELECT page_id, CASE WHEN path <> '' AND path <> '/' AND part <> '' THEN netloc || '_' || substr(part, 1, 30)
                     ELSE netloc END AS slug
FROM v""")


def _text_len(h: str) -> str:
    body = f"regexp_replace(regexp_extract({h}, '(?s)<body[^>]*>(.*)', 1), '(?s)</body>.*', '')"
    stripped = (f"regexp_replace(regexp_replace(regexp_replace({body}, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), "
                f"'(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')")
    return f"CAST(length({_unescape(stripped)}) AS BIGINT)"


register("page_changes", f"""
WITH a AS (SELECT url, html, {CLEAN_HTML} AS h FROM pages),
b0 AS (SELECT page_id, url,
              CASE page_id % 3 WHEN 0 THEN html
                   WHEN 1 THEN replace(html, '</article>', '<p>An added paragraph that is long enough.</p></article>')
                   ELSE replace(html, '<footer>', '<div><span>a</span><span>b</span><span>c</span><span>d</span><span>e</span><span>f</span></div><footer>')
              END AS html FROM pages),
b AS (SELECT url, html, {CLEAN_HTML} AS h FROM b0),
m AS (
  SELECT a.url, a.html <> b.html AS source_changed,
         {_count('b.h', '<[a-zA-Z][a-zA-Z0-9]*')} - {_count('a.h', '<[a-zA-Z][a-zA-Z0-9]*')} AS d_elements,
         {_text_len('b.h')} - {_text_len('a.h')} AS d_text
  FROM a JOIN b USING (url))
SELECT url, source_changed, d_elements, d_text,
       source_changed OR abs(d_elements) > 5 OR abs(d_text) > 20 AS changed
FROM m""")

register("alert_kind", """
SELECT conv_id, turn,
       CASE WHEN contains(text, '?') OR contains(text, '確認') OR contains(lower(text), 'confirm') THEN 'confirm'
            WHEN contains(text, '入力') OR contains(text, 'プロンプト') OR contains(lower(text), 'prompt') THEN 'prompt'
            ELSE 'alert' END AS kind
FROM conversations""")


# ---- S1-S9, ST1 -------------------------------------------------------------------
register("read_report_csv", """
SELECT CAST(row_number() OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) AS BIGINT) AS rn,
       CAST(o_orderkey // 4096 AS BIGINT) AS part,
       CAST(o_orderkey AS VARCHAR) AS "注文番号", CAST(o_custkey AS VARCHAR) AS "顧客番号", o_orderstatus AS "状態",
       printf('%.2f', o_totalprice) AS "金額", strftime(o_orderdate, '%Y-%m-%d') AS "注文日",
       o_orderpriority AS "優先度"
FROM orders""")

register("read_report_notes", """
SELECT row_number() OVER (PARTITION BY conv_id // 64 ORDER BY conv_id, turn) AS rn, CAST(conv_id // 64 AS BIGINT) AS part,
       CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, nullif(text, '') AS text
FROM conversations""")

register("read_report_headers", f"""
SELECT row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS rn, CAST(p_partkey // 50 AS BIGINT) AS part,
       CAST(p_partkey AS VARCHAR) AS "key", p_name AS name, p_brand AS brand, p_type AS kind, CAST(p_size AS VARCHAR) AS size,
       {", ".join(f"CASE WHEN p_partkey // 50 % 6 = {v} THEN 'v{v}-' || p_partkey END AS x{v}" for v in range(6))}
FROM part""")

register("report_target", f"""
WITH {REPORT_RUNS}
SELECT event_id, '20240121_ebis_' ||
       CASE WHEN report_type = 'detailed_analysis' THEN 'detailed_report'
            WHEN report_type IN ('cv_attribute', 'conversion_attribute') THEN 'conversion_attribute'
            ELSE report_type || '_report' END || '.csv' AS target
FROM runs""")

register("registry_csv", ORACLE["registry_load"])

register("schema_document", f"""
WITH t AS ({schema_table_sql("orders", "o_orderkey").replace("SELECT s.column_name AS", "SELECT CAST(s.col_pos - (SELECT min(col_pos) FROM stats) AS INTEGER) AS pos, s.column_name AS")})
SELECT *, COLUMN_ORIGIN_NAME AS result_column, DATA_TYPE AS result_type, CONSISTENCY_RATE AS result_rate, INCONSISTENT_COUNT AS result_count FROM t""")

register("read_report_auto", """
SELECT row_number() OVER (PARTITION BY c_custkey // 36 ORDER BY c_custkey) AS rn, CAST(c_custkey // 36 AS BIGINT) AS part,
       CAST(c_custkey AS VARCHAR) AS "番号",
       CASE WHEN c_custkey % 36 >= 20 THEN '顧客' || c_custkey ELSE c_name END AS "氏名", c_mktsegment AS seg,
       CASE WHEN c_custkey // 72 % 2 = 1 THEN 'K' || c_nationkey END AS "区分"
FROM customer""")

register("report_schema_table", schema_table_sql("orders_report", "o_orderkey"))

register("stream_arrivals", """
SELECT '2024-01-20' AS "日付", CAST(o_orderkey AS VARCHAR) AS "注文番号", CAST(o_custkey AS VARCHAR) AS "顧客番号",
       o_orderstatus AS "状態", printf('%.2f', o_totalprice) AS "金額", strftime(o_orderdate, '%Y-%m-%d') AS "注文日",
       o_orderpriority AS "優先度"
FROM orders""")

register("stream_landing", ORACLE["stream_arrivals"])

# ---- selector oracles on the rendered customer pages -----------------------------------
register("category_summary", f"""
WITH {CUSTOMER_PAGE},
labels AS (SELECT * FROM (VALUES (0, 'トップバー'), (1, 'サイドバー'), (2, 'ナビゲーションバー'), (3, 'サブメニュー'),
                                 (4, 'テーブル'), (5, 'フォーム'), (6, 'ボタン'), (7, 'リンク'), (8, 'コンテンツ本体'),
                                 (9, 'その他')) t(pos, category)),
counts AS (
  SELECT 'ナビゲーションバー' AS category, 2 * count(*) AS n FROM c
  UNION ALL SELECT 'サイドバー', count(*) FROM c
  UNION ALL SELECT 'リンク', 2 * count(*) FROM c
  UNION ALL SELECT 'ボタン', 2 * count(*) FROM c
  UNION ALL SELECT 'その他', sum(CASE WHEN neg THEN 37 ELSE 35 END) FROM c)
SELECT CAST(l.pos AS INTEGER) AS pos, l.category, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM labels l LEFT JOIN counts USING (category)""")

register("selector_table", f"""
WITH {CUSTOMER_PAGE}, f AS (SELECT *, CASE WHEN even THEN '#f' || k ELSE 'body > main > form' END AS fp FROM c)
SELECT page_id, 'clickable_1' AS name, 'Home' AS text_value, '' AS id, 'btn nav-link' AS class, '.btn.nav-link' AS css,
       '/html/body/header/a' AS xpath, 'クリック可能' AS element_type, 'ナビゲーションバー' AS category, '{{}}' AS data FROM f
UNION ALL SELECT page_id, 'clickable_2', 'Ext ' || k, '', '', '#sidebar > a', '/html/body/div/a', 'クリック可能', 'リンク',
       '{{"track_id":"' || k || '"}}' FROM f
UNION ALL SELECT page_id, 'clickable_3', 'Go', '', 'btn', 'html > body > main > a', '/html/body/main/a', 'クリック可能', 'ボタン', '{{}}' FROM f
UNION ALL SELECT page_id, 'clickable_4', 'Act', '', '', 'html > body > main > a:nth-child(2)', '/html/body/main/a[2]',
       'クリック可能', 'リンク', '{{}}' FROM f
UNION ALL SELECT page_id, 'clickable_5', 'Save', 'submit' || k, '', '#submit' || k, '//*[@id=''submit' || k || ''']',
       'クリック可能', 'ボタン', '{{}}' FROM f
UNION ALL SELECT page_id, 'clickable_6', 'Cancel', '', '', fp || ' > input:nth-child(4)', '/html/body/main/form/input[4]',
       'クリック可能', 'その他', '{{}}' FROM f
UNION ALL SELECT page_id, 'input_1', 'Name', 'name' || k, '', '#name' || k, '//*[@id=''name' || k || ''']', '入力フィールド', 'フォーム', '{{}}' FROM f
UNION ALL SELECT page_id, 'input_2', bal, '', '', fp || ' > input:nth-child(3)', '/html/body/main/form/input[3]', '入力フィールド', 'フォーム', '{{}}' FROM f
UNION ALL SELECT page_id, 'input_3', 'Cancel', '', '', fp || ' > input:nth-child(4)', '/html/body/main/form/input[4]', '入力フィールド', 'フォーム', '{{}}' FROM f
UNION ALL SELECT page_id, 'input_4', '', '', '', fp || ' > textarea', '/html/body/main/form/textarea', '入力フィールド', 'フォーム', '{{}}' FROM f
UNION ALL SELECT page_id, 'input_5', '', '', '', fp || ' > select', '/html/body/main/form/select', '入力フィールド', 'フォーム', '{{}}' FROM f""")

ORDER_PARTS = "(SELECT DISTINCT CAST(o_orderkey // 4096 AS BIGINT) AS part FROM orders)"

register("file_encoding", f"""
SELECT e.written, e.written AS encoding FROM {ORDER_PARTS} p, (VALUES ('utf-8'), ('cp932'), ('euc_jp')) e(written)""")

# the second landing is longer by its junk line; an empty newest file gives way to it, two of them to nothing
register("latest_file", """
SELECT CAST(o_orderkey // 4096 AS BIGINT) AS part,
       CAST(strlen('ダミー1,ダミー2,ダミー3') + 1 + strlen('注文番号,顧客番号,状態,金額,注文日,優先度') + 1 + sum(strlen(concat_ws(',',
            CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, printf('%.2f', o_totalprice),
            strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority)) + 1) AS BIGINT) AS length
FROM orders WHERE o_orderkey // 4096 % 3 <> 1 GROUP BY 1""")

register("new_files", f"SELECT part FROM {ORDER_PARTS}")

register("stream_page_changes", """
SELECT url, CAST(1 AS BIGINT) AS snapshot, false AS source_changed, CAST(0 AS BIGINT) AS d_elements,
       CAST(0 AS BIGINT) AS d_text, true AS changed, true AS first_seen FROM pages
UNION ALL
SELECT url, 2, source_changed, d_elements, d_text, changed, false FROM (""" + ORACLE["page_changes"] + """) WHERE changed""")

MAIN = "html > body:nth-child(2) > main:nth-child(3).content"
register("element_counts", f"""
WITH p AS (SELECT page_id, {CLEAN_HTML} AS h FROM pages),
t AS (SELECT page_id, lower(unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM p)
SELECT page_id, tag, count(*) AS n FROM t GROUP BY page_id, tag""")

register("selector_export", f"""
WITH {CUSTOMER_PAGE}, f AS (SELECT *, CASE WHEN even THEN '#f' || k ELSE 'body > main > form' END AS fp FROM c),
r AS (
SELECT page_id, 'clickable_1' AS name, 'Home' AS text_value, '' AS id, 'btn nav-link' AS class, '.btn.nav-link' AS css,
       '/html/body/header/a' AS xpath, '//*/html/body/header/a' AS full_xpath, 'クリック可能' AS element_type,
       'ナビゲーションバー' AS category, '' AS track_id FROM f
UNION ALL SELECT page_id, 'clickable_2', 'Ext ' || k, '', '', '#sidebar > a', '/html/body/div/a', '//*/html/body/div/a',
       'クリック可能', 'リンク', k FROM f
UNION ALL SELECT page_id, 'clickable_3', 'Go', '', 'btn', 'html > body > main > a', '/html/body/main/a', '//*/html/body/main/a',
       'クリック可能', 'ボタン', '' FROM f
UNION ALL SELECT page_id, 'clickable_4', 'Act', '', '', 'html > body > main > a:nth-child(2)', '/html/body/main/a[2]',
       '//*/html/body/main/a[2]', 'クリック可能', 'リンク', '' FROM f
UNION ALL SELECT page_id, 'clickable_5', 'Save', 'submit' || k, '', '#submit' || k, '//*[@id=''submit' || k || ''']',
       '//*/html/body/main/form/button', 'クリック可能', 'ボタン', '' FROM f
UNION ALL SELECT page_id, 'clickable_6', 'Cancel', '', '', fp || ' > input:nth-child(4)', '/html/body/main/form/input[4]',
       '//*/html/body/main/form/input[4]', 'クリック可能', 'その他', '' FROM f
UNION ALL SELECT page_id, 'input_1', 'Name', 'name' || k, '', '#name' || k, '//*[@id=''name' || k || ''']',
       '//*/html/body/main/form/input', '入力フィールド', 'フォーム', '' FROM f
UNION ALL SELECT page_id, 'input_2', bal, '', '', fp || ' > input:nth-child(3)', '/html/body/main/form/input[3]',
       '//*/html/body/main/form/input[3]', '入力フィールド', 'フォーム', '' FROM f
UNION ALL SELECT page_id, 'input_3', 'Cancel', '', '', fp || ' > input:nth-child(4)', '/html/body/main/form/input[4]',
       '//*/html/body/main/form/input[4]', '入力フィールド', 'フォーム', '' FROM f
UNION ALL SELECT page_id, 'input_4', '', '', '', fp || ' > textarea', '/html/body/main/form/textarea',
       '//*/html/body/main/form/textarea', '入力フィールド', 'フォーム', '' FROM f
UNION ALL SELECT page_id, 'input_5', '', '', '', fp || ' > select', '/html/body/main/form/select',
       '//*/html/body/main/form/select', '入力フィールド', 'フォーム', '' FROM f)
SELECT 'detailed_analysis' AS "group", name, text_value, id, class, css, xpath, full_xpath, element_type, category, track_id
FROM r""")

# ---- whole element tables and selectors ------------------------------------------------
for _name, _sql in {**rendered_queries(CUSTOMER_PAGE), **parsed_queries(CLEAN_HTML, _unescape)}.items():
    if _name != "css_selector":  # has its own SQL above
        register(_name, _sql)
        if _name not in ("elements_compact", "element_paths"):
            register(f"{_name}_all", _sql)
for _name in ("schema_document", "latest_file"):
    register(f"{_name}_all", ORACLE[_name])
