"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; *sql* is its oracle, None where SQL cannot say it."""
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return register


DELIVERY_DESC = ", ".join(f"{c} DESC" for c in (
    "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))

#: Common table expressions over the driver tables, in order of dependency.
#: They compute from the source columns and never build or parse JSON.
VIEWS = {
    "traits": """traits(group_ord, group_name, trait_ord, trait_name, scale_type, unit, shard_no) AS (VALUES
  (1, 'whole', 1, 'quantity', 'quantitative', 'cm', 1),
  (2, 'leaf', 1, 'flag', 'nominal', NULL, 2),
  (2, 'leaf', 2, 'status', 'nominal', NULL, 2),
  (2, 'leaf', 3, 'length', 'quantitative', 'mm', 2),
  (3, 'stem', 1, 'discount', 'ordinal', NULL, 3),
  (3, 'stem', 2, 'length', 'quantitative', 'mm', 3))""",
    "delivery": """delivery AS (
  SELECT 's' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS line_id, l_linenumber AS run_no, s.shard_no,
    'shard_0' || s.shard_no AS shard_id,
    's' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '__shard_0' || s.shard_no AS custom_id,
    (l_partkey + s.shard_no) % 41 = 0 AS failed, (l_partkey + s.shard_no) % 43 = 0 AS cut,
    CASE WHEN l_partkey % 3 = 0 THEN 'partial' ELSE 'fresh' END AS source,
    CASE WHEN l_suppkey % 2 = 0 THEN 'overloaded_error' ELSE 'error' END || ': try later ' || s.shard_no AS error_text,
    30000 + l_partkey % 1000 AS input_tokens, CAST(100 + l_quantity AS BIGINT) AS output_tokens,
    CASE WHEN l_partkey % 4 <> 0 THEN l_suppkey * 10 END AS cached_tokens,
    'view ' || repeat('a', CAST(l_quantity AS INTEGER) % 20) AS rationale, l.*
  FROM lineitem l, (VALUES (1), (2), (3)) s(shard_no))""",
    "newest": f"""newest AS (
  SELECT * FROM delivery WHERE NOT failed AND NOT cut
  QUALIFY row_number() OVER (PARTITION BY run_no, line_id, shard_no
    ORDER BY (source = 'fresh') DESC, {DELIVERY_DESC}) = 1)""",
    "long": """long AS (
  SELECT n.run_no, n.line_id, n.shard_id, t.group_ord, t.trait_ord, t.group_name, t.trait_name, t.scale_type, t.unit, n.rationale,
    CASE WHEN (n.l_suppkey + 3 * t.group_ord + t.trait_ord) % 17 = 0 THEN 'not_assessable'
      WHEN t.trait_name = 'quantity' THEN CASE WHEN n.l_partkey % 31 = 0 THEN 'about 5'
        ELSE CAST(CAST(n.l_quantity AS INTEGER) AS VARCHAR) END
      WHEN t.trait_name = 'flag' THEN n.l_returnflag
      WHEN t.trait_name = 'status' THEN n.l_linestatus
      WHEN t.group_name = 'leaf' THEN CASE WHEN n.l_partkey % 47 <> 0
        THEN CAST(CAST(round(n.l_tax * 100) AS INTEGER) AS VARCHAR) END
      WHEN t.trait_name = 'discount' THEN CASE WHEN n.l_partkey % 29 = 0 THEN '99'
        ELSE CAST(CAST(round(n.l_discount * 100) AS INTEGER) AS VARCHAR) END
      ELSE CAST(CAST(n.l_quantity % 7 AS INTEGER) AS VARCHAR) END AS raw
  FROM newest n JOIN traits t ON t.shard_no = n.shard_no
  WHERE NOT (t.trait_name = 'status' AND n.l_partkey % 37 = 0))""",
    "merged": """merged AS (
  SELECT *, CASE WHEN scale_type = 'quantitative' THEN TRY_CAST(raw AS DOUBLE) END AS num FROM long)""",
    "run_line": """run_line AS (
  SELECT DISTINCT l_linenumber AS run_no, 's' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS line_id FROM lineitem)""",
    "gap": """gap AS (
  SELECT r.run_no, r.line_id, t.group_ord, t.trait_ord, t.group_name, t.trait_name
  FROM run_line r CROSS JOIN traits t
  WHERE NOT EXISTS (SELECT 1 FROM long o WHERE o.run_no = r.run_no AND o.line_id = r.line_id
    AND o.group_name = t.group_name AND o.trait_name = t.trait_name))""",
    "err": f"""err AS (
  SELECT run_no, line_id, shard_id || ': ' || CASE WHEN failed THEN error_text ELSE 'JSON parse failed' END AS error
  FROM delivery WHERE (failed OR cut) AND source = 'fresh'
  QUALIFY row_number() OVER (PARTITION BY run_no, line_id, shard_no ORDER BY {DELIVERY_DESC}) = 1)""",
    "leaf": """leaf AS (
  SELECT run_no, line_id, shard_id, group_name, trait_name, scale_type, raw, TRUE AS declared FROM long
  UNION ALL
  SELECT run_no, line_id, shard_id, 'leaf', 'extra', 'nominal', 'seen', FALSE FROM newest
  WHERE shard_no = 2 AND l_partkey % 13 = 0)""",
    "typed": """typed AS (
  SELECT *,
    CASE WHEN scale_type = 'quantitative' AND raw <> 'not_assessable' THEN TRY_CAST(raw AS DOUBLE) END AS num,
    CASE WHEN raw = 'not_assessable' OR scale_type = 'quantitative' THEN NULL
      WHEN scale_type = 'ordinal' THEN CASE WHEN CAST(raw AS INTEGER) <= 10 THEN 'd' || lpad(raw, 2, '0') END
      ELSE raw END AS text
  FROM leaf)""",
    "run_info": """run_info AS (
  SELECT DISTINCT run_no, line_id,
    CASE WHEN run_no = 5 THEN 'beta' WHEN run_no <= 6 THEN 'alpha' END AS provider,
    CASE WHEN run_no IN (3, 4) THEN 'm-2' WHEN run_no <= 6 THEN 'm-1' END AS model,
    CASE WHEN run_no <= 5 THEN 'v1' END AS schema_version
  FROM run_line)""",
    "prog": """prog AS (
  SELECT 's' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS line_id, event_id AS i, ts,
    'shard_0' || (event_id % 3 + 1) AS shard_id,
    CASE event_type WHEN 'error' THEN 'api error' WHEN 'view' THEN 'skip (cached)' ELSE 'ok' END AS status,
    value AS wall_seconds, 1000 AS prompt_tokens,
    CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS cached_tokens
  FROM events)""",
    "called": """called AS (
  SELECT *, CASE WHEN status = 'skip (cached)' THEN NULL
    WHEN row_number() OVER (PARTITION BY line_id, status = 'skip (cached)' ORDER BY ts, i) = 1 THEN 'cold'
    ELSE 'warm' END AS call_class FROM prog)""",
    "samp": """samp AS (
  SELECT 's' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS host, ts, value AS gauge, event_id % 997 AS errors_total
  FROM events)""",
    "doc": """doc AS (
  SELECT p_partkey AS doc_id, p_partkey AS p, p_size, p_name, CAST(2 + p_size % 8 AS INTEGER) AS k,
    CAST(3 + p_size % 6 AS INTEGER) AS m FROM part WHERE p_partkey % 50 > 2)""",
    "part_doc": """part_doc AS (
  SELECT p_partkey AS doc_id, p_partkey AS p, p_size, p_name, CAST(2 + p_size % 8 AS INTEGER) AS k,
    CAST(3 + p_size % 6 AS INTEGER) AS m FROM part)""",
    "tr": """tr AS (
  SELECT doc_id, p, k, m, p_name, x.group_ord, x.trait_ord, x.group_name,
    CASE WHEN x.trait_name = '?' THEN CASE WHEN p % 3 = 2 THEN 'Girth Size' ELSE 'length' END ELSE x.trait_name END AS trait_name,
    x.scale_type,
    CASE WHEN x.trait_name = 'spread' THEN CASE p_size % 5 WHEN 0 THEN 'cm' WHEN 1 THEN 'm²' WHEN 2 THEN '%' WHEN 3 THEN ' mm / Day ' END
      WHEN x.trait_name = '?' THEN CASE WHEN p % 3 = 0 THEN 'mm' ELSE 'cm' END
      WHEN x.trait_name = 'length' THEN 'cm' END AS unit,
    CASE x.trait_name WHEN 'form' THEN k WHEN 'hue' THEN 3 WHEN 'vigor' THEN m END AS n_values
  FROM doc, (VALUES (1, 1, 'whole', 'spread', 'quantitative'), (1, 2, 'whole', 'form', 'nominal'),
    (2, 1, 'leaf', 'hue', 'nominal'), (2, 2, 'leaf', 'length', 'quantitative'),
    (3, 1, 'stem', 'vigor', 'ordinal'), (3, 2, 'stem', '?', 'quantitative'))
    x(group_ord, trait_ord, group_name, trait_name, scale_type))""",
    "placed": """placed AS (
  SELECT doc_id, p, x.group_name,
    CASE WHEN x.trait_name = '?' THEN CASE WHEN p % 3 = 2 THEN 'Girth Size' ELSE 'length' END ELSE x.trait_name END AS trait_name
  FROM part_doc, (VALUES ('whole', 'spread', 1), ('whole', 'form', 1), ('leaf', 'hue', 1), ('leaf', 'length', 1),
    ('leaf', 'extra_code', 8), ('leaf', 'extra_name', 8), ('stem', 'vigor', -14), ('stem', '?', 1), ('whole', 'spread', 15))
    x(group_name, trait_name, every)
  WHERE CASE WHEN every > 0 THEN p % every = 0 ELSE p % -every <> 0 END)""",
}
NEEDS = {
    "newest": ["delivery"], "long": ["traits", "newest"], "merged": ["long"], "gap": ["traits", "long", "run_line"],
    "err": ["delivery"], "leaf": ["long"], "typed": ["leaf"], "run_info": ["run_line"], "called": ["prog"],
    "tr": ["doc"], "placed": ["part_doc"],
}


def over(views: str, body: str, recursive: bool = False) -> str:
    """The query *body* with the named views and all they need in front."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        wanted.add(name)
    for name in views.split():
        add(name)
    parts = [text for name, text in VIEWS.items() if name in wanted]
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body.startswith("+"):  # the body brings views of its own
        return head + ",\n".join([*parts, body[1:].strip()])
    return head + ",\n".join(parts) + "\n" + body
