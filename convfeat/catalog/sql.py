"""DuckDB counterparts of the derived tables and of the row-wise expressions."""

from __future__ import annotations

from convfeat.functions.calendar import GAP_EDGES

FACTS = """facts AS (
  SELECT event_id, ts, user_id, event_type, value, floor(epoch(ts))::bigint AS sec,
         regexp_extract(props, '([0-9]+)', 1)::bigint AS k, round(value * 100)::bigint AS cents
  FROM events)"""

BASE = """base AS (
  SELECT event_id AS sample_id, sec AS timestamp,
         CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 END AS label_type,
         user_id, CASE WHEN k <> 50 THEN k - 1 END AS item_id, k, value
  FROM facts WHERE event_type IN ('click', 'purchase', 'view'))"""

USERS = """order_lists AS (
  SELECT o_custkey, list(o_orderkey % 200 ORDER BY o_orderkey) AS order_ids,
         list(o_totalprice ORDER BY o_orderkey) AS order_totals, max(o_totalprice) AS top_total
  FROM orders GROUP BY o_custkey),
users AS (
  SELECT c_custkey AS cust, c_nationkey::bigint - 1 AS user_int_feats_1,
         (list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment))::bigint
           AS user_int_feats_15,
         c_custkey AS user_int_feats_48, order_ids AS user_int_feats_60
  FROM customer LEFT JOIN order_lists ON o_custkey = c_custkey)"""

DENSE = """dense AS (
  SELECT vec_id AS dense_key, embedding::double[] AS user_dense_feats_61,
         order_totals AS user_dense_feats_62,
         list_transform(order_totals, lambda x: x / top_total) AS user_dense_feats_89,
         list_transform(order_totals, lambda x: x / top_total) AS user_dense_feats_90
  FROM embeddings FULL JOIN order_lists ON o_custkey = vec_id)"""

ITEMS = """items AS (
  SELECT p_partkey, p_size::bigint AS item_int_feats_5,
         regexp_extract(p_brand, '([0-9]+)', 1)::bigint AS item_int_feats_11,
         [p_size::bigint, -1, p_size::bigint * 2] AS item_int_feats_16
  FROM part)"""


def _listed(value: str, types: str, name: str) -> str:
    return f"list({value} ORDER BY h.ts DESC, h.event_id DESC) FILTER (WHERE h.event_type IN ({types})) AS {name}"


HISTORY = f"""hist AS (
  SELECT s.event_id AS hist_key,
    {_listed("h.k", "'view'", "seq_a_101")}, {_listed("h.sec", "'view'", "seq_a_29")},
    {_listed("h.k", "'click'", "seq_b_102")}, {_listed("h.event_id + 1", "'click'", "seq_b_69")},
    {_listed("h.sec", "'click'", "seq_b_29")},
    {_listed("h.k", "'purchase'", "seq_c_103")}, {_listed("h.cents", "'purchase'", "seq_c_34")},
    {_listed("h.sec", "'purchase'", "seq_c_29")},
    {_listed("h.k", "'error', 'signup'", "seq_d_104")}
  FROM facts s LEFT JOIN facts h ON h.user_id = s.user_id
   AND (h.ts < s.ts OR (h.ts = s.ts AND h.event_id < s.event_id))
  WHERE s.event_type IN ('click', 'purchase', 'view') GROUP BY s.event_id)"""


def samples_sql(*parts: str) -> str:
    """CTEs ending in ``samples``; the same parts as the Spark table."""
    ctes, joins, columns = [FACTS, BASE], [], ["base.*"]
    if "user" in parts or "dense" in parts:
        ctes.append(USERS)
    if "user" in parts:
        joins.append("LEFT JOIN users ON cust = user_id")
        columns.append("users.* EXCLUDE (cust)")
    if "dense" in parts:
        ctes.append(DENSE)
        joins.append("LEFT JOIN dense ON dense_key = user_id")
        columns.append("dense.* EXCLUDE (dense_key)")
    if "item" in parts:
        ctes.append(ITEMS)
        joins.append("LEFT JOIN items ON p_partkey = k")
        columns.append("items.* EXCLUDE (p_partkey)")
    if "seq" in parts:
        ctes.append(HISTORY)
        joins.append("LEFT JOIN hist ON hist_key = sample_id")
        columns.append("hist.* EXCLUDE (hist_key)")
    ctes.append(f"samples AS (SELECT {', '.join(columns)} FROM base {' '.join(joins)})")
    return ",\n".join(ctes)


# ---- expressions ------------------------------------------------------------------


def clean(e: str) -> str:
    return f"greatest(coalesce({e}, 0), 0)"


def clip(e: str, vocab: int) -> str:
    return "0::bigint" if vocab <= 0 else f"CASE WHEN {clean(e)} >= {vocab} THEN 0 ELSE {clean(e)} END::bigint"


def pad(e: str, n: int, vocab: int | None = None) -> str:
    each = clean("x") if vocab is None else clip("x", vocab)
    return f"list_resize(list_transform(coalesce({e}, [])[1:{n}], lambda x: {each}), {n}, 0)"


def pad_floats(e: str, n: int) -> str:
    return f"list_resize(coalesce({e}, [])[1:{n}], {n}, 0.0::double)"


def size(e: str, n: int) -> str:
    return f"least(coalesce(len({e}), 0), {n})::bigint"


def hour(ts: str) -> str:
    return f"((({ts} + 28800) % 86400 + 86400) % 86400 // 3600 + 1)"


def day(ts: str) -> str:
    return f"((floor(({ts} + 28800) / 86400.0::double)::bigint + 3) % 7 + 1)"


def bucket(sample: str, event: str) -> str:
    edges = ", ".join(map(str, GAP_EDGES))
    below = f"len(list_filter([{edges}], lambda edge: edge < greatest({sample} - {event}, 0)))"
    return f"CASE WHEN {event} = 0 THEN 0 ELSE least({below}, {len(GAP_EDGES) - 1}) + 1 END::bigint"


def threshold(source: str, keep: float, column: str = "sec") -> str:
    """Scalar subquery: the order statistic of the recent-window rule."""
    rank = f"SELECT floor((1.0::double - {keep}::double) * (count(*) - 1))::bigint FROM {source}"
    return (
        f"(SELECT {column} FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) - 1 AS rk FROM {source}) "
        f"WHERE rk = ({rank}))"
    )


def l2(e: str) -> str:
    return f"list_transform({e}, lambda x: x / greatest(sqrt(list_sum(list_transform({e}, lambda y: y * y))), 1e-6::double))"


def log_clamp(e: str) -> str:
    return f"list_transform({e}, lambda x: least(ln(1 + greatest(x, 0::double)), 20::double))"
