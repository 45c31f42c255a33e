"""Reference SQL for every catalogued query, in DuckDB's dialect.

Each string runs on the driver's pre-registered parquet views (``events``
here) and must give the same rows, column names and types as the Spark
query of the same key.  Where the Spark plan uses a cheaper equivalent (the
compressed gap lists, the telescoped repurchase mean), the SQL spells out
the direct row-by-row definition, so the check is against brute force.
"""

from __future__ import annotations

from shopflow.plans.catalog import DAY

# The events -> ACTIONS adapter (same mapping as shopflow.sources.events).
_ACTIONS = """A AS (
    SELECT event_id,
           user_id,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
           CAST(json_extract_string(props, '$.k') AS BIGINT) // 10
               - CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 < 0 THEN 1 ELSE 0 END AS item_category,
           CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3
                           WHEN 'purchase' THEN 4 ELSE 0 END AS behavior_type,
           ts AS "time",
           CAST(ts AS DATE) AS "date",
           CAST(hour(ts) AS INTEGER) AS "hour"
    FROM events
)"""

_D = f"DATE '{DAY}'"

# The orders JOIN lineitem -> purchases adapter (shopflow.sources.orders).
_ORDER_ACTIONS = """A AS (
    SELECT o_custkey AS user_id,
           l_partkey AS item_id,
           4 AS behavior_type,
           l_orderkey * 100 + l_linenumber AS event_id,
           CAST(o_orderdate AS DATE) AS "date"
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def _q(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([_ACTIONS, *ctes]) + "\n" + select


def _on_orders(sql: str) -> str:
    """The same SQL with the purchases-from-orders adapter as ``A``."""
    assert sql.startswith("WITH " + _ACTIONS)
    return "WITH " + _ORDER_ACTIONS + sql[len("WITH " + _ACTIONS):]


_PVUV_HOUR_DAY = (
    f'SELECT "hour", count(*) AS pv, count(DISTINCT user_id) AS uv FROM A '
    f'WHERE "date" = {_D} GROUP BY "hour"'
)
_FUNNEL = (
    "c AS (SELECT count_if(behavior_type = 1) AS b, count_if(behavior_type IN (2, 3)) AS i, "
    "count_if(behavior_type = 4) AS y FROM A{where})"
)
_FUNNEL_RATES = (
    "SELECT 100.0::DOUBLE * i / nullif(b, 0) AS interest_rate, "
    "100.0::DOUBLE * y / nullif(b, 0) AS buy_rate, "
    "100.0::DOUBLE * y / nullif(i, 0) AS interest_to_buy_rate FROM c"
)
# Every order of a browse, an interest and a buy of the same user that does not go back in time, pair by pair.
_STEPS = (
    "s AS (SELECT user_id, CASE behavior_type WHEN 1 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS step, "
    "date_trunc('hour', \"time\") AS tt FROM A WHERE user_id IS NOT NULL AND behavior_type IN (1, 2, 3, 4){where})",
    "f0 AS (SELECT user_id, min(tt) AS t FROM s WHERE step = 0 GROUP BY user_id)",
    "f1 AS (SELECT y.user_id, min(y.tt) AS t FROM s x JOIN s y ON x.user_id = y.user_id AND x.step = 0 AND y.step = 1 "
    "AND y.tt >= x.tt GROUP BY y.user_id)",
    "f2 AS (SELECT z.user_id, min(z.tt) AS t FROM s x JOIN s y ON x.user_id = y.user_id AND x.step = 0 AND y.step = 1 AND y.tt >= x.tt "
    "JOIN s z ON z.user_id = y.user_id AND z.step = 2 AND z.tt >= y.tt GROUP BY z.user_id)",
    "ft AS (SELECT user_id, f0.t AS browse, f1.t AS interest, f2.t AS buy FROM f0 LEFT JOIN f1 USING (user_id) LEFT JOIN f2 USING (user_id))",
    "fc AS (SELECT count(browse) AS u0, count(interest) AS u1, count(buy) AS u2, "
    "sum(epoch(interest - browse) // 3600) AS h1, sum(epoch(buy - interest) // 3600) AS h2 FROM ft)",
    "fl AS (SELECT *, 1.0::DOUBLE - u1::DOUBLE / nullif(u0, 0) AS l1, 1.0::DOUBLE - u2::DOUBLE / nullif(u1, 0) AS l2 FROM fc)",
)
_ORDERED = (
    "SELECT 'browse' AS step, u0 AS users, NULL::DOUBLE AS loss, false AS is_largest, NULL::DOUBLE AS mean_hours FROM fl UNION ALL "
    "SELECT 'interest', u1, l1, coalesce(l1 >= coalesce(l2, l1), false), h1::DOUBLE / nullif(u1, 0) FROM fl UNION ALL "
    "SELECT 'buy', u2, l2, coalesce(l2 >= coalesce(l1, l2), false), h2::DOUBLE / nullif(u2, 0) FROM fl"
)


def _steps(where: str = "") -> list[str]:
    return [_STEPS[0].format(where=where), *_STEPS[1:]]


def _gap_parts(size: int) -> str:
    """Every gap of the direct definition with its place in the list; a part is ``size`` places."""
    return _q(
        f"SELECT user_id, CAST(greatest(rn - 2, 0) // {size} AS BIGINT) AS part, count(gap) AS n, coalesce(string_agg(gap, ',' ORDER BY rn), '') AS gaps "
        "FROM r GROUP BY ALL",
        'b AS (SELECT user_id, "date", row_number() OVER (PARTITION BY user_id ORDER BY "date", '
        "event_id) AS rn FROM A WHERE behavior_type = 4 AND user_id IS NOT NULL)",
        "r AS (SELECT user_id, rn, CAST(date_diff('day', lag(\"date\") OVER "
        '(PARTITION BY user_id ORDER BY rn), "date") AS VARCHAR) AS gap FROM b)',
    )


_DAILY = (
    'd AS (SELECT "date", count_if(behavior_type = 4) AS buys, '
    'count(DISTINCT user_id) AS active_users FROM A GROUP BY "date")'
)
_PAY_DAYS = (
    'p AS (SELECT user_id, count(DISTINCT "date") AS pay_days FROM A '
    "WHERE behavior_type = 4 AND user_id IS NOT NULL GROUP BY user_id)"
)
_GAPS = (
    'dd AS (SELECT DISTINCT user_id, "date" FROM A WHERE behavior_type = 4 AND user_id IS NOT NULL)',
    'g AS (SELECT user_id, "date", CAST(date_diff(\'day\', lag("date") OVER '
    '(PARTITION BY user_id ORDER BY "date"), "date") AS INTEGER) AS gap_days FROM dd)',
    "gg AS (SELECT * FROM g WHERE gap_days IS NOT NULL)",
)
_HIST = "h AS (SELECT gap_days, count(*) AS n FROM gg GROUP BY gap_days)"
_ARPU = (
    'SELECT "date", CASE WHEN active_users > 0 THEN buys::DOUBLE / active_users ELSE 0.0 END '
    "AS arpu FROM d"
)
_PAYING = (
    'SELECT "date", count(DISTINCT CASE WHEN behavior_type = 4 THEN user_id END) AS paying_users, '
    'count(DISTINCT user_id) AS active_users FROM A GROUP BY "date"'
)
_PAYING_RATIO = (
    'SELECT "date", paying_users, active_users, CASE WHEN active_users > 0 '
    "THEN paying_users::DOUBLE / active_users ELSE 0.0 END AS paying_ratio FROM pr"
)
# Every purchase with the day of the one before it, of the same user and item.
_MEAN = _q(
    "SELECT user_id, avg(wait) AS avg_days, CAST(sum(wait) // count(wait) AS BIGINT) AS avg_days_trunc "
    "FROM waits GROUP BY user_id HAVING count(wait) > 0",
    "waits AS (SELECT user_id, date_diff('day', lag(\"date\") OVER same_item, \"date\") AS wait FROM A "
    "WHERE behavior_type = 4 AND user_id IS NOT NULL AND item_id IS NOT NULL "
    'WINDOW same_item AS (PARTITION BY user_id, item_id ORDER BY "date"))',
)


def _bucket_sql(bounds=(50, 100, 800)) -> tuple[str, str]:
    edges = [1, *bounds]
    lo = " ".join(f"WHEN c < {h} THEN {l}" for l, h in zip(edges, edges[1:]))
    lab = " ".join(f"WHEN c < {h} THEN '[{l},{h})'" for l, h in zip(edges, edges[1:]))
    return (f"CASE {lo} ELSE {edges[-1]} END", f"CASE {lab} ELSE '[{edges[-1]},inf)' END")


_PER_USER = "u AS (SELECT user_id, count(*) AS c FROM A WHERE behavior_type = 4 AND user_id IS NOT NULL GROUP BY user_id)"
_B_LO, _B_LABEL = _bucket_sql()

_MISSING_COLS = ("user_id", "item_id", "behavior_type", "item_category", "time", "date", "hour")

ORACLE_SQL: dict[str, str] = {
    "dataset_profile": _q(
        'SELECT count(*) AS "rows", count(DISTINCT user_id) AS users, '
        "count(DISTINCT item_id) AS items, count(DISTINCT item_category) AS categories FROM A"
    ),
    "missing_profile": _q(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count_if(\"{c}\" IS NULL) AS n_missing FROM A"
            for c in _MISSING_COLS
        )
    ),
    "pv_by_date": _q('SELECT "date", count(*) AS pv FROM A GROUP BY "date"'),
    "uv_by_date": _q('SELECT "date", count(DISTINCT user_id) AS uv FROM A GROUP BY "date"'),
    "pv_by_hour": _q('SELECT "hour", count(*) AS pv FROM A GROUP BY "hour"'),
    "uv_by_hour": _q('SELECT "hour", count(DISTINCT user_id) AS uv FROM A GROUP BY "hour"'),
    "pv_uv_by_date": _q(
        'SELECT "date", count(*) AS pv, count(DISTINCT user_id) AS uv FROM A GROUP BY "date"'
    ),
    "pv_uv_by_hour": _q(
        'SELECT "hour", count(*) AS pv, count(DISTINCT user_id) AS uv FROM A GROUP BY "hour"'
    ),
    "pv_uv_by_hour_on_day": _q(_PVUV_HOUR_DAY),
    "pv_uv_join_on_day": _q(
        "SELECT p.\"hour\", p.pv, u.uv FROM p JOIN u ON p.\"hour\" = u.\"hour\"",
        f'p AS (SELECT "hour", count(*) AS pv FROM A WHERE "date" = {_D} GROUP BY "hour")',
        f'u AS (SELECT "hour", count(DISTINCT user_id) AS uv FROM A WHERE "date" = {_D} '
        'GROUP BY "hour")',
    ),
    "pv_by_behavior_hour": _q(
        'SELECT behavior_type, "hour", count(*) AS pv FROM A GROUP BY behavior_type, "hour"'
    ),
    "behavior_counts": _q("SELECT behavior_type, count(*) AS n FROM A GROUP BY behavior_type"),
    "behavior_counts_on_day": _q(
        f'SELECT behavior_type, count(*) AS n FROM A WHERE "date" = {_D} GROUP BY behavior_type'
    ),
    "funnel_rates": _q(_FUNNEL_RATES, _FUNNEL.format(where="")),
    "funnel_rates_on_day": _q(_FUNNEL_RATES, _FUNNEL.format(where=f' WHERE "date" = {_D}')),
    "funnel_step_loss": _q(
        "SELECT 'browse_to_interest' AS step, l1 AS loss, "
        "coalesce(l1 = CASE WHEN l2 IS NULL OR l1 >= l2 THEN l1 ELSE l2 END, false) AS is_largest "
        "FROM l UNION ALL "
        "SELECT 'interest_to_buy' AS step, l2 AS loss, "
        "coalesce(l2 = CASE WHEN l1 IS NULL OR l2 >= l1 THEN l2 ELSE l1 END, false) AS is_largest "
        "FROM l",
        _FUNNEL.format(where=""),
        "l AS (SELECT 1.0::DOUBLE - i::DOUBLE / nullif(b, 0) AS l1, "
        "1.0::DOUBLE - y::DOUBLE / nullif(i, 0) AS l2 FROM c)",
    ),
    "ordered_funnel": _q(_ORDERED, *_steps()),
    "ordered_funnel_on_day": _q(_ORDERED, *_steps(f' AND "date" = {_D}')),
    "ordered_funnel_times": _q("SELECT * FROM ft", *_steps()),
    "buy_count_by_user": _q(
        "SELECT user_id, count(*) AS buy_count FROM A WHERE behavior_type = 4 AND user_id IS NOT NULL GROUP BY user_id"
    ),
    "actions_by_date_user_behavior": _q(
        'SELECT "date", user_id, behavior_type, count(*) AS n FROM A '
        'GROUP BY "date", user_id, behavior_type'
    ),
    "daily_consumption": _q("SELECT * FROM d", _DAILY),
    "arpu_by_date": _q(_ARPU, _DAILY),
    "buys_by_date_user": _q(
        'SELECT "date", user_id, count(*) AS buy_count FROM A WHERE behavior_type = 4 '
        'GROUP BY "date", user_id'
    ),
    "arppu_by_date": _q(
        'SELECT "date", count(*)::DOUBLE / count(DISTINCT user_id) AS arppu '
        'FROM A WHERE behavior_type = 4 GROUP BY "date" HAVING count(user_id) > 0'
    ),
    "paying_ratio_by_date": _q(_PAYING_RATIO, f"pr AS ({_PAYING})"),
    "buy_count_distribution": _q(
        f"SELECT {_B_LO} AS bucket_lo, {_B_LABEL} AS bucket, count(*) AS users FROM u "
        "GROUP BY bucket_lo, bucket",
        _PER_USER,
    ),
    "pay_days_by_user": _q("SELECT * FROM p", _PAY_DAYS),
    "repeat_buy_rate": _q(
        "SELECT count(*) AS purchasers, count_if(pay_days > 1) AS repeat_purchasers, "
        "count_if(pay_days > 1)::DOUBLE / nullif(count(*), 0) AS repeat_rate FROM p",
        _PAY_DAYS,
    ),
    "buys_by_user_date": _q(
        'SELECT user_id, "date", count(*) AS buy_count FROM A WHERE behavior_type = 4 '
        'GROUP BY user_id, "date"'
    ),
    "repurchase_gaps": _q("SELECT * FROM gg", *_GAPS),
    # Rows are numbered once, so the gap and the list use the same order even
    # when two purchases tie on (date, event_id).
    "repurchase_gap_lists": _q(
        "SELECT user_id, coalesce(string_agg(gap, ',' ORDER BY rn), '') AS gaps "
        "FROM r GROUP BY user_id",
        'b AS (SELECT user_id, "date", row_number() OVER (PARTITION BY user_id ORDER BY "date", '
        "event_id) AS rn FROM A WHERE behavior_type = 4 AND user_id IS NOT NULL)",
        "r AS (SELECT user_id, rn, CAST(date_diff('day', lag(\"date\") OVER "
        '(PARTITION BY user_id ORDER BY rn), "date") AS VARCHAR) AS gap FROM b)',
    ),
    "repurchase_gap_list_parts": _gap_parts(500_000),
    "repurchase_gap_list_parts_small": _gap_parts(3),
    "repurchase_gap_runs": _q(
        "SELECT user_id, \"date\", CAST(date_diff('day', lag(\"date\") OVER (PARTITION BY user_id "
        'ORDER BY "date"), "date") AS INTEGER) AS gap_days, repeats FROM pc',
        'pc AS (SELECT user_id, "date", count(*) - 1 AS repeats FROM A WHERE behavior_type = 4 AND user_id IS NOT NULL '
        'GROUP BY user_id, "date")',
    ),
    "repurchase_item_intervals": _q(
        "SELECT user_id, item_id, \"date\", next_date, "
        "CAST(date_diff('day', \"date\", next_date) AS INTEGER) AS days_to_next, repeats FROM nx2",
        'pid AS (SELECT user_id, item_id, "date", count(*) - 1 AS repeats FROM A '
        'WHERE behavior_type = 4 AND user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY user_id, item_id, "date")',
        'nx2 AS (SELECT *, lead("date") OVER (PARTITION BY user_id, item_id ORDER BY "date") '
        "AS next_date FROM pid)",
    ),
    "repurchase_mean_by_user": _MEAN,
    "repurchase_gap_histogram": _q("SELECT * FROM h", *_GAPS, _HIST),
    "repurchase_gap_cumulative": _q(
        "SELECT gap_days, n, CAST(sum(n) OVER (ORDER BY gap_days ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND CURRENT ROW) AS DOUBLE) / sum(n) OVER () AS cum_share FROM h",
        *_GAPS,
        _HIST,
    ),
    "pv_behavior_pivot": _q(
        'SELECT "hour", count_if(behavior_type = 1) AS b1, count_if(behavior_type = 2) AS b2, '
        'count_if(behavior_type = 3) AS b3, count_if(behavior_type = 4) AS b4 FROM A GROUP BY "hour"'
    ),
    "hourly_day_vs_overall": _q(
        'SELECT o."hour", o.pv, o.uv, coalesce(dy.pv, 0) AS pv_day, coalesce(dy.uv, 0) AS uv_day '
        'FROM o LEFT JOIN dy ON o."hour" = dy."hour"',
        'o AS (SELECT "hour", count(*) AS pv, count(DISTINCT user_id) AS uv FROM A GROUP BY "hour")',
        f"dy AS ({_PVUV_HOUR_DAY})",
    ),
    "parse_action_lines": _q(
        "SELECT user_id, item_id, behavior_type, item_category, date_trunc('hour', \"time\") AS \"time\", "
        '"date", "hour" FROM A WHERE behavior_type IN (1, 2, 3, 4)'
    ),
    "rejected_lines": _q(
        "SELECT 'behavior_type' AS reason, count(*) AS n FROM A "
        "WHERE behavior_type NOT IN (1, 2, 3, 4) GROUP BY reason"
    ),
    "text_report": _q(
        "SELECT 'date: ' || CAST(\"date\" AS VARCHAR) || ', pv: ' || CAST(count(*) AS VARCHAR) "
        "|| ', uv: ' || CAST(count(DISTINCT user_id) AS VARCHAR) AS value FROM A GROUP BY \"date\""
    ),
}


# The messy log (shopflow.plans.messy_log): what each variant of a line means, straight from the events.
_V = "M AS (SELECT *, event_id % 10 AS v FROM A)"
_KNOWN = "behavior_type IN (1, 2, 3, 4)"
_SHIFTED = (
    "CASE WHEN v <> 1 THEN user_id END AS user_id, CASE WHEN v <> 2 THEN item_id END AS item_id, behavior_type, "
    "CASE WHEN v <> 3 THEN item_category END AS item_category"
)
_REASONS_7 = (
    "CASE WHEN v = 0 THEN 'field_count' WHEN v = 8 THEN 'user_id' "
    f"WHEN v = 7 OR NOT ({_KNOWN}) THEN 'behavior_type' WHEN v = 5 THEN 'date' WHEN v = 6 THEN 'hour' END"
)
_REASONS_5 = (
    "CASE WHEN v = 0 THEN 'field_count' WHEN v = 8 THEN 'user_id' "
    f"WHEN v = 7 OR NOT ({_KNOWN}) THEN 'behavior_type' WHEN v = 4 THEN 'time' END"
)
_BLANKS = {
    "user_id": "v = 1 OR (v <> 8 AND user_id IS NULL)",
    "item_id": "v = 2 OR item_id IS NULL",
    "behavior_type": "v = 7",
    "item_category": "v IN (0, 3) OR item_category IS NULL",
    "time": "v IN (0, 4)",
    "date": "v IN (0, 5)",
    "hour": "v IN (0, 6)",
}
ORACLE_SQL |= {
    "log_profile": _q(
        "SELECT 'field_count' AS column_name, CAST(NULL AS BIGINT) AS n_missing, count_if(reason = 'field_count') AS n_rejected FROM R UNION ALL "
        + " UNION ALL ".join(f"SELECT '{c}', count_if({w}), count_if(reason = '{c}') FROM R" for c, w in _BLANKS.items()),
        _V, f"R AS (SELECT *, {_REASONS_7} AS reason FROM M)",
    ),
    "parse_messy_lines": _q(
        f"SELECT {_SHIFTED}, CASE WHEN v <> 4 THEN date_trunc('hour', \"time\") END AS \"time\", \"date\", \"hour\" FROM M "
        f"WHERE {_REASONS_7} IS NULL",
        _V,
    ),
    "parse_messy_lines_5": _q(
        f"SELECT {_SHIFTED}, date_trunc('hour', \"time\") AS \"time\", \"date\", \"hour\" FROM M WHERE {_REASONS_5} IS NULL", _V
    ),
    "rejected_messy_lines": _q(f"SELECT {_REASONS_7} AS reason, count(*) AS n FROM M GROUP BY reason HAVING reason IS NOT NULL", _V),
    "rejected_messy_lines_5": _q(f"SELECT {_REASONS_5} AS reason, count(*) AS n FROM M GROUP BY reason HAVING reason IS NOT NULL", _V),
}
_BLANK_LINE = " OR ".join(f"({w})" for w in _BLANKS.values())
ORACLE_SQL["file_quality"] = _q(
    'SELECT strftime("date", \'%Y-%m-%d\') AS file, count(*) AS n_lines, '
    f"count_if({_BLANK_LINE}) AS n_blank, count(reason) AS n_rejected, count(reason)::DOUBLE / count(*) AS reject_share, "
    "(SELECT reason FROM R r2 WHERE r2.\"date\" = R.\"date\" AND reason IS NOT NULL GROUP BY reason "
    "ORDER BY count(*) DESC, list_position(['field_count', 'user_id', 'item_id', 'behavior_type', 'item_category', 'time', 'date', 'hour'], reason) LIMIT 1) AS main_reason "
    'FROM R GROUP BY "date"',
    _V, f"R AS (SELECT *, {_REASONS_7} AS reason FROM M)",
)


def _cuts(keys: str) -> tuple[str, ...]:
    """The cuts by DuckDB's own quantiles and moments over the groups themselves, not their histogram."""
    return (
        f"act AS (SELECT {keys}, count(*) AS n FROM A WHERE user_id IS NOT NULL GROUP BY {keys})",
        "q AS (SELECT quantile_disc(n, 0.25)::DOUBLE AS q25, quantile_disc(n, 0.75)::DOUBLE AS q75, quantile_disc(n, 0.99)::DOUBLE AS q99, "
        "quantile_disc(n, 0.999)::DOUBLE AS q999, sum(n)::DOUBLE / count(*) AS m, sum(n * n)::DOUBLE / count(*) AS m2 FROM act)",
        "cuts AS (SELECT 'q99' AS rule, q99 AS cut FROM q UNION ALL SELECT 'q999', q999 FROM q "
        "UNION ALL SELECT 'iqr', q75 + 1.5::DOUBLE * (q75 - q25) FROM q "
        "UNION ALL SELECT 'mean_3sd', m + 3.0::DOUBLE * sqrt(greatest(m2 - m * m, 0.0::DOUBLE)) FROM q)",
    )


_BEYOND = (
    "SELECT rule, cut, (SELECT count(*) FROM act WHERE n > cut) AS n_groups, "
    "CAST((SELECT coalesce(sum(n), 0) FROM act WHERE n > cut) AS BIGINT) AS n_actions FROM cuts"
)
_USER_DAY = 'user_id, "date"'
ORACLE_SQL |= {
    "activity_cuts": _q(_BEYOND, *_cuts(_USER_DAY + ', "hour"')),
    "activity_cuts_daily": _q(_BEYOND, *_cuts(_USER_DAY)),
    "outlier_user_days": _q("SELECT act.*, cut FROM act, cuts WHERE rule = 'q99' AND n > cut", *_cuts(_USER_DAY)),
    "pv_uv_by_date_without_outliers": _q(
        'SELECT "date", count(*) AS pv, count(DISTINCT user_id) AS uv FROM A WHERE NOT EXISTS '
        "(SELECT 1 FROM act, cuts WHERE rule = 'q99' AND n > cut AND act.user_id = A.user_id AND act.\"date\" = A.\"date\") GROUP BY \"date\"",
        *_cuts(_USER_DAY),
    ),
    "uv_rolling_7_days": _q(
        'SELECT e."date", count(DISTINCT user_id) AS uv FROM (SELECT DISTINCT "date" FROM A WHERE user_id IS NOT NULL) e '
        'JOIN A ON A."date" BETWEEN e."date" - 6 AND e."date" GROUP BY e."date"'
    ),
    "uv_by_week": _q("SELECT CAST(date_trunc('week', \"date\") AS DATE) AS start, count(DISTINCT user_id) AS uv FROM A WHERE user_id IS NOT NULL GROUP BY start"),
    "uv_by_month": _q("SELECT CAST(date_trunc('month', \"date\") AS DATE) AS start, count(DISTINCT user_id) AS uv FROM A WHERE user_id IS NOT NULL GROUP BY start"),
    "uv_by_hour_bitmaps": ORACLE_SQL["uv_by_hour"],
    "store_last_purchase_days": _q('SELECT user_id, max("date") AS last_date FROM A WHERE behavior_type = 4 AND user_id IS NOT NULL GROUP BY user_id'),
}
for _k in ("pv_uv_by_date", "arpu_by_date", "dataset_profile", "missing_profile", "repurchase_mean_by_user", "uv_rolling_7_days",
           "repurchase_gap_histogram", "repurchase_gap_cumulative"):
    ORACLE_SQL["store_" + _k] = ORACLE_SQL[_k]
_S_LO, _S_LABEL = _bucket_sql((5, 10, 20))
ORACLE_SQL["buy_count_distribution_small"] = _q(
    f"SELECT {_S_LO} AS bucket_lo, {_S_LABEL} AS bucket, count(*) AS users FROM u GROUP BY bucket_lo, bucket", _PER_USER
)


def _bigint_count_if(sql: str) -> str:
    """DuckDB's count_if is HUGEINT; Spark's is BIGINT.  Cast every call."""
    out, i = [], 0
    while True:
        j = sql.find("count_if(", i)
        if j < 0:
            return "".join(out) + sql[i:]
        depth, k = 0, j + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
            if depth == 0:
                break
        out.append(sql[i:j] + "CAST(" + sql[j:k] + " AS BIGINT)")
        i = k


def _with_unknowns(sql: str) -> str:
    """The same SQL where every seventh event's user and every fifth event's item are unknown."""
    start = "WITH " + _ACTIONS
    assert sql.startswith(start)
    known = _ACTIONS.replace("A AS (", "A0 AS (", 1)
    unknown = (
        "A AS (SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, "
        "CASE WHEN event_id % 5 <> 0 THEN item_id END AS item_id) FROM A0)"
    )
    return "WITH " + known + ",\n" + unknown + sql[len(start):]


for _k, _of in {
    "ordered_funnel": "ordered_funnel", "pv_uv_by_date": "pv_uv_by_date", "arppu_by_date": "arppu_by_date", "buy_count_distribution": "buy_count_distribution_small",
    "repeat_buy_rate": "repeat_buy_rate", "repurchase_gaps": "repurchase_gaps", "repurchase_gap_lists": "repurchase_gap_lists",
    "repurchase_gap_cumulative": "repurchase_gap_cumulative", "repurchase_item_intervals": "repurchase_item_intervals",
    "repurchase_mean_by_user": "repurchase_mean_by_user",
}.items():
    ORACLE_SQL["unknowns_" + _k] = _with_unknowns(ORACLE_SQL[_of])
ORACLE_SQL["pv_uv_by_date_view"] = ORACLE_SQL["pv_uv_by_date"]
ORACLE_SQL["repurchase_gap_frequency"] = ORACLE_SQL["repurchase_gap_histogram"]

for _k in ("arppu_by_date", "pay_days_by_user", "repeat_buy_rate", "repurchase_gaps",
           "repurchase_gap_lists", "repurchase_mean_by_user", "repurchase_gap_cumulative"):
    ORACLE_SQL["order_" + _k] = _on_orders(ORACLE_SQL[_k])
ORACLE_SQL["order_repurchase_gap_list_parts"] = _on_orders(_gap_parts(10))

ORACLE_SQL = {k: _bigint_count_if(v) for k, v in ORACLE_SQL.items()}
ORACLE_SQL["arpu_by_date_sql"] = ORACLE_SQL["arpu_by_date"]
ORACLE_SQL["paying_ratio_by_date_sql"] = ORACLE_SQL["paying_ratio_by_date"]
ORACLE_SQL["repurchase_mean_by_user_sql"] = ORACLE_SQL["repurchase_mean_by_user"]
for _k in ("ordered_funnel", "pv_uv_by_date", "arpu_by_date", "repurchase_gap_lists"):
    ORACLE_SQL[_k + "_hourly"] = ORACLE_SQL[_k]
