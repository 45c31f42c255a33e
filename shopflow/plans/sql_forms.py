"""C-1: metrics written as multi-stage SQL CTEs over a temporary view.

These are the SQL-first spellings of operators that also exist as DataFrame
code; Catalyst plans both, and the tests check the two forms agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shopflow.operators.value import user_item_purchases
from shopflow.schema import BUY


def register(actions: DataFrame, name: str = "actions") -> str:
    """S-4: expose an ACTIONS frame to SQL under ``name`` (session-scoped)."""
    actions.createOrReplaceTempView(name)
    return name


def _run(actions: DataFrame, sql: str) -> DataFrame:
    # ``{A}`` is bound to the frame by spark.sql itself (no named view left behind).
    return actions.sparkSession.sql(sql, A=actions)


def arpu_by_date_sql(actions: DataFrame) -> DataFrame:
    """O-17 as a two-stage CTE: daily counts, then the guarded ratio."""
    return _run(
        actions,
        f"""
        WITH per_day AS (
            SELECT `date`,
                   count_if(behavior_type = {BUY}) AS buys,
                   count(DISTINCT user_id) AS active_users
            FROM {{A}}
            GROUP BY `date`
        )
        SELECT `date`,
               CASE WHEN active_users > 0 THEN CAST(buys AS DOUBLE) / active_users ELSE 0.0D END AS arpu
        FROM per_day
        """,
    )


def paying_ratio_by_date_sql(actions: DataFrame) -> DataFrame:
    """O-20 as a two-stage CTE: one row per (date, user), then per day."""
    return _run(
        actions,
        f"""
        WITH user_days AS (
            SELECT `date`, user_id, max(behavior_type = {BUY}) AS paid
            FROM {{A}}
            GROUP BY `date`, user_id
        ),
        per_day AS (
            SELECT `date`,
                   count_if(user_id IS NOT NULL AND paid) AS paying_users,
                   count(user_id) AS active_users
            FROM user_days
            GROUP BY `date`
        )
        SELECT `date`, paying_users, active_users,
               CASE WHEN active_users > 0 THEN CAST(paying_users AS DOUBLE) / active_users
                    ELSE 0.0D END AS paying_ratio
        FROM per_day
        """,
    )


def repurchase_mean_by_user_sql(actions: DataFrame) -> DataFrame:
    """O-32 as a CTE: per (user, item) first/last day and count, then per user.

    The SQL is over the purchases with a known user and item, bound as a
    frame: their filter is then the one that reaches the scan.

    The intervals of one (user, item) sum to ``last - first``, so no window
    over every purchase is needed.
    """
    return _run(
        user_item_purchases(actions),
        """
        WITH per_item AS (
            SELECT user_id, item_id, count(*) AS n,
                   min(`date`) AS first_day, max(`date`) AS last_day
            FROM {A}
            GROUP BY user_id, item_id
        ),
        per_user AS (
            SELECT user_id,
                   sum(datediff(last_day, first_day)) AS total_days,
                   sum(n - 1) AS intervals
            FROM per_item
            GROUP BY user_id
        )
        SELECT user_id,
               CAST(total_days AS DOUBLE) / intervals AS avg_days,
               total_days div intervals AS avg_days_trunc
        FROM per_user
        WHERE intervals > 0
        """,
    )


def pv_uv_by_date_view(actions: DataFrame, name: str = "actions") -> DataFrame:
    """O-6 in SQL over the named view (S-4), in date order (T-2)."""
    view = register(actions, name)
    return actions.sparkSession.sql(
        f"""
        WITH per_user AS (SELECT `date`, user_id, count(*) AS n FROM {view} GROUP BY `date`, user_id)
        SELECT `date`, sum(n) AS pv, count(user_id) AS uv FROM per_user GROUP BY `date` ORDER BY `date`
        """
    )
