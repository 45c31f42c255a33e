"""shopflow: user-behaviour analytics of e-commerce action logs on Spark.

Traffic (PV/UV), funnel conversion, user value (ARPU, ARPPU, paying ratio)
and repurchase metrics, each a function ``DataFrame -> DataFrame`` over the
ACTIONS model of :mod:`shopflow.schema` (:mod:`shopflow.operators`).

Sources (:mod:`shopflow.sources`): delimited action-log text with reject
routing, the parquet ``events`` table, orders joined to line items; sinks for
JSON lines, ``field: value`` reports and TSV.  :mod:`shopflow.plans.report`
runs the whole analysis as one job.
"""

__version__ = "0.1.0"
