"""A store that takes the log batch by batch, and the metrics from it (S-5, S-6).

Without it every report reads the whole log again.  The store keeps what the
metrics need, in tables of one shared folder::

    hourly/date=       hour, user_id, behavior_type, n_actions
    purchases/date=    user_id, item_id, n_actions (purchases only)
    visitors/date=     bucket, users (bitmaps by user number)
    users/batch=       user_id, number
    catalogue/batch=   item_id, item_category
    missing/batch=     column_name, n_missing
    rejects/batch=     line, reason
    last/batch=        user_id, last_date (the latest purchase day)
    gaps/batch=        gap_days, n (change of the gap histogram; n may be negative)
    applied/batch=     one row, written last: the batch counts

A batch may hold lines of any day.  The days it touches are read from the
day tables, merged with the batch and written again, and their folders take
the place of the old ones; all other days stay as they are.  The batch tables
get a folder of their own.

A batch that fails half-way is applied again under the same name: its
folders that are complete are kept, the merged days are written to a folder
of their own before any day is replaced, and each is then moved to its place:
what an attempt did not move, the next one does.  Readers see a batch's folders once ``applied`` has it.  One writer at
a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.operators.profile import missing_profile
from shopflow.operators.repurchase import cumulative_share
from shopflow.operators.value import purchases as only_purchases
from shopflow.operators.value import user_purchases
from shopflow.operators.visitors import number_users, visitor_bitmaps
from shopflow.schema import NATIVE, WEIGHT, pre_aggregate

_DAY_TABLES = {
    "hourly": "hour int, user_id bigint, behavior_type int, n_actions bigint, date date",
    "purchases": "user_id bigint, item_id bigint, n_actions bigint, date date",
    "visitors": "bucket bigint, users binary, date date",
}
_BATCH_TABLES = {
    "users": "user_id bigint, number bigint, batch string",
    "catalogue": "item_id bigint, item_category bigint, batch string",
    "missing": "column_name string, n_missing bigint, batch string",
    "rejects": "line string, reason string, batch string",
    "last": "user_id bigint, last_date date, batch string",
    "gaps": "gap_days int, n bigint, batch string",
    "applied": "actions bigint, batch string",
}
_HOURLY_KEYS = ("date", "hour", "user_id", "behavior_type")
_PURCHASE_KEYS = ("date", "user_id", "item_id")


class ActionStore:
    """The store in folder ``root`` (shared, any Hadoop path)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Files ---------------------------------------------------------------

    def _path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _hadoop(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _exists(self, path: str) -> bool:
        fs, hadoop = self._hadoop(path)
        return fs.exists(hadoop)

    def _delete(self, path: str) -> None:
        fs, hadoop = self._hadoop(path)
        fs.delete(hadoop, True)

    def _once(self, frame: DataFrame, path: str, *by: str) -> None:
        """Writes ``frame`` to ``path`` unless an earlier attempt finished it."""
        if not self._exists(f"{path}/_SUCCESS"):
            frame.write.mode("overwrite").partitionBy(*by).parquet(path)

    def _replace_days(self, merged: str, name: str) -> None:
        """Moves the folders of the merged days to where the old ones were: names change, no row is copied."""
        fs, source = self._hadoop(merged)
        _, table = self._hadoop(self._path(name))
        fs.mkdirs(table)
        for entry in fs.listStatus(source):  # one folder per day
            folder = entry.getPath().getName()
            if folder.startswith("date="):
                _, day = self._hadoop(self._path(name, folder))
                fs.delete(day, True)
                if not fs.rename(entry.getPath(), day):
                    raise OSError(f"{folder} of {name} was not moved")

    def _empty(self, schema: str) -> DataFrame:
        """No rows: the plan knows that, and no task runs for them."""
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)]).where(F.lit(False))

    # Reading -------------------------------------------------------------

    def batches(self) -> list[str]:
        """Names of the batches that are in the store."""
        if not self._exists(self._path("applied")):
            return []
        return sorted(r["batch"] for r in self.spark.read.schema(_BATCH_TABLES["applied"]).parquet(self._path("applied")).select("batch").collect())

    def table(self, name: str) -> DataFrame:
        """One of the tables above, without rows of batches that are not applied."""
        if name in _DAY_TABLES:
            schema = _DAY_TABLES[name]
            return self.spark.read.schema(schema).parquet(self._path(name)) if self._exists(self._path(name)) else self._empty(schema)
        schema, applied = _BATCH_TABLES[name], self.batches()
        if not applied:
            return self._empty(schema).drop("batch")
        return self.spark.read.schema(schema).parquet(self._path(name)).where(F.col("batch").isin(applied)).drop("batch")

    def hourly(self) -> DataFrame:
        """The actions as counts per hour, user and behaviour: every operator that needs no items takes them."""
        return self.table("hourly")

    def purchases(self) -> DataFrame:
        """The purchases as counts per day, user and item, for the operators that need items."""
        return self.table("purchases").withColumn("behavior_type", F.lit(4))

    def visitors(self) -> DataFrame:
        """Bitmaps for :mod:`shopflow.operators.visitors`."""
        return self.table("visitors")

    def gap_histogram(self) -> DataFrame:
        """O-33 from the batches' changes: ``gap_days, n``."""
        return self.table("gaps").groupBy("gap_days").agg(F.sum("n").alias("n")).where("n <> 0")

    def gap_cumulative(self) -> DataFrame:
        """O-34 from the batches' changes."""
        return cumulative_share(self.gap_histogram())

    def last_purchase_days(self) -> DataFrame:
        """``user_id, last_date`` of every user who bought."""
        return self.table("last").groupBy("user_id").agg(F.max("last_date").alias("last_date"))

    def dataset_profile(self) -> DataFrame:
        """O-1: actions and users from the counts, items and categories from the catalogue."""
        counts = self.hourly().agg(F.coalesce(F.sum(WEIGHT), F.lit(0).cast("bigint")).alias("rows"), F.count_distinct("user_id").alias("users"))
        items = self.table("catalogue").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("item_category").alias("categories"))
        names = ("rows", "users", "items", "categories")
        return counts.unionByName(items, allowMissingColumns=True).agg(*[F.max(n).alias(n) for n in names])

    def missing_profile(self) -> DataFrame:
        """P-5 over all batches."""
        return self.table("missing").groupBy("column_name").agg(F.sum("n_missing").alias("n_missing"))

    # Writing -------------------------------------------------------------

    def apply(self, batch: str, actions: DataFrame, rejects: DataFrame | None = None) -> list:
        """Adds a batch of actions (and rejected lines); returns the days it touched.

        Nothing happens if the batch is in the store already.
        """
        if batch in self.batches():
            return []
        if not batch or set("/=:%") & set(batch):
            raise ValueError("a batch's name becomes a folder's")
        work = self._path("working", batch)
        rows = actions.drop(NATIVE)
        own = {
            "hourly": pre_aggregate(rows, _HOURLY_KEYS),
            "purchases": pre_aggregate(only_purchases(rows), _PURCHASE_KEYS),
            "catalogue": rows.select("item_id", "item_category").distinct(),
            "missing": missing_profile(rows),
        }
        for name, frame in own.items():  # the batch's own counts: everything else is derived from these
            self._once(frame, f"{work}/{name}")
        new = {name: self.spark.read.schema(frame.schema).parquet(f"{work}/{name}") for name, frame in own.items()}
        days = [r["date"] for r in new["hourly"].select("date").distinct().collect()]  # one row per calendar day

        self._once(number_users(new["hourly"], self.table("users")), self._path("users", f"batch={batch}"))
        known = self.table("users").unionByName(self.spark.read.schema("user_id bigint, number bigint").parquet(self._path("users", f"batch={batch}")))
        met = self._unmet(new["catalogue"])
        self._once(met, self._path("catalogue", f"batch={batch}"))
        self._once(new["missing"], self._path("missing", f"batch={batch}"))
        if rejects is None:
            rejects = self._empty("line string, reason string")
        self._once(rejects.select("line", "reason"), self._path("rejects", f"batch={batch}"))
        self._once(self._new_days(new["hourly"], days), f"{work}/buy_days")
        bought = self.spark.read.schema("user_id bigint, date date").parquet(f"{work}/buy_days")
        self._once(self._earlier(bought), f"{work}/earlier")
        earlier = self.spark.read.schema("user_id bigint, first date, last_date date").parquet(f"{work}/earlier")
        self._once(self._gap_change(bought, earlier), self._path("gaps", f"batch={batch}"))
        self._once(bought.groupBy("user_id").agg(F.max("date").alias("last_date")), self._path("last", f"batch={batch}"))

        # All days are merged before the first one is replaced.
        self._once(self._merged("hourly", new["hourly"], days, _HOURLY_KEYS), f"{work}/merged/hourly", "date")
        self._once(self._merged("purchases", new["purchases"], days, _PURCHASE_KEYS), f"{work}/merged/purchases", "date")
        bitmaps = visitor_bitmaps(new["hourly"], numbers=known)
        if self._meets("visitors", days):
            bitmaps = self._days("visitors", days).unionByName(bitmaps).groupBy("date", "bucket").agg(F.bitmap_or_agg("users").alias("users"))
        self._once(bitmaps, f"{work}/merged/visitors", "date")
        for name in _DAY_TABLES:
            self._replace_days(f"{work}/merged/{name}", name)
        self._once(new["hourly"].agg(F.coalesce(F.sum(WEIGHT), F.lit(0).cast("bigint")).alias("actions")), self._path("applied", f"batch={batch}"))
        self._delete(work)
        return sorted(days)

    def _days(self, name: str, days: list) -> DataFrame:
        """The rows of these days: a filter on folders."""
        return self.table(name).where(F.col("date").isin(days)) if days else self.table(name).where(F.lit(False))

    def _meets(self, name: str, days: list) -> bool:
        """Whether the table has one of these days; a batch's rows for days of its own are added up already."""
        return any(d is None or self._exists(self._path(name, f"date={d}")) for d in days)

    def _merged(self, name: str, new: DataFrame, days: list, keys: tuple) -> DataFrame:
        merged = new
        if self._meets(name, days):
            merged = self._days(name, days).unionByName(new).groupBy(*keys).agg(F.sum(WEIGHT).alias(WEIGHT))
        adaptive = self.spark.conf.get("spark.sql.adaptive.enabled", "true").lower() == "true"
        return merged.hint("rebalance", "date") if adaptive else merged

    def _unmet(self, catalogue: DataFrame) -> DataFrame:
        """Items of the batch that no earlier one had; an unknown item or category is one like any other."""
        known = self.table("catalogue").select(F.col("item_id").alias("i"), F.col("item_category").alias("c"))
        return catalogue.join(known, F.col("item_id").eqNullSafe(F.col("i")) & F.col("item_category").eqNullSafe(F.col("c")), "left_anti")

    def _new_days(self, hourly: DataFrame, days: list) -> DataFrame:
        """``user_id, date``: purchase days of the batch that the store does not have."""
        bought = user_purchases(hourly).select("user_id", "date").distinct()
        if not self._meets("hourly", days):
            return bought
        return bought.join(user_purchases(self._days("hourly", days)).select("user_id", "date"), ["user_id", "date"], "left_anti")

    def _earlier(self, bought: DataFrame) -> DataFrame:
        """``user_id, first, last_date``: the first new purchase day of each user who bought before, and the last day known."""
        return bought.groupBy("user_id").agg(F.min("date").alias("first")).join(self.last_purchase_days(), "user_id").select("user_id", "first", "last_date")

    def _gap_change(self, bought: DataFrame, earlier: DataFrame) -> DataFrame:
        """What new purchase days change in the histogram of gaps.

        Where all of a user's new days lie after the last one known, that day
        is all that is needed of the past.  Only users with late lines have
        their purchase days read again: their gaps before go, those after
        come.  One window over known and new days sees both kinds of gaps.
        """
        late = earlier.where("first < last_date").select("user_id")
        known = earlier.where("NOT first < last_date").select("user_id", F.col("last_date").alias("date"))
        if not late.isEmpty():
            known = known.unionByName(user_purchases(self.hourly()).select("user_id", "date").distinct().join(late, "user_id", "left_semi"))
        both = bought.select("user_id", "date", F.lit(None).cast("date").alias("known")).unionByName(known.select("user_id", "date", F.col("date").alias("known")))
        ordered = Window.partitionBy("user_id").orderBy("date")
        after = F.datediff("date", F.lag("date").over(ordered))
        before = F.datediff("known", F.max("known").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
        changes = F.array(F.struct(F.col("after").alias("gap_days"), F.lit(1).cast("bigint").alias("n")), F.struct(F.col("before").alias("gap_days"), F.lit(-1).cast("bigint").alias("n")))
        gaps = both.select(after.alias("after"), before.alias("before")).select(F.inline(changes))
        return gaps.where("gap_days IS NOT NULL").groupBy("gap_days").agg(F.sum("n").alias("n")).where("n <> 0")
