"""Search and click analytics in batch; billing and feed schedules."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.catalog import of_project

RECENT = 1000
#: Days that daily counters are kept, and hours that hourly ones are.
DAYS_KEPT, HOURS_KEPT = 365, 7 * 24


def searches(log: DataFrame) -> DataFrame:
    """A search log (project_id, ts, query, results_count, took_ms) as it is counted: queries of 2 characters or more."""
    return log.withColumn("query", X.logged_query("query")).where(F.length("query") >= 2)


def per_bucket(log: DataFrame, unit: str = "day") -> DataFrame:
    """(bucket, count) by day or hour."""
    return log.groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(F.count("*").alias("count"))


def popular_queries(log: DataFrame, limit: int = 20) -> DataFrame:
    """(query, count) of searches that found something; ties from z to a."""
    return _top(searches(log).where("results_count > 0").groupBy("query").agg(F.count("*").alias("count")), "query", "count", limit)


def popular_products(clicks: DataFrame, limit: int = 20) -> DataFrame:
    """(product_id, clicks)"""
    return _top(product_clicks(clicks), "product_id", "clicks", limit)


def product_clicks(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("product_id").agg(F.count("*").alias("clicks"))


def converting_queries(clicks: DataFrame, limit: int = 10) -> DataFrame:
    """(query, clicks) of clicks that came from a query."""
    rows = clicks.select(X.clicked_query("query").alias("query")).where(F.coalesce("query", F.lit("")) != "")
    return _top(rows.groupBy("query").agg(F.count("*").alias("clicks")), "query", "clicks", limit)


def _top(counts: DataFrame, key: str, count: str, limit: int) -> DataFrame:
    return counts.orderBy(F.desc(count), F.desc(key)).limit(limit)


def mean_recent(log: DataFrame, *order: str, n: int = RECENT) -> DataFrame:
    """(avg_ms, n): the mean of the last n response times, by ``order`` from the latest on. Only n rows are gathered."""
    last = log.where("took_ms is not null").orderBy(*(F.desc(c) for c in order)).limit(n)
    return last.agg(F.bround(F.avg("took_ms"), 2).alias("avg_ms"), F.count("*").alias("n"))


def dense_days(log: DataFrame, today: date, days: int) -> DataFrame:
    """(day, count) for each of the last ``days`` days, today among them, 0 where nothing was."""
    first = F.date_sub(F.lit(today), days - 1)
    calendar = log.sparkSession.range(1).select(F.explode(F.sequence(first, F.lit(today))).alias("day"))
    counts = log.where(F.to_date("ts").between(first, F.lit(today))).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("count"))


def report(log: DataFrame, clicks: DataFrame, today: date, days: int = 7, project_id: str | None = None) -> dict[str, DataFrame]:
    """The parts of the analytics page of a project, where the logs hold several (column project_id). days=0 is all time:
    totals of everything, and the days of a year that have any."""
    if project_id is not None:
        log, clicks = (of_project(df, project_id) for df in (log, clicks))
    found = searches(log)
    if days:
        by_day = {"queries_by_day": dense_days(found, today, days), "clicks_by_day": dense_days(clicks, today, days)}
        total = lambda part: by_day[part].agg(F.sum("count").alias("n"))
        queries, clicked = total("queries_by_day"), total("clicks_by_day")
    else:
        by_day = {k: dense_days(df, today, DAYS_KEPT).where("count > 0") for k, df in (("queries_by_day", found), ("clicks_by_day", clicks))}
        queries, clicked = (df.agg(F.count("*").alias("n")) for df in (found, clicks))
    totals = queries.select(F.col("n").alias("total_queries")).join(clicked.select(F.col("n").alias("total_clicks")))
    return by_day | {
        "totals": totals,
        "popular_queries": popular_queries(log),
        "popular_products": popular_products(clicks),
        "converting_queries": converting_queries(clicks),
        "avg_response": mean_recent(found, "ts", "query"),
    }


def merge_counters(stored: DataFrame, delta: DataFrame, *keys: str) -> DataFrame:
    """Stored counts and what came since, added up."""
    return stored.unionByName(delta).groupBy(*keys).agg(F.sum("count").alias("count"))


def retained(counters: DataFrame, now, unit: str = "day") -> DataFrame:
    """Buckets that are still kept."""
    kept = F.lit(now) - F.make_interval(days=F.lit(DAYS_KEPT)) if unit == "day" else F.lit(now) - F.make_interval(hours=F.lit(HOURS_KEPT))
    return counters.where(F.col("bucket") > kept)


def unread(notifications: DataFrame) -> DataFrame:
    """(user_id, unread)"""
    return notifications.groupBy("user_id").agg(F.count_if(~F.coalesce("is_read", F.lit(False))).alias("unread"))


def ctr(clicks, searches_):
    """Clicks per 100 searches, halves up; 0 without searches."""
    return F.when(searches_ > 0, F.floor(100.0 * clicks / searches_ + 0.5)).otherwise(0).cast("long")


# Billing and feeds.


def expiring(projects: DataFrame, users: DataFrame, today: date, within: int = 7) -> DataFrame:
    """Active projects paid until today .. today + 7 whose owner was not reminded, with the owner's email."""
    due = F.col("paid_until").between(F.lit(today), F.date_add(F.lit(today), within))
    rows = projects.where((F.col("status") == "active") & due & F.col("expiry_reminder_sent_at").isNull())
    owner = users.select(F.col("id").alias("user_id"), "email")
    return rows.join(owner, "user_id").select("id", "name", "user_id", "email", "paid_until", F.datediff("paid_until", F.lit(today)).alias("days_left"))


def expired(projects: DataFrame, today: date) -> DataFrame:
    return projects.where((F.col("status") == "active") & (F.col("paid_until") < F.lit(today)))


def suspended(projects: DataFrame, today: date) -> DataFrame:
    """The projects after a billing run: the expired ones are suspended."""
    late = (F.col("status") == "active") & F.coalesce(F.col("paid_until") < F.lit(today), F.lit(False))
    return projects.withColumn("status", F.when(late, "suspended").otherwise(F.col("status")))


def reminders(due: DataFrame, users: DataFrame) -> DataFrame:
    """A notification of each due project for each admin and manager; both sides are a handful of rows by nature."""
    staff = users.where(F.col("role").isin("admin", "manager")).select(F.col("id").alias("staff_id"))
    return due.crossJoin(staff).select("staff_id", F.col("id").alias("project_id"), F.concat(F.lit("expires in "), F.col("days_left").cast("string"), F.lit(" days")).alias("message"))


def admin_list(projects: DataFrame, users: DataFrame, keys: DataFrame) -> DataFrame:
    """Projects with their owner and API key, newest first."""
    owner = users.select(F.col("id").alias("user_id"), "email")
    key = keys.select(F.col("project_id").alias("id"), "key")
    return projects.join(owner, "user_id").join(key, "id", "left").orderBy(F.desc("created_at"), "id")


def projects_by_key(keys: DataFrame, projects: DataFrame) -> DataFrame:
    return keys.join(projects.withColumnRenamed("id", "project_id"), "project_id")


def first_user(users: DataFrame) -> DataFrame:
    """Who becomes admin where there is none: the oldest user."""
    none = ~F.max(F.col("role") == "admin")
    return users.agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), none.alias("promote")).where("promote").select("id")


def stale_feeds(projects: DataFrame, runs: DataFrame, now, hours: int = 4) -> DataFrame:
    """Projects with a feed whose last update is 4 hours old or older, missing or no time at all."""
    last = latest_runs(runs).select("project_id", F.replace("last_update", F.lit("Z"), F.lit("")).alias("last_update"))
    rows = projects.where(F.coalesce("feed_url", F.lit("")) != "").join(last, "project_id", "left")
    due = F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    return rows.where(F.coalesce(F.try_to_timestamp("last_update"), F.lit("1970-01-01").cast("timestamp")) <= due).select("project_id", "feed_url")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last row of each project's feed runs."""
    columns = [c for c in runs.columns if c != "project_id"]
    return runs.groupBy("project_id").agg(F.max_by(F.struct(*columns), "ts").alias("r")).select("project_id", "r.*")


# What the dashboard and the widget show.


def grouped_preview(hits: DataFrame, preview: int = 8) -> DataFrame:
    """(query_id, category, position, id, in_category): the first 8 of each category, with the category's number of hits."""
    named = hits.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("Без категории")))
    of = Window.partitionBy("query_id", "category")
    rows = named.withColumn("place", F.row_number().over(of.orderBy("position"))).where(F.col("place") <= preview)
    sizes = named.groupBy("query_id", "category").agg(F.count("*").alias("in_category"))
    return rows.join(sizes, ["query_id", "category"]).select("query_id", "category", F.col("place").alias("position"), "id", "in_category")


def category_page(hits: DataFrame, category: str, page: int, size: int = 20) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    rows = hits.where(F.col("category") == category).withColumn("place", place)
    return rows.where((F.col("place") > page * size) & (F.col("place") <= (page + 1) * size))


def stock_first(hits: DataFrame, limit: int = 20) -> DataFrame:
    """The first results with those in stock before the others."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy((~F.coalesce("in_stock", F.lit(True))).asc(), "position"))
    return hits.withColumn("shown", place).where(F.col("shown") <= limit)


def across_projects(per_project: DataFrame) -> DataFrame:
    """Sums of (project_id, searches, clicks, products) over all projects, and their click rate."""
    total = per_project.agg(*(F.sum(c).alias(c) for c in ("searches", "clicks", "products")))
    return total.withColumn("ctr", ctr(F.col("clicks"), F.col("searches")))


def catalog_summary(catalog: DataFrame, rows: int = 500) -> DataFrame:
    """(categories, in_stock) over the first products by id that a dashboard loads."""
    return catalog.orderBy("id").limit(rows).agg(F.countDistinct("category").alias("categories"), F.count_if(F.col("in_stock")).alias("in_stock"))


def mirrored(daily: DataFrame, today, days: int) -> DataFrame:
    """The stored days (project_id, date, queries_count, clicks_count) from ``today - days`` on, which are days + 1 at most; days
    without a row are left out. With no ``days``, all of them."""
    rows = daily.where(F.col("date") >= F.date_sub(F.lit(today), days)) if days > 0 else daily
    return rows.select("project_id", "date", "queries_count", "clicks_count")
