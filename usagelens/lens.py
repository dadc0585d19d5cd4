"""All questions over one set of tables and one moment."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from usagelens.operators import compare, export, growth, listing, replication, summary, worklist
from usagelens.plans import reports, serving
from usagelens.sources.tables import Tables, custom_sql


@dataclass(frozen=True)
class Lens:
    """``Lens(store.tables(spark), as_of).top_by_size(10).show()``

    Every method returns a DataFrame. ``as_of`` is the "now" of every answer.
    """

    tables: Tables
    as_of: datetime

    # whole cluster
    def cluster_summary(self) -> DataFrame:
        return summary.cluster_summary(self.tables.cur)

    def summary_by_owner(self, limit: int | None = 50) -> DataFrame:
        return summary.summary_by_owner(self.tables.cur, limit)

    def storage_class_distribution(self) -> DataFrame:
        t = self.tables
        return summary.storage_class_distribution(t.usage, unique=t.keyed)

    def status(self, threshold_seconds: int = summary.STALE_SECONDS) -> DataFrame:
        return summary.status_rollup(self.tables.cur, self.as_of, threshold_seconds)

    def timestamp_health(self) -> DataFrame:
        return summary.timestamp_health(self.tables.cur)

    # entities
    def entity(self, name: str) -> DataFrame:
        return listing.entity_row(self.tables.cur, name)

    def entity_details(self, name: str) -> DataFrame:
        return listing.entity_details(self.tables.cur, name)

    def entity_history(self, name: str, days: int = 30) -> DataFrame:
        return listing.entity_history(self.tables.hist, name, self.as_of, days)

    def top_by_size(self, limit: int = 20) -> DataFrame:
        return listing.top_by_size(self.tables.cur, limit)

    def top_by_objects(self, limit: int = 20) -> DataFrame:
        return listing.top_by_objects(self.tables.cur, limit)

    def listing(self, sort_by: str = "size", limit: int = 100) -> DataFrame:
        return listing.listing(self.tables.cur, self.as_of, sort_by, limit)

    def all_entities(self) -> DataFrame:
        return listing.all_entities(self.tables.cur)

    def empty_entities(self) -> DataFrame:
        return listing.empty_entities(self.tables.cur)

    # growth and comparison
    def cluster_growth(self, days: int = 30, basis: str = growth.SNAPSHOTS) -> DataFrame:
        return growth.cluster_growth(self.tables.hist, self.as_of, days, basis)

    def fastest_growing_entities(self, days: int = 7, limit: int = 20) -> DataFrame:
        t = self.tables
        return growth.fastest_growing_entities(t.hist, t.cur, self.as_of, days, limit)

    def fastest_growing_owners(self, days: int = 7, limit: int = 20) -> DataFrame:
        t = self.tables
        return growth.fastest_growing_owners(t.hist, t.cur, self.as_of, days, limit)

    def compare_snapshots(self, hours_ago: int = 24) -> DataFrame:
        t = self.tables
        return compare.compare_snapshots(t.cur, t.hist, self.as_of, hours_ago)

    def entity_changes(self, hours: int = 24, min_change_pct: float = 10.0) -> DataFrame:
        t = self.tables
        return compare.entity_changes(t.hist, t.cur, self.as_of, hours, min_change_pct)

    def entity_comparison(self, days: int = 7, limit: int = 50) -> DataFrame:
        t = self.tables
        return compare.entity_comparison(t.cur, t.hist, self.as_of, days, limit)

    def capacity_forecast(
        self, history_days: int = 30, forecast_days: int = 90, by: list[str] | None = None
    ) -> DataFrame:
        return growth.capacity_forecast(
            self.tables.hist, self.as_of, history_days, forecast_days, by
        )

    # freshness
    def collection_freshness(self) -> DataFrame:
        return summary.collection_freshness(self.tables.cur, self.as_of)

    def freshness_bands(self) -> DataFrame:
        return summary.freshness_bands(self.tables.cur, self.as_of)

    def stale_ladder(self) -> DataFrame:
        return summary.stale_ladder(self.tables.cur, self.as_of)

    def stale_report(self, minutes: int = 10, limit: int = 100) -> DataFrame:
        return listing.stale_report(self.tables.cur, self.as_of, minutes, limit)

    # replication
    def sync_status_summary(self) -> DataFrame:
        return replication.sync_status_summary(self.tables.cur)

    def lagging_by_shards(self, limit: int = 50) -> DataFrame:
        return replication.lagging_by_shards(self.tables.cur, limit)

    def lagging_by_entries(self, limit: int = 50) -> DataFrame:
        return replication.lagging_by_entries(self.tables.cur, limit)

    def sync_comparison(self, limit: int = 50) -> DataFrame:
        t = self.tables
        return replication.sync_comparison(t.cur, t.hist, self.as_of, limit)

    # refresh planning; needs an inventory
    def uncollected(self, limit: int | None = 100) -> DataFrame:
        return worklist.uncollected(self.tables.inv, self.tables.cur, limit)

    def refresh_worklist(
        self, threshold_seconds: int = summary.STALE_SECONDS, limit: int | None = None
    ) -> DataFrame:
        t = self.tables
        return worklist.refresh_worklist(t.inv, t.cur, self.as_of, threshold_seconds, limit)

    def refresh_plan(
        self,
        threshold_seconds: int = summary.STALE_SECONDS,
        bulk_threshold: int = worklist.BULK_THRESHOLD,
    ) -> DataFrame:
        t = self.tables
        return worklist.refresh_plan(t.inv, t.cur, self.as_of, threshold_seconds, bulk_threshold)

    # documents, views, free SQL
    def export(self, name: str | None = None, limit: int | None = None) -> DataFrame:
        if name is None:
            return export.export_all(self.tables.cur, limit)
        return export.export_one(self.tables.cur, name)

    def serving_snapshot(self) -> DataFrame:
        return serving.serving_snapshot(self.tables.cur, self.as_of)

    def listing_report(self, sort_by: str = "age", limit: int = 50) -> DataFrame:
        return reports.listing_report(self.tables.cur, self.as_of, sort_by, limit)

    def sql(self, text: str, **args: object) -> DataFrame:
        return custom_sql(self.tables.cur.sparkSession, self.tables, text, **args)
