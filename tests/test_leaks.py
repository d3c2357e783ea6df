"""Dated outputs read nothing later; a planted leak is caught; draws with replacement."""

import collections

from pyspark.sql import functions as F

from tidemark.operators import leaks
from tidemark.plans import catalogue, feed
from tidemark.sources import tables

SF = "/root/testdata/sf0.001"
DATED = "asof_visible asof_cancellation_anti correction_latest feed_week daily_series region_counts tier_histogram source_coverage entity_record".split()


def test_registered_outputs_read_nothing_later(spark):
    chosen = {n: catalogue.queries()[n] for n in [*DATED, "max_day"]}
    found = leaks.leaking_queries(spark, chosen, SF, "events", "ts", feed.AS_OF)
    assert found.pop("max_day") > 0  # the control: it is no dated output, and reads all days
    assert found == dict.fromkeys(DATED, 0)


def test_a_planted_leak_is_caught_at_earlier_days(spark):
    facts = tables.events(spark, SF)

    def leak(rows, as_of):
        """The feed with an attribute that is not cut at the day."""
        later = rows.where("type = 'view'").groupBy("user_id").agg(F.max_by("k", F.struct("published_at", "event_id")).alias("later"))
        return feed.feed_of(rows, as_of).join(later, "user_id", "left")

    found = leaks.leaking({"feed": feed.feed_of, "leak": leak}, facts, "published_at", ["2024-01-11", "2024-01-18"])
    assert found and {name for name, _, _ in found} == {"leak"}


def test_draws_with_replacement(spark):
    keys = spark.range(30).select((F.col("id") % 10).alias("k")).repartition(5).unionByName(spark.createDataFrame([(None,)], "k long"))
    got = leaks.draws(keys, "k", 2000, "s").collect()
    assert sorted(r.draw for r in got) == list(range(2000))
    times = collections.Counter(r.k for r in got)
    assert set(times) == set(range(10)) and all(150 < n < 250 for n in times.values())
    assert leaks.draws(keys.limit(0), "k", 5, "s").collect() == []
