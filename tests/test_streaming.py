"""The streaming event feed equals the batch flatteners and is idempotent."""

from pyspark.sql import functions as F

from liftlake.plans.landing_queries import run_ts
from liftlake.sources import landing
from liftlake.operators import flatten, validate
from liftlake.sources.sinks import scratch_path
from liftlake.streaming.event_feed import land_event_pages, run_event_feed
from tests.conftest import SF_SMALL


def test_event_feed_stream_matches_batch(spark):
    base = scratch_path(spark, "test-feed")
    land_event_pages(spark, SF_SMALL, f"{base}/landing")
    upd, dele = run_event_feed(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt", run_ts())
    items = landing.parse_pages(landing.landed_event_pages(spark, SF_SMALL), "events")
    want_upd = flatten.updated_events_flat(validate.validate_events(items)[0], run_ts())
    want_del = flatten.deleted_events(items)
    assert sorted(map(str, upd.collect())) == sorted(map(str, want_upd.select(*upd.columns).collect()))
    assert sorted(map(str, dele.collect())) == sorted(map(str, want_del.select(*dele.columns).collect()))
    rejects = spark.read.parquet(f"{base}/out/rejects").drop("batch_id")
    want_rej = validate.validate_events(items)[1]
    assert rejects.count() == want_rej.count() > 0
    # a second run over the same landing folder finds nothing new: no duplicates
    upd2, _ = run_event_feed(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt", run_ts())
    assert upd2.count() == upd.count()
    assert upd.filter(F.col("event_type") != "updated").count() == 0
