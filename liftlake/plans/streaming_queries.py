"""Registered streaming queries: the event feed run as a stream over landed
pages; results must equal the batch flatteners (same oracle)."""

from __future__ import annotations

from liftlake.plans.landing_queries import RUN, run_ts
from liftlake.plans.registry import REGISTRY, query
from liftlake.sources.sinks import scratch_path
from liftlake.streaming.event_feed import land_event_pages, run_event_feed


def _run(spark, d):
    base = scratch_path(spark, "event-feed")
    land_event_pages(spark, d, f"{base}/landing")
    return run_event_feed(spark, f"{base}/landing", f"{base}/out", f"{base}/checkpoint", run_ts())


_UPD_SQL = REGISTRY["updated_events_flat"].sql
_DEL_SQL = REGISTRY["deleted_events"].sql
assert RUN


@query("event_feed_stream_updated")
def q_event_feed_stream_updated(spark, d):
    return _run(spark, d)[0]


@query("event_feed_stream_deleted")
def q_event_feed_stream_deleted(spark, d):
    return _run(spark, d)[1]


REGISTRY["event_feed_stream_updated"].sql = _UPD_SQL
REGISTRY["event_feed_stream_deleted"].sql = _DEL_SQL
