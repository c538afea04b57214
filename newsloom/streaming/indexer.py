"""Incremental vector index and feed sessions as Structured Streaming jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import pending_vectors, upsert_vectors


def index_stream(items: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Embeds items that are not stored yet, batch by batch; ``embed`` adds the vector columns.

    ``items``: item_id, item_hash, model, published_at, title, source_name and
    what ``embed`` reads.  A replayed batch finds its keys stored and adds nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = pending_vectors(batch.dropDuplicates(["item_id", "item_hash", "model"]), path)
        upsert_vectors(embed(new).select("item_id", "item_hash", "model", "published_at", "title", "source_name", "embedding"), path)

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SESSION_OUT = "user_id string, page long, events array<string>, has_more boolean"
SESSION_STATE = "state string"


def session_stream(requests: DataFrame, ttl_ms: int = 1_800_000) -> DataFrame:
    """Pages of requests (user_id, at, most, offered array<string>): events offered and not yet delivered, in order.

    State per user: delivered and pending event ids and the time of the last
    request (``at``, in milliseconds); a request more than ``ttl_ms`` later
    begins anew.  The state of a user without a request for that long is removed
    as the watermark, ``ttl_ms`` behind the newest request, passes it; requests
    from before the watermark are too late and dropped.
    """

    def serve(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {"delivered": [], "pending": [], "page": 0, "at": None}
        rows = []
        requests_now = pd.concat(list(frames)).sort_values("at")
        for r in requests_now.to_dict("records"):
            if held["at"] is not None and int(r["at"]) - held["at"] > ttl_ms > 0:
                held = {"delivered": [], "pending": [], "page": 0, "at": None}
            held["at"] = int(r["at"])
            known = set(held["delivered"]) | set(held["pending"])
            held["pending"] += [e for e in dict.fromkeys(r["offered"]) if e not in known]
            page, held["pending"] = held["pending"][: r["most"]], held["pending"][r["most"] :]
            held["delivered"] += page
            rows.append((key[0], held["page"], page, bool(held["pending"])))
            held["page"] += 1
        state.update((json.dumps(held),))
        if ttl_ms > 0:
            state.setTimeoutTimestamp(held["at"] + ttl_ms)
        yield pd.DataFrame(rows, columns=["user_id", "page", "events", "has_more"])

    if ttl_ms > 0:
        requests = requests.withColumn("_at", F.timestamp_millis(F.col("at"))).withWatermark("_at", f"{ttl_ms} milliseconds")
    return requests.groupBy("user_id").applyInPandasWithState(serve, SESSION_OUT, SESSION_STATE, "append", "EventTimeTimeout" if ttl_ms > 0 else "NoTimeout")


def replay(source: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All a stream has now, through a memory table."""
    query = source.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return source.sparkSession.table(name).where(F.lit(True))
