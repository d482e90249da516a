"""The online plane: running distinct clients per link value, and rings, on Structured Streaming.

Late rows within the watermark are ordered by (time, id) inside their micro-batch; memberships given
earlier are never rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.ship import ship_package
from coterie.operators import rings
from coterie.sources.adapters import ID, TIME


def stream_files(spark, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def gate_stream(links: DataFrame, max_shared: int = rings.MAX_SHARED, watermark: str = "10 minutes") -> DataFrame:
    """Links with ``seen`` and ``eligible``; state per (attribute, value) is at most ``max_shared + 1`` clients.

    ``links``: TransactionID, TransactionDT, client_id, attr, value.
    """
    import pandas as pd

    ship_package(links.sparkSession)
    cap = max_shared + 1

    def step(key, frames, state):
        clients = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(frames)).sort_values([TIME, ID], kind="stable")
        for i, t, c in zip(rows[ID], rows[TIME], rows["client_id"]):
            if c not in clients and len(clients) < cap:
                clients.append(c)
            out.append((int(i), int(t), c, key[0], key[1], len(clients), len(clients) <= max_shared))
        state.update((clients,))
        yield pd.DataFrame(out, columns=[ID, TIME, "client_id", "attr", "value", "seen", "eligible"])

    timed = links.withColumn("_ts", F.timestamp_seconds(TIME)).withWatermark("_ts", watermark)
    return timed.groupBy("attr", "value").applyInPandasWithState(
        step, f"{ID} bigint, {TIME} bigint, client_id string, attr string, value string, seen int, eligible boolean",
        "clients array<string>", "append", "NoTimeout",
    )


def ring_state_batch(path: str, attrs, max_shared: int = rings.MAX_SHARED, max_ring: int = rings.MAX_RING):
    """A foreachBatch function: keeps all rows seen in a table and writes the new rows' rings.

    Components merge, so no key can shard their state for good; the state is the table of transactions,
    and a batch is replayed with it.  Equal to the batch plan on the same rows, as prefixes are stable.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        seen = spark.read.parquet(f"{path}/rows").where(F.col("epoch") <= epoch).drop("epoch")
        new = spark.read.parquet(f"{path}/rows/epoch={epoch}").select(ID)
        rings.assign_rings_causally(seen, attrs, max_shared, max_ring).join(new, ID, "left_semi").write.mode("overwrite").parquet(
            f"{path}/rings/epoch={epoch}"
        )

    return step


def windowed_labels(events: DataFrame, lag: str = "30 days", window: str = "1 day") -> DataFrame:
    """Frauds by ring and day of becoming known (time + lag)."""
    known = events.where("isFraud = 1").withColumn("_known", F.timestamp_seconds(TIME) + F.expr(f"INTERVAL {lag}"))
    return known.withWatermark("_known", "1 day").groupBy("ring_id", F.window("_known", window)).agg(F.count(F.lit(1)).alias("known_frauds"))
