"""Ring state by micro-batch equals the batch plan; late rows rewrite nothing; labels count once known."""

from pyspark.sql import functions as F

from coterie.operators import rings
from coterie.operators.entity import resolve
from coterie.streaming.plane import gate_stream, ring_state_batch, stream_files, windowed_labels

ATTRS = ("addr1",)


def test_ring_state_equals_batch(spark, planted, tmp_path):
    d = resolve(planted.where("TransactionID < 300")).select("TransactionID", "TransactionDT", "client_id", "addr1")
    cut = d.approxQuantile("TransactionDT", [0.5], 0.0)[0]
    step = ring_state_batch(f"file://{tmp_path}", ATTRS)
    step(d.where(F.col("TransactionDT") <= cut), 0)
    step(d.where(F.col("TransactionDT") > cut), 1)
    step(d.where(F.col("TransactionDT") > cut), 1)  # a batch that is given again replaces itself
    got = {r["TransactionID"]: r["ring_id"] for r in spark.read.parquet(f"file://{tmp_path}/rings").collect()}
    want = {r["TransactionID"]: r["ring_id"] for r in rings.assign_rings_causally(d, ATTRS).collect()}
    assert got == want and len(got) == d.count()


def test_late_rows_are_placed_after_what_was_given(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    kind = "TransactionID bigint, TransactionDT bigint, client_id string, attr string, value string"

    def drain(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        q = gate_stream(stream_files(spark, src, kind, 10), max_shared=1).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", f"file://{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return {r["TransactionID"]: (r["seen"], r["eligible"]) for r in spark.read.parquet(out).collect()}

    first = drain([(2, 200, "b", "x", "v"), (1, 100, "a", "x", "v")])
    assert first == {1: (1, True), 2: (2, False)}
    assert drain([(0, 150, "a", "x", "v"), (3, 300, "c", "x", "w")]) == first | {0: (2, False), 3: (1, True)}


def test_labels_count_in_the_window_they_become_known_in(spark):
    day = 86400
    d = spark.createDataFrame([("r", 0, 1), ("r", day // 2, 1), ("r", 2 * day, 1), ("r", 0, 0), ("s", 0, 1)], "ring_id string, TransactionDT bigint, isFraud int")
    got = {(r["ring_id"], r["day"]): r["known_frauds"] for r in windowed_labels(d).select("ring_id", (F.unix_timestamp("window.start") / day).cast("int").alias("day"), "known_frauds").collect()}
    assert got == {("r", 30): 2, ("r", 32): 1, ("s", 30): 1}
