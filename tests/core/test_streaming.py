from pulsegrid.functions.rules import WindowRule
from pulsegrid.operators import windows
from pulsegrid.streaming.live_windows import average_over, flag_stream
from tests.core.test_mining import SCHEMA, frame, make


def test_stream_equals_batch(spark, tmp_path):
    rows = make(90, 11)
    for part in range(3):  # three micro-batches, cut inside runs; the second repeats some readings
        frame(spark, rows[max(0, part * 30 - 3 * (part == 1)) : part * 30 + 30]).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = (
        flag_stream(stream, 3, "abs_error", average_over(5))
        .writeStream.format("memory").queryName("live").outputMode("append")
        .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    )
    assert query.awaitTermination(100)
    got = sorted((r.start_iteration, r.end_iteration) for r in spark.table("live").collect())
    batch = windows.listing(frame(spark, rows), WindowRule("abs_standard", 3, standard=5, guard=None))
    assert got == sorted((r.start_iteration, r.end_iteration) for r in batch.collect()) and got
