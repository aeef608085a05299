"""The metric catalogue, the ports document and what streams do with late rows and idle keys."""

import json
import time

import pytest
from pyspark.sql import functions as F

from vigil.operators import catalogue, sinks
from vigil.sources import ingest
from vigil.sources.builtin_ports import BUILTIN
from vigil.streaming import state


def test_catalogue_names():
    names = catalogue.families()
    assert len(names) == len(set(names)) == 118
    assert catalogue.kind("instance_disk_read_gbytes_total") == "counter"
    assert catalogue.kind("host_mem_mb_total") == "gauge"


def test_long_table_and_its_files(spark, tmp_path):
    wide = spark.sql("SELECT 'h' AS host_id, timestamp'2024-01-01 00:00:00' AS snapshot_ts, 'i' AS instance, 'tor_exit' AS list, 7 AS contacts_total, CAST(NULL AS INT) AS active_flows")
    rows = catalogue.emit({"threats": wide}, prefix="x_")
    assert [(r.metric, r.type, r.value, r.labels) for r in rows.collect()] == [("x_instance_threat_tor_exit_contacts_total", "counter", 7.0, {"instance": "i"})]
    sinks.write_metrics(rows, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == 1 and str(back.first().date) == "2024-01-01"


@pytest.mark.parametrize(
    ("text", "status", "source"),
    [
        (None, "missing", "builtin"), ("{", "parse_error", "builtin"), ("{}", "invalid", "builtin"),
        ({"inbound_monitored": {"0": "zero"}}, "invalid", "builtin"), ({"inbound_monitored": {"x": "word"}}, "invalid", "builtin"),
        ({"inbound_monitored": {"80": " "}}, "invalid", "builtin"), ({"inbound_monitored": {"80": " web "}}, "loaded", "mixed"),
        ({"inbound_monitored": {"80": "web"}, "outbound_monitored": {"53": "dns"}}, "loaded", "file"),
    ],
)
def test_ports_document(spark, tmp_path, text, status, source):
    path = tmp_path / "ports.json"
    if text is not None:
        path.write_text(text if isinstance(text, str) else json.dumps({"behavior": {"ports": text}}))
    config, read = ingest.ports_file(spark, str(path))
    ports, got, using = ingest.monitored_ports(spark, config, BUILTIN, read)
    assert (got, using) == (status, source)
    if status == "loaded":
        assert ports.where("direction = 'inbound'").select("port", "name").collect() == [(80, "web")]
    else:
        assert ports.count() == sum(map(len, BUILTIN.values()))


def test_no_ports_document(spark):
    assert ingest.monitored_ports(spark, *ingest.ports_file(spark, " ")[:1], BUILTIN)[1:] == ("not_configured", "builtin")


def test_late_rows_go_and_idle_state_ends(spark, tmp_path):
    """Three files in turn: the second carries the watermark on, so the third's old row is late and key a has lost its state."""
    source = tmp_path / "in"
    for n, rows in enumerate([[("a", 0), ("a", 5)], [("b", 14_400)], [("c", 14_401)], [("a", 100), ("a", 14_460)]]):
        spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds(F.col("s") + 1_704_067_200).alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        (file,) = (tmp_path / f"part{n}").glob("*.parquet")
        source.mkdir(exist_ok=True)
        file.rename(source / f"{n}.parquet")
        time.sleep(1.1)  # files are taken by the time of their change

    def step(held: dict, row: dict) -> dict:
        held["n"] = held.get("n", 0) + 1
        return {"n": held["n"]}

    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    counted = state.stateful(state.on_time(stream, "ts"), ["k"], "ts", step, "n int", ttl_s=3600)
    seen = []
    counted.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(
        lambda batch, _: seen.extend((r.k, int(r.ts.timestamp()) - 1_704_067_200, r.n) for r in batch.collect())
    ).start().awaitTermination()
    assert sorted(seen) == [("a", 0, 1), ("a", 5, 2), ("a", 14_460, 1), ("b", 14_400, 1), ("c", 14_401, 1)]
