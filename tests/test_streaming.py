from loomgraph.streaming import queues


def collected(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return spark.table(name).collect()


def test_tickets(spark, tmp_path):
    rows = [(1, 0, "claim", None), (1, 1, "submit", "error"), (2, 0, "submit", None), (3, 0, "claim", None)]
    spark.createDataFrame(rows, "ticket_id long, pos long, kind string, outcome string").write.json(str(tmp_path / "in"))
    events = spark.readStream.schema("ticket_id long, pos long, kind string, outcome string").json(str(tmp_path / "in"))
    got = {r["ticket_id"]: r["status"] for r in collected(spark, queues.ticket_states(events), "tickets_now", "update")}
    assert got == {1: "failed", 2: "pending", 3: "claimed"}


def test_days(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("CAST(ts AS timestamp) AS ts", "event_type", "value")
    rows.write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    got = collected(spark, queues.daily_counts(events), "days_now", "complete")
    assert sum(r["n"] for r in got) == rows.count()
