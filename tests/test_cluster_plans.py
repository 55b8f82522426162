from nightledger.operators import cluster, stats


def test_summaries_of_clusters_broadcast_no_table(spark, tmp_path):
    """Targets and totals look small here, as a compressed file does, and grow with the input."""
    spark.createDataFrame([(i, f"t{i}", 10.0 + (i // 3) * 20, 5.0) for i in range(9)], "id long, name string, ra_deg double, dec_deg double").write.parquet(f"{tmp_path}/targets")
    targets = spark.read.parquet(f"{tmp_path}/targets")
    observations = spark.createDataFrame([(i % 5, 60.0, 2, None) for i in range(20)], "target_id long, exposure_time double, frame_count int, observation_date date")
    found = cluster.cluster_summary(cluster.cluster_targets(targets, 1.0, 1), targets, stats.target_totals(observations))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.cluster, r.members, r.exposure, r.name) for r in found.collect())
    assert rows == [(0, 3, 720.0, "t0"), (3, 3, 480.0, "t3"), (6, 3, 0.0, "t6")]
