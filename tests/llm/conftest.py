import pytest


@pytest.fixture()
def documents(spark):
    """Makes a documents table of (doc_id, text) rows, with columns whose names clash with those that operators add."""

    def make(rows):
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long, "
            "size int, taken string, fingerprint string, component_id string, key string, node string, score string"
        )
        full = [(i, t, "en", f"s{(i or 0) % 2}", None if t is None else len(t), 1, "x", "x", "x", "x", "x", "x") for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture()
def launched(spark):
    """Runs a function with 64 partitions a shuffle: jobs, and tasks of their stages."""
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}

    def run(function, group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            for k, v in changed.items():
                spark.conf.set(k, v)
            function()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
            spark.sparkContext._jsc.clearJobGroup()
        tracker = spark.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup(group)
        stages = {s: tracker.getStageInfo(s) for j in jobs for s in tracker.getJobInfo(j).stageIds}
        return len(jobs), sum(s.numCompletedTasks for s in stages.values() if s)

    return run
