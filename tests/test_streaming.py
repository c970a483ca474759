"""Run states as a stream: any split of a log into batches gives what the batch query gives, over restarts too."""

import random

import pytest

from riskweave.operators import workflow
from riskweave.streaming import stage_log

KIND = "run long, seq long, kind string"


def log_of(seed, n=160):
    rng = random.Random(seed)
    kinds = ["start", "complete_stage", "complete_stage", "complete_stage", "reset", "fail", "cancel", "complete", "other"]
    return [(rng.randint(0, 9), i, rng.choices(kinds, [3, 8, 8, 8, 2, 1, 1, 1, 2])[0]) for i in range(n)]


@pytest.mark.parametrize("seed, cuts", [(1, [160]), (2, [40, 41, 100, 160]), (3, list(range(20, 161, 20)))])
def test_streamed_states_are_the_batch_states(spark, tmp_path, seed, cuts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, latest = log_of(seed), {}
    source, check = tmp_path / "in", tmp_path / "check"
    source.mkdir()

    def keep(batch, _):
        latest.update({r["run"]: tuple(r) for r in batch.collect()})

    for a, b in zip([0, *cuts], cuts):  # every part is a query of its own, which starts from the checkpoint
        spark.createDataFrame(rows[a:b], KIND).coalesce(1).write.mode("append").parquet(str(source))
        stream = stage_log.run_states(spark.readStream.schema(KIND).parquet(str(source)))
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(check)).foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None and not query.isActive
    want = {r["run"]: tuple(r) for r in workflow.run_states(spark.createDataFrame(rows, KIND)).collect()}
    assert latest == want
