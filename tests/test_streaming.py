from custodia.plans import start_movement
from custodia.streaming import stream_movement


def test_stream_appends_each_staged_file_once(spark, scratch):
    staging, target = f"{scratch}/staging", f"{scratch}/target"
    ckpt = f"{scratch}/ckpt"
    a = spark.createDataFrame([(1, None), (2, 2.0)], "patientId long, fibrinogen_value double")
    start_movement(a, staging, mode="append")
    q = stream_movement(spark, staging, target, checkpoint=ckpt)
    q.awaitTermination()
    assert spark.read.parquet(target).count() == 2
    # re-running with nothing new staged appends nothing
    stream_movement(spark, staging, target, checkpoint=ckpt).awaitTermination()
    assert spark.read.parquet(target).count() == 2
    # a second staged batch is picked up exactly once
    b = spark.createDataFrame([(3, None)], "patientId long, fibrinogen_value double")
    start_movement(b, staging, mode="append")
    stream_movement(spark, staging, target, checkpoint=ckpt).awaitTermination()
    out = spark.read.parquet(target)
    assert out.count() == 3
    assert out.where("fibrinogen_value IS NULL").count() == 0


def test_continuous_stream_picks_up_new_staged_files(spark, scratch):
    staging, target, ckpt = f"{scratch}/staging", f"{scratch}/target", f"{scratch}/ckpt"
    schema = "patientId long, fibrinogen_value double"
    start_movement(spark.createDataFrame([(1, 1.0)], schema), staging, mode="append")
    q = stream_movement(spark, staging, target, checkpoint=ckpt, available_now=False,
                        max_files_per_trigger=1, processing_time="1 second")
    try:
        q.processAllAvailable()
        start_movement(spark.createDataFrame([(2, None), (3, 3.0)], schema), staging, mode="append")
        q.processAllAvailable()
    finally:
        q.stop()
    out = spark.read.parquet(target)
    assert sorted(r.patientId for r in out.collect()) == [1, 2, 3]
    assert out.where("fibrinogen_value IS NULL").count() == 0


def test_batch_finish_refuses_a_stream_target(spark, scratch):
    import pytest

    from custodia.plans import MovementError, finish_movement

    staging, target = f"{scratch}/staging", f"{scratch}/target"
    start_movement(spark.createDataFrame([(1, 1.0)], "patientId long, fibrinogen_value double"),
                   staging, mode="append")
    stream_movement(spark, staging, target, checkpoint=f"{scratch}/ckpt").awaitTermination()
    with pytest.raises(MovementError):
        finish_movement(spark, staging, target)
    assert spark.read.parquet(target).count() == 1


def test_stream_refuses_a_batch_target(spark, scratch):
    import pytest

    from custodia.plans import MovementError

    staging, target = f"{scratch}/staging", f"{scratch}/target"
    df = spark.createDataFrame([(1, 1.0)], "patientId long, fibrinogen_value double")
    start_movement(df, staging, mode="append")
    df.write.parquet(target)
    with pytest.raises(MovementError):
        stream_movement(spark, staging, target, checkpoint=f"{scratch}/ckpt")
    assert spark.read.parquet(target).count() == 1
