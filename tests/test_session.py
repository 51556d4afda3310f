import pytest

from custodia.session import RECOMMENDED_CONF, ensure_checkpoint_dir, scale_conf


def test_scale_conf_grows_with_data_and_is_capped():
    small = scale_conf(1 << 30)
    assert small["spark.sql.shuffle.partitions"] == "200"
    big = scale_conf(100 * 10**12)
    assert big["spark.sql.shuffle.partitions"] == "100000"
    mid = scale_conf(1 << 40)  # 1 TiB / 256 MiB
    assert mid["spark.sql.shuffle.partitions"] == "4096"
    assert set(RECOMMENDED_CONF) <= set(mid)
    with pytest.raises(ValueError):
        scale_conf(1, partition_bytes=0)


def test_checkpoint_dir_is_read_from_the_session(spark):
    path = ensure_checkpoint_dir(spark)
    assert path and ensure_checkpoint_dir(spark) == path
