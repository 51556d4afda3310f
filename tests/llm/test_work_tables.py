"""What the operators store on the way goes as soon as it is used."""

import os
import time

from pyspark.sql import functions as F


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for top in manager.localDirs() for _, _, names in os.walk(top.getPath())
            for name in names if name.startswith("shuffle_")}


def test_a_kept_table_leaves_no_shuffle_files(spark):
    from custodia.llm.tables import kept

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name, None), shuffle_files(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    stored = kept(rows)
    end = time.time() + 10
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(name, None) == setting
    assert sorted(map(tuple, stored.collect())) == sorted((k, len(range(k, 1000, 7))) for k in range(7))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, stored.collect()))


def test_a_table_that_stays_outlasts_its_block(spark):
    from custodia.llm.tables import kept, removed_after

    there = lambda df: all(os.path.exists(f.removeprefix("file:")) for f in df.inputFiles())
    with removed_after(spark):
        with removed_after(spark) as stays:
            a = kept(spark.range(3))
            files = [f.removeprefix("file:") for f in a.inputFiles()]
            b = stays(a.union(spark.range(2)))
        assert not any(os.path.exists(f) for f in files)
        kept_files = [f.removeprefix("file:") for f in b.inputFiles()]
        assert there(b) and b.count() == 5
    assert not any(os.path.exists(f) for f in kept_files)
    with removed_after(spark) as stays:
        c = stays(spark.range(4))
    assert there(c) and c.count() == 4


def test_whole_sets_of_compared_texts_are_removed(spark):
    from custodia.llm import jaccard_join
    from custodia.llm.tables import ensure_checkpoint_dir

    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[::-1]), None, "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = jaccard_join.jaccard_components(docs)
    columns = [spark.read.parquet(f"{folder}/{x}").columns for x in set(os.listdir(folder)) - before]
    assert columns and ["set", "value"] not in columns
    assert sorted(map(tuple, got.select("doc_id", "component_id").collect())) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4)]
