"""Tables laid out by subject: joins by subject that move no measurement.

A fact table is written once in buckets of its key, sorted within them; the
per-subject tables get the same buckets. Spark then joins bucket with bucket
where the files lie, without dealing the rows out again. The layout is a
folder of Parquet files with a small note; any session declares it as a table
of its own (in-memory) catalog, no metastore needed.

A subject with a large share of all rows would fill one bucket, and so would
rows without a subject. Such keys (``SkewPolicy``) are written beside the
buckets, spread over files, and ``parts`` gives them apart; joins spread them
over salts. Both parts together are the table.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.operators.skew import DEFAULT_SKEW, SkewPolicy, find_hot_keys
from custodia.sources.files import Folders

_NOTE = "_layout.json"


def buckets_for(table_bytes: int, bucket_bytes: int = 1 << 30, most: int = 100_000) -> int:
    """Buckets of about ``bucket_bytes``; Spark allows ``most``."""
    return max(1, min(most, -(-table_bytes // bucket_bytes)))


@dataclass(frozen=True)
class BucketedTable:
    """A table in buckets of ``key``; ``hot`` are the keys beside them."""

    folder: str
    key: str
    buckets: int
    schema: str
    hot: Mapping = field(default_factory=dict)

    def cold(self, spark: SparkSession) -> DataFrame:
        """The bucketed rows: a scan that knows its partitioning."""
        name = "custodia_" + hashlib.sha256(f"{self.folder}|{self.key}|{self.buckets}".encode()).hexdigest()[:24]
        if not spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._type().fields)
            place = self.folder.replace("'", "\\'")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) "
                      f"SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{place}/cold'")
        return spark.table(name)

    def beside(self, spark: SparkSession) -> DataFrame | None:
        """The rows of the hot keys, if there are any."""
        return spark.read.schema(self._type()).parquet(f"{self.folder}/hot") if self.hot else None

    def read(self, spark: SparkSession) -> DataFrame:
        rows, beside = self.cold(spark), self.beside(spark)
        return rows if beside is None else rows.unionByName(beside)

    def over_parts(self, spark: SparkSession,
                   operator: Callable[[DataFrame, SkewPolicy | None, Mapping], DataFrame],
                   skew: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
        """``operator(rows, skew, hot)`` of an operator that treats each row
        by itself (joins by subject, masks): on the buckets as a plain join,
        on the hot keys with their salts."""
        out, beside = operator(self.cold(spark), None, {}), self.beside(spark)
        return out if beside is None else out.unionByName(operator(beside, skew, self.hot))

    def _type(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


def _is_one_of(key: str, keys: Mapping) -> Column:
    known = [k for k in keys if k is not None]
    c = F.col(f"`{key}`")
    hit = c.isin(known) if known else F.lit(False)
    return F.coalesce(hit, F.lit(False)) | c.isNull() if None in keys else F.coalesce(hit, F.lit(False))


def write_bucketed(df: DataFrame, folder: str, key: str, buckets: int,
                   skew: SkewPolicy | None = DEFAULT_SKEW) -> BucketedTable:
    """Lay ``df`` out in ``folder`` (new). One shuffle, one file a bucket.
    ``skew=None`` for a table with about one row per key."""
    spark = df.sparkSession
    if key not in df.columns:
        raise ValueError(f"the table has no column {key}")
    if not 1 <= buckets <= 100_000:
        raise ValueError("buckets must lie between 1 and 100000")
    hot = {} if skew is None else find_hot_keys(df, key, skew)
    folders = Folders(spark)
    if folders.exists(folder):
        raise FileExistsError(folder)
    cold = df.where(~_is_one_of(key, hot)) if hot else df
    made = "custodia_new_" + hashlib.sha256(folder.encode()).hexdigest()[:24]
    (cold.repartition(buckets, F.col(f"`{key}`")).write.bucketBy(buckets, key).sortBy(key)
     .option("path", f"{folder}/cold").saveAsTable(made))
    spark.sql(f"DROP TABLE {made}")                    # external: its files stay
    if hot:
        df.where(_is_one_of(key, hot)).write.parquet(f"{folder}/hot")
    # columns come back nullable
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    table = BucketedTable(folder, key, buckets, schema.json(), hot)
    folders.write_text(f"{folder}/{_NOTE}", json.dumps({
        "key": key, "buckets": buckets, "schema": schema.json(), "hot": list(map(list, hot.items()))}))
    return table


def open_bucketed(spark: SparkSession, folder: str) -> BucketedTable:
    """A table that ``write_bucketed`` has finished; the note is written last."""
    folders = Folders(spark)
    if not folders.exists(f"{folder}/{_NOTE}"):
        raise FileNotFoundError(f"{folder} holds no finished bucketed table")
    note = json.loads(folders.read_text(f"{folder}/{_NOTE}"))
    return BucketedTable(folder, note["key"], note["buckets"], note["schema"], {k: s for k, s in note["hot"]})
