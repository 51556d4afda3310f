"""A small catalog: logical table name -> Spark source.

Every load returns a lazy DataFrame; Catalyst pushes the caller's
filters and projections into the Parquet or JDBC scan.
"""

from __future__ import annotations

from typing import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from custodia.functions.sealing import COLUMN_KEYS, CRYPTO_FACTORY, KEYSTORE, seal, split_options, unseal
from custodia.model import TableSpec

Builder = Callable[[SparkSession], DataFrame]

# The reference's source-type names ("s3a" is Parquet on an
# object store) and the Spark reader formats they map to.
_FORMAT_ALIASES = {"s3a": "parquet"}


class Catalog:
    """Logical names to table sources.

    Entries are ``TableSpec`` (a Spark data source) or builders
    (``spark -> DataFrame``) for tables derived from other tables.
    Unknown names raise ``KeyError`` instead of yielding an empty frame.
    """

    def __init__(self, specs: Mapping[str, TableSpec | Builder] | None = None):
        self._entries: dict[str, TableSpec | Builder] = dict(specs or {})

    @classmethod
    def from_maps(cls, locations: Mapping[str, str], types: Mapping[str, str],
                  jdbc: Mapping[str, str] | None = None,
                  partitioning: Mapping[str, Mapping[str, str]] | None = None) -> "Catalog":
        """Catalog from location and type maps: ``locations[name]`` is a path
        (or a JDBC table), ``types[name + "_type"]`` is ``s3a``/``parquet``/
        another Spark file format or ``jdbc``; ``jdbc`` holds ``url``,
        ``user``, ``password`` (and any other JDBC option). A table without a
        known type is an error here, not an empty frame later.

        ``partitioning[name]`` adds per-table reader options; for a large JDBC
        table give ``partitionColumn``/``lowerBound``/``upperBound``/
        ``numPartitions`` so it is read over that many connections instead of
        one."""
        specs: dict[str, TableSpec] = {}
        for name, location in locations.items():
            kind = types.get(f"{name}_type")
            if not kind:
                raise KeyError(f"no type configured for table {name!r}")
            options = dict(jdbc or {}) if kind == "jdbc" else {}
            options.update((partitioning or {}).get(name, {}))
            if kind == "jdbc" and "url" not in options:
                raise ValueError(f"table {name!r} is jdbc but no jdbc url is configured")
            specs[name] = TableSpec(name, kind, location, options)
        return cls(specs)

    def register(self, name: str, entry: TableSpec | Builder) -> "Catalog":
        self._entries[name] = entry
        return self

    def names(self) -> list[str]:
        return sorted(self._entries)

    def __contains__(self, name: str) -> bool:
        return name in self._entries

    def spec(self, name: str) -> TableSpec | Builder:
        try:
            return self._entries[name]
        except KeyError:
            raise KeyError(f"table {name!r} is not in the catalog") from None

    def load(self, spark: SparkSession, name: str, **options: str) -> DataFrame:
        """Lazy DataFrame for a logical table; ``options`` go to the reader
        (for example decryption properties of a governed plan). Sealed columns
        are opened with the keystore that the options name; without their key
        their cells are NULL."""
        entry = self.spec(name)
        if not isinstance(entry, TableSpec):
            df = entry(spark)
            required: tuple[str, ...] = ()
        else:
            fmt = _FORMAT_ALIASES.get(entry.format, entry.format)
            given = {**entry.options, **options}
            store = given.pop(KEYSTORE, None)
            if CRYPTO_FACTORY not in given:
                given.pop(COLUMN_KEYS, None)
            reader = spark.read.format(fmt).options(**given)
            if entry.schema and fmt != "jdbc":
                reader = reader.schema(entry.schema)
            if fmt == "jdbc":
                df = reader.option("dbtable", entry.location).load()
            else:
                df = unseal(reader.load(entry.location), store)
            required = entry.required_columns
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"table {name!r} lacks required columns {missing}")
        return df

    def save(self, df: DataFrame, name: str, mode: str = "append",
             partition_by: list[str] | None = None, **options: str) -> None:
        """Write a DataFrame to a catalog table (Parquet/ORC/... or JDBC)."""
        entry = self.spec(name)
        if not isinstance(entry, TableSpec):
            raise TypeError(f"table {name!r} is derived and cannot be written")
        fmt = _FORMAT_ALIASES.get(entry.format, entry.format)
        sealing, rest = split_options({**entry.options, **options})
        if sealing and fmt == "jdbc":
            raise ValueError("columns of a database table cannot be sealed")
        writer = seal(df, sealing).write.format(fmt).mode(mode).options(**rest)
        if fmt == "jdbc":
            writer.option("dbtable", entry.location).save()
            return
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(entry.location)


def parquet_catalog(directory: str, names: list[str]) -> Catalog:
    """Catalog of ``<directory>/<name>.parquet`` tables."""
    return Catalog({n: TableSpec(n, "parquet", f"{directory}/{n}.parquet") for n in names})
