"""Plain data holders shared by the operators (no Spark work here)."""

from __future__ import annotations

import enum
import json
from dataclasses import dataclass, field
from typing import Any, Mapping


class Zone(enum.IntEnum):
    """Privacy zone of the store a query runs against."""

    PUBLIC = 0
    PRIVATE = 1
    ON_PREM = 2

    @classmethod
    def parse(cls, value: "Zone | str | int | None") -> "Zone":
        """Unknown or missing names resolve to ON_PREM."""
        if isinstance(value, Zone):
            return value
        if isinstance(value, int):
            return cls(value)
        if value:
            try:
                return cls[str(value).upper()]
            except KeyError:
                pass
        return cls.ON_PREM

    @property
    def access(self) -> str:
        """Access type sent to the policy for a read in this zone."""
        return "read_public_cloud" if self is Zone.PUBLIC else "read"


@dataclass(frozen=True)
class TableSpec:
    """A logical table: name, source format, location and reader options.

    ``format`` is a Spark data source name (``parquet``, ``jdbc``, ``orc``,
    ``json``, ``csv``) or ``s3a`` as an alias for Parquet.
    For ``jdbc`` the location is the ``dbtable`` and ``options`` carries
    ``url``/``user``/``password`` plus, for parallel reads,
    ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``.
    """

    name: str
    format: str
    location: str
    options: Mapping[str, str] = field(default_factory=dict)
    required_columns: tuple[str, ...] = ()
    schema: str | None = None  # DDL; when given, reads skip schema inference


@dataclass(frozen=True)
class PolicyRequest:
    """What is sent to the policy decision point; ``access`` is ``read``,
    ``read_public_cloud`` or, to finish a movement, ``write``."""

    query: str
    purpose: str
    access: str
    requester_id: str = ""


@dataclass(frozen=True)
class GovernedPlan:
    """A policy decision: the SQL to run, the tables it needs, and the
    options (for example Parquet encryption keys) for reads and writes.
    For an export, which runs no SQL text, ``rules`` names the consent column
    that each governed column needs."""

    sql: str
    tables: tuple[str, ...]
    write_options: Mapping[str, str] = field(default_factory=dict)
    rules: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> "GovernedPlan":
        """Parse a policy response document::

            {"rewrittenQuery": "...", "tables": [{"name": "..."}],
             "encryptionProperties": [{"key": "...", "value": "..."}]}
        """
        doc: dict[str, Any] = json.loads(text)
        sql = doc.get("rewrittenQuery")
        if not sql:
            raise PermissionError("policy response carries no query")
        tables = tuple(t["name"] for t in doc.get("tables", []))
        props = {p["key"]: p["value"] for p in doc.get("encryptionProperties", [])}
        return cls(sql=sql, tables=tables, write_options=props)
