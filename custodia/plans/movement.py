"""Data movement between privacy zones: stage, then append to the target.

``start_movement`` writes a governed (usually exported) result as Parquet
to a staging path on shared storage; ``finish_movement`` reads it back,
fills configured gaps and appends it to the target. Both are single
Spark jobs; row counts and a digest of the rows come from ``observe`` on the
write itself, so the data is never computed twice. Writes go through Spark's
commit protocol, so a lost executor's tasks are re-run without duplicate
output.

What was staged is noted beside the files (folder ``_manifest``): rows, digest
and schema. A movement reads the staged files once, writes them to a hidden
folder of the target and compares what it has read with the note; only then
do they become part of the target, by a commit marker and renames. Until the
marker stands, readers see the target as it was; once it stands, the next
movement completes what a lost driver left undone (``recover``). Renames are
atomic on HDFS and local file systems; on an object store they are copies.
Movements into one target are to run one after another.

Encryption properties that name column keys and a keystore seal these columns
(``functions.sealing``); others go to the Parquet reader and writer.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from typing import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.functions.sealing import SEALED, seal, sealed_columns, split_options, unseal
from custodia.model import GovernedPlan, Zone
from custodia.plans.contents import Contents, contents_of, observed
from custodia.sources.files import Folders

# The reference fills this gap on ingest into the target zone.
DEFAULT_FILL = {"fibrinogen_value": 0.0}
MOVEMENT_COLUMN = "movement_id"
# Hidden folders (readers skip names that begin with an underscore).
MANIFEST = "_manifest"
COMMITS = "_commits"
ATTEMPT = "_attempt-"
_MANIFEST_SCHEMA = "rows long, digest string, schema string"


class MovementError(RuntimeError):
    """A movement step could not run (nothing staged, schema clash, ...)."""


@dataclass(frozen=True)
class MovementReport:
    path: str
    rows: int
    digest: str = ""

    @property
    def empty(self) -> bool:
        return self.rows == 0


def fill_present(df: DataFrame, values: Mapping[str, object] | None) -> DataFrame:
    """``na.fill`` restricted to columns the frame has (NaN is filled too);
    gaps of sealed columns stay."""
    sealed = sealed_columns(df)
    present = {c: v for c, v in (values or {}).items() if c in df.columns and c not in sealed}
    return df.na.fill(present) if present else df


def _clustered(df: DataFrame, sort_within: list[str] | None) -> DataFrame:
    # A per-task sort (no shuffle) so each Parquet row group covers a narrow
    # key range: later lookups by those keys skip row groups by min/max.
    return df.sortWithinPartitions(*sort_within) if sort_within else df


def _refuse_sealed(sealing, partition_by: list[str] | None) -> None:
    named = sorted(set(partition_by or ()) & set(sealing.keys))
    if named:
        raise ValueError(f"sealed columns cannot name folders: {named}")


def start_movement(df: DataFrame, staging: str, options: Mapping[str, str] | None = None,
                   mode: str = "overwrite", partition_by: list[str] | None = None,
                   sort_within: list[str] | None = None) -> MovementReport:
    """Stage a governed result as Parquet (``options``: e.g. encryption
    properties of the governed plan). Raises before writing a frame with
    no columns. ``mode="errorifexists"`` refuses to replace a staging path.
    The note of what was staged is written last: a stage without it is
    incomplete, and rows that came by another way do not agree with it."""
    if not df.columns:
        raise MovementError("the governed result has no columns; nothing is staged")
    sealing, rest = split_options(options)
    _refuse_sealed(sealing, partition_by)
    df, seen = observed(seal(_clustered(df, sort_within), sealing), "staged")
    w = df.write.mode(mode).option("partitionOverwriteMode", "static").options(**rest)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(staging)
    made = contents_of(seen)
    spark = df.sparkSession
    (spark.createDataFrame([(made.rows, made.digest, df.schema.json())], _MANIFEST_SCHEMA)
     .coalesce(1).write.mode("append").json(f"{staging}/{MANIFEST}"))
    return MovementReport(staging, made.rows, made.digest)


def staged_contents(spark: SparkSession, staging: str,
                    require_note: bool = False) -> tuple[Contents, T.StructType] | None:
    """What the notes of a stage say it holds, all runs together, and its
    schema. None for a folder that another Spark job wrote as a whole (it has
    the job's success marker and no note); any other folder is incomplete."""
    folders = Folders(spark)
    if not folders.exists(staging):
        raise MovementError(f"nothing staged at {staging}")
    if not folders.exists(f"{staging}/{MANIFEST}"):
        if not require_note and folders.exists(f"{staging}/_SUCCESS"):
            return None
        raise MovementError(f"the stage at {staging} is incomplete: it has no note of its contents")
    notes = spark.read.schema(_MANIFEST_SCHEMA).json(f"{staging}/{MANIFEST}").collect()
    if not notes:
        raise MovementError(f"the stage at {staging} is incomplete: the note of its contents is empty")
    schemas = {n.schema for n in notes}
    if len(schemas) > 1:
        raise MovementError(f"the runs staged at {staging} have different columns")
    total = sum((Contents.parse(n.rows, n.digest) for n in notes), Contents())
    return total, T.StructType.fromJson(json.loads(schemas.pop()))


def stage_governed(spark: SparkSession, plan: GovernedPlan | None, catalog,
                   staging: str, args: Mapping[str, object] | None = None,
                   subject: str | None = "patientId") -> MovementReport:
    """Start a movement from a policy decision: run the governed plan and
    stage its result with the plan's write options (e.g. encryption keys)."""
    from custodia.plans.governed import run_governed

    result = run_governed(spark, plan, catalog, args=args, subject=subject)
    return start_movement(result, staging, options=plan.write_options)


def stage_governed_export(spark: SparkSession, catalog, staging: str, purpose: str, policy,
                          tests: str = "blood_tests", profiles: str = "patientsProfiles",
                          clauses: str = "blood_tests_clauses", zone=Zone.ON_PREM,
                          requester_id: str = "", **arguments) -> MovementReport:
    """Start a movement of the public export under a policy: ask for a read
    of the measurement table, mask by the decision's consent rules, export
    (``arguments`` go to ``public_export``) and stage with the decision's
    options. Without a decision nothing is read or staged."""
    from custodia.plans.governed import decide, governed_export

    plan = decide(policy, f"SELECT * FROM {tests}", purpose, Zone.parse(zone).access, requester_id)
    export = governed_export(catalog.load(spark, tests), catalog.load(spark, profiles),
                             catalog.load(spark, clauses), plan, **arguments)
    return start_movement(export, staging, options=plan.write_options)


def finish_governed(spark: SparkSession, staging: str, target: str, purpose: str, policy,
                    requester_id: str = "", **arguments) -> MovementReport:
    """``finish_movement`` under a policy: asks for access ``write`` to the
    target and appends with the decision's options. Without a decision the
    target is not touched."""
    from custodia.plans.governed import decide

    plan = decide(policy, target, purpose, "write", requester_id)
    return finish_movement(spark, staging, target,
                           options={**plan.write_options, **arguments.pop("options", {})}, **arguments)


def _schema_of(spark: SparkSession, path: str, options: Mapping[str, str]) -> T.StructType | None:
    """Schema of the table at ``path``; None if there is none yet."""
    if not Folders(spark).exists(path):
        return None
    try:
        return spark.read.options(**options).parquet(path).schema
    except AnalysisException:
        return None


def _is_stream_sink(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a streaming file sink's commit log."""
    return Folders(spark).exists(f"{path.rstrip('/')}/_spark_metadata")


def _check_compatible(staged: T.StructType, target: T.StructType, skip: set[str]) -> None:
    have = {f.name: f.dataType for f in staged.fields if f.name not in skip}
    want = {f.name: f.dataType for f in target.fields if f.name not in skip}
    seals = [{f.name: f.metadata.get(SEALED) for f in s.fields if f.name not in skip} for s in (staged, target)]
    if have.keys() != want.keys():
        raise MovementError(
            f"staged columns differ from the target: missing {sorted(want.keys() - have.keys())}, "
            f"extra {sorted(have.keys() - want.keys())}")
    clashes = {c: (str(have[c]), str(want[c])) for c in have if have[c] != want[c]}
    if clashes:
        raise MovementError(f"staged column types differ from the target: {clashes}")
    if seals[0] != seals[1]:
        differ = sorted(c for c in have if seals[0][c] != seals[1][c])
        raise MovementError(f"staged columns are sealed otherwise than the target: {differ}")


def _as_read(schema: T.StructType, partitions: set[str]) -> T.StructType:
    """Stored columns come back nullable, partition columns without metadata."""
    return T.StructType([T.StructField(f.name, f.dataType, True, {} if f.name in partitions else f.metadata)
                         for f in schema.fields])


def _publish(folders: Folders, target: str, commit: dict) -> None:
    """Make an attempt part of the target. Every step may have been done
    already: a run that was cut off is completed by the next one."""
    attempt = f"{target}/{commit['attempt']}"
    there = folders.exists(attempt)
    if commit["movement_id"] is None:
        for name in folders.files(attempt) if there else ():
            if name.rpartition("/")[2].startswith(("_", ".")):
                continue
            folder = name.rpartition("/")[0]
            if folder:
                folders.make(f"{target}/{folder}")
            folders.rename(f"{attempt}/{name}", f"{target}/{name}")
    else:
        final = f"{target}/{MOVEMENT_COLUMN}={commit['movement_id']}"
        old = f"{target}/_old-{commit['attempt']}"
        if there or not commit["rows"]:
            if folders.exists(final):
                folders.rename(final, old)
            if commit["rows"]:
                folders.rename(attempt, final)
        folders.delete(old)
    folders.delete(attempt)


def recover(spark: SparkSession, target: str) -> int:
    """Complete committed movements whose driver was lost before they were
    all in place; returns how many. Attempts that were never committed are
    hidden folders, which ``recover`` leaves alone."""
    folders, done = Folders(spark), 0
    for name in folders.names(f"{target}/{COMMITS}"):
        if name.endswith(".ready"):
            path = f"{target}/{COMMITS}/{name}"
            _publish(folders, target, json.loads(folders.read_text(path)))
            folders.rename(path, path[:-len("ready")] + "done")
            done += 1
    return done


def finish_movement(spark: SparkSession, staging: str, target: str,
                    fill: Mapping[str, object] | None = None,
                    options: Mapping[str, str] | None = None,
                    movement_id: str | None = None,
                    partition_by: list[str] | None = None,
                    check_schema: bool = True,
                    sort_within: list[str] | None = None,
                    require_note: bool = False) -> MovementReport:
    """Append a staged movement to the target Parquet table.

    * an empty or missing staging path is an error, and so is an incomplete
      stage or one with other contents than noted: a part file that is
      missing, altered or foreign leaves the target as it was. Files that
      another Spark job wrote have no note to agree with; they are moved if
      that job succeeded, or refused with ``require_note``;
    * ``fill`` (default: the reference's ``fibrinogen_value`` -> 0.0) is
      applied to the columns that exist;
    * the staged schema must equal the target's (a type clash would let the
      append succeed and the next read fail);
    * with ``movement_id`` the rows land in the folder
      ``movement_id=<id>``, the outermost partition, which they replace as a
      whole: re-running a movement leaves no row of an earlier run, in
      whatever partitions below it; a re-run that staged no rows empties the
      movement, and one that fails leaves the earlier run's rows in place;
    * ``sort_within`` (e.g. ``["patientId"]``) clusters each written file by
      those columns for data skipping in later per-subject reads;
    * a target written by ``stream_movement`` is refused: its readers follow
      the stream's commit log and would never see batch-appended files.
    """
    sealing, opts = split_options(options)
    _refuse_sealed(sealing, partition_by)
    if movement_id is not None and not re.fullmatch(r"[\w.-]+", str(movement_id)):
        raise ValueError("movement_id may hold letters, digits and _ . - only")
    if _is_stream_sink(spark, target):
        raise MovementError(f"{target} is written by a stream; finish this movement with "
                            "stream_movement instead")
    known = staged_contents(spark, staging, require_note)
    if known and not known[0].rows and movement_id is None:
        raise MovementError(f"staging at {staging} holds no rows")
    folders = Folders(spark)
    recover(spark, target)
    name = f"{ATTEMPT}{uuid.uuid4().hex}"
    parts = list(partition_by or [])
    reader = spark.read.options(**opts)
    raw, seen = observed((reader.schema(known[1]) if known else reader).parquet(staging), "moved")
    staged = fill_present(unseal(raw, sealing.keystore) if sealing else raw,
                          DEFAULT_FILL if fill is None else fill)
    staged = seal(staged, sealing)
    if check_schema:
        existing = _schema_of(spark, target, opts)
        if existing is not None:
            _check_compatible(_as_read(staged.schema, set(parts)), existing, {*parts, MOVEMENT_COLUMN})
    attempt = f"{target}/{name}"
    try:
        w = _clustered(staged, sort_within).write.mode("errorifexists").options(**opts)
        if parts:
            w = w.partitionBy(*parts)
        w.parquet(attempt)
        moved = contents_of(seen)
        if known and moved != known[0]:
            raise MovementError(f"staging at {staging} is not what was staged: {moved.rows} rows with digest "
                                f"{moved.digest} instead of {known[0].rows} with {known[0].digest}")
        if not moved.rows and movement_id is None:
            raise MovementError(f"staging at {staging} holds no rows")
    except BaseException:
        folders.delete(attempt)
        raise
    commit = {"attempt": name, "rows": moved.rows, "digest": moved.digest,
              "movement_id": None if movement_id is None else str(movement_id)}
    folders.make(f"{target}/{COMMITS}")
    folders.write_text(f"{target}/{COMMITS}/{name}.ready", json.dumps(commit))
    recover(spark, target)
    return MovementReport(target, moved.rows, moved.digest)
