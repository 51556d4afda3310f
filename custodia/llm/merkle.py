"""Merkle manifest of a table: a digest of every row, of every source and of
the whole, with the proof of each row against the root.

Rows are leaves. Within a source (and then over the sources) they stand in
order, and every ``FANOUT`` consecutive nodes become one parent, level by
level, until one node is left. A level is a grouping by parent in which
conditional aggregates spread the children into ``FANOUT`` columns (a slot
pivot): the columns put together give the parent's digest, and left out the
own slot they are the siblings that a proof needs. The levels are stored on
the way up; on the way down each parent hands its own proof to its children,
so a proof is assembled once for the children of a parent, not for each row
and level.

Only digests are dealt out, never texts. Positions inside a source come from
a range partitioning by (source, order) and the sizes of its parts, so a
source of any size is spread over all tasks. A parent has ``FANOUT`` children
at most; the driver sees one number, the size of the largest source, which
gives the number of levels.

Defined cases: NULL ids and NULL sources come first, and a NULL source is a
source of its own; rows that repeat an id are leaves each for itself, in the
order of their digests; a lone leaf is the subroot of its source and a lone
subroot is the root; the proof of a lone leaf under a lone subroot is the
digest of nothing; an empty table gives an empty result; a row with a NULL
id is not tampered with; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.tables import kept

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<before:string,after:string>"


def row_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields, each as its length in bytes and its value."""
    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(framed, fields)), 256)


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, their position from 0 among the rows of their
    ``key`` by ``order``, and ``n``, the number of these rows.

    A range partitioning puts the rows in order; the sizes of its parts, by
    key, give what lies before each part.
    """
    by = [key, *order, "tie"]
    # stored first: the range bounds are sampled from a pass of their own
    dealt = kept(kept(rows.withColumn("tie", F.monotonically_increasing_id()))
                 .repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
                 .withColumn("at", F.monotonically_increasing_id())
                 .withColumn("part", F.shiftright("at", 33)))
    parts = dealt.groupBy(key, "part").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("size"))
    own = Window.partitionBy(key)
    parts = parts.select(
        key, "part",
        (F.sum("size").over(own.orderBy("part")) - F.col("size") - F.col("start")).alias("shift"),
        F.sum("size").over(own).alias("n"))
    return (dealt.join(parts, [key, "part"])
            .withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift"))


def _slots() -> list[str]:
    return [f"c{s}" for s in range(FANOUT)]


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels above ``nodes`` (key, place, n, node) and the top
    (key, h) of each key. ``node`` is a struct that begins with the digest h.

    A level has a row per parent: key, place, n (nodes of the key on this
    level), the children in columns c0, c1, ... and h.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    tops = nodes.filter("n = 1").select("key", "node.h")
    levels = []
    while largest > 1:
        slot = F.pmod("place", F.lit(FANOUT))
        spread = (nodes.filter("n > 1")
                  .groupBy("key", F.expr(f"place div {FANOUT}").alias("place"),
                           F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"))
                  .agg(*(F.max(F.when(slot == s, F.col("node"))).alias(c) for s, c in enumerate(_slots()))))
        level = kept(spread.withColumn("h", F.sha2(F.concat_ws("", *(f"{c}.h" for c in _slots())), 256)))
        levels.append(level)
        nodes = level.select("key", "place", "n", F.struct("h").alias("node"))
        tops = tops.union(level.filter("n = 1").select("key", "h"))
        largest = -(-largest // FANOUT)
    return levels, tops


def _children(parents: DataFrame) -> DataFrame:
    """The children of parents with ``up`` and ``top``: own slot left out,
    the digests before and after it are one more step of the proof."""
    def child(s: int) -> Column:
        digests = [F.col(f"{c}.h") for c in _slots()]
        step = F.struct(F.concat_ws("", *digests[:s]).alias("before"),
                        F.concat_ws("", *digests[s + 1:]).alias("after"))
        return F.when(F.col(f"c{s}").isNotNull(), F.struct(
            (F.col("place") * FANOUT + s).alias("place"), F.col(f"c{s}").alias("node"), step.alias("step")))
    return (parents.select("key", "up", "top", F.explode(F.array(*map(child, range(FANOUT)))).alias("child"))
            .filter("child IS NOT NULL")
            .select("key", "child.place", "child.node",
                    F.concat(F.array("child.step"), "up").alias("up"), "top"))


def proofs(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(node, up, top) of every node: ``up`` holds, from below, what stands
    before and after it among its siblings on each level, followed by the
    ``up`` that ``tops`` (key, up, top) has for the key."""
    lower = None
    for level in reversed(levels):
        known = level.filter("n = 1").join(tops, "key")
        if lower is not None:
            known = known.unionByName(level.filter("n > 1").join(
                lower.select("key", "place", "up", "top"), ["key", "place"]))
        lower = _children(known)
    lone = nodes.filter("n = 1").join(tops, "key").select("node", "up", "top")
    return lone if lower is None else lone.unionByName(lower.select("node", "up", "top"))


def manifest(rows: DataFrame, source_col: str = "source", id_col: str = "doc_id",
             fields: tuple[str, ...] = FIELDS, arrives: dict[str, Column] | None = None,
             arrives_if: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, up, arrived) of every row.

    ``up`` is the row's proof, an array of (before, after). ``arrived`` is
    the digest of the row as it is found later: with the columns of
    ``arrives`` replaced, where ``arrives_if`` holds; elsewhere the leaf.
    """
    changed = {c: (arrives or {}).get(c, F.col(c)) for c in fields}
    leaf = row_digest([F.col(c) for c in fields])
    later = F.when(arrives_if, row_digest(list(changed.values()))) if arrives_if is not None \
        else F.lit(None).cast("string")
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")).alias("key"),
        F.col(id_col).alias("id"), leaf.alias("h"), later.alias("later"))
    leaves = ranked(leaves, "key", ["id", "h"]).select(
        "key", "place", "n", F.struct("h", "id", "later").alias("node"))
    levels, subroots = build(leaves)
    sources = kept(ranked(subroots.select(F.lit("").alias("all"), "key", "h"), "all", ["key"])
                   .select(F.col("all").alias("key"), "place", "n", F.struct("h", "key").alias("node")))
    above, root = build(sources)
    none = F.array().cast(f"array<{_STEP}>")
    per_source = proofs(sources, above, root.select("key", none.alias("up"), F.col("h").alias("top")))
    tops = kept(per_source.select("node.key", "up", F.struct(
        F.col("node.h").alias("subroot"), F.col("top").alias("root")).alias("top")))
    return proofs(leaves, levels, tops).select(
        F.col("node.id").alias("id"), F.col("node.h").alias("leaf"), "top.subroot", "top.root", "up",
        F.coalesce("node.later", "node.h").alias("arrived"))


def proof_digest(up: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(up, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(up: Column, leaf: Column) -> Column:
    """The root that ``leaf`` leads to with the siblings ``up``."""
    return F.aggregate(up, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def verify(rows: DataFrame, every: int = 5) -> DataFrame:
    """Manifest of ``rows`` and its test against copies of them of which one
    in ``every`` (by the checksum of its id) came back in lower case."""
    spoilt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    found = manifest(rows, arrives={"text": lower_ascii(F.col("text"))}, arrives_if=spoilt)
    return (found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                         proof_digest(F.col("up")).alias("proof_sha256"),
                         folded(F.col("up"), F.col("arrived")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))

