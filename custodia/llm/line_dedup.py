"""Line dedup by a segment-partition edit join.

Of equal lines the first stays: the one in the document with the smallest
doc_id. Lines of at least ``min_chars`` characters are also joined by edit
distance: a line of length n gives k+1 disjoint segments of n // (k+1)
characters; a line within k edits leaves one of them whole, shifted by no
more than the edits around it allow. The lines probe an index of segments with
their substrings for all lengths that can match, and pairs that share one
are verified with a banded bit-parallel edit distance. A line is dropped if
an earlier line that stays (smaller first document, then the place in it) is
within k edits of it; a dropped line drops nothing. Rounds over the links
decide this: lines without an earlier undecided neighbour stay, their
neighbours go. Once few links are left, the driver goes through them in order.

Only hashes, never whole texts, are grouped: a line that most documents
hold is aggregated before the shuffle or counted by window, and segment
lists with one line are left out before pairs are formed. Inside a list, sketches of the letters and
of the pairs of letters rule out nearly all pairs that are not near.

Defined cases: lines are compared without white space around them; blank
lines are no lines and stay; NULL and empty texts have no lines; a line
repeated inside a document stays once; rows that repeat a doc_id are one
document; rows without doc_id stay as they are and drop nothing; an empty
table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm import line_keys
from custodia.llm.edit_distance import distance_within
from custodia.llm.tables import kept

MAX_EDITS = 2
MIN_CHARS = 20
#: Links that the driver decides at once; more are decided in rounds.
LOCAL_LINKS = 1 << 18
#: Columns of a line's sketches: letters and length, pairs of letters.
SKETCH = ("letters", "pairs")


def _hashes(line: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(line.encode())
    return (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True))


def _lines(text: str | None) -> list[str]:
    return [x.strip() for x in text.split("\n")] if text else []


def _occurrences(batches):
    """Per document a row with its number of lines, and one per line."""
    for batch in batches:
        docs, counts, lo, hi = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            lines = [x for x in _lines(text.as_py()) if x]
            docs.append(doc)
            counts.append(len(lines))
            lo.append(None)
            hi.append(None)
            for a, b in map(_hashes, dict.fromkeys(lines) if doc is not None else ()):
                docs.append(doc)
                counts.append(None)
                lo.append(a)
                hi.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (docs, counts, lo, hi)],
                                         names=["doc_id", "n_lines", "lo", "hi"])


def segment_keys(line: str, edits: int) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(segments of the line, further substrings it probes with), each with
    the number of the segment (see ``line_keys.places``)."""
    own, more = ([(i, line[at:at + size]) for i, at, size in some] for some in line_keys.places(len(line), edits))
    return own, sorted(set(more).difference(own))


def _sketch(line: str) -> int:
    """The letter sketch of one line."""
    return int(line_keys.sketches(line_keys.codes_of([line], len(line)))[0, 0])


def _by_length(batch: pa.RecordBatch, min_chars: int) -> dict[int, list[str]]:
    """The different lines of a batch of at least ``min_chars``, by length."""
    found: dict[int, dict[str, None]] = {}
    for text in batch.column(0):
        for line in _lines(text.as_py()):
            if len(line) >= min_chars:
                found.setdefault(len(line), {})[line] = None
    return {n: list(lines) for n, lines in found.items()}


def _keys(edits: int, min_chars: int) -> Callable:
    """Per line and place: key, lo, own and the sketches."""
    names = ["key", "lo", "own", *SKETCH]

    def run(batches):
        for batch in batches:
            for n, lines in _by_length(batch, min_chars).items():
                step = max(1, line_keys.CELLS // n)
                for k in range(0, len(lines), step):
                    some = lines[k:k + step]
                    codes = line_keys.codes_of(some, n)
                    keys, own = line_keys.segment_hashes(codes, edits)
                    each = keys.shape[1]
                    columns = [keys.ravel(), np.repeat([_hashes(x)[0] for x in some], each), np.tile(own, len(some)),
                               *(np.repeat(c, each) for c in line_keys.sketches(codes).T)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
    return run


def _wanted_lines(batches):
    for batch in batches:
        names, lines, places = [], [], []
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            wanted = set(wanted)
            for place, line in enumerate(dict.fromkeys(_lines(text.as_py()))):
                if line and (name := _hashes(line)[0]) in wanted:
                    names.append(name)
                    lines.append(line)
                    places.append(place)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(lines, pa.string()),
                                          pa.array(places, pa.int32())], names=["lo", "line", "place"])


def _near(edits: int) -> Callable:
    def run(batches):
        for batch in batches:
            close = pa.array([distance_within(x.as_py(), y.as_py(), edits) is not None
                              for x, y in zip(batch.column(4), batch.column(5))], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(close) for c in batch.columns[:4]],
                                             names=["a", "b", "a_place", "b_place"])
    return run


def line_links(docs: DataFrame, classes: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(a, b, a_place, b_place) of different lines within ``edits``, by hash,
    each pair once, with their places in their first documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .filter("doc_id IS NOT NULL")
    columns = ", ".join(f"{c} long" for c in SKETCH)
    keys = texts.select("text").mapInArrow(_keys(edits, min_chars), f"key long, lo long, own boolean, {columns}")
    whole = Window.partitionBy("key")
    lists = kept(keys.withColumn("least", F.min("lo").over(whole)).withColumn("most", F.max("lo").over(whole))
                 .filter("least <> most").groupBy("key", "lo", *SKETCH).agg(F.max("own").alias("own")))
    left, right = lists.filter("own").alias("l"), lists.alias("r")

    def changed(some: tuple[str, ...], mask: int):
        return sum((F.bit_count(F.col(f"l.{c}").bitwiseXOR(F.col(f"r.{c}")).bitwiseAND(F.lit(mask))) for c in some[1:]),
                   F.bit_count(F.col(f"l.{some[0]}").bitwiseXOR(F.col(f"r.{some[0]}")).bitwiseAND(F.lit(mask))))
    apart = F.pmod(F.shiftright(f"l.{SKETCH[0]}", 56) - F.shiftright(f"r.{SKETCH[0]}", 56), F.lit(128))
    fits = ((changed(SKETCH[:1], (1 << 56) - 1) <= line_keys.LETTER_CHANGES * edits)
            & (changed(SKETCH[1:], -1) <= line_keys.PAIR_CHANGES * edits)
            & ((apart <= edits) | (apart >= 128 - edits)))
    pairs = kept(left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.lo") != F.col("r.lo")) & fits)
                 .select(F.least("l.lo", "r.lo").alias("a"), F.greatest("l.lo", "r.lo").alias("b")).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("lo")).distinct()
    where = (asked.join(classes.select("lo", "first"), "lo").groupBy(F.col("first").alias("doc_id"))
             .agg(F.collect_set("lo").alias("wanted")))
    lines = kept(texts.join(where, "doc_id").select("text", "wanted")
                 .mapInArrow(_wanted_lines, "lo long, line string, place int")
                 .groupBy("lo", "line").agg(F.min("place").alias("place")))
    x = lines.select(F.col("lo").alias("a"), F.col("line").alias("x"), F.col("place").alias("a_place"))
    y = lines.select(F.col("lo").alias("b"), F.col("line").alias("y"), F.col("place").alias("b_place"))
    near = F.abs(F.length("x") - F.length("y")) <= edits
    return kept(pairs.join(x, "a").join(y, "b").filter(near)
                .select("a", "b", "a_place", "b_place", "x", "y")
                .mapInArrow(_near(edits), "a long, b long, a_place int, b_place int").distinct())


def late_lines(links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """The lines ``lo`` that go, each once, given every link (lo, other) to
    an earlier line, with the order (first, place) of ``lo``."""
    spark = links.sparkSession
    out = spark.createDataFrame([], "lo long")
    left = links.select("lo", "other", "first", "place")
    while left.count() > local:
        stay = left.select(F.col("other").alias("lo")).distinct().join(left.select("lo"), "lo", "left_anti")
        gone = kept(left.join(stay.withColumnRenamed("lo", "other"), "other").select("lo").distinct())
        left = kept(left.join(gone, "lo", "left_anti")
                    .join(gone.withColumnRenamed("lo", "other"), "other", "left_anti")
                    .select("lo", "other", "first", "place"))
        out = out.union(gone)
    earlier: dict[tuple[int, int, int], list[int]] = {}
    for lo, other, first, place in zip(*(c.to_pylist() for c in left.toArrow().columns)):
        earlier.setdefault((first, place, lo), []).append(other)
    late: set[int] = set()
    for line in sorted(earlier):
        if not late.issuperset(earlier[line]):
            late.add(line[2])
    return out.union(spark.createDataFrame([(lo,) for lo in sorted(late)], "lo long"))


def line_decisions(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_kept, n_near (lines dropped
    for a near line alone), n_links (near lines of its lines), first_doc
    (smallest document that has one of its lines or a line near one) and
    dropped (hashes of the lines that go)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = kept(texts.mapInArrow(_occurrences, "doc_id long, n_lines long, lo long, hi long"))
    rows = found.filter("lo IS NULL").select("doc_id", "n_lines")
    occurrences = found.filter("lo IS NOT NULL").select("doc_id", "lo", "hi").distinct()
    classes = kept(occurrences.groupBy("lo", "hi").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))

    links = line_links(docs, classes, edits, min_chars)
    both = (links.select("a", "b", "a_place", "b_place").union(links.select("b", "a", "b_place", "a_place"))
            .toDF("lo", "other", "place", "other_place"))
    order = classes.select("lo", "first")
    both = kept(both.join(order, "lo")
                .join(order.select(F.col("lo").alias("other"), F.col("first").alias("other_first")), "other"))
    earlier = F.struct("other_first", "other_place", "other") < F.struct("first", "place", "lo")
    late = late_lines(both.filter(earlier)).withColumn("late", F.lit(True))
    near = (both.groupBy("lo").agg(F.count(F.lit(1)).alias("links"), F.min("other_first").alias("near_first"))
            .join(late, "lo", "left"))
    judged = (classes.join(near, "lo", "left").filter("n > 1 OR links IS NOT NULL")
              .select("lo", "hi", "first", F.coalesce("links", F.lit(0)).alias("links"),
                      F.coalesce("late", F.lit(False)).alias("late"),
                      F.least("first", "near_first").alias("source")))
    gone = F.col("late") | (F.col("doc_id") != F.col("first"))
    per_doc = (occurrences.join(judged, ["lo", "hi"]).groupBy("doc_id").agg(
        F.collect_list(F.when(gone, F.col("lo"))).alias("dropped"),
        F.sum(F.when(F.col("late") & (F.col("doc_id") == F.col("first")), 1).otherwise(0)).alias("n_near"),
        F.sum("links").alias("n_links"), F.min("source").alias("first_doc")))
    distinct = occurrences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_distinct"))
    zero = F.lit(0).cast("long")
    dropped = F.coalesce("dropped", F.array().cast("array<bigint>"))
    return (rows.join(distinct, "doc_id", "left").join(per_doc, "doc_id", "left").select(
        "doc_id", "n_lines",
        F.when(F.col("doc_id").isNull(), F.col("n_lines"))
        .otherwise(F.coalesce("n_distinct", zero) - F.size(dropped)).cast("long").alias("n_kept"),
        F.coalesce("n_near", zero).alias("n_near"), F.coalesce("n_links", zero).alias("n_links"),
        F.least("doc_id", "first_doc").alias("first_doc"), dropped.alias("dropped")))


def dedup_lines(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS,
                drop_emptied: bool = True) -> DataFrame:
    """``docs`` without the dropped lines; documents that lose all their
    lines go, if ``drop_emptied``."""
    schema = docs.schema
    text_at = docs.columns.index("text")
    own, lost = (_unused(docs, name) for name in ("__doc", "__dropped"))
    gone = line_decisions(docs, edits, min_chars).filter("doc_id IS NOT NULL").select(
        F.col("doc_id").alias(own), F.col("dropped").alias(lost)).dropDuplicates([own])

    def run(batches):
        for batch in batches:
            texts, stay = [], []
            for text, dropped in zip(batch.column(text_at).to_pylist(), batch.column(len(schema)).to_pylist()):
                had, left, out = False, False, []
                if text and dropped is not None:
                    seen = set(dropped)
                    for raw in text.split("\n"):
                        line = raw.strip()
                        if line:
                            had = True
                            name = _hashes(line)[0]
                            if name in seen:
                                continue
                            seen.add(name)
                            left = True
                        out.append(raw)
                    text = "\n".join(out) if len(out) <= text.count("\n") else text
                texts.append(text)
                stay.append(left or not had or not drop_emptied)
            columns = list(batch.columns[:len(schema)])
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(stay, pa.bool_()))

    return docs.join(gone, docs["doc_id"] == gone[own], "left").drop(own).mapInArrow(run, schema)


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
