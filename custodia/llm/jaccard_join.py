"""N-gram Jaccard join: exact set similarity with relations between sets.

A document is the set of its distinct five-word shingles. Equal sets form
one class. A class sends the tokens of its prefix, in an order that puts
tokens seen often last, to the index lists of these tokens; two classes
that are similar enough share such a token. Entries carry set size and
position. Lists are keyed by blocks of sizes, so a set meets only the sizes
it can match; position is tested entry by entry inside a block (the smaller
set of a pair must hold the token within the first ninth of its order): no
block is skipped by position.

Relations between sets save work, but no set's answers are derived from
another's. First every class is compared with the neighbour or leader that it
shares most list entries with. What is similar forms groups. A pair inside a
group adds no new component, so only pairs across groups are formed and
compared; every member still probes its lists. No link between different texts
that would join two components is lost, and groups of near copies are not
expanded into pairs.

Defined cases: NULL text, empty text and text without words have an empty
set and are linked with nothing; a text of fewer than five words is one
shingle; repeated rows (same doc_id) are one document for linking but keep
a row each; a NULL doc_id is linked with nothing and has a NULL component;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.components import components
from custodia.llm.tables import kept, most_frequent, removed_after
from custodia.llm.words import Words, batch_words, blank_separated, mix

SHINGLE = 5
#: Tokens put last in the order, at most; the order decides only the work.
FREQUENT_TOKENS = 1 << 18
_SEEN = 4                  # documents of a batch that hold a frequent token
_ODD = ["odd0", "odd1", "odd2", "odd3"]
_FLUSH = 1 << 22           # tokens counted at once
_Q = np.uint64(0xD6E8FEB86659FD93)


def _shingles(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, first = words.hashes(), words.first
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size if len(rolled) else 0):
        rolled = rolled * _Q + h[k:len(h) - size + 1 + k]
    rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(rolled[a:b - size + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                one = one * _Q + x
            yield mix(one)
        else:
            yield np.zeros(0, np.uint64)


def _set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, as signed 64-bit numbers."""
    one = np.sum(mix(s ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)
    two = np.sum(mix(s + np.uint64(0x1234567)), dtype=np.uint64)
    return tuple(int(x) for x in np.array([one + np.uint64(len(s)), two], np.uint64).view(np.int64))


def _ranges(s: np.ndarray) -> np.ndarray:
    """How many elements fall into each of 256 ranges of hashes."""
    return np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256)


def _sketch(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint32 if counts.sum() > 65535 else np.uint16).tobytes()


def _odd(counts: np.ndarray) -> np.ndarray:
    """The ranges with an odd number of elements, as the bits of four numbers.
    Sets differ by an element at least for each bit that differs."""
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _counts(sketch) -> np.ndarray:
    data = sketch.as_buffer()
    return np.frombuffer(data, np.uint16 if len(data) == 512 else np.uint32).astype(np.int64)


def _likely(batches):
    """Of the pairs, those whose sketches allow the similarity: ranges
    bound the common elements by the smaller of both counts."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = _counts(x), _counts(y)
            keep.append(9 * int(np.minimum(a, b).sum()) >= 4 * int(a.sum() + b.sum()))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)],
                                         names=["a", "b"])


def _describe(size: int) -> Callable:
    """Rows of documents (seen NULL) and of tokens that a batch sees often."""
    names = ["doc_id", "n", "set", "check", "token", "seen", "sketch", *_ODD]

    def often(sets: list[np.ndarray]):
        tokens, n = np.unique(np.concatenate(sets), return_counts=True)
        tokens, n = tokens[n >= _SEEN], n[n >= _SEEN]
        none = pa.nulls(len(n), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none] * 4 + [pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64)),
                          pa.nulls(len(n), pa.binary()), *[none] * len(_ODD)], names=names)

    def run(batches):
        sets, held = [], 0
        for batch in batches:
            rows, sketches, odd = [], [], []
            for _, _, words in batch_words(batch.column(1), blank_separated()):
                for s in _shingles(words, size):
                    rows.append((len(s), *_set_hashes(s)))
                    counts = _ranges(s)
                    sketches.append(_sketch(counts))
                    odd.append(_odd(counts))
                    sets.append(s)
                    held += len(s)
                    if held >= _FLUSH:
                        yield often(sets)
                        sets, held = [], 0
            columns = np.array(rows, np.int64).reshape(-1, 3)
            bits = np.array(odd, np.int64).reshape(-1, len(_ODD))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(columns[:, k]) for k in range(3)], none, none,
                 pa.array(sketches, pa.binary()), *[pa.array(bits[:, k]) for k in range(len(_ODD))]], names=names)
        if sets:
            yield often(sets)
    return run


def _prefixes(size: int, frequent) -> Callable:
    """Rows (token, set, n, pos) of the prefix of every set."""
    def run(batches):
        tokens, weights = frequent.value
        for batch in batches:
            sent: set[int] = set()
            out: list[list[np.ndarray]] = [[], [], [], []]
            for _, _, words in batch_words(batch.column(0), blank_separated()):
                for s in _shingles(words, size):
                    n = len(s)
                    name = _set_hashes(s)[0]
                    if not n or name in sent:
                        continue
                    sent.add(name)
                    if len(tokens):
                        at = np.searchsorted(tokens, s)
                        at[at == len(tokens)] = 0
                        weight = np.where(tokens[at] == s, weights[at], 0)
                        s = s[np.argsort(weight, kind="stable")]
                    k = n - (4 * n + 4) // 5 + 1
                    out[0].append(s[:k].view(np.int64))
                    out[1].append(np.full(k, name, np.int64))
                    out[2].append(np.full(k, n, np.int32))
                    out[3].append(np.arange(k, dtype=np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                                 names=["token", "set", "n", "pos"])
    return run


def _full_sets(size: int) -> Callable:
    def run(batches):
        for batch in batches:
            names, sets = [], []
            for _, _, words in batch_words(batch.column(0), blank_separated()):
                for s in _shingles(words, size):
                    names.append(_set_hashes(s)[0])
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary()),
                                              batch.column(1)], names=["set", "tokens", "wanted"])
    return run


def _similar(batches):
    """Of the pairs, those with 100 * intersection >= 80 * union."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a = np.frombuffer(x.as_buffer(), np.uint64)
            b = np.frombuffer(y.as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            common = int((b[at] == a).sum())
            keep.append(100 * common >= 80 * (len(a) + len(b) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)],
                                         names=["a", "b"])


def _paired(pairs: DataFrame, values: DataFrame, test: Callable) -> DataFrame:
    """The pairs (a, b) whose ``values`` (set, value) pass a test."""
    left = values.select(F.col("set").alias("a"), F.col("value").alias("x"))
    right = values.select(F.col("set").alias("b"), F.col("value").alias("y"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
            .mapInArrow(test, "a long, b long").distinct())


def _verified(pairs: DataFrame, documents: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Of the pairs (a, b) of classes, those that are similar. Sketches rule
    most others out; then whole sets are compared, which come from one text
    of each class that is left."""
    with removed_after(documents.sparkSession) as stays:
        first = (documents.filter("doc_id IS NOT NULL AND n > 0").groupBy("set", "check")
                 .agg(F.min("doc_id").alias("doc_id")))
        both = lambda p: p.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        members = kept(both(pairs).join(first, "set").select("set", "doc_id"))
        sketches = documents.join(members, ["doc_id", "set"]).select("set", F.col("sketch").alias("value"))
        likely = kept(_paired(pairs, sketches, _likely))
        wanted = kept(both(likely).join(members, "set").select("doc_id", F.col("set").alias("wanted")))
        sets = kept(texts.join(wanted, "doc_id").select("text", "wanted")
                    .mapInArrow(_full_sets(shingle), "set long, value binary, wanted long")
                    .filter(F.col("set") == F.col("wanted")).select("set", "value"))
        return stays(_paired(likely, sets, _similar))


def _possible(n, pos, other_n, other_pos):
    """Size and position bounds of a pair whose first common token this is;
    ``n`` is the smaller size."""
    rest = F.least(n - pos, other_n - other_pos)
    return (other_n * 4 <= n * 5) & (rest * 9 >= (n + other_n) * 4)


def links_and_sets(docs: DataFrame, shingle: int = SHINGLE,
                   frequent_tokens: int = FREQUENT_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(documents, components of classes).

    Documents: doc_id, n, set, check. Components: set, component, with the
    smallest class of each component of more than one class.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = kept(texts.mapInArrow(
        _describe(shingle), "doc_id long, n long, set long, check long, token long, seen long, sketch binary, "
        + ", ".join(f"{c} long" for c in _ODD)))
    documents = seen.filter("seen IS NULL").select("doc_id", "n", "set", "check", "sketch", *_ODD)
    counted = seen.filter("seen IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("n"))
    top = most_frequent(counted, frequent_tokens)[0].toArrow()
    tokens = np.asarray(top.column("token").combine_chunks(), np.int64).view(np.uint64)
    order = np.argsort(tokens)
    weights = np.frexp(np.asarray(top.column("n").combine_chunks(), np.float64))[1]
    frequent = spark.sparkContext.broadcast((tokens[order], weights[order]))

    # index lists, one entry for each class; keep lists of two or more
    linkable = texts.filter("doc_id IS NOT NULL").select("text")
    entries = (linkable.mapInArrow(_prefixes(shingle, frequent), "token long, set long, n int, pos int")
               .repartition("token").dropDuplicates(["token", "set"]))
    by_size = Window.partitionBy("token").orderBy("n", "set")
    here = F.struct("set", "n", "pos")
    lists = (entries.withColumn("before", F.lag(here).over(by_size))
             .withColumn("after", F.lead("n").over(by_size)))
    whole = Window.partitionBy("token")
    lists = kept(lists.filter((F.col("before.n") * 5 >= F.col("n") * 4) | (F.col("after") * 4 <= F.col("n") * 5))
                 .withColumn("size", F.count(F.lit(1)).over(whole)))

    # each class with the neighbour and with the leader that it shares most
    # entries with; leaders are the classes whose entries are in long lists
    fame = lists.groupBy("set").agg((F.sum("size") / F.max("n")).alias("fame"))
    known = lists.drop("size").join(fame, "set")
    one = F.struct("fame", "set", "n", "pos")
    known = known.withColumn("leader", F.max(one).over(whole))
    offers = (known.select("set", "n", "pos", F.explode(F.array(
                  F.struct(F.lit(0).alias("kind"), F.col("before.set").alias("set"),
                           F.col("before.n").alias("n"), F.col("before.pos").alias("pos")),
                  F.struct(F.lit(1).alias("kind"), F.col("leader.set").alias("set"),
                           F.col("leader.n").alias("n"), F.col("leader.pos").alias("pos")))).alias("o"))
              .filter("o.set <> set")
              .filter(_possible(F.least("n", "o.n"), F.col("pos"), F.greatest("n", "o.n"), F.col("pos")))
              .groupBy(F.col("set").alias("a"), "o.kind", F.col("o.set").alias("b"))
              .agg(F.count(F.lit(1)).alias("n")))
    chosen = (offers.groupBy("a", "kind").agg(F.max(F.struct("n", "b")).alias("best"))
              .select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct())
    near = _verified(kept(chosen), documents, texts, shingle)
    groups = components(near)

    # pairs across groups: same list, sizes that fit, position early enough,
    # and no more odd ranges apart than similar sets can have elements apart
    bits = (documents.filter("doc_id IS NOT NULL AND n > 0").groupBy("set")
            .agg(*[F.min(c).alias(c) for c in _ODD]))
    grouped = (lists.select("token", "set", "n", "pos")
               .join(groups.select(F.col("node").alias("set"), "label"), "set", "left")
               .withColumn("group", F.coalesce("label", "set")).drop("label"))
    grouped = kept(grouped.withColumn("lo", F.min("group").over(whole)).withColumn("hi", F.max("group").over(whole))
                   .filter("lo <> hi").drop("lo", "hi").join(bits, "set")
                   .withColumn("block", F.floor(F.log(F.col("n").cast("double")) / math.log(1.26)).cast("int")))
    small = (grouped.filter(F.col("pos") * 9 <= F.col("n"))
             .withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1)))).alias("s")
    large = grouped.alias("l")
    s, l = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"l.{c}"))
    apart = sum(F.bit_count(s(c).bitwiseXOR(l(c))) for c in _ODD)
    across = (small.join(large, (s("token") == l("token")) & (s("block") == l("block"))
                         & (s("group") != l("group"))
                         & ((s("n") < l("n")) | ((s("n") == l("n")) & (s("set") < l("set"))))
                         & _possible(s("n"), s("pos"), l("n"), l("pos")) & (apart * 9 <= s("n") + l("n")))
              .select(s("set").alias("a"), l("set").alias("b")).distinct())
    more = _verified(kept(across), documents, texts, shingle)
    if more.isEmpty():
        joined = groups
    else:
        joined = components(near.union(more))
    return documents, joined.select(F.col("node").alias("set"), F.col("label").alias("component"))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE,
                       frequent_tokens: int = FREQUENT_TOKENS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id that
    links reach)."""
    documents, joined = links_and_sets(docs, shingle, frequent_tokens)
    classes = (documents.filter("doc_id IS NOT NULL AND n > 0").groupBy("set", "check")
               .agg(F.min("doc_id").alias("least"))
               .join(joined, "set", "left").withColumn("component", F.coalesce("component", "set")))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select("set", "check", "component_id")
    alone = documents.filter("doc_id IS NULL OR n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return (documents.filter("doc_id IS NOT NULL AND n > 0").join(classes, ["set", "check"])
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone))


def one_per_component(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component;
    rows without doc_id stay. Of rows that repeat a doc_id all stay."""
    gone = (jaccard_components(docs, shingle).filter("doc_id <> component_id")
            .select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
