"""Benchmark decontamination with an FM-index per shard of documents.

The benchmark's items are cut into windows of 13 words (a shorter item is
one window). A shard, some megabytes of documents inside a task, becomes a
sequence of word numbers with a separator between runs; words that no item
has end a run, and a run shorter than the shortest window cannot hold one,
so neither is indexed. Backward search finds all windows at once, sampled
suffix positions give where they occur, and overlapping occurrences merge
into the spans to remove.

The benchmark is cut into blocks of bounded size, each broadcast and
applied in the same pass over the documents, which are never shuffled.

Defined cases: a NULL or empty text has no words and no hits; an item with
NULL text or no words is left out; the windows of an item with NULL id give
hits and spans, but no name to the items; items may repeat (their
windows are united); repeated documents each get their own row; an empty
table on either side gives no hits; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.llm.fm_index import FMIndex
from custodia.llm.words import alphanumeric, batch_words, hash_words

WINDOW = 13
#: Bytes of benchmark text in a broadcast block.
BLOCK_BYTES = 8 << 20
#: Symbols in one index; longer sequences are cut with an overlap.
INDEX_SYMBOLS = 1 << 20

SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(SPAN)),
])
_ARROW_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])
_ARROW_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()),
                         ("items", pa.list_(pa.string())), ("spans", pa.list_(_ARROW_SPAN))])


class Windows:
    """The distinct windows of some items, as numbers of their words."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        table = alphanumeric()
        found: dict[bytes, tuple[np.ndarray, set[str]]] = {}
        for item, text in items:
            for _, _, words in batch_words(pa.array([text]), table):
                h = words.hashes()
                for at in range(max(1, len(h) - window + 1) if len(h) else 0):
                    w = h[at:at + window]
                    names = found.setdefault(w.tobytes(), (w, set()))[1]
                    if item is not None:
                        names.add(item)
        hashes = [w for w, _ in found.values()]
        self.items = [sorted(names) for _, names in found.values()]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.lengths = np.array([len(w) for w in hashes], np.int64)
        self.patterns = np.zeros((len(hashes), int(self.lengths.max(initial=0))), np.int64)
        for n, w in enumerate(hashes):
            self.patterns[n, :len(w)] = np.searchsorted(self.vocabulary, w) + 2

    def occurrences(self, numbers: np.ndarray, new_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of all occurrences in a sequence of word
        numbers (0: not in the vocabulary); ``new_text`` marks first words."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = numbers > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1] | new_text[1:]
        at = np.flatnonzero(begins)
        if not len(at):
            return none
        run = np.cumsum(begins) - 1
        sizes = np.bincount(run[known], minlength=len(at))
        kept = np.flatnonzero(known)
        kept = kept[(sizes >= self.lengths.min())[run[kept]]]
        if not len(kept):
            return none
        # symbol 1 separates runs; where[] gives each symbol's word
        breaks = np.flatnonzero(np.diff(run[kept])) + 1
        symbols = np.insert(numbers[kept], breaks, 1)
        where = np.insert(kept, breaks, -1)
        windows, firsts = [], []
        overlap = self.patterns.shape[1] - 1
        for cut in range(0, len(symbols), INDEX_SYMBOLS):
            index = FMIndex(symbols[cut:cut + INDEX_SYMBOLS + overlap])
            lo, hi = index.search(self.patterns, self.lengths)
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            windows.append(which)
            firsts.append(where[cut + index.locate(rows)])
        return np.concatenate(windows), np.concatenate(firsts)


def _scan(column, windows: Windows) -> Iterator[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """(words, hit words, items, spans of words) of each text."""
    table = alphanumeric()
    for i, j, words in batch_words(column, table):
        h = words.hashes()
        if len(windows.vocabulary):
            place = np.searchsorted(windows.vocabulary, h)
            place[place == len(windows.vocabulary)] = 0
            numbers = np.where(windows.vocabulary[place] == h, place + 2, 0)
        else:
            numbers = np.zeros(len(h), np.int64)
        new_text = np.zeros(len(h) + 1, bool)
        new_text[words.first] = True
        window, first = windows.occurrences(numbers, new_text[:-1])
        row = np.searchsorted(words.first, first, "right") - 1
        change = np.zeros(len(h) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + windows.lengths[window], -1)
        hit = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
        opens = np.flatnonzero(hit[1:-1] & (~hit[:-2] | new_text[:-1]))
        closes = np.flatnonzero(hit[1:-1] & (~hit[2:] | new_text[1:]))
        total = np.concatenate([[0], np.cumsum(hit[1:-1])])
        n_hit = total[words.first[1:]] - total[words.first[:-1]]
        items: dict[int, set[str]] = {}
        for r, w in set(zip(row.tolist(), window.tolist())):
            items.setdefault(r, set()).update(windows.items[w])
        span_row = np.searchsorted(words.first, opens, "right") - 1
        spans: dict[int, list[tuple[int, int]]] = {}
        for r, a, b in zip(span_row.tolist(), opens.tolist(), closes.tolist()):
            spans.setdefault(r, []).append((a - int(words.first[r]), b - int(words.first[r])))
        for r, n in enumerate(words.counts.tolist()):
            yield n, int(n_hit[r]), sorted(items.get(r, ())), spans.get(r, [])


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _marker(sent, text_at: int, hits_at: int | None, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        for batch in batches:
            found = list(_scan(batch.column(text_at), windows))
            if hits_at is not None:             # an earlier block of the benchmark
                for n, old in enumerate(batch.column(hits_at).to_pylist()):
                    words, _, items, spans = found[n]
                    spans = _united(spans + [(s["first"], s["last"]) for s in old["spans"]])
                    found[n] = (words, sum(b - a + 1 for a, b in spans),
                                sorted({*items, *old["items"]}), spans)
            rows = [{"n_words": w, "n_hit": h, "items": i,
                     "spans": [{"first": a, "last": b} for a, b in s]} for w, h, i, s in found]
            columns = batch.columns if hits_at is None else batch.columns[:hits_at]
            names = batch.schema.names if hits_at is None else batch.schema.names[:hits_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _ARROW_HITS)],
                                             names=[*names, name])
    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    rows, size = [], 0
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")) \
        .filter("t IS NOT NULL").distinct()
    for r in items.toLocalIterator():
        rows.append((r.i, r.t))
        size += len(r.t)
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    yield rows


def mark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
              block_bytes: int = BLOCK_BYTES, name: str = "hits") -> DataFrame:
    """``docs`` with one more column ``name``: words, hit words, items found
    and the merged spans of hit words (first and last word, from 0)."""
    if name in docs.columns:
        raise ValueError(f"column {name} exists")
    spark = docs.sparkSession
    schema = T.StructType([*docs.schema.fields, T.StructField(name, HITS)])
    text_at = docs.columns.index("text")
    out, hits_at = docs, None
    for block in _blocks(benchmark, block_bytes):
        windows = Windows(block, window)
        if not len(windows.lengths) and hits_at is not None:
            continue
        out = out.mapInArrow(_marker(spark.sparkContext.broadcast(windows), text_at, hits_at, name), schema)
        hits_at = len(docs.columns)
    return out


def contaminated(hits):
    """The rule on the ``hits`` column: at least one word in 20 is hit."""
    return (hits["n_hit"] > 0) & (hits["n_hit"] * 20 >= hits["n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items, spans, contaminated."""
    h = F.col("hits")
    marked = mark_hits(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    return marked.select("doc_id", "hits.n_words", "hits.n_hit", "hits.items", "hits.spans",
                         contaminated(h).alias("contaminated"))


def _unused(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    name = _unused(docs, "hits")
    marked = mark_hits(docs, benchmark, window, block_bytes, name)
    return marked.filter(~contaminated(F.col(name))).drop(name)


def cut_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All documents, with the hit spans cut out of their texts."""
    name, schema = _unused(docs, "hits"), docs.schema
    text_at = docs.columns.index("text")

    def run(batches):
        table = alphanumeric()
        for batch in batches:
            texts = []
            spans_of = batch.column(len(schema)).to_pylist()
            row = 0
            for i, j, words in batch_words(batch.column(text_at), table):
                for r in range(i, j):
                    begin, stop = int(words.bounds[r - i]), int(words.bounds[r - i + 1])
                    parts, at, w0 = [], begin, int(words.first[r - i])
                    for s in spans_of[row]["spans"]:
                        parts.append(words.data[at:words.start[w0 + s["first"]]].tobytes())
                        at = int(words.end[w0 + s["last"]])
                    parts.append(words.data[at:stop].tobytes())
                    texts.append(b"".join(parts).decode())
                    row += 1
            valid = batch.column(text_at).is_valid().to_pylist()
            columns = [*batch.columns[:len(schema)]]
            columns[text_at] = pa.array([t if v else None for t, v in zip(texts, valid)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return mark_hits(docs, benchmark, window, block_bytes, name).mapInArrow(run, schema)
