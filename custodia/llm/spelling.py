"""Spelling variants by k-d trees over letter-count vectors.

One inserted, deleted or replaced letter changes the letter counts of a word
by an L1 distance of one or two. Words of each length lie in a k-d tree over
their counts (accented letters share six dimensions, which only shortens
distances). For each pair of lengths that one edit allows, a word looks into
the boxes within that distance, and the candidates found there are verified
letter by letter.

The upper part of the trees deals the words out: per length with more than
``CELL`` words, splits are fitted on a bounded sample of the vocabulary; they
only decide where a word lies, every word is in the index. A word goes to its
own cell and visits the other cells within reach (once per pair of cells). A
cell with more than twice ``CELL`` words, which equal vectors can make, is
split into parts, and its words visit the parts behind their own. A task
holds one part of a cell with its own small tree and lets the visitors pass
by, so its memory is bounded.

Words are counted by grouping, so a common word is added up before the
shuffle. Forms are followed by pointer jumping: counts at least double on the
way, so a few rounds end it.

Defined cases: NULL and empty texts have no words; a NULL id counts as an
empty one; rows that repeat an id count each; ties of the largest count go to
the smallest word in code-point order; a table without words gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm import kd_tree
from custodia.llm.tables import kept

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 5
MIN_COUNT = 3
#: Words of a cell, and words on which the cells are fitted.
CELL = 8192
SAMPLE = 65536
#: Words of a leaf of a task's tree; letters compared at once.
LEAF = 48
_COMPARED = 1 << 22

_DIMS = 32
_ROWS = "length int, cell int, part int, visits int, word string, n long"


def word_counts(docs: DataFrame, one_in: int = 97, min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the runs of letters, A-Z in lower case. A run whose
    checksum with the id is a multiple of ``one_in`` loses one letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = (runs.filter(F.length("run") >= min_length)
            .select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
            .withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))))
    spoilt = F.expr("concat(substring(run, 1, cast(h % length(run) AS int)), "
                    "substring(run, cast(h % length(run) AS int) + 2))")
    word = F.when(F.col("h") % one_in == 0, spoilt).otherwise(F.col("run"))
    return (runs.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") >= min_count) & (F.length("word") >= min_length)))


# -- letters ---------------------------------------------------------------

def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row per word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    n, length = codes.shape
    dim = np.where(codes < 128, codes.astype(np.int64) - 97, 26 + codes % 6)
    at = np.arange(n)[:, None] * _DIMS + dim
    return np.bincount(at.ravel(), minlength=n * _DIMS).reshape(n, _DIMS).astype(np.int32)


def _signature(counts: np.ndarray) -> np.ndarray:
    """Two bits per dimension, at least one and at least two: the bits that
    differ are no more than the L1 distance."""
    bits = np.concatenate([counts >= 1, counts >= 2], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long_: np.ndarray) -> np.ndarray:
    """Equal up to some place, and shifted by one from there on."""
    size = short.shape[1]
    front, back = short != long_[:, :-1], short != long_[:, 1:]
    equal_front = np.where(front.any(axis=1), front.argmax(axis=1), size)
    equal_back = np.where(back.any(axis=1), back[:, ::-1].argmax(axis=1), size)
    return equal_front + equal_back >= size


class Cell:
    """Words of one length with their tree."""

    def __init__(self, words: list[str], counts: list[int], length: int):
        self.words, self.n, self.length = words, counts, length
        self.codes = _codes(words, length)
        points = letter_counts(self.codes)
        self.points, self.bits = points, _signature(points)
        self.tree, self.leaves = kd_tree.build(points, LEAF)

    def near(self, codes: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``codes``, word of the cell) that are one edit apart;
        ``codes`` are words of the same length or one letter shorter."""
        same = codes.shape[1] == self.length
        within = 2 if same else 1
        bits = _signature(points)
        left, right = [], []
        for leaf, rows in kd_tree.reached(self.tree, points, within):
            mine = self.leaves[leaf]
            apart = np.bitwise_count(bits[rows][:, None] ^ self.bits[mine][None, :])
            i, j = np.nonzero(apart <= within)
            i, j = rows[i], mine[j]
            step = max(1, _COMPARED // self.length)
            for at in range(0, len(i), step):
                a, b = i[at:at + step], j[at:at + step]
                verify = one_replaced if same else one_inserted
                good = verify(codes[a], self.codes[b])
                left.append(a[good])
                right.append(b[good])
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *left]), np.concatenate([empty, *right])


# -- tasks -----------------------------------------------------------------

def _dealer(trees: dict[int, kd_tree.KdTree], parts: dict[tuple[int, int], int] | None) -> Callable:
    """Each word to its cell, and to the cells it visits; without ``parts``
    to its cell alone."""

    def part_of(word: str, n: int) -> int:
        return xxhash.xxh3_64_intdigest(word) % n

    def cells(length: int, points: np.ndarray, within: int) -> Iterator[tuple[int, np.ndarray]]:
        if length in trees:
            yield from kd_tree.reached(trees[length], points, within)
        else:
            yield 0, np.arange(len(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_length: dict[int, list[int]] = {}
            for k, w in enumerate(words):
                by_length.setdefault(len(w), []).append(k)
            out: list[tuple[int, int, int, int, int]] = []
            for length, rows in by_length.items():
                points = letter_counts(_codes([words[k] for k in rows], length))
                home = np.zeros(len(rows), np.int64)
                for cell, here in cells(length, points, 0):
                    home[here] = cell
                if parts is None:
                    out += [(length, int(c), 0, 0, k) for k, c in zip(rows, home)]
                    continue
                for k, c in zip(rows, home.tolist()):
                    n_parts = parts.get((length, c), 1)
                    own = part_of(words[k], n_parts)
                    out.append((length, c, own, 0, k))
                    out += [(length, c, p, 1, k) for p in range(own + 1, n_parts)]
                for other, within in ((length, 2), (length + 1, 1)):
                    for cell, here in cells(other, points, within):
                        if other == length:
                            here = here[home[here] < cell]
                        for p in range(parts.get((other, cell), 1)):
                            out += [(other, cell, p, 1, rows[k]) for k in here.tolist()]
            columns = list(zip(*out)) or [()] * 5
            take = pa.array(columns[4], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int32()) for c in columns[:4]), batch.column(0).take(take), batch.column(1).take(take)],
                names=["length", "cell", "part", "visits", "word", "n"])
    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of length, cell, part and visits: the words of a
    part come first and make its tree, the visitors then pass by."""
    key, cell, words, counts = None, None, [], []

    def pairs(left: list[str], right: list[str], n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(n, pa.int64())],
            names=["word", "other", "other_n"])

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal cell
        if words and cell is None:
            cell = Cell(words, counts, key[0])
            for at in range(0, len(words), 1 << 13):
                some = slice(at, at + (1 << 13))
                a, b = cell.near(cell.codes[some], cell.points[some])
                yield pairs([words[at + k] for k in a], [words[k] for k in b], [counts[k] for k in b])

    for batch in batches:
        keys = np.stack([np.asarray(batch.column(k)) for k in range(4)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if lo == hi:
                continue
            part, visits = tuple(keys[lo, :3].tolist()), int(keys[lo, 3])
            new_words = batch.column(4).slice(lo, hi - lo).to_pylist()
            new_counts = batch.column(5).slice(lo, hi - lo).to_pylist()
            if part != key:
                yield from closed()
                key, cell, words, counts = part, None, [], []
            if not visits:
                words += new_words
                counts += new_counts
                continue
            yield from closed()
            if cell is None:
                continue                          # nobody lives here
            by_length: dict[int, list[int]] = {}
            for k, w in enumerate(new_words):
                by_length.setdefault(len(w), []).append(k)
            for length, rows in by_length.items():
                codes = _codes([new_words[k] for k in rows], length)
                a, b = cell.near(codes, letter_counts(codes))
                found = [(rows[i], j) for i, j in zip(a.tolist(), b.tolist())]
                there, here = [new_words[i] for i, _ in found], [words[j] for _, j in found]
                yield pairs(there + here, here + there,
                            [counts[j] for _, j in found] + [new_counts[i] for i, _ in found])
    yield from closed()


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, other, other_n): all words one edit apart, in both directions."""
    words = words.select("word", "n")
    sized = words.withColumn("length", F.length("word"))
    crowded = {r.length: r["count"] for r in sized.groupBy("length").count().filter(F.col("count") > cell).collect()}
    trees: dict[int, kd_tree.KdTree] = {}
    if crowded:
        # sample words in the order of their hashes, whatever the size of the vocabulary
        drawn = (sized.filter(F.col("length").isin(list(crowded))).orderBy(F.xxhash64("word"), "word")
                 .limit(sample).select("word").toArrow().column(0).to_pylist())
        for length, n in crowded.items():
            mine = [w for w in drawn if len(w) == length]
            if mine:
                most = max(1, len(mine) * cell // (2 * n))
                trees[length], _ = kd_tree.build(letter_counts(_codes(mine, length)), most)
    crowds = (words.mapInArrow(_dealer(trees, None), _ROWS).groupBy("length", "cell").count()
              .filter(F.col("count") > 2 * cell).collect())
    parts = {(r.length, r.cell): -(-r["count"] // cell) for r in crowds}
    dealt = words.mapInArrow(_dealer(trees, parts), _ROWS)
    return (dealt.repartition("length", "cell", "part")
            .sortWithinPartitions("length", "cell", "part", "visits")
            .mapInArrow(_search, "word string, other string, other_n long"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, given (word, form)."""
    at = kept(forms.select("word", F.col("form").alias("root")))
    while True:
        following = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = kept(at.join(following, "root", "left")
                    .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    words = kept(word_counts(docs))
    near = (near_words(words, cell, sample).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"),
                 F.min(F.struct((-F.col("other_n")).alias("down"), F.col("other").alias("form"))).alias("best")))
    form_n = -F.col("best.down")
    judged = kept(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(form_n >= 2 * F.col("n"), F.col("best.form")).alias("form"),
        F.when(form_n >= 2 * F.col("n"), form_n).alias("form_n")))
    ends = roots(judged.filter("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
