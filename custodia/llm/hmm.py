"""Hidden Markov language model, trained by Baum-Welch over partitions.

The alphabet is bounded: the most frequent words of the training texts are
symbols of their own, every other word belongs to a class by its ending and
length, and one symbol ends a text. Latent states emit symbols; a word of a
class has its smoothed share of the class. Every round of training adds up
the expected counts of all training texts, per partition in tasks and then
by a grouped sum, and only these counts (states times symbols) reach the
driver. Texts are cut into segments for training alone; scores come from
the scaled forward recursion over the whole text, so they are the exact
log-probabilities of the model.

Word counts, their number and the scores of rare words cover the whole
vocabulary: it stays in a table that is joined by word, never broadcast.
The first parameters come from a bounded sample of texts (``SAMPLE``).

Defined cases: NULL and empty texts are the end symbol alone; a NULL doc_id
is held out; repeated rows are separate documents; without training texts
all words are unknown; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.tables import kept, most_frequent
from custodia.llm.words import Words, batch_words, blank_separated, mix

STATES = 8
FREQUENT = 60_000
CLASSES = 2048
MIN_COUNT = 5
ROUNDS = 3
SAMPLE = 2000
SAMPLE_WORDS = 400
SEGMENT = 128
_BLOCK = 512               # rows that one recursion takes side by side
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(True))


def _classes(words: Words) -> np.ndarray:
    """Class of each word by its last two bytes and its length."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    length = words.end - words.start
    last = _LOWER[words.data[words.end - 1]].astype(np.uint64)
    before = _LOWER[words.data[np.maximum(words.end - 2, words.start)]].astype(np.uint64)
    code = (last << np.uint64(16)) | (before << np.uint64(8)) | np.minimum(length // 3, 5).astype(np.uint64)
    return (mix(code + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[np.ndarray] = []
        kinds: list[np.ndarray] = []
        size = 0

        def flush():
            words, at, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(np.concatenate(kinds)[at]), pa.array(n.astype(np.int64))],
                names=["word", "class", "n"])

        for _, _, words in batch_words(batch.column(0), blank_separated()):
            held.append(words.hashes())
            kinds.append(_classes(words))
            size += len(held[-1])
            if size >= 1 << 22:
                yield flush()
                held, kinds, size = [], [], 0
        if size:
            yield flush()


def _encode(frequent) -> Callable:
    """Per text its symbols, and the hashes of its words of classes."""
    def run(batches):
        known, place = frequent.value
        n = len(known)
        for batch in batches:
            symbols, rare = [], []
            for i, j, words in batch_words(batch.column(2), blank_separated()):
                h = words.hashes()
                at = np.searchsorted(known, h)
                at[at == n] = 0
                hit = known[at] == h if n else np.zeros(len(h), bool)
                codes = np.where(hit, place[at] if n else 0, FREQUENT + _classes(words)).astype(np.uint16)
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    symbols.append(np.append(codes[a:b], np.uint16(FREQUENT + CLASSES)).tobytes())
                    rare.append(h[a:b][~hit[a:b]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(symbols, pa.binary()), pa.array(rare, pa.binary())],
                names=["doc_id", "held_out", "symbols", "rare"])
    return run


def _rare_words(batches):
    """Rows (row, word, class, n) of the words of classes of each text."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for row, symbols, rare in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            h = np.frombuffer(rare.as_buffer(), np.uint64)
            if not len(h):
                continue
            s = np.frombuffer(symbols.as_buffer(), np.uint16).astype(np.int64)[:-1]
            words, at, n = np.unique(h, return_index=True, return_counts=True)
            out[0].append(np.full(len(words), row, np.int64))
            out[1].append(words.view(np.int64))
            out[2].append(s[s >= FREQUENT][at] - FREQUENT)
            out[3].append(n.astype(np.int64))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                             names=["row", "word", "class", "n"])


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, around: np.ndarray):
        self.start, self.move, self.emit, self.around = start, move, emit, around


def forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each symbol sequence, exactly."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda r: -len(texts[r]))
    emit = np.ascontiguousarray(model.emit.T)
    for at in range(0, len(order), _BLOCK):
        rows = order[at:at + _BLOCK]
        sizes = np.array([len(texts[r]) for r in rows])
        total = np.zeros(len(rows))
        state = np.tile(model.start, (len(rows), 1))
        for lo in range(0, int(sizes[0]), 4096):
            width = min(4096, int(sizes[0]) - lo)
            here = int((sizes > lo).sum())
            block = np.zeros((width, here), np.int64)
            for c in range(here):
                part = texts[rows[c]][lo:lo + width]
                block[:len(part), c] = part
            for t in range(width):
                n = int(np.searchsorted(-sizes, -(lo + t), "left"))
                now = state[:n] * emit[block[t, :n]]
                scale = now.sum(axis=1)
                total[:n] += np.log(scale)
                state[:n] = (now / scale[:, None]) @ model.move
        out[rows] = total
    return out


def _segments(texts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols [SEGMENT, rows], lengths, whether a text begins) blocks."""
    parts: list[tuple[np.ndarray, bool]] = []

    def block():
        symbols = np.zeros((SEGMENT, len(parts)), np.int64)
        for c, (p, _) in enumerate(parts):
            symbols[:len(p), c] = p
        return symbols, np.array([len(p) for p, _ in parts]), np.array([b for _, b in parts])

    for text in texts:
        for at in range(0, len(text), SEGMENT):
            parts.append((text[at:at + SEGMENT], at == 0))
            if len(parts) == 1024:
                yield block()
                parts = []
    if parts:
        yield block()


class Counts:
    """Expected counts of starts, moves and emissions."""

    def __init__(self, states: int, symbols: int):
        self.start, self.move = np.zeros(states), np.zeros((states, states))
        self.emit = np.zeros((states, symbols))

    def add(self, model: Model, texts: Iterator[np.ndarray]) -> None:
        """Forward-backward over the segments of some texts."""
        emit = np.ascontiguousarray(model.emit.T)
        for symbols, lengths, begins in _segments(texts):
            width, n = int(lengths.max()), len(lengths)
            states = len(model.start)
            alpha, given = np.empty((width, n, states)), emit[symbols[:width]]
            inside = np.arange(width)[:, None] < lengths[None, :]
            given[~inside] = 1.0
            scale = np.empty((width, n))
            now = np.where(begins[:, None], model.start, model.around) * given[0]
            for t in range(width):
                if t:
                    now = (alpha[t - 1] @ model.move) * given[t]
                scale[t] = now.sum(axis=1)
                alpha[t] = now / scale[t][:, None]
            beta = np.ones((n, states))
            gamma = alpha
            last = gamma[width - 1] * inside[width - 1][:, None]
            keep = [last]
            for t in range(width - 2, -1, -1):
                ahead = given[t + 1] * beta / scale[t + 1][:, None]
                ahead_in = ahead * inside[t + 1][:, None]
                self.move += alpha[t].T @ ahead_in * model.move
                beta = np.where(inside[t + 1][:, None], ahead @ model.move.T, 1.0)
                g = alpha[t] * beta
                keep.append(g / g.sum(axis=1, keepdims=True) * inside[t][:, None])
            keep.reverse()
            gamma = np.stack(keep)
            self.start += gamma[0][begins].sum(axis=0)
            flat, mask = symbols[:width][inside], gamma[inside]
            for k in range(states):
                self.emit[k] += np.bincount(flat, mask[:, k], minlength=self.emit.shape[1])

    def model(self, share: np.ndarray, smooth: float = 200.0) -> Model:
        """Parameters from the counts; ``share``: symbol frequencies."""
        start = (self.start + 1) / (self.start + 1).sum()
        move = (self.move + 1) / (self.move + 1).sum(axis=1, keepdims=True)
        emit = self.emit + smooth * share
        around = (self.emit.sum(axis=1) + 1) / (self.emit.sum() + len(start))
        return Model(start, move, emit / emit.sum(axis=1, keepdims=True), around)


def _expected(sent, states: int, symbols: int) -> Callable:
    """Expected counts of a partition: rows (symbol, g0, ...); symbol -1
    has the starts, -2-k the moves from state k."""
    def run(batches):
        counts = Counts(states, symbols)
        for batch in batches:
            counts.add(sent.value, (np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(0)))
        used = np.flatnonzero(counts.emit.sum(axis=0))
        names = np.concatenate([used, [-1], -2 - np.arange(states)]).astype(np.int64)
        values = np.concatenate([counts.emit[:, used].T, counts.start[None], counts.move])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), *[pa.array(np.ascontiguousarray(values[:, k])) for k in range(states)]],
            names=["symbol", *[f"g{k}" for k in range(states)]])
    return run


def _first_model(texts: list[np.ndarray], share: np.ndarray, states: int) -> Model:
    """Start values from a sample: texts are grouped by their words, each
    group gives a state, and states tend to stay."""
    symbols = len(share)
    rng = np.random.Generator(np.random.PCG64(11))
    texts = [t[:SAMPLE_WORDS].astype(np.int64) for t in texts if len(t)]
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    r = rng.dirichlet(np.full(states, 0.3), max(len(texts), 1))[:len(texts)]
    emit = np.tile(share, (states, 1))
    for _ in range(15 if texts else 0):
        emit = np.stack([np.bincount(flat, r[row, k], minlength=symbols) for k in range(states)]) + 50 * share
        emit /= emit.sum(axis=1, keepdims=True)
        weight = np.log(r.sum(axis=0) + 1)
        like = np.stack([np.bincount(row, np.log(emit[k][flat]), minlength=len(texts)) for k in range(states)], axis=1)
        like = (like + weight) * 0.5
        r = np.exp(like - like.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    model = Model(np.full(states, 1 / states), move, emit, np.full(states, 1 / states))
    for _ in range(3 if texts else 0):
        counts = Counts(states, symbols)
        counts.add(model, texts)
        model = counts.model(share, smooth=50.0)
    return model


def _forward_rows(sent) -> Callable:
    def run(batches):
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(forward(sent.value, texts) / np.log(10))], names=["row", "path"])
    return run


def _base(sent) -> Callable:
    """Sums over a text's frequent words and end: log10 shares, known."""
    def run(batches):
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(1)]
            sums = [float(sent.value[t].sum()) for t in texts]
            rare = [int(((t >= FREQUENT) & (t < FREQUENT + CLASSES)).sum()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums, pa.float64()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(rare, pa.int64())],
                names=["row", "base", "n_tokens", "n_rare"])
    return run


def lm_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score."""
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    counts = kept(rows.filter(~F.col("held_out")).select("text")
                  .mapInArrow(_count, "word long, class long, n long")
                  .groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n")))

    top, bound = most_frequent(counts.filter(F.col("n") >= MIN_COUNT), FREQUENT)
    top = top.select("word", "n").toArrow()
    words = np.asarray(top.column("word").combine_chunks(), np.int64).view(np.uint64)
    often = np.asarray(top.column("n").combine_chunks(), np.int64)
    order = np.argsort(words)
    frequent = context.broadcast((words[order], order.astype(np.int64)))
    is_rare = F.col("n") < bound

    texts = kept(rows.mapInArrow(_encode(frequent), "doc_id long, held_out boolean, symbols binary, rare binary")
                 .withColumn("row", F.monotonically_increasing_id()))
    training = texts.filter(~F.col("held_out")).select("symbols")

    # sizes of the vocabulary and of its classes
    ends = training.count()
    whole = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_all, v_all = int(whole.n) + ends, int(whole.v) + (1 if ends else 0)
    below = n_all + 0.1 * (v_all + 1)
    rare = counts.filter(is_rare)
    by_class = {r["class"]: (r.n, r.v) for r in rare.groupBy("class").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    class_n, class_v = (np.array([by_class.get(c, (0, 0))[k] for c in range(CLASSES)], float) for k in (0, 1))
    symbols = FREQUENT + CLASSES + 1
    seen = np.zeros(symbols)
    seen[:len(often)] = often
    seen[FREQUENT:FREQUENT + CLASSES] = class_n
    seen[-1] = ends
    usable = np.concatenate([np.arange(FREQUENT) < len(often), np.ones(CLASSES + 1, bool)])
    share = np.where(usable, seen + 0.1, 0.0)
    share /= share.sum()

    # training: expected counts of all training texts in every round
    sample = (texts.filter(~F.col("held_out")).orderBy(F.xxhash64("doc_id"), "row").limit(SAMPLE)
              .select(F.substring("symbols", 1, 2 * SAMPLE_WORDS).alias("s")).collect())
    model = _first_model([np.frombuffer(bytes(r.s), np.uint16) for r in sample], share, states)
    names = [f"g{k}" for k in range(states)]
    for _ in range(rounds if ends else 0):
        summed = (training.mapInArrow(_expected(context.broadcast(model), states, symbols),
                                      "symbol long, " + ", ".join(f"{g} double" for g in names))
                  .groupBy("symbol").agg(*[F.sum(g).alias(g) for g in names]).toArrow())
        at = np.asarray(summed.column("symbol").combine_chunks(), np.int64)
        values = np.stack([np.asarray(summed.column(g).combine_chunks(), np.float64) for g in names], axis=1)
        counts_ = Counts(states, symbols)
        counts_.emit[:, at[at >= 0]] = values[at >= 0].T
        counts_.start = values[at == -1][0]
        for k in range(states):
            counts_.move[k] = values[at == -2 - k][0]
        model = counts_.model(share)

    # words of classes, by joining the vocabulary
    class_below = class_n + 0.1 * (class_v + 1)
    per_class = spark.createDataFrame([(c, float(class_below[c])) for c in range(CLASSES)], "class long, below double")
    n = F.coalesce("seen", F.lit(0))
    used = (texts.select("row", "symbols", "rare").mapInArrow(_rare_words, "row long, word long, class long, n long")
            .join(counts.select("word", F.col("n").alias("seen")), "word", "left").join(per_class, "class")
            .groupBy("row").agg(
                F.sum(F.col("n") * F.log10((n + 0.1) / below)).alias("rare_base"),
                F.sum(F.col("n") * F.log10((n + 0.1) / F.col("below"))).alias("rare_score"),
                F.sum(F.when(n > 0, F.col("n")).otherwise(0)).alias("rare_known")))
    logs = np.zeros(symbols)
    logs[:len(often)] = np.log10((often + 0.1) / below)
    logs[-1] = np.log10((ends + 0.1) / below)
    ids = texts.select("row", "symbols")
    plain = ids.mapInArrow(_base(context.broadcast(logs)), "row long, base double, n_tokens long, n_rare long")
    path = ids.mapInArrow(_forward_rows(context.broadcast(model)), "row long, path double")
    zero = F.lit(0.0)
    return (texts.select("row", "doc_id", "held_out").join(plain, "row").join(path, "row").join(used, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("n_tokens") - F.col("n_rare") + F.coalesce("rare_known", F.lit(0))
                     - (0 if ends else 1)).cast("long").alias("n_known"),
                    F.lit(n_all).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
                    (F.col("path") + F.coalesce("rare_score", zero)).alias("score")))
