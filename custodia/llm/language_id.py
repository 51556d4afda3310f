"""Language identification by multilingual mixture inference.

Byte trigrams of words (with word boundaries) are counted per language over
all training documents. A document is a mixture of languages: each word has
a likelihood under every language, the product of its trigrams, and
expectation-maximisation finds the proportions of the languages. Then the
set of languages is chosen among the leading one, two, ... up to all of them
by likelihood minus a penalty for each further language; sizes that cannot
win by an upper bound of the likelihood are not fitted. The prediction is the
language with the largest proportion of the chosen set, the score its proportion.

Trigrams fall into a fixed number of buckets, so the model's size depends
on the number of languages alone, which is checked before it is broadcast.

Defined cases: NULL text and texts without a letter get ``und`` with score
0; rows with NULL language are not learned from; without any training row
all is ``und``; equal proportions go to the smaller language name; repeated
rows are separate documents; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.llm.words import Words, alphanumeric, batch_words

BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 8
PENALTY = 2.0
MAX_LANGUAGES = 1024
UNDETERMINED = "und"

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("languages", T.ArrayType(T.StringType()))])
_ARROW_RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()),
                           ("languages", pa.list_(pa.string()))])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte's trigram, for all word bytes in order, and for
    each word the place of its first one."""
    length = words.end - words.start
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(first - words.start, length)
    low = _LOWER[words.data]
    middle = low[at].astype(np.uint32)
    left = low[np.maximum(at - 1, 0)].astype(np.uint32)
    right = low[np.minimum(at + 1, len(low) - 1)].astype(np.uint32)
    left[first] = 0x20
    right[first + length - 1] = 0x20
    code = (left << np.uint32(16)) | (middle << np.uint32(8)) | right
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), first


def is_training(doc_id: Column) -> Column:
    """Documents that may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column(1).to_pylist()
        for i, j, words in batch_words(batch.column(0), alphanumeric()):
            if not len(words.start):
                continue
            grams, first = _trigrams(words)
            starts = np.append(first, len(grams))
            for r in range(i, j):
                a, b = starts[words.first[r - i]], starts[words.first[r - i + 1]]
                if b > a:
                    held = counts.setdefault(names[r], np.zeros(BUCKETS, np.int64))
                    held += np.bincount(grams[a:b], minlength=BUCKETS)
    for name, held in counts.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(held[at])],
                                         names=["lang", "bucket", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, bucket]) of all rows of
    ``docs`` with a text and a language."""
    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")) \
        .filter("lang IS NOT NULL AND text IS NOT NULL")
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counted = rows.mapInArrow(_count, "lang string, bucket long, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted.column("lang").to_pylist()))
    place = {name: k for k, name in enumerate(names)}
    table = np.zeros((len(names), BUCKETS))
    table[[place[x] for x in counted.column("lang").to_pylist()],
          np.asarray(counted.column("bucket").combine_chunks(), np.int64)] = \
        np.asarray(counted.column("n").combine_chunks(), np.float64)
    if names:
        table = np.log((table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    return names, table.astype(np.float32)


def _fit(p: np.ndarray, row: np.ndarray, first: np.ndarray, n: np.ndarray,
         theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixture proportions of each document, and its log-likelihood
    (relative to the best language of each word)."""
    like = None
    for step in range(rounds + 1):
        r = p * theta[row]
        total = r.sum(axis=1)
        like = np.add.reduceat(np.log(np.maximum(total, 1e-300)), first)
        if step < rounds:
            r /= np.maximum(total, 1e-300)[:, None]
            theta = np.add.reduceat(r, first, axis=0) / n[:, None]
    return theta, like


def _most(p: np.ndarray, row: np.ndarray, first: np.ndarray, n: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """An upper bound of each document's log-likelihood under any
    proportions: the logarithm is concave, so none exceeds that of ``theta``
    by more than n log of the largest mean ratio of a language's likelihood
    to the mixture's."""
    total = np.maximum((p * theta[row]).sum(axis=1), 1e-300)
    ratio = np.add.reduceat(p / total[:, None], first, axis=0) / n[:, None]
    most = np.add.reduceat(np.log(total), first) + n * np.log(ratio.max(axis=1))
    return most + 1e-9 * (n + np.abs(most))


def _infer(words: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows that have words: their proportions, with 0 for
    languages outside the chosen set; and which rows these are."""
    rows = np.flatnonzero(words.counts > 0)
    grams, first_gram = _trigrams(words)
    like = np.stack([np.add.reduceat(one[grams], first_gram) for one in table], axis=1).astype(np.float64)
    p = np.exp(like - like.max(axis=1, keepdims=True))
    n = words.counts[rows]
    first = words.first[rows]
    row = np.repeat(np.arange(len(rows)), n)
    theta, _ = _fit(p, row, first, n, np.full((len(rows), len(table)), 1 / len(table)), ROUNDS)
    order = np.argsort(-theta, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    most = _most(p, row, first, n, theta)
    chosen, best = _fit(p, row, first, n, (rank == 0).astype(np.float64), 0)
    for size in range(2, len(table) + 1):
        penalty = PENALTY * (size - 1) * np.log(n + 1.0)
        at = np.flatnonzero(most - penalty > best)      # only shrinks with size
        if not len(at):
            break
        start = np.where(rank[at] < size, theta[at] + 1e-9, 0.0)
        start /= start.sum(axis=1, keepdims=True)
        fitted, value = _fit(p[np.isin(row, at)], np.repeat(np.arange(len(at)), n[at]),
                             np.cumsum(n[at]) - n[at], n[at], start, 3)
        value = value - penalty[at]
        better = value > best[at]
        best[at[better]] = value[better]
        chosen[at[better]] = fitted[better]
    return chosen, rows


def _has_letter(words: Words) -> np.ndarray:
    data, bounds = words.data, words.bounds
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    count = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = count[bounds[1:]] > count[bounds[:-1]]
    for r in np.flatnonzero(~found):
        part = data[bounds[r]:bounds[r + 1]]
        if (part >= 0x80).any():
            found[r] = any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace"))
    return found


def _predict(model, text_at: int, name: str) -> Callable:
    def run(batches):
        names, table = model.value
        for batch in batches:
            out: list[dict] = []
            for i, j, words in batch_words(batch.column(text_at), alphanumeric()):
                found = [{"lang_pred": UNDETERMINED, "score": 0.0, "languages": []} for _ in range(j - i)]
                if names and len(words.start):
                    letters = _has_letter(words)
                    theta, rows = _infer(words, table)
                    for r, t in zip(rows.tolist(), theta):
                        if letters[r]:
                            k = int(t.argmax())
                            found[r] = {"lang_pred": names[k], "score": float(min(1.0, t[k])),
                                        "languages": [names[x] for x in np.argsort(-t, kind="stable") if t[x] > 0.01]}
                out += found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _ARROW_RESULT)],
                                             names=[*batch.schema.names, name])
    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], name: str = "identified") -> DataFrame:
    """``docs`` with a column ``name``: lang_pred, score and the languages
    chosen for the document, largest proportion first."""
    if name in docs.columns:
        raise ValueError(f"column {name} exists")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, RESULT)])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict(sent, docs.columns.index("text"), name), schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, languages; learned
    from the documents that ``is_training`` names."""
    model = train(docs.filter(is_training(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "identified.lang_pred", "identified.score", "identified.languages")


def identified_only(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language can be told, unchanged."""
    name = "identified"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    model = train(docs.filter(is_training(F.col("doc_id"))))
    marked = identify(docs, model, name)
    return marked.filter(F.col(name)["lang_pred"] != UNDETERMINED).drop(name)
