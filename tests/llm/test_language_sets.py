"""Sets of more than three languages."""

import random

import numpy as np
import pytest

from custodia.llm import language_id
from custodia.llm.words import alphanumeric, batch_words

NAMES = "ab cd fg hk lm".split()


def sentence(rng, k, n):
    letters = "abcdefghijklmnopqrstuvwxy"[5 * k:5 * k + 5]
    return " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
def test_equal_parts_in_so_many_languages(spark, size):
    rng = random.Random(3)
    learn = spark.createDataFrame([(10 * k + i, sentence(rng, k, 200), NAMES[k]) for k in range(5) for i in range(4)],
                                  "doc_id long, text string, lang string")
    text = " ".join(sentence(rng, k, 150) for k in range(size))
    got = language_id.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"),
                               language_id.train(learn)).first().identified
    assert sorted(got.languages) == NAMES[:size]
    assert got.score == pytest.approx(1 / size, abs=0.02)


def test_no_size_of_the_set_is_missed():
    import pyarrow as pa

    rng, gen = random.Random(4), np.random.default_rng(4)
    table = np.log(gen.dirichlet(np.full(language_id.BUCKETS, 0.01), 6) + 1e-7).astype(np.float32)
    texts = [" ".join(sentence(rng, rng.randrange(5), 1) for _ in range(rng.choice((1, 3, 20, 200)))) for _ in range(40)]
    for _, _, words in batch_words(pa.array(texts), alphanumeric()):
        chosen, rows = language_id._infer(words, table)
        grams, at = language_id._trigrams(words)
        like = np.stack([np.add.reduceat(one[grams], at) for one in table], axis=1).astype(np.float64)
        p = np.exp(like - like.max(axis=1, keepdims=True))
        n, first = words.counts[rows], words.first[rows]
        row = np.repeat(np.arange(len(rows)), n)
        theta, _ = language_id._fit(p, row, first, n, np.full((len(rows), 6), 1 / 6), language_id.ROUNDS)
        rank = np.argsort(np.argsort(-theta, axis=1, kind="stable"), axis=1, kind="stable")
        sizes = []
        for size in range(1, 7):
            start = np.where(rank < size, theta + 1e-9, 0.0)
            start /= start.sum(axis=1, keepdims=True)
            fitted, value = language_id._fit(p, row, first, n, start, 0 if size == 1 else 3)
            sizes.append((value - language_id.PENALTY * (size - 1) * np.log(n + 1.0), fitted))
        best = np.argmax([v for v, _ in sizes], axis=0)
        np.testing.assert_allclose(chosen, np.stack([sizes[b][1][k] for k, b in enumerate(best)]))
