"""Substring hashes and sketches of whole blocks of lines against single ones."""

import random

import numpy as np

from custodia.llm import line_dedup, line_keys


def hashes(line, edits):
    keys, own = line_keys.segment_hashes(line_keys.codes_of([line], len(line)), edits)
    return keys[0].tolist(), own.tolist()


def test_equal_segments_have_equal_keys_and_others_do_not():
    rng = random.Random(5)
    lines = ["".join(rng.choice("abé😀") for _ in range(rng.randint(6, 40))) for _ in range(400)]
    lines += [x[:k] + "zz" + x[k + 1:] for x in lines for k in [rng.randrange(len(x))]]
    named = {}
    for line in lines:
        own, more = line_keys.places(len(line), 2)
        got, mine = hashes(line, 2)
        assert mine == [True] * len(own) + [False] * len(more)
        for (i, at, size), key in zip(own + more, got):
            assert named.setdefault(key, (i, line[at:at + size])) == (i, line[at:at + size])
    assert len(set(named.values())) == len(named)


def test_blocks_equal_single_lines():
    rng = random.Random(6)
    lines = ["".join(rng.choice("ab c") for _ in range(30)) for _ in range(50)]
    codes = line_keys.codes_of(lines, 30)
    keys, _ = line_keys.segment_hashes(codes, 2)
    sketches = line_keys.sketches(codes)
    for k, line in enumerate(lines):
        assert keys[k].tolist() == hashes(line, 2)[0]
        assert (sketches[k] == line_keys.sketches(line_keys.codes_of([line], 30))[0]).all()


def test_an_edit_changes_few_bits():
    rng = random.Random(7)
    for _ in range(3000):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 60)))
        b = list(a)
        for _ in range(2):
            p = rng.randrange(len(b))
            b[p:p + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        x, y = (line_keys.sketches(line_keys.codes_of([t], len(t)))[0].view(np.uint64) for t in (a, "".join(b)))
        apart = np.bitwise_count(x ^ y)
        assert np.bitwise_count((x[0] ^ y[0]) & np.uint64((1 << 56) - 1)) <= 2 * line_keys.LETTER_CHANGES
        assert apart[1:].sum() <= 2 * line_keys.PAIR_CHANGES


def test_a_column_with_the_name_of_an_own_one(spark):
    docs = spark.createDataFrame([(1, "a line of more than twenty letters", 5, "x"), (2, "a line of more than twenty letter", 6, "y")],
                                 "doc_id long, text string, __dropped int, __doc string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "a line of more than twenty letters", 5, "x")]
    nameless = spark.createDataFrame([(None, "x" * 30), (None, "x" * 30), (3, "x" * 30)], "doc_id long, text string")
    assert line_dedup.dedup_lines(nameless).count() == 3
