"""Cases at the edges: large scores, participants with similar names."""

import collections

import numpy as np
import pytest

from custodia.llm import chat, topk


def brute(rows, every, k=5):
    whole = {}
    for n, (i, v) in enumerate(rows):
        whole[n] = (i, [int(np.floor(256 * float(x))) for x in v])
    out = {}
    for i, q in whole.values():
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in whole.values() if j != i and len(c) == len(q))
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


@pytest.mark.parametrize("size", [1.0, 1e6, 1.5e6])
def test_large_scores_are_exact(spark, size):
    rng = np.random.default_rng(int(size))
    rows = [(i, [float(x) for x in rng.normal(size=20) * size]) for i in range(300)]
    rows += [(300 + i, [float(np.nextafter(x, np.inf)) for x in rows[i][1]]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.filter("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == brute(rows, 10)


def test_scores_beyond_a_long_and_the_readers_of_the_verdict(spark):
    rows = [(0, [1e6, 2e6]), (1, [3e6, 1.0]), (2, [1e12, 1e12]), (3, [-1e200, 1e200]), (4, [1e307, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 2, 2**63 - 1), (2, 3, 2**63 - 1), (3, 1, 256 * 256 * (3 * 10**12 + 2 * 10**6))] or got == [
        (1, 3, 2**63 - 1), (2, 2, 2**63 - 1), (3, 1, 256 * 256 * (3 * 10**12 + 2 * 10**6))]


def test_columns_of_other_names_and_lengths(spark):
    rows = [(i, [float(i)] * (1 + i % 2), "x", 1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, v int, rank int")
    got = topk.top_k(df, df.filter("vec_id < 2"), k=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 2), (0, 2, 4), (1, 1, 19), (1, 2, 17)]


def test_no_two_participants_share_a_name(spark):
    roles = ["a b", "a_b", "a%20b", "a\tb", "a  b", None, "unknown", "%75nknown", "<|x", "< |x", "<%20|x", "System", "a"]
    rows = [(1, k, r, f"t{k}", 0) for k, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, speaker int")
    got = chat.rotate(df).collect()
    speakers = [r.speaker for r in got]
    assert len(speakers) == len(set(speakers)) == len(roles) - 1
    for r in got:
        assert len(r.spans) == 1 and r.n_turns == len(roles)
        assert all(not set(s.speaker) & set(" \t\n") for s in got) and "<|x" not in r.speaker
        assert r.text.count("<|im_start|>") == len(roles)


def test_long_conversations_are_whole(spark):
    df = spark.range(1500).selectExpr("7 AS conv_id", "id AS turn", "concat('p', id % 3) AS role", "concat('t', id) AS text")
    got = collections.defaultdict(list)
    for r in chat.rotate(df).orderBy("speaker", "part").collect():
        got[r.speaker].append(r)
    assert set(got) == {"p0", "p1", "p2"}
    for speaker, parts in got.items():
        text = "".join(p.text for p in parts)
        assert [p.n_turns for p in parts] == [256] * 5 + [220]
        assert text == "".join(f"<|im_start|>{'assistant' if f'p{k % 3}' == speaker else f'user name=p{k % 3}'}\nt{k}<|im_end|>\n"
                               for k in range(1500))
        assert sum(len(p.spans) for p in parts) == 500


def test_tables_kept_on_the_way_are_removed(spark, tmp_path):
    import os

    from custodia.llm.tables import kept, removed_after

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    stays = kept(spark.range(2))
    with removed_after(spark):
        a = kept(spark.range(3))
        with removed_after(spark):
            b = kept(a.union(stays))
            assert b.count() == 5
        a.write.parquet(f"{tmp_path}/out")
    with pytest.raises(ValueError):
        with removed_after(spark):
            kept(spark.range(4))
            raise ValueError
    assert len(set(os.listdir(folder)) - before) == 1 and stays.count() == 2
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
