"""Benchmark items without id give hits, as in the module's SQL."""

from custodia.llm import decontaminate


def test_items_without_id_give_hits_and_no_name(spark):
    docs = spark.createDataFrame([(1, "a river stone here"), (2, "two words and river stone"), (3, "nothing"),
                                  (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "river stone"), (7, "two words"), (8, None)], "item_id long, text string")
    want = {(1, 4, 2, "", True), (2, 5, 4, "7", True), (3, 1, 0, "", False), (4, 0, 0, "", False)}
    for block in (1 << 20, 5):
        got = decontaminate.contamination(docs, bench, block_bytes=block).collect()
        assert {(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got} == want
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {3, 4}
