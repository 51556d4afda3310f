"""Each operator against a plain version on a small corpus with planted
cases, and on the defined cases: NULLs, empty and long texts, repeated
rows, empty tables and other columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from custodia.llm import (
    chat, decontaminate, hmm, html_text, jaccard_join, language_id, line_dedup, mixing, quality, topk,
)
from custodia.llm.edit_distance import distance_within
from custodia.llm.fm_index import FMIndex

WORDS = {"en": "the of and river stone house light under walk green morning paper".split(),
         "de": "der die und fluss straße häuser licht unter gehen grün morgen papier".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "ing", "ö"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    for k in range(120):
        lang = "en" if k % 3 else "de"
        text = "\n".join(sentence(rng, lang, rng.randint(3, 40)) for _ in range(rng.randint(1, 5)))
        rows.append([k, text, lang, f"s{k % 4}" if k % 9 else None])
    for k in range(120, 150):                      # near and exact copies
        words = rows[k - 100][1].split(" ")
        if k % 2:
            words[len(words) // 2] = "changed"
        rows.append([k, " ".join(words), rows[k - 100][2], "s0"])
    rows += [[150, None, "en", "s1"], [151, "", None, "s1"], [152, "... 123", "en", None],
             [153, "Short line.\nShort line.\n\n  ", "en", "s2"], [154, "two words", "en", "s2"],
             [155, sentence(rng, "en", 20000), "en", "s3"], [120, rows[120][1], rows[120][2], "s0"]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    from pyspark.sql import functions as F
    return (spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string")
            .withColumn("n_words", F.lit("clash")).withColumn("hits", F.lit(1)).withColumn("size", F.lit(2)))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def brute_components(corpus, size=5):
    sets = {}
    for i, t, *_ in corpus:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_components_equal_brute_force(docs, corpus, none):
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(corpus)
    stay = {r.doc_id for r in jaccard_join.one_per_component(docs).collect()}
    assert stay == {i for i, (_, c) in brute_components(corpus).items() if i == c}
    assert jaccard_join.jaccard_components(none).count() == 0


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(3, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            p = rng.randrange(len(b) + 1)
            b[p:p + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        b = "".join(b)
        d = plain(a, b)
        for k in (1, 2, 3):
            assert distance_within(a, b, k) == (d if d <= k else None)
            if d <= k and min(len(a), len(b)) > k:
                short, long_ = sorted((a, b), key=len)
                own, more = line_dedup.segment_keys(long_, k)
                assert set(line_dedup.segment_keys(short, k)[0]) & set(own + more)
                bits = line_dedup._sketch(a) ^ line_dedup._sketch(b)
                assert (bits & ((1 << 56) - 1)).bit_count() <= 2 * k


def test_line_dedup_equals_brute_force(docs, corpus, none):
    first = {}
    for i, t, *_ in corpus:
        for place, x in enumerate(dict.fromkeys(x.strip() for x in (t or "").split("\n"))):
            if x:
                first[x] = min((i, place), first.get(x, (i, place)))
    stay, late = [], set()
    for x in sorted(first, key=first.get):           # only a line that stays drops another one
        if len(x) >= 20 and any(distance_within(x, y, 2) is not None for y in stay):
            late.add(x)
        elif len(x) >= 20:
            stay.append(x)
    first = {x: at[0] for x, at in first.items()}
    want = {}
    for i, t, *_ in corpus:
        had = {x.strip() for x in (t or "").split("\n") if x.strip()}
        want[i] = sum(first[x] == i and x not in late for x in had)
    got = {r.doc_id: r.n_kept for r in line_dedup.line_decisions(docs).collect()}
    assert got == want
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[153] == "Short line.\n\n  " and kept[150] is None and kept[151] == ""
    assert {i for i, n in want.items() if n} | {150, 151} == set(kept)
    assert line_dedup.line_decisions(none).count() == 0 and line_dedup.dedup_lines(none).count() == 0


def test_mixing_follows_the_targets(docs, corpus, none):
    rows = mixing.mix_sources(docs).collect()
    assert any(r.source is None for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_sources(docs.repartition(5)).collect()))
    assert len(rows) == len(corpus)
    sizes = collections.Counter()
    for _, t, _, s in corpus:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    open_ = set(order)
    while True:                                     # reshare what is over
        left = total - sum(v for s, v in target.items())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3 * largest[s]
    assert mixing.mix_sources(none).count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 400)
    index = FMIndex(text, sample=8)
    patterns = np.array([text[k:k + 4] for k in range(0, 300, 7)] + [[9, 9, 9, 9]])
    lo, hi = index.search(patterns, np.full(len(patterns), 4))
    for p, a, b in zip(patterns, lo, hi):
        want = [k for k in range(397) if (text[k:k + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_contamination_equals_brute_force(spark, docs, corpus, none):
    long_ = corpus[10][1].split()
    items = [(1, " ".join(long_)), (10, " ".join(corpus[40][1].split()[:16]).upper()), (2, "two words"),
             (3, None), (4, "..."), (None, "river stone"), (2, "two  WORDS!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 12) if w else 0):     # an item without id hits and has no name
            windows[tuple(w[k:k + 13])].update([] if i is None else [str(i)])
    want, hits = collections.Counter(), {}
    for i, t, *_ in corpus:
        w, hit, found = low(t), set(), set()
        hits[i] = hit
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[k:k + n]) in windows and k + n <= len(w):
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        want[i, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    for block in (1 << 20, 5):                      # one block, and several
        got = decontaminate.contamination(docs, bench, block_bytes=block).collect()
        assert collections.Counter(
            (r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got) == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {k[0] for k in want if not k[4]}
    cut = {r.doc_id: r.text for r in decontaminate.cut_hits(docs, bench).collect()}
    assert cut[154] == "" and cut[150] is None
    long_text = dict((r[0], r[1]) for r in corpus)[155].split(" ")
    assert hits[155] and cut[155].split() == [x for k, x in enumerate(long_text) if k not in hits[155]]
    assert decontaminate.contamination(none, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=40)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(30)]
    rows += [(900, None), (901, [1.0, None] * 20), (902, [float("nan")] * 40), (903, [1.0, 2.0]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id % 10 = 0"), k=5, query_block=16).collect()
    valid = [(i, np.floor(256 * np.array(v))) for i, v in rows
             if v is not None and None not in v and np.isfinite(v).all()]
    want = set()
    for q, a in valid:
        if q % 10 == 0:
            found = sorted((-int(a @ b), i) for i, b in valid if i != q and len(a) == len(b))[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    assert {tuple(r) for r in got} == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_language_mixture(spark, docs, corpus, none):
    rows = {r.doc_id: r for r in language_id.predict_languages(docs).collect()}
    assert rows[150].lang_pred == rows[151].lang_pred == rows[152].lang_pred == "und"
    true = {i: lang for i, _, lang, _ in corpus if i < 150}
    held = [i for i in true if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(rows[i].held_out for i in held)
    assert np.mean([rows[i].lang_pred == true[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())
    rng = random.Random(1)
    mixed = spark.createDataFrame([(1, sentence(rng, "de", 300) + " " + sentence(rng, "en", 200))],
                                  "doc_id long, text string")
    model = language_id.train(docs.filter("doc_id < 100"))
    assert language_id.identify(mixed, model).first().identified.languages == ["de", "en"]
    assert language_id.predict_languages(none).count() == 0
    assert {r.doc_id for r in language_id.identified_only(docs).collect()} == {i for i, *_ in corpus} - {150, 151, 152}


def test_quality_rules(spark, none):
    rng = random.Random(4)
    rows = [(i, sentence(rng, "en", 40) if i % 2 else " | ".join(sentence(rng, "en", 1) + "###" for _ in range(40)))
            for i in range(400)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(df, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out and got[i].predicted == i % 2 for i in held)
    assert all(0 <= r.score <= 1 for r in got.values()) and {500, 501} <= set(got)
    assert {r.predicted for r in quality.quality_scores(df, labels.limit(0)).collect()} <= {0, 1}
    assert quality.quality_scores(none, labels).count() == 0


def test_hidden_markov_scores(docs, corpus, none):
    got = {r.doc_id: r for r in hmm.lm_scores(docs, states=3).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in corpus}
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = collections.Counter(x for i, t, *_ in corpus if not held[i] for x in tokens(t))
    n, v = sum(c.values()), len(c)
    base = model = 0.0
    for i, t, *_ in corpus:
        want = sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))
        assert got[i].base_score == pytest.approx(want) and got[i].train_tokens == n
        assert got[i].n_tokens == len(tokens(t)) and got[i].n_known == sum(c[x] > 0 for x in tokens(t))
        assert got[i].held_out == held[i]
        if held[i]:
            base, model = base + want, model + got[i].score
    assert model > base
    assert hmm.lm_scores(none).count() == 0


def test_forward_is_exact():
    rng = np.random.default_rng(6)
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3)
    model = hmm.Model(start, move, emit, start)
    texts = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 6, 2)]
    for t, got in zip(texts, hmm.forward(model, texts)):
        a = start * emit[:, t[0]]
        for s in t[1:]:
            a = (a @ move) * emit[:, s]
        assert got == pytest.approx(np.log(a.sum()))


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a>
</ul></nav><div class="ad">Buy, now, please, today.</div><div id=sidebar><p>Side, text, with, commas.</p></div>
<article><h1>Title &amp; more</h1><p>First, <b>bold
text<br><p>Second one, with commas, and &eacute;.</p><script>var x="</p>";</script><aside>Not, this, one.</aside>
<form><input>Name</form><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><ul><li>Kept item, one<li>Kept item two</ul>
</article><div class="comments"><p>Reader, says, this, and, that, and, more.</p></div><footer>&copy; us</footer>"""


def test_html_extraction(spark):
    assert html_text.main_text(PAGE) == (
        "Title & more\nFirst, bold text\nSecond one, with commas, and é.\nKept item, one\nKept item two")
    assert html_text.main_text("just text, no tags") == "just text, no tags"
    assert html_text.main_text("<div><div><p>a") == "a"
    assert html_text.main_text("<p title=\"x>broken") == "broken"
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.page_texts(df).collect()}
    assert got[2].text == got[3].text == "" and got[1].n_chars == len(got[1].text)
    assert html_text.page_texts(df.limit(0)).count() == 0


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "Be kind <|im_end|>"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "é!"),
            (1, 3, "ann", "é!"), (2, 0, "system", "alone"), (None, None, None, "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = collections.defaultdict(str)
    for part in sorted(chat.rotate(df, part_turns=2).collect(), key=lambda r: r.part):
        whole[part.conv_id, part.speaker] += part.text
        for s in part.spans:
            assert part.text[s.begin:s.end].endswith("<|im_end|>")
            assert part.text[:s.begin].endswith("<|im_start|>assistant\n")
        assert part.n_trained == sum(s.end - s.begin for s in part.spans)
    assert set(whole) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    assert whole[1, "bob"] == (
        "<|im_start|>system\nBe kind < |im_end|><|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n" + "<|im_start|>user name=ann\né!<|im_end|>\n" * 2)
    assert chat.rotate(df.limit(0)).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    out = docs.drop("n_words", "hits", "size")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language", "line_dedup", "near_duplicates", "decontamination", "mixture"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        new = stage(spark, out, sf)
        if k < 4:
            assert new.columns == out.columns
            out = new
    left = {r.doc_id for r in out.collect()}
    assert left and not left & {150, 151, 152}


def test_pipeline_run(spark, docs, tmp_path):
    import corpus_pipeline
    bench = spark.createDataFrame([(1, "nothing that the corpus has")], "item_id long, text string")
    for name, rows in (("some", docs.drop("n_words", "hits", "size")), ("none", docs.drop("n_words", "hits", "size").limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.limit(0 if name == "none" else 1).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    ids = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()]
    assert len(ids) == len(set(ids)) > 50 and set(ids) <= set(range(156))
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_odd_ranges_never_differ_by_more_than_the_sets():
    from custodia.llm.jaccard_join import _odd, _ranges

    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(0, 900, 2)
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        b = np.unique(np.concatenate([a[: int(rng.integers(0, len(a) + 1))],
                                      rng.integers(0, 1 << 63, m).astype(np.uint64) << np.uint64(1)]))
        apart = sum(int(x).bit_count() for x in (_odd(_ranges(a)) ^ _odd(_ranges(b))).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))
