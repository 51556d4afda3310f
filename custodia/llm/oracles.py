"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

OP4 = f"""
WITH d AS (SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
        3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, nth) AS step,
        sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, nth
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
        sum(weight) OVER ()
          - coalesce(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, nth
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight FROM w),
f AS (SELECT min(step) AS step, arg_min(left_words, step) AS lw, arg_min(left_weight, step) AS lg
        FROM o WHERE left_words * weight <= cap * left_weight),
t AS (SELECT o.source, o.source_size,
        CASE WHEN o.step >= f.step THEN CAST(o.weight AS DOUBLE) * (CAST(f.lw AS DOUBLE) / CAST(f.lg AS DOUBLE))
             ELSE CAST(o.cap AS DOUBLE) END AS target,
        CAST(('0x' || substr(md5('mix-1' || CASE WHEN o.source IS NULL THEN ':null' ELSE ':=' || o.source END), 1, 8))
             AS BIGINT) / 4294967296.0::DOUBLE AS shift FROM o CROSS JOIN f),
g AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS size_class,
        (((((coalesce(doc_id, 0) % 1048576) + 1048576) % 1048576) * 2654435761) % 4294967296) * 64 // 4294967296
          AS bucket FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size_class, bucket, size, doc_id) AS place FROM g),
c AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.place, t.shift,
        CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate
        FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate * place + shift) - floor(rate * (place - 1) + shift) AS BIGINT) * size AS taken FROM c
"""

OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (
  SELECT doc_id, list(word ORDER BY pos) AS w, count(*) AS n_words FROM words GROUP BY doc_id),
found AS (
  SELECT p.doc_id, p.pos, p.n, item_id FROM (
    SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS phrase
    FROM (SELECT d.*, s.n, unnest(generate_series(1, d.n_words - s.n + 1)) AS pos FROM docs d, sizes s
          WHERE d.n_words >= s.n)) p JOIN windows x ON x.phrase = p.phrase AND x.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (
    SELECT doc_id, unnest(generate_series(pos, pos + n - 1)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
    FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated
FROM documents d LEFT JOIN docs USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT
  AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Unsigned CRC-32 of a text, as lists of integers: a table of 256 entries by
#: eight steps each, then one step per byte of the text.
_STEP = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"


def _crc_table() -> str:
    made = "CAST(range(256) AS BIGINT[])"
    for _ in range(8):
        made = f"list_transform({made}, lambda x: {_STEP})"
    return f"crc AS (SELECT {made} AS entries)"


def _crc(text: str) -> str:
    size = f"CAST(strlen({text}) AS BIGINT)"
    each = f"list_transform(range({size}), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    folded = ("list_reduce(list_prepend(4294967295::BIGINT, " + each
              + "), lambda a, b: xor(a >> 8, crc.entries[(xor(a, b) & 255) + 1]))")
    return f"xor({folded}, 4294967295::BIGINT)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVELS = 6                                     # 16 ** 6 leaves a source, 16 ** 6 sources


def _op13() -> str:
    def framed(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || {c} END"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(map(framed, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def tree(p: str) -> list[str]:
        steps = []
        for i in range(_LEVELS):
            run = "PARTITION BY source, place // 16 ORDER BY place ROWS BETWEEN"
            steps += [
                f"{p}s{i} AS (SELECT source, place, "
                f"coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, "
                f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt "
                f"FROM {p}{i} WHERE n > 1)",
                f"{p}{i + 1} AS (SELECT source, place // 16 AS place, (n + 15) // 16 AS n, "
                f"CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY place)) ELSE max(h) END AS h "
                f"FROM {p}{i} GROUP BY source, place // 16, n)"]
        return steps

    def climb(p: str, start: str) -> list[str]:
        steps = [start]
        for i in range(_LEVELS):
            steps.append(
                f"{p}f{i + 1} AS (SELECT f.* REPLACE (f.place // 16 AS place, "
                f"CASE WHEN s.lft IS NULL THEN f.h ELSE sha256(s.lft || f.h || s.rgt) END AS h, "
                f"f.proof || coalesce(s.lft || s.rgt, '') AS proof) FROM {p}f{i} f LEFT JOIN {p}s{i} s "
                f"ON s.source IS NOT DISTINCT FROM f.source AND s.place = f.place)")
        return steps

    return "WITH " + ",\n".join([
        _crc_table(),
        f"d AS (SELECT *, {digest('text')} AS leaf, coalesce({_crc('CAST(doc_id AS VARCHAR)')} % 5 = 0, FALSE) AS hit "
        "FROM documents, crc)",
        f"l AS (SELECT doc_id, source, leaf, CASE WHEN hit THEN "
        + digest(f"translate(text, '{_UPPER}', '{_LOWER}')") + " ELSE leaf END AS changed, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, "
        "count(*) OVER (PARTITION BY source) AS n FROM d)",
        "a0 AS (SELECT source, place, n, leaf AS h FROM l)", *tree("a"),
        f"tops AS (SELECT source AS own, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, "
        f"count(*) OVER () AS n FROM a{_LEVELS})",
        "b0 AS (SELECT '' AS source, place, n, subroot AS h FROM tops)", *tree("b"),
        *climb("a", "af0 AS (SELECT doc_id, leaf, source, place, changed AS h, '' AS proof FROM l)"),
        *climb("b", "bf0 AS (SELECT f.doc_id, f.leaf, t.subroot, '' AS source, t.place, f.h, f.proof "
                    f"FROM af{_LEVELS} f JOIN tops t ON t.own IS NOT DISTINCT FROM f.source)"),
    ]) + (f"\nSELECT f.doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, "
          f"f.h = r.h AS verified FROM bf{_LEVELS} f, b{_LEVELS} r")


OP12 = "WITH RECURSIVE " + ",\n".join([
    _crc_table(),
    f"""runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text,
  '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)""",
    f"""lowered AS (SELECT id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n FROM runs
  WHERE length(run) >= 5 GROUP BY ALL)""",
    f"hashed AS (SELECT run, n, {_crc('(id || chr(58) || run)')} AS h FROM lowered, crc)",
    """spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
  ELSE run END AS word, n FROM hashed)""",
    "words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3)",
    "cuts AS (SELECT word, n, unnest(range(length(word))) AS k FROM words)",
    "holes AS (SELECT word, n, k, substr(word, 1, k) AS l, substr(word, k + 2) AS r FROM cuts)",
    """near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b
    ON a.k = b.k AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.l || h.r
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.l || h.r)""",
    """best AS (SELECT word, count(*) AS n_near, max(other_n) AS most,
  first(other ORDER BY other_n DESC, other) AS other FROM near GROUP BY word)""",
    """judged AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN other END AS form,
  CASE WHEN most >= 2 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word))""",
    """walk AS (SELECT word, word AS at, form AS next FROM judged
  UNION ALL SELECT walk.word, judged.word, judged.form FROM walk JOIN judged ON judged.word = walk.next)""",
]) + """
SELECT word, form, walk.at AS root, n, n_near, form_n FROM judged JOIN walk USING (word) WHERE walk.next IS NULL
"""

OP13 = _op13()

ORACLE_SQL = {
    "op4_systematic_mix": OP4,
    "op8_fm_index_decontamination": OP8,
    "op10_branch_and_bound": OP10,
    "op12_spelling_variants": OP12,
    "op13_merkle_manifest": OP13,
}
