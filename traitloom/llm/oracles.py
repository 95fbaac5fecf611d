"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from .quality import RULES, mask

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = f"translate(coalesce(text, ''), '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"


def _words(text: str = "coalesce(text, '')") -> str:
    """Views d (a text's words as a list) and w (one row a word)."""
    return f"""d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({text}, '{_WORD}') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos, len(words) AS n FROM d)"""


def _window(size: int) -> str:
    return f"string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"


def _covered(size: int) -> str:
    return f"max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"


def _components(links: str) -> str:
    """View least: the smallest node reachable from each node of the symmetric *links* (a, b)."""
    return f"""reach(a, b) AS (SELECT a, b FROM {links} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)"""


def _failed(policy: str) -> str:
    return f"(failures & {mask(policy)}) <> 0"


ORACLES = {
    "op2_vectors": f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fit AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fit x JOIN fit y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_components("links")}
SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE a = v.vec_id) AS BIGINT) AS n_links,
  coalesce(least(v.vec_id, l.b), v.vec_id) AS component_id, coalesce(least(v.vec_id, l.b), v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN least l ON l.a = v.vec_id""",
    "op3_suffixes": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS pos, b FROM d),
s AS (SELECT doc_id, n, pos, hex(array_slice(b, pos, pos)) AS byte, CASE WHEN pos <= n - 99 THEN md5(array_slice(b, pos, pos + 99)) END AS string FROM c),
m AS (SELECT *, CASE WHEN string IS NOT NULL AND row_number() OVER (PARTITION BY string ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS again FROM s),
g AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM m),
r AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before FROM g),
a AS (SELECT doc_id, count(*) FILTER (gone = 1) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans,
  coalesce(string_agg(byte, '' ORDER BY pos) FILTER (gone = 0), '') AS kept FROM r GROUP BY 1)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op7_quality": rf"""WITH {_words()},
x AS (SELECT *, CASE WHEN pos <= n - 7 THEN {_window(8)} END AS part FROM w),
y AS (SELECT *, CASE WHEN part IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, part) > 1 THEN 1 ELSE 0 END AS again FROM x),
z AS (SELECT doc_id, {_covered(8)} AS covered FROM y),
t AS (SELECT doc_id, sum(covered) AS n_repeat_words FROM z GROUP BY 1),
k AS (SELECT *, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM d),
q AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_capitals,
  length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks FROM k LEFT JOIN t USING (doc_id)),
f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))} AS BIGINT) AS failures FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_failed("base")} AS base_failed,
  NOT {_failed("base")} AND NOT {_failed("v1")} AS kept, failures FROM f""",
    "op8_substrings": f"""WITH {_words()},
x AS (SELECT *, CASE WHEN pos <= n - 34 THEN {_window(35)} END AS part FROM w),
y AS (SELECT *, CASE WHEN part IS NOT NULL AND count(*) OVER (PARTITION BY part) > 1 THEN 1 ELSE 0 END AS again FROM x),
z AS (SELECT *, {_covered(35)} AS gone FROM y),
a AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM z GROUP BY 1)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)""",
    "op11_topk": """WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.i, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.i <> c.i AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op10_minhash": f"""WITH RECURSIVE {_words(_LOWER)},
s AS (SELECT DISTINCT doc_id, part FROM (SELECT doc_id, pos, n, {_window(5)} AS part FROM w) WHERE pos <= greatest(1, n - 4)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.part = y.part AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
{_components("links")}
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(least(d.doc_id, l.b), d.doc_id) AS component_id,
  coalesce(least(d.doc_id, l.b), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN size z USING (doc_id) LEFT JOIN least l ON l.a = d.doc_id""",
    # the checksum bit by bit; near words share a rest after one letter is left out, at the same place or as a word
    "op13_variants": f"""WITH RECURSIVE o AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT doc_id, run, xor(4294967295, list_reduce(flatten(list_transform(range(1, octet_length(k) + 1),
  lambda i: [CAST('0x' || hex(array_slice(k, i, i)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
  lambda h, b: xor(xor(h, b) >> 1, 3988292384 * (xor(h, b) & 1)), CAST(4294967295 AS BIGINT))) AS h
  FROM (SELECT *, encode(concat(doc_id, ':', run)) AS k FROM o)),
a AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM a JOIN c USING (doc_id, run)),
v AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
x AS (SELECT word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS pos FROM v)),
p AS (SELECT a.word, b.word AS other FROM x a JOIN x b ON a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
q AS (SELECT p.word, count(*) AS n_near, arg_min(p.other, (-v.n, p.other)) AS best, max(v.n) AS best_n FROM p JOIN v ON v.word = p.other GROUP BY 1),
f AS (SELECT v.word, CASE WHEN best_n >= 10 * n THEN best END AS form, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
  CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v LEFT JOIN q USING (word)),
g(word, root) AS (SELECT word, word FROM f UNION SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT arg_max(root, z.n) FROM g JOIN f z ON z.word = g.root WHERE g.word = f.word) AS root, n, n_near, form_n FROM f""",
}
