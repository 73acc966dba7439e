"""The queries over the given tables, one per operator, and the DuckDB text of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from figtrail.llm import class_lm, conversation_trie, embedding_dedup, exact_dedup, filter_audit, mixing, near_dedup, packing, quality, repetition, secrets, token_files, warc
from figtrail.llm.common import fresh_folder, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE = 2048

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# all pairs by shared shingles, then reachability; on the small tables only
NEAR = f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT node, b FROM reach JOIN links ON other = a)
SELECT node AS doc_id, min(other) AS class_id, node = min(other) AS kept FROM reach GROUP BY node
"""


@query("op1_near_dedup", NEAR)
def near(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query("op2_class_lm")
def perplexity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return class_lm.fit_and_score(docs)


@query("op3_quality")
def scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


@query("op4_token_files")
def files(spark: SparkSession, folder: str) -> DataFrame:
    to = fresh_folder(spark, "token-files")
    parts = token_files.write_token_files(table(spark, folder, "documents"), to, TOKENIZER, end_id=1)
    return token_files.read_token_files(spark, parts, to)


DAMAGED = 50  # the replica is damaged where page_id leaves 7 when divided by this


def _damaged(page: int | None) -> bool:
    return page is not None and page % DAMAGED == 7


@query("op5_warc_fixity", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Date: {warc.DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS head, chr(13) || chr(10) || chr(13) || chr(10) AS tail FROM pages),
r AS (SELECT page_id, h, head, tail, row_number() OVER (ORDER BY page_id) - 1 AS seq, strlen(head || h || tail) AS length, (sum(strlen(head || h || tail)) OVER (ORDER BY page_id))::BIGINT - strlen(head || h || tail) AS "offset" FROM p)
SELECT seq, page_id, "offset", length, sha256(head || h || tail) AS primary_sha256, sha256(head || chr(xor(ascii(h), 1)) || substring(h, 2) || tail) AS replica_sha256 FROM r WHERE page_id % {DAMAGED} = 7 AND h <> ''
""")
def fixity(spark: SparkSession, folder: str) -> DataFrame:
    first, second = fresh_folder(spark, "warc"), fresh_folder(spark, "warc-replica")
    manifest = warc.write_warc(table(spark, folder, "pages"), first)
    places = warc.damaged_copy(manifest, first, second, _damaged)
    return warc.audit(manifest, first, second, replica_places=places)


@query("op6_exact_dedup", f"""
WITH n AS (SELECT doc_id, {LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256 FROM n WINDOW g AS (PARTITION BY t)
""")
def exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def _spans(kind: str, pattern: str) -> str:
    """Matches with their places, by summing the lengths of pieces and matches row by row."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, m, (sum(length(p) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) - coalesce(length(m), 0))::BIGINT AS s
  FROM (SELECT doc_id, unnest(string_split_regex(t, '{quoted}')) AS p, unnest(regexp_extract_all(t, '{quoted}')) AS m, unnest(range(len(string_split_regex(t, '{quoted}')))) AS i FROM texts)"""


_LISTED = "|".join(secrets.ALLOWED)
_FIND = f"""
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_spans('assign', secrets.ASSIGN)} UNION ALL {_spans('access', 'AKIA[A-Z0-9]+')} UNION ALL {_spans('hex', '[0-9a-f]+')}),
base AS (SELECT doc_id, kind, s, s + length(m) AS e, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS k FROM found WHERE m IS NOT NULL AND CASE kind WHEN 'assign' THEN length(regexp_extract(m, '{secrets.ASSIGN.replace("'", "''")}', 2)) >= 6 WHEN 'access' THEN length(m) >= 20 ELSE length(m) >= 24 END),
strings AS (SELECT row_number() OVER () AS c, * FROM ({_spans('', secrets.CANDIDATE)}) WHERE m IS NOT NULL),
listed AS (SELECT c, (sum(length(p) + coalesce(length(x), 0)) OVER (PARTITION BY c ORDER BY i) - length(x))::BIGINT AS lo, (sum(length(p) + coalesce(length(x), 0)) OVER (PARTITION BY c ORDER BY i))::BIGINT AS hi, x
  FROM (SELECT c, unnest(string_split_regex(lower(m), '{_LISTED}')) AS p, unnest(regexp_extract_all(lower(m), '{_LISTED}')) AS x, unnest(range(len(string_split_regex(lower(m), '{_LISTED}')))) AS i FROM strings)),
windows AS (SELECT c, doc_id, s, i, substring(m, i + 1, {secrets.WINDOW}) AS w FROM (SELECT *, unnest(range(length(m) - {secrets.WINDOW - 1})) AS i FROM strings) u WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.c = u.c AND x IS NOT NULL AND lo < u.i + {secrets.WINDOW} AND hi > u.i)),
letters AS (SELECT c, i, x, count(*) AS n FROM (SELECT c, i, unnest(string_split(w, '')) AS x FROM windows) GROUP BY ALL),
judged AS (SELECT c, i, sum(round(n * log2(n) * 1e6)::BIGINT) AS total, sum(n) FILTER (x BETWEEN '0' AND '9') AS digits, sum(n) FILTER (regexp_matches(x, '[A-Za-z]')) AS alphas, sum(n) FILTER (regexp_matches(x, '[0-9a-f]')) AS hexes, sum(n) FILTER (regexp_matches(x, '[0-9A-F]')) AS capital_hexes FROM letters GROUP BY c, i),
kinds AS (SELECT c, i, CASE WHEN digits >= 2 AND alphas >= 2 THEN CASE WHEN hexes = {secrets.WINDOW} OR capital_hexes = {secrets.WINDOW} THEN CASE WHEN total <= {secrets.most(3.0)} THEN 'entropy_hex' END WHEN total <= {secrets.most(3.8)} THEN 'entropy_text' END
  WHEN alphas >= {secrets.WINDOW - 1} AND alphas + coalesce(digits, 0) = {secrets.WINDOW} AND total <= {secrets.most(4.0)} THEN 'entropy_letters' END AS kind FROM judged),
marked AS (SELECT *, CASE WHEN lag(i) OVER w >= i - {secrets.WINDOW} AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS new FROM kinds WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY c ORDER BY i)),
runs AS (SELECT c, any_value(kind) AS kind, min(i) AS lo, max(i) + {secrets.WINDOW} AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY c ORDER BY i) AS r FROM marked) GROUP BY c, r),
added AS (SELECT doc_id, kind, s + lo AS s, s + hi AS e, 3 AS k FROM runs JOIN (SELECT c, doc_id, s FROM strings) USING (c)),
fresh AS (SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.s <= a.s AND b.e >= a.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM fresh),
folded AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_added,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3), '') AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS a FROM every GROUP BY doc_id)
"""


@query("op7_secrets", f"""
WITH {_FIND}
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_added, 0) AS n_added, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM texts LEFT JOIN folded USING (doc_id)
""")
def secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents"))


@query("op8_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, folder, "documents"), TOKENIZER, end_id=0, capacity=SEQUENCE), SEQUENCE)


# one period slot by slot: the state is the next block of each source
@query("op9_mixing", """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weights AS (SELECT source, greatest(1, round(1000 * pow(n, 0.5) / sum(pow(n, 0.5)) OVER ()))::BIGINT AS w, row_number() OVER (ORDER BY source) AS i FROM counts),
all_w AS (SELECT list(w ORDER BY i) AS ws, sum(w)::BIGINT AS total, count(*) AS k FROM weights),
sim AS (
  SELECT 0::BIGINT AS slot, list_transform(ws, lambda x: 0::BIGINT) AS nxt, 0::BIGINT AS src, 0::BIGINT AS j, 0::BIGINT AS due FROM all_w
  UNION ALL
  SELECT slot + 1, list_transform(nxt, lambda x, q: x + CASE WHEN q = best % 100000 THEN 1 ELSE 0 END), best % 100000, nxt[best % 100000], best // 100000
  FROM (SELECT slot, nxt, list_min(list_transform(range(1, k + 1), lambda q: CASE WHEN nxt[q] < ws[q] AND nxt[q] * total // ws[q] <= slot THEN ((nxt[q] + 1) * total + ws[q] - 1) // ws[q] * 100000 + q END)) AS best FROM sim, all_w WHERE slot < total)
),
slots AS (SELECT i, source, w, slot - 1 AS slot, j, due FROM sim JOIN weights ON i = src WHERE slot > 0),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS block FROM documents),
timed AS (SELECT doc_id, r.source, block, block // w AS period, s.slot, s.due AS deadline FROM ranked r JOIN slots s ON s.source = r.source AND s.j = block % s.w)
SELECT *, row_number() OVER (ORDER BY period, slot) - 1 AS position FROM timed
""")
def mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


@query("op10_embedding_dedup", """
WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT node, b FROM reach JOIN links ON other = a),
parts AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept FROM parts LEFT JOIN counts ON a = node
""")
def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(table(spark, folder, "embeddings"))


_REPEATS = ", ".join(f"coalesce(sum(CASE WHEN n = {n} THEN chars END), 0)::BIGINT AS dup_chars_{n}" for n in repetition.MOST_IN_WINDOWS)
_WITHIN = " AND ".join(f"100 * coalesce(dup_chars_{n}, 0) <= {most} * word_chars" for n, most in repetition.MOST_IN_WINDOWS.items())


# windows as joined strings, the words they cover as rows
@query("op11_repetition", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
size AS (SELECT r, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars FROM w),
word AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
five AS (SELECT r, i, row_number() OVER (PARTITION BY r, g ORDER BY i) AS nth, count(*) OVER (PARTITION BY r, g) AS times FROM (SELECT r, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g, count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS c FROM word) WHERE c = 5),
longer AS (SELECT r, n, i, array_to_string(ws[i + 1:i + n], ' ') AS g FROM five JOIN w USING (r), (SELECT unnest([6, 7, 8, 9, 10]) AS n) WHERE times > 1 AND i + n <= len(ws)),
found AS (SELECT r, 5 AS n, i, nth, times FROM five WHERE times > 1 UNION ALL SELECT r, n, i, row_number() OVER (PARTITION BY r, n, g ORDER BY i), count(*) OVER (PARTITION BY r, n, g) FROM longer),
twice AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM found, (SELECT unnest(range(5)) AS k) WHERE n = 5 AND times > 1 GROUP BY r),
inside AS (SELECT DISTINCT r, n, i + k AS i FROM found, (SELECT unnest(range(10)) AS k) WHERE nth > 1 AND k < n),
covered AS (SELECT r, {_REPEATS} FROM (SELECT r, n, length(word) AS chars FROM inside JOIN word USING (r, i)) GROUP BY r),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
again AS (SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')))::BIGINT AS dup_line_chars FROM (SELECT *, row_number() OVER (PARTITION BY r, l ORDER BY i) AS nth FROM line WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')) WHERE nth > 1 GROUP BY r),
every AS (SELECT doc_id, n_words, word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
  {', '.join(f'coalesce(dup_chars_{n}, 0) AS dup_chars_{n}' for n in repetition.MOST_IN_WINDOWS)} FROM d JOIN size USING (r) LEFT JOIN again USING (r) LEFT JOIN twice USING (r) LEFT JOIN covered USING (r)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM every)
SELECT *, NOT base_failed AND 10 * n_symbols <= n_words AND 100 * dup_line_chars <= {repetition.MOST_IN_LINES} * word_chars AND {_WITHIN} AS kept FROM base
""")
def repeated(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition_quality(table(spark, folder, "documents"))


# crc32 bit by bit; nodes as prefixes of role and text, subtrees as pairs of prefixes on one conversation's path
@query("op12_conversation_trie", """
WITH ids AS (SELECT conv_id AS c, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (SELECT c, n, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1])) AS bs FROM ids),
sized AS (SELECT c, n, c - c % 5 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda s, x: xor(xor(s, CASE WHEN x >= 0 THEN x ELSE 0 END) >> 1, 3988292384 * (xor(s, CASE WHEN x >= 0 THEN x ELSE 0 END) & 1))), 4294967295::BIGINT) % 9 AS h FROM bits),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
made AS (SELECT s.c, 0 AS half, pos, role, text FROM sized s JOIN t ON t.c = s.b WHERE pos < h UNION ALL SELECT s.c, 1, pos, role, text FROM sized s JOIN t ON t.c = s.c WHERE pos >= h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY half, pos) AS d, role, text FROM made),
rows_ AS (SELECT c, d, text, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM turns UNION ALL SELECT c, 0, '', '' FROM ids),
linked AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, lead(k) OVER (PARTITION BY c ORDER BY d) IS NULL AS last FROM rows_),
nodes AS (SELECT k, any_value(up) AS up, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(text)) AS own, bool_and(last) AS leaf, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last) AS ends FROM linked GROUP BY k),
below AS (SELECT DISTINCT a.k AS top, b.k AS k FROM rows_ a JOIN rows_ b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT top AS k, count(*) FILTER (leaf) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM below JOIN nodes USING (k) GROUP BY top),
kids AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN nodes p ON p.k = n.up
""")
def trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, folder, "conversations"), rebuilt=True)


# masks of the five conditions, then every order step by step
@query("op13_filter_audit", """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS lo FROM d),
m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > lo, false)::INT AS mask,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM w),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, instr('ABCDE', filter_order[step]) - 1 AS bit, list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (instr('ABCDE', x) - 1) END))::BIGINT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
measured AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (coalesce(before, 0) | (1 << bit)) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & coalesce(before, 0) = 0 AND mask & (1 << bit) <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & coalesce(before, 0) <> 0 AND mask & (1 << bit) <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = 1 << bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & coalesce(before, 0) = 0 AND mask & (1 << bit) <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & coalesce(before, 0) = 0 AND mask & (1 << bit) <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM measured
""")
def audited(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))
