"""SQL beside the registered queries of this subpackage, over the same tables in DuckDB."""

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP11 = rf"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM cut),
sizes AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
places AS (
  SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i
  FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k),
counts AS MATERIALIZED (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM places GROUP BY ALL HAVING count(*) >= 30),
found AS MATERIALIZED (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a FROM counts WHERE k > 1),
inside AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, words, k, a, m, unnest(range(1, k - m + 2)) AS i
        FROM found, (SELECT unnest([2, 3]) AS m) WHERE m < k)
  GROUP BY ALL),
kept AS (
  SELECT f.* FROM found f LEFT JOIN inside i ON f.lang = i.lang AND f.phrase = i.phrase
  WHERE i.most IS NULL OR 100 * i.most < 80 * f.a),
cuts AS (
  SELECT t.lang, t.phrase, t.a, t.c, l.f AS l, r.f AS r,
    (2000000::HUGEINT * t.a // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept) t
  JOIN counts l ON l.lang = t.lang AND l.phrase = array_to_string(t.words[1:t.c], ' ')
  JOIN counts r ON r.lang = t.lang AND r.phrase = array_to_string(t.words[t.c + 1:], ' ')),
least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""



def op13(count: int = 40, rounds: int = 5) -> str:
    """The rounds one after another: c<i> are centroids, a<i> the nearest one of each vector."""

    def nearest(i: int) -> str:
        return f"""
a{i} AS MATERIALIZED (
  SELECT row, min_by(c, (distance, c)) AS c, min(distance) AS distance FROM (
    SELECT v.row, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance
    FROM vectors v JOIN c{i} c ON v.d = c.d GROUP BY v.row, c.c) GROUP BY row)"""

    def means(i: int) -> str:
        return f"""
c{i + 1} AS MATERIALIZED (
  SELECT c, d, coalesce(m, x) AS x FROM c{i} LEFT JOIN (
    SELECT a.c, v.d, ((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM a{i} a JOIN vectors v USING (row) GROUP BY a.c, v.d) USING (c, d))"""

    return f"""
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
vectors AS MATERIALIZED (
  SELECT row, unnest(range(64)) AS d, floor(256 * unnest(e))::BIGINT AS x FROM rows),
first AS (
  SELECT row, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS c FROM rows
  QUALIFY c < {count}),
c0 AS MATERIALIZED (SELECT c, d, x FROM first JOIN vectors USING (row)),{
    ",".join(nearest(i) + "," + means(i) for i in range(rounds))},{nearest(rounds)},
marks AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT
    AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN rows USING (row) JOIN marks USING (c)
"""


OP3 = rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, '{CAPITALS}', '{CAPITALS.lower()}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met
    FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * met >= 75 * (p.n + q.n - met)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, b) AS component_id, coalesce(b >= doc_id, true) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id
"""

OP9 = """
WITH texts AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM texts WHERE n >= 50)),
met AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM windows JOIN (SELECT w, min(doc_id) AS first, max(doc_id) AS last FROM windows GROUP BY w HAVING first < last) USING (w)
  WHERE doc_id > first),
runs AS MATERIALIZED (
  SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (
    SELECT doc_id, i, count(*) FILTER (before IS NULL OR i > before + 50) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM met)
  GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, s, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS begin_at FROM runs),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * begin_at + 1, 2 * (s - begin_at)), '' ORDER BY s) AS head FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id),
told AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM texts LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP10 = """
WITH v AS MATERIALIZED (
  SELECT vec_id, d, floor(64 * x::DOUBLE)::BIGINT AS x, n FROM (
    SELECT vec_id, len(embedding) AS n, unnest(embedding) AS x, unnest(range(len(embedding))) AS d
    FROM embeddings WHERE len(list_filter(embedding, lambda c: isfinite(c))) = len(embedding))),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.d = c.d AND q.n = c.n AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 20
"""

ORACLES: dict[str, str] = {
    "op3_minhash_near_dedup": OP3,
    "op9_suffix_array_dedup": OP9,
    "op10_exact_topk": OP10,
    "op11_phrase_collocations": OP11,
    "op13_centroid_clusters": op13(),
}
