"""SQL that queries of this package have to equal, over the driver's tables."""

from __future__ import annotations


def _vector_codes(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and means, one after another."""

    def assigned(k: int) -> str:
        return f"""
near_{k} AS (
  SELECT vec_id, p, min(struct_pack(distance := distance, entry := entry)) AS best
  FROM (SELECT vec_id, pieces.p, entry,
               list_sum(list_transform(list_zip(piece, center), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
        FROM pieces JOIN books_{k} ON pieces.p = books_{k}.p)
  GROUP BY vec_id, p)"""

    def moved(k: int) -> str:
        return f"""
means_{k} AS (
  SELECT p, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY place) AS center
  FROM (SELECT near_{k}.p, best.entry AS entry, place, CAST(sum(piece[place]) AS DOUBLE) AS total, count(*) AS n
        FROM near_{k} JOIN pieces ON pieces.vec_id = near_{k}.vec_id AND pieces.p = near_{k}.p,
        LATERAL (SELECT unnest(range(1, len(piece) + 1))) g(place) GROUP BY ALL)
  GROUP BY p, entry),
books_{k + 1} AS (
  SELECT p, entry, coalesce(means_{k}.center, books_{k}.center) AS center
  FROM books_{k} LEFT JOIN means_{k} USING (p, entry))"""

    turns = [text for k in range(rounds) for text in (assigned(k), moved(k))]
    return f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {scale}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (
  SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS piece
  FROM kept, range({parts}) g(p)),
books_0 AS (
  SELECT p, entry, piece AS center
  FROM pieces JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id)
  WHERE entry < {entries}),{",".join(turns)},{assigned(rounds)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY p) AS code, CAST(sum(best.distance) AS BIGINT) AS error
  FROM near_{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(center, ','), ',' ORDER BY p, entry)) FROM books_{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


def _repeats(length: int = 200) -> str:
    """Every string of that many bytes, in hexadecimal, counted by its MD5."""
    return f"""WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT r, i, md5_number(substr(h, 2 * i + 1, {2 * length})) AS s
  FROM texts, LATERAL (SELECT unnest(range(length(h) // 2 - {length - 1}))) g(i)),
repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
marks AS (
  SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > {length}, true) AS new
  FROM windows SEMI JOIN repeated USING (s)),
spans AS (
  SELECT r, min(i) AS a, max(i) + {length} AS b
  FROM (SELECT r, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM marks) GROUP BY r, k),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS c FROM spans),
cut AS (
  SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS head
  FROM gaps JOIN texts USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM texts LEFT JOIN cut USING (r)"""


def _chat() -> str:
    """Turns joined in order; the control strings have 8, 8 and 7 characters."""
    escaped = "replace(replace({}, '\\', '\\\\'), '<|', '<\\|')"
    size = f"8 + length({escaped.format('role')}) + 8 + length({escaped.format('text')}) + 7"
    words = r"'\### Assistant: </turn> ok'"
    return f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {words}), (-7, 1, 'assistant', {words}))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({size}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def _vectors(cosine: float = 0.98) -> str:
    """Every pair of a label, and what links reach."""
    return f"""WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {cosine}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a) USING (vec_id)"""


ORACLES: dict[str, str] = {
    "op2_chat": _chat(),
    "op9_vectors": _vectors(),
    "op11_vector_codes": _vector_codes(),
    "op12_repeats": _repeats(),
}
