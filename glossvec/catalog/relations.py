"""The derived relations as SQL common table expressions, in the order they build on each other."""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{M}\p{N}_]+"
PUNCT = r"[^\p{L}\p{M}\p{N}_\s]"


def pieces_sql(pattern: str, mark: bool = False) -> str:
    """Pre-tokens with character spans, from a pattern that also matches the gaps."""
    shown = "replace(piece, ' ', 'Ġ')" if mark else "piece"
    kept = "true" if mark else r"NOT regexp_full_match(piece, '\s+')"
    return f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS pos, {shown} AS tok,
       CAST(e - length(piece) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end"
FROM (SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e
      FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS p FROM documents)))
WHERE {kept}"""


def wide_sql(long: str, key: str, order: str = "i", value: str = "m") -> str:
    return f"SELECT {key}, list({value} ORDER BY {order}) AS v FROM ({long}) GROUP BY {key}"


def nearest_sql(queries: str, vectors: str, metric: str, low: int, high: int) -> str:
    """Ranks low..high; `queries` gives (query_id, v), `vectors` (token_id, v)."""
    if metric == "cosine":
        score, order = "round(list_cosine_similarity(q.v, e.v), 6)", "DESC"
    else:
        score = "round(list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)"
        order = "ASC"
    return f"""
SELECT query_id, hit_id, distance, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance {order}, hit_id) AS BIGINT) AS rank
  FROM (SELECT q.query_id, e.token_id AS hit_id, {score} AS distance FROM ({queries}) q, ({vectors}) e))
WHERE rank BETWEEN {low} AND {high}"""


def pooled_sql(counts: str, key: str) -> str:
    """Mean vector per key from (key, id, n)."""
    return f"""
SELECT {key}, list(m ORDER BY i) AS v FROM (
  SELECT {key}, i, sum(x * n) / sum(n) AS m
  FROM (SELECT c.{key}, c.n, unnest(e.v) AS x, unnest(range(len(e.v))) AS i
        FROM ({counts}) c JOIN vectors e ON e.token_id = c.id)
  GROUP BY {key}, i) GROUP BY {key}"""


RELATIONS = {
    "vocab": rf"""
SELECT w AS word, CAST(row_number() OVER (ORDER BY c DESC, w) - 1 AS BIGINT) AS token_id, c AS freq
FROM (SELECT w, count(*) AS c
      FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM documents)
      GROUP BY w)
QUALIFY row_number() OVER (ORDER BY c DESC, w) <= (SELECT count(*) FROM embeddings)""",
    "vectors": """
SELECT vec_id AS token_id,
       list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (0.85::DOUBLE + CAST((vec_id * 37) % 2003 AS DOUBLE) / 2003.0::DOUBLE)) AS v
FROM embeddings""",
    "definitions": rf"""
SELECT * FROM (SELECT doc_id AS token_id, regexp_extract_all(lower(text), '{WORD}') AS tokens FROM documents)
WHERE len(tokens) > 0""",
    "def_tokens": """
SELECT token_id, CAST(i - 1 AS BIGINT) AS pos, tok
FROM (SELECT token_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i FROM definitions)""",
    "dictionary": """
SELECT token_id AS doc_id, tokens[1] AS word, array_to_string(tokens[2:], ' ') AS definition
FROM definitions WHERE len(tokens) > 1""",
    "lexicon": """
SELECT d.doc_id AS entry, d.word, o.token_id, d.definition,
       round(sqrt(list_sum(list_transform(e.v, lambda x: x * x))), 6) AS norm
FROM dictionary d JOIN vocab o USING (word) JOIN vectors e USING (token_id)""",
    "head_vectors": "SELECT l.entry AS token_id, e.v FROM lexicon l JOIN vectors e ON e.token_id = l.token_id",
    "def_vectors": pooled_sql(
        "SELECT t.token_id, o.token_id AS id, count(*) AS n FROM def_tokens t JOIN vocab o ON o.word = t.tok GROUP BY ALL",
        "token_id",
    ),
    "band_sheet": """
SELECT l.token_id, arg_max(d.v, l.entry) AS v FROM lexicon l JOIN def_vectors d ON d.token_id = l.entry
WHERE l.norm > 1.1 AND l.norm < 1.6 GROUP BY l.token_id""",
    "char_vocab": r"""
SELECT ch, n FROM (
  SELECT ch, count(*) AS n, sum(count(*)) OVER () AS total
  FROM (SELECT unnest(regexp_extract_all(lower(text), '\S')) AS ch FROM documents) GROUP BY ch)
WHERE n * 10000 >= total""",
    "char_ids": "SELECT ch, CAST(row_number() OVER (ORDER BY n DESC, ch) - 1 AS BIGINT) AS char_id FROM char_vocab",
    "issues": """
SELECT conv_id,
       max(CASE WHEN turn = 0 THEN text END) AS title,
       coalesce(max(CASE WHEN turn = 1 THEN text END), '') AS body,
       max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 1 AS is_pr,
       coalesce(list(text ORDER BY turn, text) FILTER (WHERE turn >= 2), []) AS comments
FROM conversations GROUP BY conv_id""",
    "token_seq": """
SELECT d.token_id AS doc_id, d.pos, coalesce(o.token_id, -1) AS id
FROM def_tokens d LEFT JOIN vocab o ON o.word = d.tok""",
    "sequences": """
SELECT d.doc_id, coalesce(s.ids, []::BIGINT[]) AS ids
FROM documents d LEFT JOIN (SELECT doc_id, list(id ORDER BY pos) AS ids FROM token_seq GROUP BY doc_id) s USING (doc_id)""",
    "pretokens": "SELECT doc_id AS sent_id, pos, tok, start, \"end\" FROM (" + pieces_sql(rf"{WORD}|{PUNCT}+|\s+") + ")",
    "ner_tokens": """
SELECT *, CASE WHEN length(tok) % 5 <= 1 THEN 'I-PER' WHEN length(tok) % 5 = 2 THEN 'I-LOC' ELSE 'O' END AS label,
       CAST(length(tok) + pos % 7 AS DOUBLE) / 40.0::DOUBLE AS score
FROM pretokens""",
    "logits": """
SELECT *, [CAST((length(tok) * 7 + pos) % 11 AS DOUBLE) / 4.0::DOUBLE, CAST((length(tok) * 3 + pos * 5) % 13 AS DOUBLE) / 4.0::DOUBLE,
           CAST((length(tok) * 5 + pos * 2) % 7 AS DOUBLE) / 4.0::DOUBLE, CAST((length(tok) * 2 + pos * 3) % 17 AS DOUBLE) / 4.0::DOUBLE] AS logits
FROM pretokens""",
    "labelled": """
SELECT d.doc_id, CAST(coalesce(l.quality, -1) AS BIGINT) AS label,
       CASE WHEN l.quality IS NULL THEN 'unsupervised' WHEN l.toxic = 1 THEN 'test' ELSE 'train' END AS split
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "unigram": """
SELECT w, -ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM def_tokens)) AS loss
FROM (SELECT tok AS w FROM def_tokens) GROUP BY w""",
    "doc_losses": """
SELECT d.doc_id, d.lang, avg(u.loss) AS loss
FROM def_tokens t JOIN unigram u ON u.w = t.tok JOIN documents d ON d.doc_id = t.token_id GROUP BY ALL""",
    "words": rf"""
SELECT w, count(*) AS f FROM (SELECT unnest(regexp_extract_all(text, '{WORD}|{PUNCT}+')) AS w FROM documents) GROUP BY w""",
    "split_words": r"SELECT w, f, regexp_extract_all(w, '.') AS sy FROM words",
    "pair_counts": """
SELECT a, b, CAST(sum(f) AS BIGINT) AS n
FROM (SELECT f, unnest(sy[:-2]) AS a, unnest(sy[2:]) AS b FROM split_words WHERE len(sy) > 1) GROUP BY a, b""",
}


def with_relations(sql: str) -> str:
    """Put the relations a query names in front of it, and those they name."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in RELATIONS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+\(*{name}\b", text):
                needed.add(name)
                visit(RELATIONS[name])

    visit(sql)
    parts = [f"{name} AS MATERIALIZED ({RELATIONS[name]})" for name in RELATIONS if name in needed]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
