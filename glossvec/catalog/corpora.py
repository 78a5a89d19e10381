"""Queries over tokens, tokenisers and training corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossvec.catalog.registry import query
from glossvec.catalog.relations import PUNCT, WORD, pieces_sql
from glossvec.catalog.tables import LABELS
from glossvec.functions.text import word_runs
from glossvec.operators import corpus as cp
from glossvec.operators import entities as en
from glossvec.operators import merges as mg
from glossvec.operators import tokens as tk
from glossvec.operators import vocabulary as voc

# --- vocabulary and pairs --------------------------------------------------


@query("build_vocabulary", "SELECT word, token_id, freq FROM vocab")
def _(x):
    counts = voc.word_frequencies(x.documents)
    return voc.build_vocabulary(counts, x.embeddings.count())


@query("char_vocabulary", "SELECT ch, n FROM char_vocab")
def _(x):
    return voc.char_vocabulary(x.documents, share=1e-4)


@query("word_frequencies", "SELECT tok AS w, count(*) AS n FROM def_tokens GROUP BY tok")
def _(x):
    return voc.word_frequencies(x.documents)


@query("alphabet", r"""
SELECT DISTINCT unnest(regexp_extract_all(w, '.')) AS ch FROM words""")
def _(x):
    return voc.alphabet(x.documents, tk.pretokens("text", "punct"))


@query("pair_frequencies", "SELECT a, b, n FROM pair_counts")
def _(x):
    return mg.pair_frequencies(mg.split_words(mg.word_table(x.documents)))


@query("best_pair", "SELECT a, b, n FROM pair_counts ORDER BY n DESC, a, b LIMIT 1")
def _(x):
    return mg.best_pair(mg.pair_frequencies(mg.split_words(mg.word_table(x.documents))))


@query("apply_merge", r"""
SELECT w, f, string_split(replace(s, chr(29) || 't' || chr(30) || chr(29) || 'h' || chr(30), chr(29) || 'th' || chr(30))[2:-2],
                          chr(30) || chr(29)) AS sy
FROM (SELECT w, f, chr(29) || array_to_string(sy, chr(30) || chr(29)) || chr(30) AS s FROM split_words)""")
def _(x):
    return mg.apply_merge(mg.split_words(mg.word_table(x.documents)), "t", "h")


# --- pre-tokenising --------------------------------------------------------

@query("pretokenise_whitespace_punct", pieces_sql(rf"{WORD}|{PUNCT}+|\s+"))
def _(x):
    return tk.pretokenise(x.documents, "punct")


@query("pretokenise_bert", pieces_sql(rf"{WORD}|{PUNCT}|\s+"))
def _(x):
    return tk.pretokenise(x.documents, "bert")


@query("pretokenise_leading_space", pieces_sql(rf" ?{WORD}| ?{PUNCT}+|\s+", mark=True))
def _(x):
    return tk.pretokenise(x.documents, "space")


@query("token_offsets", 'SELECT sent_id AS doc_id, pos, start, "end" FROM pretokens')
def _(x):
    return tk.token_offsets(x.documents)


# --- tokenisers ------------------------------------------------------------

#: Merges of `train_bpe`; entries of the corpus tokeniser and of word pieces, or while a pair repeats.
MERGES, CORPUS_ENTRIES, PIECE_ENTRIES = 4_000, 52_000, 25_000


def _trained(x, name, train):
    """Training result, kept per folder so that encoding queries do not train again."""
    if name not in x.__dict__:
        x.__dict__[name] = train()
    return x.__dict__[name]


def _bpe(x):
    return _trained(x, "bpe", lambda: mg.train_bpe(x.documents, rounds=MERGES, least=2, words=x.words))


def _wordpiece(x):
    return _trained(x, "wordpiece", lambda: mg.train_wordpiece(x.documents, PIECE_ENTRIES, least=2))


@query("train_bpe")
def _(x):
    return _bpe(x).merge_table()


@query("train_corpus_tokeniser")
def _(x):
    return mg.train_corpus_tokeniser(x.documents, CORPUS_ENTRIES, least=2).vocabulary_table()


@query("train_wordpiece")
def _(x):
    return _wordpiece(x).vocabulary_table()


@query("encode_bpe")
def _(x):
    return mg.encode_bpe(x.documents, _bpe(x).merges).select("doc_id", "tokens")


@query("encode_wordpiece")
def _(x):
    return mg.encode_wordpiece(x.documents, _wordpiece(x).vocabulary).select("doc_id", "tokens")


@query("compare_tokenisations")
def _(x):
    words = x.words.select("w")
    merges = _bpe(x).merges
    short, full = mg.encode_words(words, merges[: len(merges) // 2]), mg.encode_words(words, merges)
    return tk.compare_tokenisations(words, short, full)


# --- sequences -------------------------------------------------------------

@query("add_special_tokens", """
SELECT doc_id, list_concat([-3], ids, [-4]) AS input_ids, list_transform(range(len(ids) + 2), lambda z: 0::BIGINT) AS token_type_ids,
       list_transform(range(len(ids) + 2), lambda z: 1::BIGINT) AS attention_mask FROM sequences""")
def _(x):
    return tk.add_special_tokens(x.sequences)


@query("tokens_to_ids", """
SELECT doc_id, ids AS input_ids, list_transform(range(len(ids)), lambda z: 0::BIGINT) AS token_type_ids,
       list_transform(range(len(ids)), lambda z: 1::BIGINT) AS attention_mask FROM sequences""")
def _(x):
    return tk.tokens_to_ids(x.documents.select("doc_id", "text"), word_runs("text"), x.vocab)


@query("truncate", """
SELECT doc_id, CASE WHEN len(f) > 128 THEN list_concat(f[1:127], [-4]) ELSE f END AS input_ids,
       list_transform(range(least(len(f), 128)), lambda z: 0::BIGINT) AS token_type_ids,
       list_transform(range(least(len(f), 128)), lambda z: 1::BIGINT) AS attention_mask
FROM (SELECT doc_id, list_concat([-3], ids, [-4]) AS f FROM sequences)""")
def _(x):
    return tk.truncate(tk.add_special_tokens(x.sequences), 128)


@query("encode_pair", """
WITH p AS (SELECT i.conv_id,
                  list_transform(regexp_extract_all(lower(title), '[\\p{L}\\p{M}\\p{N}_]+'), lambda t: coalesce(v.m[t], -1)) AS a,
                  list_transform(regexp_extract_all(lower(body), '[\\p{L}\\p{M}\\p{N}_]+'), lambda t: coalesce(v.m[t], -1)) AS b
           FROM issues i, (SELECT map(list(word), list(token_id)) AS m FROM vocab) v),
k AS (SELECT *, greatest(len(a) + len(b) - 125, 0) AS o, abs(len(a) - len(b)) AS g FROM p),
c AS (SELECT conv_id,
             a[1:greatest(len(a) - CASE WHEN len(a) > len(b) THEN least(o, g) ELSE 0 END - CAST(floor(greatest(o - g, 0) / 2) AS BIGINT), 0)] AS a,
             b[1:greatest(len(b) - CASE WHEN len(b) > len(a) THEN least(o, g) ELSE 0 END - CAST(ceil(greatest(o - g, 0) / 2) AS BIGINT), 0)] AS b FROM k)
SELECT conv_id, list_concat([-3], a, [-4], b, [-4]) AS input_ids,
       list_transform(range(len(a) + len(b) + 3), lambda z: CASE WHEN z < len(a) + 2 THEN 0::BIGINT ELSE 1::BIGINT END) AS token_type_ids,
       list_transform(range(len(a) + len(b) + 3), lambda z: 1::BIGINT) AS attention_mask
FROM c""")
def _(x):
    both = tk.with_token_ids(x.issues.select("conv_id", "title", "body"), word_runs("title"), x.vocab, "a", key="conv_id")
    both = tk.with_token_ids(both, word_runs("body"), x.vocab, "b", key="conv_id")
    return tk.encode_pair(both, key="conv_id", max_len=128)


@query("pad_batch", """
WITH s AS (SELECT CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 8) AS BIGINT) AS batch_id, doc_id, ids FROM sequences),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) - len(ids) AS gap FROM s)
SELECT batch_id, doc_id, list_concat(ids, list_transform(range(gap), lambda z: -2::BIGINT)) AS input_ids,
       list_concat(list_transform(range(len(ids)), lambda z: 1::BIGINT), list_transform(range(gap), lambda z: 0::BIGINT)) AS attention_mask
FROM m""")
def _(x):
    return tk.pad_batch(x.sequences, 8)


PIECES_SQL = r"""
SELECT token_id AS doc_id, pos, p[j] AS piece, j, row_number() OVER (PARTITION BY token_id ORDER BY pos, j) - 1 AS k
FROM (SELECT token_id, pos, p, unnest(range(1, len(p) + 1)) AS j
      FROM (SELECT token_id, pos, regexp_extract_all(tok, '.{1,3}') AS p FROM def_tokens))"""


def _pieces(x):
    """Words cut into pieces of up to three characters."""
    def cut(w):
        return F.regexp_extract_all(w, F.lit(".{1,3}"), F.lit(0))

    return tk.word_pieces(x.documents.select("doc_id", "text"), word_runs("text"), cut)


@query("word_alignment", f"""
SELECT doc_id, list_concat([NULL], list(pos ORDER BY k), [NULL]) AS word_ids FROM ({PIECES_SQL}) GROUP BY doc_id""")
def _(x):
    return tk.word_alignment(_pieces(x).where(F.size("pieces") > 0))


@query("tokens_to_string", f"""
SELECT doc_id, string_agg(CASE WHEN j > 1 THEN piece WHEN k > 0 THEN ' ' || piece ELSE piece END, '' ORDER BY k) AS text
FROM ({PIECES_SQL}) GROUP BY doc_id""")
def _(x):
    first = F.transform("word_ids", lambda w, i: (i == 0) | (F.get("word_ids", i - 1) != w))
    marked = F.zip_with("pieces", first, lambda p, f: F.when(f, p).otherwise(F.concat(F.lit("##"), p)))
    seq = _pieces(x).where(F.size("pieces") > 0).select("doc_id", marked.alias("tokens"))
    return tk.tokens_to_string(seq)


@query("char_word_ids", """
SELECT word, list(coalesce(c.char_id, -1) ORDER BY i) AS word_ids
FROM (SELECT word, unnest(t) AS ch, generate_subscripts(t, 1) AS i FROM (SELECT word, regexp_extract_all(word, '.') AS t FROM vocab))
LEFT JOIN char_ids c USING (ch) GROUP BY word""")
def _(x):
    return tk.char_word_ids(x.vocab, x.char_ids)


# --- corpus jobs -----------------------------------------------------------

@query("corpus_batches", """
SELECT CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 1000) AS BIGINT) AS batch_id, doc_id, text FROM documents""")
def _(x):
    return cp.corpus_batches(x.documents)


@query("group_texts", """
SELECT chunk, input_ids, input_ids AS labels FROM (
  SELECT CAST(floor(g / 128) AS BIGINT) AS chunk, list(id ORDER BY g) AS input_ids
  FROM (SELECT id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS g FROM token_seq) GROUP BY 1) WHERE len(input_ids) = 128""")
def _(x):
    return cp.group_texts(x.sequences, 128)


@query("group_texts_by_source", """
SELECT source, chunk, input_ids, input_ids AS labels FROM (
  SELECT source, CAST(floor(g / 128) AS BIGINT) AS chunk, list(id ORDER BY g) AS input_ids
  FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS g
        FROM token_seq JOIN documents USING (doc_id)) GROUP BY 1, 2) WHERE len(input_ids) = 128""")
def _(x):
    named = x.sequences.join(x.documents.select("doc_id", "source"), "doc_id")
    return cp.group_texts(named, 128, group_key="source")


_MASKED = """
SELECT doc_id, pos,
       CASE WHEN h[1:4] < '2666' THEN CASE WHEN h[5:8] < 'cccd' THEN -5 WHEN h[5:8] < 'e666' THEN CAST('0x' || h[9:16] AS BIGINT) % (SELECT count(*) FROM vocab) ELSE id END
            ELSE id END AS {a},
       CASE WHEN h[1:4] < '2666' THEN id ELSE -100 END AS {b}
FROM (SELECT *, md5(concat_ws(':', '{s}', doc_id, pos)) AS h FROM token_seq)"""


@query("mlm_mask", _MASKED.format(a="input_id", b="label", s=42))
def _(x):
    return cp.mlm_mask(x.token_seq, vocab_size=x.vocab.count())


@query("fixed_eval_mask", _MASKED.format(a="masked_input_ids", b="masked_labels", s=7))
def _(x):
    return cp.fixed_eval_mask(x.token_seq, seed=7, vocab_size=x.vocab.count())


@query("whole_word_mask", f"""
SELECT doc_id, CAST(k AS BIGINT) AS pos, CASE WHEN c THEN -5 ELSE id END AS input_id, CASE WHEN c THEN id ELSE -100 END AS label
FROM (SELECT doc_id, k, CAST('0x' || md5(piece)[1:7] AS BIGINT) AS id,
             md5(concat_ws(':', '42', doc_id, pos))[1:4] < '3333' AS c FROM ({PIECES_SQL}))""")
def _(x):
    def number(p):
        return F.conv(F.substring(F.md5(p), 1, 7), 16, 10).cast("bigint")

    seq = _pieces(x).select("doc_id", F.transform("pieces", number).alias("ids"), "word_ids")
    return cp.whole_word_mask(seq)


@query("shuffle", "SELECT doc_id, lang, md5(concat_ws(':', '42', doc_id)) AS ord FROM documents")
def _(x):
    return cp.shuffle(x.documents.select("doc_id", "lang"), "doc_id")


@query("train_test_split", """
SELECT doc_id, CASE WHEN k < 120 THEN 'train' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id) - 1 AS k FROM documents) WHERE k < 160""")
def _(x):
    return cp.train_test_split(x.documents.select("doc_id"), "doc_id", 120, 40)


@query("sample_rows", """
SELECT doc_id, source FROM documents ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id LIMIT 50""")
def _(x):
    return cp.sample_rows(x.documents.select("doc_id", "source"), "doc_id", 50)


# --- entities --------------------------------------------------------------

@query("decode_entities", """
SELECT sent_id, pos, ['O', 'B-PER', 'I-PER', 'I-LOC'][b] AS entity,
       round(exp(logits[b] - list_max(logits)) / list_sum(list_transform(logits, lambda z: exp(z - list_max(logits)))), 6) AS score,
       tok AS word, start, "end"
FROM (SELECT *, list_position(logits, list_max(logits)) AS b FROM logits) WHERE b > 1""")
def _(x):
    return en.decode_entities(x.logits, LABELS).withColumn("score", F.round("score", 6))


@query("entity_groups", """
WITH t AS (SELECT *, CASE WHEN label <> 'O' THEN label[3:] END AS eg FROM ner_tokens),
l AS (SELECT *, lag(eg) OVER (PARTITION BY sent_id ORDER BY pos) AS p FROM t),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> eg THEN 1 ELSE 0 END) OVER (PARTITION BY sent_id ORDER BY pos) AS g FROM l)
SELECT s.sent_id, s.entity_group, s.score, s.start, s."end", substring(d.text, s.start + 1, s."end" - s.start) AS word
FROM (SELECT sent_id, eg AS entity_group, round(avg(score), 6) AS score, min(start) AS start, max("end") AS "end"
      FROM g WHERE eg IS NOT NULL GROUP BY sent_id, eg, g) s JOIN documents d ON d.doc_id = s.sent_id""")
def _(x):
    return en.entity_groups(x.ner_tokens, x.sentences).withColumn("score", F.round("score", 6))
