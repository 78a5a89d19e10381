"""Queries over rows and columns: sources' projections, filters, joins, sets, reshapes, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossvec.catalog.registry import query
from glossvec.functions import labels as lab
from glossvec.functions import text as txt
from glossvec.operators import filters as flt
from glossvec.operators import quality as ql
from glossvec.operators import shape as shp
from glossvec.operators import vocabulary as voc
from glossvec.operators.corpus import shuffle
from glossvec.operators.summaries import mean_word_losses
from glossvec.sources.corpora import code_columns

# Norm band of the examples: about the middle half of the norms.
LO, HI = 1.1, 1.6


# --- sources ---------------------------------------------------------------

@query("code_record_projection", r"""
SELECT source AS repository_name, source || '/' || doc_id AS func_path_in_repository, 'f' || doc_id AS func_name,
       text AS whole_func_string, lang AS language, lower(text) AS func_code_string,
       regexp_extract_all(text, '\S+') AS func_code_tokens, source AS func_documentation_string,
       [source] AS func_documentation_tokens, 'train' AS split_name, lang || '/' || doc_id AS func_code_url
FROM documents""")
def _(x):
    d = x.documents
    stored = d.select(
        F.col("source").alias("repo"),
        F.concat("source", F.lit("/"), "doc_id").alias("path"),
        F.concat(F.lit("f"), "doc_id").alias("func_name"),
        F.col("text").alias("original_string"),
        F.col("lang").alias("language"),
        F.lower("text").alias("code"),
        txt.words("text").alias("code_tokens"),
        F.col("source").alias("docstring"),
        F.array("source").alias("docstring_tokens"),
        F.lit("train").alias("partition"),
        F.concat("lang", F.lit("/"), "doc_id").alias("url"),
    )
    return stored.select(*code_columns(stored))


@query("select_language", "SELECT doc_id, lang AS language, n_chars FROM documents WHERE lang IN ('en', 'fr')")
def _(x):
    d = x.documents.select("doc_id", F.col("lang").alias("language"), "n_chars")
    return shp.select_language(d, ["en", "fr"])


@query("concat_languages", "SELECT doc_id, lang AS language FROM documents WHERE lang IN ('en', 'de', 'es')")
def _(x):
    d = x.documents.select("doc_id", F.col("lang").alias("language"))
    return shp.concat_languages(*[shp.select_language(d, v) for v in ("en", "de", "es")])


@query("read_named_split", "SELECT doc_id, label, split FROM labelled WHERE split = 'unsupervised'")
def _(x):
    return shp.read_named_split(x.labelled, "unsupervised")


# --- projections, filters --------------------------------------------------

@query("norm_band_filter", f"SELECT word, token_id, definition, norm FROM lexicon WHERE norm > {LO} AND norm < {HI}")
def _(x):
    return flt.norm_band_filter(x.lexicon_rows, LO, HI).drop("entry")


@query("norm_quartile_bands", """
SELECT word, norm, CAST(CASE WHEN norm < q1 THEN 0 WHEN norm > q1 AND norm < q2 THEN 1 WHEN norm > q2 AND norm < q3 THEN 2
                        WHEN norm > q3 AND norm < 1.84 THEN 3 END AS BIGINT) AS band
FROM lexicon, (SELECT quantile_cont(norm, 0.25) AS q1, quantile_cont(norm, 0.5) AS q2, quantile_cont(norm, 0.75) AS q3 FROM lexicon)""")
def _(x):
    return flt.norm_quartile_bands(x.lexicon, top=1.84)


@query("drop_columns", "SELECT doc_id, lang, source FROM documents")
def _(x):
    return shp.drop_columns(x.documents, ["text", "n_chars"])


@query("keep_columns", "SELECT title, body, comments FROM issues")
def _(x):
    return shp.keep_columns(x.issues, ["title", "body", "comments"])


@query("rename_columns", "SELECT doc_id AS id, label AS labels, split FROM labelled")
def _(x):
    return shp.rename_columns(x.labelled, {"doc_id": "id", "label": "labels"})


@query("definition_contains_band_word", r"""
SELECT word, token_id, definition, norm FROM lexicon l
WHERE EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(l.definition, '\S+')) AS w) d
              JOIN lexicon b ON b.word = d.w WHERE b.norm > 1.3 AND b.norm < 1.4)""")
def _(x):
    return flt.definition_contains_band_word(x.defined_lexicon, 1.3, 1.4, "entry").select("word", "token_id", "definition", "norm")


@query("band_word_positions", f"""
SELECT l.entry, l.word, coalesce(list(d.pos ORDER BY d.pos) FILTER (WHERE b.word IS NOT NULL), []::BIGINT[]) AS positions
FROM lexicon l JOIN def_tokens d ON d.token_id = l.entry AND d.pos > 0
LEFT JOIN (SELECT DISTINCT word FROM lexicon WHERE norm > {LO} AND norm < {HI}) b ON b.word = d.tok
GROUP BY l.entry, l.word""")
def _(x):
    return flt.band_word_positions(x.defined_lexicon, LO, HI, key="entry")


@query("char_coverage_filter", r"""
SELECT word, token_id, definition, norm FROM lexicon
WHERE entry NOT IN (SELECT entry FROM (SELECT entry, unnest(list_distinct(regexp_extract_all(word || definition, '\S'))) AS c FROM lexicon)
                       WHERE c NOT IN (SELECT ch FROM char_vocab))""")
def _(x):
    return flt.char_coverage_filter(x.lexicon_rows, x.char_vocab, ["word", "definition"]).drop("entry")


@query("clean_word_filter", r"""
SELECT doc_id, word FROM dictionary
WHERE word NOT IN (SELECT word FROM (SELECT word, unnest(list_distinct(regexp_extract_all(word, '.'))) AS c FROM dictionary)
                   WHERE c NOT IN (SELECT ch FROM char_vocab))""")
def _(x):
    return flt.clean_word_filter(x.dictionary.select("doc_id", "word"), x.char_vocab)


@query("issue_filter", "SELECT conv_id, title, body, is_pr, comments FROM issues WHERE NOT is_pr AND len(comments) > 0")
def _(x):
    return flt.issue_filter(x.issues)


@query("min_words_filter", r"""
SELECT conv_id, turn, role, text FROM conversations WHERE len(regexp_extract_all(text, '\S+')) > 15""")
def _(x):
    return flt.min_words_filter(x.conversations, "text", 15)


@query("string_type_guard", """
SELECT d.token_id, v.word FROM definitions d LEFT JOIN vocab v USING (token_id) WHERE v.word IS NOT NULL""")
def _(x):
    named = x.definitions.select("token_id").join(x.vocab.select("token_id", "word"), "token_id", "left")
    return flt.string_type_guard(named, "word")


@query("lookup_word", "SELECT doc_id, word, definition FROM dictionary WHERE word = 'the'")
def _(x):
    return flt.lookup_word(x.dictionary, "the")


@query("head_slice", """
SELECT doc_id, ord FROM (SELECT doc_id, md5(concat_ws(':', '42', doc_id)) AS ord FROM documents) ORDER BY ord, doc_id LIMIT 100""")
def _(x):
    return flt.head_slice(shuffle(x.documents.select("doc_id"), "doc_id", 42), ["ord", "doc_id"], 100)


@query("row_range", """
SELECT word, entry, norm FROM (SELECT *, row_number() OVER (ORDER BY entry) - 1 AS n FROM lexicon) WHERE n >= 50 AND n < 150""")
def _(x):
    return flt.row_range(x.lexicon.select("word", "entry", "norm"), "entry", 50, 150)


@query("with_length", "SELECT doc_id, CAST(length(definition) AS BIGINT) AS length FROM dictionary")
def _(x):
    return flt.with_length(x.dictionary, "definition").select("doc_id", "length")


@query("with_word_count", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS word_count FROM documents""")
def _(x):
    return flt.with_word_count(x.documents, "text").select("doc_id", "word_count")


@query("concat_text", r"SELECT conv_id, title || E' \n ' || body AS text FROM issues")
def _(x):
    return flt.concat_text(x.issues, ["title", "body"]).select("conv_id", "text")


@query("cast_to_string", """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role FROM conversations""")
def _(x):
    return shp.cast_to_string(x.conversations.select("conv_id", "turn", "role"), ["conv_id", "turn"])


@query("strip_chars", """SELECT doc_id, trim(text, '[]''".') AS text FROM documents""")
def _(x):
    return flt.strip_chars(x.documents.select("doc_id", "text"), "text", "[]'\".")


# --- joins and sets --------------------------------------------------------

@query("vocab_dictionary_overlap", """
SELECT doc_id, word, definition FROM dictionary WHERE word IN (SELECT word FROM vocab)""")
def _(x):
    return voc.vocab_dictionary_overlap(x.dictionary, x.vocab).select("doc_id", "word", "definition")


@query("oov_words", "SELECT DISTINCT tok FROM def_tokens WHERE tok NOT IN (SELECT word FROM vocab)")
def _(x):
    return voc.oov_words(x.def_tokens, x.vocab)


@query("token_to_id", """
SELECT d.token_id AS doc_id, d.pos, coalesce(o.token_id, -1) AS id FROM def_tokens d LEFT JOIN vocab o ON o.word = d.tok""")
def _(x):
    return voc.token_to_id(x.def_tokens, x.vocab).select(F.col("token_id").alias("doc_id"), "pos", "id")


@query("id_to_token", """
SELECT s.doc_id, list(coalesce(o.word, '[UNK]') ORDER BY s.pos) AS tokens
FROM token_seq s LEFT JOIN vocab o ON o.token_id = s.id GROUP BY s.doc_id""")
def _(x):
    return voc.id_to_token(x.sequences.where(F.size("ids") > 0), x.vocab, key="doc_id")


@query("definition_band_words", f"""
SELECT DISTINCT word FROM lexicon
WHERE norm > {LO} AND norm < {HI} AND word IN (SELECT d.tok FROM def_tokens d JOIN lexicon l ON l.entry = d.token_id AND d.pos > 0)""")
def _(x):
    return flt.definition_band_words(x.defined_lexicon, LO, HI)


@query("overlap_counts", """
SELECT (SELECT count(DISTINCT word) FROM vocab) AS n_a, (SELECT count(DISTINCT word) FROM dictionary) AS n_b,
       (SELECT count(DISTINCT word) FROM dictionary WHERE word IN (SELECT word FROM vocab)) AS n_common""")
def _(x):
    return voc.overlap_counts(x.vocab, x.dictionary)


@query("word_intersection", "SELECT word FROM vocab INTERSECT SELECT word FROM dictionary")
def _(x):
    return voc.word_intersection(x.vocab, x.dictionary)


@query("word_union", "SELECT word FROM vocab UNION SELECT word FROM dictionary")
def _(x):
    return voc.word_union(x.vocab, x.dictionary)


@query("distinct_words", "SELECT DISTINCT word FROM dictionary")
def _(x):
    return voc.distinct_words(x.dictionary)


@query("compare_tables", """
SELECT a.word, a.doc_id AS doc_id_1, a.definition AS definition, b.token_id, b.norm
FROM dictionary a JOIN (SELECT DISTINCT word, token_id, norm FROM lexicon) b USING (word)""")
def _(x):
    a = x.dictionary
    b = x.lexicon.select("word", "token_id", "norm", F.col("token_id").alias("doc_id")).distinct()
    return shp.compare_tables(a, b, "word").drop("doc_id_2")


@query("last_wins", "SELECT source, arg_max(lang, doc_id) AS lang, max(doc_id) AS doc_id FROM documents GROUP BY source")
def _(x):
    return flt.last_wins(x.documents.select("source", "lang", "doc_id"), "source", F.col("doc_id"))


# --- reshape ---------------------------------------------------------------

@query("explode_list", """
SELECT conv_id, unnest(CASE WHEN len(comments) = 0 THEN [NULL] ELSE comments END) AS comments FROM issues""")
def _(x):
    return shp.explode_list(x.issues.select("conv_id", "comments"), "comments")


@query("melt", """
SELECT doc_id AS id, 'label' AS variable, CAST(label AS VARCHAR) AS value FROM labelled
UNION ALL SELECT doc_id, 'split', split FROM labelled""")
def _(x):
    return shp.melt(x.labelled, "doc_id")


@query("dict_to_table", "SELECT word AS key, freq AS value FROM vocab")
def _(x):
    return shp.dict_to_table(x.vocab.select(F.create_map("word", "freq").alias("m")), "m")


# --- scalar functions ------------------------------------------------------

@query("words", r"SELECT doc_id, regexp_extract_all(text, '\S+') AS words FROM documents")
def _(x):
    return x.documents.select("doc_id", txt.words("text").alias("words"))


@query("chars", r"SELECT doc_id, regexp_extract_all(text, '(?s).') AS chars FROM documents")
def _(x):
    return x.documents.select("doc_id", txt.chars("text").alias("chars"))


@query("normalise_text", "SELECT doc_id, strip_accents(lower(text)) AS text FROM documents")
def _(x):
    return x.documents.select("doc_id", txt.normalise_text("text").alias("text"))


@query("softmax", """
SELECT sent_id, pos, list_transform(list_transform(g, lambda z: z / list_sum(g)), lambda z: round(z, 6)) AS p
FROM (SELECT sent_id, pos, list_transform(logits, lambda z: exp(z - list_max(logits))) AS g FROM logits)""")
def _(x):
    return x.logits.select("sent_id", "pos", F.transform(lab.softmax("logits"), lambda z: F.round(z, 6)).alias("p"))


@query("argmax", "SELECT sent_id, pos, CAST(list_position(logits, list_max(logits)) - 1 AS BIGINT) AS best FROM logits")
def _(x):
    return x.logits.select("sent_id", "pos", lab.argmax("logits").alias("best"))


LABELS = {0: "O", 1: "B-PER", 2: "I-PER", 3: "I-LOC"}


@query("id_to_label", """
SELECT doc_id, CASE label WHEN 0 THEN 'O' WHEN 1 THEN 'B-PER' END AS entity FROM labelled""")
def _(x):
    return x.labelled.select("doc_id", lab.id_to_label("label", LABELS).alias("entity"))


@query("char_span", """
SELECT p.sent_id, p.pos, substring(d.text, CAST(p.start AS BIGINT) + 1, p."end" - p.start) AS tok
FROM pretokens p JOIN documents d ON d.doc_id = p.sent_id""")
def _(x):
    # Three lists of whole numbers in the same order: a third of the bytes of a list of structs.
    spans = x.pretokens.groupBy("sent_id").agg(*[F.collect_list(F.col(c).cast("int")).alias(c) for c in ("pos", "start", "end")])
    met = spans.join(x.sentences, "sent_id")
    cut = met.select("sent_id", "pos", txt.char_spans("text", "start", "end").alias("tok"))
    return cut.select("sent_id", F.inline(F.arrays_zip("pos", "tok"))).withColumn("pos", F.col("pos").cast("bigint"))


@query("hyphen_to_space", "SELECT doc_id, replace(text, '-', ' ') AS text FROM documents")
def _(x):
    return x.documents.select("doc_id", txt.hyphen_to_space("text").alias("text"))


@query("exp", "SELECT doc_id, round(exp(loss), 4) AS ppl FROM doc_losses")
def _(x):
    return document_losses(x).select("doc_id", F.round(F.exp("loss"), 4).alias("ppl"))


def document_losses(x):
    """Mean unigram loss of every document: doc_id, lang, loss."""
    losses = mean_word_losses(x.documents)
    return losses.join(x.documents.select("doc_id", "lang"), "doc_id")


# --- quality ---------------------------------------------------------------

@query("label_domain_check", """
SELECT 'label_domain' AS "check", count(*) AS n_violations FROM labelled
WHERE NOT ((split = 'train' AND label IN (0, 1)) OR (split = 'test' AND label IN (1)) OR (split = 'unsupervised' AND label IN (-1)))""")
def _(x):
    return ql.label_domain_check(x.labelled, {"train": [0, 1], "test": [1], "unsupervised": [-1]})


@query("no_duplicate_rows", """
SELECT 'no_duplicate_rows' AS "check", CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_violations
FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)""")
def _(x):
    return ql.no_duplicate_rows(x.documents.select("text", "lang"))


@query("non_empty_sequences", """
SELECT 'non_empty_sequences' AS "check", count(*) AS n_violations
FROM sequences WHERE len(list_filter(ids, lambda i: i >= 0)) = 0""")
def _(x):
    known = x.sequences.select(F.filter("ids", lambda i: i >= 0).alias("input_ids"))
    return ql.non_empty_sequences(known)


@query("min_fields", r"""
SELECT 'min_fields' AS "check", count(*) AS n_violations
FROM (SELECT unnest(string_split(text, E'\n')) AS line FROM documents) WHERE len(regexp_extract_all(line, '\S+')) < 3""")
def _(x):
    return ql.min_fields(x.documents.select(F.explode(F.split("text", "\n")).alias("value")))


@query("tokens_match_vectors", """
SELECT 'tokens_match_vectors' AS "check", count(*) AS n_violations
FROM sequences WHERE len(list_filter(ids, lambda i: i >= 0)) <> len(ids)""")
def _(x):
    pairs = x.sequences.select(F.col("ids").alias("tokens"), F.filter("ids", lambda i: i >= 0).alias("vectors"))
    return ql.tokens_match_vectors(pairs)


@query("non_empty_dataset", """
SELECT 'non_empty_dataset' AS "check", CAST(CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS BIGINT) AS n_violations FROM documents""")
def _(x):
    return ql.non_empty_dataset(x.documents)
