"""Token-level entity predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossvec.functions.labels import argmax, id_to_label, top_share
from glossvec.functions.text import char_spans


def decode_entities(logits: DataFrame, labels: dict[int, str], key: str = "sent_id") -> DataFrame:
    """Best label of every token, `O` dropped: sent_id, pos, entity, score, word, start, end.

    `logits` holds (sent_id, pos, tok, logits[], start, end).
    """
    named = logits.withColumn("entity", id_to_label(argmax("logits"), labels)).where(F.col("entity") != "O")
    return named.select(
        key, "pos", "entity", top_share("logits").alias("score"), F.col("tok").alias("word"), "start", "end"
    )


def entity_groups(ner_tokens: DataFrame, texts: DataFrame, key: str = "sent_id") -> DataFrame:
    """Runs of one entity to one row: sent_id, entity_group, score, start, end, word.

    `ner_tokens` holds (sent_id, pos, label, score, start, end); `texts` the
    sentence (sent_id, text) the offsets point into. A `B-` label and a gap in
    positions start a new group; the score is the mean.
    """
    w = Window.partitionBy(key).orderBy("pos")
    kind = F.when(F.col("label") != "O", F.substring("label", 3, 1000))
    typed = ner_tokens.withColumn("entity_group", kind)
    typed = typed.withColumn("__prev", F.lag("entity_group").over(w)).withColumn("__pp", F.lag("pos").over(w))
    new = (
        F.col("__prev").isNull()
        | (F.col("__prev") != F.col("entity_group"))
        | F.col("label").startswith("B-")
        | (F.col("pos") != F.col("__pp") + 1)
    )
    grouped = (
        typed.withColumn("__g", F.sum(F.when(new, 1).otherwise(0)).over(w))
        .where(F.col("entity_group").isNotNull())
        .groupBy(key, "entity_group", "__g")
        .agg(F.avg("score").alias("score"), F.min("start").alias("start"), F.max("end").alias("end"))
    )
    # One row per sentence meets the text, so the text is not copied once per group.
    spans = grouped.groupBy(key).agg(F.collect_list(F.struct("entity_group", "score", "start", "end")).alias("s"))
    met = spans.join(texts.select(key, "text"), key)
    word = char_spans("text", F.col("s.start"), F.col("s.end"))
    rows = met.select(key, "s", word.alias("w")).select(key, F.explode(F.arrays_zip("s", "w")).alias("z"))
    return rows.select(key, "z.s.entity_group", "z.s.score", "z.s.start", "z.s.end", F.col("z.w").alias("word"))
