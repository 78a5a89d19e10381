import pytest

from glossvec.operators import vocabulary as vo
from glossvec.plans import growing
from plain_rows import rows


def _write(spark, folder, texts, first=0, mode="append"):
    table = spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    table.repartition(2).write.mode(mode).parquet(folder)


def test_two_increments_equal_a_full_count_and_a_new_file_costs_itself(spark, tmp_path):
    source, store, letters = (str(tmp_path / n) for n in ("docs", "words", "letters"))
    seen = []

    def count(docs):
        seen.append(docs.count())
        return vo.word_frequencies(docs)

    with pytest.raises(ValueError):
        growing.merged_counts(spark, store)
    for texts, first in ((["a b a", "b c", None], 0), (["a", "", "d d d é"], 10)):
        _write(spark, source, texts, first)
        assert growing.add_new_files(spark, store, source, count) > 0
        growing.add_new_files(spark, letters, source, vo.char_vocabulary)
    whole = spark.read.parquet(source)
    assert seen == [3, 3]
    merged = growing.merged_counts(spark, store)
    assert rows(merged) == rows(vo.word_frequencies(whole))
    assert rows(growing.merged_counts(spark, letters)) == rows(vo.char_vocabulary(whole))
    # Vocabulary and what two vocabularies share go on from the counts.
    assert rows(vo.build_vocabulary(merged, 3)) == rows(vo.build_vocabulary(vo.word_frequencies(whole), 3))
    assert growing.add_new_files(spark, store, source, count) == 0 and seen == [3, 3]
    assert rows(growing.merged_counts(spark, store)) == rows(merged)


def test_a_lost_count_adds_nothing_and_a_changed_file_is_refused(spark, tmp_path):
    source, store = str(tmp_path / "docs"), str(tmp_path / "words")
    _write(spark, source, ["a b", "b"])

    def lost(docs):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        growing.add_new_files(spark, store, source, lost)
    assert growing.counted_files(spark, store).count() == 0
    n = growing.add_new_files(spark, store, source, vo.word_frequencies)
    assert n == growing.counted_files(spark, store).count()
    assert rows(growing.merged_counts(spark, store)) == [("a", 1), ("b", 2)]
    part = next((tmp_path / "docs").glob("part-*.parquet"))
    (tmp_path / "docs" / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError):
        growing.add_new_files(spark, store, source, vo.word_frequencies)
