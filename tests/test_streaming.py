import random

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import cleaning
from reviewloom.operators.conversations import pair_turns
from reviewloom.schemas import MESSAGES
from reviewloom.sources.reviews import read_clean
from reviewloom.streaming import clean_stream, turn_stream

AS_OF = "2025-01-01 00:00:00"
RAW = "site string, ingest_seq long, rating double, date string, content string"


COLUMNS = ["site", "ingest_seq", "rating", "date", "content", "review_length", "weekday", "text_length"]


def raw_rows(seed, n=200):
    rnd = random.Random(seed)
    return [(rnd.choice(["kakaomap", "tripdotcom"]), i, float(rnd.randint(0, 6)), "2024-01-%02d" % rnd.randint(1, 28),
             rnd.choice(["the same text!", "other text here", "short", f"unique text {i}", f"some text {i % 9}"])) for i in range(n)]


def clean_in_files(spark, folder, files, **options):
    source, sink, progress = (str(folder / n) for n in ("in", "out", "progress"))
    for rows in files:
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RAW).parquet(source)
        clean_stream.start_cleaning(stream, sink, progress, AS_OF, **options).awaitTermination()
    return sink


def whole_table(spark, rows):
    return sorted(map(tuple, cleaning.clean_reviews(spark.createDataFrame(rows, RAW), AS_OF).select(*COLUMNS).collect()))


@pytest.mark.parametrize("order", ["as numbered", "backwards", "mixed"])
def test_cleaning_in_batches_equals_one_batch(spark, tmp_path, order):
    """Also where a copy with a smaller number arrives later: it takes the place of the one before."""
    rows = raw_rows(3)
    arriving = {"as numbered": rows, "backwards": rows[::-1], "mixed": random.Random(1).sample(rows, len(rows))}[order]
    sink = clean_in_files(spark, tmp_path, [arriving[at:at + 50] for at in range(0, 200, 50)])
    got = clean_stream.read_cleaned(spark, sink).select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == whole_table(spark, rows)
    replaced = read_clean(spark, sink).count() - got.count()
    assert replaced == 0 if order == "as numbered" else replaced > 0


def test_equal_digests_of_other_texts_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clean_stream, "digest", lambda content: F.length(content).cast("long"))
    rows = raw_rows(4)
    sink = clean_in_files(spark, tmp_path, [rows[100:], rows[:100]])
    assert sorted(map(tuple, clean_stream.read_cleaned(spark, sink).select(*COLUMNS).collect())) == whole_table(spark, rows)


def test_state_of_few_batches_is_bounded_and_loses_nothing(spark, tmp_path):
    rows = raw_rows(5)
    sink = clean_in_files(spark, tmp_path, [rows[at:at + 40] for at in range(160, -1, -40)], keep_batches=2)
    assert len(list((tmp_path / "out-seen").glob("batch=*"))) == 3  # the last one and the two before
    got = clean_stream.read_cleaned(spark, sink, keep_batches=2).select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == whole_table(spark, rows)


def test_a_batch_that_runs_again_leaves_no_second_copy(spark, tmp_path):
    sink = str(tmp_path / "out")
    batches = [[("kakaomap", 5, 5.0, "2024-01-01", "some good text")], [("kakaomap", 1, 4.0, "2024-01-02", "some good text")]]
    for number, rows in enumerate(batches):
        for _ in range(2):
            clean_stream.add_batch(cleaning.apply_rules(spark.createDataFrame(rows, RAW), AS_OF), number, sink)
    assert [(r.ingest_seq, r.rating) for r in clean_stream.read_cleaned(spark, sink).collect()] == [(1, 4.0)]
    assert read_clean(spark, sink).count() == 2


@pytest.mark.parametrize("shuffled", [False, True])
@pytest.mark.parametrize("start, width", [(turn_stream.start_pairing, 4096), (turn_stream.start_pairing, 3),
                                          (turn_stream.start_live_pairing, 4096)])
def test_pairing_in_batches_equals_one_batch(spark, tmp_path, start, width, shuffled):
    rnd = random.Random(8)
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["", "x", "y", None]))
            for t in range(24) for c in range(12)]
    if shuffled:
        rnd.shuffle(rows)
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for first in range(0, len(rows), 60):
        spark.createDataFrame(rows[first:first + 60], MESSAGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(source)
        start(stream, sink, progress).awaitTermination()
    whole = pair_turns(spark.createDataFrame(rows, MESSAGES))
    assert sorted(map(tuple, turn_stream.read_pairs(spark, sink, width).collect())) == sorted(map(tuple, whole.collect()))


def test_late_turns_take_their_place(spark, tmp_path):
    for start in (turn_stream.start_pairing, turn_stream.start_live_pairing):
        source, sink, progress = (str(tmp_path / start.__name__ / n) for n in ("in", "out", "progress"))
        for rows in ([(1, 2, "user", "c")], [(1, 0, "user", "a"), (1, 1, "assistant", "b")]):
            spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(source)
            start(spark.readStream.schema(MESSAGES).parquet(source), sink, progress).awaitTermination()
        got = sorted(map(tuple, turn_stream.read_pairs(spark, sink).collect()))
        assert got == [(1, 1, "a", "b"), (1, 2, "c", "")]


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    sink = str(tmp_path / "out")
    batches = [[(1, 0, "user", "a"), (2, 0, "assistant", "")], [(1, 1, "assistant", "b"), (2, 1, "assistant", "c")],
               [(1, 2, "assistant", "d"), (3, 0, "user", "e")]]
    for number, rows in enumerate(batches):
        for _ in range(2):
            turn_stream.pair_batch(spark.createDataFrame(rows, MESSAGES), number, sink)
    whole = pair_turns(spark.createDataFrame([r for b in batches for r in b], MESSAGES))
    got = sorted(map(tuple, turn_stream.read_pairs(spark, sink).collect()))
    assert got == sorted(map(tuple, whole.collect())) == [(1, 1, "a", "b"), (1, 2, "", "d"), (2, 1, "", "c"), (3, 1, "e", "")]
