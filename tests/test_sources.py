import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewloom.operators import cleaning
from reviewloom.operators.conversations import transcript
from reviewloom.schemas import INDEX, USERS
from reviewloom.sources import reviews as source, segments, tables
from reviewloom.sources.transcripts import write_transcript

AS_OF = "2025-01-01 00:00:00"


@pytest.fixture()
def raw_folder(tmp_path):
    (tmp_path / "reviews_kakaomap.csv").write_text(
        'rating,date,content\n5,2024.05.03,"first line\nsecond ""line"""\nabc,2024.05.03,not a rating\n', encoding="utf-8")
    (tmp_path / "reviews_myrealtrip.csv").write_text(
        'rating,date,content\n4,2024.5.3.,본문 있는 글\n3,,\n', encoding="utf-8-sig")
    (tmp_path / "reviews_other.csv").write_text("rating,date,content\n1,2024.05.03,skipped\n", encoding="utf-8")
    return tmp_path


def test_raw_files_by_name(spark, raw_folder):
    got = source.read_raw_csv(spark, str(raw_folder / "reviews_*.csv")).orderBy("site", "ingest_seq").collect()
    assert [(r.site, r.rating, r.date, r.content) for r in got] == [
        ("kakaomap", 5.0, "2024.05.03", 'first line\nsecond "line"'), ("kakaomap", None, "2024.05.03", "not a rating"),
        ("myrealtrip", 4.0, "2024.5.3.", "본문 있는 글"), ("myrealtrip", 3.0, None, None)]


def test_rows_of_many_files_keep_the_order_of_names(spark, tmp_path):
    for n in range(5):
        body = "".join(f"5,2024.05.03,file {n} row {i}{' long' * (n * 7 % 5) * 50}\n" for i in range(20))
        (tmp_path / f"part-{4 - n}.csv").write_text("rating,date,content\n" + body, encoding="utf-8")
    got = source.read_raw_csv(spark, str(tmp_path / "*.csv"), "kakaomap").orderBy("ingest_seq").collect()
    assert [tuple(map(int, r.content.split()[1:4:2])) for r in got] == [(n, i) for n in range(4, -1, -1) for i in range(20)]
    assert len({r.ingest_seq for r in got}) == 100


def test_one_file_of_a_named_site(spark, raw_folder):
    got = source.read_raw_csv(spark, str(raw_folder / "reviews_kakaomap.csv"), "tripdotcom")
    assert {r.site for r in got.collect()} == {"tripdotcom"}


def test_collection_drops_id_and_refuses_empty(spark, tmp_path):
    full, empty = tmp_path / "full.json", tmp_path / "empty.json"
    full.write_text('{"_id": "x1", "rating": 5, "date": "2024.05.03", "content": "본문"}\n', encoding="utf-8")
    empty.write_text("", encoding="utf-8")
    row = source.read_collection(spark, str(full), "kakaomap").first()
    assert (row.rating, row.content) == (5.0, "본문") and "_id" not in row.asDict()
    with pytest.raises(ValueError, match="No data found"):
        source.read_collection(spark, str(empty), "kakaomap")


def clean_rows(spark):
    rows = [("kakaomap", 1, 5.0, "2024-05-03", "first good text"), ("kakaomap", 2, 4.0, "2024-05-04", "second good text"),
            ("tripdotcom", 3, 3.0, "2024-05-05", "third good text")]
    return cleaning.clean_reviews(
        spark.createDataFrame(rows, "site string, ingest_seq long, rating double, date string, content string"), AS_OF)


def test_writing_again_replaces_sites_and_append_adds(spark, tmp_path):
    clean, path = clean_rows(spark), str(tmp_path / "clean")
    source.write_clean(clean, path)
    source.write_clean(clean.filter("site = 'kakaomap'"), path)
    assert source.read_clean(spark, path).count() == 3
    source.write_clean(clean, path, mode="append")
    assert source.read_clean(spark, path).count() == 6
    with pytest.raises(ValueError):
        source.write_clean(clean, path, mode="other")


def test_summary_of_a_run(spark, tmp_path):
    got = source.write_clean_with_summary(clean_rows(spark), str(tmp_path / "clean")).orderBy("site_name").collect()
    assert [(r.site_name, r.processed_count, r.source_collection, r.target_collection) for r in got] == [
        ("kakaomap", 2, "review_kakaomap", "preprocessed_reviews_kakaomap"),
        ("tripdotcom", 1, "review_tripdotcom", "preprocessed_reviews_tripdotcom")]
    assert got[0].message.endswith("for kakaomap. Processed 2 records.")


def test_csv_form_keeps_tokens_as_json(spark, tmp_path):
    source.write_clean_csv(clean_rows(spark), str(tmp_path / "csv"))
    got = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert json.loads(got.filter("ingest_seq = 1").first().tokenized_content) == ["first", "good", "text"]


def test_preprocessed_files_become_records(spark, tmp_path):
    (tmp_path / "preprocessed_reviews_tripdotcom.csv").write_text(
        "rating,date,content,review_length,tokenized_content,weekday,text_length\n"
        '5.0,2024-05-03,"a ""b""",5,"[\'a\', \'b\']",Friday,5\n4.0,,x,1,[],,1\n', encoding="utf-8")
    got = source.read_preprocessed_csv(spark, str(tmp_path / "preprocessed_reviews_*.csv")).orderBy("ingest_seq").collect()
    assert [(r.platform, r.subject, r.rating, r.date, r.content) for r in got] == [
        ("tripdotcom", "롯데월드", 5.0, "2024-05-03", 'a "b"'), ("tripdotcom", "롯데월드", 4.0, "", "x")]


def test_raw_csv_round_trip_has_three_columns(spark, tmp_path):
    rows = spark.createDataFrame([(5.0, "2024.05.03", 'two\nlines "x"', 1)], "rating double, date string, content string, filter_index int")
    source.write_raw_csv(rows, str(tmp_path / "out"))
    back = source.read_raw_csv(spark, str(tmp_path / "out"), "tripdotcom").first()
    assert (back.rating, back.date, back.content) == (5.0, "2024.05.03", 'two\nlines "x"')


def test_sites_are_tagged_and_split(spark):
    frames = {"kakaomap": spark.createDataFrame([(1,)], "x int"), "nowhere": spark.createDataFrame([(2, "b")], "x int, y string")}
    whole = source.union_sites(frames)
    assert sorted((r.site, r.x, r.y) for r in whole.collect()) == [("kakaomap", 1, None), ("nowhere", 2, "b")]
    known, refused = source.split_known_sites(whole)
    assert known.count() == 1
    assert refused.first().reason == "Unknown site_name: nowhere. Supported sites: ['kakaomap', 'myrealtrip', 'tripdotcom']"


def test_index_is_built_once_checked_and_extended(spark, tmp_path):
    path, built = str(tmp_path / "index"), []
    meta = ("kakaomap", "s", "p", "2024-05-03", 5.0, "")
    rows = spark.createDataFrame([(0, "one", meta, [1.0, 0.0]), (1, "two", meta, [0.0, 1.0])], INDEX)

    def build():
        built.append(1)
        return rows

    assert tables.load_index(spark, path, build).count() == 2
    again = tables.load_index(spark, path, build)
    assert again.count() == 2 and built == [1]
    assert tables.missing_index_fields(again) == []
    assert tables.missing_index_fields(again.drop("meta")) == ["platform", "date", "rating"]
    tables.append_index(path, again, rows)
    assert sorted(r.vec_id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]


def test_empty_index_writes_nothing(spark, tmp_path):
    tables.write_index(spark.createDataFrame([], INDEX), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_subject_files(spark, tmp_path):
    one, many = tmp_path / "one.json", tmp_path / "many.json"
    one.write_text(json.dumps({"name": "A", "category": "c", "ticket_info": {"t": {"adult": "1"}}}), encoding="utf-8")
    many.write_text(json.dumps([{"name": "A"}, {"name": "B"}]), encoding="utf-8")
    row = tables.read_subjects(spark, str(one)).first()
    assert row.name == "A" and json.loads(row.ticket_info) == {"t": {"adult": "1"}}
    assert [r.name for r in tables.read_subjects(spark, str(many)).orderBy("pos").collect()] == ["A", "B"]
    assert tables.read_subjects(spark, str(tmp_path / "missing.json")).count() == 0


def test_users_and_transcript(spark, tmp_path):
    spark.createDataFrame([("a@example.com", "p", "n")], USERS).write.parquet(str(tmp_path / "users"))
    assert tables.read_users(spark, str(tmp_path / "users")).count() == 1
    pairs = spark.createDataFrame([(1, 2, "q2", "a2"), (1, 1, "q1", "a1"), (2, 1, None, "hi")],
                                  "conv_id long, pair_no long, user string, assistant string")
    write_transcript(transcript(pairs), str(tmp_path / "text"))
    whole = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "text").glob("part-*")))
    assert whole == ("[chat] 사용자: q1\n챗봇: a1\n\n[chat] 사용자: q2\n챗봇: a2\n\n[chat] 사용자: None\n챗봇: hi\n\n")


def test_spread_only_when_tasks_are_few(spark, sf):
    few = tables.table(spark, sf, "documents")
    assert tables.spread(few, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(50).withColumn("x", F.lit(1))
    assert tables.spread(many, "id") is many


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_arrival_order_follows_names_and_places_not_sizes(spark, tmp_path, split):
    """Files of 5, 50 and 500 rows, whole and cut into many blocks, in JSON and CSV."""
    sizes = {"a": 5, "b": 50, "c": 500}
    for name, n in sizes.items():
        (tmp_path / f"{name}.json").write_text("".join(json.dumps({
            "_id": f"{name}{i}", "rating": 1, "date": "2024.05.03", "content": f"{name} {i:04d}"}) + "\n" for i in range(n)))
        (tmp_path / f"preprocessed_reviews_{name}.csv").write_text(
            "rating,date,content,review_length,tokenized_content,weekday,text_length\n"
            + "".join(f"5.0,2024-05-03,{name} {i:04d},1,[],,1\n" for i in range(n)))
    expected = [f"{name} {i:04d}" for name, n in sizes.items() for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for rows in (source.read_collection(spark, str(tmp_path / "*.json"), "kakaomap"),
                     source.read_preprocessed_csv(spark, str(tmp_path / "preprocessed_reviews_*.csv"))):
            got = rows.orderBy("ingest_seq").collect()
            assert [r.content for r in got] == expected
            assert [r.ingest_seq for r in got] == list(range(len(expected)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_of_preprocessed_files_can_be_indexed(spark, tmp_path):
    from reviewloom.operators import retrieval
    clean = clean_rows(spark)
    for site in ("kakaomap", "tripdotcom"):
        source.write_preprocessed_csv(clean.filter(F.col("site") == site), str(tmp_path / f"preprocessed_reviews_{site}.csv"))
    records = source.read_preprocessed_csv(spark, str(tmp_path / "preprocessed_reviews_*.csv"))
    got = retrieval.build_index(records).orderBy("vec_id").collect()
    assert [(r.vec_id, r.content, r.meta.platform) for r in got] == [
        (0, "first good text", "kakaomap"), (1, "second good text", "kakaomap"), (2, "third good text", "tripdotcom")]


def test_numbers_of_unlisted_groups_and_clumped_order(spark):
    from reviewloom.operators.ordered import number_rows
    rows = [("z", 1), ("b", 2**40), *(("a", n) for n in range(200)), ("a", 2**50), (None, 3)]
    got = number_rows(spark.createDataFrame(rows, "g string, o long"), "g", "o", "n", ("b", "a")).orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(rows)))
    assert [r.g for r in got][:1] == ["b"] and {r.g for r in got[-2:]} == {"z", None}


def test_loading_warns_of_missing_fields_and_writes_no_empty_index(spark, tmp_path):
    spark.createDataFrame([(0, "x")], "vec_id long, content string").write.parquet(str(tmp_path / "bare"))
    with pytest.warns(UserWarning, match="lacks platform, date, rating"):
        tables.load_index(spark, str(tmp_path / "bare"), lambda: None)
    assert tables.load_index(spark, str(tmp_path / "new"), lambda: spark.createDataFrame([], INDEX)).count() == 0
    assert not (tmp_path / "new").exists()


@pytest.fixture()
def cut_files(spark):
    """Cuts files into ranges of so many bytes."""
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def csv_field(draw):
    text = "".join(draw.choice('ab,"\n x글') for _ in range(draw.randint(0, 30)))
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') or draw.random() < 0.3 else text


def csv_files(folder):
    draw = random.Random(1)
    for n in range(3):
        (folder / f"f{n}.csv").write_text("rating,date,content\n" + "".join(
            f"{i},{csv_field(draw)},{csv_field(draw)}\n" for i in range(200)), encoding="utf-8")
    (folder / "g.csv").write_bytes(b'rating,date,content\n1,a "q" b,say "hi"\n\n2,"x\r\ny",z\r\n3,,"""q"""\n4,"",\n5,"a"b,"c')
    (folder / "h.csv").write_bytes(b'\xef\xbb\xbfrating,date,content\r\n1,"a\r\nb",c\r\n\r\n2,,d\r\n')
    (folder / "i.csv").write_bytes(b"rating,date,content\n")
    (folder / "j.csv").write_bytes(b'rating,date,content\n6,"' + b'long "" line\n' * 300 + b'",end')


@pytest.mark.parametrize("size", ["128m", "300", "41"])
def test_records_cut_in_ranges_are_those_of_the_whole_file(spark, tmp_path, cut_files, size):
    """Quotes and line feeds lie across cuts; a record can hold whole ranges."""
    from reviewloom.schemas import RAW_REVIEW
    csv_files(tmp_path)
    whole = []
    for file in sorted(tmp_path.iterdir()):
        read = (spark.read.schema(RAW_REVIEW).option("header", True).option("multiLine", True).option("quote", '"')
                .option("escape", '"').csv(str(file)))
        assert read.rdd.getNumPartitions() == 1
        whole += [tuple(r) for r in read.collect()]
    cut_files(size)
    got = source.read_csv(spark, str(tmp_path), RAW_REVIEW, "n", check_header=True).orderBy("n").collect()
    assert [(r.rating, r.date, r.content) for r in got] == whole
    assert [r.n for r in got] == list(range(len(whole)))


def test_one_file_is_read_in_many_tasks(spark, tmp_path, cut_files):
    file = tmp_path / "reviews_kakaomap.csv"
    file.write_text("rating,date,content\n" + "".join(f'{i % 5},2024.05.03,"row {i}\nsecond ""line"", {"x" * (i % 90)}"\n' for i in range(1000)))
    cut_files(str(file.stat().st_size // 50 + 1))
    assert spark.read.text(str(file)).rdd.getNumPartitions() == 50
    got = source.read_raw_csv(spark, str(file)).orderBy("ingest_seq").collect()
    assert [r.content for r in got] == [f'row {i}\nsecond "line", {"x" * (i % 90)}' for i in range(1000)]
    assert [r.ingest_seq for r in got] == list(range(1000)) and {r.site for r in got} == {"kakaomap"}


def test_segments_are_never_broadcast_to_the_task_of_their_ranges(spark, tmp_path, monkeypatch):
    """Rows of a few numbers look small; broadcast on that, all of them would be sorted by the one task of the ranges."""
    from reviewloom.schemas import SUBJECT
    from reviewloom.sources import records

    def planned(df):
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")

    plans, write = [], records.stored
    monkeypatch.setattr(records, "stored", lambda df, purpose: (plans.append(planned(df)), write(df, purpose))[1])
    for k in range(3):
        (tmp_path / f"list{k}.json").write_text("[" + ",\n".join(f'{{"name": "n{k * 5 + i} }} x"}}' for i in range(5)) + "]")
    read = records.read_json_lists(spark, str(tmp_path), SUBJECT, "pos")
    plans.append(planned(read))
    assert [r.name for r in read.orderBy("pos").collect()] == [f"n{i} }} x" for i in range(15)]
    assert sum(plan.count("SortMergeJoin") for plan in plans) >= 3 and not any("BuildLeft" in plan for plan in plans)


def test_a_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "reviews_kakaomap.csv").write_text("date,rating,content\n2024,5,x\n")
    with pytest.raises(PySparkException, match="header of a CSV file"):
        source.read_raw_csv(spark, str(tmp_path / "*.csv")).collect()


@pytest.mark.parametrize("size", ["128m", "200", "37"])
def test_lists_cut_in_ranges_are_those_of_the_whole_file(spark, tmp_path, cut_files, size):
    """Braces, brackets, quotes and backslashes inside texts lie across cuts."""
    from reviewloom.schemas import SUBJECT
    draw = random.Random(2)

    def subject(i):
        return {"name": f'n{i}\\"}}{{ [{{ \\\\' * draw.randint(0, 3), "category": "c}", "ticket_info": {"a}{": {"b": ["x", "]}"]}}, "visitor_tips": ["t}", '\\"{']}
    for n, indent in enumerate((None, 1, None)):
        (tmp_path / f"{n}.json").write_text(json.dumps([subject(i) for i in range(120)], indent=indent, ensure_ascii=n == 0))
    (tmp_path / "3.json").write_text(json.dumps(subject(0)))
    (tmp_path / "4.json").write_text("[]")
    (tmp_path / "5.json").write_text("\n [ ]\n")
    (tmp_path / "6.json").write_bytes(b"\xef\xbb\xbf\n[" + json.dumps({"name": "last"}).encode() + b"]")

    def rows(frame):
        return [(r.name, r.category, json.loads(r.ticket_info) if r.ticket_info else None, r.visitor_tips) for r in frame]
    whole = []
    for file in sorted(tmp_path.iterdir()):
        whole += rows(spark.read.schema(SUBJECT).option("multiLine", True).json(str(file)).collect())
    cut_files(size)
    got = tables.read_subjects(spark, str(tmp_path)).orderBy("pos").collect()
    assert rows(got) == whole and [r.pos for r in got] == list(range(len(whole)))


def test_a_list_that_breaks_off_keeps_what_it_has(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "A"}, {"name": "B", "category":')
    got = tables.read_subjects(spark, str(tmp_path)).orderBy("pos").collect()
    assert len(got) == 2 and got[0].name == "A"


def index_rows(spark, names):
    meta = ("kakaomap", "s", "p", "2024-05-03", 5.0, "")
    return spark.createDataFrame([(n, name, meta, [1.0, 0.0]) for n, name in enumerate(names)], INDEX)


def test_segments_are_added_once_and_in_turn(spark, tmp_path):
    path = str(tmp_path / "index")
    tables.write_index(index_rows(spark, ["a", "b"]), path)
    for key, names in (("x", ["c"]), ("x", ["c"]), ("y", ["d", "e"]), ("x", ["c"]), ("empty", [])):
        segments.add_segment(index_rows(spark, names), path, key)
    got = tables.load_index(spark, path, lambda: None).orderBy("vec_id").collect()
    assert [(r.vec_id, r.content) for r in got] == list(enumerate("abcde"))
    tables.append_index(path, index_rows(spark, []), index_rows(spark, ["f"]), key="x")  # a key that is done
    assert tables.load_index(spark, path, lambda: None).count() == 5


def test_a_segment_that_broke_off_is_written_in_its_place(spark, tmp_path):
    path = str(tmp_path / "index")
    tables.write_index(index_rows(spark, ["a", "b"]), path)
    segments.add_segment(index_rows(spark, ["c"]), path, "x")
    (tmp_path / "index" / "_log" / "1.done").unlink()  # as if the writer had died before the end
    assert tables.load_index(spark, path, lambda: None).count() == 2
    assert segments.add_segment(index_rows(spark, ["d"]), path, "y").start == 3
    with pytest.raises(ValueError, match="was claimed for 1 rows"):
        segments.add_segment(index_rows(spark, ["c", "c"]), path, "x")
    segments.add_segment(index_rows(spark, ["c"]), path, "x")
    got = tables.load_index(spark, path, lambda: None).orderBy("vec_id").collect()
    assert [(r.vec_id, r.content) for r in got] == list(enumerate("abcd"))


def test_writers_at_the_same_time_get_ids_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    path = str(tmp_path / "index")
    tables.write_index(index_rows(spark, ["a"]), path)
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: segments.add_segment(index_rows(spark, [f"{k}"] * (k + 1)), path, f"k{k}"), range(6)))
    got = tables.load_index(spark, path, lambda: None).collect()
    assert sorted(r.vec_id for r in got) == list(range(1 + 21))
