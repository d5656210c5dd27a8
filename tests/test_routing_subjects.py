import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from reviewloom.fixed_values import CATEGORY_WORDS, NAME_ENDINGS, NAME_STOPWORDS, PROMPT_INTENT
from reviewloom.operators import routing, subjects
from reviewloom.schemas import SUBJECT


def routed(spark, texts, replies=None):
    rows = [(i, t, replies[i] if replies else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, text string, model_reply string")
    got = routing.route(df, reply_col="model_reply" if replies else None).orderBy("i").collect()
    return [r.routing_decision for r in got]


def test_words(spark):
    assert routed(spark, ["", "  ", None, "후기 궁금", "티켓 가격", "티켓 후기", "안녕"]) == [
        "chat", "chat", "chat", "rag_review", "subject_info", "rag_review", "chat"]


def test_model_replies(spark):
    replies = ['{"intent":"subject_info"}', "{}", "not json", '{"intent":"other"}', "[1]", '"text"', None, '{"intent":"chat"}']
    texts = ["안녕"] * 2 + ["후기"] * 5 + [""]
    assert routed(spark, texts, replies) == [
        "subject_info", "chat", "rag_review", "other", "rag_review", "rag_review", "rag_review", "chat"]


def test_intent_prompt(spark):
    df = spark.createDataFrame([(" hi {x} ",), ("",)], "text string")
    got = [r.prompt for r in routing.intent_prompts(df).collect()]
    assert got == [PROMPT_INTENT.replace("{user_message}", "hi {x}")]
    assert routing.chat_prompts(df).count() == 1


def test_words_with_special_characters(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), ("q\\Eq",)], "text string")
    got = routing.route(df, review_words=("A.B",), info_words=("\\E",)).collect()
    assert [r.routing_decision for r in got] == ["rag_review", "chat", "subject_info"]


# --- names ------------------------------------------------------------------
QUESTIONS = ["롯데월드에 대해 알려줘", "롯데월드는 정보", "월드 정보 알려줘", "  에 대해", "에 대해", "정보 롯데 알려줘 월드", "대해 정보",
             "", "이것이 무엇", "first line\n둘째 줄에 대해", "a\n는 b는 c", "hello world", " spaced   words ", "이", "x y에 대해"]


def by_search(text):
    for ending in NAME_ENDINGS:
        match = re.search("(.+?)" + ending, text)
        if match:
            return match.group(1).strip()
    left = [w for w in text.split() if not any(s in w for s in NAME_STOPWORDS)]
    return " ".join(left) if left else text


def test_names_in_questions(spark):
    rnd = random.Random(4)
    pieces = ["롯데", " ", "\n", "에 대해", " 정보", "는", "이", "줘", "a", "에 대한", " 알려", "\r"]
    texts = QUESTIONS + ["".join(rnd.choices(pieces, k=rnd.randint(0, 8))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(subjects.extract_name(F.col("t"))).collect()]
    assert got == [by_search(t) for t in texts]


# --- finding ----------------------------------------------------------------
def subject_table(spark, names, categories=None):
    rows = [(n, (categories or ["x"] * len(names))[i]) for i, n in enumerate(names)]
    df = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(rows)], "name string, category string, pos long")
    for f in SUBJECT.fields[2:]:
        df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def first_by_name(names, typed):
    for i, name in enumerate(names):
        if typed.lower() in name.lower() or name.lower() in typed.lower():
            return i
    return None


def first_mentioned(names, text):
    for name in names:
        if name.lower() in text.lower() or any(w in text.lower() for w in name.lower().split()):
            return first_by_name(names, name)
    return None


NAMES = ["Lotte World", "Lotte World Tower", "World", "남산 타워", "경복궁", "A b", "abc"]
TYPED = ["lotte world", "WORLD", "tower", "남산", "남산 타워 전망대", "nothing here", "", "abc lotte", "궁", "a"]


@pytest.mark.parametrize("gram", [2, 3, 5])
def test_lookup_equals_loop(spark, monkeypatch, gram):
    monkeypatch.setattr(subjects, "GRAM", gram)
    df = spark.createDataFrame(list(enumerate(TYPED)), "query_id int, name string")
    got = {r.query_id: r.pos for r in subjects.find_by_name(df, subject_table(spark, NAMES)).collect()}
    assert got == {i: first_by_name(NAMES, t) for i, t in enumerate(TYPED)}


@pytest.mark.parametrize("gram", [2, 3, 5])
def test_mentions_equal_loop(spark, monkeypatch, gram):
    monkeypatch.setattr(subjects, "GRAM", gram)
    rnd = random.Random(2)
    words = ["lotte", "World", "tower", "남산", "타워", "경복궁", "b", "zzz", " ", "abc"]
    texts = ["".join(rnd.choices(words, k=rnd.randint(0, 4))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id int, text string")
    got = {r.msg_id: r.pos for r in subjects.find_mentioned(df, subject_table(spark, NAMES)).collect()}
    assert got == {i: p for i, t in enumerate(texts) if (p := first_mentioned(NAMES, t)) is not None}


@pytest.mark.parametrize("more", [0, 1000])
def test_null_empty_and_repeated_rows_for_any_size_of_dictionary(spark, more):
    """Rows are judged one by one; a longer dictionary of other words changes nothing."""
    rows = [(1, None), (2, "abc"), (2, "zz"), (3, ""), (2, "abc"), (4, "xxabyy")]
    words = [("", 5), ("abc", 1), ("xab", 7), ("y", 3), *((f"other {n}", 100 + n) for n in range(more))]
    got = subjects.with_first_contained(spark.createDataFrame(rows, "id int, t string"), "t",
                                        spark.createDataFrame(words, "word string, pos long"), "found")
    assert sorted(((r.id, r.t, r.found) for r in got.collect()), key=repr) == sorted(
        [(1, None, None), (2, "abc", 1), (2, "zz", 5), (3, "", 5), (2, "abc", 1), (4, "xxabyy", 3)], key=repr)


def test_categories_and_outcomes(spark):
    table = subject_table(spark, ["Ritz", "남산"], ["호텔", "관광지"])
    texts = ["남산 어때", "호텔 추천", "맛집 추천", "안녕", "호텔 놀이공원", None]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id int, text string")
    got = {r.msg_id: (r.detected_category, r.found_subject_name, r.info_type, r.data_source)
           for r in subjects.resolve_messages(df, table).collect()}
    known, unknown = ("subject_information", "json_database"), ("general_information", "llm_general")
    assert got == {0: ("관광지", "남산", *known), 1: ("호텔", "Ritz", *known), 2: ("레스토랑", None, *unknown),
                   3: ("general", None, *unknown), 4: ("테마파크", None, *unknown), 5: ("general", None, *unknown)}
    prompts = subjects.subject_prompts(subjects.resolve_messages(df, table), table).orderBy("msg_id").collect()
    assert "다음은 '남산'에 대한 정보입니다:\n\n## 📍 남산\n**카테고리**: 관광지\n\n사용자 질문: 남산 어때" in prompts[0].prompt
    assert "'안녕'에 대한 정보를 요청받았지만" in prompts[3].prompt
    assert {r.category: r.n for r in subjects.category_counts(table).collect()} == {"호텔": 1, "관광지": 1}
    assert [c for c, _ in CATEGORY_WORDS][0] == "테마파크"


def test_a_list_of_subjects_is_never_broadcast(spark, tmp_path):
    """Its files say little of its size in memory: rows of long lists would all lie in the driver."""
    subject_table(spark, ["Ritz", "남산"], ["호텔", "관광지"]).write.parquet(f"{tmp_path}/subjects")
    table = spark.read.parquet(f"{tmp_path}/subjects")
    df = spark.createDataFrame([(0, "남산 어때"), (1, "안녕"), (2, None)], "msg_id int, text string")
    prompts = subjects.subject_prompts(subjects.resolve_messages(df, table), table)
    plan = prompts._jdf.queryExecution().sparkPlan().toString()
    assert "Join [__subject" in plan and "BroadcastHashJoin [__subject" not in plan
    got = {r.msg_id: (r.found_subject_name, "## 📍" in r.prompt) for r in prompts.collect()}
    assert got == {0: ("남산", True), 1: (None, False), 2: (None, False)}


def test_runs_are_dealt_out_before_a_broadcast_is_chosen(spark, tmp_path):
    """Texts take little room, their runs of three letters a hundred times as much."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcdefghij", k=300)) + f" word{n}x" for n in range(50)]
    words = [(f"word{n}x" + "z" * (n % 40), n) for n in range(3000)]
    spark.createDataFrame([(t,) for t in texts], "t string").write.parquet(f"{tmp_path}/texts")
    spark.createDataFrame(words, "word string, pos long").write.parquet(f"{tmp_path}/words")
    found = subjects.with_first_contained(spark.read.parquet(f"{tmp_path}/texts"), "t",
                                          spark.read.parquet(f"{tmp_path}/words"), "found")
    assert {r.t: r.found for r in found.collect()} == {
        t: min((n for w, n in words if w in t), default=None) for t in texts}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    sent = re.findall(r"BroadcastExchange(.*?)(?:Exchange|QueryStage|\Z)", plan, re.S)
    assert not any("Generate explode" in below for below in sent)


def test_runs_of_a_long_text(spark):
    """In time by its length, not by the square of it; letters beyond 16 bits are one letter."""
    long = spark.range(40_000, 40_001).select(F.concat(F.expr("repeat('한글 문장 ', int(id))"), F.lit("a😀b")).alias("t"))
    began = time.monotonic()
    runs = long.select(subjects._runs(F.col("t"), 3).alias("r")).first().r
    assert time.monotonic() - began < 20
    assert runs == ["한글 ", "글 문", " 문장", "문장 ", "장 한", " 한글", "장 a", " a😀", "a😀b"]


# --- nested records ---------------------------------------------------------
RECORD = {
    "name": "Harbour Park", "category": "park", "location": "Pier 1",
    "transportation": {"parking": "north lot", "subway": "line 2"}, "opening_date": "1999-01-02",
    "ticket_info": {"day": {"teen": "54,000원", "adult": "61,000원", "senior": "x"}, "note": "book {early}", "night": {"child": "free"}},
    "attractions": {"indoor": {"b1": ["cave"], "f1": ["swing", "carousel"], "odd": "text"}, "outdoor": ["tower"], "closed": "soon"},
    "facilities": {"inside": ["locker", "ice"], "other": "none"}, "visitor_tips": ["come early", "bring water"],
}


def record_table(spark, *records):
    schema_rows = []
    for r in records:
        row = []
        for f in SUBJECT.fields:
            value = r.get(f.name)
            row.append(json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else value)
        schema_rows.append(tuple(row))
    return spark.createDataFrame(schema_rows, SUBJECT).withColumn("pos", F.monotonically_increasing_id())


def test_flat_tables(spark):
    table = record_table(spark, RECORD)
    tickets = {(r.ticket, r.age_group, r.price_text, r.price_krw) for r in subjects.ticket_prices(table).collect()}
    assert tickets == {("day", "teen", "54,000원", 54000), ("day", "adult", "61,000원", 61000), ("day", "senior", "x", None),
                       ("note", None, "book {early}", None), ("night", "child", "free", None)}
    places = {(r.area, r.sub_area, r.item_no, r.attraction) for r in subjects.attractions(table).collect()}
    assert places == {("indoor", "b1", 0, "cave"), ("indoor", "f1", 0, "swing"), ("indoor", "f1", 1, "carousel"), ("outdoor", None, 0, "tower")}
    assert {(r.facility_type, r.facility) for r in subjects.facilities(table).collect()} == {("inside", "locker"), ("inside", "ice")}
    assert [r.tip for r in subjects.visitor_tips(table).orderBy("item_no").collect()] == RECORD["visitor_tips"]


def test_markdown_of_a_full_and_a_bare_record(spark):
    bare = {"name": "Bare", "category": "c", "attractions": {}, "facilities": {}, "visitor_tips": [], "ticket_info": {}, "transportation": {}}
    got = {r.name: r.m for r in record_table(spark, RECORD, bare).select("name", subjects.markdown().alias("m")).collect()}
    assert got["Harbour Park"] == "\n".join([
        "## 📍 Harbour Park", "**카테고리**: park", "**위치**: Pier 1", "\n**교통편**", "🚇 **지하철**: line 2", "🅿️ **주차**: north lot",
        "\n**개장일**: 1999-01-02", "\n**티켓 정보**", "  🎫 **day**: 청소년: 54,000원, 성인: 61,000원", "  💰 **note**: book {early}",
        "  🎫 **night**: 어린이: free", "\n**주요 어트랙션**", "\n🎢 **indoor**", "  • **b1**: cave", "  • **f1**: swing, carousel",
        "\n🎢 **outdoor**", "  • tower", "\n🎢 **closed**", "\n**시설 안내**", "  🏢 **inside**: locker, ice", "\n**방문 팁**",
        "  💡 come early", "  💡 bring water"])
    assert got["Bare"] == "## 📍 Bare\n**카테고리**: c\n\n**교통편**\n\n**티켓 정보**"
