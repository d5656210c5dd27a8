"""Tables in the shape this library works on, derived from the given tables.

There is no review table, so reviews are the lines of ``documents``; users and
their changes come from ``customer`` and ``orders``, subjects from ``part``.
Each definition has an equal one in SQL in ``oracle_parts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewloom.fixed_values import DATE_LABEL, DEFAULT_PLACE, NAME_ENDINGS, SITES
from reviewloom.functions.labels import or_default
from reviewloom.operators.cleaning import clean_reviews
from reviewloom.session import shared_folder
from reviewloom.sources.reviews import read_clean, write_clean
from reviewloom.sources.tables import spread, table

AS_OF = "2025-01-01 00:00:00"


def pair_id(major: str, minor: str) -> Column:
    """One number for a pair, the second part below 2**32."""
    return F.shiftleft(F.col(major), 32) + F.col(minor)


def lines(documents: DataFrame) -> DataFrame:
    """One row per line of a document, with the review columns."""
    numbered = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "content"))
    numbered = numbered.withColumn("line_no", (F.col("at") + 1).cast("long"))
    days = ((F.col("doc_id") * 37 + F.col("line_no")) % 1600).cast("int")
    return numbered.select(
        "doc_id", "line_no",
        F.element_at(F.array(*[F.lit(s) for s in SITES]), (F.col("doc_id") % 3 + 1).cast("int")).alias("site"),
        pair_id("doc_id", "line_no").alias("ingest_seq"),
        F.when(F.col("doc_id") % 11 != 0, ((F.col("doc_id") + F.col("line_no")) % 7).cast("double")).alias("rating"),
        F.date_add(F.lit("2021-06-01").cast("date"), days).cast("timestamp").alias("date"),
        "content")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id"))


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return clean_reviews(reviews(spark, folder), AS_OF)


def stored_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned table written to the shared folder, as the cleaning job leaves it."""
    path = shared_folder(spark, "clean")
    write_clean(cleaned(spark, folder), path)
    return read_clean(spark, path)


# --- retrieval --------------------------------------------------------------
def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id")


def vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored vector as a query of its own."""
    return vectors(spark, folder).withColumnRenamed("vec_id", "query_id")


def label_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of each label."""
    parts = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "x")))
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(ordered, lambda p: p["x"]).alias("embedding"))


def index_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Document texts with metadata, numbered like the vectors."""
    docs = table(spark, folder, "documents")
    meta = F.struct(
        F.when(F.col("doc_id") % 4 != 0, F.element_at(F.array(*[F.lit(s) for s in SITES]),
                                                     (F.col("doc_id") % 3 + 1).cast("int"))).alias("platform"),
        F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("subject"),
        F.lit(DEFAULT_PLACE).alias("place"),
        F.when(F.col("doc_id") % 6 != 0, F.col("source")).alias("date"),
        F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 5 + 1).cast("double")).alias("rating"),
        F.lit("").alias("url"))
    return docs.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), meta.alias("meta"))


# --- conversations ----------------------------------------------------------
def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")


def user_messages(spark: SparkSession, folder: str) -> DataFrame:
    """User texts with a message key and a request in the language of the word lists."""
    asked = F.element_at(
        F.array(*[F.lit(x) for x in ("후기 알려줘", "가격 정보", "호텔 위치", "맛집 추천", "안녕")]),
        ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return messages(spark, folder).filter("role = 'user'").select(
        F.concat_ws(":", "conv_id", "turn").alias("msg_id"), "conv_id", "turn",
        F.concat_ws(" ", "text", asked).alias("text"))


def requests_first(spark: SparkSession, folder: str) -> DataFrame:
    """The whole text of every message, whoever wrote it, after a request."""
    asked = F.element_at(F.array(*[F.lit(x) for x in ("호텔", "맛집 추천", "관광지", "가격", "안녕")]),
                         ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return table(spark, folder, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("msg_id"), F.concat_ws(" ", asked, "text").alias("text"))


def numbered_messages(spark: SparkSession, folder: str) -> DataFrame:
    return user_messages(spark, folder).select(pair_id("conv_id", "turn").alias("msg_id"), "text")


def model_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Events as classifier replies: JSON with and without an intent, other JSON, no JSON."""
    kind = F.col("event_type")
    reply = (F.when(kind == "view", '{"intent":"subject_info"}').when(kind == "purchase", '{"intent": "rag_review"}')
             .when(kind == "click", F.col("props")).when(kind == "signup", F.concat(F.lit("["), "props", F.lit("]")))
             .otherwise(F.concat(F.lit("intent="), "props")))
    text = F.element_at(F.array(*[F.lit(x) for x in ("티켓 얼마", "리뷰 요약", "안녕하세요", "  ")]),
                        (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, folder, "events").select("event_id", text.alias("text"), reply.alias("model_reply"))


# --- subjects ---------------------------------------------------------------
def subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as subject records with nested sections of mixed shape."""
    part = table(spark, folder, "part")
    size = F.col("p_size")
    won = F.format_string("%,d원", size * 1000)
    category = (F.when(F.col("p_type") == "SMALL", "호텔").when(F.col("p_type") == "PROMO", "레스토랑")
                .when(F.col("p_type") == "LARGE", "관광지").otherwise(F.col("p_type")))
    day_ticket = F.struct(won.alias("adult"), won.alias("teen"), F.col("p_brand").alias("senior"))
    tickets = F.when(size % 2 == 0, F.to_json(F.struct(
        day_ticket.alias("1일권"), F.col("p_type").alias("discount")))).when(
        size % 3 == 0, F.to_json(F.struct(F.struct(won.alias("child")).alias("after4"))))
    areas = F.when(size % 4 == 0, F.to_json(F.struct(
        F.struct(F.array("p_name", "p_brand").alias("1층")).alias("실내"),
        F.array("p_type").alias("실외")))).when(size % 4 == 1, F.lit("{}"))
    places = F.when(size % 3 != 0, F.to_json(F.struct(
        F.array("p_brand", "p_type").alias("실내"), F.array("p_name").alias("연결"))))
    ways = F.when(size % 2 == 1, F.to_json(F.struct(
        F.col("p_brand").alias("subway"), F.when(size % 5 == 0, F.col("p_type")).alias("bus"))))
    return part.select(
        F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), category.alias("category"),
        F.when(size % 7 != 0, F.col("p_brand")).alias("location"), ways.alias("transportation"),
        F.when(size % 5 != 0, F.concat_ws(" ", "p_name", "p_type")).alias("description"),
        F.lit(None).cast("string").alias("opening_date"),
        F.when(size % 5 == 1, F.lit("10:00 ~ 21:00")).alias("opening_hours"),
        F.when(size % 6 == 1, F.lit("연중무휴")).alias("closed_days"),
        tickets.alias("ticket_info"), areas.alias("attractions"), places.alias("facilities"),
        F.when(size % 4 != 3, F.array("p_type", "p_brand")).alias("visitor_tips"),
        F.when(size % 9 != 0, F.concat(F.lit("https://example.com/"), F.col("p_partkey").cast("string")))
        .alias("official_website"))


def name_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Names as people type them: whole, one word of it, or with something added."""
    size = F.col("p_size") % 3
    typed = (F.when(size == 0, F.upper("p_name")).when(size == 1, F.split_part("p_name", F.lit(" "), F.lit(2)))
             .otherwise(F.concat_ws(" ", "p_name", "p_brand")))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("query_id"), typed.alias("name"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions on a part with each of the name endings, and without any."""
    endings = [*NAME_ENDINGS, "에 대해 설명", "는 정보", " 주세요", ""]
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("p_size") % len(endings) + 1).cast("int"))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("msg_id"), F.concat("p_name", ending).alias("text"))


# --- users ------------------------------------------------------------------
def _email(name):
    return F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.com"))


def customers_as_users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        _email(F.col("c_name")).alias("email"), F.concat(F.lit("pw"), "c_custkey").alias("password"),
        F.col("c_name").alias("username"), "c_acctbal")


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts that exist before any change: customers in credit."""
    return customers_as_users(spark, folder).filter("c_acctbal >= 0").drop("c_acctbal")


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as one change of its customer's account."""
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    op = F.element_at(F.array(*[F.lit(o) for o in ("register", "upsert", "update", "delete", "login")]), rank)
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    password = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("pw"), "o_custkey")).otherwise(
        F.concat(F.lit("new"), "o_orderstatus"))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"), op.alias("op"), _email(name).alias("email"),
        password.alias("password"), F.concat_ws("/", name, "o_orderstatus").alias("username"))


def requests(spark: SparkSession, folder: str, op: str) -> DataFrame:
    return changes(spark, folder).filter(F.col("op") == op)


# --- pages ------------------------------------------------------------------
def _escaped(c):
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def review_pages(spark: SparkSession, folder: str, site: str) -> DataFrame:
    """One saved page per document in a site's markup: an item per line."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    stars = F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 6).cast("int")).otherwise(F.lit(0))
    day = F.date_add(F.lit("2021-06-01").cast("date"), (F.col("doc_id") % 1600).cast("int"))
    body = lambda line: _escaped(line)
    if site == "kakaomap":
        star, off = '<span class="figure_star on">*</span>', '<span class="figure_star">*</span>'
        item = lambda line: F.concat(
            F.lit("<li><div>"), F.repeat(F.lit(star), stars), F.lit(off),
            F.when(F.col("doc_id") % 13 != 0, F.concat(
                F.lit('</div><span class="txt_date"> '), F.date_format(day, "yyyy.MM.dd."), F.lit(" </span>"))).otherwise("</div>"),
            F.lit('<p class="desc_review">'), body(line), F.lit("</p></li>"))
        wrap = ('<ul class="list_review">', "</ul><ul><li>menu</li></ul>")
    elif site == "myrealtrip":
        svg = '<svg><path fill="#51ABF3"></path></svg>'
        item = lambda line: F.concat(
            F.lit('<div class="offer-review__list--content"><div class="starRating starRating--m starRating--blue starRating--">'),
            F.repeat(F.lit(svg), stars), F.lit('<svg><path fill="#DDD"/></svg></div>'),
            F.lit('<div class="offer-review__list--purpose"><b>tour</b> | <i>'), F.date_format(day, "yyyy.MM.dd"), F.lit("</i></div>"),
            F.when(F.col("doc_id") % 2 == 0, '<div class="offer-review__list--wrapper">').otherwise('<div class="offer-review__list--photo-wrapper">'),
            F.lit('<div class="offer-review__list--message"><div class="with-more">first<br>'), body(line),
            F.lit("</div></div></div></div>"))
        wrap = ("<main>", "</main>")
    else:
        item = lambda line: F.concat(
            F.lit('<div class="TripReviewItemContainer-sc-1fopyhi-0 x review-item">'),
            F.when(F.col("doc_id") % 13 != 0, F.concat(F.lit('<b class="review_score">'), stars.cast("string"), F.lit("</b>"))).otherwise(""),
            F.lit('<p class="hover-pointer">'), body(line), F.lit('</p><span class="r c2 create-time">'),
            F.when(F.col("doc_id") % 2 == 0, F.date_format(day, f"'{DATE_LABEL}': yyyy년 M월 d일")).otherwise(F.date_format(day, "yyyy-MM-dd")),
            F.lit("</span></div>"))
        wrap = ('<div id="reviews">', "</div>")
    items = F.array_join(F.transform(F.split("text", "\n", -1), item), "")
    return docs.select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit(wrap[0]), items, F.lit(wrap[1])).alias("html"),
        (F.col("doc_id") % 4).alias("filter_index"))


def unknown_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as items of known and unknown sites."""
    site = F.when(F.col("doc_id") % 4 == 3, or_default(F.col("source"), "none")).otherwise(
        F.element_at(F.array(*[F.lit(s) for s in SITES]), (F.col("doc_id") % 3 + 1).cast("int")))
    return table(spark, folder, "documents").select("doc_id", site.alias("site"))
