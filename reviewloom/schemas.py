"""Table schemas used at the boundaries."""

from pyspark.sql import types as T

RAW_REVIEW = T.StructType([
    T.StructField("rating", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("content", T.StringType()),
])

CLEAN_REVIEW = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("ingest_seq", T.LongType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("content", T.StringType()),
    T.StructField("review_length", T.IntegerType()),
    T.StructField("tokenized_content", T.ArrayType(T.StringType())),
    T.StructField("weekday", T.StringType()),
    T.StructField("text_length", T.IntegerType()),
])

INDEX_META = T.StructType([
    T.StructField("platform", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("place", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("url", T.StringType()),
])

INDEX = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("content", T.StringType()),
    T.StructField("meta", INDEX_META),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

MESSAGES = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

USERS = T.StructType([
    T.StructField("email", T.StringType()),
    T.StructField("password", T.StringType()),
    T.StructField("username", T.StringType()),
])

CHANGES = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("password", T.StringType()),
    T.StructField("username", T.StringType()),
])

# The four nested sections have free keys and mixed leaves. They stay JSON text
# here and are opened by the subject operators.
SUBJECT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("transportation", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("opening_date", T.StringType()),
    T.StructField("opening_hours", T.StringType()),
    T.StructField("closed_days", T.StringType()),
    T.StructField("ticket_info", T.StringType()),
    T.StructField("attractions", T.StringType()),
    T.StructField("facilities", T.StringType()),
    T.StructField("visitor_tips", T.ArrayType(T.StringType())),
    T.StructField("official_website", T.StringType()),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
