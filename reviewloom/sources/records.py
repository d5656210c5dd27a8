"""Records of large files, cut in many tasks: CSV with line feeds inside quotes, and JSON lists.

Spark's text reader cuts a file into byte ranges and a range into segments, at line feeds
or at closing braces. Whether a segment begins inside a quoted text depends on all that
stands before it, so each segment, and then each range, is first described for
both cases: the state it leads to and, for JSON, the change of bracket depth. A running
combination over one row per range tells where each range really begins; then
records are cut inside ranges. Only records that reach over the end of a range are put
together in a second step, a few pieces per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.window import WindowSpec

from reviewloom.session import stored
from reviewloom.sources.arrival import numbered, with_places

_RANGE = ["__file", "__block"]


def _earlier(upto: int = -1) -> WindowSpec:
    """A segment's range up to the one before it."""
    return Window.partitionBy(*_RANGE).orderBy("__row").rowsBetween(Window.unboundedPreceding, upto)


def _ranges_before(upto: int = -1) -> WindowSpec:
    return Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, upto)


def _segments(spark: SparkSession, path: str, separator: str, options: dict) -> DataFrame:
    return with_places(spark.read.options(**options).option("lineSep", separator).text(path))


def _switch(start: Column, change: Column) -> Column:
    return start != (change % 2 == 1)


def _with_states(df: DataFrame, earlier: WindowSpec, starts: dict[str, Column]) -> DataFrame:
    """Add, for each name, the state before each row if the first row's is as given.

    ``__out`` and ``__in`` are the states a row leads to from outside and from inside: it keeps the state, switches
    it or sets it. What counts is the last row that set it, and the switches since.
    """
    switch = (F.col("__out") & ~F.col("__in")).cast("int")
    counted = df.withColumn("__seen", F.coalesce(F.sum(switch).over(earlier), F.lit(0)))
    set_here = F.when(F.col("__out") == F.col("__in"), F.struct(F.col("__out").alias("state"), F.col("__seen").alias("seen")))
    known = counted.withColumn("__set", F.last(set_here, ignorenulls=True).over(earlier))
    return known.withColumns({name: F.coalesce(_switch(F.col("__set.state"), F.col("__seen") - F.col("__set.seen")),
                                               _switch(start, F.col("__seen"))) for name, start in starts.items()}).drop("__seen", "__set")


def _led_to(state: Column) -> Column:
    return F.when(state, F.col("__in")).otherwise(F.col("__out"))


def _known(segments: DataFrame, first: Column, depth: bool = False) -> DataFrame:
    """Segments with the true state before them (``__inside``), what ``first`` says of the file's first segment
    (``__kind``) and, with ``depth``, the depth of brackets after them."""
    both = stored(_with_states(segments, _earlier(), {"__if_out": F.lit(False), "__if_in": F.lit(True)}), "segments")

    def deeper(state: str) -> Column:
        return F.when(F.col(state), F.col("__deep_in")).otherwise(F.col("__deep_out"))

    ranges = both.groupBy(*_RANGE).agg(
        F.max_by(_led_to(F.col("__if_out")), "__row").alias("__out"), F.max_by(_led_to(F.col("__if_in")), "__row").alias("__in"),
        F.min_by(first, "__row").alias("__kind"),
        *([F.sum(deeper("__if_out")).alias("__sum_out"), F.sum(deeper("__if_in")).alias("__sum_in")] if depth else []))
    begun = _with_states(ranges, _ranges_before(), {"__begins": F.lit(False)}).withColumn(
        "__kind", F.first("__kind").over(_ranges_before(0)))
    if depth:
        begun = begun.withColumn("__level", F.coalesce(F.sum(
            F.when(F.col("__begins"), F.col("__sum_in")).otherwise(F.col("__sum_out"))).over(_ranges_before()), F.lit(0)))
    # merged: rows of a few numbers look small enough to broadcast, and would then all meet in the one task of the ranges
    known = both.hint("merge").join(begun.select(*_RANGE, "__begins", "__kind", *(["__level"] if depth else [])), _RANGE).withColumn(
        "__inside", F.when(F.col("__begins"), F.col("__if_in")).otherwise(F.col("__if_out")))
    if depth:
        known = known.withColumn("__depth", F.col("__level") + F.sum(deeper("__inside")).over(_earlier(0)))
    return known


def _joined(segments: DataFrame, separator: str) -> DataFrame:
    """One row per record: ``__file``, ``__block`` and ``__row`` tell its place, ``record`` its text.

    ``__ends`` marks the segments with which a record ends.
    """
    placed = segments.withColumn("__part", F.coalesce(F.sum(F.col("__ends").cast("int")).over(_earlier()), F.lit(0)))
    in_order = F.array_sort(F.collect_list(F.struct("__row", "value")))
    parts = stored(placed.groupBy(*_RANGE, "__part").agg(
        F.array_join(F.transform(in_order, lambda s: s["value"]), separator).alias("record"), F.max("__ends").alias("__ends")), "parts")
    # a range's last part may go on in the ranges after it, up to the first part that ends there
    ranges = parts.groupBy(*_RANGE).agg(F.sum(F.col("__ends").cast("int")).alias("__n"))
    began = ranges.withColumns({
        "__from": F.coalesce(F.last(F.when(F.col("__n") > 0, F.struct("__block", "__n")), ignorenulls=True).over(_ranges_before()),
                             F.first(F.struct("__block", F.lit(0).cast("long").alias("__n"))).over(_ranges_before()))})
    met = parts.hint("merge").join(began, _RANGE)
    reaching = (F.col("__part") == 0) & F.col("__from").isNotNull() | ~F.col("__ends")
    own = met.where(~reaching).select(*_RANGE, F.col("__part").alias("__row"), "record", "__ends")
    begin = F.when((F.col("__part") == 0) & F.col("__from").isNotNull(), F.col("__from")).otherwise(
        F.struct("__block", F.col("__part").alias("__n")))
    pieces = met.where(reaching).withColumn("__begin", begin)
    in_order = F.array_sort(F.collect_list(F.struct("__block", "record")))
    over = pieces.groupBy("__file", "__begin").agg(
        F.array_join(F.transform(in_order, lambda s: s["record"]), separator).alias("record"), F.max("__ends").alias("__ends"))
    return own.unionByName(over.select("__file", F.col("__begin.__block").alias("__block"), F.col("__begin.__n").alias("__row"),
                                       "record", "__ends"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, name: str, check_header: bool = False, **options) -> DataFrame:
    """Rows of CSV files with a header, with ``__file`` and their number ``name`` by file and place.

    Quotes are doubled inside quoted fields, which may hold line feeds; a quote inside an unquoted field is text.
    Empty lines are skipped. Lines end as the first one of the file does, with a line feed alone or after a carriage
    return. With ``check_header`` a file whose header differs from the schema is an error.
    """
    # doubled quotes lead nowhere; of the others, one opens a field where a field begins, and closes it elsewhere
    pieces = F.split(F.regexp_replace("value", '""', ""), '"')

    def after(start: bool) -> Column:
        quotes = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x, i: (
            ((i == 0) & (x == "")) | x.endswith(",")))
        return F.aggregate(quotes, F.lit(start), lambda inside, opens: ~inside & opens)

    quoted = F.instr("value", '"') > 0
    lines = _segments(spark, path, "\n", options).withColumns({
        "__out": F.when(quoted, after(False)).otherwise(F.lit(False)), "__in": F.when(quoted, after(True)).otherwise(F.lit(True))})
    known = _known(lines, F.col("value").endswith("\r")).withColumn(
        "value", F.when(F.col("__kind"), F.regexp_replace("value", r"\r\z", "")).otherwise(F.col("value")))
    filled = known.where(F.col("__inside") | (F.col("value") != "")).withColumn("__ends", ~_led_to(F.col("__inside")))
    rows = numbered(_joined(filled, "\n").drop("__ends"), name, skip=1, keep=["__file", "__skipped"], settled=True)
    header = ",".join(schema.fieldNames())
    if check_header:
        said = F.lower(F.regexp_replace("record", r'["\x{FEFF}]', ""))
        same = F.when(said == header.lower(), False).otherwise(F.raise_error(F.concat(
            F.lit(f"the header of a CSV file is not {header}: "), "__file")).cast("boolean"))
        rows = rows.where(F.when(F.col("__skipped"), same).otherwise(True))
    else:
        rows = rows.where(~F.col("__skipped"))
    fields = F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "),
                        {"quote": '"', "escape": '"', "multiLine": "true"})
    return rows.withColumn("__fields", fields).select("__file", name, "__fields.*")


def read_json_lists(spark: SparkSession, path: str, schema: T.StructType, name: str, **options) -> DataFrame:
    """Objects of JSON files, each a list of them or one, with their number ``name`` by file and place.

    What cannot be parsed is NULL. A nested value that the schema reads as text is JSON without spaces.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # an escaped character opens and closes nothing

    def deeper(text: Column, inside: Column) -> Column:
        outside = F.regexp_replace(text, r'"[^"]*(?:"|\z)', "")
        level = (F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", "")))
        return (level - F.when(inside, 0).otherwise(1)).cast("long")  # the brace that ends the segment

    odd = (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))) % 2 == 1
    rest = F.when(F.instr(bare, '"') > 0, F.regexp_replace(bare, r'\A[^"]*"', "")).otherwise("")
    braces = _segments(spark, path, "}", options).withColumns({"__out": odd, "__in": ~odd}).withColumns({
        "__deep_out": deeper(bare, F.col("__out")), "__deep_in": deeper(rest, F.col("__in"))})
    known = _known(braces, F.col("value").rlike(r"\A[\x{FEFF}\s]*\["), depth=True)
    outer = F.col("__kind").cast("int")
    records = _joined(known.withColumn("__ends", ~_led_to(F.col("__inside")) & (F.col("__depth") == outer)), "}")
    text = F.regexp_replace("record", r"\A[\s,\[\]\x{FEFF}]+", "")
    whole = records.withColumn("record", F.when(F.col("__ends"), F.concat(text, F.lit("}"))).otherwise(text)).where("record <> ''")
    fields = F.from_json("record", schema)
    return numbered(whole.drop("__ends"), name, keep=["__file"], settled=True).withColumn("__fields", fields).select("__file", name, "__fields.*")
