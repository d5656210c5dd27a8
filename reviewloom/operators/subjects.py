"""Subject records: finding them from messages, flattening them, writing them out.

Containment tests ("the message holds this name") are equi-joins. A word of
``GRAM`` letters or more is looked up by one of its runs of ``GRAM`` letters, the
one that fewest words of the dictionary have; a text brings its distinct runs of
that length, one per position, and the few candidates are then verified. Shorter
words are looked up among the texts' runs of their length. There is one way for
every size of dictionary, and the answer depends on a row's text alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.fixed_values import (AGE_LABELS, CATEGORY_WORDS, NAME_ENDINGS, NAME_STOPWORDS, NO_CATEGORY,
                                     PROMPT_SUBJECT_FOUND, PROMPT_SUBJECT_MISSING, PROMPT_SUBJECT_SYSTEM)
from reviewloom.functions.text import contains_any, fill_template, quoted, split_words, trim_space

GRAM = 3
#: Bits, as a power of two, of the table that tells which runs no word of a dictionary is looked up by.
RUN_BITS = 16
TEXT_MAP = "map<string,string>"


# --- containment by equi-join -----------------------------------------------
def _runs(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` letters of a text, put together letter by letter: to cut one out by its place reads
    all that stands before it, which takes the square of a long text's length."""
    letters = runs = F.split(text, "")
    for later in range(1, size):
        runs = F.zip_with(runs, F.slice(letters, later + 1, F.length(text)), lambda run, letter: F.concat(run, letter))
    return F.when(F.length(text) >= size, F.array_distinct(F.slice(runs, 1, F.length(text) - size + 1))).otherwise(
        F.array().cast("array<string>"))


def _short_runs(text: Column) -> Column:
    return F.flatten(F.array(*[_runs(text, size) for size in range(1, GRAM)]))


def _keyed(df: DataFrame, column: str) -> DataFrame:
    """Add a key of 128 bits that stands for a text where whole texts need not travel."""
    return df.withColumns({"key": F.xxhash64(column), "again": F.xxhash64(column, F.lit(1))})


def _place(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(1 << RUN_BITS))


def _looked_up(keys: DataFrame) -> Callable[[Column], Column]:
    """A test that every run among the ``keys`` passes, and of other runs as few as a table of fixed size can tell.

    The table is a subquery, so it is made when a query runs and not when its plan is built.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(_place(F.col("run")), F.lit(64)).cast("int"))
    rows = keys.groupBy(F.floor(_place(F.col("run")) / 64).cast("int").alias("__at")).agg(F.bit_or(bit).alias("__bits"))
    held = rows.repartition(1).agg(F.map_from_entries(F.collect_list(F.struct("__at", "__bits"))).alias("held"))
    every = F.sequence(F.lit(0), F.lit((1 << RUN_BITS - 6) - 1))
    table = held.select(F.transform(every, lambda at: F.coalesce(F.try_element_at("held", at), F.lit(0).cast("long")))).scalar()
    return lambda run: F.getbit(F.get(table, F.floor(_place(run) / 64).cast("int")), F.pmod(_place(run), F.lit(64)).cast("int")) == 1


def _held(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of the keyed ``texts`` joined with those of the distinct ``words`` that they hold.

    Runs and candidates travel with the key, and only the runs that words may be looked up by. Each text is sent once,
    to the candidates of its key, and goes no further than the comparison. Runs take far more room than what they are
    cut from, so they are dealt out before they are joined: what decides on a broadcast is their own size.
    """
    grams = words.filter(F.length("word") >= GRAM).select(
        "*", F.explode(_runs(F.col("word"), GRAM)).alias("run")).repartition("run")
    spread = grams.groupBy("run").agg(F.count("*").alias("n"))
    others = [F.any_value(c).alias(c) for c in words.columns if c != "word"]
    rarest = grams.join(spread, "run").groupBy("word").agg(F.min(F.struct("n", "run"))["run"].alias("run"), *others)
    short = words.filter(F.length("word") < GRAM).withColumn("run", F.col("word"))
    keys = rarest.unionByName(short)
    runs = F.concat(F.array(F.lit("")), _short_runs(F.col("text")), _runs(F.col("text"), GRAM))
    met = texts.select("key", "again", F.explode(runs).alias("run")).filter(_looked_up(keys)(F.col("run")))
    candidates = met.repartition("run").join(keys, "run").drop("run").distinct()
    return texts.join(candidates, ["key", "again"]).filter(F.contains("text", "word")).drop("text")


def with_first_contained(texts: DataFrame, text_col: str, words: DataFrame, name: str) -> DataFrame:
    """Add the lowest ``pos`` among the dictionary words that are substrings of the text, NULL if none is.

    ``words`` holds unique ``word`` with its ``pos``; the empty word is in every
    text but NULL.
    """
    known = _keyed(texts.select(F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct(), "text")
    lowest = _held(known, words).groupBy("key", "again").agg(F.min("pos").alias(name))
    return _keyed(texts, text_col).join(lowest, ["key", "again"], "left").drop("key", "again")


def with_first_around(texts: DataFrame, text_col: str, words: DataFrame, name: str) -> DataFrame:
    """Add the lowest ``pos`` among the dictionary words that hold the text, NULL if none does.

    A short text can be in very many words, so the runs of these are reduced to
    their lowest position before they meet the texts.
    """
    known = texts.select(F.col(text_col).alias("word")).filter("word IS NOT NULL").distinct()
    runs = F.concat(F.array(F.lit("")), _short_runs(F.col("word")))
    short = (words.select("pos", F.explode(runs).alias("word")).groupBy("word").agg(F.min("pos").alias("pos"))
             .join(known, "word").select("word", "pos"))
    names = _keyed(words.select(F.col("word").alias("text"), "pos"), "text")
    long = _held(names, known.filter(F.length("word") >= GRAM)).select("word", "pos")
    lowest = short.unionByName(long).groupBy(F.col("word").alias("__held")).agg(F.min("pos").alias(name))
    return texts.join(lowest, F.col(text_col) == F.col("__held"), "left").drop("__held")


def _lowest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("word").agg(F.min("pos").alias("pos"))


def _names(subjects: DataFrame) -> DataFrame:
    return _lowest(subjects.select(F.lower("name").alias("word"), "pos"))


def find_by_name(queries: DataFrame, subjects: DataFrame, id_col: str = "query_id",
                 name_col: str = "name") -> DataFrame:
    """``id_col, pos`` of the first subject in list order whose name equals, contains
    or is contained in the query's name, ignoring case; NULL if there is none."""
    names = _names(subjects)
    probes = queries.select(id_col, F.lower(name_col).alias("probe"))
    probes = with_first_contained(probes, "probe", names, "pos_inside")
    probes = with_first_around(probes, "probe", names, "pos_around")
    return probes.select(id_col, F.least("pos_inside", "pos_around").alias("pos"))


def _with_mentioned(messages: DataFrame, subjects: DataFrame, text_col: str) -> DataFrame:
    """Messages with the position of the subject they mention, or NULL, as ``named_pos``."""
    names = _names(subjects)
    parts = names.select("pos", F.explode(F.concat(F.array("word"), split_words(F.col("word")))).alias("word"))
    texts = messages.withColumn("__probe", F.lower(F.coalesce(text_col, F.lit(""))))
    mentioned = with_first_contained(texts, "__probe", _lowest(parts), "__mentioned")
    resolved = find_by_name(names.select(F.col("pos").alias("__mentioned"), F.col("word").alias("name")),
                            subjects, "__mentioned")
    return mentioned.join(
        resolved.withColumnRenamed("pos", "named_pos"), "__mentioned", "left",
    ).select(*messages.columns, "named_pos")


def find_mentioned(messages: DataFrame, subjects: DataFrame, id_col: str = "msg_id",
                   text_col: str = "text") -> DataFrame:
    """``id_col, pos`` of the subject a message mentions by its name or any word of it.

    The first mentioned list entry counts, and its name is then looked up like a
    typed name, so an earlier entry contained in that name takes its place.
    """
    found = _with_mentioned(messages, subjects, text_col)
    return found.filter(F.col("named_pos").isNotNull()).select(id_col, F.col("named_pos").alias("pos"))


# --- categories -------------------------------------------------------------
def detect_category(text: Column, categories=CATEGORY_WORDS) -> Column:
    """First category, in list order, with a keyword in the text; else NULL."""
    found = F.lit(None).cast("string")
    for category, words in reversed(categories):
        found = F.when(contains_any(text, words), category).otherwise(found)
    return found


def first_of_category(subjects: DataFrame) -> DataFrame:
    return subjects.groupBy("category").agg(F.min("pos").alias("category_pos"))


def category_counts(subjects: DataFrame) -> DataFrame:
    return subjects.groupBy("category").agg(F.count("*").alias("n"))


def in_category(subjects: DataFrame, category: str) -> DataFrame:
    return subjects.filter(F.col("category") == category)


def category_members(subjects: DataFrame) -> DataFrame:
    """The subjects of every category, as rows: a category can hold any number."""
    return subjects.filter(F.col("category").isNotNull()).select("category", "pos", "name")


# --- names in questions -----------------------------------------------------
def _before(ending: str) -> str:
    # anchored to line starts, so that a text without the ending is read once
    return rf"(?dm)^([^\n]+?){quoted(ending)}"


def extract_name(text: Column, endings=NAME_ENDINGS, stopwords=NAME_STOPWORDS) -> Column:
    """The words before the first ending, tried in list order, that follows some text.

    Without any ending: the words that hold no stop-word, or the text itself if
    nothing is left.
    """
    words = F.filter(split_words(text), lambda w: ~_holds(w, stopwords))
    found = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(text)
    for ending in reversed(endings):
        before = F.regexp_extract(text, _before(ending), 1)
        found = F.when(text.contains(ending) & (before != ""), trim_space(before)).otherwise(found)
    return found


def _holds(word: Column, parts) -> Column:
    return word.rlike("|".join(quoted(p) for p in parts))


# --- outcome per message ----------------------------------------------------
def _with_subject(rows: DataFrame, facts: DataFrame, text: Column) -> DataFrame:
    """Add the facts of each row's ``subject_pos``, NULL where there are none.

    A list of subjects takes far more room in memory than its files tell, so it is never broadcast. Rows without a
    subject must not meet in one task.
    """
    none = F.concat(F.lit("\0"), F.pmod(F.xxhash64(text), F.lit(1 << 16)))
    keyed = rows.withColumn("__subject", F.coalesce(F.col("subject_pos").cast("string"), none))
    known = facts.withColumn("__subject", F.col("subject_pos").cast("string")).drop("subject_pos")
    return keyed.join(known.hint("merge"), "__subject", "left").drop("__subject")


def resolve_messages(messages: DataFrame, subjects: DataFrame, id_col: str = "msg_id", text_col: str = "text",
                     categories=CATEGORY_WORDS) -> DataFrame:
    """Detected category, extracted name, found subject and its labels per message."""
    keyed = _with_mentioned(messages, subjects, text_col).withColumn(
        "__category", detect_category(F.col(text_col), categories))
    # one row per keyword category at most
    first = first_of_category(subjects.filter(F.col("category").isin(*[c for c, _ in categories])))
    keyed = keyed.join(F.broadcast(first.withColumnRenamed("category", "__category")), "__category", "left")
    chosen = keyed.withColumn("subject_pos", F.coalesce("named_pos", "category_pos"))
    facts = subjects.select(F.col("pos").alias("subject_pos"), F.col("name").alias("found_subject_name"),
                            F.col("category").alias("subject_category"))
    joined = _with_subject(chosen, facts, F.col(text_col))
    found = F.col("found_subject_name").isNotNull()
    return joined.select(
        *[F.col(c) for c in messages.columns],
        F.when(F.col("named_pos").isNotNull(), F.col("subject_category"))
        .otherwise(F.coalesce("__category", F.lit(NO_CATEGORY))).alias("detected_category"),
        extract_name(F.col(text_col)).alias("extracted_subject"),
        "subject_pos", "found_subject_name",
        F.when(found, "subject_information").otherwise("general_information").alias("info_type"),
        F.when(found, "json_database").otherwise("llm_general").alias("data_source"))


def subject_prompts(resolved: DataFrame, subjects: DataFrame, text_col: str = "text") -> DataFrame:
    """Prompt per message, with the subject's details where one was found; only these are written out."""
    rows = resolved.select("subject_pos", F.struct("*").alias("__message"))
    met = _with_subject(rows, subjects.withColumnRenamed("pos", "subject_pos"), F.col("__message")[text_col])
    details = F.when(F.col("__message.found_subject_name").isNotNull(), markdown())
    joined = met.select("__message.*", details.alias("details"))
    system, question = F.lit(PROMPT_SUBJECT_SYSTEM), F.col(text_col)
    with_details = fill_template(PROMPT_SUBJECT_FOUND, system=system, name=F.col("found_subject_name"),
                                 details=F.col("details"), question=question)
    without = fill_template(PROMPT_SUBJECT_MISSING, system=system, name=F.col("extracted_subject"), question=question)
    return joined.withColumn(
        "prompt", F.when(F.col("found_subject_name").isNotNull(), with_details).otherwise(without)).drop("details")


# --- nested sections --------------------------------------------------------
def _kinds(section: Column) -> Column:
    """Key to type name of each value (``OBJECT<…>``, ``ARRAY<…>``, ``STRING``)."""
    return F.transform_values(F.from_json(section, "map<string,variant>"), lambda k, v: F.schema_of_variant(v))


def _entries(section: Column) -> Column:
    """``(at, key, value text, kind)`` of each section entry, in document order."""
    pairs = F.map_entries(F.from_json(section, TEXT_MAP))
    kinds = _kinds(section)
    return F.transform(pairs, lambda e, i: F.struct(
        i.alias("at"), e["key"].alias("key"), e["value"].alias("value"),
        F.element_at(kinds, e["key"]).alias("kind")))


def ticket_prices(subjects: DataFrame) -> DataFrame:
    """One row per ticket and age group; a plain text value is a note without age group."""
    tickets = subjects.select("pos", "name", F.explode(_entries(F.col("ticket_info"))).alias("e"))
    opened = tickets.select("pos", "name", F.col("e.key").alias("ticket"), F.col("e.kind").alias("kind"),
                            F.col("e.value").alias("value"))
    priced = opened.filter(F.col("kind").startswith("OBJECT")).select(
        "pos", "name", "ticket", F.explode(F.from_json("value", TEXT_MAP)).alias("age_group", "price_text"))
    notes = opened.filter(F.col("kind") == "STRING").select(
        "pos", "name", "ticket", F.lit(None).cast("string").alias("age_group"), F.col("value").alias("price_text"))
    price = F.when(F.col("age_group").isNotNull(), F.regexp_replace("price_text", "[^0-9]", ""))
    return priced.unionByName(notes).withColumn("price_krw", price.try_cast("long"))


def attractions(subjects: DataFrame) -> DataFrame:
    """One row per attraction: area, sub-area (NULL where the area is a plain list), place in the list."""
    areas = subjects.select("pos", "name", F.explode(_entries(F.col("attractions"))).alias("e")).select(
        "pos", "name", F.col("e.key").alias("area"), F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
    nested = areas.filter(F.col("kind").startswith("OBJECT")).select(
        "pos", "name", "area", F.explode(_entries(F.col("value"))).alias("s"))
    nested = nested.filter(F.col("s.kind").startswith("ARRAY")).select(
        "pos", "name", "area", F.col("s.key").alias("sub_area"), F.col("s.value").alias("value"))
    flat = areas.filter(F.col("kind").startswith("ARRAY")).select(
        "pos", "name", "area", F.lit(None).cast("string").alias("sub_area"), "value")
    return nested.unionByName(flat).select(
        "pos", "name", "area", "sub_area",
        F.posexplode(F.from_json("value", "array<string>")).alias("item_no", "attraction"))


def facilities(subjects: DataFrame) -> DataFrame:
    """One row per facility of each type."""
    kinds = subjects.select("pos", "name", F.explode(_entries(F.col("facilities"))).alias("e"))
    return kinds.filter(F.col("e.kind").startswith("ARRAY")).select(
        "pos", "name", F.col("e.key").alias("facility_type"),
        F.posexplode(F.from_json("e.value", "array<string>")).alias("item_no", "facility"))


def visitor_tips(subjects: DataFrame) -> DataFrame:
    return subjects.select("pos", "name", F.posexplode("visitor_tips").alias("item_no", "tip"))


# --- Markdown ---------------------------------------------------------------
def _list_text(json_list: Column) -> Column:
    return F.array_join(F.from_json(json_list, "array<string>"), ", ")


def _line(before: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(before), value))


def _block(title: str, section: Column, lines: Column) -> Column:
    """A titled section: nothing when the section is absent."""
    return F.when(section.isNotNull(), F.array_join(F.concat(F.array(F.lit(title)), F.flatten(lines)), "\n"))


def _ticket_lines(e: Column) -> Column:
    ages = F.map_entries(F.from_json(e["value"], TEXT_MAP))
    known = F.filter(ages, lambda a: a["key"].isin(*AGE_LABELS))
    label = F.create_map(*[F.lit(x) for pair in AGE_LABELS.items() for x in pair])
    prices = F.array_join(F.transform(known, lambda a: F.concat(F.element_at(label, a["key"]), F.lit(": "), a["value"])), ", ")
    none = F.array().cast("array<string>")
    return (F.when(e["kind"].startswith("OBJECT"),
                   F.array(F.concat(F.lit("  🎫 **"), e["key"], F.lit("**: "), prices)))
            .when(e["kind"] == "STRING", F.array(F.concat(F.lit("  💰 **"), e["key"], F.lit("**: "), e["value"])))
            .otherwise(none))


def _area_lines(e: Column) -> Column:
    head = F.array(F.concat(F.lit("\n🎢 **"), e["key"], F.lit("**")))
    lists = F.filter(_entries(e["value"]), lambda s: s["kind"].startswith("ARRAY"))
    subs = F.transform(lists, lambda s: F.concat(F.lit("  • **"), s["key"], F.lit("**: "), _list_text(s["value"])))
    return (F.when(e["kind"].startswith("OBJECT"), F.concat(head, subs))
            .when(e["kind"].startswith("ARRAY"),
                  F.concat(head, F.array(F.concat(F.lit("  • "), _list_text(e["value"])))))
            .otherwise(head))


def _facility_lines(e: Column) -> Column:
    return F.when(e["kind"].startswith("ARRAY"),
                  F.array(F.concat(F.lit("  🏢 **"), e["key"], F.lit("**: "), _list_text(e["value"])))
                  ).otherwise(F.array().cast("array<string>"))


def markdown() -> Column:
    """A subject record as Markdown text; absent sections leave no trace."""
    ways = F.from_json("transportation", TEXT_MAP)

    def filled(name: str) -> Column:
        return F.nullif(F.nullif(F.col(name), F.lit("{}")), F.lit(""))

    tips = F.when(F.size("visitor_tips") > 0, F.col("visitor_tips"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("## 📍 "), F.col("name")),
        F.concat(F.lit("**카테고리**: "), F.col("category")),
        _line("**위치**: ", F.col("location")),
        F.when(F.col("transportation").isNotNull(), F.concat_ws(
            "\n", F.lit("\n**교통편**"), _line("🚇 **지하철**: ", F.element_at(ways, "subway")),
            _line("🚌 **버스**: ", F.element_at(ways, "bus")),
            _line("🅿️ **주차**: ", F.element_at(ways, "parking")))),
        _line("\n**소개**\n", F.col("description")),
        _line("\n**개장일**: ", F.col("opening_date")),
        _line("\n**운영시간**\n", F.col("opening_hours")),
        _line("\n**휴무일**: ", F.col("closed_days")),
        _block("\n**티켓 정보**", F.col("ticket_info"), F.transform(_entries(F.col("ticket_info")), _ticket_lines)),
        _block("\n**주요 어트랙션**", filled("attractions"), F.transform(_entries(filled("attractions")), _area_lines)),
        _block("\n**시설 안내**", filled("facilities"), F.transform(_entries(filled("facilities")), _facility_lines)),
        F.when(tips.isNotNull(), F.array_join(F.concat(
            F.array(F.lit("\n**방문 팁**")), F.transform(tips, lambda t: F.concat(F.lit("  💡 "), t))), "\n")),
        _line("\n**공식 웹사이트**\n", F.col("official_website")),
    )
