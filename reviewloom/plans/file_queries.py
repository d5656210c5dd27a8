"""Queries that write files in the forms the library reads, and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from reviewloom.fixed_values import SITES
from reviewloom.operators import cleaning, retrieval
from reviewloom.plans import derived
from reviewloom.plans.oracle_parts import CLEAN, SITE_LIST, SUBJECTS, trimmed
from reviewloom.session import shared_folder
from reviewloom.sources import reviews as source
from reviewloom.sources.tables import load_index, read_subjects, table


def _raw(spark, folder) -> DataFrame:
    """Whole documents as raw reviews: bodies hold line feeds and quotes."""
    docs = table(spark, folder, "documents")
    site = F.element_at(F.array(*[F.lit(s) for s in SITES]), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select("doc_id", site.alias("site"), (F.col("doc_id") % 5 + 1).cast("string").alias("rating"),
                       F.concat(F.lit("2024.01."), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("date"),
                       F.col("text").alias("content"))


def raw_files_by_site(spark, folder):
    """Raw CSV of each site, found and read by its name, numbered as it arrived."""
    path, raw = shared_folder(spark, "raw"), _raw(spark, folder)
    for site in SITES:
        ordered = raw.filter(F.col("site") == site).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
        source.write_raw_csv(ordered, f"{path}/reviews_{site}.csv")
    return source.read_raw_csv(spark, f"{path}/reviews_*.csv")


def tagged_union(spark, folder):
    """One table from a raw file per site, the site given with each."""
    path, raw = shared_folder(spark, "raw"), _raw(spark, folder)
    frames = {}
    for site in SITES:
        source.write_raw_csv(raw.filter(F.col("site") == site), f"{path}/{site}")
        frames[site] = source.read_raw_csv(spark, f"{path}/{site}", site).drop("ingest_seq", "site")
    return source.union_sites(frames)


def collection_first_copies(spark, folder):
    """The first copy of equal contents in a collection of three files of very different size."""
    path, raw = shared_folder(spark, "collection"), _raw(spark, folder)
    rows = raw.withColumn("_id", F.concat(F.lit("x"), "doc_id")).withColumn(
        "part", F.when(F.col("doc_id") < 10, "a").when(F.col("doc_id") < 100, "b").otherwise("c"))
    for part in ("a", "b", "c"):
        (rows.filter(F.col("part") == part).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
         .select("_id", "rating", "date", "content").write.json(f"{path}/{part}"))
    read = source.read_collection(spark, f"{path}/*", "kakaomap")
    return cleaning.keep_first(read, ["site", "content"], ["ingest_seq"])


def subjects_in_file_order(spark, folder):
    """Subject records of several JSON lists, in the order of the files and of each list."""
    path = shared_folder(spark, "subjects")
    records = derived.subjects(spark, folder).select(
        "pos", F.format_string("%09d", F.floor(F.col("pos") / 64).cast("long")).alias("chunk"),
        F.to_json(F.struct("name", "category", "description")).alias("record"))
    lists = records.groupBy("chunk").agg(F.concat(F.lit("["), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "record"))), lambda r: r["record"]), ",\n"), F.lit("]")).alias("value"))
    lists.write.partitionBy("chunk").text(path)
    return read_subjects(spark, path).select("pos", "name", "category", "description")


def processed_runs(spark, folder):
    """A cleaning run with its summary, the same run again, and the rows appended once more."""
    path, clean = shared_folder(spark, "processed"), derived.stored_clean(spark, folder)
    summary = source.write_clean_with_summary(clean, path)
    source.write_clean(clean, path)
    again = source.read_clean(spark, path).groupBy("site").agg(F.count("*").alias("rows_after_second_run")).collect()
    source.write_clean(clean, path, mode="append")
    second = reduce(lambda a, r: a.when(F.col("site_name") == r["site"], r["rows_after_second_run"]), again,
                    F.when(F.lit(False), 0)).cast("long")  # one row per known site
    appended = source.read_clean(spark, path).groupBy(F.col("site").alias("site_name")).agg(
        F.count("*").alias("rows_after_append"))
    return summary.withColumn("rows_after_second_run", second).join(appended, "site_name")


def _shown(index: DataFrame) -> DataFrame:
    meta = F.col("meta")
    return index.select("vec_id", "content", meta["platform"].alias("platform"), meta["date"].alias("date"),
                        meta["rating"].alias("rating"))


def preprocessed_index(spark, folder):
    """An index from preprocessed files: written per site, read by name, embedded, stored, loaded."""
    path, clean = shared_folder(spark, "preprocessed"), derived.stored_clean(spark, folder)
    for site in SITES:
        source.write_preprocessed_csv(clean.filter(F.col("site") == site), f"{path}/preprocessed_reviews_{site}.csv")
    records = source.read_preprocessed_csv(spark, f"{path}/preprocessed_reviews_*.csv")
    return _shown(load_index(spark, f"{path}/index", lambda: retrieval.build_index(records)))


def extended_index(spark, folder):
    """An index of one site's reviews to which those of the others are added, the second ones twice."""
    path, clean = shared_folder(spark, "extended"), derived.stored_clean(spark, folder)
    first = F.col("site") == SITES[0]
    index = load_index(spark, path, lambda: retrieval.build_index(clean.filter(first)))
    for site in (SITES[1], SITES[1], SITES[2]):
        retrieval.add_documents(path, index, retrieval.indexable(clean.filter(F.col("site") == site)), key=site)
    return _shown(load_index(spark, path, lambda: index))


QUERIES = {f.__name__: f for f in (
    raw_files_by_site, tagged_union, collection_first_copies, subjects_in_file_order, processed_runs,
    preprocessed_index, extended_index)}

_RAW = f"""raw AS (SELECT doc_id, {SITE_LIST}[doc_id % 3 + 1] AS site, CAST(doc_id % 5 + 1 AS DOUBLE) AS rating,
    '2024.01.' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date, text AS content FROM documents)"""
_INDEXED = f"""WITH {CLEAN} SELECT row_number() OVER (ORDER BY site, ingest_seq) - 1 AS vec_id, content, site AS platform,
    strftime(date, '%Y-%m-%d') AS date, rating FROM clean WHERE length({trimmed('content')}) > 10"""

SQL = {
    "raw_files_by_site": f"""WITH {_RAW} SELECT site, row_number() OVER (ORDER BY site, doc_id) - 1 AS ingest_seq, rating, date,
        content FROM raw""",
    "tagged_union": f"WITH {_RAW} SELECT site, rating, date, content FROM raw",
    "collection_first_copies": f"""WITH {_RAW}, placed AS (SELECT 'kakaomap' AS site, row_number() OVER (ORDER BY doc_id) - 1 AS ingest_seq,
          rating, date, content FROM raw)
        SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY content ORDER BY ingest_seq) = 1""",
    "subjects_in_file_order": f"""WITH {SUBJECTS} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, name, category,
        CASE WHEN p_size % 5 <> 0 THEN name || ' ' || p_type END AS description FROM subjects_v""",
    "processed_runs": f"""WITH {CLEAN} SELECT site AS site_name, count(*) AS processed_count, 'review_' || site AS source_collection,
        'preprocessed_reviews_' || site AS target_collection, 'Review preprocessing completed successfully for ' || site ||
        '. Processed ' || count(*) || ' records.' AS message, count(*) AS rows_after_second_run, 2 * count(*) AS rows_after_append
        FROM clean GROUP BY site""",
    "preprocessed_index": _INDEXED,
    "extended_index": _INDEXED,
}
