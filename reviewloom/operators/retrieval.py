"""From nearest vectors to context, quality figures and prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.fixed_values import (DEFAULT_PLACE, INDEX_LENGTH_ABOVE, KEEP_AT_LEAST, KEEP_AT_MOST, MMR_FETCH,
                                     MMR_KEEP, NO_REFERENCES, PROMPT_REVIEW, REPLY_BLANK_QUESTION, REPLY_NO_REVIEWS,
                                     SCORE_MIN, SITES)
from reviewloom.functions.labels import (chunk_entry, confidence, confidence_note, hit_entry, or_default,
                                         reference_line)
from reviewloom.functions.text import fill_template, is_blank, trim_space
from reviewloom.operators.answers import ask_once, one_by_one, with_answers
from reviewloom.operators.cleaning import keep_first
from reviewloom.operators.embed import embed, hashed_features
from reviewloom.operators.knn import nearest
from reviewloom.operators.ordered import number_rows
from reviewloom.session import stored
from reviewloom.sources.tables import append_index


# --- index ------------------------------------------------------------------
def indexable(clean: DataFrame, place: str = DEFAULT_PLACE) -> DataFrame:
    """Records worth indexing, with their metadata."""
    day = F.date_format("date", "yyyy-MM-dd") if clean.schema["date"].dataType.typeName() != "string" else F.col("date")
    meta = F.struct(
        F.col("site").alias("platform"), F.lit(place).alias("subject"), F.lit(place).alias("place"),
        F.coalesce(day, F.lit("")).alias("date"), F.col("rating").cast("double").alias("rating"),
        F.lit("").alias("url"))
    return (clean.filter(F.length(trim_space(F.col("content"))) > INDEX_LENGTH_ABOVE)
            .select("site", "ingest_seq", "content", meta.alias("meta")))


def build_index(clean: DataFrame, sites=SITES,
                make_embedder: Callable = lambda: hashed_features) -> DataFrame:
    """``vec_id, content, meta, embedding``; ids count from 0 by site, then arrival."""
    numbered = number_rows(indexable(clean), "site", "ingest_seq", "vec_id", tuple(sites))
    return embed(numbered.select("vec_id", "content", "meta"), "content", make_embedder)


def add_documents(index_path: str, existing: DataFrame, records: DataFrame, sites=SITES,
                  make_embedder: Callable = lambda: hashed_features, key: str | None = None) -> None:
    """Append records ``site, ingest_seq, content, meta`` to a stored index.

    Their ids follow the highest one there is. Vectors are normalised like those
    of a new index, so all scores stay cosines. Records sent again under the same
    ``key`` are added once.
    """
    numbered = number_rows(records, "site", "ingest_seq", "vec_id", tuple(sites))
    append_index(index_path, existing, embed(numbered.select("vec_id", "content", "meta"), "content", make_embedder), key)


# --- selection --------------------------------------------------------------
def threshold(hits: DataFrame, minimum: float = 0.6) -> DataFrame:
    return hits.filter(F.col("score") >= minimum)


def select_hits(hits: DataFrame, minimum: float = SCORE_MIN, at_least: int = KEEP_AT_LEAST,
                at_most: int = KEEP_AT_MOST) -> DataFrame:
    """Apply threshold, floor and cap to ranked hits, at most k of them per query.

    Fewer than ``at_least`` passing hits are topped up to it when that many were
    found, else one hit is kept. ``filtered_count`` is the count after the floor.
    """
    query = Window.partitionBy("query_id")
    counted = hits.select(
        "*", F.count("*").over(query).alias("total_found"),
        F.count(F.when(F.col("score") >= minimum, 1)).over(query).alias("__pass"))
    kept = (F.when((F.col("__pass") < at_least) & (F.col("total_found") >= at_least), F.lit(at_least))
            .when(F.col("__pass") == 0, F.least(F.lit(1), F.col("total_found")))
            .otherwise(F.col("__pass")))
    return (counted.withColumn("filtered_count", kept.cast("long")).drop("__pass")
            .filter(F.col("rank") <= F.least(F.col("filtered_count"), F.lit(at_most))))


def _figures() -> list[Column]:
    return [F.max("total_found").alias("total_found"), F.max("filtered_count").alias("filtered_count"),
            F.count("*").alias("used_count"), F.avg("score").alias("avg_similarity"),
            F.max("score").alias("max_similarity"), F.min("score").alias("min_similarity")]


def quality(selected: DataFrame) -> DataFrame:
    """Counts and score figures per query, with the confidence label."""
    figures = selected.groupBy("query_id").agg(*_figures())
    return figures.withColumn("confidence", confidence(F.col("avg_similarity")))


def with_content(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Attach text and metadata by ``vec_id``; hits on unknown ids are dropped."""
    return hits.join(index.select("vec_id", "content", "meta"), "vec_id")


def document_hits(hits: DataFrame) -> DataFrame:
    """Flat hit rows with defaults for missing metadata."""
    meta = F.col("meta")
    return hits.select(
        "query_id", "rank", F.col("content").alias("chunk"),
        F.coalesce(meta["platform"], F.lit("unknown")).alias("platform"),
        F.coalesce(meta["place"], F.lit(DEFAULT_PLACE)).alias("place"),
        F.coalesce(meta["date"], F.lit("")).alias("date"), meta["rating"].alias("rating"),
        F.col("vec_id").alias("source_row"), F.col("vec_id").alias("chunk_index"), "score")


def retriever_hits(hits: DataFrame) -> DataFrame:
    """Hit rows of the retriever: all metadata, no score unless one is supplied."""
    keys = ("platform", "subject", "place", "date", "rating", "url")
    score = F.col("score") if "score" in hits.columns else F.lit(None).cast("double")
    return hits.select("query_id", "rank", F.col("content").alias("chunk"),
                       *[F.col("meta")[k].alias(k) for k in keys], score.alias("score"))


def _listed(rows: DataFrame) -> Column:
    """A query's few hits as structs in rank order."""
    return F.array_sort(F.collect_list(F.struct("rank", *[c for c in rows.columns if c not in ("query_id", "rank")])))


def hit_lists(rows: DataFrame) -> DataFrame:
    """One list of hit structs per query in rank order; ``rows`` holds a few hits per query."""
    return rows.groupBy("query_id").agg(_listed(rows).alias("retrieved_reviews"))


# --- text -------------------------------------------------------------------
def _in_rank_order(entry: Column, separator: str = "\n\n") -> Column:
    """Join the entries of one query's few selected hits."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return F.array_join(F.transform(ranked, lambda x: x["entry"]), separator)


def _hit_context() -> Column:
    return _in_rank_order(hit_entry(F.col("content"), F.col("meta"), F.col("score"))).alias("context")


def context_blocks(hits: DataFrame) -> DataFrame:
    """One context text per query from its selected hits."""
    return hits.groupBy("query_id").agg(_hit_context())


def distinct_chunks(hits: DataFrame) -> DataFrame:
    """First hit of each query among those whose trimmed text is the same."""
    keyed = hits.withColumn("__text", F.md5(trim_space(F.col("content")).cast("binary")))
    return keep_first(keyed, ["query_id", "__text"], ["rank"]).drop("__text")


def chunk_blocks(hits: DataFrame) -> DataFrame:
    """Context text in the retriever's form, copies removed."""
    entries = _in_rank_order(chunk_entry(F.col("content"), F.col("meta")))
    return distinct_chunks(hits).groupBy("query_id").agg(entries.alias("context"))


def reference_lists(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """The reference lines of every query; a query without hits has a line that says so."""
    entries = _in_rank_order(reference_line(F.col("content"), F.col("meta")), "\n")
    found = hits.groupBy("query_id").agg(entries.alias("references"))
    return queries.select("query_id").distinct().join(found, "query_id", "left").select(
        "query_id", F.coalesce("references", F.lit(NO_REFERENCES)).alias("references"))


def review_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Prompt per question from its selected hits, or the fixed reply where no prompt is due."""
    material = hits.groupBy("query_id").agg(_hit_context(), *_figures()).join(
        hit_lists(document_hits(hits)), "query_id")
    joined = questions.join(material.withColumn("confidence", confidence(F.col("avg_similarity"))), "query_id", "left")
    blank = is_blank(F.col("question"))
    found = F.col("used_count").isNotNull()
    return joined.select(
        "query_id", "question", F.coalesce("context", F.lit("")).alias("context"),
        F.when(~blank & found, fill_template(PROMPT_REVIEW, context=F.col("context"),
                                             question=trim_space(F.col("question")))).alias("prompt"),
        F.when(blank, REPLY_BLANK_QUESTION).when(~found, REPLY_NO_REVIEWS).alias("reply"),
        "total_found", "filtered_count", "used_count", "avg_similarity", "max_similarity", "min_similarity",
        "retrieved_reviews", "confidence", F.when(found, confidence_note(F.col("confidence"))).alias("note"))


def search_reviews(index: DataFrame, questions: DataFrame,
                   make_embedder: Callable = lambda: hashed_features) -> DataFrame:
    """Questions ``query_id, question`` to prompts: embed, search, select, assemble.

    The questions' vectors are stored, so that a model sees each question once.
    The selected hits are stored: they are few and narrow, so the join that
    fetches their texts can broadcast them instead of shuffling all texts.
    """
    asked = stored(embed(questions.filter(~is_blank(F.col("question"))), "question", make_embedder)
                   .select("query_id", "embedding"), "questions")
    selected = stored(select_hits(nearest(index, asked.select("query_id", "embedding"))), "hits")
    return review_prompts(questions, with_content(selected, index))


# --- answers ----------------------------------------------------------------
def answer(prompts: DataFrame, make_model: Callable[[], Callable[[str], str]], fallback: str,
           prompt_col: str = "prompt", fallback_fields: tuple[str, ...] = (), trim: bool = False,
           answers: DataFrame | None = None) -> DataFrame:
    """Add ``result`` and ``error`` by asking a user-supplied model once per distinct prompt.

    A failing call leaves the job running: its rows get the fallback text, in
    which ``{error}`` stands for the reason and ``{name}`` for a listed column,
    and the reason. ``trim`` takes white space off both ends of an answer, which
    free chat asks for and the other handlers do not. ``answers`` are those that
    ``ask_once`` gave already.
    """
    if answers is None:
        answers = ask_once(prompts, lambda: one_by_one(make_model()), prompt_col)
    return with_answers(prompts, answers, fallback, prompt_col, fallback_fields, trim_space if trim else None)


def noted_result(result: Column, note: Column, error: Column) -> Column:
    """The shown text of a review answer: the confidence note follows a real answer."""
    return F.when(error.isNull(), F.concat(result, F.coalesce(note, F.lit("")))).otherwise(result)


# --- diversity --------------------------------------------------------------
def select_diverse(candidates: DataFrame, queries: DataFrame, k: int = MMR_KEEP, balance: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over a few candidates per query.

    ``candidates`` holds ``query_id, vec_id, embedding``, at most ``fetch_k`` per
    query, so a query's rows always fit one task. The first pick is the most
    similar candidate; each further one weighs similarity against the closest
    earlier pick. Ties go to the lower ``vec_id``.
    """
    def pick(vec_ids: np.ndarray, vectors: np.ndarray, query: np.ndarray) -> tuple[list[int], np.ndarray]:
        relevance = np.round(vectors @ query, 6)
        alike = np.round(vectors @ vectors.T, 6)
        chosen = [int(relevance.argmax())]
        while len(chosen) < min(k, len(vec_ids)):
            value = np.round(balance * relevance - (1 - balance) * alike[:, chosen].max(axis=1), 6)
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
        return chosen, relevance[chosen]

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)

    def select(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        query_ids, vec_ids = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("query_id", "vec_id"))
        vectors, queries = matrix(rows.column("embedding")), matrix(rows.column("query"))
        begin = np.flatnonzero(np.append(True, query_ids[1:] != query_ids[:-1]))
        places, scores, ranks = [], [], []
        for at, end in zip(begin, np.append(begin[1:], len(query_ids))):
            chosen, score = pick(vec_ids[at:end], vectors[at:end], queries[at])
            places += [at + c for c in chosen]
            scores.append(score)
            ranks += range(1, len(chosen) + 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[places]), pa.array(vec_ids[places]), pa.array(np.concatenate(scores)),
             pa.array(ranks, pa.int32())], ["query_id", "vec_id", "score", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Many queries at a time; the last query of a batch waits for the next one."""
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            query_ids = rows.column("query_id").to_numpy()
            cut = int(np.argmax(query_ids == query_ids[-1]))
            if cut:
                yield select(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield select(held)

    paired = candidates.join(queries.select("query_id", F.col("embedding").alias("query")), "query_id").select(
        F.col("query_id").cast("long").alias("query_id"), F.col("vec_id").cast("long").alias("vec_id"), "embedding", "query")
    return paired.repartition("query_id").sortWithinPartitions("query_id", "vec_id").mapInArrow(
        run, "query_id long, vec_id long, score double, rank int")


def diverse(vectors: DataFrame, queries: DataFrame, k: int = MMR_KEEP, fetch_k: int = MMR_FETCH,
            balance: float = 0.5, skip_self: bool = False) -> DataFrame:
    """Fetch the nearest ``fetch_k`` vectors of each query and select ``k`` diverse ones."""
    found = stored(nearest(vectors, queries, fetch_k, skip_self).select("query_id", "vec_id"), "candidates")
    return select_diverse(found.join(vectors.select("vec_id", "embedding"), "vec_id"), queries, k, balance)


def retrieve(vectors: DataFrame, queries: DataFrame, mode: str = "mmr", k: int = MMR_KEEP,
             fetch_k: int = MMR_FETCH) -> DataFrame:
    """Search by ``mmr`` (diverse) or plain ``similarity``."""
    if mode == "mmr":
        return diverse(vectors, queries, k, fetch_k)
    return nearest(vectors, queries, k)


def with_default_meta(meta: Column) -> Column:
    """Metadata struct with missing text fields as empty strings."""
    texts = ("platform", "subject", "place", "date", "url")
    return F.struct(*[or_default(meta[t], "").alias(t) for t in texts], meta["rating"].alias("rating"))
