"""Vector search, selection, context and prompt queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reviewloom.fixed_values import (INFO_WORDS, NO_REFERENCES, NOTE_HIGH, NOTE_LOW, PROMPT_CHAT, PROMPT_REVIEW,
                                     REPLY_CHAT_FAILED, REPLY_REVIEW_FAILED, REPLY_SUBJECT_FAILED, REVIEW_WORDS)
from reviewloom.functions.labels import chunk_source, hit_source
from reviewloom.functions.vectors import l2_normalise
from reviewloom.functions.text import split_words
from reviewloom.operators.answers import ask_once, one_by_one
from reviewloom.operators import cells, conversations, embed, knn, retrieval, wordpiece
from reviewloom.plans import answering, derived
from reviewloom.plans.chat_queries import MARKDOWN, keyword_case, quoted, resolve_sql, subject_prompt
from reviewloom.plans.oracle_parts import (CLEAN, CONTENTS, MENTIONS, PAIRS, SELECTED, TOP10, TURNS, USER_MESSAGES,
                                           hashed, selected, trimmed, words)
from reviewloom.session import shared_folder, stored
from reviewloom.sources.tables import load_index, table


def _long(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


def _top10(spark: SparkSession, folder: str) -> DataFrame:
    return knn.nearest(derived.vectors(spark, folder), derived.vector_queries(spark, folder), skip_self=True)


def knn_top10(spark, folder):
    return _long(_top10(spark, folder), "rank")


def knn_label_profiles(spark, folder):
    """Nearest vectors of each label's mean: few queries over the whole table."""
    profiles = derived.label_profiles(spark, folder).withColumn("embedding", l2_normalise(F.col("embedding")))
    return _long(knn.nearest(derived.vectors(spark, folder), profiles), "rank")


def knn_blockwise(spark, folder):
    """The search for query sets of any size, cell by cell instead of broadcasting."""
    found = knn.nearest(derived.vectors(spark, folder), derived.vector_queries(spark, folder), skip_self=True,
                        broadcast_bytes=0)
    return _long(found, "rank")


def knn_stored_cells(spark, folder):
    """The same hits from vectors that were stored by cell, as an index is."""
    path = shared_folder(spark, "cells")
    vectors = knn.usable(derived.vectors(spark, folder))
    length = vectors.select(F.size("embedding")).first()[0]
    cells.write(vectors, length, path, cell_rows=256)
    found = knn.search_cells(cells.load(spark, path), derived.vector_queries(spark, folder), 11).hits.drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.filter("query_id <> vec_id").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter("rank <= 10")


def hits_above_threshold(spark, folder):
    return _long(retrieval.threshold(_top10(spark, folder), 0.4), "rank")


def _selected(spark, folder):
    return retrieval.select_hits(_top10(spark, folder))


def knn_threshold_floor(spark, folder):
    return _long(_selected(spark, folder), "rank")


def retrieval_quality(spark, folder):
    figures = retrieval.quality(_selected(spark, folder))
    return figures.withColumn("avg_similarity", F.round("avg_similarity", 6))


def _content_hits(spark, folder):
    return retrieval.with_content(stored(_selected(spark, folder), "hits"), derived.index_contents(spark, folder))


def context_block(spark, folder):
    return retrieval.context_blocks(_content_hits(spark, folder))


def chunk_context(spark, folder):
    return retrieval.chunk_blocks(_content_hits(spark, folder))


def reference_lines(spark, folder):
    """The reference lines of every vector's hits, and of one query that finds nothing."""
    asked = derived.vector_queries(spark, folder).select("query_id")
    nothing = spark.createDataFrame([(-1,)], "query_id long")
    return retrieval.reference_lists(_content_hits(spark, folder), asked.unionByName(nothing))


def document_hits(spark, folder):
    return _long(retrieval.document_hits(_content_hits(spark, folder)), "rank")


def retriever_hits(spark, folder):
    return _long(retrieval.retriever_hits(_content_hits(spark, folder)), "rank")


def hit_lists(spark, folder):
    lists = retrieval.hit_lists(retrieval.document_hits(_content_hits(spark, folder)))
    shown = F.transform("retrieved_reviews", lambda h: F.concat_ws(
        "|", h["rank"].cast("string"), h["chunk_index"].cast("string"), h["source_row"].cast("string"), h["platform"],
        h["place"], h["date"], h["rating"].cast("string"), F.format_string("%.6f", h["score"]), h["chunk"]))
    return lists.select("query_id", F.array_join(shown, "\n").alias("hits"))


def source_strings(spark, folder):
    meta = F.col("meta")
    return derived.index_contents(spark, folder).select(
        "vec_id", hit_source(meta).alias("hit_source"), chunk_source(meta).alias("chunk_source"))


def context_dedup(spark, folder):
    """First of equal trimmed texts per language, ranked by document number."""
    ranked = table(spark, folder, "documents").select(
        F.col("lang").alias("query_id"), F.col("doc_id").alias("rank"), F.col("text").alias("content"))
    return retrieval.distinct_chunks(ranked).select("query_id", "rank")


def review_index(spark, folder):
    index = retrieval.build_index(derived.stored_clean(spark, folder))
    meta = F.col("meta")
    return index.select("vec_id", "content", meta["platform"].alias("platform"), meta["place"].alias("place"),
                        meta["date"].alias("date"), meta["rating"].alias("rating"))


def hash_embed_reviews(spark, folder):
    """The non-zero components of every review's vector."""
    vectors = embed.embed(derived.cleaned(spark, folder).select("ingest_seq", "content"), "content")
    parts = vectors.select("ingest_seq", F.posexplode("embedding").alias("slot", "w"))
    return parts.filter("w <> 0").select(
        "ingest_seq", F.col("slot").cast("long").alias("slot"), F.round(F.col("w").cast("double"), 6).alias("w"))


def _questions(spark, folder):
    rows = derived.messages(spark, folder).filter("role = 'user'")
    return rows.select(derived.pair_id("conv_id", "turn").alias("query_id"), F.col("text").alias("question"))


def _stored_index(spark, folder):
    return load_index(spark, shared_folder(spark, "index"),
                      lambda: retrieval.build_index(derived.stored_clean(spark, folder)))


def _shown_reviews(prompts: DataFrame) -> DataFrame:
    """The retrieved reviews as text."""
    shown = F.transform("retrieved_reviews", lambda h: F.concat_ws(
        "|", h["rank"].cast("string"), h["source_row"].cast("string"), h["platform"], h["date"],
        F.format_string("%.6f", h["score"]), h["chunk"]))
    return prompts.withColumn("retrieved_reviews", F.array_join(shown, "\n"))


def review_prompts(spark, folder):
    """User messages answered from the review index: embed, search, select, assemble."""
    prompts = retrieval.search_reviews(_stored_index(spark, folder), _questions(spark, folder))
    return _shown_reviews(prompts.withColumn("avg_similarity", F.round("avg_similarity", 6)))


def chat_states(spark, folder):
    """User messages through routing and all three handlers."""
    states = answering.session_states(derived.numbered_messages(spark, folder), _stored_index(spark, folder),
                                      derived.subjects(spark, folder))
    return _shown_reviews(states).select(
        "msg_id", "routing_decision", "review_query", "rag_context", "retrieved_reviews", "total_found", "filtered_count",
        "used_count", F.round("avg_similarity", 6).alias("avg_similarity"), "max_similarity", "min_similarity",
        "confidence", "note", "reply", "detected_category", "extracted_subject",
        "found_subject_name", "info_type", "data_source", "prompt")


def _checking_model():
    def model(prompt: str) -> str:
        if len(prompt) % 3 == 0:
            raise ValueError("no answer")
        return f" {len(prompt)} "
    return model


def _answered(spark, folder) -> DataFrame:
    states = answering.session_states(derived.numbered_messages(spark, folder), _stored_index(spark, folder),
                                      derived.subjects(spark, folder))
    answers = answering.answer_states(states, lambda: _checking_model())
    return stored(answers.withColumns({"conv_id": F.shiftright("msg_id", 32),
                                       "turn": F.col("msg_id").bitwiseAND((1 << 32) - 1)}), "answers")


def answered_states(spark, folder):
    """Every message answered by its handler, with a stand-in for the model that fails at times."""
    return _answered(spark, folder).select("conv_id", "turn", "routing_decision", "result", "said", "error")


def handled_history(spark, folder):
    """The history of each conversation after its messages were answered, by the handlers' own rules."""
    return answering.answered_history(conversations.pair_turns(derived.messages(spark, folder)), _answered(spark, folder))


def wordpiece_reviews(spark, folder):
    """Word pieces by a vocabulary of the characters in use and the benchmark's words."""
    clean = derived.cleaned(spark, folder).select("ingest_seq", "content")
    chars = clean.select(F.explode(F.array_distinct(F.split("content", ""))).alias("c")).distinct()
    whole = table(spark, folder, "benchmark").select(F.explode(split_words(F.col("text"))).alias("piece"))
    vocabulary = chars.select(F.explode(F.array("c", F.concat(F.lit("##"), "c"))).alias("piece")).unionByName(whole)
    return wordpiece.with_pieces(clean, vocabulary).select(
        "ingest_seq", F.array_join("tokenized_content", " ").alias("pieces"))


def _stub():
    def model(prompt: str) -> str:
        if "?" in prompt:
            raise ValueError("no answer")
        return f"  {len(prompt)}  "
    return model


def answered_messages(spark, folder):
    """The answer job with a deterministic stand-in for a model."""
    asked = derived.messages(spark, folder).filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = ask_once(asked, lambda: one_by_one(_stub()))
    plain = retrieval.answer(asked, _stub, "failed: {error}", answers=answers).withColumnRenamed("result", "plain_result")
    return retrieval.answer(plain.drop("error"), _stub, "failed: {error}", trim=True, answers=answers).select(
        "conv_id", "turn", F.col("plain_result").alias("result"), F.col("result").alias("trimmed_result"), "error")


def answers_in_history(spark, folder):
    """One answered message appended after the pairs of each conversation."""
    pairs = conversations.pair_turns(derived.messages(spark, folder))
    last = conversations.last_user_message(derived.messages(spark, folder)).select(
        "conv_id", F.col("last_user_message").alias("user"),
        F.length("last_user_message").cast("string").alias("assistant"))
    return conversations.append_answers(pairs, last)


def mmr_select(spark, folder):
    return _long(retrieval.diverse(derived.vectors(spark, folder), derived.vector_queries(spark, folder),
                                   skip_self=True), "rank")


QUERIES = {f.__name__: f for f in (
    knn_top10, knn_label_profiles, knn_blockwise, knn_stored_cells, hits_above_threshold, knn_threshold_floor, retrieval_quality,
    context_block, chunk_context, reference_lines, document_hits, retriever_hits, hit_lists, source_strings,
    context_dedup, review_index, hash_embed_reviews, wordpiece_reviews, review_prompts, chat_states, answered_states, handled_history, answered_messages, answers_in_history,
    mmr_select)}

_KNN = f"WITH {TOP10} SELECT query_id, vec_id, score, rank FROM top10"
_HITS = f"WITH {SELECTED}, {CONTENTS}, hits AS (SELECT s.*, c.* EXCLUDE (vec_id) FROM selected s JOIN contents c USING (vec_id))"
_RATING = "CASE WHEN rating IS NOT NULL THEN '|rating=' || CAST(rating AS VARCHAR) ELSE '' END"
_HIT_SOURCE = f"""'review|' || coalesce(date, '') || {_RATING} || CASE WHEN platform IS NOT NULL THEN '|' || platform ELSE '' END"""
_CHUNK_SOURCE = f"coalesce(platform, 'review') || '|' || coalesce(subject, place, '') || '|' || coalesce(date, '') || {_RATING}"
_QUALITY = """SELECT query_id, max(total_found) AS total_found, max(filtered_count) AS filtered_count, count(*) AS used_count,
    round(avg(score), 6) AS avg_similarity, max(score) AS max_similarity, min(score) AS min_similarity,
    CASE WHEN avg(score) < 0.5 THEN 'low' WHEN avg(score) > 0.7 THEN 'high' ELSE 'none' END AS confidence
    FROM selected GROUP BY query_id"""
_INDEX = f"""review_index AS (SELECT row_number() OVER (ORDER BY site, ingest_seq) - 1 AS vec_id, ingest_seq, content,
    site AS platform, '롯데월드' AS place, strftime(date, '%Y-%m-%d') AS date, rating FROM clean WHERE length({trimmed('content')}) > 10)"""
_SEARCH = f"""{hashed('review_index', 'vec_id', 'content', 'doc_vec')}, {hashed('asked', 'query_id', 'question', 'ask_vec')},
        all_pairs AS (SELECT a.query_id, r.vec_id, 0 AS s FROM asked a CROSS JOIN review_index r),
        shared AS (SELECT query_id, vec_id, sum(CAST(a.w AS DOUBLE) * CAST(d.w AS DOUBLE)) AS s
          FROM ask_vec a JOIN doc_vec d USING (slot) GROUP BY ALL),
        ranked AS (SELECT p.query_id, p.vec_id, round(coalesce(s.s, 0), 6) + 0 AS score,
          row_number() OVER (PARTITION BY p.query_id ORDER BY score DESC, p.vec_id) AS rank
          FROM all_pairs p LEFT JOIN shared s USING (query_id, vec_id) QUALIFY rank <= 10),
        {selected('ranked')}, figures AS ({_QUALITY}),
        lists AS (SELECT query_id, string_agg(concat_ws('|', rank, vec_id, platform, date, format('{{:.6f}}', score), content),
          chr(10) ORDER BY rank) AS retrieved_reviews FROM selected JOIN review_index USING (vec_id) GROUP BY query_id),
        ctx AS (SELECT query_id, string_agg(content || chr(10) || '(source: ' || {_HIT_SOURCE} || ', similarity: ' ||
          format('{{:.3f}}', score) || ')', chr(10) || chr(10) ORDER BY rank) AS context
          FROM selected JOIN review_index USING (vec_id) GROUP BY query_id)"""
_TEMPLATE = PROMPT_REVIEW.replace("'", "''")
_HEAD, _REST = _TEMPLATE.split("{context}")
_MIDDLE, _TAIL = _REST.split("{question}")



def _diverse_sql(k: int) -> str:
    """The greedy selection, one step per common table."""
    dot = "round(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6)"
    steps = f"""cand AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 25),
        near AS (SELECT a.query_id, a.vec_id, b.vec_id AS other, {dot} AS s FROM cand a JOIN cand b USING (query_id)
          JOIN embeddings x ON x.vec_id = a.vec_id JOIN embeddings y ON y.vec_id = b.vec_id),
        chosen1 AS (SELECT query_id, vec_id, score, 1 AS rank FROM cand
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1)"""
    for n in range(2, k + 1):
        steps += f""",
        value{n} AS (SELECT c.query_id, c.vec_id, c.score, round(0.5 * c.score - 0.5 * max(n.s), 6) AS value
          FROM cand c JOIN near n USING (query_id, vec_id) JOIN chosen{n - 1} o ON o.query_id = n.query_id AND o.vec_id = n.other
          WHERE (c.query_id, c.vec_id) NOT IN (SELECT (query_id, vec_id) FROM chosen{n - 1})
          GROUP BY c.query_id, c.vec_id, c.score),
        chosen{n} AS (SELECT * FROM chosen{n - 1} UNION ALL SELECT query_id, vec_id, score, {n} FROM value{n}
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, vec_id) = 1)"""
    return f"WITH {PAIRS}, {steps} SELECT query_id, vec_id, score, CAST(rank AS BIGINT) AS rank FROM chosen{k}"


SQL = {
    "mmr_select": _diverse_sql(5),
    # every character is a piece, so a word is its longest known beginning and then single characters
    "wordpiece_reviews": f"""WITH {CLEAN}, whole AS (SELECT DISTINCT unnest({words('text')}) AS piece FROM benchmark),
        toks AS (SELECT ingest_seq, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word
          FROM (SELECT ingest_seq, {words("replace(content, '_', ' _ ')")} AS w FROM clean)),
        starts AS (SELECT word, unnest(range(1, length(word) + 1)) AS n FROM (SELECT DISTINCT word FROM toks)),
        longest AS (SELECT word, max(n) AS n FROM starts LEFT JOIN whole ON piece = substr(word, 1, n)
          WHERE n = 1 OR piece IS NOT NULL GROUP BY word),
        cut AS (SELECT word, CASE WHEN length(word) > 100 THEN ['[UNK]'] ELSE list_concat([substr(word, 1, n)],
          list_transform(range(n + 1, length(word) + 1), lambda i: '##' || substr(word, i, 1))) END AS pieces FROM longest)
        SELECT ingest_seq, array_to_string(list_slice(flatten(list(pieces ORDER BY place)), 1, 250), ' ') AS pieces
        FROM toks JOIN cut USING (word) GROUP BY ingest_seq""",
    "knn_top10": _KNN,
    "knn_blockwise": _KNN,
    "knn_stored_cells": _KNN,
    "knn_label_profiles": """WITH parts AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS place, unnest(embedding)::DOUBLE AS x FROM embeddings),
        means AS (SELECT label, place, avg(x) AS x FROM parts GROUP BY ALL),
        profiles AS (SELECT CAST(label AS BIGINT) AS query_id,
          list(CAST(CAST(x / n AS FLOAT) AS DOUBLE) ORDER BY place) AS embedding
          FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM means) GROUP BY label)
        SELECT query_id, vec_id, round(list_dot_product(q.embedding, CAST(v.embedding AS DOUBLE[])), 6) AS score,
          row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
        FROM profiles q CROSS JOIN embeddings v QUALIFY rank <= 10""",
    "hits_above_threshold": f"WITH {TOP10} SELECT query_id, vec_id, score, rank FROM top10 WHERE score >= 0.4",
    "knn_threshold_floor": f"WITH {SELECTED} SELECT * FROM selected",
    "retrieval_quality": f"WITH {SELECTED} {_QUALITY}",
    "context_block": f"""{_HITS} SELECT query_id, string_agg(content || chr(10) || '(source: ' || {_HIT_SOURCE} ||
        ', similarity: ' || format('{{:.3f}}', score) || ')', chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id""",
    "chunk_context": f"""{_HITS}, firsts AS (SELECT * FROM hits
          QUALIFY row_number() OVER (PARTITION BY query_id, {trimmed('content')} ORDER BY rank) = 1)
        SELECT query_id, string_agg('[Chunk]' || chr(10) || content || chr(10) || '(meta: source=' || {_CHUNK_SOURCE} || ')',
          chr(10) || chr(10) ORDER BY rank) AS context FROM firsts GROUP BY query_id""",
    "reference_lines": f"""{_HITS}, l AS (SELECT *, replace({trimmed('content')}, chr(10), ' ') AS line FROM hits)
        SELECT query_id, string_agg('   - "' || CASE WHEN length(line) > 40 THEN substr(line, 1, 40) || '...' ELSE line END ||
          '" (플랫폼: ' || coalesce(platform, '') || ', 평점: ' || coalesce(CAST(rating AS VARCHAR), '') || ', 날짜: ' ||
          coalesce(date, '') || ')', chr(10) ORDER BY rank) AS "references" FROM l GROUP BY query_id
        UNION ALL SELECT q.query_id, '{NO_REFERENCES}' FROM (SELECT vec_id AS query_id FROM embeddings UNION ALL SELECT -1) q
          WHERE q.query_id NOT IN (SELECT query_id FROM hits)""",
    "document_hits": f"""{_HITS} SELECT query_id, rank, content AS chunk, coalesce(platform, 'unknown') AS platform, place,
        coalesce(date, '') AS date, rating, vec_id AS source_row, vec_id AS chunk_index, score FROM hits""",
    "retriever_hits": f"""{_HITS} SELECT query_id, rank, content AS chunk, platform, subject, place, date, rating, '' AS url, score FROM hits""",
    "hit_lists": f"""{_HITS} SELECT query_id, string_agg(concat_ws('|', rank, vec_id, vec_id, coalesce(platform, 'unknown'), place,
          coalesce(date, ''), CAST(rating AS VARCHAR), format('{{:.6f}}', score), content), chr(10) ORDER BY rank) AS hits
        FROM hits GROUP BY query_id""",
    "source_strings": f"WITH {CONTENTS} SELECT vec_id, {_HIT_SOURCE} AS hit_source, {_CHUNK_SOURCE} AS chunk_source FROM contents",
    "context_dedup": f"SELECT lang AS query_id, min(doc_id) AS rank FROM documents GROUP BY lang, {trimmed('text')}",
    "review_index": f"WITH {CLEAN}, {_INDEX} SELECT vec_id, content, platform, place, date, rating FROM review_index",
    "hash_embed_reviews": f"""WITH {CLEAN}, {hashed('clean', 'ingest_seq', 'content', 'vec')}
        SELECT ingest_seq, slot, round(CAST(w AS DOUBLE), 6) AS w FROM vec""",
    "review_prompts": f"""WITH {CLEAN}, {_INDEX},
        asked AS (SELECT conv_id * 4294967296 + turn AS query_id, text AS question FROM conversations WHERE role = 'user'),
        {_SEARCH}
        SELECT query_id, question, context, '{_HEAD}' || context || '{_MIDDLE}' || {trimmed('question')} || '{_TAIL}' AS prompt,
          CAST(NULL AS VARCHAR) AS reply, retrieved_reviews, total_found, filtered_count, used_count, avg_similarity,
          max_similarity, min_similarity, confidence,
          CASE confidence WHEN 'low' THEN '{NOTE_LOW}' WHEN 'high' THEN '{NOTE_HIGH}'
            ELSE '' END AS note
        FROM asked JOIN ctx USING (query_id) JOIN figures USING (query_id) JOIN lists USING (query_id)""",
    "chat_states": f"""WITH {CLEAN}, {_INDEX}, {USER_MESSAGES}, {MENTIONS},
        routed AS (SELECT conv_id * 4294967296 + turn AS query_id, msg_id, text,
          {keyword_case('text', REVIEW_WORDS, INFO_WORDS)} AS routing_decision FROM user_messages),
        asked AS (SELECT query_id, text AS question FROM routed WHERE routing_decision = 'rag_review'),
        {_SEARCH}, subject_messages AS (SELECT * FROM routed WHERE routing_decision = 'subject_info'),
        {resolve_sql('subject_messages')}, described AS (SELECT pos, {MARKDOWN} AS details FROM subjects_v)
        SELECT r.query_id AS msg_id, r.routing_decision, {trimmed('question')} AS review_query, context AS rag_context, retrieved_reviews,
          total_found, filtered_count, used_count, avg_similarity, max_similarity, min_similarity, confidence,
          CASE confidence WHEN 'low' THEN '{NOTE_LOW}' WHEN 'high' THEN '{NOTE_HIGH}' WHEN 'none' THEN '' END AS note,
          CAST(NULL AS VARCHAR) AS reply, detected_category, extracted_subject, found_subject_name,
          info_type, data_source, CASE r.routing_decision
            WHEN 'rag_review' THEN '{_HEAD}' || context || '{_MIDDLE}' || {trimmed('question')} || '{_TAIL}'
            WHEN 'subject_info' THEN {subject_prompt('s.text')} ELSE {quoted(PROMPT_CHAT)} END AS prompt
        FROM routed r LEFT JOIN asked a USING (query_id) LEFT JOIN ctx USING (query_id) LEFT JOIN figures USING (query_id)
        LEFT JOIN lists USING (query_id)
        LEFT JOIN resolved_messages s ON s.query_id = r.query_id LEFT JOIN described ON pos = s.subject_pos""",
    "answers_in_history": f"""WITH {TURNS}, spoken AS (SELECT conv_id, max_by(text, turn) FILTER (role = 'user' AND text <> '') AS t
          FROM conversations GROUP BY conv_id)
        SELECT * FROM turn_pairs UNION ALL
        SELECT conv_id, coalesce((SELECT max(pair_no) FROM turn_pairs p WHERE p.conv_id = s.conv_id), 0) + 1, coalesce(t, ''),
          CAST(length(coalesce(t, '')) AS VARCHAR) FROM spoken s""",
    "answered_messages": """SELECT conv_id, turn,
        CASE WHEN contains(text, '?') THEN 'failed: no answer' ELSE '  ' || length(text) || '  ' END AS result,
        CASE WHEN contains(text, '?') THEN 'failed: no answer' ELSE CAST(length(text) AS VARCHAR) END AS trimmed_result,
        CASE WHEN contains(text, '?') THEN 'no answer' END AS error FROM conversations WHERE role = 'user'""",
}

_FAILED = "length(prompt) % 3 = 0"
_SAID = f"""said AS (SELECT msg_id >> 32 AS conv_id, msg_id & 4294967295 AS turn, s.*,
      CASE routing_decision WHEN 'chat' THEN CASE WHEN {_FAILED} THEN '{REPLY_CHAT_FAILED}' ELSE length(prompt)::VARCHAR END
        WHEN 'rag_review' THEN CASE WHEN {_FAILED} THEN replace('{REPLY_REVIEW_FAILED}', '{{error}}', 'no answer')
          ELSE ' ' || length(prompt) || ' ' END END AS said FROM ({SQL["chat_states"]}) s)"""
SQL["answered_states"] = f"""WITH {_SAID} SELECT conv_id, turn, routing_decision,
    CASE routing_decision WHEN 'rag_review' THEN said || CASE WHEN {_FAILED} THEN '' ELSE note END
      WHEN 'subject_info' THEN CASE WHEN {_FAILED} THEN replace('{REPLY_SUBJECT_FAILED}', '{{subject}}', extracted_subject)
        ELSE ' ' || length(prompt) || ' ' END ELSE said END AS result,
    said, CASE WHEN {_FAILED} AND routing_decision <> 'chat' THEN 'no answer' END AS error FROM said"""
SQL["handled_history"] = f"""WITH {TURNS}, {USER_MESSAGES}, {_SAID},
    ends AS (SELECT conv_id, max(pair_no) AS last_no FROM turn_pairs GROUP BY conv_id)
    SELECT conv_id, pair_no, "user", assistant FROM turn_pairs UNION ALL
    SELECT conv_id, coalesce(last_no, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn), text, said
    FROM said JOIN user_messages USING (conv_id, turn) LEFT JOIN ends USING (conv_id) WHERE said IS NOT NULL"""
