"""Conversation, routing and subject queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewloom.fixed_values import (INFO_WORDS, PROMPT_CHAT, PROMPT_INTENT, PROMPT_SUBJECT_FOUND,
                                     PROMPT_SUBJECT_MISSING, PROMPT_SUBJECT_SYSTEM, REVIEW_WORDS)
from reviewloom.operators import conversations, routing, subjects
from reviewloom.plans import derived
from reviewloom.plans.oracle_parts import MENTIONS, SUBJECTS, TURNS, USER_MESSAGES, extracted, trimmed



# --- conversations ----------------------------------------------------------
def turn_pairs(spark, folder):
    return conversations.pair_turns(derived.messages(spark, folder))


def last_n_turns(spark, folder):
    return conversations.last_turns(turn_pairs(spark, folder), 2)


def history_lists(spark, folder):
    lists = conversations.history(turn_pairs(spark, folder))
    shown = F.transform("conversation_history", lambda p: F.concat_ws(" => ", p["user"], p["assistant"]))
    return lists.select("conv_id", F.size("conversation_history").cast("long").alias("n"),
                        F.array_join(shown, "\n").alias("history"))


def last_user_message(spark, folder):
    return conversations.last_user_message(derived.messages(spark, folder))


def transcript(spark, folder):
    return conversations.transcript(turn_pairs(spark, folder))


# --- routing ----------------------------------------------------------------
def route_messages(spark, folder):
    return routing.route(derived.user_messages(spark, folder)).select("msg_id", "routing_decision", "known_route")


def route_by_language_words(spark, folder):
    """The same rule with other word lists."""
    asked = derived.messages(spark, folder)
    return routing.route(asked, review_words=("avec", "Schein", "stion"), info_words=("und ", "que")).select(
        "conv_id", "turn", "routing_decision")


def intent_json(spark, folder):
    replies = derived.model_replies(spark, folder)
    return routing.route(replies, reply_col="model_reply").select("event_id", "routing_decision", "known_route")


def intent_prompts(spark, folder):
    return routing.intent_prompts(derived.user_messages(spark, folder)).select("msg_id", "prompt")


def chat_prompts(spark, folder):
    return routing.chat_prompts(derived.user_messages(spark, folder)).select("msg_id", "prompt")


# --- subjects ---------------------------------------------------------------
def subject_mentions(spark, folder):
    return subjects.find_mentioned(derived.user_messages(spark, folder), derived.subjects(spark, folder))


def subject_lookup(spark, folder):
    found = subjects.find_by_name(derived.name_queries(spark, folder), derived.subjects(spark, folder))
    return found.select("query_id", "pos")


def subject_names(spark, folder):
    asked = derived.questions(spark, folder)
    return asked.select("msg_id", "text", subjects.extract_name(F.col("text")).alias("extracted_subject"))


def _resolved(spark, folder) -> DataFrame:
    return subjects.resolve_messages(derived.user_messages(spark, folder), derived.subjects(spark, folder))


def resolve_messages(spark, folder):
    return _resolved(spark, folder).drop("text")


def resolve_questions(spark, folder):
    """Every message of either side after a request; without a known name it still finds the first subject of a category."""
    return subjects.resolve_messages(derived.requests_first(spark, folder), derived.subjects(spark, folder))


def subject_prompts(spark, folder):
    return subjects.subject_prompts(_resolved(spark, folder), derived.subjects(spark, folder)).select("msg_id", "prompt")


def subject_markdown(spark, folder):
    return derived.subjects(spark, folder).select("pos", subjects.markdown().alias("markdown"))


def ticket_prices(spark, folder):
    return subjects.ticket_prices(derived.subjects(spark, folder))


def attractions_flat(spark, folder):
    return subjects.attractions(derived.subjects(spark, folder)).withColumn("item_no", F.col("item_no").cast("long"))


def facilities_flat(spark, folder):
    return subjects.facilities(derived.subjects(spark, folder)).withColumn("item_no", F.col("item_no").cast("long"))


def visitor_tips(spark, folder):
    return subjects.visitor_tips(derived.subjects(spark, folder)).withColumn("item_no", F.col("item_no").cast("long"))


def category_counts(spark, folder):
    return subjects.category_counts(derived.subjects(spark, folder))


def category_members(spark, folder):
    """The subjects of every category."""
    return subjects.category_members(derived.subjects(spark, folder))


QUERIES = {f.__name__: f for f in (
    turn_pairs, last_n_turns, history_lists, last_user_message, transcript, route_messages, route_by_language_words,
    intent_json, intent_prompts, chat_prompts, subject_mentions, subject_lookup, subject_names, resolve_messages,
    resolve_questions, subject_prompts, subject_markdown, ticket_prices, attractions_flat, facilities_flat,
    visitor_tips, category_counts, category_members)}


def _any_of(c: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w.lower()}')" for w in words) + ")"


def keyword_case(c: str, review, info) -> str:
    return (f"CASE WHEN {trimmed(c)} = '' THEN 'chat' WHEN {_any_of(c, review)} THEN 'rag_review' "
            f"WHEN {_any_of(c, info)} THEN 'subject_info' ELSE 'chat' END")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _around(template: str, **columns: str) -> str:
    """SQL that fills a template's names with columns."""
    sql = quoted(template)
    for name, column in columns.items():
        sql = sql.replace("{" + name + "}", "' || " + column + " || '")
    return sql


def _category(c: str) -> str:
    return f"""CASE WHEN {_any_of(c, ('테마파크', '놀이공원', '롯데월드', '어트랙션', '놀이기구', '어드벤처', '매직아일랜드'))} THEN '테마파크'
        WHEN {_any_of(c, ('관광지', '여행지', '명소'))} THEN '관광지' WHEN {_any_of(c, ('레스토랑', '맛집', '음식점'))} THEN '레스토랑'
        WHEN {_any_of(c, ('호텔', '숙박', '리조트'))} THEN '호텔' END"""


def resolve_sql(source: str) -> str:
    return f"""by_category AS (SELECT category, min(pos) AS pos FROM subjects_v GROUP BY category),
keyed AS (SELECT m.*, n.pos AS named_pos, {_category('m.text')} AS keyword_category FROM {source} m LEFT JOIN mentions n USING (msg_id)),
chosen AS (SELECT k.*, coalesce(k.named_pos, c.pos) AS subject_pos FROM keyed k LEFT JOIN by_category c ON c.category = k.keyword_category),
resolved_messages AS (SELECT c.*, s.name AS found_subject_name, {extracted('c.text')} AS extracted_subject,
  CASE WHEN named_pos IS NOT NULL THEN s.category ELSE coalesce(keyword_category, 'general') END AS detected_category,
  CASE WHEN s.name IS NOT NULL THEN 'subject_information' ELSE 'general_information' END AS info_type,
  CASE WHEN s.name IS NOT NULL THEN 'json_database' ELSE 'llm_general' END AS data_source
  FROM chosen c LEFT JOIN subjects_v s ON s.pos = c.subject_pos)"""


_RESOLVED = f"WITH {USER_MESSAGES}, {MENTIONS}, {resolve_sql('user_messages')}"
_OUT = "detected_category, extracted_subject, subject_pos, found_subject_name, info_type, data_source"

MARKDOWN = """concat_ws(chr(10), '## 📍 ' || name, '**카테고리**: ' || category,
    CASE WHEN p_size % 7 <> 0 THEN '**위치**: ' || p_brand END,
    CASE WHEN p_size % 2 = 1 THEN concat_ws(chr(10), chr(10) || '**교통편**', '🚇 **지하철**: ' || p_brand,
      CASE WHEN p_size % 5 = 0 THEN '🚌 **버스**: ' || p_type END) END,
    CASE WHEN p_size % 5 <> 0 THEN chr(10) || '**소개**' || chr(10) || name || ' ' || p_type END,
    CASE WHEN p_size % 5 = 1 THEN chr(10) || '**운영시간**' || chr(10) || '10:00 ~ 21:00' END,
    CASE WHEN p_size % 6 = 1 THEN chr(10) || '**휴무일**: 연중무휴' END,
    CASE WHEN p_size % 2 = 0 THEN concat_ws(chr(10), chr(10) || '**티켓 정보**', '  🎫 **1일권**: 성인: ' || won || ', 청소년: ' || won,
        '  💰 **discount**: ' || p_type)
      WHEN p_size % 3 = 0 THEN concat_ws(chr(10), chr(10) || '**티켓 정보**', '  🎫 **after4**: 어린이: ' || won) END,
    CASE WHEN p_size % 4 = 0 THEN concat_ws(chr(10), chr(10) || '**주요 어트랙션**', chr(10) || '🎢 **실내**',
      '  • **1층**: ' || name || ', ' || p_brand, chr(10) || '🎢 **실외**', '  • ' || p_type) END,
    CASE WHEN p_size % 3 <> 0 THEN concat_ws(chr(10), chr(10) || '**시설 안내**', '  🏢 **실내**: ' || p_brand || ', ' || p_type,
      '  🏢 **연결**: ' || name) END,
    CASE WHEN p_size % 4 <> 3 THEN concat_ws(chr(10), chr(10) || '**방문 팁**', '  💡 ' || p_type, '  💡 ' || p_brand) END,
    CASE WHEN p_size % 9 <> 0 THEN chr(10) || '**공식 웹사이트**' || chr(10) || 'https://example.com/' || pos END)"""



def subject_prompt(text: str) -> str:
    system = quoted(PROMPT_SUBJECT_SYSTEM)
    found = _around(PROMPT_SUBJECT_FOUND, system=system, name="found_subject_name", details="details", question=text)
    missing = _around(PROMPT_SUBJECT_MISSING, system=system, name="extracted_subject", question=text)
    return f"CASE WHEN found_subject_name IS NOT NULL THEN {found} ELSE {missing} END"


SQL = {
    "turn_pairs": f"WITH {TURNS} SELECT * FROM turn_pairs",
    "last_n_turns": f"WITH {TURNS} SELECT * FROM turn_pairs QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pair_no DESC) <= 2",
    "history_lists": f"""WITH {TURNS}, recent AS (SELECT * FROM turn_pairs
          QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pair_no DESC) <= 5)
        SELECT conv_id, count(*) AS n, string_agg("user" || ' => ' || assistant, chr(10) ORDER BY pair_no) AS history
        FROM recent GROUP BY conv_id""",
    "last_user_message": """SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'user' AND text <> ''), '') AS last_user_message
        FROM conversations GROUP BY conv_id""",
    "transcript": f"""WITH {TURNS} SELECT conv_id, pair_no, '[chat] 사용자: ' || "user" || chr(10) || '챗봇: ' || assistant || chr(10) AS entry
        FROM turn_pairs""",
    "route_messages": f"""WITH {USER_MESSAGES} SELECT msg_id, {keyword_case('text', REVIEW_WORDS, INFO_WORDS)} AS routing_decision,
        true AS known_route FROM user_messages""",
    "route_by_language_words": f"""SELECT conv_id, turn, {keyword_case('text', ('avec', 'Schein', 'stion'), ('und ', 'que'))}
        AS routing_decision FROM conversations""",
    "intent_json": f"""WITH r AS (SELECT event_id, event_type, (['티켓 얼마', '리뷰 요약', '안녕하세요', '  '])[user_id % 4 + 1] AS text FROM events)
        SELECT event_id, CASE WHEN {trimmed('text')} = '' THEN 'chat' WHEN event_type = 'view' THEN 'subject_info'
          WHEN event_type = 'purchase' THEN 'rag_review' WHEN event_type = 'click' THEN 'chat'
          ELSE {keyword_case('text', REVIEW_WORDS, INFO_WORDS)} END AS routing_decision, true AS known_route FROM r""",
    "intent_prompts": f"""WITH {USER_MESSAGES} SELECT msg_id, {_around(PROMPT_INTENT, user_message=trimmed('text'))} AS prompt FROM user_messages""",
    "chat_prompts": f"WITH {USER_MESSAGES} SELECT msg_id, {quoted(PROMPT_CHAT)} AS prompt FROM user_messages",
    "subject_mentions": f"WITH {USER_MESSAGES}, {MENTIONS} SELECT * FROM mentions",
    "subject_lookup": f"""WITH {SUBJECTS}, typed AS (SELECT pos AS query_id, lower(CASE p_size % 3 WHEN 0 THEN name
          WHEN 1 THEN split_part(name, ' ', 2) ELSE name || ' ' || p_brand END) AS probe FROM subjects_v)
        SELECT query_id, min(n.pos) AS pos FROM typed t LEFT JOIN names n ON contains(t.probe, n.low) OR contains(n.low, t.probe)
        GROUP BY query_id""",
    "subject_names": f"""WITH q AS (SELECT p_partkey AS msg_id, p_name || (['에 대해', '에 대한', ' 정보', ' 알려', '는', '이', ' 설명', ' 소개',
          '에 대해 설명', '는 정보', ' 주세요', ''])[p_size % 12 + 1] AS text FROM part)
        SELECT msg_id, text, {extracted('text')} AS extracted_subject FROM q""",
    "resolve_messages": f"{_RESOLVED} SELECT msg_id, conv_id, turn, {_OUT} FROM resolved_messages",
    "resolve_questions": f"""WITH user_messages AS (SELECT conv_id || ':' || turn AS msg_id,
          concat_ws(' ', (['호텔', '맛집 추천', '관광지', '가격', '안녕'])[(conv_id + turn) % 5 + 1], text) AS text FROM conversations),
        {MENTIONS}, {resolve_sql('user_messages')} SELECT msg_id, text, {_OUT} FROM resolved_messages""",
    "subject_prompts": f"""{_RESOLVED}, described AS (SELECT pos, {MARKDOWN} AS details FROM subjects_v)
        SELECT msg_id, {subject_prompt('text')} AS prompt
        FROM resolved_messages LEFT JOIN described ON pos = subject_pos""",
    "subject_markdown": f"WITH {SUBJECTS} SELECT pos, {MARKDOWN} AS markdown FROM subjects_v",
    "ticket_prices": f"""WITH {SUBJECTS}, t AS (
          SELECT pos, name, '1일권' AS ticket, unnest(['adult', 'teen', 'senior']) AS age_group, unnest([won, won, p_brand]) AS price_text
            FROM subjects_v WHERE p_size % 2 = 0
          UNION ALL SELECT pos, name, 'discount', NULL, p_type FROM subjects_v WHERE p_size % 2 = 0
          UNION ALL SELECT pos, name, 'after4', 'child', won FROM subjects_v WHERE p_size % 2 <> 0 AND p_size % 3 = 0)
        SELECT *, CASE WHEN age_group IS NOT NULL THEN TRY_CAST(regexp_replace(price_text, '[^0-9]', '', 'g') AS BIGINT) END AS price_krw FROM t""",
    "attractions_flat": f"""WITH {SUBJECTS} SELECT pos, name, '실내' AS area, '1층' AS sub_area, unnest([0, 1])::BIGINT AS item_no,
          unnest([name, p_brand]) AS attraction FROM subjects_v WHERE p_size % 4 = 0
        UNION ALL SELECT pos, name, '실외', NULL, 0, p_type FROM subjects_v WHERE p_size % 4 = 0""",
    "facilities_flat": f"""WITH {SUBJECTS} SELECT pos, name, '실내' AS facility_type, unnest([0, 1])::BIGINT AS item_no,
          unnest([p_brand, p_type]) AS facility FROM subjects_v WHERE p_size % 3 <> 0
        UNION ALL SELECT pos, name, '연결', 0, name FROM subjects_v WHERE p_size % 3 <> 0""",
    "visitor_tips": f"""WITH {SUBJECTS} SELECT pos, name, unnest([0, 1])::BIGINT AS item_no, unnest([p_type, p_brand]) AS tip
        FROM subjects_v WHERE p_size % 4 <> 3""",
    "category_counts": f"WITH {SUBJECTS} SELECT category, count(*) AS n FROM subjects_v GROUP BY category",
    "category_members": f"WITH {SUBJECTS} SELECT category, pos, name FROM subjects_v WHERE category IS NOT NULL",
}
