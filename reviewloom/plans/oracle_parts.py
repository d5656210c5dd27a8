"""SQL for the derived tables, written for the checking engine (RE2 patterns)."""

from reviewloom.fixed_values import NAME_ENDINGS, NAME_STOPWORDS

# whitespace and "not word, not whitespace" as Python sees them, for an ASCII-only \s
WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SITE_LIST = "['kakaomap','myrealtrip','tripdotcom']"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '\\A[{WS}]+|[{WS}]+\\z', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[{WS}]+'), lambda w: w <> '')"


REVIEWS = f"""reviews_v AS (
  SELECT doc_id, line_no, {SITE_LIST}[doc_id % 3 + 1] AS site, doc_id * 4294967296 + line_no AS ingest_seq,
    CASE WHEN doc_id % 11 <> 0 THEN CAST((doc_id + line_no) % 7 AS DOUBLE) END AS rating,
    TIMESTAMP '2021-06-01' + to_days(CAST((doc_id * 37 + line_no) % 1600 AS INTEGER)) AS date, content
  FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS content,
               unnest(range(1, len(str_split(text, chr(10))) + 1)) AS line_no FROM documents))"""

STRIP = f"replace(regexp_replace(content, '[^\\p{{L}}\\p{{N}}_{WS}]', '', 'g'), chr(10), '')"

CLEAN = REVIEWS + f""",
stripped AS (SELECT site, ingest_seq, rating, date, {STRIP} AS c FROM reviews_v
  WHERE content IS NOT NULL AND rating BETWEEN 1 AND 5
    AND date BETWEEN TIMESTAMP '2022-01-01' AND TIMESTAMP '2025-01-01'),
ruled AS (SELECT site, ingest_seq, rating, date, length(c) AS review_length, {trimmed('c')} AS content
  FROM stripped WHERE length(c) > 5 AND length(c) < 250),
first_rows AS (SELECT * FROM ruled QUALIFY row_number() OVER (PARTITION BY site, content ORDER BY ingest_seq) = 1),
clean AS (SELECT *, dayname(date) AS weekday, length(content) AS text_length,
  list_slice({words('content')}, 1, 250) AS tokens FROM first_rows)"""

# --- vectors ----------------------------------------------------------------
PAIRS = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id,
    round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id)"""
TOP10 = PAIRS + """,
top10 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
  QUALIFY rank <= 10)"""


def selected(top: str) -> str:
    return f"""counted AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total_found,
    count(*) FILTER (score >= 0.4) OVER (PARTITION BY query_id) AS n_pass FROM {top}),
kept AS (SELECT *, CASE WHEN n_pass < 3 AND total_found >= 3 THEN 3
    WHEN n_pass = 0 THEN least(1, total_found) ELSE n_pass END AS filtered_count FROM counted),
selected AS (SELECT query_id, vec_id, score, rank, total_found, filtered_count FROM kept
  WHERE rank <= least(filtered_count, 5))"""


SELECTED = TOP10 + ",\n" + selected("top10")

CONTENTS = f"""contents AS (SELECT doc_id AS vec_id, text AS content,
    CASE WHEN doc_id % 4 <> 0 THEN {SITE_LIST}[doc_id % 3 + 1] END AS platform,
    CASE WHEN doc_id % 5 <> 0 THEN lang END AS subject, '롯데월드' AS place,
    CASE WHEN doc_id % 6 <> 0 THEN source END AS date,
    CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 5 + 1 AS DOUBLE) END AS rating FROM documents)"""

# sparse form of the hashed token vectors
def hashed(source: str, id_col: str, text: str, name: str) -> str:
    return f"""{name}_t AS (SELECT {id_col}, md5(unnest({words(f'lower({text})')})) AS h FROM {source}),
{name}_c AS (SELECT {id_col}, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS slot,
    sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS n FROM {name}_t GROUP BY ALL),
{name} AS (SELECT {id_col}, slot, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {id_col})) AS FLOAT) AS w
  FROM {name}_c WHERE n <> 0)"""


# --- conversations ----------------------------------------------------------
TURNS = """turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  WHERE role IN ('user', 'assistant')),
opened AS (SELECT *, role = 'user' OR NOT coalesce(lag(role = 'user' OR text = '')
    OVER (PARTITION BY conv_id ORDER BY turn), false) AS opens FROM turns),
numbered AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS pair_no FROM opened),
turn_pairs AS (SELECT conv_id, CAST(pair_no AS BIGINT) AS pair_no,
    max(CASE WHEN role = 'user' THEN text ELSE '' END) AS "user",
    max(CASE WHEN role = 'user' THEN '' ELSE text END) AS assistant FROM numbered GROUP BY ALL)"""

USER_MESSAGES = """user_messages AS (SELECT conv_id || ':' || turn AS msg_id, conv_id, turn,
    concat_ws(' ', text, (['후기 알려줘', '가격 정보', '호텔 위치', '맛집 추천', '안녕'])[(conv_id + turn) % 5 + 1]) AS text
  FROM conversations WHERE role = 'user')"""

# --- subjects ---------------------------------------------------------------
SUBJECTS = """subjects_v AS (SELECT p_partkey AS pos, p_name AS name, lower(p_name) AS low,
    CASE p_type WHEN 'SMALL' THEN '호텔' WHEN 'PROMO' THEN '레스토랑' WHEN 'LARGE' THEN '관광지' ELSE p_type END AS category,
    p_brand, p_type, p_size, format('{:,}원', p_size * 1000) AS won FROM part),
names AS (SELECT low, min(pos) AS pos FROM subjects_v GROUP BY low)"""

MENTIONS = SUBJECTS + """,
name_words AS (SELECT w, min(pos) AS pos FROM (
    SELECT low AS w, pos FROM names UNION ALL SELECT unnest(str_split(low, ' ')), pos FROM names) GROUP BY w),
mentioned AS (SELECT m.msg_id, min(n.pos) AS pos FROM user_messages m JOIN name_words n
    ON contains(lower(m.text), n.w) GROUP BY m.msg_id),
resolved AS (SELECT s.pos AS mentioned, min(n.pos) AS pos FROM subjects_v s JOIN names n
    ON contains(s.low, n.low) OR contains(n.low, s.low) GROUP BY s.pos),
mentions AS (SELECT m.msg_id, r.pos FROM mentioned m JOIN resolved r ON m.pos = r.mentioned)"""


def extracted(text: str) -> str:
    stops = " AND ".join(f"NOT contains(w, '{s}')" for s in NAME_STOPWORDS)
    left = f"list_filter({words(text)}, lambda w: {stops})"
    cases = " ".join(
        f"WHEN regexp_matches({text}, '[^\\n]+?{e}') THEN " + trimmed(f"regexp_extract({text}, '([^\\n]+?){e}', 1)")
        for e in NAME_ENDINGS)
    return f"CASE {cases} WHEN len({left}) > 0 THEN array_to_string({left}, ' ') ELSE {text} END"


# --- users ------------------------------------------------------------------
USERS = """all_users AS (SELECT lower(replace(c_name, '#', '.')) || '@example.com' AS email,
    'pw' || c_custkey AS password, c_name AS username, c_acctbal FROM customer),
users AS (SELECT email, password, username FROM all_users WHERE c_acctbal >= 0),
named_orders AS (SELECT *, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name FROM orders),
changes AS (SELECT o_orderkey AS seq,
    (['register', 'upsert', 'update', 'delete', 'login'])[CAST(substr(o_orderpriority, 1, 1) AS INT)] AS op,
    lower(replace(name, '#', '.')) || '@example.com' AS email,
    CASE WHEN o_orderstatus = 'F' THEN 'pw' || o_custkey ELSE 'new' || o_orderstatus END AS password,
    name || '/' || o_orderstatus AS username FROM named_orders)"""

HISTORY = USERS + """,
events_a AS (SELECT -1 AS seq, 'load' AS op, email, password, username FROM users
    UNION ALL SELECT seq, op, email, password, username FROM changes),
events_b AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('load', 'register', 'upsert') THEN true
      WHEN op = 'delete' THEN false END IGNORE NULLS)
    OVER (PARTITION BY email ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS known FROM events_a),
events_c AS (SELECT *, op IN ('load', 'upsert') OR (op = 'register' AND NOT known) AS replaces FROM events_b),
events_d AS (SELECT *, CASE WHEN replaces OR (op = 'update' AND known) THEN password WHEN op = 'delete' THEN '' END AS set_p,
    CASE WHEN replaces THEN username WHEN op = 'delete' THEN '' END AS set_u FROM events_c),
history AS (SELECT *, last_value(set_p IGNORE NULLS) OVER w AS old_p, last_value(set_u IGNORE NULLS) OVER w AS old_u
  FROM events_d WINDOW w AS (PARTITION BY email ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
