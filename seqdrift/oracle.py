"""DuckDB twins of the registered queries (plain windows, brute force where cheap).

Each twin is written from the operator's definition, not from the Spark plan:
positions are whole-partition ``row_number``s, neighbours are ``lead``/``lag``,
ranks are full sorts. Counts are cast to BIGINT (DuckDB sums are HUGEINT).
"""

from __future__ import annotations

# ---------------------------------------------------------------- shared CTEs

CLICKS = """
clicks_raw AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS event_time, user_id,
         TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id
  FROM events
),
clicks_e AS (
  SELECT * FROM clicks_raw WHERE event_time IS NOT NULL AND user_id IS NOT NULL AND product_id IS NOT NULL
),
clicks_g AS (
  SELECT *, CASE WHEN lag(event_time) OVER w IS NULL
                   OR epoch_us(event_time) - epoch_us(lag(event_time) OVER w) > 86400000000
                 THEN 1 ELSE 0 END AS s
  FROM clicks_e WINDOW w AS (PARTITION BY user_id ORDER BY event_time, event_id)
),
clicks AS (
  SELECT event_id, event_time, user_id, product_id,
         CAST(user_id AS VARCHAR) || '-' ||
         CAST(SUM(s) OVER (PARTITION BY user_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS VARCHAR)
           AS user_session
  FROM clicks_g
)"""

BASKETS = """
baskets AS (
  SELECT CAST(row_number() OVER (PARTITION BY l.l_orderkey
                                 ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS BIGINT)
           AS event_id,
         CAST(o.o_orderdate AS TIMESTAMP) AS event_time, o.o_custkey AS user_id, l.l_partkey AS product_id,
         CAST(l.l_orderkey AS VARCHAR) AS user_session
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""

ROWS = """
rows_ AS (
  SELECT *,
         CAST(row_number() OVER (PARTITION BY user_session ORDER BY event_time, event_id) AS BIGINT) AS row_num,
         lead(product_id) OVER (PARTITION BY user_session ORDER BY event_time, event_id) AS next_item,
         count(*) OVER (PARTITION BY user_session) AS session_len
  FROM {src}
)"""

PAIRS = """
pairs AS (
  SELECT user_session, row_num, event_time, event_id, product_id AS prev_item, next_item
  FROM rows_ WHERE next_item IS NOT NULL
)"""

SPLIT = """
ev AS (SELECT *, substr(md5(user_session), 1, 4) < 'cccc' AS is_train FROM clicks)"""

VOCAB_TRAIN = """
vocab AS (
  SELECT item, freq, CAST(row_number() OVER (ORDER BY freq DESC, CAST(item AS VARCHAR)) - 1 AS BIGINT) AS idx
  FROM (SELECT product_id AS item, count(*) AS freq FROM ev WHERE is_train GROUP BY 1)
)"""

KS = "(VALUES (1), (5), (10), (20), (50)) ks(k)"


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def rows_on(src: str) -> str:
    return ROWS.format(src=src)


SQL: dict[str, str] = {}

# ---------------------------------------------------------------- A: sources
SQL["clicks"] = with_ctes(CLICKS, body="SELECT * FROM clicks")
SQL["baskets"] = with_ctes(BASKETS, body="SELECT * FROM baskets")
SQL["csv_log"] = """
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS event_time, user_id,
       TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id, CAST(user_id AS VARCHAR) AS user_session
FROM events"""
SQL["ingest_drops"] = """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE ts IS NULL) AS null_times, count(*) FILTER (WHERE user_id IS NULL) AS null_users,
       count(*) FILTER (WHERE k IS NULL) AS null_items,
       count(*) FILTER (WHERE ts IS NULL OR user_id IS NULL OR k IS NULL) AS n_dropped,
       count(*) FILTER (WHERE ts IS NOT NULL AND user_id IS NOT NULL AND k IS NOT NULL) AS n_kept
FROM (SELECT ts, user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
SQL["ingest_stats"] = with_ctes(CLICKS, body="""
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE product_id IS NULL) AS null_items,
       count(*) FILTER (WHERE user_id IS NULL) AS null_users,
       count(*) FILTER (WHERE user_session IS NULL) AS null_sessions,
       count(DISTINCT user_session) AS n_sessions, count(DISTINCT product_id) AS n_items,
       count(DISTINCT user_id) AS n_users, min(event_time) AS first_time, max(event_time) AS last_time
FROM clicks""")

# ---------------------------------------------------------------- G/B/F4/I: sessions
SQL["session_rows"] = with_ctes(CLICKS, rows_on("clicks"), body="""
SELECT user_session, event_id, row_num, product_id FROM rows_""")
SQL["session_pairs"] = with_ctes(CLICKS, rows_on("clicks"), PAIRS, body="""
SELECT user_session, row_num, prev_item, next_item FROM pairs""")
SQL["session_pairs_compat"] = with_ctes(CLICKS, rows_on("clicks"), body="""
SELECT user_session, row_num, product_id AS prev_item, next_item FROM rows_
WHERE next_item IS NOT NULL AND row_num <= session_len - 2""")
SQL["basket_pairs"] = with_ctes(BASKETS, rows_on("baskets"), PAIRS, body="""
SELECT user_session, row_num, prev_item, next_item FROM pairs""")
SQL["session_sequences"] = with_ctes(CLICKS, rows_on("clicks"), body="""
SELECT user_session, CAST((row_num - 1) // 1024 AS BIGINT) AS chunk, session_len,
       array_to_string(list(product_id ORDER BY row_num), ',') AS items
FROM rows_ WHERE session_len >= 2 GROUP BY 1, 2, 3""")
SQL["history_windows"] = with_ctes(CLICKS, rows_on("clicks"), body="""
SELECT user_session, row_num,
       array_to_string(list(product_id) OVER (PARTITION BY user_session ORDER BY row_num
                                              ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ',') AS history,
       next_item AS target
FROM rows_""")

# ---------------------------------------------------------------- flagship: split → fit → score
# Rank of a target under "followers (count desc, idx), then popular non-followers (idx)":
# a follower takes its follower rank; otherwise #followers + #non-followers more popular + 1.
SPLIT_MODEL = """
model AS (SELECT prev_item, next_item, count(*) AS cnt FROM pairs WHERE is_train GROUP BY 1, 2),
fol AS (
  SELECT m.prev_item, m.next_item, v.idx,
         row_number() OVER (PARTITION BY m.prev_item ORDER BY m.cnt DESC, v.idx, m.next_item) AS frank
  FROM model m LEFT JOIN vocab v ON v.item = m.next_item
),
nf AS (SELECT prev_item, count(*) AS nf FROM model GROUP BY 1),
tests AS (SELECT prev_item, next_item AS target, count(*) AS n FROM pairs WHERE NOT is_train GROUP BY 1, 2),
ranked AS (
  SELECT t.n,
         CASE WHEN f.frank IS NOT NULL THEN f.frank
              WHEN tv.idx IS NOT NULL THEN coalesce(nf.nf, 0) + 1 +
                (SELECT count(*) FROM vocab v2 WHERE v2.idx < tv.idx AND NOT EXISTS
                   (SELECT 1 FROM model m2 WHERE m2.prev_item = t.prev_item AND m2.next_item = v2.item))
         END AS rank
  FROM tests t
  LEFT JOIN fol f ON f.prev_item = t.prev_item AND f.next_item = t.target
  LEFT JOIN vocab tv ON tv.item = t.target
  LEFT JOIN nf ON nf.prev_item = t.prev_item
)"""

ACC_BODY = """
SELECT CAST(k AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n,
       CAST(sum(CASE WHEN rank <= k THEN n ELSE 0 END) AS BIGINT) AS hits,
       CAST(sum(CASE WHEN rank <= k THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS accuracy
FROM ranked, """ + KS + " GROUP BY k"

SQL["topk_accuracy"] = with_ctes(CLICKS, SPLIT, rows_on("ev"), PAIRS.replace(
    "SELECT user_session,", "SELECT is_train, user_session,"), VOCAB_TRAIN, SPLIT_MODEL, body=ACC_BODY)

# ---------------------------------------------------------------- D: vocabularies


def vocab_sql(src: str, col: str, where: str = "TRUE") -> str:
    return f"""
SELECT item, CAST(row_number() OVER (ORDER BY freq DESC, CAST(item AS VARCHAR)) - 1 AS BIGINT) AS idx, freq
FROM (SELECT {col} AS item, count(*) AS freq FROM {src} WHERE {col} IS NOT NULL AND {where} GROUP BY 1)"""


SQL["vocab_items"] = with_ctes(CLICKS, body=vocab_sql("clicks", "product_id"))
SQL["vocab_users"] = with_ctes(CLICKS, body=vocab_sql("clicks", "user_id"))
SQL["vocab_sessions"] = with_ctes(CLICKS, body=vocab_sql("clicks", "user_session"))
SQL["popularity"] = with_ctes(CLICKS, body="SELECT product_id AS item, count(*) AS freq FROM clicks GROUP BY 1")

SPLIT_B = """
ev AS (SELECT *, substr(md5(user_session), 1, 4) < 'cccc' AS is_train FROM baskets)"""

SQL["encoded_events"] = with_ctes(
    CLICKS, SPLIT,
    "vi AS (" + vocab_sql("ev", "product_id", "is_train") + ")",
    "vu AS (" + vocab_sql("ev", "user_id", "is_train") + ")", body="""
SELECT e.event_id, e.event_time,
       coalesce(vi.idx, (SELECT count(*) FROM vi)) AS product_index,
       coalesce(vu.idx, (SELECT count(*) FROM vu)) AS user_index
FROM ev e LEFT JOIN vi ON vi.item = e.product_id LEFT JOIN vu ON vu.item = e.user_id""")

SQL["decode_items"] = with_ctes(BASKETS, SPLIT_B, "vi AS (" + vocab_sql("ev", "product_id", "is_train") + ")", body="""
SELECT e.user_session, e.event_id, coalesce(vi.idx, (SELECT count(*) FROM vi)) AS product_index,
       vi.item AS decoded_item
FROM ev e LEFT JOIN vi ON vi.item = e.product_id""")

SQL["encode_unknown"] = with_ctes(BASKETS, SPLIT_B, "vi AS (" + vocab_sql("ev", "product_id", "is_train") + ")", body="""
SELECT e.user_session, e.event_id, coalesce(vi.idx, -1) AS product_index, vi.idx IS NULL AS is_unknown
FROM ev e LEFT JOIN vi ON vi.item = e.product_id WHERE NOT e.is_train""")

SQL["vocab_remap"] = with_ctes(
    BASKETS, SPLIT_B, "o AS (" + vocab_sql("ev", "product_id", "is_train") + ")",
    "n AS (" + vocab_sql("ev", "product_id", "NOT is_train") + ")", body="""
SELECT coalesce(o.item, n.item) AS item, o.idx AS old_idx, n.idx AS new_idx,
       CASE WHEN o.idx IS NULL THEN 'added' WHEN n.idx IS NULL THEN 'retired' ELSE 'kept' END AS status
FROM o FULL OUTER JOIN n ON o.item = n.item""")

# ---------------------------------------------------------------- C/E: splits and samples
SQL["split_sessions"] = with_ctes(CLICKS, SPLIT, body="SELECT DISTINCT user_session, is_train FROM ev")
SQL["split_sessions_exact"] = with_ctes(CLICKS, body="""
SELECT user_session, row_number() OVER (ORDER BY md5(user_session)) <= (count(*) OVER ()) * 80 // 100 AS is_train
FROM (SELECT DISTINCT user_session FROM clicks)""")
SQL["split_semi"] = with_ctes(CLICKS, SPLIT, body="""
SELECT event_id, user_session FROM clicks
WHERE user_session IN (SELECT user_session FROM ev WHERE is_train)""")
SQL["split_anti"] = with_ctes(CLICKS, SPLIT, body="""
SELECT event_id, user_session FROM clicks
WHERE user_session NOT IN (SELECT user_session FROM ev WHERE is_train)""")
SQL["replay_sample"] = with_ctes(CLICKS, body="""
SELECT event_id, user_session FROM (
  SELECT event_id, user_session, row_number() OVER (ORDER BY md5('replay' || CAST(event_id AS VARCHAR))) AS r
  FROM clicks)
WHERE r <= (SELECT count(*) * 5 // 100 FROM clicks)""")
SQL["validation_tail"] = with_ctes(CLICKS, SPLIT, rows_on("ev"), PAIRS.replace(
    "SELECT user_session,", "SELECT is_train, user_session,"), body="""
SELECT user_session, row_num, pair_pos, pair_pos >= (n_pairs * 80) // 100 AS is_validation
FROM (SELECT user_session, row_num,
             CAST(row_number() OVER (ORDER BY event_time, event_id) - 1 AS BIGINT) AS pair_pos,
             count(*) OVER () AS n_pairs
      FROM pairs WHERE is_train)""")

# ---------------------------------------------------------------- B/G4/H6: slices and positions
POS = """
pos_ AS (
  SELECT *, CAST(row_number() OVER (ORDER BY event_time, event_id) - 1 AS BIGINT) AS pos,
         count(*) OVER () AS n_all
  FROM clicks
)"""
SQL["event_positions"] = with_ctes(CLICKS, POS, body="SELECT event_id, pos FROM pos_")
SQL["position_slice"] = with_ctes(CLICKS, POS, body="""
SELECT event_id, pos FROM pos_ WHERE pos >= n_all * 15 // 100 AND pos < n_all * 55 // 100""")
SQL["slice_except_compat"] = with_ctes(CLICKS, POS, body="""
SELECT event_time, user_id, product_id, user_session FROM pos_ WHERE pos < n_all * 55 // 100
EXCEPT
SELECT event_time, user_id, product_id, user_session FROM pos_ WHERE pos < n_all * 15 // 100""")
SQL["cutoff_split"] = with_ctes(CLICKS, body="""
SELECT event_id, event_time, user_session FROM clicks
WHERE event_time <= (SELECT CAST(CAST(max(event_time) - INTERVAL 14 DAY AS DATE) AS TIMESTAMP) FROM clicks)""")
SQL["trailing_window"] = with_ctes(CLICKS, body="""
SELECT event_id, event_time FROM clicks
WHERE event_time >= (SELECT max(event_time) - INTERVAL 3 DAY FROM clicks)""")

# ---------------------------------------------------------------- F/J: statistics and models
FOLLOW = """
cnts AS (SELECT prev_item, next_item, count(*) AS cnt FROM pairs GROUP BY 1, 2),
ranked_f AS (
  SELECT prev_item, next_item, cnt, sum(cnt) OVER (PARTITION BY prev_item) AS tot,
         row_number() OVER (PARTITION BY prev_item ORDER BY cnt DESC, next_item) AS rank
  FROM cnts
)"""
SQL["follow_stats"] = with_ctes(CLICKS, rows_on("clicks"), PAIRS, FOLLOW, body="""
SELECT prev_item, next_item AS item, cnt AS support, CAST(cnt AS DOUBLE) / CAST(tot AS DOUBLE) AS confidence,
       CAST(rank AS BIGINT) AS rank
FROM ranked_f WHERE rank <= 5 AND cnt >= 5""")
SQL["follow_stats_temporal"] = with_ctes(CLICKS, rows_on("clicks"), PAIRS, body="""
SELECT dim, slot, prev_item, next_item AS item, cnt AS support,
       CAST(cnt AS DOUBLE) / CAST(tot AS DOUBLE) AS confidence, CAST(rank AS BIGINT) AS rank
FROM (
  SELECT *, sum(cnt) OVER (PARTITION BY dim, slot, prev_item) AS tot,
         row_number() OVER (PARTITION BY dim, slot, prev_item ORDER BY cnt DESC, next_item) AS rank
  FROM (
    SELECT 'all' AS dim, CAST(-1 AS BIGINT) AS slot, prev_item, next_item, count(*) AS cnt FROM pairs GROUP BY 3, 4
    UNION ALL
    SELECT 'hour', CAST(hour(event_time) AS BIGINT), prev_item, next_item, count(*) FROM pairs GROUP BY 2, 3, 4
    UNION ALL
    SELECT 'dow', CAST(dayofweek(event_time) + 1 AS BIGINT), prev_item, next_item, count(*) FROM pairs GROUP BY 2, 3, 4
  ))
WHERE rank <= 5 AND cnt >= 1""")
SQL["transition_model"] = with_ctes(CLICKS, rows_on("clicks"), PAIRS, body="""
SELECT prev_item, next_item, count(*) AS cnt FROM pairs GROUP BY 1, 2""")

TRAIN_PAIRS = [CLICKS, SPLIT, rows_on("ev"), PAIRS.replace("SELECT user_session,", "SELECT is_train, user_session,"),
               VOCAB_TRAIN, "model AS (SELECT prev_item, next_item, count(*) AS cnt FROM pairs WHERE is_train GROUP BY 1, 2)"]


def recommend_sql(k: int, excl: str = "SELECT NULL::BIGINT AS item WHERE FALSE") -> str:
    return recommend_ctes(k, excl) + "\nSELECT prev_item, rank, item, score FROM recs"


def recommend_ctes(k: int, excl: str = "SELECT NULL::BIGINT AS item WHERE FALSE") -> str:
    return f"""
excl AS ({excl}),
fol AS (
  SELECT m.prev_item, m.next_item AS item, m.cnt AS score,
         row_number() OVER (PARTITION BY m.prev_item ORDER BY m.cnt DESC, v.idx, m.next_item) AS rank
  FROM model m LEFT JOIN vocab v ON v.item = m.next_item
  WHERE m.next_item NOT IN (SELECT item FROM excl)
),
nf AS (SELECT prev_item, count(*) AS nf FROM fol GROUP BY 1),
prevs AS (SELECT DISTINCT prev_item FROM model UNION ALL SELECT NULL::BIGINT),
fills AS (
  SELECT p.prev_item, v.item, CAST(0 AS BIGINT) AS score,
         coalesce(nf.nf, 0) + row_number() OVER (PARTITION BY p.prev_item ORDER BY v.idx) AS rank
  FROM prevs p CROSS JOIN vocab v LEFT JOIN nf ON nf.prev_item = p.prev_item
  WHERE v.item NOT IN (SELECT item FROM excl)
    AND NOT EXISTS (SELECT 1 FROM model m WHERE m.prev_item = p.prev_item AND m.next_item = v.item)
),
recs AS (
  SELECT prev_item, CAST(rank AS BIGINT) AS rank, item, score FROM fol WHERE rank <= {k}
  UNION ALL
  SELECT prev_item, CAST(rank AS BIGINT) AS rank, item, score FROM fills WHERE rank <= {k}
)"""


SQL["recommend_topk"] = "WITH " + ",".join(TRAIN_PAIRS) + "," + recommend_sql(10)
SQL["recommend_excluding"] = "WITH " + ",".join(TRAIN_PAIRS) + "," + recommend_sql(
    10, "SELECT item FROM vocab WHERE idx < 2")
SQL["recommend_history"] = "WITH " + ",".join(TRAIN_PAIRS) + """,
last_rows AS (
  SELECT user_session, product_id AS prev_item, 10 - (session_len - row_num) AS w
  FROM rows_ WHERE NOT is_train AND row_num > session_len - 10
),
scores AS (
  SELECT l.user_session, m.next_item AS item, CAST(sum(l.w * m.cnt) AS BIGINT) AS score
  FROM last_rows l JOIN model m ON m.prev_item = l.prev_item GROUP BY 1, 2
)
SELECT user_session, rank, item, score FROM (
  SELECT s.*, CAST(row_number() OVER (PARTITION BY s.user_session ORDER BY s.score DESC, v.idx NULLS LAST, s.item)
                   AS BIGINT) AS rank
  FROM scores s LEFT JOIN vocab v ON v.item = s.item)
WHERE rank <= 10"""

SQL["recommend_history_bounded"] = SQL["recommend_history"]

SQL["recommend_history_filled"] = "WITH " + ",".join(TRAIN_PAIRS) + """,
last_rows AS (
  SELECT user_session, product_id AS prev_item, 10 - (session_len - row_num) AS w
  FROM rows_ WHERE NOT is_train AND row_num > session_len - 10
),
scores AS (
  SELECT l.user_session, m.next_item AS item, CAST(sum(l.w * m.cnt) AS BIGINT) AS score
  FROM last_rows l JOIN model m ON m.prev_item = l.prev_item GROUP BY 1, 2
),
offers AS (
  SELECT e.user_session, v.item, v.idx, coalesce(s.score, 0) AS score
  FROM (SELECT DISTINCT user_session FROM ev WHERE NOT is_train) e CROSS JOIN vocab v
  LEFT JOIN scores s ON s.user_session = e.user_session AND s.item = v.item WHERE v.idx >= 2
)
SELECT user_session, rank, item, score FROM (
  SELECT o.*, CAST(row_number() OVER (PARTITION BY user_session ORDER BY score DESC, idx) AS BIGINT) AS rank FROM offers o)
WHERE rank <= 10"""

# ---------------------------------------------------------------- L: sliding window + replay
PHASE = """
pos_ AS (SELECT *, CAST(row_number() OVER (ORDER BY event_time, event_id) - 1 AS BIGINT) AS pos FROM clicks),
pp0 AS (
  SELECT user_session, event_id, pos AS prev_pos, product_id AS prev_item,
         lead(product_id) OVER w AS next_item, lead(pos) OVER w AS next_pos
  FROM pos_ WINDOW w AS (PARTITION BY user_session ORDER BY event_time, event_id)
),
pp AS (SELECT * FROM pp0 WHERE next_item IS NOT NULL),
sz AS (
  SELECT n AS N, n * 45 // 100 AS init, n * 40 // 100 AS train, n * 5 // 100 AS test,
         n * 10 // 100 AS step, n * 5 // 100 AS buffer
  FROM (SELECT count(*) AS n FROM clicks)
),
plan0 AS (
  SELECT CAST(r.p AS BIGINT) AS phase, sz.*,
         CASE WHEN r.p = 0 THEN init ELSE N - init + (r.p - 1) * step END AS e
  FROM sz, range(0, 64) r(p)
),
plan AS (
  SELECT phase, CASE WHEN phase = 0 THEN 0 ELSE e - train END AS train_start, e AS train_end,
         e AS test_start, e + test AS test_end, N, buffer, step, test
  FROM plan0 WHERE e + test <= N
),
draws0 AS (
  SELECT CAST(0 AS BIGINT) AS q, step + test AS bound, buffer FROM sz
  UNION ALL SELECT phase, train_start, buffer FROM plan WHERE phase >= 1
),
draws AS (
  SELECT q, bound,
         CASE WHEN (buffer * 16777216) // greatest(bound, 1) >= 16777216 THEN 'gggggg'
              ELSE lpad(lower(hex((buffer * 16777216) // greatest(bound, 1))), 6, '0') END AS thr
  FROM draws0
),
ev_draw AS (
  SELECT p.*, (SELECT min(d.q) FROM draws d WHERE p.pos < d.bound AND
                 substr(md5('replay' || CAST(d.q AS VARCHAR) || '|' || p.user_session), 1, 6) < d.thr) AS draw
  FROM pos_ p
),
pp_draw AS (
  SELECT pp.*, (SELECT min(d.q) FROM draws d WHERE pp.next_pos < d.bound AND
                  substr(md5('replay' || CAST(d.q AS VARCHAR) || '|' || pp.user_session), 1, 6) < d.thr) AS draw
  FROM pp
)"""

SQL["phase_plan"] = with_ctes(CLICKS, PHASE, body="SELECT phase, train_start, train_end, test_start, test_end FROM plan")
SQL["phase_events"] = with_ctes(CLICKS, PHASE, body="""
SELECT pl.phase, 'train' AS role, e.event_id FROM pos_ e JOIN plan pl ON e.pos >= pl.train_start AND e.pos < pl.train_end
UNION ALL
SELECT pl.phase, 'test', e.event_id FROM pos_ e JOIN plan pl ON e.pos >= pl.test_start AND e.pos < pl.test_end""")
SQL["replay_buffer"] = with_ctes(CLICKS, PHASE, body="""
SELECT pl.phase, e.event_id, e.draw AS phase_added
FROM ev_draw e JOIN plan pl ON pl.phase >= 1 AND e.draw < pl.phase""")
TRAIN_ROWS = """
train_rows AS (
  SELECT pl.phase, 'window' AS source, e.event_id, e.user_session, e.product_id
  FROM ev_draw e JOIN plan pl ON e.pos >= pl.train_start AND e.pos < pl.train_end
  UNION ALL
  SELECT pl.phase, 'replay', e.event_id, e.user_session, e.product_id
  FROM ev_draw e JOIN plan pl ON pl.phase >= 1 AND e.draw < pl.phase
)"""
SQL["train_with_replay"] = with_ctes(CLICKS, PHASE, TRAIN_ROWS, body="SELECT phase, source, event_id FROM train_rows")
SQL["train_stats"] = with_ctes(CLICKS, PHASE, TRAIN_ROWS, body="""
SELECT phase, count(*) AS n_rows, count(DISTINCT product_id) AS n_items, count(DISTINCT user_session) AS n_sessions
FROM train_rows GROUP BY phase""")


SQL["train_stats_sketch_error"] = with_ctes(CLICKS, PHASE, TRAIN_ROWS, body="""
SELECT phase, count(*) AS n_rows, TRUE AS items_near, TRUE AS sessions_near FROM train_rows GROUP BY phase""")


def phase_acc_sql(variants: tuple[str, ...], frozen: bool = False) -> str:
    vals = ", ".join(f"('{v}')" for v in variants)
    draw_filter = "AND pp.draw = 0" if frozen else ""
    return with_ctes(CLICKS, PHASE, f"""
vars AS (SELECT * FROM (VALUES {vals}) v(variant)),
train AS (
  SELECT pl.phase, v.variant, pp.prev_item, pp.next_item, count(*) AS cnt
  FROM pp_draw pp, plan pl, vars v
  WHERE (pp.prev_pos >= pl.train_start AND pp.next_pos < pl.train_end)
        AND v.variant <> 'static'
     OR (v.variant = 'static' AND pp.prev_pos >= 0 AND pp.next_pos < (SELECT init FROM sz))
     OR (v.variant = 'replay' AND pl.phase >= 1 AND pp.draw IS NOT NULL AND pp.draw < pl.phase {draw_filter})
  GROUP BY 1, 2, 3, 4
),
tests AS (
  SELECT pl.phase, pp.prev_item, pp.next_item AS target, count(*) AS n
  FROM pp, plan pl WHERE pp.prev_pos >= pl.test_start AND pp.next_pos < pl.test_end GROUP BY 1, 2, 3
  UNION ALL SELECT phase, NULL, NULL, 0 FROM plan
),
fr AS (
  SELECT phase, variant, prev_item, next_item,
         row_number() OVER (PARTITION BY phase, variant, prev_item ORDER BY cnt DESC, next_item) AS rank
  FROM train
),
ranked AS (
  SELECT t.phase, v.variant, t.n, fr.rank
  FROM tests t CROSS JOIN vars v
  LEFT JOIN fr ON fr.phase = t.phase AND fr.variant = v.variant AND fr.prev_item = t.prev_item
              AND fr.next_item = t.target
),
acc AS (
  SELECT phase, variant, CAST(k AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n,
         CAST(sum(CASE WHEN rank <= k THEN n ELSE 0 END) AS BIGINT) AS hits,
         CAST(sum(CASE WHEN rank <= k THEN n ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(n) AS DOUBLE), 0) AS accuracy
  FROM ranked, {KS} GROUP BY phase, variant, k
)""", body="SELECT * FROM acc")


SQL["phase_topk_accuracy"] = phase_acc_sql(("window", "replay"))
SQL["phase_topk_accuracy_static"] = phase_acc_sql(("static",))
SQL["phase_topk_accuracy_frozen"] = phase_acc_sql(("replay",), frozen=True)
SQL["degradation_alerts"] = phase_acc_sql(("window", "replay")).replace("SELECT * FROM acc", """
SELECT variant, k, phase, accuracy, prev_accuracy,
       coalesce(accuracy * 100.0 < prev_accuracy * 90.0, FALSE) AS alert
FROM (SELECT *, lag(accuracy) OVER (PARTITION BY variant, k ORDER BY phase) AS prev_accuracy FROM acc)""")
SQL["phase_unknown_share"] = with_ctes(CLICKS, PHASE, TRAIN_ROWS, """
known AS (SELECT DISTINCT phase, product_id AS item FROM train_rows),
te AS (SELECT pl.phase, e.product_id FROM pos_ e JOIN plan pl ON e.pos >= pl.test_start AND e.pos < pl.test_end),
ev_share AS (
  SELECT te.phase, count(*) AS n_test_events,
         avg(CASE WHEN k.item IS NULL THEN 1.0 ELSE 0.0 END) AS unknown_item_share
  FROM te LEFT JOIN known k ON k.phase = te.phase AND k.item = te.product_id GROUP BY 1
),
tp AS (SELECT pl.phase, pp.next_item FROM pp, plan pl WHERE pp.prev_pos >= pl.test_start AND pp.next_pos < pl.test_end),
pr_share AS (
  SELECT tp.phase, count(*) AS n_test_pairs,
         CAST(count(*) FILTER (WHERE k.item IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS unknown_target_share
  FROM tp LEFT JOIN known k ON k.phase = tp.phase AND k.item = tp.next_item GROUP BY 1
)""", body="SELECT e.*, p.n_test_pairs, p.unknown_target_share FROM ev_share e LEFT JOIN pr_share p USING (phase)")

# ---------------------------------------------------------------- L: daily protocol
DAILY = """
bnd AS (
  SELECT max(event_time) AS max_time,
         CAST(CAST(max(event_time) - INTERVAL 14 DAY AS DATE) AS TIMESTAMP) AS cutoff
  FROM clicks
),
dates AS (
  SELECT cutoff + CAST(r.k AS INTEGER) * INTERVAL 1 DAY AS test_date
  FROM bnd, range(1, 100000) r(k) WHERE cutoff + CAST(r.k AS INTEGER) * INTERVAL 1 DAY <= max_time
),
d_up AS (
  SELECT test_date, (SELECT max(event_time) FROM clicks c WHERE c.event_time <= test_date) AS upto,
         row_number() OVER (ORDER BY test_date) AS i
  FROM dates
),
init AS (SELECT (SELECT max(event_time) FROM clicks c WHERE c.event_time <= bnd.cutoff) AS last FROM bnd),
sched(i, test_date, is_update, last_update) AS (
  SELECT d.i, d.test_date, date_sub('day', init.last, d.test_date) >= 3,
         CASE WHEN date_sub('day', init.last, d.test_date) >= 3 THEN d.upto ELSE init.last END
  FROM d_up d, init WHERE d.i = 1
  UNION ALL
  SELECT d.i, d.test_date, date_sub('day', s.last_update, d.test_date) >= 3,
         CASE WHEN date_sub('day', s.last_update, d.test_date) >= 3 THEN d.upto ELSE s.last_update END
  FROM sched s JOIN d_up d ON d.i = s.i + 1
),
versions AS (
  SELECT CAST(0 AS BIGINT) AS version, bnd.cutoff AS fit_date, init.last AS fit_time,
         CAST(NULL AS TIMESTAMP) AS lo, bnd.cutoff AS hi
  FROM bnd, init
  UNION ALL
  SELECT CAST(row_number() OVER (ORDER BY test_date) AS BIGINT), test_date, last_update,
         last_update - INTERVAL 3 DAY, test_date
  FROM sched WHERE is_update
),
rows_d AS (
  SELECT *, lead(product_id) OVER w AS next_item, lead(event_time) OVER w AS next_time
  FROM clicks WINDOW w AS (PARTITION BY user_session ORDER BY event_time, event_id)
),
dpairs AS (
  SELECT product_id AS prev_item, next_item, event_time AS prev_time, next_time FROM rows_d WHERE next_item IS NOT NULL
),
wv AS (
  SELECT v.version, p.prev_item, p.next_item, count(*) AS cnt
  FROM dpairs p JOIN versions v ON (v.lo IS NULL OR p.prev_time >= v.lo) AND p.next_time <= v.hi
  GROUP BY 1, 2, 3
),
mif AS (
  SELECT d.test_date,
         (SELECT v.version FROM versions v WHERE v.fit_date < d.test_date ORDER BY v.fit_date DESC LIMIT 1) AS version
  FROM dates d
),
tkeys AS (SELECT DISTINCT prev_item, next_item FROM wv),
tgrid AS (
  SELECT k.prev_item, k.next_item, v.version, coalesce(w.cnt, 0) AS w
  FROM tkeys k CROSS JOIN versions v
  LEFT JOIN wv w ON w.prev_item = k.prev_item AND w.next_item = k.next_item AND w.version = v.version
),
tlists AS (SELECT prev_item, next_item, list(w ORDER BY version) AS ws FROM tgrid GROUP BY 1, 2),
transfer AS (
  SELECT v.version, t.prev_item, t.next_item,
         CAST(list_reduce(list_slice(t.ws, 1, CAST(v.version AS INTEGER) + 1), lambda a, x: a // 2 + x) AS BIGINT) AS cnt
  FROM tlists t CROSS JOIN versions v
)"""


def daily_sql(body: str, extra: str = "") -> str:
    return "WITH RECURSIVE " + ",".join([CLICKS, DAILY] + ([extra] if extra else [])) + "\n" + body


def day_key_sql(c: str) -> str:
    return f"(CAST(CAST({c} - INTERVAL 1 MICROSECOND AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY)"


SQL["test_dates"] = daily_sql("SELECT test_date FROM dates")
SQL["update_schedule"] = daily_sql("SELECT test_date, is_update, last_update FROM sched")
SQL["model_in_force"] = daily_sql("SELECT test_date, version FROM mif")
SQL["window_refit"] = daily_sql("""
SELECT v.version, c.event_id FROM clicks c JOIN versions v
  ON v.version >= 1 AND c.event_time >= v.lo AND c.event_time <= v.hi""")
SQL["initial_model"] = daily_sql("SELECT prev_item, next_item, cnt FROM wv WHERE version = 0")
SQL["transition_transfer"] = daily_sql("SELECT version, prev_item, next_item, cnt FROM transfer WHERE cnt > 0")

DAILY_ACC = """
models AS (
  SELECT 'static' AS variant, d.test_date, w.prev_item, w.next_item, w.cnt
  FROM dates d JOIN wv w ON w.version = 0
  UNION ALL
  SELECT 'updated', m.test_date, w.prev_item, w.next_item, w.cnt FROM mif m JOIN wv w ON w.version = m.version
  UNION ALL
  SELECT 'transfer', m.test_date, t.prev_item, t.next_item, t.cnt FROM mif m JOIN transfer t
    ON t.version = m.version AND t.cnt > 0
),
fr AS (
  SELECT *, row_number() OVER (PARTITION BY variant, test_date, prev_item ORDER BY cnt DESC, next_item) AS rank
  FROM models
),
tests AS (
  SELECT {dk_next} AS test_date, prev_item, next_item AS target, count(*) AS n
  FROM dpairs WHERE {dk_prev} = {dk_next} AND {dk_next} IN (SELECT test_date FROM dates) GROUP BY 1, 2, 3
  UNION ALL SELECT test_date, NULL, NULL, 0 FROM dates
),
vars AS (SELECT * FROM (VALUES ('static'), ('updated'), ('transfer')) v(variant)),
ranked AS (
  SELECT t.test_date, v.variant, t.n, fr.rank
  FROM tests t CROSS JOIN vars v
  LEFT JOIN fr ON fr.variant = v.variant AND fr.test_date = t.test_date AND fr.prev_item = t.prev_item
              AND fr.next_item = t.target
)""".format(dk_next=day_key_sql("next_time"), dk_prev=day_key_sql("prev_time"))

SQL["daily_topk_accuracy"] = daily_sql("""
SELECT test_date, variant, CAST(k AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n,
       CAST(sum(CASE WHEN rank <= k THEN n ELSE 0 END) AS BIGINT) AS hits,
       CAST(sum(CASE WHEN rank <= k THEN n ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(n) AS DOUBLE), 0) AS accuracy
FROM ranked, """ + KS + " GROUP BY test_date, variant, k", DAILY_ACC)

SQL["daily_topk_accuracy_cumulative"] = daily_sql("""
SELECT test_date, variant, CAST(k AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n,
       CAST(sum(CASE WHEN rank <= k THEN n ELSE 0 END) AS BIGINT) AS hits,
       CAST(sum(CASE WHEN rank <= k THEN n ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(n) AS DOUBLE), 0) AS accuracy
FROM ranked, """ + KS + " GROUP BY test_date, variant, k", """
mif_c AS (
  SELECT d.test_date,
         (SELECT v.version FROM versions v WHERE v.fit_date <= d.test_date ORDER BY v.fit_date DESC LIMIT 1) AS version
  FROM dates d
),
models AS (
  SELECT 'static' AS variant, d.test_date, w.prev_item, w.next_item, w.cnt FROM dates d JOIN wv w ON w.version = 0
  UNION ALL
  SELECT 'updated', m.test_date, w.prev_item, w.next_item, w.cnt FROM mif_c m JOIN wv w ON w.version = m.version
),
fr AS (
  SELECT *, row_number() OVER (PARTITION BY variant, test_date, prev_item ORDER BY cnt DESC, next_item) AS rank
  FROM models
),
tests AS (
  SELECT d.test_date, p.prev_item, p.next_item AS target, count(*) AS n
  FROM dpairs p JOIN dates d ON p.next_time <= d.test_date GROUP BY 1, 2, 3
  UNION ALL SELECT test_date, NULL, NULL, 0 FROM dates
),
vars AS (SELECT * FROM (VALUES ('static'), ('updated')) v(variant)),
ranked AS (
  SELECT t.test_date, v.variant, t.n, fr.rank
  FROM tests t CROSS JOIN vars v
  LEFT JOIN fr ON fr.variant = v.variant AND fr.test_date = t.test_date AND fr.prev_item = t.prev_item
              AND fr.next_item = t.target
)""")

# ---------------------------------------------------------------- M: streaming twins (= batch results)
SQL["stream_events"] = with_ctes(CLICKS, body="SELECT event_id, event_time, user_id, product_id, user_session FROM clicks")
SQL["stream_dedup"] = SQL["stream_events"]
SQL["windowed_popularity"] = with_ctes(CLICKS, body="""
SELECT ws AS window_start, ws + INTERVAL 3 DAY AS window_end, product_id AS item, count(*) AS n
FROM (SELECT product_id, CAST(CAST(event_time AS DATE) AS TIMESTAMP) - CAST(k.k AS INTEGER) * INTERVAL 1 DAY AS ws
      FROM clicks, (VALUES (0), (1), (2)) k(k))
GROUP BY 1, 2, 3""")
SQL["stream_popularity"] = SQL["windowed_popularity"]
SQL["stream_sessions"] = with_ctes(CLICKS, body="""
SELECT user_id, min(event_time) AS session_start, max(event_time) + INTERVAL 1 DAY AS session_end,
       count(*) AS n_events, arg_min(product_id, (event_time, event_id)) AS first_item,
       arg_max(product_id, (event_time, event_id)) AS last_item
FROM clicks GROUP BY user_session, user_id""")
SQL["stream_history"] = with_ctes(CLICKS, rows_on("clicks"), body="""
SELECT user_session, max(row_num) AS n_events,
       array_to_string(list(product_id ORDER BY row_num) FILTER (WHERE row_num > session_len - 10), ',') AS history
FROM rows_ GROUP BY user_session""")
SQL["stream_recommend"] = "WITH " + ",".join(TRAIN_PAIRS) + "," + recommend_ctes(10) + """
SELECT c.event_id, c.product_id, r.rank, r.item, r.score
FROM clicks c JOIN recs r ON r.prev_item = c.product_id
UNION ALL
SELECT c.event_id, c.product_id, r.rank, r.item, r.score
FROM clicks c JOIN recs r ON r.prev_item IS NULL
WHERE c.product_id NOT IN (SELECT prev_item FROM model)"""
SQL["stream_history_unordered"] = SQL["stream_history"]
SQL["stream_sequences"] = SQL["session_sequences"]
SQL["stream_model_refresh"] = SQL["transition_model"]
SQL["stream_model_refresh_unordered"] = SQL["transition_model"]
SQL["stream_model_refresh_redelivered"] = SQL["transition_model"]
SQL["stream_history_state"] = with_ctes(CLICKS, rows_on("clicks"), body="""
SELECT r.user_session, r.row_num, r.event_id, array_to_string(list(p.product_id ORDER BY p.row_num), ',') AS history
FROM rows_ r JOIN rows_ p ON p.user_session = r.user_session AND p.row_num BETWEEN r.row_num - 9 AND r.row_num
GROUP BY ALL""")
SQL["stream_refit_schedule"] = daily_sql("SELECT version, fit_date, fit_time, lo, hi FROM versions")
SQL["stream_refit_versions"] = daily_sql("SELECT version, prev_item, next_item, cnt FROM wv")
SQL["baskets_update_model"] = """
WITH r AS (SELECT l_orderkey, l_partkey AS item,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.item AS prev_item, b.item AS next_item, count(*) AS cnt
FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND b.i = a.i + 1 GROUP BY ALL"""
SQL["baskets_replay_model"] = with_ctes(BASKETS, """
aged AS (SELECT *, event_time < (SELECT max(event_time) FROM baskets) - INTERVAL 365 DAY AS old FROM baskets),
kept AS (
  SELECT * FROM aged WHERE NOT old
  UNION ALL
  (SELECT * FROM aged WHERE old ORDER BY md5('replay' || user_session || chr(31) || CAST(event_id AS VARCHAR)) LIMIT 20000)
),
nexts AS (
  SELECT product_id AS prev_item, lead(product_id) OVER (PARTITION BY user_session ORDER BY event_time, event_id) AS next_item
  FROM kept
)""", body="SELECT prev_item, next_item, count(*) AS cnt FROM nexts WHERE next_item IS NOT NULL GROUP BY ALL")
SQL["sample_rows_seeded"] = with_ctes(CLICKS, body="""
SELECT event_id, user_session FROM clicks
WHERE substr(md5('rows' || user_session || '/' || CAST(event_id AS VARCHAR)), 1, 6) < '0ccccc'""")
SQL["stream_replay"] = with_ctes(CLICKS, body="""
SELECT event_id, user_session FROM (
  SELECT event_id, user_session, row_number() OVER (ORDER BY md5('replay' || CAST(event_id AS VARCHAR))) AS r
  FROM clicks)
WHERE r <= 500""")

SQL["stream_replay_baskets"] = with_ctes(BASKETS, body="""
SELECT event_id, event_time, user_id, product_id, user_session FROM (
  SELECT *, row_number() OVER (ORDER BY md5('replay' || user_session || '/' || CAST(event_id AS VARCHAR))) AS r FROM baskets)
WHERE r <= 500""")
SQL["stream_metrics"] = with_ctes(CLICKS, body="""
SELECT count(*) AS n_events, count(DISTINCT user_session) AS n_sessions, count(DISTINCT product_id) AS n_items,
       max(event_time) AS last_time, CAST(b AS BIGINT) AS batch_id, 'run-1' AS run
FROM (SELECT *, (instr('0123456789abcdef', substr(md5('batch' || user_session), 1, 1)) - 1) % 3 AS b FROM clicks) GROUP BY b""")

# ---------------------------------------------------------------- I2/I3
SQL["history_padded"] = with_ctes(CLICKS, SPLIT, "vi AS (" + vocab_sql("ev", "product_id", "is_train") + ")", """
enc AS (
  SELECT e.event_id, e.event_time, e.user_session, coalesce(vi.idx, -1) AS product_id
  FROM ev e LEFT JOIN vi ON vi.item = e.product_id WHERE NOT e.is_train
)""", rows_on("enc"), body="""
SELECT user_session, row_num,
       array_to_string(list_concat(list_transform(range(10 - len(h)), lambda x: -1),
                                   list_transform(h, lambda x: CASE WHEN x >= 0 AND x < nl
                                                                    THEN x ELSE 0 END)), ',') AS padded,
       next_item AS target
FROM (SELECT *, list(product_id) OVER (PARTITION BY user_session ORDER BY row_num
                                       ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h FROM rows_),
     (SELECT count(*) AS nl FROM vi)""")

def phase_rows_sql(draw_filter: str = "") -> str:
    return with_ctes(CLICKS, PHASE, f"""
rdraw AS (
  SELECT d.q, p.event_id,
         row_number() OVER (PARTITION BY d.q ORDER BY
           md5('replay' || CAST(d.q AS VARCHAR) || '|' || CAST(p.event_id AS VARCHAR))) AS r
  FROM pos_ p JOIN draws d ON p.pos < d.bound
),
rsel AS (SELECT event_id, min(q) AS draw FROM rdraw, sz WHERE r <= sz.buffer {draw_filter} GROUP BY 1),
trows AS (
  SELECT pl.phase, e.event_id, e.event_time, e.user_session, e.product_id
  FROM pos_ e JOIN plan pl ON e.pos >= pl.train_start AND e.pos < pl.train_end
  UNION ALL
  SELECT pl.phase, e.event_id, e.event_time, e.user_session, e.product_id
  FROM pos_ e JOIN rsel r ON r.event_id = e.event_id JOIN plan pl ON pl.phase >= 1 AND r.draw < pl.phase
),
tp AS (
  SELECT phase, product_id AS prev_item,
         lead(product_id) OVER (PARTITION BY phase, user_session ORDER BY event_time, event_id) AS next_item
  FROM trows
),
train AS (SELECT phase, prev_item, next_item, count(*) AS cnt FROM tp WHERE next_item IS NOT NULL GROUP BY 1, 2, 3),
tests AS (
  SELECT pl.phase, pp.prev_item, pp.next_item AS target, count(*) AS n
  FROM pp, plan pl WHERE pp.prev_pos >= pl.test_start AND pp.next_pos < pl.test_end GROUP BY 1, 2, 3
  UNION ALL SELECT phase, NULL, NULL, 0 FROM plan
),
fr AS (
  SELECT phase, prev_item, next_item,
         row_number() OVER (PARTITION BY phase, prev_item ORDER BY cnt DESC, next_item) AS rank
  FROM train
),
ranked AS (
  SELECT t.phase, t.n, fr.rank FROM tests t
  LEFT JOIN fr ON fr.phase = t.phase AND fr.prev_item = t.prev_item AND fr.next_item = t.target
)""", body=f"""
SELECT phase, 'replay_rows' AS variant, CAST(k AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n,
       CAST(sum(CASE WHEN rank <= k THEN n ELSE 0 END) AS BIGINT) AS hits,
       CAST(sum(CASE WHEN rank <= k THEN n ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(n) AS DOUBLE), 0) AS accuracy
FROM ranked, {KS} GROUP BY phase, k""")


SQL["phase_topk_accuracy_rows"] = phase_rows_sql()
SQL["phase_topk_accuracy_rows_frozen"] = phase_rows_sql("AND q = 0")

# ---------------------------------------------------------------- K1: co-occurrence
COOCCURRENCE = """
cooc AS (
  SELECT a.product_id AS item, b.product_id AS context, CAST(count(*) AS BIGINT) AS n
  FROM rows_ a JOIN rows_ b ON a.user_session = b.user_session
   AND b.row_num BETWEEN a.row_num - 5 AND a.row_num + 5 AND a.row_num <> b.row_num
  WHERE a.is_train GROUP BY 1, 2
)"""

SQL["item_cooccurrence"] = with_ctes(CLICKS, SPLIT, rows_on("ev"), COOCCURRENCE, body="SELECT item, context, n FROM cooc")

SQL["item_ppmi"] = with_ctes(CLICKS, SPLIT, rows_on("ev"), COOCCURRENCE, """
per AS (SELECT item, CAST(sum(n) AS DOUBLE) AS s FROM cooc GROUP BY 1),
w AS (
  SELECT c.item, c.context, c.n,
         ln(CAST(c.n AS DOUBLE) * (SELECT CAST(sum(n) AS DOUBLE) FROM cooc) / (p.s * q.s)) AS weight
  FROM cooc c JOIN per p ON p.item = c.item JOIN per q ON q.item = c.context
)""", body="SELECT item, context, n, round(weight, 6) AS weight FROM w WHERE weight > 0")

PROJECTION = """
proj AS (
  SELECT item, j, CAST(sum(CASE WHEN ((strpos('0123456789abcdef', substr(md5(CAST(context AS VARCHAR)), j // 4 + 1, 1)) - 1)
                                       >> (3 - j % 4)) & 1 = 1 THEN n ELSE -n END) AS BIGINT) AS v
  FROM cooc, (SELECT CAST(range AS INTEGER) AS j FROM range(32)) GROUP BY 1, 2
)"""

SQL["item_projection"] = with_ctes(CLICKS, SPLIT, rows_on("ev"), COOCCURRENCE, PROJECTION,
                                   body="SELECT item, CAST(j AS BIGINT) AS j, v FROM proj")

SQL["inner_product_topk"] = with_ctes(CLICKS, SPLIT, rows_on("ev"), COOCCURRENCE, PROJECTION, """
hv AS (
  SELECT r.user_session, p.j, sum(p.v) AS v FROM rows_ r JOIN proj p ON p.item = r.product_id
  WHERE NOT r.is_train AND r.row_num > r.session_len - 10 GROUP BY 1, 2
),
s AS (SELECT h.user_session, p.item, CAST(sum(h.v * p.v) AS DOUBLE) AS score FROM hv h JOIN proj p USING (j) GROUP BY 1, 2)
""", body="""
SELECT * FROM (
  SELECT user_session, CAST(row_number() OVER (PARTITION BY user_session ORDER BY score DESC, item) AS BIGINT) AS rank, item, score
  FROM s)
WHERE rank <= 10""")

SQL["inner_product_accuracy"] = with_ctes(CLICKS, SPLIT, rows_on("ev"), COOCCURRENCE, PROJECTION, """
q AS (
  SELECT r.user_session, r.row_num, n.product_id AS target
  FROM rows_ r JOIN rows_ n ON n.user_session = r.user_session AND n.row_num = r.row_num + 1 WHERE NOT r.is_train
),
hv AS (
  SELECT q.user_session, q.row_num, p.j, sum(p.v) AS v
  FROM q JOIN rows_ a ON a.user_session = q.user_session AND a.row_num BETWEEN q.row_num - 9 AND q.row_num
  JOIN proj p ON p.item = a.product_id GROUP BY 1, 2, 3
),
s AS (SELECT h.user_session, h.row_num, p.item, sum(h.v * p.v) AS score FROM hv h JOIN proj p USING (j) GROUP BY 1, 2, 3),
own AS (SELECT q.*, s.score FROM q LEFT JOIN s ON s.user_session = q.user_session AND s.row_num = q.row_num AND s.item = q.target),
ranked AS (
  SELECT o.user_session, o.row_num, CASE WHEN any_value(o.score) IS NOT NULL THEN 1 + count(s.item) END AS rank
  FROM own o LEFT JOIN s ON s.user_session = o.user_session AND s.row_num = o.row_num AND s.score > o.score GROUP BY 1, 2
)""", body=f"""
SELECT CAST(k AS BIGINT) AS k, count(r.row_num) AS n, count(*) FILTER (r.rank <= k) AS hits,
       CAST(count(*) FILTER (r.rank <= k) AS DOUBLE) / nullif(count(r.row_num), 0) AS accuracy
FROM {KS} LEFT JOIN ranked r ON TRUE GROUP BY 1""")

# ---------------------------------------------------------------- M2: account of late rows
ARRIVALS = """
span AS (SELECT min(epoch_us(event_time)) AS lo, max(epoch_us(event_time)) AS hi FROM clicks),
sent AS (
  SELECT event_id, event_time, user_session, c.c AS copy,
         (epoch_us(event_time) - lo) * 3 // (hi - lo + 1) + c.c
           + CASE WHEN substr(md5('held' || CAST(event_id AS VARCHAR)), 1, 1) IN ('0', '1') THEN 1 ELSE 0 END AS b
  FROM clicks, span, (VALUES (0), (1)) c(c)
  WHERE c.c = 0 OR substr(md5('again' || CAST(event_id AS VARCHAR)), 1, 1) = '0'
),
marks AS (
  SELECT x.b, (SELECT max(event_time) FROM sent y WHERE y.b < x.b) - INTERVAL 1 DAY AS mark
  FROM (SELECT DISTINCT b FROM sent) x
),
judged AS (
  SELECT s.*, coalesce(s.event_time <= m.mark, false) AS late FROM sent s JOIN marks m ON m.b = s.b
)"""

SQL["stream_late_account"] = with_ctes(CLICKS, ARRIVALS, body="""
SELECT CAST(b AS BIGINT) AS batch_id, count(*) AS sent, count(*) FILTER (NOT late AND copy = 0) AS kept,
       count(*) FILTER (late) AS late, count(*) FILTER (NOT late AND copy = 1) AS repeated
FROM judged GROUP BY 1""")

SQL["stream_late_rows"] = with_ctes(CLICKS, ARRIVALS, body="""
SELECT event_id, event_time, user_session, CAST(b AS BIGINT) AS batch_id FROM judged WHERE late""")
