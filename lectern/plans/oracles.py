"""The same queries as SQL over the generic tables, for comparison in another engine."""

from __future__ import annotations

from lectern.functions.text import SPACES

MISSING = "'NaN'"


def _r(expr: str, digits: int = 6) -> str:
    """Rounded, with negative zero made positive."""
    return f"(round({expr}, {digits}) + 0.0)"


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def _cosine(a: str, b: str) -> str:
    return f"(1 - list_cosine_similarity({a}, {b}))"


def _l2(a: str, b: str) -> str:
    return f"list_distance({a}, {b})"


def _numbers(c: str) -> str:
    """All numbers of a vector, to six places, as a digest."""
    return f"md5(array_to_string(list_transform({c}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ','))"


# Named parts, each using only parts above it.
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def _part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (sql, needs)


SHARED = ("doc_words", "raw_weights")  # steps that several later ones read


def _sql(body: str, *needs: str) -> str:
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for other in PARTS[name][1]:
                add(other)

    for name in needs:
        add(name)
    chosen = [
        f"{name} AS {'MATERIALIZED ' if name in SHARED else ''}({sql})" for name, (sql, _) in PARTS.items() if name in wanted
    ]
    return f"WITH {', '.join(chosen)} {body}" if chosen else body


def _second_snapshot(body: str, *needs: str) -> str:
    """The same over the books of the second snapshot only."""
    whole = "AS author FROM documents"
    return _sql(body, *needs).replace(whole, f"{whole} WHERE doc_id % 7 <> 2", 1)


def _titled_by_text(sql: str) -> str:
    """The same over books whose title is the start of their text."""
    return sql.replace("concat_ws(' ', lang, doc_id, source) AS title", "substring(text, 1, 40) AS title", 1)


# --- domain -----------------------------------------------------------------------------------------------

_part(
    "history",
    """SELECT 'u' || user_id || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS sid,
        CAST(user_id AS INTEGER) AS uid,
        CAST(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 25 AS INTEGER) AS bid,
        CASE event_type WHEN 'purchase' THEN 'read' WHEN 'error' THEN 'skip' ELSE event_type END AS action,
        CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, event_id FROM events""",
)
_part("ui", "SELECT * FROM history WHERE action <> 'view'", "history")
_part("rec", "SELECT * EXCLUDE (action) FROM history WHERE action = 'view'", "history")
_part(
    "books",
    f"""SELECT CAST(2 * doc_id + 1 AS INTEGER) AS idx, CAST(doc_id AS INTEGER) AS id,
        concat_ws(' ', lang, doc_id, source) AS title,
        CASE WHEN doc_id % 13 = 0 THEN {MISSING} ELSE text END AS summary,
        CASE WHEN doc_id % 11 = 0 THEN '' ELSE source || '/' || doc_id || '/cover.jpg' END AS image,
        source AS author FROM documents""",
)
_part(
    "vectors",
    """SELECT b.id, CAST(t.embedding AS DOUBLE[]) AS title_embed, CAST(s.embedding AS DOUBLE[]) AS summary_embed
        FROM books b LEFT JOIN embeddings t ON t.vec_id = b.id + 1 LEFT JOIN embeddings s ON s.vec_id = b.id""",
    "books",
)
_part("langs", "SELECT lang, CAST(99 + row_number() OVER (ORDER BY lang) AS INTEGER) AS id FROM (SELECT DISTINCT lang FROM documents)")
_part(
    "tags",
    """SELECT label + 1 AS id, 'label_' || label AS name, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS tag_embed
        FROM embeddings GROUP BY label
        UNION ALL
        SELECT l.id, 'lang_' || l.lang,
            CAST((SELECT arg_min(e.embedding, e.vec_id) FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
                WHERE d.lang = l.lang) AS DOUBLE[]) FROM langs l""",
    "langs",
)
_part(
    "bridge",
    """SELECT CAST(d.doc_id AS INTEGER) AS book_id, e.label + 1 AS tag_id
        FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
        UNION ALL
        SELECT CAST(d.doc_id AS INTEGER), l.id FROM documents d JOIN langs l ON l.lang = d.lang""",
    "langs",
)
_part("source_bridge", "SELECT * FROM bridge WHERE (book_id + tag_id) % 10 <> 3", "bridge")
_part("target_bridge", "SELECT * FROM bridge WHERE (book_id + tag_id) % 7 <> 2", "bridge")
_part("source_books", "SELECT * FROM books WHERE id % 10 <> 3", "books")
_part("target_books", "SELECT * FROM books WHERE id % 7 <> 2", "books")
_part(
    "questions",
    """SELECT b.item_id AS query_id, b.text AS query, CAST(e.embedding AS DOUBLE[]) AS query_embed
        FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id""",
)
_part(
    "model",
    """SELECT o_orderkey AS id,
        list_extract(['weights', 'optim', 'metadata', 'losses', 'adapter', 'adapter_losses'], CAST(o_orderkey % 6 AS INTEGER) + 1) AS type,
        [o_totalprice, o_totalprice / 2, o_totalprice / 4] AS weights, o_orderdate AS timestamp FROM orders""",
)
_part(
    "ranked_model",
    "SELECT *, CAST(row_number() OVER (PARTITION BY type ORDER BY timestamp DESC, id DESC) AS INTEGER) AS training_round FROM model",
    "model",
)

# --- warehouse --------------------------------------------------------------------------------------------


def _days(first: str, last: str) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS timeid, CAST(d AS DATE) AS date,
        CAST(day(d) AS INTEGER) AS day, CAST(month(d) AS INTEGER) AS month, CAST(year(d) AS INTEGER) AS year,
        CAST(quarter(d) AS INTEGER) AS quarter, rpad(dayname(d), 9, ' ') AS day_name,
        CAST(week(d) AS INTEGER) AS week_of_year, dayofweek(d) IN (6, 0) AS is_weekend
        FROM generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 DAY) AS s(d)"""


_part("days", _days("2024-01-01", "2026-12-31"))
_part("calendar", _days("1990-01-01", "2029-12-31"))
_part(
    "actions",
    """SELECT * FROM (VALUES (1, 'click', 'User clicked the book'), (2, 'read', 'User read the book'),
        (3, 'skip', 'User skipped (not care) the book')) AS a(actionid, actionname, description)""",
)


def _staged(history: str, action: bool) -> str:
    named = "a.actionid, " if action else ""
    joined = "LEFT JOIN actions a ON a.actionname = h.action" if action else ""
    return f"""SELECT h.sid AS sessionid, h.uid AS userid, h.bid AS bookid, {named}t.timeid, h.timestamp AS created_at
        FROM {history} h LEFT JOIN days t ON t.date = CAST(make_timestamp(h.timestamp * 1000000) AS DATE) {joined}"""


_KEYS = "f.sessionid = s.sessionid AND f.userid = s.userid AND f.bookid = s.bookid AND f.created_at = s.created_at"
_END = 1705363200

_part("ui_staged", _staged("ui", True), "ui", "days", "actions")
_part("ui_first", f"SELECT * FROM ui_staged WHERE created_at < {_END} AND actionid IS NOT NULL AND timeid IS NOT NULL", "ui_staged")
_part("ui_fresh", f"SELECT * FROM ui_staged s WHERE NOT EXISTS (SELECT 1 FROM ui_first f WHERE {_KEYS})", "ui_staged", "ui_first")
_part(
    "fact_ui",
    "SELECT * FROM ui_first UNION ALL SELECT * FROM ui_fresh WHERE actionid IS NOT NULL AND timeid IS NOT NULL",
    "ui_first", "ui_fresh",
)
_part("rec_staged", _staged("rec", False), "rec", "days")
_part("rec_first", f"SELECT * FROM rec_staged WHERE created_at < {_END} AND timeid IS NOT NULL", "rec_staged")
_part(
    "fact_rec",
    f"""SELECT * FROM rec_first UNION ALL SELECT * FROM rec_staged s
        WHERE timeid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rec_first f WHERE {_KEYS})""",
    "rec_staged", "rec_first",
)
_part(
    "outcome",
    """SELECT CAST(date AS VARCHAR) AS recommendation_date, actionname AS action_type,
        count(*) FILTER (actionname = 'skip') AS total_skipped,
        count(*) FILTER (actionname = 'click') AS total_clicked,
        count(*) FILTER (actionname = 'read') AS total_read,
        count(*) FILTER (acted IS NULL) AS total_no_interaction,
        count(DISTINCT bookid) AS total_recommended_books,
        count(*) AS total_recommendations
        FROM fact_rec
        LEFT JOIN (SELECT userid, bookid, timeid, actionid, true AS acted FROM fact_ui) USING (userid, bookid, timeid)
        LEFT JOIN actions USING (actionid)
        JOIN days USING (timeid)
        GROUP BY ALL""",
    "fact_rec", "fact_ui", "actions", "days",
)
_part(
    "analysis",
    """SELECT t.year, t.quarter, t.month, a.actionname, count(*) AS action_count,
        count(DISTINCT u.userid) AS unique_users, count(DISTINCT u.bookid) AS unique_books
        FROM fact_ui u JOIN days t ON t.timeid = u.timeid JOIN actions a ON a.actionid = u.actionid
        GROUP BY t.year, t.quarter, t.month, a.actionname""",
    "fact_ui", "days", "actions",
)
_part(
    "per_user",
    f"""SELECT year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS month_label, actionname,
        {_r('action_count / unique_users')} AS action_per_user FROM analysis""",
    "analysis",
)
_part(
    "curves",
    """SELECT type, training_round, id, generate_subscripts(weights, 1) - 1 AS epoch, unnest(weights) AS loss
        FROM ranked_model WHERE training_round <= 3""",
    "ranked_model",
)

# --- sessions ---------------------------------------------------------------------------------------------

_part(
    "items",
    "SELECT id, idx, CAST(row_number() OVER (ORDER BY idx) - 1 AS INTEGER) AS item FROM books",
    "books",
)
_REWARD = "CASE {a} WHEN 'click' THEN 1 WHEN 'skip' THEN -1 WHEN 'read' THEN 2 ELSE 0 END"
_part(
    "steps",
    f"""SELECT h.sid, h.event_id, h.bid, i.item, {_REWARD.format(a='h.action')} AS reward,
        row_number() OVER (PARTITION BY h.sid ORDER BY h.timestamp, h.event_id) - 1 AS step
        FROM ui h JOIN items i ON i.id = h.bid""",
    "ui", "items",
)
_part(
    "full_steps",
    f"""SELECT *, coalesce(string_agg(item || ':' || reward, ',') OVER before, '') AS state,
        {_r('sum(reward * 0.99 ** step) OVER rest / 0.99 ** step')} AS ret
        FROM steps
        WINDOW before AS (PARTITION BY sid ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
            rest AS (PARTITION BY sid ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "steps",
)
_part(
    "known",
    f"SELECT *, {_REWARD.format(a='action')} AS reward FROM ui WHERE action IN ('click', 'skip', 'read')",
    "ui",
)
_part(
    "last5",
    """SELECT sid, event_id, first_value(uid) OVER recent AS state_uid,
        string_agg(bid || ':' || reward, ',') OVER recent AS last
        FROM known
        WINDOW recent AS (PARTITION BY sid ORDER BY timestamp, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "known",
)
_part(
    "last5_silent",
    """SELECT sid, event_id, first_value(uid) OVER recent AS state_uid, string_agg(bid || ':' || reward, ',') OVER recent AS last
        FROM (SELECT *, sum(CAST(gap > 86400 AS INTEGER)) OVER (PARTITION BY sid ORDER BY timestamp, event_id) AS part
            FROM (SELECT *, timestamp - lag(timestamp, 1, timestamp) OVER (PARTITION BY sid ORDER BY timestamp, event_id) AS gap
                FROM known))
        WINDOW recent AS (PARTITION BY sid, part ORDER BY timestamp, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "known",
)
_part(
    "ends",
    "SELECT *, row_number() OVER (PARTITION BY sid ORDER BY timestamp DESC, event_id DESC) AS back FROM known",
    "known",
)
_part(
    "last_state",
    """SELECT sid, arg_max(uid, back) AS uid, string_agg(bid || ':' || reward, ',' ORDER BY back DESC) AS last
        FROM ends WHERE back <= 5 GROUP BY sid""",
    "ends",
)

# --- retrieval --------------------------------------------------------------------------------------------


def _split(text: str) -> str:
    return f"regexp_split_to_array(lower({text}), '{SPACES}+')"


_part(
    "doc_words",
    f"""SELECT id, word, place FROM (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS place
        FROM (SELECT id, {_split("title || ' ' || summary")} AS w FROM books)) WHERE word <> ''""",
    "books",
)
_part("doc_lengths", "SELECT id, count(*) AS words FROM doc_words GROUP BY id", "doc_words")
_part(
    "totals",
    "SELECT (SELECT count(*) FROM books) AS n_docs, sum(words) / (SELECT count(*) FROM books) AS avg_length FROM doc_lengths",
    "books", "doc_lengths",
)
_part("frequencies", "SELECT word AS term, count(*) AS df FROM (SELECT DISTINCT id, word FROM doc_words) GROUP BY word", "doc_words")
_part(
    "raw_weights",
    "SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf FROM frequencies, totals",
    "frequencies", "totals",
)
_part("floor", "SELECT 0.25 * avg(idf) AS least FROM raw_weights", "raw_weights")
_part(
    "weights",
    "SELECT term, df, CASE WHEN idf < 0 THEN least ELSE idf END AS idf FROM raw_weights CROSS JOIN floor",
    "raw_weights", "floor",
)
_part(
    "asked",
    f"""SELECT query_id, word AS term, count(*) AS times
        FROM (SELECT query_id, unnest({_split("query")}) AS word FROM questions)
        WHERE word <> '' GROUP BY query_id, word""",
    "questions",
)
_part(
    "counted",
    """SELECT d.id, d.word AS term, l.words, count(*) AS tf
        FROM doc_words d JOIN doc_lengths l USING (id)
        WHERE d.word IN (SELECT term FROM asked) GROUP BY d.id, d.word, l.words""",
    "doc_words", "doc_lengths", "asked",
)
_part(
    "scores",
    """SELECT a.query_id, c.id,
        sum(a.times * w.idf * c.tf * 2.5 / (c.tf + 1.5 * (0.25 + 0.75 * c.words / t.avg_length))) AS bm25_score
        FROM asked a JOIN counted c USING (term) JOIN weights w USING (term), totals t GROUP BY a.query_id, c.id""",
    "asked", "counted", "weights", "totals",
)
_part(
    "best_scores",
    """SELECT * FROM (SELECT query_id, id, bm25_score,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, id) AS INTEGER) AS rank FROM scores)
        WHERE rank <= 10""",
    "scores",
)
_part(
    "distances",
    f"""SELECT q.query_id, v.id, {_cosine('v.title_embed', 'q.query_embed')} AS title_similarity,
        {_cosine('v.summary_embed', 'q.query_embed')} AS summary_similarity
        FROM questions q, vectors v WHERE q.query_embed IS NOT NULL""",
    "questions", "vectors",
)
_part(
    "dense",
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
            ORDER BY round(combined_similarity, 12) NULLS LAST, id) AS INTEGER) AS dense_rank
        FROM (SELECT *, 0.5 * title_similarity + 0.75 * summary_similarity AS combined_similarity FROM distances))
        WHERE dense_rank <= 10""",
    "distances",
)
_part(
    "scored",
    """SELECT d.*, coalesce(s.bm25_score, 0.0) AS bm25_score FROM dense d
        LEFT JOIN scores s ON s.query_id = d.query_id AND s.id = d.id""",
    "dense", "scores",
)
_part(
    "suggestions",
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
            ORDER BY round(bm25_score, 9) DESC, round(combined_similarity, 12) NULLS LAST, id) AS INTEGER) AS rank
        FROM scored) s JOIN books b USING (id) WHERE rank <= 3""",
    "scored", "books",
)
_part(
    "hybrid",
    f"""SELECT query_id, rank, id, title,
        CASE WHEN image <> '' THEN '/media/calibre-library-image/' || image END AS image, author,
        md5(CASE WHEN summary = 'NaN' THEN 'No summary available' ELSE summary END) AS summary_digest,
        CASE WHEN summary_similarity IS NULL THEN 'No summary available' END AS summary_label,
        CASE WHEN title_similarity IS NULL THEN 'No title available' END AS title_label,
        CASE WHEN combined_similarity IS NULL THEN 'No combined similarity available' END AS combined_label,
        {_r('combined_similarity')} AS combined_similarity, {_r('bm25_score')} AS bm25_score FROM suggestions""",
    "suggestions",
)
_part(
    "contexts",
    """SELECT s.query_id, q.query, CAST(to_json(list({'id': s.id, 'title': s.title,
            'summary': CASE WHEN s.summary = 'NaN' THEN 'No summary available' ELSE s.summary END} ORDER BY s.rank)) AS VARCHAR) AS context
        FROM suggestions s JOIN questions q USING (query_id) GROUP BY s.query_id, q.query""",
    "suggestions", "questions",
)

# --- triplets and recommender -----------------------------------------------------------------------------

_part(
    "nearest",
    f"""SELECT id, neg_id, distance FROM (SELECT a.id, b.id AS neg_id, {_l2('a.tag_embed', 'b.tag_embed')} AS distance,
            row_number() OVER (PARTITION BY a.id ORDER BY {_l2('a.tag_embed', 'b.tag_embed')}, b.id) AS n
        FROM tags a JOIN tags b ON a.id <> b.id WHERE a.tag_embed IS NOT NULL AND b.tag_embed IS NOT NULL) WHERE n = 1""",
    "tags",
)
_part(
    "triplets",
    """SELECT g.tag_id, g.book_id, n.neg_id, a.tag_embed AS anchor, v.summary_embed AS pos, o.tag_embed AS neg
        FROM bridge g JOIN tags a ON a.id = g.tag_id JOIN vectors v ON v.id = g.book_id
        LEFT JOIN nearest n ON n.id = g.tag_id LEFT JOIN tags o ON o.id = n.neg_id""",
    "bridge", "tags", "vectors", "nearest",
)
_part(
    "evaluated",
    f"""SELECT tag_id, book_id, neg_id, {_cosine('anchor', 'pos')} AS distance_pos, {_cosine('anchor', 'neg')} AS distance_neg,
        {_cosine('anchor[1:32]', 'pos[1:32]')} AS adapted_distance_pos,
        {_cosine('anchor[1:32]', 'neg[1:32]')} AS adapted_distance_neg FROM triplets""",
    "triplets",
)
_RES = "CASE WHEN adapted_distance_pos < adapted_distance_neg THEN 1 ELSE 0 END"
_part(
    "entries",
    """SELECT e.sid, e.back, CASE e.reward WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE -1.0 END AS weight, v.summary_embed AS vector
        FROM ends e JOIN vectors v ON v.id = e.bid WHERE e.back <= 5""",
    "ends", "vectors",
)
_part(
    "state_numbers",
    """SELECT sid, place, sum(weight * x) / max(n) AS x FROM (
            SELECT sid, weight, unnest(vector) AS x, generate_subscripts(vector, 1) AS place, n
            FROM entries JOIN (SELECT sid, count(*) AS n FROM ends WHERE back <= 5 GROUP BY sid) USING (sid))
        GROUP BY sid, place""",
    "entries", "ends",
)
_part("state_vectors", "SELECT sid, list(x ORDER BY place) AS state FROM state_numbers GROUP BY sid", "state_numbers")
_part(
    "logits",
    f"""SELECT s.sid, i.id AS bid, i.item, {_dot('s.state', 'v.summary_embed')} AS logit
        FROM state_vectors s, vectors v JOIN items i ON i.id = v.id WHERE v.summary_embed IS NOT NULL""",
    "state_vectors", "vectors", "items",
)
_part(
    "recommended",
    f"""SELECT sid, uid, rank, bid, item, {_r('logit')} AS logit, {_r('exp(logit) / mass')} AS probability FROM (
            SELECT *, sum(exp(logit)) OVER (PARTITION BY sid) AS mass,
                CAST(row_number() OVER (PARTITION BY sid ORDER BY round(logit, 12) DESC, item) AS INTEGER) AS rank FROM logits)
        JOIN last_state USING (sid) WHERE rank <= 5""",
    "logits", "last_state",
)

# The first update of a fit starts at zeros, where all N items are equally probable.
_part(
    "raw_steps",
    """SELECT sid, item, sum(reward * 0.99 ** step) OVER rest / 0.99 ** step AS ret,
        count(*) OVER (PARTITION BY sid) AS size, list({'item': item, 'reward': reward}) OVER before AS state FROM steps
        WINDOW before AS (PARTITION BY sid ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
            rest AS (PARTITION BY sid ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "steps",
)
_part(
    "with_vector",
    """SELECT i.item, i.id, v.summary_embed AS vector FROM items i JOIN vectors v ON v.id = i.id
        WHERE v.summary_embed IS NOT NULL""",
    "items", "vectors",
)
_part("scored_steps", "SELECT * FROM raw_steps SEMI JOIN with_vector USING (item)", "raw_steps", "with_vector")
_part(
    "sizes_of_fit",
    """SELECT (SELECT count(*) FROM with_vector) AS n, (SELECT max(len(vector)) FROM with_vector) AS dim,
        (SELECT count(DISTINCT sid) FROM raw_steps) AS sessions""",
    "with_vector", "raw_steps",
)
_part(
    "pushes",
    """SELECT item, place, sum(push) AS push FROM (
            SELECT item, generate_subscripts(vector, 1) - 1 AS place, unnest(vector) * share AS push FROM (
                SELECT r.item, v.vector, r.ret * CASE e.reward WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE -1.0 END / r.n AS share
                FROM (SELECT item, ret, len(state) AS n, unnest(state) AS e FROM scored_steps) r
                JOIN with_vector v ON v.item = r.e.item)
            UNION ALL SELECT item, dim, ret FROM scored_steps, sizes_of_fit)
        GROUP BY item, place""",
    "scored_steps", "with_vector", "sizes_of_fit",
)
_part(
    "first_gradient",
    """SELECT v.id, t.place, (t.push / z.n - coalesce(p.push, 0)) / z.sessions AS slope
        FROM with_vector v CROSS JOIN (SELECT place, sum(push) AS push FROM pushes GROUP BY place) t CROSS JOIN sizes_of_fit z
        LEFT JOIN pushes p ON p.item = v.item AND p.place = t.place""",
    "with_vector", "pushes", "sizes_of_fit",
)

# --- the queries ------------------------------------------------------------------------------------------

_BOOK = "id, title, image, author"
_TAG_LIST = """coalesce((SELECT string_agg(t.name, '|' ORDER BY t.name) FROM bridge g JOIN tags t ON t.id = g.tag_id
    WHERE g.book_id = b.id), '')"""
_PATH = "p_type || '/' || p_name || '''s ' || p_partkey"


def _asset(suffix: str) -> str:
    return f"replace({_PATH} || '{suffix}', '''', '_')"


def _clean(c: str) -> str:
    return f"""coalesce(trim(regexp_replace(regexp_replace({c}, '<.*?>', '', 'g'), '{SPACES}+', ' ', 'g')), 'NaN')"""


_AUTHORED = """(SELECT l_partkey, string_agg(s_name, ', ' ORDER BY s_name) AS author
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey)"""

ORACLES: dict[str, str] = {
    "dim_time": _sql(
        """SELECT CAST(c.date AS VARCHAR) AS date, c.* EXCLUDE (date), o.orders
        FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders FROM orders GROUP BY 1) o JOIN calendar c USING (date)""",
        "calendar",
    ),
    "dim_action": _sql(
        """SELECT h.action, h.interactions, CAST(a.actionid AS VARCHAR) AS actionid, a.description
        FROM (SELECT action, count(*) AS interactions FROM history GROUP BY action) h
        LEFT JOIN actions a ON a.actionname = h.action""",
        "history", "actions",
    ),
    "lookup_dims": _sql(
        f"""SELECT timeid, CAST(actionid AS VARCHAR) AS actionid, count(*) AS events, min(created_at) AS first_at
        FROM ({_staged('history', True)}) GROUP BY timeid, actionid""",
        "history", "days", "actions",
    ),
    "fact_interaction_load": _sql("SELECT * FROM fact_ui", "fact_ui"),
    "fact_recommendation_load": _sql("SELECT * FROM fact_rec", "fact_rec"),
    "stored_facts": _sql("SELECT * FROM fact_ui", "fact_ui"),
    **{
        name: _sql(
            "SELECT * REPLACE (CAST(actionid AS VARCHAR) AS actionid) FROM ui_fresh WHERE actionid IS NULL OR timeid IS NULL",
            "ui_fresh",
        )
        for name in ("fact_rejects", "stored_rejects")
    },
    "rec_outcomes": _sql(
        """SELECT userid, bookid, timeid, CAST(u.actionid AS VARCHAR) AS actionid, r.n AS recommended,
            coalesce(u.n, 0) AS acted, r.n * coalesce(u.n, 1) AS pairs
        FROM (SELECT userid, bookid, timeid, count(*) AS n FROM fact_rec GROUP BY ALL) r
        LEFT JOIN (SELECT userid, bookid, timeid, actionid, count(*) AS n FROM fact_ui GROUP BY ALL) u
        USING (userid, bookid, timeid)""",
        "fact_rec", "fact_ui",
    ),
    "rec_outcome_by_action": _sql("SELECT * FROM outcome ORDER BY 1, 2", "outcome"),
    "user_interaction_analysis": _sql("SELECT * FROM analysis", "analysis"),
    "actions_per_user_month": _sql("SELECT * FROM per_user", "per_user"),
    "chart_rec_by_action": _sql(
        "SELECT recommendation_date, action_type, total_recommended_books FROM outcome WHERE action_type IS NOT NULL",
        "outcome",
    ),
    "dashboard": _sql(
        f"""SELECT 'recommended_books_by_action' AS chart, action_type AS line, recommendation_date AS x,
            CAST(total_recommended_books AS DOUBLE) AS y FROM outcome WHERE action_type IS NOT NULL
        UNION ALL SELECT 'actions_per_user', actionname, month_label, action_per_user FROM per_user
        UNION ALL SELECT CASE type WHEN 'losses' THEN 'policy_losses' ELSE 'adapter_losses' END,
            CAST(training_round AS VARCHAR), CAST(epoch AS VARCHAR), {_r('loss')} FROM curves
            WHERE type IN ('losses', 'adapter_losses')""",
        "outcome", "per_user", "curves",
    ),
    "catalogue_extract": f"""SELECT p_partkey AS id, p_name AS title, author, {_asset('/metadata.opf')} AS summary,
        {_asset('/cover.jpg')} AS image, {_asset('/*.pdf')} AS pdf_file, CAST(1704067200 AS BIGINT) AS created_date
        FROM part JOIN {_AUTHORED} ON l_partkey = p_partkey""",
    "catalogue_tags": """SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS id, count(*) AS books, p_brand AS name
        FROM part GROUP BY p_brand""",
    "asset_paths": f"""SELECT p_partkey AS id, {_PATH} AS path, {_PATH} || '/metadata.opf' AS sidecar,
        {_asset('/metadata.opf')} AS summary, {_asset('/cover.jpg')} AS image, {_asset('/*.pdf')} AS pdf_file FROM part""",
    "media_urls": _titled_by_text(_sql(
        "SELECT id, title, CASE WHEN image <> '' THEN '/media/calibre-library-image/' || image END AS image FROM books",
        "books",
    )),
    "diff_new_keys": _sql("SELECT id FROM source_books EXCEPT SELECT id FROM target_books", "source_books", "target_books"),
    "diff_deleted_keys": _sql("SELECT id FROM target_books EXCEPT SELECT id FROM source_books", "source_books", "target_books"),
    "diff_composite_key": _sql(
        """SELECT *, 'new' AS change FROM (SELECT * FROM source_bridge EXCEPT SELECT * FROM target_bridge)
        UNION ALL SELECT *, 'deleted' FROM (SELECT * FROM target_bridge EXCEPT SELECT * FROM source_bridge)""",
        "source_bridge", "target_bridge",
    ),
    "apply_diff_soft": _sql(
        """SELECT id, idx, title, id IN (SELECT id FROM source_books) AS active FROM target_books
        UNION ALL
        SELECT id, CAST((SELECT max(idx) FROM target_books) + row_number() OVER (ORDER BY id) AS INTEGER), title, true
        FROM source_books WHERE id NOT IN (SELECT id FROM target_books)""",
        "source_books", "target_books",
    ),
    "apply_diff_hard": _sql("SELECT * FROM source_bridge", "source_bridge"),
    "transform_new": _titled_by_text(_sql(
        f"""SELECT b.id, b.title, {_clean('p.html')} AS summary, 768 AS title_dim, 768 AS summary_dim
        FROM source_books b LEFT JOIN pages p ON p.page_id = b.id WHERE b.id NOT IN (SELECT id FROM target_books)""",
        "source_books", "target_books",
    )),
    "catalogue_etl": f"""WITH extracted AS (SELECT CAST(p_partkey AS INTEGER) AS id, p_name AS title, author,
            {_clean('html')} AS summary, {_asset('/cover.jpg')} AS image
            FROM part JOIN {_AUTHORED} ON l_partkey = p_partkey LEFT JOIN pages ON page_id = p_partkey),
        kept AS (SELECT *, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS idx FROM extracted WHERE id % 7 <> 2)
        SELECT id, idx, title, author, summary, image, id % 10 <> 3 AS active, 768 AS dim FROM kept
        UNION ALL
        SELECT id, CAST((SELECT max(idx) FROM kept) + row_number() OVER (ORDER BY id) AS INTEGER), title, author, summary,
            image, true, 768
        FROM extracted WHERE id % 7 = 2 AND id % 10 <> 3""",
    "catalogue_etl_links": """WITH brands AS (SELECT *, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS tag FROM part),
        tags AS (SELECT DISTINCT tag AS tag_id, p_brand AS name, 768 AS dim FROM brands WHERE tag % 10 <> 3),
        pairs AS (SELECT CAST(p_partkey AS INTEGER) AS book_id, tag AS tag_id FROM brands WHERE p_partkey % 4 <> 0)
        SELECT tag_id, book_id, name, dim FROM pairs FULL JOIN tags USING (tag_id)""",
    "item_positions": _sql("SELECT * FROM items", "items"),
    "books_with_tags": _sql(f"SELECT {_BOOK}, {_TAG_LIST} AS tags FROM books b", "books", "bridge", "tags"),
    "tags_with_books": _sql(
        f"""SELECT t.id, t.name, CAST(g.book_id // 1000 AS INTEGER) AS page, g.book_id, l.title, l.tags
        FROM tags t JOIN bridge g ON g.tag_id = t.id
        JOIN (SELECT b.id, b.title, {_TAG_LIST} AS tags FROM books b) l ON l.id = g.book_id""",
        "books", "bridge", "tags",
    ),
    "tags_of": _sql("SELECT id, name FROM tags WHERE id IN (SELECT tag_id FROM bridge WHERE book_id = 42)", "tags", "bridge"),
    "books_of": _sql(f"SELECT {_BOOK} FROM books WHERE id IN (SELECT book_id FROM bridge WHERE tag_id = 100)", "books", "bridge"),
    "search_title": _sql(f"SELECT {_BOOK} FROM books WHERE contains(upper(title), 'EN 1')", "books"),
    "search_author": _sql(f"SELECT {_BOOK} FROM books WHERE contains(upper(author), 'SRC1')", "books"),
    "search_tags": _sql(
        f"""SELECT {_BOOK} FROM books WHERE id IN (SELECT book_id FROM bridge WHERE tag_id IN
            (SELECT id FROM tags WHERE contains(upper(name), 'LABEL_1')))""",
        "books", "bridge", "tags",
    ),
    "search_blank": _sql(f"SELECT {_BOOK} FROM books", "books"),
    "book_detail": _sql(
        f"SELECT id, title, '/media/calibre-library-image/' || image AS image, author, {_TAG_LIST} AS tags FROM books b WHERE id = 42",
        "books", "bridge", "tags",
    ),
    "clean_html": f"SELECT page_id, {_clean('html')} AS description FROM pages",
    "missing_text": f"""SELECT doc_id, summary, CASE WHEN summary = 'NaN' THEN 'No summary available' ELSE summary END AS shown,
        CASE WHEN summary = 'NaN' THEN 'No summary available.' ELSE summary END AS prompted
        FROM (SELECT doc_id, {_clean('html')} AS summary FROM documents LEFT JOIN pages ON page_id = doc_id)""",
    "tokenize": _sql(
        """SELECT b.id, CAST(count(word) AS INTEGER) AS words, CAST(count(DISTINCT word) AS INTEGER) AS distinct_words,
        md5(coalesce(string_agg(word, ' ' ORDER BY place), '')) AS digest
        FROM books b LEFT JOIN doc_words d ON d.id = b.id GROUP BY b.id""",
        "books", "doc_words",
    ),
    "xml_description": f"""SELECT doc_id, doc_id % 17 <> 0 AND doc_id % 19 = 0 AS absent,
        CASE WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 THEN 'NaN' ELSE {_clean('text')} END AS summary FROM documents""",
    "sidecar_files": f"""SELECT doc_id, doc_id % 17 <> 0 AND doc_id % 19 = 0 AS absent,
        CASE WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 THEN 'NaN' ELSE {_clean('text')} END AS summary FROM documents""",
    "embed_text": f"""WITH hashed AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 15) AS BIGINT) AS h
            FROM (SELECT doc_id, unnest({_split('text')}) AS word FROM documents) WHERE word <> ''),
        summed AS (SELECT doc_id, CAST(h % 256 AS INTEGER) AS place, sum(CASE WHEN (h >> 32) % 2 = 1 THEN -1.0 ELSE 1.0 END) AS x
            FROM hashed GROUP BY ALL),
        scaled AS (SELECT doc_id, place, CAST(CAST(x AS DOUBLE) / sqrt(CAST(sum(x * x) OVER (PARTITION BY doc_id) AS DOUBLE)) AS FLOAT) AS value
            FROM summed)
        SELECT doc_id, place, {_r('CAST(value AS DOUBLE)')} AS value FROM scaled WHERE value <> 0""",
    "embed_default": "SELECT doc_id, 256 AS dim, CAST(1 AS DOUBLE) AS length FROM documents",
    "reward_total": _sql(
        f"""SELECT * EXCLUDE (timestamp), CASE reward WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS category
        FROM (SELECT *, {_REWARD.format(a='action')} AS reward FROM history)""",
        "history",
    ),
    "reward_rejects": _sql("SELECT * FROM ui WHERE action NOT IN ('click', 'skip', 'read')", "ui"),
    "valid_events": _sql(
        "SELECT * FROM ui WHERE bid <> 0 AND uid <> 0 AND action <> '' AND sid <> ''", "ui"
    ),
    "session_order": _sql(
        "SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY timestamp, event_id) - 1 AS step, event_id FROM ui", "ui"
    ),
    "history_items": _sql("SELECT sid, event_id, bid, item, reward FROM steps", "steps"),
    "session_sequence": _sql(
        """SELECT sid, CAST(0 AS BIGINT) AS first_step, string_agg(item || ':' || reward, ',' ORDER BY step) AS sequence
        FROM steps GROUP BY sid""",
        "steps",
    ),
    "sliding_state": _sql("SELECT sid, step, item, state FROM full_steps", "full_steps"),
    "discounted_return": _sql("SELECT sid, step, reward, ret FROM full_steps", "full_steps"),
    "training_steps": _sql("SELECT sid, step, bid, item, reward, state, ret FROM full_steps", "full_steps"),
    "last5_serving": _sql("SELECT * FROM last5", "last5"),
    "last_state": _sql("SELECT * FROM last_state", "last_state"),
    "cosine_pairs": _sql(
        f"""SELECT id, {_r(_cosine('title_embed', 'summary_embed'))} AS cosine, {_r(_l2('title_embed', 'summary_embed'))} AS l2,
        {_r(_dot('title_embed', 'summary_embed'))} AS dot FROM vectors""",
        "vectors",
    ),
    "vector_text": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, 0.0::DOUBLE AS l2, 0.0::DOUBLE AS combined FROM embeddings",
    "l2_nearest_tag": _sql(f"SELECT id, neg_id, {_r('distance')} AS distance FROM nearest", "nearest"),
    "dense_top10": _sql(
        f"""SELECT query_id, id, {_r('title_similarity')} AS title_similarity, {_r('summary_similarity')} AS summary_similarity,
        {_r('combined_similarity')} AS combined_similarity, dense_rank FROM dense""",
        "dense",
    ),
    "corpus_stats": _sql(f"SELECT term, df, {_r('idf')} AS idf FROM weights", "weights"),
    "corpus_totals": _sql(f"SELECT n_docs, {_r('avg_length')} AS avg_length FROM totals", "totals"),
    "bm25_scores": _titled_by_text(_sql(f"SELECT query_id, id, {_r('bm25_score')} AS bm25_score FROM scores", "scores")),
    "corpus_stats_updated": _second_snapshot(f"SELECT term, df, {_r('idf')} AS idf FROM weights", "weights"),
    "bm25_updated": _second_snapshot(
        f"SELECT query_id, id, {_r('bm25_score')} AS bm25_score, rank FROM best_scores", "best_scores"
    ),
    "attach_bm25": _sql(f"SELECT query_id, id, dense_rank, {_r('bm25_score')} AS bm25_score FROM scored", "scored"),
    "hybrid_search": _sql("SELECT * FROM hybrid", "hybrid"),
    "prompt_context": _sql(
        "SELECT *, 'User input: ' || query || chr(10) || 'Book suggestions:' || chr(10) || context AS prompt FROM contexts",
        "contexts",
    ),
    "mine_triplets": _sql(
        f"""SELECT tag_id, book_id, neg_id, pos IS NOT NULL AS has_pos, {_numbers('anchor')} AS anchor,
        {_numbers('pos')} AS pos, {_numbers('neg')} AS neg FROM triplets""",
        "triplets",
    ),
    "triplet_csv": _sql(
        f"SELECT {_numbers('anchor')} AS anchor, {_numbers('pos')} AS pos, {_numbers('neg')} AS neg FROM triplets", "triplets"
    ),
    "prompt_log": _sql("SELECT context, query FROM contexts", "contexts"),
    "saved_models": _sql(
        f"""SELECT type, dense_rank() OVER (ORDER BY type) AS id, CAST(place - 1 AS INTEGER) AS place, {_r('weight', 4)} AS weight
        FROM (SELECT type, unnest(weights) AS weight, generate_subscripts(weights, 1) AS place
            FROM ranked_model WHERE training_round = 1)""",
        "ranked_model",
    ),
    "event_messages": _sql("SELECT sid, uid, bid, action, timestamp FROM ui", "ui"),
    "created_tables": _sql("SELECT sid, uid, bid, action, timestamp FROM ui", "ui"),
    "evaluate_triplets": _sql(
        f"""SELECT tag_id, book_id, neg_id, {_r('distance_pos')} AS distance_pos, {_r('distance_neg')} AS distance_neg,
        {_r('adapted_distance_pos')} AS adapted_distance_pos, {_r('adapted_distance_neg')} AS adapted_distance_neg,
        {_RES} AS res FROM evaluated""",
        "evaluated",
    ),
    "correct_triplets": _sql(f"SELECT {_RES} AS res, count(*) AS count FROM evaluated GROUP BY 1", "evaluated"),
    "adapter_output": f"""SELECT vec_id, CAST(generate_subscripts(embedding[1:16], 1) - 1 AS INTEGER) AS place,
        {_r('CAST(CAST(2 * CAST(unnest(embedding[1:16]) AS DOUBLE) + 1 AS FLOAT) AS DOUBLE)', 5)} AS value FROM embeddings""",
    "latest_model": _sql(
        f"""SELECT type, id, CAST(place - 1 AS INTEGER) AS place, {_r('weight', 4)} AS weight
        FROM (SELECT type, id, unnest(weights) AS weight, generate_subscripts(weights, 1) AS place
            FROM ranked_model WHERE training_round = 1)""",
        "ranked_model",
    ),
    "last3_models": _sql("SELECT type, training_round, id FROM ranked_model WHERE training_round <= 3", "ranked_model"),
    "last3_losses": _sql(
        f"""SELECT training_round, id, CAST(epoch AS INTEGER) AS epoch, {_r('loss', 4)} AS loss FROM curves
        WHERE type = 'losses'""",
        "curves",
    ),
    "model_metadata": _sql(
        "SELECT CAST(max(len(summary_embed)) AS INTEGER) AS embedding_dim, count(*) AS action_dim FROM vectors", "vectors"
    ),
    "recommend_top5": _sql("SELECT * FROM recommended", "recommended"),
    "first_fit_loss": _sql(
        f"""SELECT {_r('sum(ln(n) * (ret - 0.01 / size)) / any_value(sessions) ** 2', 9)} AS loss
            FROM scored_steps, sizes_of_fit""",
        "scored_steps", "sizes_of_fit",
    ),
    "first_fit_update": _sql(
        f"""SELECT id, CAST(place AS INTEGER) AS place,
            {_r('slope / greatest(1.0, (SELECT sqrt(sum(slope * slope)) FROM first_gradient))', 7)} AS slope
            FROM first_gradient""",
        "first_gradient",
    ),
    "recommended_books": _sql(
        "SELECT r.bid, r.sid, r.uid, r.rank, b.title, b.author FROM recommended r JOIN books b ON b.id = r.bid",
        "recommended", "books",
    ),
    "stream_reward": _sql("SELECT event_id, sid, bid, reward FROM known", "known"),
    "stream_raw_log": _sql("SELECT event_id, sid, uid, bid, action FROM ui", "ui"),
    "stream_drain": _sql("SELECT sid, uid, bid, action, timestamp FROM ui", "ui"),
    "stream_last5": _sql("SELECT * FROM last5", "last5"),
    "last5_since_silence": _sql("SELECT * FROM last5_silent", "last5_silent"),
    "stream_since_silence": _sql("SELECT * FROM last5_silent", "last5_silent"),
    "stream_resumed": _sql(
        """SELECT uid, string_agg(bid, ',' ORDER BY rank) AS bids, string_agg(bid, ',' ORDER BY rank) AS logged FROM recommended
        WHERE sid IN (SELECT arg_max(sid, event_id) FROM known GROUP BY uid) GROUP BY uid""",
        "recommended", "known",
    ),
    "stream_rejects": _sql(
        "SELECT event_id, sid, uid, bid, action FROM ui WHERE action NOT IN ('click', 'skip', 'read')", "ui"
    ),
    "stream_recommend": _sql(
        """SELECT uid, string_agg(bid, ',' ORDER BY rank) AS bids FROM recommended
        WHERE sid IN (SELECT arg_max(sid, event_id) FROM known GROUP BY uid) GROUP BY uid""",
        "recommended", "known",
    ),
}
