"""SQL counterparts of the registered queries, for an engine that has the given tables as views.

They are written relationally and on their own, so that they check the DataFrame operators.
"""

from __future__ import annotations

from tallyvox import fixed_values as fixed
from tallyvox.plans import models
from tallyvox.plans.adapters import POSTS_DOCUMENTS, POSTS_EVENTS, POSTS_THREADS

PE = f"({POSTS_EVENTS.format(events='events')}) pe"
PD = f"({POSTS_DOCUMENTS.format(documents='documents')}) pd"
PT = f"({POSTS_THREADS.format(conversations='conversations')}) pt"


# The same classes as in the text functions, in this engine's pattern language.
SPACE = (
    r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
CASED = r"\p{Lu}\p{Ll}\p{Lt}"
WORD = r"\p{L}\p{N}_"
TAG_PATTERN = r"[@#][\p{L}\p{N}_]+"
EDGE = r"!-/:-@\[-`{-~"
URL_PATTERN = f"http[^{SPACE}]+|www[^{SPACE}]+"


def q(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return str(value)


def values(rows, name: str, *columns: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) {name}({', '.join(columns)})"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def clean(x: str) -> str:
    return strip(
        f"regexp_replace(regexp_replace({x}, '{URL_PATTERN}', '', 'g'), '{TAG_PATTERN}', '', 'g')"
    )


def title(x: str) -> str:
    runs = f"regexp_extract_all(lower({x}), '[{CASED}]+|[^{CASED}]+')"
    return (
        f"array_to_string(list_transform({runs}, lambda r: upper(r[1:1]) || r[2:]), '')"
    )


def country_name(x: str) -> str:
    cases = " ".join(f"WHEN {q(a)} THEN {q(c)}" for a, c in fixed.COUNTRY_ALIASES.items())
    return f"CASE upper({strip(x)}) {cases} ELSE {title(f'upper({strip(x)})')} END"


def leader_name(x: str) -> str:
    cases = " ".join(f"WHEN {q(a)} THEN {q(c)}" for a, c in fixed.LEADER_ALIASES.items())
    return f"CASE {x} {cases} ELSE {x} END"


MARK = f"TIMESTAMP '{models.MARK:%Y-%m-%d %H:%M:%S}'"
LOADED = f"""loaded AS (
  SELECT post_id, text, greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), sentiment_score))
           AS sentiment_score,
         country, leader, upvotes, created_utc,
         CAST(extract(hour FROM created_utc) AS INTEGER) AS hour_of_day,
         CAST(extract(dow FROM created_utc) AS INTEGER) AS day_of_week,
         CAST(created_utc AS DATE) AS date
  FROM {PE} WHERE sentiment_score IS NOT NULL)"""


def _items(column: str, source: str) -> str:
    return f"""(SELECT *, {strip('raw')} AS item
      FROM (SELECT *, unnest(string_split(coalesce({column}, ''), ',')) AS raw FROM {source}) x
      WHERE {strip('raw')} <> '') items"""


COUNTRIES = f"{LOADED}, named AS (SELECT *, {country_name('item')} AS entity FROM {_items('country', 'loaded')})"
LEADERS = f"{LOADED}, named AS (SELECT *, {leader_name('item')} AS entity FROM {_items('leader', 'loaded')})"
STATS = """stats AS (SELECT entity, avg(sentiment_score) AS sentiment,
    count(sentiment_score) AS mentions, avg(upvotes) AS avg_upvotes FROM named GROUP BY entity)"""
LEADER_VIEW = """entity AS leader, mentions, round(sentiment, 6) AS sentiment,
    round(avg_upvotes, 6) AS avg_upvotes"""


def _ranked(order: str, having: str = "true") -> str:
    return f"""WITH {LEADERS}, {STATS}
SELECT CAST(row_number() OVER (ORDER BY {order}, entity) AS INTEGER) AS rank, {LEADER_VIEW}
FROM stats WHERE {having}"""


def is_bot(author: str, names, patterns) -> str:
    return f"""(coalesce({author}, '') = '' OR lower({author}) IN {in_list(names)}
    OR regexp_matches({author}, '(?i)({'|'.join(patterns)})'))"""


BOT = is_bot("author", fixed.KNOWN_BOTS, fixed.BOT_PATTERNS)
BOT_STRICT = is_bot("author", fixed.KNOWN_BOTS_STRICT, fixed.BOT_PATTERNS_STRICT)


def first_hit(x: str, keywords) -> str:
    """The hit with the lowest number in the keyword list."""
    rows = [(i, k, v) for i, (k, v) in enumerate(keywords)]
    return f"""(SELECT arg_min(g.value, g.priority) FROM {values(rows, 'g', 'priority', 'keyword', 'value')}
    WHERE contains(lower({x}), g.keyword))"""


def all_hits(x: str, keywords) -> str:
    return f"""(SELECT string_agg(DISTINCT g.value, ',' ORDER BY g.value)
    FROM {values(keywords, 'g', 'keyword', 'value')} WHERE contains(lower({x}), g.keyword))"""


# --- sentiment -----------------------------------------------------------------------------


def _tokens(text: str) -> str:
    stripped = f"regexp_replace(t, '^[{EDGE}]+|[{EDGE}]+$', '', 'g')"
    return f"""list_filter(list_transform(regexp_split_to_array({text}, '[{SPACE}]+'),
      lambda t: {stripped}), lambda t: length(t) > 1)"""


def sentiment_basic(source: str) -> str:
    """(post_id, sentiment_score): ratings only."""
    return f"""
SELECT p.post_id, coalesce(round(h.s / sqrt(h.s * h.s + {fixed.NORMALIZATION_ALPHA}), 4), CAST(0 AS DOUBLE)) AS sentiment_score
FROM (SELECT post_id FROM {source}) p LEFT JOIN (
  SELECT post_id, sum(valence) AS s
  FROM (SELECT post_id, lower(unnest({_tokens(clean('text'))})) AS token FROM {source}) t
  JOIN {values(fixed.LEXICON.items(), 'l', 'token', 'valence')} USING (token) GROUP BY post_id) h
USING (post_id)"""


def sentiment_rules(source: str, model) -> str:
    """(post_id, sentiment_score): all rules, by window functions over token positions."""
    k = fixed

    def back(d: int) -> str:
        return f"lag(low, {d}) OVER w"

    boosts = " + ".join(
        f"coalesce((SELECT b.delta FROM boosters b WHERE b.token = p{d}), 0) * CAST({decay} AS DOUBLE)"
        for d, decay in enumerate(k.BOOST_DECAY, start=1)
    )
    negated = " OR ".join(
        f"coalesce(p{d} IN {in_list(model.negators)}, false)" for d in range(1, 4)
    )
    return f"""
SELECT post_id, sentiment_score FROM (
WITH lexicon AS (SELECT * FROM {values(model.lexicon.items(), 'l', 'token', 'valence')}),
boosters AS (SELECT * FROM {values(model.boosters.items(), 'b', 'token', 'delta')}),
cleaned AS (SELECT post_id, {clean('text')} AS c FROM {source}),
lists AS (SELECT post_id, {_tokens('c')} AS toks FROM cleaned),
toks AS (SELECT post_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM lists),
lowered AS (SELECT *, lower(tok) AS low, upper(tok) = tok AND lower(tok) <> tok AS caps FROM toks),
around AS (
  SELECT *, {back(1)} AS p1, {back(2)} AS p2, {back(3)} AS p3,
    count(*) FILTER (caps) OVER d BETWEEN 1 AND count(*) OVER d - 1 AS mixed,
    min(pos) FILTER (low = {q(model.pivot)}) OVER d AS turn_at
  FROM lowered
  WINDOW w AS (PARTITION BY post_id ORDER BY pos), d AS (PARTITION BY post_id)),
hits AS (
  SELECT a.*, l.valence, sign(l.valence) * (
      CASE WHEN mixed AND upper(tok) = tok THEN CAST({k.CAPS_BOOST} AS DOUBLE) ELSE 0 END + {boosts}) AS push,
    CASE WHEN {negated} THEN CAST({k.NEGATION_FACTOR} AS DOUBLE) ELSE 1 END AS flip,
    CASE WHEN pos < turn_at THEN CAST({k.BEFORE_PIVOT} AS DOUBLE) WHEN pos > turn_at THEN CAST({k.AFTER_PIVOT} AS DOUBLE) ELSE 1 END AS weight
  FROM around a JOIN lexicon l ON l.token = a.low),
sums AS (SELECT post_id, sum((valence + push) * flip * weight) AS s FROM hits GROUP BY post_id),
marked AS (
  SELECT c.post_id, s + sign(s) * least({k.MAX_EXCLAMATIONS}, length(c) - length(replace(c, '!', ''))) * CAST({k.EXCLAMATION_BOOST} AS DOUBLE) AS s
  FROM cleaned c LEFT JOIN sums USING (post_id))
SELECT post_id, coalesce(round(s / sqrt(s * s + {k.NORMALIZATION_ALPHA}), 4), CAST(0 AS DOUBLE)) AS sentiment_score
FROM marked) scored"""


# --- language ------------------------------------------------------------------------------


def fold(x: str) -> str:
    return f"(instr('0123456789abcdef', md5({x})[1:1]) - 1)"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}]+'), lambda w: w <> '')"


def profile(size: int) -> str:
    return f"""
counts AS (SELECT lang, gram, count(*) AS n FROM (
    SELECT lang, unnest({_words('text')}) AS gram FROM documents
    WHERE {fold('text')} < {models.TRAIN_FOLDS} AND lang IN {in_list(models.LANGUAGES)}) w
  GROUP BY lang, gram),
totals AS (SELECT lang, sum(n) AS total, count(*) AS distinct_words FROM counts GROUP BY lang),
grams AS (SELECT DISTINCT gram FROM (
    SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM counts) r
  WHERE r <= {size}),
profile AS (
  SELECT g.gram, t.lang, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
    CAST(round(ln((coalesce(c.n, 0) + 1) / (t.total + t.distinct_words)) * 1000000) AS BIGINT) AS log_p
  FROM grams g CROSS JOIN totals t LEFT JOIN counts c ON c.gram = g.gram AND c.lang = t.lang)"""


PROFILE = profile(models.PROFILE_SIZE)


def language(source: str, text: str = "text") -> str:
    """(post_id, message_language); needs PROFILE in scope."""
    return f"""
SELECT p.post_id, coalesce(l.lang, 'en') AS message_language
FROM (SELECT post_id FROM {source}) p LEFT JOIN (
  SELECT post_id, arg_min(lang, (-score, lang)) AS lang FROM (
    SELECT post_id, lang, sum(log_p) AS score
    FROM (SELECT DISTINCT post_id, unnest({_words(text)}) AS gram FROM {source}) w
    JOIN profile USING (gram) GROUP BY post_id, lang) s
  GROUP BY post_id) l USING (post_id)"""


class _Default:
    lexicon = fixed.LEXICON
    boosters = fixed.BOOSTERS
    negators = fixed.NEGATORS
    pivot = fixed.PIVOT_WORD


def _enriched(posts: str, columns: str, tail: str = "", size: int = models.PROFILE_SIZE, rules=_Default) -> str:
    return f"""WITH {profile(size)},
kept AS (SELECT * FROM {posts} WHERE NOT {BOT}),
scored AS ({sentiment_rules('kept', rules)}),
spoken AS ({language('kept')})
SELECT {columns} FROM (
  SELECT k.post_id, k.author, s.sentiment_score, l.message_language,
    {first_hit('k.text', models.KEYWORDS)} AS country,
    {first_hit('k.text', models.LEADER_WORDS)} AS leader,
    '{models.LOAD_TIME:%Y-%m-%d %H:%M:%S}.000000' AS last_processed
  FROM kept k JOIN scored s USING (post_id) JOIN spoken l USING (post_id)) e {tail}"""


# --- upsert --------------------------------------------------------------------------------

_NUMBER = "CAST(post_id AS BIGINT)"
UPSERT = f"""
base AS (SELECT * FROM {PE} WHERE {_NUMBER} % 3 <> 0),
sent AS (
  SELECT * REPLACE (upvotes + 1 AS upvotes, 'changed' AS text, last_processed + INTERVAL 1 DAY AS last_processed)
  FROM {PE} WHERE {_NUMBER} % 2 = 0 OR {_NUMBER} % 3 = 0
  UNION ALL
  SELECT * REPLACE (upvotes + 5 AS upvotes, 'changed' AS text, last_processed + INTERVAL 2 DAY AS last_processed)
  FROM {PE} WHERE {_NUMBER} % 10 = 0),
once AS (SELECT * FROM sent QUALIFY row_number() OVER
  (PARTITION BY post_id ORDER BY last_processed DESC, upvotes DESC) = 1),
merged AS (
  SELECT coalesce(b.post_id, u.post_id) AS post_id,
    CASE WHEN b.post_id IS NULL THEN u.text ELSE b.text END AS text,
    CASE WHEN u.post_id IS NULL THEN b.upvotes ELSE u.upvotes END AS upvotes,
    CASE WHEN u.post_id IS NULL THEN b.num_comments ELSE u.num_comments END AS num_comments,
    CASE WHEN b.post_id IS NULL THEN u.country ELSE b.country END AS country,
    CASE WHEN b.post_id IS NULL THEN u.subreddit ELSE b.subreddit END AS subreddit,
    CASE WHEN u.post_id IS NULL THEN b.last_processed ELSE u.last_processed END AS last_processed
  FROM base b FULL OUTER JOIN once u ON b.post_id = u.post_id)"""
MERGED_VIEW = f"""WITH {UPSERT}
SELECT post_id, text, upvotes, num_comments, country, {stamp('last_processed')} AS last_processed
FROM merged"""

# --- the queries ---------------------------------------------------------------------------

ORACLE: dict[str, str] = {}

ORACLE["parse_listing"] = f"""
SELECT CAST(event_id AS VARCHAR) AS post_id,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '[deleted]'
       ELSE 'user_' || user_id END AS author,
  {stamp('ts')} AS created_utc,
  CASE WHEN event_id % 3 = 2 THEN event_type WHEN event_id % 5 = 0 THEN ''
       ELSE 'title ' || event_type END AS text,
  event_type AS subreddit,
  CASE WHEN event_id % 13 = 0 THEN 0 ELSE CAST(floor(value) AS INTEGER) END AS upvotes,
  CAST(event_id % 50 AS INTEGER) AS num_comments,
  CAST(NULL AS VARCHAR) AS parent_post_id
FROM events"""

ORACLE["parse_comments"] = f"""
SELECT conv_id || '-' || turn AS post_id,
  CASE WHEN turn % 3 = 0 THEN '[deleted]' ELSE role END AS author,
  {stamp('epoch_ms((1700000000 + conv_id * 100 + turn) * 1000)')} AS created_utc,
  CASE WHEN turn % 7 = 6 THEN '' ELSE text END AS text,
  CASE WHEN turn % 2 = 0 THEN 'talk' ELSE '' END AS subreddit,
  CAST(turn AS INTEGER) AS upvotes, CAST(0 AS INTEGER) AS num_comments,
  conv_id || '-0' AS parent_post_id
FROM conversations WHERE turn > 0 AND turn % 5 <> 4 AND conv_id % 10 <> 9"""

ORACLE["typed_posts"] = f"""
SELECT CAST(event_id AS VARCHAR) AS post_id, {stamp('ts')} AS created_utc, event_type AS subreddit,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(value) AS INTEGER) END AS upvotes,
  CAST(NULL AS INTEGER) AS num_comments, value AS sentiment_score, CAST(NULL AS VARCHAR) AS leader
FROM events WHERE event_id % 19 <> 0"""

ORACLE["scan_posts"] = "SELECT event_id, event_type, value FROM events"

ORACLE["load_posts"] = f"""WITH {LOADED}
SELECT post_id, text, sentiment_score, country, leader, upvotes, {stamp('created_utc')} AS created_utc,
  hour_of_day, day_of_week, date FROM loaded"""

ORACLE["sink_ignore"] = "SELECT event_type AS subreddit, count(*) AS posts FROM events GROUP BY 1"

ORACLE["sink_append"] = """
SELECT CAST(ts AS DATE) AS created_date, count(*) AS posts,
  CAST(sum(CAST(floor(value) AS INTEGER)) AS BIGINT) AS upvotes FROM events GROUP BY 1"""

ORACLE["gazetteer_flatten"] = """
WITH named AS (
  SELECT p_partkey, 0 AS pos, p_name AS alias, p_brand AS value FROM part
  UNION ALL SELECT p_partkey, 1, p_type, p_brand FROM part
  UNION ALL SELECT p_partkey, 2, p_name || ' ' || p_type, p_brand FROM part)
SELECT lower(alias) AS alias, value FROM named
QUALIFY row_number() OVER (PARTITION BY lower(alias) ORDER BY p_partkey DESC, pos DESC) = 1"""

ORACLE["upsert_posts"] = MERGED_VIEW
ORACLE["transfer_batch"] = MERGED_VIEW
ORACLE["sink_atomic_snapshot"] = f"""WITH {UPSERT}
SELECT subreddit, count(*) AS posts, CAST(sum(upvotes) AS BIGINT) AS upvotes FROM merged GROUP BY 1"""

_LENGTH_CHECKS = " UNION ALL ".join(
    f"""SELECT post_id, '{c}' AS column_name, 'too long' AS problem,
    CAST(length({c}) AS BIGINT) AS amount FROM posts WHERE length({c}) > {n}"""
    for c, n in {
        "post_id": 50,
        "author": 100,
        "subreddit": 50,
        "parent_post_id": 50,
        "message_language": 10,
        "country": 10,
        "leader": 100,
    }.items()
)
ORACLE["schema_violations"] = f"""
WITH posts AS (SELECT * FROM {PE} UNION ALL SELECT * FROM {PE} WHERE num_comments = 7)
{_LENGTH_CHECKS}
UNION ALL SELECT post_id, 'post_id', 'repeated key', count(*) FROM posts GROUP BY post_id HAVING count(*) > 1"""

ORACLE["bot_filter"] = f"SELECT post_id, author FROM {PD} WHERE NOT {BOT}"
ORACLE["bot_filter_extended"] = f"SELECT post_id, author FROM {PD} WHERE NOT {BOT_STRICT}"
ORACLE["bot_anti_join"] = f"""SELECT post_id, author FROM {PD}
WHERE author IS NULL OR lower(author) NOT IN {in_list(fixed.KNOWN_BOTS_STRICT)}"""
ORACLE["incremental_filter"] = f"""
SELECT post_id, subreddit, {stamp('created_utc')} AS created_utc FROM {PE} WHERE created_utc > {MARK}"""

ORACLE["text_fallback"] = """
SELECT event_id, CASE WHEN event_id % 4 = 2 THEN ' ' WHEN event_id % 4 = 3 THEN event_type
  WHEN event_id % 8 <> 0 THEN 't ' || event_type END AS text FROM events"""

ORACLE["enrich_posts"] = _enriched(PD, "*")
ORACLE["stream_enrich"] = ORACLE["enrich_posts"]
ORACLE["enrich_large_models"] = _enriched(
    PD, "post_id, sentiment_score, message_language, country, leader", size=models.LARGE_PROFILE, rules=models.RULE_MODEL
)
ORACLE["enrich_defaults"] = _enriched(
    f"""(SELECT * REPLACE ('someone' AS author, CASE CAST(post_id AS BIGINT) % 10 WHEN 0 THEN ''
      WHEN 1 THEN NULL WHEN 2 THEN ' ' || chr(9) || chr(10) || ' ' ELSE text END AS text) FROM {PD}) pd""",
    "post_id, sentiment_score, message_language, country, leader",
)
ORACLE["enrich_struct"] = f"""WITH {PROFILE},
kept AS (SELECT post_id, text, {clean('text')} AS cleaned FROM {PD})
SELECT post_id, sentiment_score AS sentiment, message_language AS language
FROM ({sentiment_rules('kept', _Default)}) s JOIN ({language('kept', 'cleaned')}) l USING (post_id)"""
ORACLE["sample_enriched"] = _enriched(
    PD, "post_id, author, sentiment_score, country, leader", "ORDER BY post_id LIMIT 5"
)

ORACLE["detect_country"] = f"SELECT post_id, {first_hit('text', models.KEYWORDS)} AS country FROM {PD}"
ORACLE["detect_leader"] = f"SELECT post_id, {first_hit('text', models.LEADER_WORDS)} AS leader FROM {PD}"
for _name, _hit in (("detect_long_lists", first_hit), ("detect_long_lists_all", all_hits)):
    ORACLE[_name] = f"""SELECT post_id, {_hit('text', models.PHRASES)} AS country,
  {_hit('text', models.LEADER_WORDS)} AS leader FROM {PD}"""
ORACLE["detect_all_entities"] = f"""SELECT post_id, {all_hits('text', models.KEYWORDS)} AS country,
  {all_hits('text', models.LEADER_WORDS)} AS leader FROM {PD}"""

_PHRASES = [(alias, value, len(alias.split())) for alias, value in models.PHRASES]
ORACLE["gazetteer_ngram_join"] = f"""
WITH lists AS (SELECT post_id, list_filter(regexp_split_to_array(lower(text), '[^{WORD}]+'), lambda w: w <> '') AS ws FROM {PD}),
words AS (SELECT post_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS s FROM lists),
ahead AS (SELECT *, lead(w) OVER p AS w2 FROM words WINDOW p AS (PARTITION BY post_id ORDER BY s)),
hits AS (SELECT post_id, s, s + g.words - 1 AS e, value
  FROM ahead JOIN {values(_PHRASES, 'g', 'alias', 'value', 'words')}
  ON alias = CASE WHEN g.words = 1 THEN w ELSE w || ' ' || w2 END)
SELECT post_id, value, count(*) AS mentions FROM (
  SELECT *, max(e) OVER (PARTITION BY post_id ORDER BY s, e DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM hits) h
WHERE covered IS NULL OR e > covered
GROUP BY post_id, value"""

_ISO = [(n.lower(), a2.lower(), a3) for n, a2, a3 in fixed.ISO_COUNTRIES]
ORACLE["country_iso"] = f"""WITH {COUNTRIES}, {STATS},
costs AS (
  SELECT entity, alpha2, alpha3, CASE
    WHEN lower(entity) IN (name, alpha2, lower(alpha3)) THEN 0
    WHEN contains(' ' || name || ' ', ' ' || lower(entity) || ' ')
      THEN instr(' ' || name || ' ', ' ' || lower(entity) || ' ')
    WHEN length(entity) >= 5 AND levenshtein(lower(entity), name) <= 1 THEN 1000 + levenshtein(lower(entity), name) END AS cost
  FROM stats CROSS JOIN {values(_ISO, 'i', 'name', 'alpha2', 'alpha3')}),
codes AS (SELECT entity, arg_min(alpha3, (cost, alpha2)) AS code FROM costs WHERE cost IS NOT NULL GROUP BY entity),
coded AS (SELECT s.*, coalesce(x.code, c.code) AS iso_alpha FROM stats s
  LEFT JOIN {values(fixed.ISO_SPECIAL.items(), 'x', 'name', 'code')} ON x.name = s.entity
  LEFT JOIN codes c ON c.entity = s.entity)
SELECT entity AS country, iso_alpha, round(sentiment, 6) AS avg_sentiment, mentions AS post_count,
  round(avg_upvotes, 6) AS avg_upvotes FROM coded WHERE iso_alpha IS NOT NULL"""

ORACLE["normalize_country"] = f"""
SELECT item, {country_name('item')} AS country, count(*) AS mentions FROM {_items('country', PE)} GROUP BY item"""
ORACLE["normalize_leader"] = f"""
SELECT item, {leader_name('item')} AS leader, count(*) AS mentions FROM {_items('leader', PE)} GROUP BY item"""
ORACLE["explode_countries"] = f"WITH {COUNTRIES} SELECT post_id, entity AS country FROM named"
ORACLE["explode_leaders"] = f"WITH {LEADERS} SELECT post_id, entity AS leader FROM named"

ORACLE["thread_join"] = f"""
WITH pt AS (SELECT * FROM {PT})
SELECT p.post_id, p.author, count(c.post_id) AS comments,
  CAST(coalesce(sum(length(c.text)), 0) AS BIGINT) AS comment_chars,
  CAST(coalesce(max(length(c.text)), 0) AS INTEGER) AS longest_comment
FROM pt p LEFT JOIN pt c ON c.parent_post_id = p.post_id
WHERE p.parent_post_id IS NULL GROUP BY p.post_id, p.author"""

ORACLE["headline_metrics"] = f"""WITH {LOADED}
SELECT (SELECT count(*) FROM loaded) AS total_posts,
  (SELECT count(DISTINCT {country_name('item')}) FROM {_items('country', 'loaded')}) AS countries,
  (SELECT count(DISTINCT {leader_name('item')}) FROM {_items('leader', 'loaded')}) AS leaders,
  (SELECT round(avg(sentiment_score), 6) FROM loaded) AS avg_sentiment,
  (SELECT round(avg(upvotes), 6) FROM loaded) AS avg_upvotes"""

_DAYS = f"(SELECT * FROM loaded WHERE date BETWEEN DATE '{models.FIRST_DAY}' AND DATE '{models.LAST_DAY}')"
ORACLE["headline_by_days"] = f"""WITH {LOADED}
SELECT (SELECT count(*) FROM {_DAYS}) AS total_posts,
  (SELECT count(DISTINCT {country_name('item')}) FROM {_items('country', _DAYS)}) AS countries,
  (SELECT count(DISTINCT {leader_name('item')}) FROM {_items('leader', _DAYS)}) AS leaders,
  (SELECT round(avg(sentiment_score), 6) FROM {_DAYS}) AS avg_sentiment,
  (SELECT round(avg(upvotes), 6) FROM {_DAYS}) AS avg_upvotes"""
ORACLE["country_stats"] = f"""WITH {COUNTRIES}, {STATS}
SELECT entity AS country, round(sentiment, 6) AS avg_sentiment, mentions AS post_count,
  round(avg_upvotes, 6) AS avg_upvotes FROM stats"""
ORACLE["country_table"] = f"""WITH {COUNTRIES}, {STATS}
SELECT entity AS country, round(sentiment, 6) AS sentiment, mentions AS posts FROM stats
WHERE mentions >= 10"""
ORACLE["leader_stats"] = f"WITH {LEADERS}, {STATS} SELECT {LEADER_VIEW} FROM stats"
ORACLE["rank_overall"] = _ranked("mentions DESC")
ORACLE["rank_positive"] = _ranked("sentiment DESC", "mentions >= 100")
ORACLE["rank_negative"] = _ranked("sentiment", "mentions >= 100")
ORACLE["top3_leaders"] = f"""WITH {LEADERS}, {STATS}
SELECT {LEADER_VIEW} FROM stats ORDER BY stats.mentions DESC, entity LIMIT 3"""

ORACLE["daily_sentiment"] = f"""WITH {LOADED}
SELECT date, round(avg(sentiment_score), 6) AS sentiment, count(sentiment_score) AS posts
FROM loaded GROUP BY date"""
ORACLE["stream_daily_trend"] = ORACLE["daily_sentiment"]

ORACLE["sentiment_histogram"] = f"""WITH {LOADED},
counts AS (SELECT least(29, greatest(0, CAST(floor((sentiment_score + 1) * CAST(15 AS DOUBLE)) AS INTEGER))) AS bin,
  count(*) AS n FROM loaded GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(CAST(-1 AS DOUBLE) + b.bin * (CAST(2 AS DOUBLE) / 30), 6) AS bin_start,
  coalesce(n, 0) AS posts FROM (SELECT unnest(range(30)) AS bin) b LEFT JOIN counts c ON c.bin = b.bin"""

for _name, _value in (("sentiment_bins", "sentiment_score"), ("votes_bins", "upvotes")):
    ORACLE[_name] = f"""WITH {LOADED},
x AS (SELECT CAST({_value} AS DOUBLE) AS x FROM loaded WHERE {_value} IS NOT NULL),
ends AS (SELECT min(x) AS a, max(x) AS b FROM x),
widths AS (SELECT m * CAST(10 AS DOUBLE) ** e AS w FROM (SELECT unnest([1, 2, 5]) AS m), (SELECT unnest(range(-6, 7)) AS e)),
width AS (SELECT min(w) AS w FROM widths, ends WHERE floor(round(b / w, 9)) - floor(round(a / w, 9)) < 30),
counts AS (SELECT floor(round(x / w, 9)) AS bin, count(*) AS n FROM x, width GROUP BY 1),
bins AS (SELECT unnest(range(CAST(min(bin) AS BIGINT), CAST(max(bin) AS BIGINT) + 1)) AS bin FROM counts)
SELECT round(b.bin * w, 9) AS bin_start, round((b.bin + 1) * w, 9) AS bin_end, coalesce(n, 0) AS posts
FROM bins b CROSS JOIN width LEFT JOIN counts c ON c.bin = b.bin"""

ORACLE["activity_heatmap"] = f"""WITH {LOADED}
SELECT day_of_week, hour_of_day, count(*) AS posts, round(avg(sentiment_score), 6) AS sentiment
FROM loaded GROUP BY day_of_week, hour_of_day"""

ORACLE["batch_counts"] = f"""
SELECT count(*) AS items, count(*) FILTER (NOT {BOT}) AS kept, count(*) FILTER ({BOT}) AS dropped FROM {PD}"""
ORACLE["post_comment_counts"] = f"""
SELECT count(*) FILTER (parent_post_id IS NULL) AS posts,
  count(*) FILTER (parent_post_id IS NOT NULL) AS comments FROM {PE}"""
ORACLE["source_counts"] = f"""
SELECT subreddit, count(*) AS retrieved, count(*) FILTER (created_utc > {MARK}) AS new_posts
FROM {PE} GROUP BY subreddit"""
ORACLE["stream_clean_source"] = f"""
SELECT *, true AS some_archived, true AS none_lost FROM ({ORACLE["source_counts"]}) c"""


def _top(order: str) -> str:
    return f"""WITH {LOADED}
SELECT post_id, text, sentiment_score, upvotes, {stamp('created_utc')} AS created_utc
FROM loaded ORDER BY {order}, post_id LIMIT 5"""


ORACLE["top_positive"] = _top("sentiment_score DESC")
ORACLE["top_negative"] = _top("sentiment_score")
ORACLE["top_upvoted"] = _top("upvotes DESC")
ORACLE["latest_per_source"] = f"""
SELECT post_id, subreddit, {stamp('created_utc')} AS created_utc, upvotes FROM {PE}
QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY pe.created_utc DESC, post_id) = 1"""
ORACLE["stream_source_cursor"] = f"""
SELECT post_id, subreddit, {stamp('created_utc')} AS created_utc, 't3_' || post_id AS after FROM {PE}
QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY pe.created_utc DESC, post_id DESC) = 1"""
ORACLE["comments_per_post_k"] = f"""
SELECT post_id, author, text, turn, parent_post_id FROM {PT} WHERE parent_post_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY parent_post_id ORDER BY turn DESC) <= 3"""
ORACLE["union_posts_comments"] = f"""
WITH pt AS (SELECT * FROM {PT})
SELECT post_id, author, parent_post_id, 'post' AS kind FROM pt WHERE parent_post_id IS NULL
UNION ALL SELECT post_id, author, parent_post_id, 'comment' FROM pt
WHERE parent_post_id IN (SELECT post_id FROM pt WHERE parent_post_id IS NULL)"""
ORACLE["dedupe_posts"] = f"""
WITH sent AS (SELECT * FROM {PE} UNION ALL
  SELECT * REPLACE (upvotes + 1 AS upvotes, last_processed + INTERVAL 1 DAY AS last_processed)
  FROM {PE} WHERE upvotes >= 25)
SELECT post_id, text, upvotes, num_comments, country, {stamp('last_processed')} AS last_processed FROM sent
QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY sent.last_processed DESC, upvotes DESC) = 1"""

ORACLE["clean_text"] = f"SELECT post_id, {clean('text')} AS text FROM {PD}"
ORACLE["epoch_to_ts"] = f"SELECT event_id, {stamp('ts')} AS created_utc FROM events"
_EXPIRES = "ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT))"
ORACLE["ttl_expiry"] = f"""
SELECT event_id, {stamp(_EXPIRES)} AS expires_at, {MARK} > {_EXPIRES} AS expired FROM events"""
ORACLE["time_features"] = f"""
SELECT post_id, CAST(extract(hour FROM created_utc) AS INTEGER) AS hour_of_day,
  CAST(extract(dow FROM created_utc) AS INTEGER) AS day_of_week, CAST(created_utc AS DATE) AS date FROM {PE}"""
ORACLE["clip_scores"] = f"""
SELECT post_id, CASE WHEN sentiment_score < -1 THEN -1 WHEN sentiment_score > 1 THEN 1
  ELSE sentiment_score END AS sentiment_score FROM {PE}"""
ORACLE["format_report"] = f"""WITH {LEADERS}, {STATS}
SELECT entity AS leader, format('{{:,}}', mentions) AS mentions, printf('%.2f', sentiment) AS sentiment,
  printf('%.0f', avg_upvotes) AS avg_upvotes FROM stats"""
ORACLE["format_posts"] = f"""WITH {LOADED}
SELECT post_id, printf('%.2f', sentiment_score) AS sentiment_score, format('{{:,}}', upvotes) AS upvotes,
  strftime(loaded.created_utc, '%Y-%m-%d %H:%M') AS created_utc FROM loaded"""

ORACLE["lexicon_sentiment"] = sentiment_basic(PD)
ORACLE["lexicon_sentiment_rules"] = sentiment_rules(PD, models.RULE_MODEL)
ORACLE["lang_profile_train"] = f"WITH {PROFILE} SELECT gram, lang, n, log_p FROM profile"
_TEST = f"""test AS (SELECT post_id, text, expected_language FROM {PD}
  WHERE {fold('text')} >= {models.TRAIN_FOLDS})"""
ORACLE["detect_language"] = f"""WITH {PROFILE}, {_TEST}
SELECT post_id, expected_language, message_language FROM test JOIN ({language('test')}) l USING (post_id)"""
ORACLE["lang_confusion"] = f"""WITH {PROFILE}, {_TEST},
pairs AS (SELECT expected_language, message_language, count(*) AS n
  FROM test JOIN ({language('test')}) l USING (post_id) GROUP BY 1, 2)
SELECT *, round(n / sum(n) OVER (PARTITION BY expected_language), 6) AS share FROM pairs"""

_GROUPS = f"""unnest(flatten(list_transform({_words('text')},
      lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)))))"""
ORACLE["lang_rank_confusion"] = f"""WITH {_TEST},
ranked AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS place
  FROM (SELECT lang, {_GROUPS} AS gram FROM documents
    WHERE {fold('text')} < {models.TRAIN_FOLDS} AND lang IN {in_list(models.LANGUAGES)}) g GROUP BY lang, gram
  QUALIFY place <= {models.RANKED_GROUPS}),
own AS (SELECT post_id, gram, row_number() OVER (PARTITION BY post_id ORDER BY count(*) DESC, gram) AS place
  FROM (SELECT post_id, {_GROUPS} AS gram FROM test) g GROUP BY post_id, gram
  QUALIFY place <= {models.RANKED_IN_TEXT}),
apart AS (SELECT post_id, l.lang, sum(coalesce(abs(o.place - r.place), {models.RANKED_GROUPS})) AS d
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM ranked) l
  LEFT JOIN ranked r ON r.gram = o.gram AND r.lang = l.lang GROUP BY post_id, l.lang),
pairs AS (SELECT expected_language, coalesce(f.lang, 'en') AS message_language, count(*) AS n
  FROM test LEFT JOIN (SELECT post_id, arg_min(lang, (d, lang)) AS lang FROM apart GROUP BY post_id) f USING (post_id)
  GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY expected_language), 6) AS share FROM pairs"""

# --- streams whose result depends on arrival -----------------------------------------------

_SLICE = "least(3, CAST(floor((extract(day FROM created_utc) - 1) / 8) AS INTEGER))"


def _marks(source: str, arrival: str) -> str:
    """Per slice: the newest time, in milliseconds, of all earlier slices, less one hour."""
    return f"""arrived AS (SELECT *, {arrival} AS slice FROM {source}),
marks AS (SELECT slice, max(newest) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    - INTERVAL 1 HOUR AS mark FROM (SELECT slice, max(created_utc) AS newest FROM arrived GROUP BY slice) n)"""


ORACLE["stream_watermark"] = f"""
WITH {_marks(PE, 'CAST(post_id AS BIGINT) % 4')}
SELECT post_id, subreddit, {stamp('created_utc')} AS created_utc FROM arrived JOIN marks USING (slice)
WHERE mark IS NULL OR created_utc > date_trunc('milliseconds', mark)"""
ORACLE["stream_dedupe"] = f"""
SELECT post_id, subreddit, {stamp('created_utc')} AS created_utc FROM {PE}"""
ORACLE["stream_late_split"] = f"""
WITH {_marks(PE, f"least(3, {_SLICE} + CASE WHEN subreddit = 'click' AND upvotes > 40 THEN 1 ELSE 0 END)")}
SELECT post_id, CAST(slice AS BIGINT) AS batch_id, coalesce(created_utc <= mark, false) AS late
FROM arrived JOIN marks USING (slice)"""
ORACLE["stream_upsert"] = MERGED_VIEW
ORACLE["stream_restart"] = MERGED_VIEW
ORACLE["stream_resume"] = MERGED_VIEW
ORACLE["stream_threads"] = f"""
SELECT c.post_id, c.parent_post_id FROM (SELECT * FROM {PE}) c JOIN (SELECT * FROM {PE}) p ON p.post_id = c.parent_post_id
WHERE p.parent_post_id IS NULL AND c.created_utc >= p.created_utc AND c.created_utc <= p.created_utc + INTERVAL 1 HOUR"""
ORACLE["stream_fair"] = f"SELECT post_id, subreddit, true AS within_quota FROM {PE}"
ORACLE["stream_state_check"] = f"""
SELECT 'cursor' AS state, count(DISTINCT subreddit) AS in_state, CAST(0 AS BIGINT) AS differing FROM {PE}
UNION ALL SELECT 'dedupe', count(*), CAST(0 AS BIGINT) FROM (SELECT *, max(created_utc) OVER () AS newest FROM {PE}) z
WHERE created_utc + INTERVAL 2 HOUR > date_trunc('milliseconds', newest)"""
ORACLE["stream_moved_days"] = f"""WITH {UPSERT}
SELECT m.post_id, m.upvotes, CASE WHEN {_NUMBER.replace('post_id', 'm.post_id')} % 3 <> 0 THEN {stamp('p.created_utc')}
  ELSE {stamp('p.created_utc + INTERVAL 1 DAY')} END AS created_utc
FROM merged m JOIN (SELECT * FROM {PE}) p ON p.post_id = m.post_id"""
ORACLE["stream_collect"] = """
SELECT CAST(event_id AS VARCHAR) AS post_id, 'user_' || user_id AS author, event_type AS text,
  event_type AS subreddit, CAST(floor(value) AS INTEGER) AS upvotes, 0 AS num_comments,
  CAST(NULL AS VARCHAR) AS parent_post_id, CAST(0 AS DOUBLE) AS sentiment_score,
  'en' AS message_language, true AS processed
FROM events WHERE event_id % 17 <> 0
UNION ALL
SELECT conv_id || '-' || turn, role, 'turn ' || turn, 'talk', CAST(turn AS INTEGER), 0,
  CAST(conv_id % 8 AS VARCHAR), CAST(0 AS DOUBLE), 'de', true
FROM conversations WHERE turn > 0"""

_PAGE = "CAST(floor(event_id / 100) AS BIGINT)"
ORACLE["rejected_rows"] = f"""
WITH found AS (
  SELECT DISTINCT 'listing' AS input, event_type AS source, 'unreadable' AS reason, {_PAGE} AS item
  FROM events WHERE {_PAGE} % 7 = 3
  UNION ALL SELECT 'listing', event_type, CASE WHEN event_id % 19 = 0 THEN 'no id' ELSE 'no time' END, event_id
  FROM events WHERE {_PAGE} % 7 <> 3 AND (event_id % 19 = 0 OR event_id % 23 = 0)
  UNION ALL SELECT 'rows', event_type, CASE WHEN event_id % 29 = 0 THEN 'no id' ELSE 'no time' END, event_id
  FROM events WHERE event_id % 29 = 0 OR event_id % 31 = 0)
SELECT input, source, reason, count(*) AS rejected FROM found GROUP BY ALL"""

_NAMED = values([(i, n, c) for i, (n, c) in enumerate(models.COUNTRY_NAMES)], "k", "i", "country", "iso_alpha")
ORACLE["country_names_iso"] = f"""
SELECT country, iso_alpha, count(*) AS posts FROM documents JOIN {_NAMED}
  ON i = doc_id % {len(models.COUNTRY_NAMES)} WHERE iso_alpha IS NOT NULL GROUP BY country, iso_alpha"""

_ALIASES = [(a, code) for name, code, others in fixed.COUNTRY_GAZETTEER for a in [name, *others]]
_ALIASES += [(a, name) for name, others in fixed.LEADER_GAZETTEER for a in [name, *others]]
_ALIASES += [("congo", "COD"), ("congo", "COG")]


def _split(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^{WORD}]+'), lambda w: w <> '')"


_TURN = " ".join(f"WHEN {i} THEN {q(p)}" for i, p in enumerate(models.LEADING_PHRASES))
ORACLE["gazetteer_full"] = f"""
WITH aliases AS (SELECT DISTINCT {_split('alias')} AS ws, value FROM {values(_ALIASES, 'g', 'alias', 'value')}),
texts AS (SELECT post_id, CASE CAST(post_id AS BIGINT) % {len(models.LEADING_PHRASES)} {_TURN} END || ' ' || text AS t
  FROM {PD}),
lists AS (SELECT post_id, {_split('t')} AS ws FROM texts),
places AS (SELECT post_id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS s FROM lists),
hits AS (SELECT post_id, s, s + len(a.ws) - 1 AS e, value
  FROM places p JOIN aliases a ON p.w = a.ws[1] AND p.ws[s:s + len(a.ws) - 1] = a.ws)
SELECT post_id, value, count(*) AS mentions FROM hits h WHERE NOT EXISTS (
  SELECT 1 FROM hits o WHERE o.post_id = h.post_id AND o.s <= h.s AND o.e >= h.e AND o.e - o.s > h.e - h.s)
GROUP BY post_id, value"""
