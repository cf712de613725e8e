"""DuckDB SQL for the registered queries, over the same Parquet tables.

``STAR`` derives the three star tables; ``levels`` and ``engaged`` add the frames the
reports share. ``g`` is the group: one constant for a global answer, or the channel.
"""

from tallyreel.schemas import FEATURES

STAR = """
videos AS (
  SELECT 'v' || p.user_id AS video_id, 'c_' || d.lang AS channel_id,
         split_part(d.text, chr(10), 1) AS title, d.text AS description, p.ts AS published_at,
         d.n_chars % 180 AS duration_seconds, d.source AS category_id,
         CASE WHEN d.n_chars % 180 <= 60 THEN 1 ELSE 0 END AS is_short
  FROM (SELECT user_id, ts,
               row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn
        FROM events) p
  JOIN documents d ON d.doc_id = p.user_id
  WHERE p.rn = 1),
daily_base AS (
  SELECT 'v' || user_id AS video_id, CAST(ts AS DATE) AS date,
         CAST(sum(CAST(floor(value * power(10, user_id % 4)) AS BIGINT)) AS BIGINT) AS views,
         CAST(floor(sum(CAST(round(value * 100) AS BIGINT)) / 100.0E0) AS BIGINT)
           AS estimated_minutes_watched,
         100.0E0 * sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) / count(*)
           AS average_view_percentage,
         CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT)
           AS subscribers_gained,
         CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT)
           AS subscribers_lost
  FROM events GROUP BY user_id, CAST(ts AS DATE)),
daily_metrics AS (
  SELECT *, CASE WHEN views > 0
                 THEN CAST(floor(estimated_minutes_watched * 60.0E0 / views) AS BIGINT)
                 ELSE 0 END AS average_view_duration
  FROM daily_base),
traffic_sources AS (
  SELECT 'v' || user_id AS video_id, upper(event_type) AS traffic_source_type,
         CAST(sum(CAST(floor(value * power(10, user_id % 4)) AS BIGINT)) AS BIGINT) AS views,
         CAST(floor(sum(CAST(round(value * 100) AS BIGINT)) / 100.0E0) AS BIGINT)
           AS estimated_minutes_watched
  FROM events GROUP BY user_id, event_type),
totals AS (SELECT video_id, CAST(sum(views) AS BIGINT) AS total_views
           FROM daily_metrics GROUP BY video_id)"""

# Patterns in DuckDB's regular expressions, which know only ASCII white space.
WORD_SQL = (
    r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
DAYS_SQL = (
    "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']"
)
BUCKETS_SQL = "['short','medium','long','very_long']"
LABELS_SQL = "['Low (<10K)','Medium (10K-100K)','High (100K-1M)','Viral (1M+)']"

# Text features of an expression, as numbers.
def non_ascii(x):
    return rf"regexp_matches({x}, '[^\x00-\x7F]')"


def digit(x):
    return rf"regexp_matches({x}, '\p{{Nd}}')"


def words(x):
    return f"CAST(len(regexp_extract_all({x}, '{WORD_SQL}')) AS BIGINT)"


def bucket(x):
    return f"""CASE WHEN length({x}) BETWEEN 1 AND 30 THEN 0 WHEN length({x}) BETWEEN 31 AND 50 THEN 1
      WHEN length({x}) BETWEEN 51 AND 70 THEN 2 WHEN length({x}) BETWEEN 71 AND 200 THEN 3 END"""


def category(x):
    return f"""CASE WHEN {x} < 10000 THEN 0 WHEN {x} < 100000 THEN 1
      WHEN {x} < 1000000 THEN 2 ELSE 3 END"""


def big(x):
    return f"CAST({x} AS BIGINT)"


def whole(x):
    return f"CAST(trunc({x}) AS BIGINT)"


def to_even(x, digits):
    return f"CAST(round_even(CAST({x} AS DOUBLE), {digits}) AS DOUBLE)"


def with_star(body, *more):
    return "WITH " + ",\n".join([STAR.strip(), *more]) + "\n" + body


def group(channel):
    return "v.channel_id" if channel else "'all'"


def shown(channel, alias="g"):
    """The group as the leading output column."""
    return f"{alias} AS channel_id, " if channel else ""


def levels(channel):
    parts = {
        "hour": "hour(published_at)",
        "weekday": "isodow(published_at) - 1",
        "short": "is_short",
        "non_ascii": f"CAST({non_ascii('title')} AS INTEGER)",
        "exclamation": "CAST(contains(title, '!') AS INTEGER)",
        "question": "CAST(contains(title, '?') AS INTEGER)",
        "length_bucket": bucket("title"),
        "all": "0",
    }
    each = "\nUNION ALL\n".join(
        f"SELECT g, '{d}' AS dimension, {big(x)} AS level, total_views, title FROM grouped"
        for d, x in parts.items()
    )
    return f"""
grouped AS (SELECT v.*, {group(channel)} AS g, t.total_views FROM videos v JOIN totals t USING (video_id)),
long_rows AS ({each}),
levels AS (
  SELECT g, dimension, level, count(*) AS videos, CAST(sum(total_views) AS BIGINT) AS views,
         avg(total_views) AS mean_views, avg(length(title)) AS mean_length
  FROM long_rows WHERE level IS NOT NULL GROUP BY g, dimension, level),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g, dimension ORDER BY mean_views DESC, level) AS best,
         row_number() OVER (PARTITION BY g, dimension ORDER BY mean_views, level) AS worst
  FROM levels)"""


def pick(dimension, level, column):
    return (
        f"coalesce(max(CASE WHEN dimension = '{dimension}' AND level = {level} THEN {column} END), 0)"
    )


def at_rank(dimension, rank, column, place=1):
    return f"max(CASE WHEN dimension = '{dimension}' AND {rank} = {place} THEN {column} END)"


def _columns(pairs):
    return ", ".join(f"{x} AS {name}" for name, x in pairs.items())


UPLOAD = {
    "best_hour": at_rank("hour", "best", "level"),
    "worst_hour": at_rank("hour", "worst", "level"),
    "best_day": f"{DAYS_SQL}[{at_rank('weekday', 'best', 'level')} + 1]",
    "worst_day": f"{DAYS_SQL}[{at_rank('weekday', 'worst', 'level')} + 1]",
    "top_3_hours": (
        "string_agg(CASE WHEN dimension = 'hour' AND best <= 3 THEN CAST(level AS VARCHAR) END, '|'"
        " ORDER BY best)"
    ),
    "best_hour_avg_views": whole(at_rank("hour", "best", "mean_views")),
    "best_day_avg_views": whole(at_rank("weekday", "best", "mean_views")),
}



def scaled(x, factor):
    return f"CAST(CAST(round_even(CAST({x} AS DOUBLE) * {factor}, 0) AS BIGINT) AS VARCHAR)"


def listed_levels(dimension, text):
    inside = f"CASE WHEN dimension = '{dimension}' THEN {text} END"
    return f"string_agg({inside}, '|' ORDER BY {inside})"


def _one_day(number, name):
    mean = f"max(CASE WHEN dimension = 'weekday' AND level = {number} THEN mean_views END)"
    return f"'{name}:' || coalesce({scaled(mean, 1000)}, '-')"


_DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# Maps of the reports as text.
UPLOAD_MAPS = {
    "hour_data": listed_levels("hour", f"level || ':' || {scaled('mean_views', 1000)}"),
    "day_data": " || '|' || ".join(_one_day(i, d) for i, d in enumerate(_DAY_NAMES)),
}
TITLE_MAPS = {
    "length_performance": listed_levels(
        "length_bucket", f"{BUCKETS_SQL}[level + 1] || ':' || CAST({whole('mean_views')} AS VARCHAR)"
    ),
}

_SHORTS, _LONGS = pick("short", 1, "mean_views"), pick("short", 0, "mean_views")
FORMAT = {
    "avg_views_shorts": whole(_SHORTS),
    "avg_views_longform": whole(_LONGS),
    "better_format": f"CASE WHEN {_SHORTS} > {_LONGS} THEN 'Shorts' ELSE 'Long-form' END",
    "multiplier": to_even(f"coalesce({_SHORTS} / nullif({_LONGS}, 0), 1.0)", 2),
    "has_baseline": f"{_LONGS} > 0",
    "total_shorts": big(pick("short", 1, "videos")),
    "total_longform": big(pick("short", 0, "videos")),
    "shorts_total_views": big(pick("short", 1, "views")),
    "longform_total_views": big(pick("short", 0, "views")),
}


def _flag(dimension, name):
    with_it, without = pick(dimension, 1, "mean_views"), pick(dimension, 0, "mean_views")
    return {
        f"{name}_helps": f"{with_it} > {without}",
        f"avg_views_with_{name}": whole(with_it),
        f"avg_views_without_{name}": whole(without),
    }


TITLES = {
    **_flag("non_ascii", "emoji"),
    **_flag("exclamation", "exclamation"),
    **_flag("question", "question"),
    "best_title_length_bucket": f"{BUCKETS_SQL}[{at_rank('length_bucket', 'best', 'level')} + 1]",
    "avg_title_length": to_even("max(CASE WHEN dimension = 'all' THEN mean_length END)", 1),
}


def engaged(channel):
    return f"""
engaged AS (
  SELECT {group(channel)} AS g, e.*, v.title FROM (
    SELECT video_id, avg(average_view_percentage) AS avg_retention,
           CAST(sum(views) AS BIGINT) AS total_views,
           CAST(sum(subscribers_gained) - sum(subscribers_lost) AS BIGINT) AS net_subs
    FROM daily_metrics WHERE average_view_percentage > 0
    GROUP BY video_id HAVING sum(views) > 100) e
  JOIN videos v USING (video_id)),
means AS (SELECT g, avg(avg_retention) AS baseline_retention, avg(total_views) AS baseline_views
          FROM engaged GROUP BY g),
under AS (
  SELECT e.*, m.baseline_retention,
         row_number() OVER (PARTITION BY e.g ORDER BY e.avg_retention, e.video_id) AS place
  FROM engaged e JOIN means m USING (g) WHERE e.avg_retention < m.baseline_retention),
weak AS (
  SELECT m.g, {to_even('m.baseline_retention', 1)} AS channel_avg_retention,
         {whole('m.baseline_views')} AS channel_avg_views,
         (SELECT count(*) FROM under u WHERE u.g = m.g) AS total_weak_count,
         (SELECT string_agg(video_id, '|' ORDER BY place) FROM under u
          WHERE u.g = m.g AND place <= 5) AS weak_videos,
         (SELECT string_agg(concat_ws(':', video_id, substr(title, 1, 60),
                   {scaled(to_even('avg_retention', 1), 10)}, total_views, net_subs,
                   {scaled(to_even('baseline_retention - avg_retention', 1), 10)}), '|' ORDER BY place)
          FROM under u WHERE u.g = m.g AND place <= 5) AS weak_list
  FROM means m)"""


def sources(channel):
    rows = (
        "SELECT v.channel_id AS g, s.traffic_source_type, s.views"
        " FROM traffic_sources s JOIN videos v USING (video_id)"
        if channel
        else "SELECT 'all' AS g, traffic_source_type, views FROM traffic_sources"
    )
    return f"""
source_totals AS (SELECT g, traffic_source_type, CAST(sum(views) AS BIGINT) AS total_views
                  FROM ({rows}) GROUP BY g, traffic_source_type),
shares AS (
  SELECT g, traffic_source_type, total_views,
         {to_even('total_views / nullif(CAST(sum(total_views) OVER (PARTITION BY g) AS DOUBLE), 0) * 100', 1)}
           AS percentage,
         row_number() OVER (PARTITION BY g ORDER BY total_views DESC, traffic_source_type) AS place
  FROM source_totals)"""


FIRST_WEEK = """
first_week AS (
  SELECT video_id, views_7d, total_views FROM (
    SELECT d.video_id,
           CAST(sum(CASE WHEN date_diff('day', CAST(v.published_at AS DATE), d.date) <= 7
                         THEN d.views ELSE 0 END) AS BIGINT) AS views_7d,
           CAST(sum(d.views) AS BIGINT) AS total_views
    FROM daily_metrics d JOIN videos v USING (video_id) GROUP BY d.video_id)
  WHERE total_views > 0)"""


def features(title, hour, day, month):
    return f"""{big(hour)} AS hour, {big(day)} AS day_of_week, {big(month)} AS month,
      {big(f'length({title})')} AS title_length, {big(non_ascii(title))} AS has_emoji,
      {big(f"contains({title}, '!')")} AS has_exclamation,
      {big(f"contains({title}, '?')")} AS has_question,
      {words(title)} AS title_word_count, {big(digit(title))} AS title_has_numbers"""


TRAINING = f"""
training AS (
  SELECT v.video_id, {features('v.title', 'hour(v.published_at)', 'isodow(v.published_at) - 1',
                               'month(v.published_at)')},
         f.views_7d, f.total_views, {big(category('f.views_7d'))} AS category
  FROM videos v JOIN first_week f USING (video_id) WHERE v.title IS NOT NULL)"""

SPREAD = f"""
spread AS (SELECT {big('c')} AS category, {LABELS_SQL}[c + 1] AS label,
                  (SELECT count(*) FROM training t WHERE t.category = c) AS videos
           FROM range(4) AS classes(c))"""


def candidates(channel):
    g = "'c_' || lang" if channel else "'all'"
    return f"""
candidates AS (SELECT doc_id, {g} AS g, split_part(text, chr(10), 1) AS title FROM documents
               WHERE doc_id NOT IN (SELECT user_id FROM events))"""


def best_titles(channel, n):
    return f"""
best_titles AS (
  SELECT g, string_agg(title, '|' ORDER BY place) AS top_titles FROM (
    SELECT g, title, row_number() OVER (PARTITION BY g ORDER BY total_views DESC, video_id) AS place
    FROM grouped) WHERE place <= {n} GROUP BY g)"""


RESPONSES = """
responses AS (
  SELECT 'k' || user_id AS cache_key, ts AS created_at,
         CASE event_type WHEN 'view' THEN '```json' || chr(10) || props || chr(10) || '```' || chr(10)
              WHEN 'click' THEN '  JSON ' || props
              WHEN 'signup' THEN '[' || props || ']'
              WHEN 'error' THEN props || ' and {'
              ELSE props END AS response,
         CASE event_type WHEN 'signup' THEN 'list' WHEN 'error' THEN 'broken' ELSE 'object' END AS kind,
         json(props) AS body
  FROM events)"""

# Compact text built from the exact decimal digits: printf rounds the binary value
# and sends exact ties to even, so those (quarters) are sent upward by hand.
def one_decimal(x):
    return f"""CASE WHEN {x} * 4 = floor({x} * 4) AND {x} * 2 <> floor({x} * 2)
      THEN printf('%.1f', (floor({x} * 10) + 1) / 10) ELSE printf('%.1f', {x}) END"""


def compact(x):
    v = f"CAST({x} AS DOUBLE)"
    return f"""CASE WHEN {v} >= 1000000 THEN {one_decimal(f'({v} / 1000000)')} || 'M'
      WHEN {v} >= 1000 THEN {one_decimal(f'({v} / 1000)')} || 'K'
      WHEN {v} IS NULL THEN '—'
      ELSE CAST(CAST(floor({v} + 0.5) AS BIGINT) AS VARCHAR) END"""


def parts_flags(x):
    return f"""{non_ascii(x)} AS has_emoji, contains({x}, '!') AS has_exclamation,
      contains({x}, '?') AS has_question, {digit(x)} AS title_has_numbers,
      {big(f'length({x})')} AS title_length, {words(x)} AS title_word_count"""


ORACLES: dict[str, str] = {}
Q = ORACLES

Q["scan_videos"] = with_star(
    f"""SELECT video_id, channel_id, title, published_at, duration_seconds,
               {big('is_short')} AS is_short FROM videos"""
)
DAILY_COLUMNS = f"""video_id, date, views, estimated_minutes_watched, average_view_duration,
  {to_even('average_view_percentage', 6)} AS average_view_percentage,
  subscribers_gained, subscribers_lost"""
Q["scan_daily_metrics"] = with_star(f"SELECT {DAILY_COLUMNS} FROM daily_metrics")
Q["scan_traffic_sources"] = with_star("SELECT * FROM traffic_sources")
Q["stored_daily_metrics"] = with_star("SELECT video_id, date, views FROM daily_metrics")
Q["stored_traffic_sources"] = with_star("SELECT * FROM traffic_sources")
NUMBER_OF_FIVE = "CAST(substr(video_id, 2) AS BIGINT) % 5"
Q["landing_rejects"] = with_star(
    f"""SELECT count(DISTINCT CASE WHEN {NUMBER_OF_FIVE} = 0 THEN video_id END) AS unreadable,
               count(*) FILTER ({NUMBER_OF_FIVE} = 1 AND date = DATE '2024-01-05') AS without_day,
               CAST(0 AS BIGINT) AS without_text,
               count(*) FILTER ({NUMBER_OF_FIVE} > 0 AND views <> 0
                                AND NOT ({NUMBER_OF_FIVE} = 1 AND date = DATE '2024-01-05')) AS kept
        FROM daily_metrics"""
)
Q["landing_video_ids"] = with_star("SELECT video_id FROM videos")
Q["landing_video_metadata"] = with_star(
    f"""SELECT video_id, channel_id, title, substr(description, 1, 1000) AS description,
               published_at, duration_seconds,
               CASE WHEN length(category_id) > 4 THEN category_id END AS category_id,
               '' AS thumbnail_url, {big('is_short')} AS is_short FROM videos"""
)
LANDED_DAILY = DAILY_COLUMNS.replace(
    "average_view_duration",
    """CASE WHEN CAST(substr(video_id, 2) AS BIGINT) % 2 = 0 THEN average_view_duration ELSE 0 END
         AS average_view_duration""",
)
Q["landing_daily_report"] = with_star(f"SELECT {LANDED_DAILY} FROM daily_metrics WHERE views <> 0")
Q["landing_traffic_report"] = with_star("SELECT * FROM traffic_sources")
Q["channel_info"] = with_star(
    """SELECT upper(v.channel_id) AS title, v.channel_id, 'N/A' AS subscribers,
              CAST(sum(s.views) AS VARCHAR) AS views, CAST(count(*) AS VARCHAR) AS videos
       FROM (SELECT video_id, sum(views) AS views FROM traffic_sources GROUP BY video_id) s
       JOIN videos v USING (video_id) GROUP BY v.channel_id"""
)
LOADS = """loads AS (
  SELECT 'v' || user_id AS video_id, event_type, props, ts, CAST(floor(value) AS BIGINT) AS amount
  FROM events)"""
Q["upsert_videos"] = f"""WITH {LOADS}
  SELECT l.video_id, f.event_type AS channel_id, l.props AS title, f.ts AS published_at,
         l.amount AS duration_seconds, f.ts AS created_at, l.ts AS updated_at
  FROM (SELECT * FROM loads QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY ts DESC) = 1) l
  JOIN (SELECT * FROM loads QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY ts) = 1) f
  USING (video_id)"""
Q["stored_videos"] = Q["upsert_videos"]
for name, key, column in [
    ("upsert_daily_metrics", "CAST(ts AS DATE)", "date"),
    ("upsert_traffic_sources", "upper(event_type)", "traffic_source_type"),
]:
    Q[name] = f"""WITH {LOADS}
      SELECT video_id, {key} AS {column}, amount AS views, ts AS fetched_at FROM loads
      QUALIFY row_number() OVER (PARTITION BY video_id, {key} ORDER BY ts DESC, amount DESC) = 1"""
Q["audit_unique"] = """SELECT 'v' || user_id AS video_id, CAST(ts AS DATE) AS date, count(*) AS copies
  FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING count(*) > 1"""
Q["audit_not_null"] = with_star(
    """SELECT * FROM (
         UNPIVOT (SELECT CAST(sum(CASE WHEN video_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS video_id,
                 CAST(sum(CASE WHEN channel_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS channel_id,
                 CAST(sum(CASE WHEN title IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS title,
                 CAST(sum(CASE WHEN published_at IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS published_at,
                 CAST(sum(CASE WHEN length(category_id) > 4 THEN 0 ELSE 1 END) AS BIGINT) AS category_id
                 FROM videos)
         ON COLUMNS(*) INTO NAME column_name VALUE nulls)"""
)
Q["audit_orphans"] = with_star(
    """SELECT video_id, traffic_source_type, views FROM traffic_sources
       WHERE video_id NOT IN (SELECT 'v' || doc_id FROM labels)"""
)
Q["audit_daily_orphans"] = with_star(
    """SELECT video_id, date, views FROM daily_metrics
       WHERE video_id NOT IN (SELECT 'v' || doc_id FROM labels)"""
)
Q["audit_kept_parts"] = with_star(
    """SELECT fact, part, CAST(sum(copies) AS BIGINT) AS rows,
              CAST(coalesce(sum(copies) FILTER (video_id IS NULL), 0) AS BIGINT) AS null_video_id,
              CAST(sum(null_views) AS BIGINT) AS null_views,
              count(*) FILTER (copies > 1) AS repeated_keys,
              CAST(sum(copies - 1) AS BIGINT) AS extra_rows,
              CAST(sum(CASE WHEN video_id IN (SELECT 'v' || doc_id FROM labels) THEN 0 ELSE copies END) AS BIGINT)
                AS orphan_rows
       FROM (
         SELECT 'daily' AS fact, CAST(date AS VARCHAR) AS part, video_id, count(*) AS copies,
                count(*) FILTER (views IS NULL) AS null_views
         FROM (SELECT video_id, date, views FROM daily_metrics UNION ALL
               SELECT video_id, date, views FROM daily_metrics
               WHERE date >= DATE '2024-01-13' AND date < DATE '2024-01-16')
         GROUP BY date, video_id
         UNION ALL
         SELECT 'traffic', lower(traffic_source_type), video_id, count(*), count(*) FILTER (views IS NULL)
         FROM (SELECT video_id, traffic_source_type, views FROM traffic_sources UNION ALL
               SELECT video_id, traffic_source_type, views FROM traffic_sources
               WHERE traffic_source_type = 'SIGNUP')
         GROUP BY traffic_source_type, video_id)
       GROUP BY fact, part"""
)
Q["fetch_plan"] = with_star(
    """SELECT video_id, CAST(published_at AS DATE) AS start_date, DATE '2024-01-28' AS end_date
       FROM videos WHERE CAST(published_at AS DATE) <= DATE '2024-01-28'"""
)
Q["stream_landing_upsert"] = Q["landing_daily_report"]

Q["filter_positive_retention"] = with_star(
    f"""SELECT video_id, date, views, {to_even('average_view_percentage', 6)} AS retention
        FROM daily_metrics WHERE average_view_percentage > 0"""
)
Q["filter_active_days"] = with_star(
    "SELECT video_id, date, views FROM daily_metrics WHERE coalesce(views, 0) <> 0"
)
for channel in (False, True):
    Q["filter_below_mean" + ("_by_channel" if channel else "")] = with_star(
        f"""SELECT {shown(channel)} video_id, {to_even('avg_retention', 6)} AS avg_retention,
                   {to_even('baseline_retention', 6)} AS baseline_retention FROM under""",
        engaged(channel),
    )
Q["filter_complete_features"] = with_star(
    "SELECT video_id, views_7d, total_views FROM training", FIRST_WEEK, TRAINING
)
SERIES_DAYS = "date BETWEEN DATE '2024-01-14' AND DATE '2024-02-13'"
Q["filter_last_n_days"] = with_star(f"SELECT video_id, date, views FROM daily_metrics WHERE {SERIES_DAYS}")
Q["stored_last_n_days"] = Q["filter_last_n_days"]
Q["filter_one_video"] = with_star("SELECT video_id, date, views FROM daily_metrics WHERE video_id = 'v7'")
Q["having_min_views"] = with_star("SELECT video_id, total_views FROM engaged", engaged(False))
Q["having_positive_views"] = with_star("SELECT video_id, total_views FROM first_week", FIRST_WEEK)
Q["join_videos_totals"] = with_star(
    """SELECT video_id, channel_id, title, published_at, total_views
       FROM videos JOIN totals USING (video_id)"""
)
Q["join_daily_videos"] = with_star(
    """SELECT video_id, date, views, channel_id, published_at
       FROM daily_metrics JOIN videos USING (video_id)"""
)
for channel in (False, True):
    Q["day_spine" + ("_by_channel" if channel else "")] = with_star(
        f"""SELECT {shown(channel, 's.g')} {big('s.n')} AS weekday, {DAYS_SQL}[s.n + 1] AS day,
                   l.mean_views
            FROM (SELECT g, n FROM (SELECT DISTINCT g FROM levels), range(7) AS r(n)) s
            LEFT JOIN levels l ON l.g = s.g AND l.dimension = 'weekday' AND l.level = s.n""",
        levels(channel),
    )

Q["video_totals"] = with_star("SELECT * FROM totals")
Q["avg_views_by_hour"] = with_star(
    f"""SELECT {big('hour(published_at)')} AS hour, avg(total_views) AS mean_views
        FROM videos JOIN totals USING (video_id) GROUP BY hour(published_at)"""
)
Q["avg_views_by_day"] = with_star(
    f"""SELECT names.day, m.mean_views
        FROM (SELECT unnest({DAYS_SQL}) AS day) names
        LEFT JOIN (SELECT dayname(published_at) AS day, avg(total_views) AS mean_views
                   FROM videos JOIN totals USING (video_id) GROUP BY dayname(published_at)) m
        USING (day)"""
)
Q["format_stats"] = with_star(
    """SELECT coalesce(avg(total_views) FILTER (WHERE is_short = 1), 0) AS mean_shorts,
              coalesce(avg(total_views) FILTER (WHERE is_short = 0), 0) AS mean_longform,
              count(*) FILTER (WHERE is_short = 1) AS total_shorts,
              count(*) FILTER (WHERE is_short = 0) AS total_longform,
              CAST(coalesce(sum(total_views) FILTER (WHERE is_short = 1), 0) AS BIGINT)
                AS shorts_total_views,
              CAST(coalesce(sum(total_views) FILTER (WHERE is_short = 0), 0) AS BIGINT)
                AS longform_total_views
       FROM videos JOIN totals USING (video_id)"""
)
Q["traffic_totals"] = with_star(
    "SELECT traffic_source_type, total_views FROM source_totals", sources(False)
)
for channel in (False, True):
    Q["traffic_share" + ("_by_channel" if channel else "")] = with_star(
        f"SELECT {shown(channel)} traffic_source_type, total_views, percentage FROM shares",
        sources(channel),
    )
Q["engagement_by_video"] = with_star(
    f"""SELECT video_id, title, {to_even('avg_retention', 6)} AS avg_retention, total_views, net_subs
        FROM engaged""",
    engaged(False),
)
Q["channel_engagement_baseline"] = with_star(
    f"""SELECT g AS channel_id, {to_even('baseline_retention', 6)} AS baseline_retention,
               {to_even('baseline_views', 6)} AS baseline_views FROM means""",
    engaged(True),
)
Q["weak_count"] = with_star("SELECT count(*) AS total_weak_count FROM under", engaged(False))
for name, test in [
    ("avg_views_by_emoji", non_ascii("title")),
    ("avg_views_by_exclamation", "contains(title, '!')"),
    ("avg_views_by_question", "contains(title, '?')"),
]:
    Q[name] = with_star(
        f"""SELECT coalesce(avg(total_views) FILTER (WHERE {test}), 0) AS mean_with,
                   coalesce(avg(total_views) FILTER (WHERE NOT {test}), 0) AS mean_without
            FROM videos JOIN totals USING (video_id)"""
    )
Q["avg_views_by_title_bucket"] = with_star(
    f"""SELECT {BUCKETS_SQL}[level + 1] AS bucket, videos, mean_views
        FROM levels WHERE dimension = 'length_bucket'""",
    levels(False),
)
Q["avg_title_length"] = with_star(
    f"""SELECT {to_even('avg(length(title))', 1)} AS avg_title_length
        FROM videos JOIN totals USING (video_id)"""
)
Q["title_and_time_means"] = with_star(
    "SELECT g AS channel_id, dimension, level, videos, views, mean_views FROM levels", levels(True)
)
Q["views_7d"] = with_star("SELECT * FROM first_week", FIRST_WEEK)
Q["category_distribution"] = with_star("SELECT * FROM spread", FIRST_WEEK, TRAINING, SPREAD)
Q["training_size"] = with_star("SELECT count(*) AS trained_on FROM training", FIRST_WEEK, TRAINING)


def series(keys, rows):
    def weighted(x):
        total = f"sum(CAST({x} AS DOUBLE) * views) / nullif(CAST(sum(views) AS DOUBLE), 0)"
        return f"{to_even(total, 4)} AS {x}"

    return f"""SELECT {keys}, {big('sum(views)')} AS views,
        {big('sum(estimated_minutes_watched)')} AS estimated_minutes_watched,
        {weighted('average_view_duration')}, {weighted('average_view_percentage')},
        {big('sum(subscribers_gained)')} AS subscribers_gained,
        {big('sum(subscribers_lost)')} AS subscribers_lost
      FROM {rows} WHERE {SERIES_DAYS} GROUP BY {keys}"""


Q["channel_daily_last_n"] = with_star(series("date", "daily_metrics"))
Q["channel_daily_last_n_by_channel"] = with_star(
    series("channel_id, date", "(SELECT * FROM daily_metrics JOIN videos USING (video_id))")
)
Q["video_daily_last_n"] = with_star(
    f"""SELECT date, views, estimated_minutes_watched, average_view_duration,
               {to_even('average_view_percentage', 6)} AS average_view_percentage
        FROM daily_metrics WHERE video_id = 'v7' AND {SERIES_DAYS} ORDER BY date"""
)
Q["video_traffic"] = with_star(
    """SELECT traffic_source_type, views, estimated_minutes_watched FROM traffic_sources
       WHERE video_id = 'v7' ORDER BY views DESC, traffic_source_type"""
)

for name, columns in [
    ("best_worst_hour", ["best_hour", "worst_hour"]),
    ("best_worst_day", ["best_day", "worst_day"]),
]:
    Q[name] = with_star(
        f"SELECT g AS channel_id, {_columns({c: UPLOAD[c] for c in columns})} FROM ranked GROUP BY g",
        levels(True),
    )
for channel in (False, True):
    suffix = "_by_channel" if channel else ""
    Q["top_3_hours" + suffix] = with_star(
        f"""SELECT {shown(channel)} level AS hour, mean_views FROM ranked
            WHERE dimension = 'hour' AND best <= 3""",
        levels(channel),
    )
    Q["weak_videos" + suffix] = with_star(
        f"""SELECT {shown(channel)} video_id, substr(title, 1, 60) AS title,
                   {to_even('avg_retention', 1)} AS avg_retention, total_views, net_subs,
                   {to_even('baseline_retention - avg_retention', 1)} AS below_avg_by
            FROM under WHERE place <= 5""",
        engaged(channel),
    )
    Q["top_3_sources" + suffix] = with_star(
        f"""SELECT {shown(channel)} traffic_source_type, total_views, percentage
            FROM shares WHERE place <= 3""",
        sources(channel),
    )
    for n in (10, 20):
        Q[f"top_videos_{n}" + suffix] = with_star(
            f"""SELECT {shown(channel)} video_id, title, total_views FROM grouped
                QUALIFY row_number() OVER (PARTITION BY g ORDER BY total_views DESC, video_id) <= {n}""",
            levels(channel),
        )
    Q["latest_videos" + suffix] = with_star(
        f"""SELECT {shown(channel, 'v.channel_id')} video_id, title, published_at FROM videos v
            QUALIFY row_number() OVER (PARTITION BY {group(channel)}
                                       ORDER BY published_at DESC, video_id) <= 5"""
    )
    Q["chart_hours" + suffix] = with_star(
        f"""SELECT {shown(channel)} level || ':00' AS hour, mean_views AS views, best = 1 AS is_max
            FROM ranked WHERE dimension = 'hour'""",
        levels(channel),
    )
    Q["chart_days" + suffix] = with_star(
        f"""SELECT {shown(channel, 's.g')} substr({DAYS_SQL}[s.n + 1], 1, 3) AS day,
                   coalesce(r.mean_views, 0) AS views, coalesce(r.best = 1, false) AS is_max
            FROM (SELECT g, n FROM (SELECT DISTINCT g FROM levels), range(7) AS x(n)) s
            LEFT JOIN ranked r ON r.g = s.g AND r.dimension = 'weekday' AND r.level = s.n""",
        levels(channel),
    )
del Q["top_videos_20_by_channel"]
Q["traffic_ranked"] = Q["traffic_share"]
Q["top_source"] = with_star(
    "SELECT traffic_source_type, total_views, percentage FROM shares WHERE place = 1", sources(False)
)
Q["best_title_bucket"] = with_star(
    f"""SELECT g AS channel_id, {TITLES['best_title_length_bucket']} AS best_title_length_bucket
        FROM ranked GROUP BY g""",
    levels(True),
)
Q["chart_traffic_top6"] = with_star(
    f"""SELECT traffic_source_type AS name, total_views AS value,
               CAST(floor(total_views / CAST(sum(total_views) OVER () AS DOUBLE) * 100 + 0.5) AS BIGINT)
                 AS percent_of_shown
        FROM shares WHERE place <= 6""",
    sources(False),
)

Q["publish_time_parts"] = f"""SELECT event_id, {big('hour(ts)')} AS hour,
  {big('isodow(ts) - 1')} AS day_of_week, dayname(ts) AS day, {big('month(ts)')} AS month FROM events"""
Q["parse_timestamps"] = """
  SELECT event_id, published_at, CAST(published_at AS DATE) AS date FROM (
    SELECT event_id, CASE event_type WHEN 'error' THEN NULL
                     WHEN 'view' THEN ts - INTERVAL 2 HOUR ELSE ts END AS published_at FROM events)"""
Q["title_flags"] = (
    f"SELECT doc_id, {parts_flags('title')}"
    " FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents)"
)
Q["text_flags"] = f"SELECT doc_id, {parts_flags('text')} FROM documents"
Q["title_length_bucket"] = f"""SELECT doc_id, {BUCKETS_SQL}[{bucket('title')} + 1] AS bucket
  FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents)"""
Q["performance_category"] = with_star(
    f"""SELECT video_id, {big(category('total_views'))} AS category,
               {LABELS_SQL}[{category('total_views')} + 1] AS label FROM totals"""
)
Q["format_verdict"] = with_star(
    f"""SELECT g AS channel_id,
               {_columns({c: FORMAT[c] for c in ['better_format', 'multiplier', 'has_baseline']})}
        FROM ranked GROUP BY g""",
    levels(True),
)
Q["iso_duration"] = """
  SELECT doc_id, CAST(seconds AS BIGINT) AS seconds, CAST(seconds + days * 86400 AS BIGINT) AS seconds_with_days,
         CAST(CASE WHEN seconds <= 60 THEN 1 ELSE 0 END AS BIGINT) AS is_short
  FROM (SELECT doc_id,
               CASE lang WHEN 'en' THEN n_chars WHEN 'fr' THEN n_chars // 3600 * 3600 + n_chars // 60 * 60
                    WHEN 'de' THEN n_chars ELSE 0 END AS seconds,
               CASE lang WHEN 'de' THEN n_chars // 86400 + 1 ELSE 0 END AS days
        FROM documents)"""
Q["compact_number"] = f"""
  SELECT o_custkey, {compact('n')} AS orders, {compact('total')} AS value,
         {compact('total / 20.0E0')} AS twentieth
  FROM (SELECT o_custkey, count(*) AS n, sum(CAST(round(o_totalprice) AS BIGINT)) AS total
        FROM orders GROUP BY o_custkey)"""


def capitals(x):
    return f"""array_to_string(list_transform(string_split({x}, ' '),
      lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"""


Q["display_name"] = f"""SELECT p_partkey, {capitals('lower(p_type)')} AS type, {capitals('p_name')} AS name
  FROM part"""

for channel in (False, True):
    suffix = "_by_channel" if channel else ""
    per_group = "FROM ranked GROUP BY g"
    Q["upload_times" + suffix] = with_star(
        f"SELECT {shown(channel)} {_columns({**UPLOAD, **UPLOAD_MAPS})} {per_group}", levels(channel)
    )
    Q["video_length" + suffix] = with_star(
        f"SELECT {shown(channel)} {_columns(FORMAT)} {per_group}", levels(channel)
    )
    Q["title_patterns" + suffix] = with_star(
        f"SELECT {shown(channel)} {_columns({**TITLES, **TITLE_MAPS})} {per_group}", levels(channel)
    )
    traffic_row = f"""SELECT g, max(CASE WHEN place = 1 THEN traffic_source_type END) AS top_source,
        max(CASE WHEN place = 1 THEN percentage END) AS top_source_percentage,
        string_agg(CASE WHEN place <= 3 THEN traffic_source_type END, '|' ORDER BY place)
          AS top_3_sources,
        string_agg(concat_ws(':', traffic_source_type, total_views, {scaled('percentage', 10)}), '|'
                   ORDER BY traffic_source_type) AS sources FROM shares GROUP BY g"""
    Q["traffic" + suffix] = with_star(
        f"""SELECT {shown(channel)} top_source, top_source_percentage, top_3_sources, sources
            FROM ({traffic_row})""",
        sources(channel),
    )
    Q["weak_engagement" + suffix] = with_star(
        f"""SELECT {shown(channel)} channel_avg_retention, channel_avg_views, total_weak_count,
                   weak_list AS weak_videos FROM weak""",
        engaged(channel),
    )
    facts = f"facts AS (SELECT g, {_columns({**UPLOAD, **FORMAT, **TITLES})} {per_group})"
    Q["all_patterns_flat" + suffix] = with_star(
        f"""SELECT {shown(channel)} best_hour, worst_day, best_day_avg_views, better_format, multiplier,
                   longform_total_views, top_source, top_source_percentage, channel_avg_retention,
                   total_weak_count, weak_videos, emoji_helps, best_title_length_bucket,
                   avg_title_length
            FROM facts LEFT JOIN ({traffic_row}) USING (g) LEFT JOIN weak USING (g)""",
        levels(channel),
        facts,
        sources(channel),
        engaged(channel),
    )
    every = {**UPLOAD, **UPLOAD_MAPS, **FORMAT, **TITLES, **TITLE_MAPS}
    Q["all_patterns" + suffix] = with_star(
        f"""SELECT {shown(channel)} {', '.join(every)}, top_source, top_source_percentage,
                   top_3_sources, sources, channel_avg_retention, channel_avg_views, total_weak_count,
                   weak_list AS weak_videos
            FROM (SELECT g, {_columns(every)} {per_group})
            LEFT JOIN ({traffic_row}) USING (g) LEFT JOIN weak USING (g)""",
        levels(channel),
        sources(channel),
        engaged(channel),
    )
    Q["kpi_tiles" + suffix] = with_star(
        f"""SELECT {shown(channel)} {compact('total_shorts')} AS total_shorts,
                   {compact('total_longform')} AS total_longform, better_format,
                   regexp_replace(CAST(coalesce(channel_avg_retention, 0) AS VARCHAR), '\\.0$', '') || '%'
                     AS avg_retention,
                   {compact('total_weak_count')} AS weak_videos
            FROM facts LEFT JOIN weak USING (g)""",
        levels(channel),
        facts,
        engaged(channel),
    )
    # Kept through two loads, the reports are those of the last rows.
    Q["kept_patterns" + suffix] = Q["all_patterns" + suffix]
    Q["kept_kpi_tiles" + suffix] = Q["kpi_tiles" + suffix]
    Q["context_upload" + suffix] = with_star(
        f"SELECT {shown(channel)} {_columns(UPLOAD)} {per_group}", levels(channel)
    )
    title_names = [c for c in TITLES if "question" not in c]
    Q["context_titles" + suffix] = with_star(
        f"SELECT {shown(channel)} {', '.join(title_names)}, 'travel' AS topic FROM facts",
        levels(channel),
        facts,
    )
    Q["context_weak_video" + suffix] = with_star(
        f"""SELECT {shown(channel, 'u.g')} u.video_id, substr(u.title, 1, 60) AS title,
                   {to_even('u.avg_retention', 1)} AS avg_retention, u.total_views,
                   w.channel_avg_retention, w.channel_avg_views, f.better_format, f.multiplier,
                   f.has_baseline
            FROM under u JOIN weak w USING (g) JOIN facts f USING (g) WHERE u.place <= 5""",
        levels(channel),
        facts,
        engaged(channel),
    )
    Q["context_thumbnail" + suffix] = with_star(
        f"""SELECT {shown(channel)} better_format, multiplier, has_baseline, emoji_helps, top_source
            FROM facts LEFT JOIN ({traffic_row}) USING (g)""",
        levels(channel),
        facts,
        sources(channel),
    )
    Q["context_audit" + suffix] = with_star(
        f"""SELECT {shown(channel)} best_day, best_hour, better_format, multiplier, has_baseline,
                   total_shorts, total_longform, top_source, top_source_percentage,
                   channel_avg_retention, total_weak_count
            FROM facts LEFT JOIN ({traffic_row}) USING (g) LEFT JOIN weak USING (g)""",
        levels(channel),
        facts,
        sources(channel),
        engaged(channel),
    )
    Q["context_next_videos" + suffix] = with_star(
        f"""SELECT {shown(channel)} better_format, multiplier, has_baseline, emoji_helps,
                   best_title_length_bucket, top_titles
            FROM facts JOIN best_titles USING (g)""",
        levels(channel),
        facts,
        best_titles(channel, 15),
    )
    Q["context_title_thumbnail" + suffix] = with_star(
        f"""SELECT {shown(channel)} doc_id, title, emoji_helps, better_format, top_source, top_titles
            FROM candidates LEFT JOIN (SELECT * FROM facts LEFT JOIN ({traffic_row}) USING (g)
                                       LEFT JOIN best_titles USING (g)) USING (g)""",
        levels(channel),
        facts,
        sources(channel),
        best_titles(channel, 10),
        candidates(channel),
    )

Q["ml_features"] = with_star(
    """SELECT video_id, hour, day_of_week, month, title_length, has_emoji, has_exclamation,
              has_question, title_word_count, title_has_numbers, views_7d, category FROM training""",
    FIRST_WEEK,
    TRAINING,
)
Q["ml_folds"] = with_star(
    f"""SELECT video_id, category,
               {big('(row_number() OVER (PARTITION BY category ORDER BY video_id) - 1) % 5')}
                 AS fold
        FROM training""",
    FIRST_WEEK,
    TRAINING,
)
Q["candidate_features"] = with_star(
    f"""SELECT c.doc_id, c.g AS channel_id,
               {features('c.title', 'coalesce(s.hour, o.hour)', 'coalesce(s.day, o.day)', '2')}
        FROM candidates c LEFT JOIN (
          SELECT g, {at_rank('hour', 'best', 'level')} AS hour,
                 {at_rank('weekday', 'best', 'level')} AS day {per_group}) s USING (g)
        CROSS JOIN (
          SELECT {at_rank('hour', 'best', 'level')} AS hour, {at_rank('weekday', 'best', 'level')} AS day
          FROM (SELECT dimension, level, row_number() OVER (PARTITION BY dimension
                         ORDER BY sum(views) / CAST(sum(videos) AS DOUBLE) DESC, level) AS best
                FROM levels GROUP BY dimension, level)) o""",
    levels(True),
    candidates(True),
)
Q["chart_distribution"] = with_star(
    f"""SELECT CASE category WHEN 0 THEN label WHEN 3 THEN label ELSE 'Medium / High' END AS tile,
               {big('sum(videos)')} AS videos FROM spread GROUP BY 1""",
    FIRST_WEEK,
    TRAINING,
    SPREAD,
)

Q["normalise_responses"] = f"""WITH {RESPONSES}
  SELECT cache_key, created_at, CASE WHEN kind = 'object' THEN CAST(body AS VARCHAR) END AS reply,
         CASE kind WHEN 'broken' THEN 'Could not parse AI response'
              WHEN 'list' THEN 'AI response was valid JSON, but not a JSON object' END AS error,
         CASE WHEN kind <> 'object' THEN substr(response, 1, 500) END AS raw
  FROM responses"""
Q["responses_live"] = f"""WITH {RESPONSES}
  SELECT cache_key, CAST(body AS VARCHAR) AS reply, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, response DESC) AS rn
    FROM responses)
  WHERE rn = 1 AND kind = 'object' AND created_at >= TIMESTAMP '2024-01-29 12:00:00'"""
Q["upsert_responses"] = f"""WITH {RESPONSES}
  SELECT cache_key, created_at, response FROM responses
  QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, response DESC) = 1"""
Q["context_fingerprint"] = with_star(
    """SELECT g AS channel_id,
              md5(CAST(json_object('best_day', best_day, 'best_day_avg_views', best_day_avg_views,
                                   'best_hour', best_hour, 'best_hour_avg_views', best_hour_avg_views,
                                   'top_3_hours', hours, 'worst_day', worst_day,
                                   'worst_hour', worst_hour) AS VARCHAR)
                  || 'upload_strategy' || 'provider' || 'model') AS cache_key
       FROM (SELECT g, """
    + _columns(UPLOAD)
    + """, list(level ORDER BY best) FILTER (WHERE dimension = 'hour' AND best <= 3) AS hours
             FROM ranked GROUP BY g)
       WHERE g NOT IN (SELECT g FROM ranked WHERE g IN ('c_de', 'c_fr'))""",
    levels(True),
)
# The first tree of a class fits what is left of its share; its root has the split with most gain.
Q["ml_fit"] = with_star(
    """SELECT category, CAST(100 AS BIGINT) AS trees, CAST(s.videos AS BIGINT) AS trained_on,
               round(ln(s.n / CAST(s.videos AS DOUBLE)), 9) AS start, feature,
               (value + next) / 2.0::DOUBLE AS threshold
        FROM firsts JOIN sizes s USING (category) WHERE rank = 1""",
    FIRST_WEEK,
    TRAINING,
    f"""sizes AS (
          SELECT category, count(*) AS n, sum(count(*)) OVER () AS videos FROM training GROUP BY category),
        long AS (
          SELECT category, feature, value, place FROM (
            SELECT category, unnest({FEATURES}) AS feature, unnest([{', '.join(FEATURES)}]) AS value,
                   unnest(range({len(FEATURES)})) AS place FROM training)),
        counts AS (
          SELECT s.category, feature, place, value, count(*) AS w, count(*) FILTER (l.category = s.category) AS y
          FROM long l, sizes s GROUP BY ALL),
        cuts AS (
          SELECT category, feature, place, value, lead(value) OVER o AS next,
                 CAST(sum(w) OVER o AS DOUBLE) AS lw, CAST(sum(y) OVER o AS DOUBLE) AS ly,
                 CAST(sum(w) OVER p AS DOUBLE) AS w, CAST(sum(y) OVER p AS DOUBLE) AS y
          FROM counts WINDOW o AS (PARTITION BY category, place ORDER BY value),
                             p AS (PARTITION BY category, place)),
        gains AS (
          SELECT *, lw * (w - lw) / w * (ly / lw - (y - ly) / (w - lw)) ** 2 AS gain FROM cuts WHERE next IS NOT NULL),
        firsts AS (
          SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(gain, 9) DESC, place, value) AS rank
          FROM gains)""",
)
