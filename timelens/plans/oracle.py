"""What the registered queries must return, as SQL for DuckDB on the same tables."""

from __future__ import annotations

EV = """
ev AS (
  SELECT event_type AS host, event_id, ts,
         CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5
                         WHEN 'view' THEN 6 ELSE 7 END AS priority,
         event_type AS unit, event_type AS source, CAST(user_id AS INTEGER) AS pid, props AS message
  FROM events)"""

SM = """
sm AS (
  SELECT event_type AS host, ts, least(value, 100.0::DOUBLE) AS cpu_pct,
         CAST(floor(value * 1000000) AS BIGINT) AS mem_used, 500000000::BIGINT AS mem_total,
         ((event_id * 7919) % 1000003) * 4096 AS disk_read,
         ((event_id * 104729) % 1000003) * 512 AS disk_write,
         ((event_id * 15485863) % 1000003) * 1500 AS net_rx,
         event_id * 1024 AS net_tx
  FROM events)"""

PR = """
pr AS (
  SELECT date_trunc('hour', ts) AS ts, CAST(user_id AS INTEGER) AS pid, 'user_' || user_id AS name,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cpu_pct,
         CAST(count(*) * 1048576 AS BIGINT) AS mem_rss
  FROM events GROUP BY 1, 2, 3)"""

PRF = PR.replace("SELECT date_trunc", "SELECT event_type AS host, date_trunc").replace(
    "GROUP BY 1, 2, 3", "GROUP BY 1, 2, 3, 4").replace("pr AS", "prf AS")

CURSORS = """
cur AS (
  SELECT event_id AS cursor_id, ts + INTERVAL 45 SECOND AS at FROM events WHERE event_type = 'error')"""

SHOWN = "event_id, ts, priority, unit, source, pid, message"
SAMPLE = "ts, cpu_pct, mem_used, mem_total, disk_read, disk_write, net_rx, net_tx"
PROCESS = "ts, pid, name, cpu_pct, mem_rss"

VEC = """
vec AS (
  SELECT vec_id AS event_id, TIMESTAMP '1970-01-01' + to_seconds(vec_id) AS ts, 6 AS priority,
         'label' || label AS unit, '' AS source, 0 AS pid, 'vector ' || vec_id AS message, embedding
  FROM embeddings)"""

DONE = "event_id NOT IN (SELECT vec_id FROM embeddings)"


def rate(column: str) -> str:
    grown = f"({column} - p_{column})"
    return (
        f"CASE WHEN p_ts IS NULL OR sec <= 0 OR {grown} < 0 THEN 0 "
        f"ELSE CAST(trunc({grown} / sec) AS BIGINT) END"
    )


COUNTERS = ["disk_read", "disk_write", "net_rx", "net_tx"]


def rated(source: str = "sm", partition: str = "", name: str = "rated") -> str:
    """CTE with rates against the row before."""
    lags = ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ["ts", *COUNTERS])
    rates = ", ".join(f"{rate(c)} AS {c}_rate" for c in COUNTERS)
    over = f"PARTITION BY {partition} ORDER BY ts" if partition else "ORDER BY ts"
    return f"""
{name}_lag AS (SELECT *, {lags} FROM {source} WINDOW w AS ({over})),
{name}_sec AS (SELECT *, date_diff('microsecond', p_ts, ts) / 1000000::DOUBLE AS sec FROM {name}_lag),
{name} AS (SELECT q.*, disk_read_rate + disk_write_rate AS disk_rate, net_rx_rate + net_tx_rate AS net_rate
           FROM (SELECT *, {rates} FROM {name}_sec) q)"""


RATES = "ts, disk_read_rate, disk_write_rate, net_rx_rate, net_tx_rate, disk_rate, net_rate"
MEM_PCT = "CASE WHEN mem_total > 0 THEN mem_used / mem_total * 100 ELSE 0 END"
BAND = "CASE WHEN cpu_pct < 50 THEN 'ok' WHEN cpu_pct < 80 THEN 'warn' ELSE 'high' END"


def trends(ends: str, partition: str, seconds: int) -> str:
    """Trend series per end, from CTEs `sm` and `rated` (which has p_ts and sec)."""
    same = " AND s.host = e.host" if partition else ""
    keys = "host, " if partition else ""
    key_e = "e.host, " if partition else ""
    return f"""
ends AS ({ends}),
win AS (
  SELECT {key_e}e."end", s.ts, s.cpu_pct AS cpu, {MEM_PCT} AS mem,
         CASE WHEN s.p_ts >= e."end" - INTERVAL {seconds} SECOND THEN s.disk_rate ELSE 0 END::DOUBLE AS disk,
         CASE WHEN s.p_ts >= e."end" - INTERVAL {seconds} SECOND THEN s.net_rate ELSE 0 END::DOUBLE AS net
  FROM ends e JOIN rated s ON s.ts BETWEEN e."end" - INTERVAL {seconds} SECOND AND e."end"{same}),
pk AS (SELECT *, greatest(max(disk) OVER w, 0) AS dp, greatest(max(net) OVER w, 0) AS np, count(*) OVER w AS n
       FROM win WINDOW w AS (PARTITION BY {keys}"end"))
SELECT {keys}"end", ts, 'cpu' AS series, cpu AS value, NULL::DOUBLE AS peak FROM pk WHERE n >= 2
UNION ALL SELECT {keys}"end", ts, 'mem', mem, NULL FROM pk WHERE n >= 2
UNION ALL SELECT {keys}"end", ts, 'disk', CASE WHEN dp > 0 THEN disk / dp * 100 ELSE 0 END, dp FROM pk WHERE n >= 2
UNION ALL SELECT {keys}"end", ts, 'net', CASE WHEN np > 0 THEN net / np * 100 ELSE 0 END, np FROM pk WHERE n >= 2"""


def state(keys: list[str], partition: str, gap: int | None, history: int, trend: int, procs: str) -> str:
    """State rows for CTE `cur(keys, sample_ts, batch_ts)`, from `rated`, and processes in `procs`."""
    host = bool(partition)
    same_s = " AND s.host = c.host" if host else ""
    k = "c.host, " if host else ""
    key = "host, " if host else ""
    own = [
        f"CASE WHEN s.sec <= {gap} THEN s.{c}_rate ELSE 0 END AS {c}_rate" if gap else f"s.{c}_rate"
        for c in COUNTERS
    ]
    def on(table: str, column: str) -> str:
        return f"{table}.{column} = c.{column}" + (f" AND {table}.host = c.host" if host else "")

    lead = "".join(f"c.{c}, " for c in keys)
    return f"""
pts AS (SELECT DISTINCT {key}sample_ts FROM cur WHERE sample_ts IS NOT NULL),
hist AS (
  SELECT {k}c.sample_ts, count(*) AS history_n, arg_min(s.cpu_pct, s.ts) AS history_first
  FROM pts c JOIN rated s ON s.ts BETWEEN c.sample_ts - INTERVAL {history} SECOND AND c.sample_ts{same_s}
  GROUP BY ALL),
tr AS (
  SELECT {k}c.sample_ts, s.ts,
         CASE WHEN s.p_ts >= c.sample_ts - INTERVAL {trend} SECOND THEN s.disk_rate ELSE 0 END::DOUBLE AS disk,
         CASE WHEN s.p_ts >= c.sample_ts - INTERVAL {trend} SECOND THEN s.net_rate ELSE 0 END::DOUBLE AS net
  FROM pts c JOIN rated s ON s.ts BETWEEN c.sample_ts - INTERVAL {trend} SECOND AND c.sample_ts{same_s}),
tra AS (
  SELECT {key}sample_ts, count(*) AS n, min(ts) AS t0, arg_max(disk, ts) AS d1, arg_max(net, ts) AS n1,
         max(disk) AS dp, max(net) AS np
  FROM tr GROUP BY ALL),
tp AS (
  SELECT *, row_number() OVER (PARTITION BY {key}ts ORDER BY cpu_pct DESC NULLS LAST, pid) AS rank FROM {procs}),
tops AS (
  SELECT {key}ts AS batch_ts, count(*) AS top_n, max(CASE WHEN rank = 1 THEN pid END) AS top_pid,
         max(CASE WHEN rank = 5 THEN name END) AS fifth_name
  FROM tp WHERE rank <= 5 GROUP BY ALL)
SELECT {lead}c.sample_ts, s.cpu_pct, {MEM_PCT} AS mem_pct, {BAND} AS cpu_band, {', '.join(own)},
       CAST(history_n AS INTEGER) AS history_n, history_first,
       CAST(CASE WHEN n >= 2 THEN n ELSE 0 END AS INTEGER) AS trend_n,
       CASE WHEN n >= 2 THEN t0 END AS trend_from,
       CASE WHEN n >= 2 THEN CASE WHEN dp > 0 THEN d1 / dp * 100 ELSE 0 END END AS disk_last,
       CASE WHEN n >= 2 THEN CASE WHEN np > 0 THEN n1 / np * 100 ELSE 0 END END AS net_last,
       CASE WHEN n >= 2 THEN dp ELSE 0 END AS disk_peak, CASE WHEN n >= 2 THEN np ELSE 0 END AS net_peak,
       c.batch_ts, CAST(coalesce(top_n, 0) AS INTEGER) AS top_n, top_pid, fifth_name
FROM cur c JOIN rated s ON s.ts = c.sample_ts{same_s}
JOIN hist ON {on('hist', 'sample_ts')} JOIN tra ON {on('tra', 'sample_ts')}
LEFT JOIN tops ON {on('tops', 'batch_ts')}"""


def first_of(keys: str, where: str = "") -> str:
    return f"""
WITH r AS (SELECT event_id AS ingest_seq, date_trunc('hour', ts) AS ts, CAST(user_id AS INTEGER) AS pid,
                  event_type, value FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ingest_seq) AS rn FROM r)
SELECT ingest_seq, ts, pid, event_type, value FROM n WHERE rn = 1 {where}"""


def human(n: str) -> str:
    return (
        f"CASE WHEN {n} >= 1099511627776 THEN printf('%.2f TB', {n} / 1099511627776) "
        f"WHEN {n} >= 1073741824 THEN printf('%.2f GB', {n} / 1073741824) "
        f"WHEN {n} >= 1048576 THEN printf('%.2f MB', {n} / 1048576) "
        f"WHEN {n} >= 1024 THEN printf('%.2f KB', {n} / 1024) ELSE printf('%d B', {n}) END"
    )


NEAR = """
SELECT {key}c.cursor_id, {at}
       CAST(row_number() OVER (PARTITION BY c.cursor_id ORDER BY e.ts, e.event_id) AS INTEGER) AS rank,
       e.event_id, e.ts{extra}
FROM {cursors} c JOIN ev e ON e.ts BETWEEN c.at - INTERVAL {w} SECOND AND c.at + INTERVAL {w} SECOND{same}
QUALIFY rank <= {limit}"""

RFC3339 = """strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN rtrim(strftime(ts, '%f'), '0') = '' THEN '' ELSE '.' || rtrim(strftime(ts, '%f'), '0') END || 'Z'"""

PARSED = """
SELECT event_id, ts, CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5
                                     WHEN 'view' THEN 6 ELSE 0 END AS priority,
       event_type AS unit, event_type AS source, CAST(user_id AS INTEGER) AS pid, props AS message
FROM events WHERE NOT (event_type = 'signup' AND value < 10)"""

COSINE = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"



def embedded(text: str, rows: str) -> str:
    """CTEs ending in `emb` (event_id, embedding) of the offline embedder over `text` of `rows`."""
    return f"""places AS (SELECT event_id, list_transform(list_filter(regexp_split_to_array(lower({text}), '\\s'), lambda w: w <> ''),
            lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS p FROM {rows}),
        counts AS (SELECT event_id, list_transform(range(0, 64), lambda i: len(list_filter(p, lambda x: x = i))::DOUBLE) AS c FROM places),
        emb AS (SELECT event_id, list_transform(c, lambda x: (x / sqrt(list_sum(list_transform(c, lambda y: y * y))))::FLOAT) AS embedding
            FROM counts WHERE list_sum(c) > 0)"""


DOCS = """docs AS (SELECT doc_id AS event_id, CASE WHEN coalesce(source, '') = '' THEN text ELSE source || ': ' || text END AS body,
        source AS unit, lang, text FROM documents)"""
CONTENT = """CAST(len(embedding) AS INTEGER) AS dimensions,
    round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 3) AS content"""
REFRESHES = """src AS (SELECT *, floor(event_id * 4 / (max(event_id) OVER () + 1)) AS batch FROM events)"""

SQL: dict[str, str] = {
    "events_latest": f"WITH {EV} SELECT {SHOWN} FROM ev ORDER BY ts DESC, event_id LIMIT 20",
    "events_search": f"""WITH {EV} SELECT {SHOWN} FROM ev
        WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 31 DAY
          AND (contains(lower(message), '"k": 4') OR contains(lower(unit), '"k": 4'))
        ORDER BY ts DESC, event_id LIMIT 50""",
    "events_search_by_unit": f"""WITH {EV} SELECT {SHOWN} FROM ev
        WHERE ts >= TIMESTAMP '2024-01-24' AND (contains(lower(message), 'sign') OR contains(lower(unit), 'sign'))
        ORDER BY ts DESC, event_id LIMIT 50""",
    "events_search_wildcards": f"""WITH {EV} SELECT {SHOWN} FROM ev
        WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 31 DAY
          AND (lower(message) LIKE '%k%_7}}%' OR lower(unit) LIKE '%k%_7}}%')
        ORDER BY ts DESC, event_id LIMIT 50""",
    "events_search_text": """SELECT doc_id AS event_id, source AS unit, lang AS source, length(text) AS chars
        FROM documents WHERE contains(lower(text), 'für') OR contains(lower(source), 'für')""",
    "events_near_time": f"""WITH {EV} SELECT {SHOWN} FROM ev
        WHERE ts BETWEEN TIMESTAMP '2024-01-25 23:00:00' AND TIMESTAMP '2024-01-26 01:00:00'
        ORDER BY ts, event_id LIMIT 50""",
    "events_at": f"""WITH {EV} SELECT {SHOWN} FROM ev
        WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:08:00' AND TIMESTAMP '2024-01-01 00:09:00'
        ORDER BY ts, event_id LIMIT 10""",
    "events_at_live": f"WITH {EV} SELECT {SHOWN} FROM ev ORDER BY ts DESC, event_id LIMIT 10",
    "events_near_many": f"WITH {EV}, {CURSORS} " + NEAR.format(
        key="", at="c.at,", extra=", e.unit, e.message", cursors="cur", w=1800, same="", limit=10),
    "events_near_fleet": f"WITH {EV}, cur AS (SELECT host, event_id AS cursor_id, ts AS at FROM ev) " + NEAR.format(
        key="c.host, ", at="", extra="", cursors="cur", w=600, same=" AND e.host = c.host", limit=3),
    "events_pending": f"""WITH {EV} SELECT event_id, ts, unit, message FROM ev
        WHERE {DONE} ORDER BY ts DESC, event_id LIMIT 50""",
    "events_pending_all": f"WITH {EV} SELECT event_id, ts, unit, message FROM ev WHERE {DONE}",
    "events_semantic": f"""WITH {VEC} SELECT v.event_id, v.ts, v.priority, v.unit, v.source, v.pid, v.message
        FROM vec v, vec q WHERE q.event_id = 7 ORDER BY {COSINE} DESC, v.event_id LIMIT 10""",
    "events_semantic_many": f"""WITH {VEC} SELECT q.event_id AS query_id, v.event_id,
          CAST(row_number() OVER (PARTITION BY q.event_id ORDER BY {COSINE} DESC, v.event_id) AS INTEGER) AS rank
        FROM vec q, vec v QUALIFY rank <= 10""",
    "events_as_json": f"""WITH {EV}, w AS (SELECT * FROM ev
          WHERE ts BETWEEN TIMESTAMP '2024-01-15 11:00:00' AND TIMESTAMP '2024-01-15 13:00:00'
          ORDER BY ts, event_id LIMIT 50)
        SELECT '{{"at":"' || {RFC3339} || '","event_id":' || event_id || ',"priority":' || priority ||
               ',"unit":"' || unit || '","source":"' || source || '","pid":' || pid || '}}' AS value FROM w""",
    "schema_conform": f"WITH {EV} SELECT event_id, ts, pid, unit, true AS pending FROM ev",
    "system_current": f"WITH {SM} SELECT {SAMPLE} FROM sm ORDER BY ts DESC LIMIT 1",
    "system_current_fleet": f"""WITH {SM} SELECT host, {SAMPLE} FROM sm
        QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC) = 1""",
    "system_history": f"""WITH {SM} SELECT {SAMPLE} FROM sm
        WHERE ts BETWEEN TIMESTAMP '2024-01-11' AND TIMESTAMP '2024-01-21'""",
    "system_top_cpu": f"""WITH {PR} SELECT {PROCESS} FROM pr WHERE ts = (SELECT max(ts) FROM pr)
        ORDER BY cpu_pct DESC, pid LIMIT 10""",
    "system_top_mem": f"""WITH {PR} SELECT {PROCESS} FROM pr WHERE ts = (SELECT max(ts) FROM pr)
        ORDER BY mem_rss DESC, pid LIMIT 7""",
    "system_top_fleet": f"""WITH {PRF} SELECT p.host, {PROCESS},
          CAST(row_number() OVER (PARTITION BY p.host ORDER BY mem_rss DESC, pid) AS INTEGER) AS rank
        FROM prf p WHERE ts = (SELECT max(ts) FROM prf x WHERE x.host = p.host) QUALIFY rank <= 5""",
    "system_sample_at": f"""WITH {SM} SELECT {SAMPLE} FROM sm WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'
        ORDER BY ts DESC LIMIT 1""",
    "system_sample_at_fleet": f"""WITH {SM} SELECT host, {SAMPLE} FROM sm
        WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'
        QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC) = 1""",
    "system_samples_at_many": f"""WITH {SM}, {CURSORS}
        SELECT c.cursor_id, c.at, s.ts AS as_of, {SAMPLE[4:]} FROM cur c ASOF LEFT JOIN sm s ON c.at >= s.ts""",
    "system_samples_at_fleet": f"""WITH {SM}, {PRF}, cur AS (SELECT DISTINCT host, ts AS at FROM prf)
        SELECT c.host, c.at, s.ts AS as_of, {SAMPLE[4:]}
        FROM cur c ASOF LEFT JOIN sm s ON c.host = s.host AND c.at >= s.ts""",
    "system_samples_before": f"""WITH {SM}, cur AS (SELECT event_id AS cursor_id, ts AS at FROM events)
        SELECT c.cursor_id, c.at, s.ts AS as_of, cpu_pct, mem_used
        FROM cur c ASOF JOIN sm s ON c.at > s.ts WHERE date_diff('microsecond', s.ts, c.at) <= 120000000""",
    "system_top_at": f"""WITH {PR} SELECT {PROCESS} FROM pr
        WHERE ts = (SELECT max(ts) FROM pr WHERE ts <= TIMESTAMP '2024-01-15 12:00:00')
        ORDER BY cpu_pct DESC, pid LIMIT 5""",
    "system_top_at_many": f"""WITH {PR}, {CURSORS}, t AS (SELECT DISTINCT ts FROM pr),
        n AS (SELECT *, CAST(row_number() OVER (PARTITION BY ts ORDER BY mem_rss DESC, pid) AS INTEGER) AS rank
              FROM pr)
        SELECT c.cursor_id, c.at, n.ts AS as_of, pid, name, cpu_pct, mem_rss, rank
        FROM (SELECT cur.*, t.ts FROM cur ASOF JOIN t ON cur.at >= t.ts) c JOIN n ON n.ts = c.ts WHERE rank <= 5""",
    "process_at": f"""WITH {PRF}, cur AS (
          SELECT event_type AS host, CAST(user_id AS INTEGER) AS pid, event_id AS cursor_id, ts AS at FROM events)
        SELECT c.host, c.pid, c.cursor_id, c.at, p.ts AS as_of, p.name, p.cpu_pct, p.mem_rss
        FROM cur c ASOF LEFT JOIN prf p ON c.host = p.host AND c.pid = p.pid AND c.at >= p.ts""",
    "system_bounds": f"WITH {SM} SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM sm",
    "system_bounds_fleet": f"""WITH {SM} SELECT host, min(ts) AS min_ts, max(ts) AS max_ts,
          date_diff('microsecond', min(ts), max(ts)) AS span_us FROM sm GROUP BY host""",
    "system_rates": f"WITH {SM}, {rated()} SELECT {RATES} FROM rated",
    "system_rates_gap": f"""WITH {SM}, {rated()} SELECT ts, {', '.join(
        f'CASE WHEN sec <= 120 THEN {c} ELSE 0 END AS {c}' for c in RATES.split(', ')[1:])} FROM rated""",
    "system_rates_fleet": f"WITH {SM}, {rated(partition='host')} SELECT host, {RATES} FROM rated",
    "system_trends": f"""WITH {SM}, {rated()}, {trends('SELECT max(ts) AS "end" FROM sm', '', 86400)}""",
    "system_trends_fleet": f"""WITH {SM}, {PRF}, {rated(partition='host')},
        {trends('SELECT DISTINCT host, ts AS "end" FROM prf', 'host', 3600)}""",
    "system_rolling_cpu": f"""WITH {SM} SELECT ts, CAST(count(*) OVER w AS INTEGER) AS n,
          first_value(cpu_pct) OVER w AS oldest, cpu_pct AS newest, max(cpu_pct) OVER w AS highest
        FROM sm WINDOW w AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    "system_cpu_history": f"""WITH {SM} SELECT host, ts, CAST(count(*) OVER w AS INTEGER) AS n,
          first_value(cpu_pct) OVER w AS oldest, cpu_pct AS newest, max(cpu_pct) OVER w AS highest
        FROM sm WINDOW w AS (PARTITION BY host ORDER BY ts
                             RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)""",
    "system_state_at": f"""WITH {SM}, {PR}, {rated()}, c0 AS ({CURSORS.split('AS (', 1)[1]},
        t AS (SELECT DISTINCT ts FROM pr),
        c1 AS (SELECT c0.*, s.ts AS sample_ts FROM c0 ASOF JOIN sm s ON c0.at >= s.ts),
        cur AS (SELECT c1.*, t.ts AS batch_ts FROM c1 ASOF LEFT JOIN t ON c1.at >= t.ts),
        {state(['cursor_id', 'at'], '', 120, 1800, 3600, 'pr')}""",
    "system_state_at_fleet": f"""WITH {SM}, {PRF}, {rated(partition='host')},
        t AS (SELECT DISTINCT host, ts FROM prf), c0 AS (SELECT host, ts AS at FROM t),
        c1 AS (SELECT c0.*, s.ts AS sample_ts FROM c0 ASOF JOIN sm s ON c0.host = s.host AND c0.at >= s.ts),
        cur AS (SELECT c1.*, t.ts AS batch_ts FROM c1 ASOF LEFT JOIN t ON c1.host = t.host AND c1.at >= t.ts),
        {state(['host', 'at'], 'host', 600, 3600, 7200, 'prf')}""",
    "system_snapshot": f"""WITH {SM}, {PR}, {rated()},
        cur AS (SELECT max(ts) AS sample_ts, (SELECT max(ts) FROM pr) AS batch_ts FROM sm),
        {state([], '', None, 60, 3600, 'pr')}""",
    "system_snapshot_fleet": f"""WITH {SM}, {PRF}, {rated(partition='host')},
        cur AS (SELECT host, sample_ts, batch_ts FROM (SELECT host, max(ts) AS sample_ts FROM sm GROUP BY host)
                JOIN (SELECT host, max(ts) AS batch_ts FROM prf GROUP BY host) USING (host)),
        {state(['host'], 'host', None, 60, 3600, 'prf')}""",
    "samples_build": """SELECT date_trunc('hour', ts) AS ts,
          least(coalesce(max(value) FILTER (event_type = 'purchase'), 0), 100.0::DOUBLE) AS cpu_pct,
          CAST(count(*) FILTER (event_type = 'purchase') * 1048576 AS BIGINT) AS mem_used,
          CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 500000000 ELSE 0 END::BIGINT AS mem_total,
          CAST(coalesce(sum(event_id * 7) FILTER (event_type <> 'view'), 0) AS BIGINT) AS disk_read,
          CAST(coalesce(sum(event_id * 3) FILTER (event_type <> 'view'), 0) AS BIGINT) AS disk_write,
          CAST(coalesce(sum(event_id * 7) FILTER (event_type = 'view'), 0) AS BIGINT) AS net_rx,
          CAST(coalesce(sum(event_id * 3) FILTER (event_type = 'view'), 0) AS BIGINT) AS net_tx
        FROM events GROUP BY 1""",
    "processes_top_per_tick": f"""WITH {PR} SELECT {PROCESS} FROM pr
        QUALIFY row_number() OVER (PARTITION BY ts ORDER BY cpu_pct DESC, pid) <= 10""",
    "first_wins_samples": first_of(
        "ts", "AND ts NOT IN (SELECT date_trunc('hour', ts) FROM events WHERE event_type = 'purchase')"),
    "first_wins_processes": first_of("ts, pid"),
    "journal_parse": PARSED,
    "journal_rejects": "SELECT event_id, ts AS arrived FROM events WHERE event_type = 'signup' AND value < 10",
    "vector_import": """SELECT vec_id AS event_id, CAST(4 * len(embedding) AS INTEGER) AS bytes,
          CAST(len(embedding) AS INTEGER) AS dimensions,
          round(CAST(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS FLOAT)::DOUBLE, 4) AS norm,
          embedding[-1]::DOUBLE AS last FROM embeddings""",
    "vector_cosine": """SELECT v.vec_id AS event_id,
          round(CAST(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS FLOAT)::DOUBLE, 4) AS cosine
        FROM embeddings v, embeddings q WHERE q.vec_id = 7""",
    "embed_pending": f"""WITH {DOCS}, {embedded('body', 'docs')} SELECT event_id, {CONTENT}, 1.0::DOUBLE AS norm FROM emb
        WHERE event_id NOT IN (SELECT doc_id FROM labels)""",
    "events_semantic_text": f"""WITH {DOCS}, {embedded('body', 'docs')},
        q AS (SELECT embedding FROM (WITH ask AS (SELECT 0 AS event_id), {embedded("'error in the system log'", 'ask')} SELECT * FROM emb))
        SELECT d.event_id, make_timestamp(d.event_id * 1000000) AS ts, 6 AS priority, d.unit, d.lang AS source, 0 AS pid, d.text AS message
        FROM emb v JOIN docs d USING (event_id), q ORDER BY CAST({COSINE} AS FLOAT) DESC, d.event_id LIMIT 10""",
    "columns_bands": f"""WITH {SM} SELECT ts, {RFC3339} AS at, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS anchor,
          {MEM_PCT} AS mem_pct, {BAND} AS cpu_band,
          CAST(trunc(greatest(least(cpu_pct, 100), 0) / 100 * 8) AS INTEGER) AS level,
          {human('mem_used')} AS mem_text, {human('disk_read')} AS disk_text, {human('net_tx')} AS net_text FROM sm""",
    "columns_events": """SELECT event_id, CASE event_type WHEN 'error' THEN 'bad' WHEN 'signup' THEN 'warn'
            WHEN 'purchase' THEN 'notice' WHEN 'view' THEN 'info' ELSE 'debug' END AS class,
          CASE WHEN event_type = 'view' THEN props ELSE event_type || ': ' || props END AS text FROM events""",
    "stream_journal": PARSED.replace("SELECT event_id, ts", "SELECT ts"),
    "stream_journal_followed": PARSED.replace("SELECT event_id, ts", "SELECT ts"),
    "stream_journal_flushed": """WITH placed AS (SELECT *, user_id % 16 AS machine,
              (row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) - 1) // 200 AS flush FROM events)
        SELECT ts, CAST(machine AS INTEGER) AS host, event_type AS unit, CAST(user_id AS INTEGER) AS pid, props AS message,
          count(*) OVER (PARTITION BY machine, flush) AS flushed
        FROM placed WHERE NOT (event_type = 'signup' AND value < 10)""",
    "stream_samples_bounded": f"""WITH {REFRESHES},
        sent AS (SELECT *, least(batch + CASE WHEN event_id % 13 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END, 3) AS part
                 FROM src),
        -- a refresh drops what lies behind the mark that its predecessor went by
        marks AS (SELECT part + 2 AS part, max(max(date_trunc('millisecond', ts))) OVER (ORDER BY part) - INTERVAL 5 DAY AS mark
                  FROM sent GROUP BY part)
        SELECT event_type AS host, ts, value AS cpu_pct, user_id AS mem_used FROM sent LEFT JOIN marks USING (part)
        WHERE mark IS NULL OR ts > mark""",
    "stream_samples": """SELECT date_trunc('hour', ts) AS ts, value AS cpu_pct, user_id AS mem_used FROM events
        QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) = 1""",
    "stream_processes": """SELECT date_trunc('hour', ts) AS ts, CAST(event_id AS INTEGER) AS pid, event_type AS name,
          value AS cpu_pct, user_id AS mem_rss FROM events
        QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY value DESC, event_id) <= 10""",
    "stream_readings": """SELECT date_trunc('hour', ts) AS ts,
          coalesce(max(value) FILTER (event_type = 'purchase'), 0) AS cpu_pct,
          coalesce(max(user_id) FILTER (event_type = 'purchase'), 0) AS mem_used,
          CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 500000000 ELSE 0 END::BIGINT AS mem_total,
          CAST(coalesce(sum(event_id) FILTER (event_type NOT IN ('purchase', 'view')), 0) AS BIGINT) AS disk_read,
          CAST(coalesce(sum(user_id) FILTER (event_type NOT IN ('purchase', 'view')), 0) AS BIGINT) AS disk_write,
          CAST(coalesce(sum(event_id) FILTER (event_type = 'view'), 0) AS BIGINT) AS net_rx,
          CAST(coalesce(sum(user_id) FILTER (event_type = 'view'), 0) AS BIGINT) AS net_tx
        FROM events GROUP BY 1""",
    "stored_events_search": f"""WITH {EV} SELECT {SHOWN} FROM ev
        WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY
          AND (contains(lower(message), '"k": 4') OR contains(lower(unit), '"k": 4'))
        ORDER BY ts DESC, event_id LIMIT 50""",
    "stream_embed": f"WITH {DOCS}, {embedded('body', 'docs')} SELECT event_id, {CONTENT} FROM emb",
    "stream_live": f"""WITH {REFRESHES},
        newest AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY event_type, batch ORDER BY ts DESC) = 1),
        shown AS (SELECT * FROM newest QUALIFY coalesce(ts > max(ts) OVER (PARTITION BY event_type ORDER BY batch
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)),
        before AS (SELECT *, lag(event_id * 7) OVER w AS was, date_diff('microsecond', lag(ts) OVER w, ts) / 1e6 AS sec,
            row_number() OVER w AS n FROM shown WINDOW w AS (PARTITION BY event_type ORDER BY batch))
        SELECT event_type AS host, ts, value AS cpu_pct, user_id AS mem_used, event_id * 7 AS disk_read,
          CASE WHEN sec > 0 AND event_id * 7 > was THEN CAST(trunc((event_id * 7 - was) / sec) AS BIGINT) ELSE 0 END AS disk_read_rate,
          CAST(n AS INTEGER) AS n FROM before""",
}


def _live_processes(unit: str) -> str:
    """What is shown of each host's newest tick after every refresh that changes it."""
    return f"""WITH {REFRESHES},
        tick AS (SELECT *, date_trunc('{unit}', ts) AS tick FROM src),
        newest AS (SELECT event_type, batch, max(tick) AS tick FROM tick GROUP BY ALL),
        opened AS (SELECT * FROM newest QUALIFY coalesce(tick >= max(tick) OVER (PARTITION BY event_type ORDER BY batch
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)),
        tops AS (SELECT o.event_type, o.batch, o.tick, t.event_id, t.value, t.user_id,
              row_number() OVER (PARTITION BY o.event_type, o.batch, o.tick ORDER BY t.value DESC, t.event_id) AS place
            FROM opened o JOIN opened p ON p.event_type = o.event_type AND p.tick = o.tick AND p.batch <= o.batch
            JOIN tick t ON t.event_type = p.event_type AND t.batch = p.batch AND t.tick = p.tick QUALIFY place <= 5),
        lists AS (SELECT event_type, batch, tick, list(event_id ORDER BY place) AS ids FROM tops GROUP BY ALL),
        changed AS (SELECT *, row_number() OVER (PARTITION BY event_type, tick ORDER BY batch) - 1 AS revision FROM (
            SELECT *, lag(ids) OVER (PARTITION BY event_type, tick ORDER BY batch) AS before FROM lists)
            WHERE before IS NULL OR ids <> before)
        SELECT event_type AS host, CAST(tick AS TIMESTAMP) AS ts, CAST(event_id AS INTEGER) AS pid, value AS cpu_pct,
          user_id AS mem_rss, CAST(revision AS INTEGER) AS revision
        FROM tops JOIN changed USING (event_type, batch, tick)"""


SQL["stream_live_processes"] = _live_processes("hour")
SQL["stream_live_processes_cut"] = _live_processes("day")
SQL["stored_events_latest"] = SQL["events_latest"].replace("LIMIT 20", "LIMIT 200")
SQL["stored_sample_at_fleet"] = SQL["system_sample_at_fleet"]
SQL["stored_top_mem"] = SQL["system_top_mem"]
