"""SQL over the same tables, written from the definitions and without text parsing.

The inputs of ``adapters`` are rebuilt as typed values, so that nothing here
depends on how the library reads text.
"""

from __future__ import annotations

from checks.adapters import BOUND, HEADER, MESS

_KINDS = " ".join(f"WHEN event_id % {d} = 0 THEN '{name}'" for d, name in MESS)

# One row per derived trip line, with what is wrong with it.
_LINES = f"""
WITH marked AS (
  SELECT event_id, user_id, value, date_trunc('second', ts) AS pickup,
         CASE {_KINDS} ELSE 'none' END AS mess
  FROM events
),
lines AS (
  SELECT *, pickup + to_minutes(CAST(event_id % 60 AS INTEGER)) AS dropoff
  FROM marked
),
trips AS (
  SELECT event_id,
         CAST(user_id % 2 + 1 AS INTEGER) AS vendor_id,
         CASE WHEN mess = 'blank_pickup' THEN TIMESTAMP '1970-01-01 00:00:00' ELSE pickup END
           AS pickup_ts,
         dropoff AS dropoff_ts,
         CAST(CASE WHEN mess = 'blank_passenger' THEN 0 ELSE event_id % 6 END AS INTEGER)
           AS passenger_count,
         CAST(user_id % 263 + 1 AS INTEGER) AS pu_location_id,
         CAST(event_id % 263 + 1 AS INTEGER) AS do_location_id,
         CASE WHEN mess = 'null_total' THEN 0.0 ELSE value END AS total_amount
  FROM lines
  WHERE mess NOT IN ('short', 'blank_line', 'quoted_pickup', 'bad_dropoff')
),
readable AS (
  SELECT event_id, pickup,
         CASE WHEN mess <> 'bad_dropoff' THEN dropoff END AS dropoff, mess
  FROM lines
  WHERE mess NOT IN ('blank_pickup', 'blank_line')
),
texts AS (
  SELECT event_id, pickup, mess,
         strftime(pickup, '%Y-%m-%d %H:%M:%S') AS pickup_text,
         CASE WHEN mess = 'bad_dropoff' THEN 'bad'
              ELSE strftime(dropoff, '%Y-%m-%d %H:%M:%S') END AS dropoff_text,
         CASE WHEN mess = 'blank_passenger' THEN ''
              ELSE CAST(event_id % 6 AS VARCHAR) END AS passenger_text,
         CASE WHEN mess = 'null_total' THEN 'null' ELSE CAST(value AS VARCHAR) END AS total_text,
         user_id
  FROM lines
),
raw AS (
  SELECT event_id, mess,
         CASE WHEN mess = 'blank_line' THEN '  ' ELSE
           concat_ws(',', CAST(user_id % 2 + 1 AS VARCHAR),
             CASE mess WHEN 'blank_pickup' THEN ''
                       WHEN 'fraction' THEN pickup_text || '.000'
                       WHEN 'quoted_pickup' THEN '"' || pickup_text || '"'
                       ELSE pickup_text END,
             dropoff_text, passenger_text, '1.5,1.0, N ',
             CAST(user_id % 263 + 1 AS VARCHAR), CAST(event_id % 263 + 1 AS VARCHAR),
             '2,10.0,0.5,0.5,-1.25,null,1.0', total_text, '2.5')
           || CASE WHEN mess = 'short' THEN '' ELSE ',0.0' END
         END AS value
  FROM texts
)
"""

_HOURLY = """
SELECT pu_location_id, date_trunc('hour', pickup_ts) AS window_start,
       date_trunc('hour', pickup_ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS trip_count,
       CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_income
FROM trips GROUP BY ALL
"""


def _ticks(rate_s: int) -> str:
    micros = rate_s * 1_000_000
    return f"""{_LINES},
sent AS (
  SELECT greatest(epoch_us(pickup) - min(epoch_us(pickup)) OVER () - 1, 0) // {micros} AS tick
  FROM readable
),
steps AS (SELECT unnest(generate_series(0, (SELECT max(tick) FROM sent))) AS tick),
origin AS (SELECT min(pickup) AS first FROM readable)
SELECT tick, first + to_seconds(tick * {rate_s}) AS sim_start,
       first + to_seconds((tick + 1) * {rate_s}) AS sim_end,
       count(sent.tick) AS lines_sent
FROM steps LEFT JOIN sent USING (tick), origin GROUP BY tick, first
"""


_STATUS = """
WITH samples AS (
  SELECT user_id % 3 AS run_id, ts, event_id AS seq,
         CASE event_type WHEN 'error' THEN 'RESTARTING' WHEN 'signup' THEN 'FAILED'
                         WHEN 'view' THEN NULL ELSE 'RUNNING' END AS status
  FROM events
)
"""

_EPISODES = f"""{_STATUS},
ends AS (
  SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY ts, seq) AS earlier
  FROM samples WHERE status IN ('RESTARTING', 'RUNNING')
),
edges AS (
  SELECT *, lag(ts) OVER w AS started_at, lag(seq) OVER w AS started_seq
  FROM ends
  WHERE (status = 'RESTARTING' AND earlier IS DISTINCT FROM 'RESTARTING')
     OR (status = 'RUNNING' AND earlier = 'RESTARTING')
  WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)
),
episodes AS (
  SELECT run_id, started_at, started_seq, ts AS ended_at, seq AS ended_seq,
         epoch_us(ts) - epoch_us(started_at) AS duration_us,
         CAST(CASE run_id WHEN 0 THEN 5 WHEN 1 THEN 30 ELSE 300 END AS INTEGER) AS interval_s
  FROM edges WHERE status = 'RUNNING'
),
metrics AS (
  SELECT user_id % 3 AS run_id, ts, event_id AS seq,
         CAST(CASE user_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 30 ELSE 300 END AS INTEGER)
           AS interval_s,
         CAST(user_id AS DOUBLE) AS latency, value AS throughput,
         CASE WHEN event_type <> 'signup' THEN event_id // 10 END AS checkpoint_id,
         CASE WHEN event_type <> 'signup' THEN event_id // 10 % 1500 END
           AS checkpoint_duration_ms,
         event_type
  FROM events
),
once AS (
  SELECT DISTINCT run_id, interval_s, checkpoint_id, checkpoint_duration_ms
  FROM metrics WHERE checkpoint_id IS NOT NULL
),
durations AS (
  SELECT interval_s, count(*) AS checkpoints, avg(checkpoint_duration_ms) AS avg_checkpoint_ms,
         stddev_samp(checkpoint_duration_ms) AS stddev_checkpoint_ms
  FROM once GROUP BY interval_s
),
restarts AS (
  SELECT interval_s, count(*) AS restarts, sum(duration_us) / count(*) / 1e6 - 60.0
           AS avg_restart_s
  FROM episodes GROUP BY interval_s
),
costs AS (
  SELECT interval_s, avg_checkpoint_ms / 1000.0 AS checkpoint_s, avg_restart_s AS recovery_s
  FROM durations JOIN restarts USING (interval_s)
),
used AS (
  SELECT *, (1.0 / 600.0) * (interval_s - checkpoint_s)
           / (exp(recovery_s / 600.0) * (exp(interval_s / 600.0) - 1)) AS utilization
  FROM costs
)
"""

# Windows that the stream closes.
_CLOSED = f"""{_LINES}, hourly AS ({_HOURLY}), closed AS (
  SELECT * FROM hourly
  WHERE window_end <= (SELECT max(pickup_ts) - INTERVAL 1 MINUTE FROM trips)
)
"""

_MEDIANS = f"""{_LINES}
SELECT pu_location_id, date_trunc('hour', pickup_ts) AS window_start,
       date_trunc('hour', pickup_ts) + INTERVAL 1 HOUR AS window_end, count(*) AS trip_count,
       list_sort(list(total_amount))[(count(*) + 1) // 2] AS low_median,
       list_sort(list(total_amount))[(count(*) + 2) // 2] AS high_median
FROM trips GROUP BY ALL
"""

_LOG = """
WITH log AS (
  SELECT event_id AS seq, ts AS "timestamp", CAST(user_id AS DOUBLE) AS "Latency",
         value AS "Throughput",
         CASE WHEN event_type <> 'signup' THEN event_id // 10 END AS "CheckpointID",
         CASE WHEN event_type <> 'signup' THEN 'COMPLETED' END AS "CheckpointStatus",
         CASE WHEN event_type <> 'signup' THEN event_id // 10 % 1500 END
           AS "CheckpointDurationMs",
         CASE WHEN event_type <> 'view' THEN event_type END AS "JobStatus"
  FROM events
)
"""

ORACLE_SQL: dict[str, str] = {
    "q_peek_lines": f"{_LINES} SELECT event_id, value FROM raw ORDER BY event_id LIMIT 10",
    "q_read_lines": f"{_LINES} SELECT value FROM raw WHERE mess <> 'blank_line'",
    "q_lenient_int": """
SELECT event_id, CAST(CASE event_id % 9
    WHEN 0 THEN floor(value + 0.5) WHEN 1 THEN floor(value + 0.5)
    WHEN 5 THEN floor(-value + 0.5) WHEN 6 THEN event_id + 1
    WHEN 8 THEN floor(CAST(CAST(value AS DECIMAL(18,2)) * 10 AS DOUBLE) + 0.5)
    ELSE 0 END AS INTEGER) AS number
FROM events""",
    "q_lenient_double": """
SELECT event_id, CAST(CASE event_id % 9
    WHEN 0 THEN value WHEN 1 THEN value WHEN 5 THEN -value WHEN 6 THEN event_id + 0.5
    WHEN 8 THEN CAST(CAST(value AS DECIMAL(18,2)) * 10 AS DOUBLE)
    ELSE 0 END AS DOUBLE) AS number
FROM events""",
    "q_time_fields": """
WITH t AS (SELECT event_id, event_id % 7 AS k, date_trunc('second', ts) AS s FROM events)
SELECT event_id,
       CASE WHEN k IN (0, 1, 5) THEN s WHEN k = 3 THEN TIMESTAMP '1970-01-01 00:00:00'
            WHEN k = 6 AND strftime(s, '%m') >= '10' AND strftime(s, '%d') >= '10'
             AND strftime(s, '%H') >= '10' AND strftime(s, '%M') >= '10'
             AND strftime(s, '%S') >= '10' THEN s END AS strict,
       CASE WHEN k IN (0, 1, 5, 6) THEN s END AS from_column,
       CASE WHEN k IN (0, 1, 2, 5, 6) THEN s END AS from_raw_line
FROM t""",
    "q_parse_trips": f"""{_LINES}
SELECT event_id, vendor_id, pickup_ts, dropoff_ts, passenger_count,
       CAST(1.5 AS DOUBLE) AS trip_distance, 1 AS ratecode_id, 'N' AS store_and_fwd_flag,
       pu_location_id, do_location_id, 2 AS payment_type, CAST(10 AS DOUBLE) AS fare_amount,
       CAST(0.5 AS DOUBLE) AS extra, CAST(0.5 AS DOUBLE) AS mta_tax,
       CAST(-1.25 AS DOUBLE) AS tip_amount, CAST(0 AS DOUBLE) AS tolls_amount,
       CAST(1 AS DOUBLE) AS improvement_surcharge, total_amount,
       CAST(2.5 AS DOUBLE) AS congestion_surcharge, CAST(0 AS DOUBLE) AS airport_fee
FROM trips""",
    "q_bad_lines": f"""{_LINES}
SELECT event_id, value, CASE mess WHEN 'blank_line' THEN 'empty' WHEN 'short' THEN 'short'
       WHEN 'quoted_pickup' THEN 'pickup' ELSE 'dropoff' END AS bad_reason
FROM raw WHERE mess IN ('blank_line', 'short', 'quoted_pickup', 'bad_dropoff')""",
    "q_prep_sorted": f"""{_LINES}
SELECT event_id, pickup, dropoff,
       row_number() OVER (ORDER BY dropoff NULLS FIRST, event_id) AS sort_rank
FROM readable WHERE pickup >= TIMESTAMP '{BOUND}'""",
    "q_shifted_columns": f"""{_LINES}
SELECT event_id, pickup, dropoff,
       row_number() OVER (ORDER BY dropoff NULLS FIRST, event_id) AS sort_rank
FROM readable WHERE pickup >= TIMESTAMP '{BOUND}'""",
    "q_prep_stats": f"""{_LINES}
SELECT count(*) AS rows_read,
       count(*) FILTER (mess = 'blank_line') AS rows_short,
       count(*) FILTER (mess <> 'blank_line'
         AND (mess = 'blank_pickup' OR pickup < TIMESTAMP '{BOUND}')) AS rows_too_early,
       count(*) FILTER (mess NOT IN ('blank_line', 'blank_pickup')
         AND pickup >= TIMESTAMP '{BOUND}') AS rows_kept
FROM lines""",
    "q_sorted_csv": f"""{_LINES}
SELECT pickup_text || CASE WHEN mess = 'fraction' THEN '.000' ELSE '' END
         AS tpep_pickup_datetime,
       dropoff_text AS tpep_dropoff_datetime,
       nullif(passenger_text, '') AS passenger_count,
       CAST(user_id % 263 + 1 AS VARCHAR) AS "PULocationID",
       total_text AS total_amount,
       CASE WHEN mess <> 'short' THEN '0.0' END AS airport_fee
FROM texts
WHERE mess NOT IN ('blank_line', 'blank_pickup') AND pickup >= TIMESTAMP '{BOUND}'""",
    "q_sorted_lines": f"""{_LINES}
SELECT 1 + row_number() OVER (ORDER BY dropoff NULLS FIRST, event_id) AS line_no, raw.value
FROM readable JOIN raw USING (event_id) WHERE pickup >= TIMESTAMP '{BOUND}'
UNION ALL SELECT 1, '{",".join(HEADER)}'""",
    "q_lines_by_place": f"""{_LINES}
SELECT CASE WHEN event_id % 500 = 3 THEN '{",".join(HEADER)}' ELSE value END AS value
FROM raw WHERE mess <> 'blank_line' OR event_id % 500 = 3""",
    "q_replay_ticks": _ticks(7200),
    "q_replay_ticks_fine": _ticks(60),
    "q_replay_order": f"""{_LINES}
SELECT event_id, pickup,
       greatest(epoch_us(pickup) - min(epoch_us(pickup)) OVER () - 1, 0) // 7200000000 AS tick,
       row_number() OVER (ORDER BY pickup, event_id) AS send_rank
FROM readable""",
    "q_hourly_income": _LINES + _HOURLY,
    "q_hourly_lines": f"""{_LINES}, hourly AS ({_HOURLY})
SELECT format('PULocationID={{}}, WindowStart={{}}, WindowEnd={{}}, TripCount={{}}, '
              || 'TotalIncome={{:.2f}}', pu_location_id,
              strftime(window_start, '%Y-%m-%d %H:%M:%S'),
              strftime(window_end, '%Y-%m-%d %H:%M:%S'), trip_count, total_income) AS value
FROM hourly""",
    "q_window_apply": _LINES + _HOURLY,
    "q_window_rows": _MEDIANS,
    "q_window_medians": _MEDIANS,
    "q_stream_sources": f"""{_LINES}, hourly AS ({_HOURLY}), seen AS (
  SELECT max(pickup_ts) - INTERVAL 1 MINUTE AS till FROM trips GROUP BY event_id % 3 = 0
)
SELECT * FROM hourly WHERE window_end <= (SELECT min(till) FROM seen)""",
    "q_open_windows": f"""{_LINES}, hourly AS ({_HOURLY})
SELECT *, window_end > (SELECT max(pickup_ts) - INTERVAL 1 MINUTE FROM trips) AS is_open FROM hourly""",
    "q_late_rows": f"""{_LINES}
SELECT pu_location_id, do_location_id, pickup_ts, total_amount,
       event_id % 2 = 1 AND date_trunc('hour', pickup_ts) + INTERVAL 1 HOUR <= (
         SELECT max(pickup_ts) - INTERVAL 1 MINUTE FROM trips WHERE event_id % 2 = 0) AS late
FROM trips""",
    "q_stream_interval": f"""{_CLOSED}
SELECT CAST(interval_ms AS INTEGER) AS interval_ms, closed.*, CAST(3 AS BIGINT) AS commits
FROM closed, (VALUES (100), (400)) AS i(interval_ms)""",
    "q_stream_hourly": f"{_CLOSED} SELECT * FROM closed",
    "q_stream_restart": f"{_CLOSED} SELECT * FROM closed",
    "q_stream_fold": f"{_CLOSED} SELECT * FROM closed",
    "q_stream_lines": f"""{_CLOSED}
SELECT format('PULocationID={{}}, WindowStart={{}}, WindowEnd={{}}, TripCount={{}}, '
              || 'TotalIncome={{:.2f}}', pu_location_id,
              strftime(window_start, '%Y-%m-%d %H:%M:%S'),
              strftime(window_end, '%Y-%m-%d %H:%M:%S'), trip_count, total_income) AS value
FROM closed""",
    "q_stream_rolled": f"""{_CLOSED}
SELECT format('PULocationID={{}}, WindowStart={{}}, WindowEnd={{}}, TripCount={{}}, '
              || 'TotalIncome={{:.2f}}', pu_location_id,
              strftime(window_start, '%Y-%m-%d %H:%M:%S'),
              strftime(window_end, '%Y-%m-%d %H:%M:%S'), trip_count, total_income) AS value, TRUE AS fits
FROM closed""",
    "q_stream_observed": f"""{_LINES}
SELECT CAST(3 AS BIGINT) AS batches, (SELECT count(*) FROM lines) AS lines,
       (SELECT count(*) FROM lines) - count(*) AS bad_lines, max(pickup_ts) AS latest_pickup,
       round(CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE), 2) AS total_amount
FROM trips""",
    "q_stream_divert": f"""{_LINES}
SELECT pu_location_id, pickup_ts, dropoff_ts, total_amount,
       CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS bad_reason FROM trips
UNION ALL
SELECT NULL, NULL, NULL, NULL, value,
       CASE mess WHEN 'blank_line' THEN 'empty' WHEN 'short' THEN 'short'
                 WHEN 'quoted_pickup' THEN 'pickup' ELSE 'dropoff' END
FROM raw WHERE mess IN ('blank_line', 'short', 'quoted_pickup', 'bad_dropoff')""",
    "q_metrics_render": f"""{_LOG}
SELECT seq, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS "timestamp",
       CAST("Latency" AS VARCHAR) AS "Latency", CAST("Throughput" AS VARCHAR) AS "Throughput",
       coalesce(CAST("CheckpointID" AS VARCHAR), 'N/A') AS "CheckpointID",
       coalesce("CheckpointStatus", 'N/A') AS "CheckpointStatus",
       coalesce(CAST("CheckpointDurationMs" AS VARCHAR), 'N/A') AS "CheckpointDurationMs",
       coalesce("JobStatus", 'N/A') AS "JobStatus"
FROM log""",
    "q_status_render": f"""{_STATUS}
SELECT seq, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS record_timestamp,
       coalesce(status, 'N/A (API Failed)') AS job_status
FROM samples""",
    "q_run_log": f"{_LOG} SELECT * EXCLUDE (seq) FROM log UNION ALL SELECT * EXCLUDE (seq) FROM log",
    "q_compacted_log": f"{_LOG} SELECT * EXCLUDE (seq) FROM log",
    "q_metric_pick": """
WITH hits AS (
  SELECT event_id // 8 AS poll_id,
         arg_min(value, event_id) FILTER (event_type IN ('view', 'purchase')) AS latency,
         arg_min(value, event_id) FILTER (event_type = 'click') AS throughput
  FROM events GROUP BY 1
)
SELECT poll_id, CASE WHEN throughput IS NOT NULL THEN latency END AS latency,
       CASE WHEN latency IS NOT NULL THEN throughput END AS throughput
FROM hits""",
    "q_checkpoint_rows": """
SELECT event_id, CASE WHEN event_id % 5 < 4 THEN event_id + 1 END AS checkpoint_id,
       CASE event_id % 5 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'FAILED' END
         AS checkpoint_status,
       CASE WHEN event_id % 5 < 3 THEN event_id % 1500 WHEN event_id % 5 = 3 THEN 44 END
         AS checkpoint_duration_ms
FROM events""",
    "q_progress_metrics": """
SELECT event_id, 'run-' || (user_id % 3) AS stream_run_id,
       date_trunc('millisecond', ts) AS "timestamp",
       CAST(event_id % 900 AS DOUBLE) AS "Latency", value AS "Throughput",
       event_id AS "CheckpointID", 'COMPLETED' AS "CheckpointStatus",
       event_id % 40 + event_id % 30 AS "CheckpointDurationMs", 'RUNNING' AS "JobStatus",
       CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 3 + 1 END AS late_rows,
       CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 11 + 5 END AS state_commit_ms
FROM events""",
    "q_latest_checkpoint": f"""{_EPISODES}, marked AS (
  SELECT run_id, ts, seq, event_type <> 'purchase' AS is_poll,
         last_value(CASE WHEN event_type = 'purchase' THEN checkpoint_id END IGNORE NULLS)
           OVER w AS checkpoint_id,
         last_value(CASE WHEN event_type = 'purchase' THEN checkpoint_duration_ms END IGNORE NULLS)
           OVER w AS checkpoint_duration_ms
  FROM metrics
  WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_type <> 'purchase', seq
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT run_id, ts, seq, checkpoint_id, checkpoint_duration_ms FROM marked WHERE is_poll""",
    "q_status_changes": f"""{_STATUS}, known AS (
  SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY ts, seq) AS previous_status
  FROM samples WHERE status IS NOT NULL
)
SELECT run_id, ts, seq, status, previous_status FROM known
WHERE status IS DISTINCT FROM previous_status""",
    "q_restart_episodes": f"{_EPISODES} SELECT * EXCLUDE (interval_s) FROM episodes",
    "q_restart_log": f"""{_EPISODES}
SELECT run_id, ended_at AS record_timestamp,
       round(duration_us / 1e6 - 60.0, 6) AS duration_minus_60s_seconds FROM episodes""",
    "q_recorded_report": f"""{_EPISODES},
figures AS (
  SELECT interval_s, round(avg(throughput), 6) AS avg_throughput,
         max(throughput) AS peak_throughput, round(avg(latency), 6) AS avg_latency,
         max(latency) - min(latency) AS latency_spread
  FROM metrics GROUP BY interval_s
),
steady AS (
  SELECT interval_s, round(avg(throughput), 6) AS steady_throughput FROM metrics m
  WHERE NOT EXISTS (SELECT 1 FROM episodes e WHERE e.run_id = m.run_id
                    AND m.ts >= e.started_at AND m.ts < e.ended_at)
  GROUP BY interval_s
)
SELECT interval_s, avg_throughput, peak_throughput, avg_latency, latency_spread, checkpoints,
       round(avg_checkpoint_ms, 6) AS avg_checkpoint_ms,
       round(stddev_checkpoint_ms, 6) AS stddev_checkpoint_ms, steady_throughput,
       restarts, round(avg_restart_s, 6) AS avg_restart_s, round(utilization, 6) AS utilization
FROM figures JOIN durations USING (interval_s) LEFT JOIN steady USING (interval_s)
LEFT JOIN restarts USING (interval_s) LEFT JOIN used USING (interval_s)""",
    "q_steady_state_avg": f"""{_EPISODES}
SELECT interval_s, count(*) AS samples, round(avg(throughput), 6) AS avg_throughput,
       round(avg(latency), 6) AS avg_latency
FROM metrics m
WHERE NOT EXISTS (SELECT 1 FROM episodes e WHERE e.run_id = m.run_id
                  AND m.ts >= e.started_at AND m.ts < e.ended_at)
GROUP BY interval_s""",
    "q_metrics_by_interval": f"""{_EPISODES},
figures AS (
  SELECT interval_s, round(avg(throughput), 6) AS avg_throughput,
         max(throughput) AS peak_throughput, round(avg(latency), 6) AS avg_latency,
         max(latency) - min(latency) AS latency_spread
  FROM metrics GROUP BY interval_s
)
SELECT interval_s, avg_throughput, peak_throughput, avg_latency, latency_spread, checkpoints,
       round(avg_checkpoint_ms, 6) AS avg_checkpoint_ms,
       round(stddev_checkpoint_ms, 6) AS stddev_checkpoint_ms
FROM figures JOIN durations USING (interval_s)""",
    "q_restart_by_interval": f"""{_EPISODES}
SELECT interval_s, restarts, round(avg_restart_s, 6) AS avg_restart_s FROM restarts""",
    "q_utilization": f"""{_EPISODES}
SELECT interval_s, round(checkpoint_s, 9) AS checkpoint_s, round(recovery_s, 9) AS recovery_s,
       round(utilization, 9) AS utilization FROM used""",
    "q_best_interval": f"""{_EPISODES}
SELECT interval_s, round(utilization, 9) AS utilization FROM used
ORDER BY used.utilization DESC, interval_s LIMIT 1""",
    "q_best_interval_exact": f"""{_EPISODES.replace("WITH", "WITH RECURSIVE", 1)},
halved AS (
  SELECT interval_s, checkpoint_s, recovery_s, 0 AS i, 0.0::DOUBLE AS low, 8.0::DOUBLE AS high FROM costs
  UNION ALL
  SELECT interval_s, checkpoint_s, recovery_s, i + 1,
    CASE WHEN (low + high) / 2 - checkpoint_s / 600.0 < 1 - exp(-(low + high) / 2) THEN (low + high) / 2 ELSE low END,
    CASE WHEN (low + high) / 2 - checkpoint_s / 600.0 < 1 - exp(-(low + high) / 2) THEN high ELSE (low + high) / 2 END
  FROM halved WHERE i < 60
),
best AS (SELECT *, 600.0 * low AS t FROM halved WHERE i = 60)
SELECT interval_s, round(t, 6) AS best_interval_s,
  round((1.0 / 600.0) * (t - checkpoint_s) / (exp(recovery_s / 600.0) * (exp(t / 600.0) - 1)), 9) AS best_utilization
FROM best""",
}
