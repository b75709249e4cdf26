"""DuckDB SQL equivalent to the registered queries, on the same tables."""

from alarmloom.registry import fixtures as fx

RAW = """
raw AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'FP' ELSE 'TP' END AS label,
         CASE WHEN user_id % 4 = 0 THEN 'training' ELSE 'inference' END AS phase,
         'flow_' || CAST(user_id AS VARCHAR) AS case_id,
         event_id, ts,
         CASE WHEN event_type IN ('signup', 'view', 'click') THEN 'C_to_S' ELSE 'S_to_C' END AS direction,
         CASE WHEN event_type = 'signup' THEN 'SYN'
              WHEN event_type = 'view' THEN 'ACK'
              WHEN event_type = 'click' THEN 'ACK+PSH'
              WHEN event_type = 'purchase' THEN 'SYN+ACK'
              WHEN user_id % 2 = 1 AND g = 0 THEN 'RST'
              ELSE 'ACK+FIN' END AS tcp_flag,
         CAST(floor(value) AS BIGINT) AS payload_size,
         CASE WHEN event_type IN ('signup', 'view', 'click') THEN client_ip ELSE server_ip END AS src_ip,
         CASE WHEN event_type IN ('signup', 'view', 'click') THEN server_ip ELSE client_ip END AS dst_ip,
         CASE WHEN event_type IN ('signup', 'view', 'click') THEN client_port ELSE server_port END AS src_port,
         CASE WHEN event_type IN ('signup', 'view', 'click') THEN server_port ELSE client_port END AS dst_port,
         client_ip
  FROM (
    SELECT *, (user_id // 2) % 5 AS g,
           '10.0.0.' || CAST(user_id AS VARCHAR) AS client_ip,
           '192.168.0.' || CAST(k % 7 AS VARCHAR) AS server_ip,
           40000 + k AS client_port,
           CASE WHEN k % 5 <> 0 THEN 443 ELSE 8080 END AS server_port
    FROM (
      SELECT user_id, event_id, ts, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
             CASE WHEN user_id % 2 = 0 OR (user_id // 2) % 5 = 3 THEN
                    CASE WHEN event_type IN ('view', 'click') OR event_id % 8 = 0 THEN event_type
                         WHEN event_id % 2 = 0 THEN 'view' ELSE 'click' END
                  WHEN (user_id // 2) % 5 = 0 THEN 'error'
                  WHEN (user_id // 2) % 5 = 1 THEN
                    CASE WHEN event_type IN ('signup', 'purchase') THEN event_type
                         WHEN event_id % 2 = 0 THEN 'signup' ELSE 'purchase' END
                  WHEN (user_id // 2) % 5 = 2 THEN event_type
                  WHEN event_type IN ('error', 'purchase') OR (event_type = 'view' AND event_id % 2 = 0) THEN event_type
                  WHEN event_id % 2 = 0 THEN 'error' ELSE 'purchase' END AS event_type
      FROM events
    )
  )
)"""

PACKETS = f"""{RAW},
packets AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS packet_no FROM raw
),
placed AS (
  SELECT *, (packet_no - 1) // 3 AS window_no,
         first(src_ip) OVER (PARTITION BY case_id ORDER BY packet_no) AS first_sender
  FROM packets
),
windows AS (
  SELECT label, phase, case_id, window_no, avg(payload_size) AS avg_payload,
         len(list_distinct(list(src_ip) || list(dst_ip)))
           - CAST(list_contains(list(src_ip) || list(dst_ip), min(first_sender)) AS BIGINT) AS n_servers,
         len(list_distinct(list(src_port) || list(dst_port)))
           - CAST(list_contains(list(src_port) || list(dst_port), 443) AS BIGINT) AS n_user_ports,
         count(*) FILTER (contains(tcp_flag, 'ACK')) AS n_ack,
         count(*) FILTER (contains(tcp_flag, 'SYN')) AS n_syn,
         count(*) FILTER (contains(tcp_flag, 'FIN')) AS n_fin,
         count(*) FILTER (contains(tcp_flag, 'PSH')) AS n_psh,
         count(*) FILTER (contains(tcp_flag, 'RST')) AS n_rst
  FROM placed GROUP BY ALL HAVING count(*) = 3
)"""

EVENTS = f"""{PACKETS},
log AS (
  SELECT p.label, p.phase, p.case_id, p.window_no, p.packet_no, p.ts, p.payload_size,
         p.direction || '_' || p.tcp_flag AS activity,
         CASE WHEN w.avg_payload >= 50 THEN 'STATE_1' ELSE 'STATE_0' END AS state
  FROM placed p JOIN windows w USING (case_id, window_no)
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY state, case_id ORDER BY packet_no) AS event_no FROM log
),
counts AS (
  SELECT label, phase, state, case_id, activity, count(*) AS n FROM log GROUP BY ALL
),
profile AS (
  SELECT state, activity, floor(sum(n) / count(*)) AS value FROM counts WHERE phase = 'training' GROUP BY ALL
)"""

# Cosine of `vec(label, state, case_id, activity, value)` with `prof(state, activity, value)`.
COSINE = """
norms AS (SELECT state, sqrt(sum(value * value)) AS norm FROM prof GROUP BY state),
sims AS (
  SELECT v.label, v.case_id, v.state,
         coalesce(sum(v.value * coalesce(p.value, 0)) / nullif(sqrt(sum(v.value * v.value)) * max(n.norm), 0), 0)
           AS similarity
  FROM vec v JOIN norms n USING (state) LEFT JOIN prof p USING (state, activity)
  GROUP BY ALL
)"""

BANDED = f"""{EVENTS},
prof AS (SELECT * FROM profile),
vec AS (SELECT label, state, case_id, activity, CAST(n AS DOUBLE) AS value FROM counts WHERE phase = 'inference'),
{COSINE},
means AS (SELECT label, case_id, avg(similarity) AS mean_similarity FROM sims GROUP BY ALL),
banded AS (
  SELECT *, CASE WHEN mean_similarity <= 0.01 THEN 'BAND_0_1'
                 WHEN mean_similarity <= 0.25 THEN 'BAND_1_25'
                 WHEN mean_similarity <= 0.75 THEN 'BAND_25_75'
                 WHEN mean_similarity <= 0.99 THEN 'BAND_75_99'
                 ELSE 'BAND_99_100' END AS band
  FROM means
),
names AS (
  SELECT * FROM (VALUES (1, 'BAND_0_1'), (2, 'BAND_1_25'), (3, 'BAND_25_75'), (4, 'BAND_75_99'), (5, 'BAND_99_100'))
    AS t(cut, band)
),
per_band AS (
  SELECT CAST(cut AS BIGINT) AS cut, band,
         count(*) FILTER (label = 'TP') AS tp_count, count(*) FILTER (label = 'FP') AS fp_count
  FROM names LEFT JOIN banded USING (band) GROUP BY ALL
),
cuts AS (
  SELECT *, sum(tp_count) OVER (ORDER BY cut) AS tp, sum(fp_count) OVER (ORDER BY cut) AS fp,
         sum(tp_count) OVER () AS all_tp
  FROM per_band
),
band_table AS (
  SELECT cut, band, tp_count, fp_count,
         round(coalesce(tp / nullif(all_tp, 0), 0), 6) AS recall,
         round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision
  FROM cuts
),
levels AS (
  SELECT label, case_id, avg(m) AS alignment_level
  FROM (SELECT label, case_id, activity, avg(n) AS m FROM counts WHERE phase = 'inference' GROUP BY ALL)
  GROUP BY ALL
)"""

# The same path for packets numbered by a hash of their id: windows by packet_no, the log by time.
UNORDERED = EVENTS.replace(
    "ORDER BY ts, event_id) AS packet_no", "ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS packet_no"
).replace("PARTITION BY state, case_id ORDER BY packet_no", "PARTITION BY state, case_id ORDER BY ts, packet_no")

DURATIONS = f"""{EVENTS},
nexts AS (
  SELECT *, lead(ts) OVER (PARTITION BY state, case_id ORDER BY packet_no) AS next_ts FROM log
),
durations AS (
  SELECT *, (epoch_us(next_ts) - epoch_us(ts)) / 1e6 AS duration
  FROM nexts WHERE next_ts IS NOT NULL AND next_ts >= ts
)"""

WINDOW_CASES = f"""{EVENTS},
short AS (
  SELECT label, state, case_id || '#' || CAST(window_no AS VARCHAR) AS case_id,
         packet_no - window_no * 3 AS event_no, activity
  FROM log
),
short_traces AS (
  SELECT label, state, case_id, count(*) AS n_events, string_agg(activity, ',' ORDER BY event_no) AS sequence
  FROM short GROUP BY ALL
),
found AS (
  SELECT label, state, sequence, max(n_events) AS n_events, count(*) AS n_traces, min(case_id) AS first_case
  FROM short_traces GROUP BY ALL
),
ranked AS (
  SELECT *, row_number() OVER w AS variant_no,
         coalesce(sum(n_traces) OVER (PARTITION BY label, state ORDER BY n_traces DESC, first_case
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(n_traces) OVER (PARTITION BY label, state) AS total
  FROM found WINDOW w AS (PARTITION BY label, state ORDER BY n_traces DESC, first_case)
)"""

SPLIT_EVENTS = f"""{EVENTS},
train_traces AS (
  SELECT state, case_id, md5('42:' || case_id) AS h FROM log WHERE phase = 'training' GROUP BY ALL
),
trace_parts AS (
  SELECT state, case_id,
         CASE WHEN row_number() OVER (PARTITION BY state ORDER BY h, case_id)
                   <= floor(round(count(*) OVER (PARTITION BY state) * 0.2, 9))
              THEN 'validation' ELSE 'training' END AS part
  FROM train_traces
),
fitted AS (SELECT l.* FROM log l JOIN trace_parts t USING (state, case_id) WHERE part = 'training'),
held_out AS (SELECT l.* FROM log l JOIN trace_parts t USING (state, case_id) WHERE part = 'validation')"""

POOLED_COSINE = """
SELECT a.state, round(coalesce(max(dot) / nullif(max(na) * max(nb), 0), 0), 6) + 0.0 AS similarity
FROM (SELECT state, sqrt(sum(value * value)) AS na FROM one GROUP BY state) a
LEFT JOIN (SELECT state, sqrt(sum(value * value)) AS nb FROM other GROUP BY state) b USING (state)
LEFT JOIN (SELECT state, sum(x.value * y.value) AS dot FROM one x JOIN other y USING (state, activity) GROUP BY state) d
  USING (state)
GROUP BY a.state"""

FLOWS = """
flows AS (
  SELECT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR))
           AS flow_identifier,
         l_orderkey, l_linenumber, l_partkey, l_suppkey,
         l_quantity - 1 AS duration, l_returnflag AS protocol,
         CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS delta_start,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS label
  FROM lineitem
),
cleaned AS (
  SELECT * REPLACE (coalesce(delta_start, 0) AS delta_start) FROM flows WHERE duration IS NULL OR duration <> 0
)"""

PARTS = f"""{FLOWS},
hashed AS (SELECT flow_identifier, label, md5('42:' || flow_identifier) AS h FROM flows),
first_split AS (
  SELECT flow_identifier, h,
         row_number() OVER (ORDER BY h, flow_identifier) <= ceil(round(count(*) OVER () * 0.4, 9)) AS is_test
  FROM hashed WHERE label = 1
),
second_split AS (
  SELECT flow_identifier,
         row_number() OVER (ORDER BY h, flow_identifier) <= ceil(round(count(*) OVER () * 0.14, 9)) AS is_validation
  FROM first_split WHERE NOT is_test
),
parts AS (
  SELECT flow_identifier, CAST(1 AS BIGINT) AS label, 'test' AS part FROM first_split WHERE is_test
  UNION ALL
  SELECT flow_identifier, 1, CASE WHEN is_validation THEN 'validation' ELSE 'train' END FROM second_split
  UNION ALL
  SELECT flow_identifier, -1, 'test' FROM flows WHERE label = -1
)"""

PREDICTIONS = """
predictions AS (
  SELECT m.model, doc_id AS id,
         CASE WHEN doc_id % 4 <> 0 THEN 1 ELSE -1 END AS y_true,
         CASE WHEN (m.model = 'toxic_flag' AND toxic = 1) OR (m.model = 'low_quality' AND quality = 0)
                OR (m.model = 'odd_id' AND doc_id % 2 = 1) THEN -1 ELSE 1 END AS y_pred
  FROM labels, (VALUES ('toxic_flag'), ('low_quality'), ('odd_id')) AS m(model)
),
measured AS (
  SELECT model,
         count(*) FILTER (y_true = -1 AND y_pred = -1) AS tp, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tn,
         count(*) FILTER (y_true = 1 AND y_pred = -1) AS fp, count(*) FILTER (y_true = -1 AND y_pred = 1) AS fn,
         count(*) FILTER (y_true = 1) AS benign_samples, count(*) FILTER (y_true = -1) AS anomaly_samples
  FROM predictions GROUP BY model
),
metrics AS (
  SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
         coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score,
         coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr,
         coalesce(fn / nullif(fn + tp, 0), 0) AS fnr
  FROM measured
),
members AS (
  SELECT id,
         CAST(max(CASE WHEN model = 'toxic_flag' THEN 1 ELSE 0 END) AS BIGINT) AS toxic_flag,
         CAST(max(CASE WHEN model = 'low_quality' THEN 1 ELSE 0 END) AS BIGINT) AS low_quality,
         CAST(max(CASE WHEN model = 'odd_id' THEN 1 ELSE 0 END) AS BIGINT) AS odd_id
  FROM predictions WHERE y_true = 1 AND y_pred = -1 GROUP BY id
)"""

REPEATED = f"""{PREDICTIONS},
cells AS (
  SELECT r AS repetition, d.detector, id, md5(CAST(41 + r AS VARCHAR) || ':' || CAST(id AS VARCHAR)) AS h
  FROM (UNPIVOT members ON toxic_flag, low_quality, odd_id INTO NAME detector VALUE flag) d,
       (SELECT unnest([1, 2, 3, 4, 5]) AS r)
  WHERE flag = 1
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY repetition, detector ORDER BY h, id) AS rn,
         count(*) OVER (PARTITION BY repetition, detector) AS n
  FROM cells
),
split AS (
  SELECT CAST(repetition AS BIGINT) AS repetition, detector,
         CASE WHEN n = 1 OR rn <= floor(n * 0.5) THEN 'training' ELSE 'inference' END AS phase, 'FP' AS label, id
  FROM placed
  UNION ALL
  SELECT CAST(r AS BIGINT), detector, 'inference', 'TP', doc_id
  FROM labels, (SELECT unnest([1, 2, 3, 4, 5]) AS r),
       (VALUES ('toxic_flag'), ('low_quality'), ('odd_id')) AS d(detector)
  WHERE quality = 0
)"""


def _r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


FEATURES = ["avg_payload", "n_servers", "n_user_ports", "n_ack", "n_syn", "n_fin", "n_psh", "n_rst"]
COUNTS = ", ".join(FEATURES[1:])


def _scaled(centre: str, width: str) -> str:
    columns = [
        f"round((w.{c} - {centre.format(c=c)}) / (CASE WHEN {width.format(c=c)} = 0 THEN 1 ELSE {width.format(c=c)} END), 6)"
        f" + 0.0 AS {c}"
        for c in FEATURES
    ]
    stats = [f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}" for c in FEATURES]
    return (
        f"WITH {PACKETS}, s AS (SELECT {', '.join(stats)} FROM windows) "
        f"SELECT label, case_id, window_no, {', '.join(columns)} FROM windows w, s"
    )


def _nearest() -> str:
    features = ["avg_payload", "n_ack", "n_syn"]
    scaled = ", ".join(
        f"(w.{c} - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END) AS z_{i}" for i, c in enumerate(features)
    )
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in features)
    centroids = [[-1.0, 0.5, 0.0], [1.0, -0.5, 0.0], [0.0, 0.0, 1.5]]
    distance = [" + ".join(f"(z_{i} - ({x})) ** 2" for i, x in enumerate(c)) for c in centroids]
    return f"""WITH {PACKETS}, s AS (SELECT {stats} FROM windows WHERE phase = 'training'),
z AS (SELECT label, case_id, window_no, {scaled} FROM windows w, s),
d AS (SELECT label, case_id, window_no, {', '.join(f'{d} AS d{i}' for i, d in enumerate(distance))} FROM z)
SELECT label, case_id, window_no,
       CASE WHEN d0 <= d1 AND d0 <= d2 THEN 'STATE_0' WHEN d1 <= d2 THEN 'STATE_1' ELSE 'STATE_2' END AS state FROM d"""


KNOWN = " OR ".join(
    f"(state = '{state}' AND activity IN ({', '.join(repr(a) for a in activities)}))" for state, activities in fx.KNOWN.items()
)

# Fitness with the fixed models: unknown events are log moves, and a trace without known ones has a model move.
FITNESS = f"""{EVENTS}, aligned AS (
  SELECT label, phase, state, case_id, count(*) AS n_events, count(*) FILTER (NOT ({KNOWN})) AS unknown
  FROM log GROUP BY ALL
), f AS (
  SELECT label, phase, state, case_id, n_events, unknown + CAST(unknown = n_events AS INT) AS deviations, n_events + 1 AS worst,
         1.0 - (unknown + CAST(unknown = n_events AS INT)) / CAST(n_events + 1 AS DOUBLE) AS fitness FROM aligned
)"""


FLAGS = [(2, "SYN"), (16, "ACK"), (1, "FIN"), (4, "RST"), (8, "PSH"), (32, "URG")]
FLAG_NAMES = ", ".join(f"CASE WHEN (event_id % 64) & {bit} <> 0 THEN '{name}' END" for bit, name in FLAGS)
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
MEASURES = ["accuracy", "precision", "recall", "f1_score", "specificity", "fpr", "fnr"]
CLASS_REPORT = f"""WITH {PREDICTIONS},
sides AS (
  SELECT model, y_true AS class, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS hit, 1 AS t, 0 AS g FROM predictions
  UNION ALL SELECT model, y_pred, 0, 0, 1 FROM predictions
),
scored AS (
  SELECT model, class, sum(t) AS support, sum(hit) AS hits,
         coalesce(sum(hit) / nullif(sum(g), 0), 0) AS precision, coalesce(sum(hit) / nullif(sum(t), 0), 0) AS recall,
         coalesce(2 * sum(hit) / nullif(sum(g) + sum(t), 0), 0) AS f1_score
  FROM sides GROUP BY ALL
),
report AS (
  SELECT model, CAST(class AS VARCHAR) AS row, precision, recall, f1_score, support FROM scored
  UNION ALL SELECT model, 'accuracy', NULL, NULL, sum(hits) / sum(support), sum(support) FROM scored GROUP BY model
  UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM scored GROUP BY model
  UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1_score * support) / sum(support), sum(support) FROM scored GROUP BY model
)
SELECT model, "row", {_r6('precision', 'recall', 'f1_score')}, CAST(support AS BIGINT) AS support FROM report"""

ORACLES: dict[str, str] = {
    "alarm_bands": f"WITH {BANDED} SELECT * FROM band_table",
    "band_activity_stats": f"""WITH {BANDED}
SELECT band, label, activity, round(avg(n), 6) + 0.0 AS mean_alignments
FROM counts JOIN banded USING (label, case_id) WHERE phase = 'inference' GROUP BY ALL""",
    "band_similarity_stats": f"""WITH {BANDED}, kinds AS (SELECT unnest(['TP', 'FP']) AS label)
SELECT n.band, k.label, round(coalesce(avg(b.mean_similarity), 0), 6) + 0.0 AS mean_similarity
FROM names n CROSS JOIN kinds k LEFT JOIN banded b ON b.band = n.band AND b.label = k.label GROUP BY ALL""",
    "trace_alignment_level": f"WITH {BANDED} SELECT label, case_id, {_r6('alignment_level')} FROM levels",
    "band_alignment_level": f"""WITH {BANDED}
SELECT band, label, round(avg(alignment_level), 6) + 0.0 AS mean_total_alignments
FROM levels JOIN banded USING (label, case_id) GROUP BY ALL""",
    "trace_similarity_by_label": f"WITH {BANDED} SELECT label, case_id, {_r6('mean_similarity')}, band FROM banded",
    "trace_state_similarity": f"WITH {BANDED} SELECT label, case_id, state, {_r6('similarity')} FROM sims",
    "client_direction": f"WITH {PACKETS} SELECT label, case_id, packet_no, client_ip, direction FROM packets",
    "tcp_flag_names": f"""SELECT event_id, CAST(event_id % 64 AS INTEGER) AS flag_bits,
  CASE WHEN concat_ws('+', {FLAG_NAMES}) = '' THEN 'OTHER' ELSE concat_ws('+', {FLAG_NAMES}) END AS tcp_flag
FROM events""",
    "activity_names": f"WITH {RAW} SELECT event_id, direction || '_' || tcp_flag AS activity FROM raw",
    "address_text": """SELECT event_id, packed, concat_ws('.', packed // 16777216, packed // 65536 % 256,
  packed // 256 % 256, packed % 256) AS address
FROM (SELECT event_id, event_id * 2654435761 % 4294967296 AS packed FROM events)""",
    "payload_values": """SELECT event_id,
  round(CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 0 ELSE coalesce(value, 0) END, 6) AS payload FROM events""",
    "epoch_to_timestamp": f"SELECT event_id, strftime(ts, {STAMP}) AS ts_text FROM events",
    "packet_windows": f"""WITH {PACKETS} SELECT p.label, p.case_id, p.window_no, p.packet_no
FROM placed p JOIN windows w USING (case_id, window_no)""",
    "window_features": f"WITH {PACKETS} SELECT label, case_id, window_no, {_r6('avg_payload')}, {COUNTS} FROM windows",
    "packets_with_features": f"""WITH {PACKETS} SELECT p.label, p.case_id, p.packet_no, p.tcp_flag, p.payload_size,
  window_no, {_r6('avg_payload')}, {COUNTS} FROM placed p JOIN windows w USING (case_id, window_no)""",
    "window_zscore": _scaled("mean_{c}", "std_{c}"),
    "window_minmax": _scaled("min_{c}", "(max_{c} - min_{c})"),
    "state_assignment_fixed_centroids": _nearest(),
    "state_event_log": f"""WITH {EVENTS}
SELECT label, case_id, state, window_no, event_no, activity, payload_size FROM numbered""",
    "time_ordered_log": f"""WITH {EVENTS}
SELECT label, case_id, state, event_no, activity, payload_size FROM numbered""",
    "unordered_capture_log": f"""WITH {UNORDERED}
SELECT label, case_id, state, event_no, window_no, activity, payload_size FROM numbered""",
    "unordered_event_durations": f"""WITH {UNORDERED},
nexts AS (SELECT *, lead(ts) OVER (PARTITION BY state, case_id ORDER BY event_no) AS next_ts FROM numbered),
durations AS (SELECT *, (epoch_us(next_ts) - epoch_us(ts)) / 1e6 AS duration FROM nexts WHERE next_ts >= ts)
SELECT label, case_id, state, event_no, activity, {_r6('duration')} FROM durations""",
    "event_durations": f"""WITH {DURATIONS}
SELECT label, case_id, state, packet_no, activity, {_r6('duration')} FROM durations""",
    "traces": f"""WITH {EVENTS} SELECT label, case_id, state, count(*) AS n_events, strftime(min(ts), {STAMP}) AS first_ts,
  strftime(max(ts), {STAMP}) AS last_ts, CAST(sum(payload_size) AS BIGINT) AS payload_total FROM log GROUP BY ALL""",
    "log_quality": f"""WITH {EVENTS} SELECT label, state, count(DISTINCT case_id) AS n_traces, count(*) AS n_events
FROM log GROUP BY ALL""",
    "variants": f"WITH {WINDOW_CASES} SELECT label, state, n_events, n_traces, first_case FROM found",
    "variants_topk": f"""WITH {WINDOW_CASES}
SELECT label, state, variant_no, n_events, n_traces, first_case FROM ranked WHERE variant_no <= 5""",
    "variants_coverage": f"""WITH {WINDOW_CASES}
SELECT label, state, variant_no, n_events, n_traces, first_case FROM ranked WHERE variant_no = 1 OR before < total * 0.6""",
    "variant_unfiltered_log": f"WITH {WINDOW_CASES} SELECT label, case_id, state, event_no, activity FROM short",
    "variant_filtered_log": f"""WITH {WINDOW_CASES}
SELECT s.label, s.case_id, s.state, s.event_no, s.activity
FROM short s JOIN short_traces t USING (label, state, case_id) JOIN ranked r USING (label, state, sequence)
WHERE r.variant_no = 1 OR r.before < r.total * 0.6""",
    "variant_sequences": f"""WITH {WINDOW_CASES}
SELECT s.label, s.state, s.case_id, f.n_traces, s.event_no, s.activity
FROM found f JOIN short s ON s.label = f.label AND s.state = f.state AND s.case_id = f.first_case""",
    "conversation_variants": """WITH t AS (
  SELECT conv_id, count(*) AS n_events, string_agg(role, ',' ORDER BY turn) AS sequence FROM conversations GROUP BY ALL
), v AS (
  SELECT sequence, max(n_events) AS n_events, count(*) AS n_traces, min(conv_id) AS first_case FROM t GROUP BY sequence
), r AS (SELECT *, row_number() OVER (ORDER BY n_traces DESC, first_case) AS variant_no FROM v)
SELECT variant_no, n_events, n_traces, first_case FROM r WHERE variant_no <= 10""",
    "directly_follows": f"""WITH {EVENTS}, p AS (
  SELECT label, state, activity, lead(activity) OVER (PARTITION BY state, case_id ORDER BY packet_no) AS next_activity FROM log
) SELECT label, state, activity, next_activity, count(*) AS n FROM p WHERE next_activity IS NOT NULL GROUP BY ALL""",
    "start_end_activities": f"""WITH {EVENTS}, e AS (
  SELECT label, state, case_id, arg_min(activity, packet_no) AS s, arg_max(activity, packet_no) AS f FROM log GROUP BY ALL
) SELECT label, state, position, activity, count(*) AS n FROM (
  SELECT label, state, 'start' AS position, s AS activity FROM e UNION ALL SELECT label, state, 'end', f FROM e) GROUP BY ALL""",
    "frequent_pairs": f"""WITH {EVENTS}, p AS (
  SELECT label, state, activity AS a, lead(activity) OVER (PARTITION BY state, case_id ORDER BY packet_no) AS b FROM log
), c AS (SELECT label, state, a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL)
SELECT label, state, a, b, n FROM (SELECT *, max(n) OVER (PARTITION BY label, state, a) AS top FROM c) WHERE n >= 0.5 * top""",
    "training_sync_moves": f"WITH {EVENTS} SELECT label, case_id, state, activity, n FROM counts WHERE phase = 'training'",
    "fixed_alignments": f"""WITH {FITNESS}
SELECT label, case_id, state, n_events, deviations, worst, round(fitness, 6) AS fitness FROM f""",
    "fixed_sync_moves": f"""WITH {EVENTS}
SELECT label, case_id, state, activity, count(*) AS n FROM log WHERE {KNOWN} GROUP BY ALL""",
    "fixed_log_fitness": f"""WITH {FITNESS}
SELECT state, count(*) AS n_traces, round(1 - sum(deviations) / CAST(sum(worst) AS DOUBLE), 6) AS fitness FROM f GROUP BY state""",
    "log_fitness": f"""WITH {EVENTS} SELECT state, count(DISTINCT case_id) AS n_traces, CAST(1 AS DOUBLE) AS fitness
FROM log WHERE phase = 'training' GROUP BY state""",
    "control_flow_profile": f"WITH {EVENTS} SELECT state, activity, value FROM profile",
    "timing_profile": f"""WITH {DURATIONS} SELECT state, activity, round(sum(duration), 3) AS value
FROM durations WHERE phase = 'training' GROUP BY ALL""",
    "payload_profile": f"""WITH {EVENTS} SELECT state, activity, round(avg(payload_size), 6) + 0.0 AS value
FROM log WHERE phase = 'training' GROUP BY ALL""",
    "trace_timing_profile": f"""WITH {DURATIONS}
SELECT label, case_id, state, activity, round(avg(duration), 3) AS value, count(*) AS n FROM durations GROUP BY ALL""",
    "trace_payload_profile": f"""WITH {EVENTS}
SELECT label, case_id, state, activity, round(avg(payload_size), 6) + 0.0 AS value, count(*) AS n FROM log GROUP BY ALL""",
    "trace_timing_similarity": f"""WITH {DURATIONS},
prof AS (SELECT state, activity, sum(duration) AS value FROM durations WHERE phase = 'training' GROUP BY ALL),
vec AS (SELECT label, state, case_id, activity, avg(duration) AS value FROM durations WHERE phase = 'inference' GROUP BY ALL),
{COSINE} SELECT label, case_id, state, {_r6('similarity')} FROM sims""",
    "trace_payload_similarity": f"""WITH {EVENTS},
prof AS (SELECT state, activity, avg(payload_size) AS value FROM log WHERE phase = 'training' GROUP BY ALL),
vec AS (SELECT label, state, case_id, activity, avg(payload_size) AS value FROM log WHERE phase = 'inference' GROUP BY ALL),
{COSINE} SELECT label, case_id, state, {_r6('similarity')} FROM sims""",
    "trace_split": f"WITH {SPLIT_EVENTS} SELECT state, case_id, part FROM trace_parts",
    "state_similarity_control": f"""WITH {SPLIT_EVENTS},
c AS (SELECT state, case_id, activity, count(*) AS n FROM fitted GROUP BY ALL),
prof AS (SELECT state, activity, floor(sum(n) / count(*)) AS value FROM c GROUP BY ALL),
vec AS (SELECT label, state, case_id, activity, CAST(count(*) AS DOUBLE) AS value FROM held_out GROUP BY ALL),
{COSINE} SELECT state, round(avg(similarity), 6) + 0.0 AS similarity FROM sims GROUP BY state""",
    "state_similarity_timing": f"""WITH {SPLIT_EVENTS},
gaps AS (
  SELECT state, case_id, activity, (lead(epoch_us(ts)) OVER (PARTITION BY state, case_id ORDER BY packet_no) - epoch_us(ts)) / 1e6 AS d,
         part FROM log JOIN trace_parts USING (state, case_id)
),
one AS (SELECT state, activity, sum(d) AS value FROM gaps WHERE part = 'training' AND d >= 0 GROUP BY ALL),
other AS (SELECT state, activity, sum(d) AS value FROM gaps WHERE part = 'validation' AND d >= 0 GROUP BY ALL)
{POOLED_COSINE}""",
    "state_similarity_payload": f"""WITH {SPLIT_EVENTS},
one AS (SELECT state, activity, avg(payload_size) AS value FROM fitted GROUP BY ALL),
other AS (SELECT state, activity, avg(payload_size) AS value FROM held_out GROUP BY ALL)
{POOLED_COSINE}""",
    "flow_clean": f"""WITH {FLOWS} SELECT flow_identifier, duration, protocol, delta_start, quantity, price, discount, tax,
  CAST(1 AS BIGINT) AS label FROM cleaned""",
    "protocol_codes": f"""WITH {FLOWS}, f AS (
  SELECT protocol, min(ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS place FROM flows GROUP BY protocol
) SELECT protocol, row_number() OVER (ORDER BY place) - 1 AS code FROM f""",
    "protocol_codes_by_label": f"""WITH {FLOWS}, f AS (
  SELECT label, protocol, min(ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS place FROM flows GROUP BY ALL
) SELECT CAST(label AS BIGINT) AS label, protocol, row_number() OVER (PARTITION BY label ORDER BY place) - 1 AS code FROM f""",
    "protocol_encoded": f"""WITH {FLOWS}, f AS (
  SELECT protocol, min(ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS place FROM flows GROUP BY protocol
), c AS (SELECT protocol, row_number() OVER (ORDER BY place) - 1 AS code FROM f)
SELECT flow_identifier, code AS protocol FROM flows JOIN c USING (protocol)""",
    "flow_minmax": f"""WITH {FLOWS}, s AS (SELECT min(quantity) AS q0, max(quantity) AS q1, min(price) AS p0, max(price) AS p1,
  min(discount) AS d0, max(discount) AS d1, min(tax) AS t0, max(tax) AS t1, min(delta_start) AS s0, max(delta_start) AS s1
  FROM cleaned WHERE label = 1)
SELECT flow_identifier, round((quantity - q0) / (q1 - q0), 6) + 0.0 AS quantity, round((price - p0) / (p1 - p0), 6) + 0.0 AS price,
  round((discount - d0) / (d1 - d0), 6) + 0.0 AS discount, round((tax - t0) / (t1 - t0), 6) + 0.0 AS tax,
  round((delta_start - s0) / (s1 - s0), 6) + 0.0 AS delta_start FROM cleaned, s""",
    "holdout_split": f"""WITH {PARTS}
SELECT flow_identifier, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part FROM first_split""",
    "validation_split": f"WITH {PARTS} SELECT flow_identifier, label, part FROM parts",
    "stacked_test_rows": f"""WITH {PARTS}
SELECT part, count(*) FILTER (label = 1) AS benign, count(*) FILTER (label = -1) AS anomalies FROM parts GROUP BY part""",
    "repeated_split": f"WITH {REPEATED} SELECT * FROM split",
    "recon_threshold": f"""WITH {FLOWS}, s AS (SELECT *, price / 1000.0 + discount AS score FROM flows),
t AS (SELECT avg(score) + 1.75 * stddev_pop(score) AS threshold FROM s WHERE label = 1)
SELECT CAST(CASE WHEN score > threshold THEN -1 ELSE 1 END AS BIGINT) AS prediction, round(threshold, 6) AS threshold,
  round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score,
  round(min(score), 6) AS min_score, round(max(score), 6) AS max_score
FROM s, t GROUP BY 1, threshold""",
    "confusion": f"WITH {PREDICTIONS} SELECT * FROM measured",
    "detector_metrics": f"""WITH {PREDICTIONS}
SELECT model, tp, tn, fp, fn, benign_samples, anomaly_samples, {_r6(*MEASURES)} FROM metrics""",
    "class_report": CLASS_REPORT,
    "fp_fn_lists": f"""WITH {PREDICTIONS}
SELECT model, CASE WHEN y_true = 1 THEN 'false_positives' ELSE 'false_negatives' END AS kind, id
FROM predictions WHERE y_true <> y_pred""",
    "detector_membership": f"WITH {PREDICTIONS} SELECT * FROM members ORDER BY id",
    "common_alarms": f"WITH {PREDICTIONS} SELECT id FROM members WHERE toxic_flag + low_quality + odd_id = 3",
    "first_common_alarms": f"""WITH {PREDICTIONS}
SELECT id FROM members WHERE toxic_flag + low_quality + odd_id = 3 ORDER BY id LIMIT 10""",
    "alarm_counts": f"""WITH {PREDICTIONS}
SELECT CAST(coalesce(sum(toxic_flag), 0) AS BIGINT) AS toxic_flag, CAST(coalesce(sum(low_quality), 0) AS BIGINT) AS low_quality,
  CAST(coalesce(sum(odd_id), 0) AS BIGINT) AS odd_id,
  count(*) FILTER (toxic_flag + low_quality + odd_id = 3) AS common, count(*) AS ids FROM members""",
    "metrics_report": f"""WITH {PREDICTIONS}
SELECT model, {', '.join(f'round({m}, 4) AS {m}' for m in MEASURES)}, tp, tn, fp, fn, benign_samples, anomaly_samples
FROM metrics ORDER BY f1_score DESC, model""",
    "trace_fitness_mean": f"""WITH {FITNESS} SELECT label, case_id, round(avg(fitness), 6) + 0.0 AS fitness, count(*) AS n_states FROM f GROUP BY ALL""",
    "trace_fitness_min": f"""WITH {FITNESS} SELECT label, case_id, round(CAST(min(fitness) AS DOUBLE), 6) AS fitness FROM f GROUP BY ALL""",
    "robust_threshold": f"""WITH {FITNESS}, m AS (SELECT label, case_id, avg(fitness) AS fitness FROM f GROUP BY ALL)
SELECT label, round(greatest(0, avg(fitness) - 2 * stddev_pop(fitness)), 6) AS threshold, count(*) AS n_traces FROM m GROUP BY label""",
    "xes_round_trip": f"""WITH {EVENTS}
SELECT label, case_id, state, event_no, activity, strftime(ts, {STAMP}) AS ts_text, payload_size FROM numbered""",
    "event_log_store": f"""WITH {EVENTS}
SELECT label, state, case_id, event_no, activity, payload_size FROM numbered WHERE label = 'TP'""",
    "flow_csv_scan": f"""WITH {FLOWS} SELECT flow_identifier AS flow_id, duration, protocol, {_r6('price', 'delta_start')} FROM flows""",
    "capture_ingest": f"""WITH {PACKETS}, addressed AS (
  SELECT * REPLACE (CASE WHEN src_ip LIKE '10.%' THEN client ELSE src_ip END AS src_ip,
                    CASE WHEN dst_ip LIKE '10.%' THEN client ELSE dst_ip END AS dst_ip)
  FROM (SELECT *, concat_ws('.', 10, u // 65536 % 256, u // 256 % 256, u % 256) AS client
        FROM (SELECT *, CAST(substr(case_id, 6) AS BIGINT) AS u FROM packets))
)
SELECT label, case_id || '.pcap' AS case_id, packet_no, src_ip, dst_ip, src_port, dst_port, tcp_flag, payload_size, direction,
       strftime(ts, {STAMP}) AS ts_text FROM addressed""",
    "capture_errors": f"""WITH {PACKETS}, sizes AS (
  SELECT label || '/' || case_id || '.pcap' AS file, CAST(substr(case_id, 6) AS BIGINT) AS u, count(*) AS n FROM packets GROUP BY ALL
)
SELECT file, CASE WHEN u % 11 = 0 THEN 'not a capture file' WHEN u % 7 = 0 THEN 'record header is cut off' END AS reason,
  CASE WHEN u % 11 = 0 OR u % 7 = 0 THEN 0 ELSE n END AS n_packets FROM sizes""",
    "alarm_semi_join": """SELECT o_orderkey AS id FROM orders
WHERE o_orderstatus <> 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "labelled_captures": f"WITH {RAW} SELECT DISTINCT case_id AS id FROM raw WHERE label = 'TP'",
    "schema_union": """SELECT l_orderkey AS key, l_quantity AS quantity, NULL AS status FROM lineitem
UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders""",
    "sorted_flows": f"WITH {FLOWS} SELECT flow_identifier, price FROM flows ORDER BY price",
    "scores_store": f"""WITH {PREDICTIONS}
SELECT model, id AS flow_id, round(id % 10 / 10.0, 6) + 0.0 AS anomaly_score FROM predictions""",
    "alarm_list_store": f"""WITH {PREDICTIONS}
SELECT CAST(id AS VARCHAR) AS id FROM predictions WHERE model = 'low_quality' AND y_true = -1 AND y_pred = 1""",
    "membership_csv": f"WITH {PREDICTIONS} SELECT CAST(id AS VARCHAR) AS id, * EXCLUDE (id) FROM members",
    "metrics_csv": f"""WITH {PREDICTIONS} SELECT model, printf('%.4f', round(accuracy, 4)) AS accuracy,
  printf('%.4f', round(f1_score, 4)) AS f1_score, CAST(tp AS VARCHAR) AS tp, CAST(fp AS VARCHAR) AS fp FROM metrics""",
    "split_layout": f"WITH {REPEATED} SELECT repetition, detector, phase, label, count(*) AS n FROM split GROUP BY ALL",
    "profile_store": f"""WITH {EVENTS}
SELECT 'control_flow' AS perspective, state, activity, round(value, 6) AS value FROM profile
UNION ALL SELECT 'payload', state, activity, round(avg(payload_size), 6) FROM log WHERE phase = 'training' GROUP BY ALL""",
    "band_json": f"""WITH {BANDED}
SELECT cut, band, recall, precision,
  (SELECT tp_count FROM per_band WHERE band = 'BAND_25_75') AS tp_middle,
  (SELECT fp_count FROM per_band WHERE band = 'BAND_75_99') AS fp_high,
  (SELECT round(avg(mean_similarity), 6) FROM banded WHERE band = 'BAND_25_75' AND label = 'TP') AS similarity_middle
FROM band_table""",
    "threshold_store": f"""WITH {FITNESS}, m AS (SELECT label, case_id, avg(fitness) AS fitness FROM f GROUP BY ALL),
t AS (SELECT greatest(0, avg(fitness) - 2 * stddev_pop(fitness)) AS threshold FROM m)
SELECT count(*) FILTER (fitness >= threshold) AS kept, round(max(threshold), 6) AS threshold FROM m, t""",
    "cell_states": "SELECT event_id % 2 AS part, event_id, 'STATE_' || CAST(user_id % 3 AS VARCHAR) AS state FROM events",
    "cell_failures": """SELECT part, CAST(3 AS BIGINT) AS clusters, reason FROM (VALUES
  (CAST(2 AS BIGINT), '3 states of fewer distinct windows'), (10, 'no windows to fit'), (11, 'no windows to fit'), (12, 'no windows to fit')) f(part, reason)
WHERE EXISTS (SELECT 1 FROM events)""",
    "planted_states": """SELECT method, event_id % 2 AS part, event_id, 'STATE_' || CAST(user_id % 3 AS VARCHAR) AS state
FROM events, (SELECT unnest(['kmeans', 'gmm', 'agglomerative']) AS method)""",
}
