"""Views that derive flows, packets, predictions and logs from the driver's tables."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alarmloom.operators.eventlog import number_events, traces, variant_steps, variants
from alarmloom.operators.ordering import join_per_group, number_rows
from alarmloom.operators.sizing import longest_group, split_rows
from alarmloom.operators.split import split_traces
from alarmloom.operators.windows import full_windows, route_windows, with_first_sender
from alarmloom.sources import captures

WINDOW = 3
CASE = ["label", "phase", "case_id"]
TRACE = ["label", "phase", "state", "case_id"]
LOG = ["label", "phase", "state"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of `events` before they are numbered."""
    user, told, event = F.col("user_id"), F.col("event_type"), F.col("event_id")
    even_user = user % 2 == 0
    g = F.floor(user / 2) % 5

    def instead(even: str, odd: str) -> Column:
        return F.when(event % 2 == 0, even).otherwise(odd)

    # Every event stays; the groups of users differ in the kinds they know.
    kind = (
        F.when(
            even_user | (g == 3),
            F.when(told.isin("view", "click") | (event % 8 == 0), told).otherwise(instead("view", "click")),
        )
        .when(g == 0, "error")
        .when(g == 1, F.when(told.isin("signup", "purchase"), told).otherwise(instead("signup", "purchase")))
        .when(g == 2, told)
        .when(told.isin("error", "purchase") | ((told == "view") & (event % 2 == 0)), told)
        .otherwise(instead("error", "purchase"))
    )
    upstream = kind.isin("signup", "view", "click")
    flag = (
        F.when(kind == "signup", "SYN")
        .when(kind == "view", "ACK")
        .when(kind == "click", "ACK+PSH")
        .when(kind == "purchase", "SYN+ACK")
        .when(~even_user & (g == 0), "RST")
        .otherwise("ACK+FIN")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    client_ip = F.concat(F.lit("10.0.0."), user.cast("string"))
    server_ip = F.concat(F.lit("192.168.0."), (k % 7).cast("string"))
    client_port = F.lit(40000) + k
    server_port = F.when(k % 5 != 0, F.lit(443)).otherwise(F.lit(8080))
    return table(spark, sf_dir, "events").select(
        F.when(even_user, "FP").otherwise("TP").alias("label"),
        F.when(user % 4 == 0, "training").otherwise("inference").alias("phase"),
        F.concat(F.lit("flow_"), user.cast("string")).alias("case_id"),
        event.alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(upstream, "C_to_S").otherwise("S_to_C").alias("direction"),
        flag.alias("tcp_flag"),
        F.floor("value").cast("bigint").alias("payload_size"),
        F.when(upstream, client_ip).otherwise(server_ip).alias("src_ip"),
        F.when(upstream, server_ip).otherwise(client_ip).alias("dst_ip"),
        F.when(upstream, client_port).otherwise(server_port).alias("src_port"),
        F.when(upstream, server_port).otherwise(client_port).alias("dst_port"),
    )


@dataclass
class Packets:
    """Numbered packets, and the piece length when a flow is too long for one task."""

    rows: DataFrame
    split: int | None


def packets(spark: SparkSession, sf_dir: str) -> Packets:
    raw = raw_packets(spark, sf_dir)
    longest = longest_group(raw, CASE)
    rows = number_rows(raw, CASE, ["ts", "event_id"], "packet_no", longest=longest)
    return Packets(rows, split_rows(longest))


def unordered_packets(spark: SparkSession, sf_dir: str) -> Packets:
    """Packets numbered by a hash of their id, as in a capture out of time order."""
    raw = raw_packets(spark, sf_dir).withColumn("_place", F.md5(F.col("event_id").cast("string").cast("binary")))
    longest = longest_group(raw, CASE)
    rows = number_rows(raw, CASE, ["_place", "event_id"], "packet_no", longest=longest).drop("_place")
    return Packets(rows, split_rows(longest))


HELD = ["ts", "direction", "tcp_flag", "payload_size"]


def windows(source: Packets, held: list[str] = ()) -> DataFrame:
    known = with_first_sender(source.rows, CASE, source.split)
    return full_windows(known, WINDOW, CASE, held)


def rule_state() -> Column:
    """The state rule that SQL can express: STATE_1 from a mean payload of 50 on."""
    return F.when(F.col("avg_payload") >= 50, "STATE_1").otherwise("STATE_0")


def state_events(source: Packets) -> DataFrame:
    return route_windows(windows(source, HELD), rule_state(), CASE)


def numbered_events(source: Packets) -> DataFrame:
    return number_events(state_events(source), TRACE, source.split)


def training(rows: DataFrame) -> DataFrame:
    return rows.where("phase = 'training'")


def inference(rows: DataFrame) -> DataFrame:
    return rows.where("phase = 'inference'")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records of `lineitem`."""
    identifier = F.concat_ws(
        "_",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        F.col("l_shipdate").cast("date").cast("string"),
    )
    handshake = F.when(F.col("l_partkey") % 7 == 0, "not a complete handshake")
    return table(spark, sf_dir, "lineitem").select(
        identifier.alias("flow_identifier"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (F.col("l_quantity") - 1).alias("duration"),
        F.col("l_returnflag").alias("protocol"),
        handshake.otherwise(F.col("l_extendedprice").cast("string")).alias("delta_start"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("label"),
    )


FLOW_FEATURES = ["quantity", "price", "discount", "tax", "delta_start"]
FLOW_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def embedding_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide flow records of `embeddings`: vectors with label 9 are the attacks."""
    values = F.transform("embedding", lambda x: (x.cast("double") + 1) / 2)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), values.alias("features"), F.when(F.col("label") == 9, -1).otherwise(1).alias("label")
    )


DETECTORS = ["toxic_flag", "low_quality", "odd_id"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three rules over `labels`, in long form."""
    flagged = [
        F.struct(F.lit("toxic_flag").alias("model"), (F.col("toxic") == 1).alias("flag")),
        F.struct(F.lit("low_quality").alias("model"), (F.col("quality") == 0).alias("flag")),
        F.struct(F.lit("odd_id").alias("model"), (F.col("doc_id") % 2 == 1).alias("flag")),
    ]
    return table(spark, sf_dir, "labels").withColumn("_m", F.explode(F.array(*flagged))).select(
        F.col("_m.model").alias("model"),
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 4 != 0, 1).otherwise(-1).alias("y_true"),
        F.when(F.col("_m.flag"), -1).otherwise(1).alias("y_pred"),
    )


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log of `conversations`: case is the conversation, activity the role."""
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("conversation").alias("log"),
        F.col("conv_id").alias("case_id"),
        "turn",
        F.col("role").alias("activity"),
        F.length("text").cast("bigint").alias("payload_size"),
        F.timestamp_seconds("turn").alias("ts"),
    )
    numbered = number_rows(turns, ["log", "case_id"], ["turn"], "event_no")
    return numbered.withColumn("packet_no", F.col("event_no"))


def window_cases(source: Packets) -> DataFrame:
    """Events with every full window as a case of its own: short traces, repeated variants."""
    events = route_windows(windows(source, HELD), rule_state(), CASE)
    place = F.col("packet_no") - F.col("window_no") * WINDOW
    return events.withColumn("case_id", F.concat_ws("#", "case_id", "window_no")).withColumn("event_no", place)


def parts_of_training(events: DataFrame, split: int | None) -> tuple[DataFrame, DataFrame]:
    """Training events split by trace into training and validation."""
    fitted = training(events)
    sizes = fitted.groupBy(*TRACE).agg(F.max("packet_no").alias("_last"))
    marked = join_per_group(fitted, split_traces(sizes, ["state"], 0.2), TRACE, "packet_no", split, "inner")
    return marked.where("part = 'training'"), marked.where("part = 'validation'")


# Activities that the fixed model of each state knows.
KNOWN = {
    "STATE_0": ["C_to_S_ACK", "C_to_S_ACK+PSH", "S_to_C_ACK+FIN"],
    "STATE_1": ["C_to_S_ACK", "C_to_S_SYN", "S_to_C_SYN+ACK"],
}


def fixed_model(spark: SparkSession) -> DataFrame:
    """Process trees of known alignments: in each state, its activities in any order, one event or more.

    A known event is a synchronous move, any other a log move, and a trace without known
    events has one model move.
    """
    rows = []
    for state, activities in KNOWN.items():
        rows += [(state, "0", None, 0, "loop", None), (state, "0.0", "0", 0, "xor", None), (state, "0.1", "0", 1, "tau", None)]
        rows += [(state, f"0.0.{i}", "0.0", i, "activity", a) for i, a in enumerate(activities)]
    return spark.createDataFrame(rows, "state string, node string, parent string, position int, operator string, activity string")


def model_steps(events: DataFrame, split: int | None) -> DataFrame:
    """Training variants of every state, one row per step, ready for discovery."""
    ids = ["label", "phase", "case_id"]
    rows = variants(traces(events, TRACE), ["state"], ids)
    return variant_steps(events, rows, ["state"], ids, split).select(
        "state",
        F.to_json(F.struct(*ids)).alias("sid"),
        F.col("event_no").alias("pos"),
        "activity",
        F.col("n_traces").alias("weight"),
    )


# Packets after which a capture goes on in another file.
FILE_PACKETS = 40


def with_real_addresses(rows: DataFrame) -> DataFrame:
    """Client addresses as four octets; the user id may exceed one octet."""
    user = F.substring_index("case_id", "_", -1).cast("bigint")
    octets = [F.floor(user / scale % 256).cast("string") for scale in (65536, 256, 1)]
    client = F.concat_ws(".", F.lit("10"), *octets)
    return rows.withColumns(
        {c: F.when(F.col(c).startswith("10."), client).otherwise(F.col(c)) for c in ("src_ip", "dst_ip")}
    )


def damaged_records(numbered: DataFrame) -> DataFrame:
    """Records of capture files, of which every seventh flow has a torn end and every eleventh no capture header."""
    rows = captures.rotated_records(with_real_addresses(numbered), 1 << 40)
    user = F.regexp_extract("path", r"flow_(\d+)\.pcap$", 1).cast("bigint")
    header = (F.col("packet_no") == 0) & (user % 11 == 0)
    rows = rows.withColumn("record", F.when(header, F.lit(b"not a capture, but long enough")).otherwise(F.col("record")))
    torn = rows.where((F.col("packet_no") == 0) & (user % 7 == 0))
    end = torn.select("path", F.lit((1 << 62)).cast("bigint").alias("packet_no"), F.lit(b"torn").alias("record"))
    return rows.unionByName(end)


ALARM_DETECTORS = ["every_alarm", "every_third", "silent"]


def grid_alarms(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """False alarms with the detectors that raise them, and true alarms; one detector raises no false alarm."""
    flows = numbered.groupBy("label", "case_id").agg(F.count("*").alias("n"))
    user = F.substring_index("case_id", "_", -1).cast("bigint")
    false_alarms = flows.where("label = 'FP'").select(
        F.col("case_id").alias("id"),
        F.lit(1).alias("every_alarm"),
        (user % 3 == 0).cast("int").alias("every_third"),
        F.lit(0).alias("silent"),
    )
    return false_alarms, flows.where("label = 'TP'").select(F.col("case_id").alias("id"))


def planted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window features around three far centres, one per group of users; constant and mixed features among them.

    `part` splits the rows in two cells of like content, and a third one has too few distinct windows.
    """
    g = F.col("user_id") % 3
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_id") % 2).alias("part"),
        g.alias("planted"),
        (g * 100_000 + F.col("value")).alias("avg_payload"),
        (g + 1).alias("n_servers"),
        (g * 3 + 2).alias("n_user_ports"),
        (2 - g).alias("n_ack"),
        F.lit(0).cast("bigint").alias("n_syn"),
        (g * g).alias("n_fin"),
        F.when(g == 1, 5).otherwise(0).cast("bigint").alias("n_psh"),
        g.alias("n_rst"),
    )
    poor = rows.where("event_id % 10 = 0").withColumns(
        {"part": F.lit(2).cast("bigint"), "avg_payload": F.lit(1.0), **{c: F.lit(0).cast("bigint") for c in ("n_servers", "n_user_ports", "n_ack", "n_fin", "n_psh")}}
    )
    return rows.unionByName(poor.withColumn("n_rst", F.col("event_id") % 20 / 10))
