"""Count-based windows over the packets of a flow, and their features."""

from pyspark.sql import Column, DataFrame, functions as F

from alarmloom.functions.packets import activity_name, direction, likely_client, seconds_between
from alarmloom.operators.ordering import first_value, next_row
from alarmloom.schema import COUNTED_FLAGS, HTTPS_PORT

CASE = ["label", "case_id"]


def with_client(packets: DataFrame, keys: list[str] = CASE, split: int | None = None) -> DataFrame:
    """Client address of a capture, inferred from the ports of its first packet."""
    client = likely_client(F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"))
    return first_value(packets, keys, "packet_no", client, "client_ip", split)


def with_first_sender(packets: DataFrame, keys: list[str] = CASE, split: int | None = None) -> DataFrame:
    """Source address of the first packet, the client as the window features see it."""
    return first_value(packets, keys, "packet_no", F.col("src_ip"), "first_sender", split)


def with_direction(packets: DataFrame, keys: list[str] = CASE, split: int | None = None) -> DataFrame:
    side = direction(F.col("src_ip"), F.col("client_ip"))
    return with_client(packets, keys, split).withColumn("direction", side)


def with_window_no(packets: DataFrame, size: int) -> DataFrame:
    """Tumbling window number from the dense packet number; no shuffle."""
    return packets.withColumn("window_no", F.floor((F.col("packet_no") - 1) / F.lit(size)).cast("bigint"))


def full_windows(packets: DataFrame, size: int, keys: list[str] = CASE, held: list[str] = ()) -> DataFrame:
    """One row per full window with the eight features; partial windows are dropped.

    Columns named in held are kept as an array of packet structs, which has
    exactly `size` items. Group keys extend the keys by which packets were
    numbered, so the plan reuses that partitioning.
    """
    addresses = F.flatten(F.array(F.collect_set("src_ip"), F.collect_set("dst_ip")))
    ports = F.flatten(F.array(F.collect_set("src_port"), F.collect_set("dst_port")))
    counted = [
        F.count_if(F.col("tcp_flag").contains(flag)).alias(f"n_{flag.lower()}") for flag in COUNTED_FLAGS
    ]
    kept = [F.collect_list(F.struct("packet_no", *held)).alias("packets")] if held else []
    grouped = with_window_no(packets, size).groupBy(*keys, "window_no").agg(
        F.avg("payload_size").alias("avg_payload"),
        addresses.alias("_addresses"),
        ports.alias("_ports"),
        F.any_value("first_sender").alias("_sender"),
        *counted,
        *kept,
        F.count("*").alias("_n"),
    )
    servers = F.size(F.array_except("_addresses", F.array("_sender"))).cast("bigint")
    user_ports = F.size(F.array_except("_ports", F.array(F.lit(HTTPS_PORT)))).cast("bigint")
    return grouped.where(F.col("_n") == size).select(
        *keys,
        "window_no",
        "avg_payload",
        servers.alias("n_servers"),
        user_ports.alias("n_user_ports"),
        *[f"n_{flag.lower()}" for flag in COUNTED_FLAGS],
        *(["packets"] if held else []),
    )


def packets_with_features(packets: DataFrame, size: int, keys: list[str] = CASE) -> DataFrame:
    """Window features repeated on each packet; packets past the last full window are cut."""
    held = [c for c in packets.columns if c not in keys and c not in ("packet_no", "first_sender")]
    windows = full_windows(packets, size, keys, held)
    return windows.withColumn("_p", F.explode("packets")).select(
        *[c for c in windows.columns if c != "packets"], "_p.*"
    )


def route_windows(windows: DataFrame, state: Column, keys: list[str] = CASE) -> DataFrame:
    """Windows with held packets, routed to their state: one event row per packet."""
    event = F.col("_p")
    return windows.withColumn("state", state).withColumn("_p", F.explode("packets")).select(
        *keys,
        "state",
        "window_no",
        event["packet_no"].alias("packet_no"),
        event["ts"].alias("ts"),
        activity_name(event["direction"], event["tcp_flag"]).alias("activity"),
        event["payload_size"].cast("bigint").alias("payload_size"),
    )


def event_durations(
    events: DataFrame, keys: list[str], position: str = "packet_no", split: int | None = None
) -> DataFrame:
    """Seconds to the next event of the same trace.

    The last event, pairs without a timestamp, negative gaps and traces without
    a case id give no row.
    """
    named = events.where(F.col("case_id").isNotNull())
    following = next_row(named, keys, position, ["ts"], "_next", split)
    gap = seconds_between(F.col("ts"), F.col("_next.ts"))
    return following.withColumn("duration", gap).where("duration >= 0").drop("_next")
