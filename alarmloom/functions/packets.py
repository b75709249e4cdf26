"""Column expressions over packet fields."""

from pyspark.sql import Column, functions as F

from alarmloom.schema import NO_FLAG, TCP_FLAG_BITS


def tcp_flag_names(bits: Column) -> Column:
    """Names of the set header bits joined by '+', or OTHER when none is set."""
    names = [F.when(bits.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in TCP_FLAG_BITS]
    joined = F.concat_ws("+", *names)
    return F.when(joined == "", F.lit(NO_FLAG)).otherwise(joined)


def likely_client(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column) -> Column:
    """The side with the higher port, seen from one packet."""
    return F.when(src_port > dst_port, src_ip).otherwise(dst_ip)


def direction(src_ip: Column, client_ip: Column) -> Column:
    return F.when(src_ip == client_ip, F.lit("C_to_S")).otherwise(F.lit("S_to_C"))


def activity_name(direction_col: Column, flag_col: Column) -> Column:
    return F.concat_ws("_", direction_col, flag_col)


def ipv4_text(packed: Column) -> Column:
    """A 32-bit address held in a long, as dotted text."""
    octets = [F.shiftright(packed, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def epoch_timestamp(seconds: Column) -> Column:
    """Epoch seconds (double) to a timestamp, to the microsecond."""
    return F.timestamp_micros(F.round(seconds * F.lit(1e6)).cast("bigint"))


def payload_or_zero(value: Column) -> Column:
    """Payload as double; missing or unreadable values count as 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)).cast("double") / F.lit(1e6)
