"""Capture files to a packet table, and packets to capture files.

The data source `captures` plans byte ranges of files, so that a file of any size is read
by many tasks. A range starts at the first record header that heads a chain of plausible
headers; every range also tells where its first record starts and where the one after its
last would. Ranges whose start is not where the range before ends are read again from
there, so the result never depends on the guess. Packet numbers follow from the packet
counts of earlier ranges. Only TCP over IPv4 over Ethernet is kept. A file that cannot be
read gives one error row and no packets.

Tasks open files with pyarrow; for a store that only Spark reaches, read_files() and
decode_files() take whole files (at most 2 GB each) from Spark's reader.
"""

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from alarmloom.functions.packets import epoch_timestamp, ipv4_text, tcp_flag_names
from alarmloom.operators.sizing import cut_lineage, small_side
from alarmloom.operators.windows import with_direction
from alarmloom.schema import INGEST_ERROR_SCHEMA, TCP_FLAG_BITS
from alarmloom.shipping import ship_by_value

# Fixed values of the capture format: magic number to byte order and units per second.
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
ETHERNET, IPV4, TCP = 1, 0x0800, 6
VLAN_TAGS = (0x8100, 0x88A8)
FILE_HEADER, RECORD_HEADER = 24, 16

# Bytes of a file that one task decodes at a time.
RANGE_BYTES = 64 << 20
# Tasks that a small set of files is dealt to.
LEAST_TASKS = 32
# Bytes read past a range, for the frame headers of its last record.
MARGIN = 256 << 10
# What a plausible record header is, and how many in a row make a start.
LONGEST_FRAME, CHAIN, YEARS = 1 << 20, 32, 20 * 366 * 86_400

DECODED = pa.schema(
    [
        ("path", pa.string()),
        ("range_no", pa.int64()),
        ("packet_no", pa.int64()),
        ("epoch", pa.float64()),
        ("src", pa.int64()),
        ("dst", pa.int64()),
        ("src_port", pa.int32()),
        ("dst_port", pa.int32()),
        ("flag_bits", pa.int32()),
        ("payload_size", pa.int64()),
        # One row per range has these, and none of the above from packet_no on.
        ("start", pa.int64()),
        ("stop", pa.int64()),
        ("size", pa.int64()),
        ("first", pa.int64()),
        ("next", pa.int64()),
        ("n", pa.int64()),
        ("reason", pa.string()),
    ]
)
DECODED_SQL = """path string, range_no bigint, packet_no bigint, epoch double, src bigint, dst bigint, src_port int, dst_port int,
flag_bits int, payload_size bigint, start bigint, stop bigint, size bigint, first bigint, next bigint, n bigint, reason string"""


class Bytes:
    """A stretch of a file, read at absolute offsets by whole arrays."""

    def __init__(self, data: bytes, base: int):
        self.data, self.base, self.end = data, base, base + len(data)
        self.array = np.frombuffer(data, np.uint8)

    def number(self, at: np.ndarray, octets: int, order: str = ">") -> np.ndarray:
        """Unsigned numbers of some octets; places beyond the stretch read as its last byte."""
        out = np.zeros(len(at), np.int64)
        if not len(self.array):
            return out
        for k in range(octets) if order == ">" else reversed(range(octets)):
            out = out << 8 | self.array[np.minimum(at - self.base + k, len(self.array) - 1)]
        return out


def file_format(head: bytes) -> tuple[str, int]:
    """Byte order and time units of a capture, from its first bytes."""
    if len(head) < FILE_HEADER or head[:4] not in MAGIC:
        raise ValueError("not a capture file")
    order, units = MAGIC[head[:4]]
    if struct.unpack_from(order + "I", head, 20)[0] != ETHERNET:
        raise ValueError("link type is not Ethernet")
    return order, units


def record_places(held: Bytes, first: int, stop: int, size: int, order: str) -> tuple[np.ndarray, int, str | None]:
    """Offsets of the record headers from first to stop, the offset after the last record, and what is wrong."""
    length, data, shift = struct.Struct(order + "I").unpack_from, held.data, 8 - held.base
    places, at, reason = [], first, None
    while at < stop:
        if at + RECORD_HEADER > size:
            reason = "record header is cut off"
            break
        places.append(at)
        at += RECORD_HEADER + length(data, at + shift)[0]
    return np.array(places, np.int64), at, reason


def guess_start(held: Bytes, start: int, stop: int, size: int, order: str, units: int, seconds: int) -> int | None:
    """First offset in a range that heads a chain of plausible record headers; None if there is none."""
    read = struct.Struct(order + "IIII").unpack_from

    def plausible(at: int) -> int | None:
        """Offset of the next header, if there can be one at this offset."""
        if at + RECORD_HEADER > held.end:
            return None
        time, part, length, wire = read(held.data, at - held.base)
        good = part < units and length <= LONGEST_FRAME and length <= max(wire, 1) and abs(time - seconds) < YEARS
        return at + RECORD_HEADER + length if good else None

    def chained(at: int) -> bool:
        for known in range(CHAIN):
            following = plausible(at)
            if following is None:
                # The stretch or the file ends inside this header.
                return known > 0 and at <= size < at + RECORD_HEADER or known > 1 and at + RECORD_HEADER > held.end
            at = following
        return True

    window = 1 << 18
    for low in range(start, stop, window):
        at = np.arange(low, min(low + window, stop, held.end - RECORD_HEADER + 1), dtype=np.int64)
        if not len(at):
            return None
        time, part, length = (held.number(at + k, 4, order) for k in (0, 4, 8))
        good = (part < units) & (length <= LONGEST_FRAME) & (np.abs(time - seconds) < YEARS)
        for place in at[good].tolist():
            if chained(place):
                return place
    return None


def tcp_columns(held: Bytes, places: np.ndarray, size: int, order: str, units: int) -> list[np.ndarray]:
    """Time, addresses, ports, flags and payload length of the records that hold TCP over IPv4."""
    frame = places + RECORD_HEADER
    length = np.minimum(held.number(places + 8, 4, order), size - frame)
    at = np.full(len(places), 14, np.int64)
    kind = np.where(length >= 14, held.number(frame + 12, 2), 0)
    while (tagged := np.isin(kind, VLAN_TAGS)).any():
        inside = length >= at + 4
        kind = np.where(tagged, np.where(inside, held.number(frame + at + 2, 2), 0), kind)
        at = np.where(tagged, at + 4, at)
    ip, left = frame + at, length - at
    first = held.number(ip, 1)
    header, total = (first & 15) * 4, held.number(ip + 2, 2)
    good = (kind == IPV4) & (left >= 20) & (first >> 4 == 4) & (header >= 20)
    good &= (held.number(ip + 9, 1) == TCP) & (held.number(ip + 6, 2) & 0x1FFF == 0)
    segment = np.minimum(np.where(total == 0, left, total), left) - header
    tcp = ip + header
    offset = held.number(tcp + 12, 1) >> 4
    good &= (segment >= 20) & (offset >= 5)
    time = held.number(places, 4, order) + held.number(places + 4, 4, order) / units
    columns = [
        time,
        held.number(ip + 12, 4),
        held.number(ip + 16, 4),
        held.number(tcp, 2),
        held.number(tcp + 2, 2),
        held.number(tcp + 13, 1),
        np.maximum(0, segment - offset * 4),
    ]
    return [c[good] for c in columns]


def decode_range(
    path: str, range_no: int, start: int, stop: int, size: int, head: bytes, data: bytes, first: int | None = None
) -> pa.RecordBatch:
    """Packets of a byte range and a row about the range; data begins at start, or at first if that is given."""
    base = start if first is None else first
    found, next_, reason, columns = None, None, None, [np.empty(0)] * 7
    try:
        order, units = file_format(head)
        held = Bytes(data, base)
        if first is None and range_no == 0:
            first, held = FILE_HEADER, Bytes(data[FILE_HEADER - start :], FILE_HEADER)
        elif first is None:
            seconds = struct.unpack_from(order + "I", head, FILE_HEADER)[0]
            first = guess_start(held, start, stop, size, order, units, seconds)
        if first is not None and first < stop:
            places, next_, reason = record_places(held, first, stop, size, order)
            found = first if len(places) or reason else None
            columns = tcp_columns(held, places, size, order, units)
    except ValueError as error:
        reason = str(error)
    n = len(columns[0])
    packet = [np.full(n, range_no), np.arange(1, n + 1), *columns]
    about = [start, stop, size, found, next_, n, reason]
    arrays = [pa.array([path] * (n + 1), pa.string())]
    for field, values in zip(list(DECODED)[1:10], packet):
        last = range_no if field.name == "range_no" else None
        arrays.append(pa.concat_arrays([pa.array(values.astype(field.type.to_pandas_dtype())), pa.array([last], field.type)]))
    for field, value in zip(list(DECODED)[10:], about):
        arrays.append(pa.concat_arrays([pa.nulls(n, field.type), pa.array([value], field.type)]))
    return pa.RecordBatch.from_arrays(arrays, schema=DECODED)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it, of a path or URI."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def read_range(path: str, range_no: int, start: int, stop: int, size: int, first: int | None = None) -> pa.RecordBatch:
    """decode_range() on the bytes of a file."""
    store, inside = open_store(path)
    with store.open_input_file(inside) as file:
        head = file.read_at(min(size, FILE_HEADER + RECORD_HEADER), 0)
        base = start if first is None else first
        data = file.read_at(max(0, min(size, stop + MARGIN) - base), base)
    return decode_range(path, range_no, start, stop, size, head, data, first)


class CaptureReader(DataSourceReader):
    """Byte ranges of all `.pcap` files below a path; small ones share a task."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        store, inside = open_store(self.path)
        start = self.path[: len(self.path) - len(inside)] if self.path.endswith(inside) else ""
        info = store.get_file_info(inside)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(inside, recursive=True))
        files = sorted((f for f in found if f.is_file and f.path.endswith(".pcap")), key=lambda f: f.path)
        task_bytes = max(1, min(RANGE_BYTES, sum(f.size for f in files) // LEAST_TASKS))
        parts, ranges, held = [], [], 0
        for file in files:
            for number, low in enumerate(range(0, max(file.size, 1), self.range_bytes)):
                high = min(low + self.range_bytes, file.size)
                if ranges and held + high - low > task_bytes:
                    parts.append(InputPartition(ranges))
                    ranges, held = [], 0
                ranges.append((start + file.path, number, low, high, file.size))
                held += high - low
        return [*parts, InputPartition(ranges)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for one in partition.value:
            yield read_range(*one)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class CaptureWriter(DataSourceArrowWriter):
    """Files of the `record` bytes of their rows in order; rows come with a file's rows together.

    A task writes under names of its own. Commit gives them their final names, abort removes them.
    """

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, inside = open_store(self.path)
        files, out, name = [], None, None
        try:
            for batch in iterator:
                names, records = batch.column("path"), batch.column("record").cast(pa.large_binary())
                ends = np.frombuffer(records.buffers()[1], np.int64)[records.offset : records.offset + len(records) + 1]
                bytes_ = records.buffers()[2]
                changes = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
                for low, high in zip(changes, changes[1:]):
                    if low == high:
                        continue
                    if names[low].as_py() != name:
                        if out is not None:
                            out.close()
                        name = names[low].as_py()
                        final = f"{inside}/{name}"
                        store.create_dir(final.rsplit("/", 1)[0], recursive=True)
                        files.append((f"{final}.{uuid.uuid4().hex}", final))
                        out = store.open_output_stream(files[-1][0])
                    if ends[high] > ends[low]:
                        out.write(bytes_.slice(int(ends[low]), int(ends[high] - ends[low])))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = open_store(self.path)
        for message in messages:
            for own, final in message.files if message else []:
                store.move(own, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = open_store(self.path)
        for message in messages:
            for own, _ in message.files if message else []:
                store.delete_file(own)


class CaptureSource(DataSource):
    """`spark.read.format("captures")` and `df.write.format("captures")`."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return DECODED_SQL

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return CaptureWriter(self.options)


def register(spark: SparkSession) -> None:
    ship_by_value()
    spark.dataSource.register(CaptureSource)


def scan(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Decoded records of all `.pcap` files below a path, with one row about each byte range."""
    register(spark)
    rows = spark.read.format("captures").option("rangebytes", range_bytes).load(path)
    return _with_exact_starts(cut_lineage(rows))


def _with_exact_starts(rows: DataFrame) -> DataFrame:
    """Ranges whose first record is not the one after the range before are read again from there.

    The first range of a file starts right; so each round rights at least one more in
    every file that needs it, and all that follow from it.
    """
    while True:
        earlier = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
        ranges = rows.where("n is not null").withColumn("entry", F.max("next").over(earlier))
        expected = F.when(F.col("entry") < F.col("stop"), F.col("entry"))
        wrong = ranges.where(F.col("range_no") > 0).where(~F.col("first").eqNullSafe(expected)).where("entry is not null")
        redo = wrong.groupBy("path").agg(F.min_by(F.struct("range_no", "start", "stop", "size", "entry"), "range_no").alias("r")).select("path", "r.*")
        redo = cut_lineage(redo)
        if redo.isEmpty():
            return rows
        rest = rows.join(redo.select("path", "range_no"), ["path", "range_no"], "left_anti").select(*rows.columns)

        def again(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield read_range(row["path"], row["range_no"], row["start"], row["stop"], row["size"], row["entry"])

        rows = cut_lineage(rest.unionByName(redo.mapInArrow(again, DECODED_SQL)))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and content of all `.pcap` files below a path."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").option("recursiveFileLookup", True)
    return reader.load(path).select("path", "content")


def decode_files(files: DataFrame) -> DataFrame:
    """Decoded records of whole capture files (path, content), as one range each."""
    ship_by_value()

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                data = content.as_py()
                yield decode_range(name.as_py(), 0, 0, len(data), len(data), data[: FILE_HEADER + RECORD_HEADER], data)

    return files.mapInArrow(decode, DECODED_SQL)


def packets_of(decoded: DataFrame, rotated: bool = False) -> DataFrame:
    """Packet table: label from the folder name, case id from the file name, numbers from 1 in each case.

    With rotated, the files x.pcap, x.1.pcap, x.2.pcap ... are one case x.pcap, in this order.
    """
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    place = F.coalesce(F.regexp_extract(name, r"\.(\d+)\.pcap$", 1).try_cast("bigint"), F.lit(0).cast("bigint")) if rotated else F.lit(0)
    case = F.regexp_replace(name, r"\.\d+\.pcap$", ".pcap") if rotated else name
    ranges = decoded.where("n is not null").withColumns({"label": F.element_at(parts, -2), "case_id": case, "rotation": place})
    earlier = Window.partitionBy("label", "case_id").orderBy("rotation", "range_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    offsets = (
        ranges.withColumn("n", F.when(F.count("reason").over(whole) > 0, 0).otherwise(F.col("n")))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .where("n > 0")
        .select("path", "range_no", "label", "case_id", "before")
    )
    return decoded.where("n is null").join(small_side(offsets), ["path", "range_no"]).select(
        "label",
        "case_id",
        (F.col("packet_no") + F.col("before")).alias("packet_no"),
        epoch_timestamp(F.col("epoch")).alias("ts"),
        ipv4_text(F.col("src")).alias("src_ip"),
        ipv4_text(F.col("dst")).alias("dst_ip"),
        "src_port",
        "dst_port",
        tcp_flag_names(F.col("flag_bits")).alias("tcp_flag"),
        "payload_size",
    )


def read_captures(
    spark: SparkSession, path: str, split: int | None = None, range_bytes: int = RANGE_BYTES, rotated: bool = False
) -> DataFrame:
    """Packets with client address and direction."""
    return with_direction(packets_of(scan(spark, path, range_bytes), rotated), split=split)


def ingest_errors(decoded: DataFrame) -> DataFrame:
    """Files that could not be read, and why."""
    failed = decoded.where(F.col("reason").isNotNull())
    return failed.groupBy("path").agg(F.min_by("reason", "range_no").alias("reason")).select(*INGEST_ERROR_SCHEMA.names)


def packet_record(packets: DataFrame) -> Column:
    """Bytes of a capture record (big-endian, microseconds) of each packet; payloads are zeros."""

    def big(value: Column, octets: int) -> Column:
        return F.lpad(F.hex(value), 2 * octets, "0")

    def address(text: Column) -> Column:
        return F.concat(*[big(F.split(text, r"\.")[i].cast("bigint"), 1) for i in range(4)])

    names = F.split("tcp_flag", r"\+")
    bits = sum((F.when(F.array_contains(names, name), bit).otherwise(0) for bit, name in TCP_FLAG_BITS), F.lit(0)).cast("bigint")
    micros, length = F.unix_micros("ts"), F.lit(54) + F.col("payload_size")
    return F.unhex(
        F.concat(
            big(F.floor(micros / 1_000_000), 4),
            big(micros % 1_000_000, 4),
            big(length, 4),
            big(length, 4),
            F.lit("00" * 12 + "0800" + "4500"),
            big(F.lit(40) + F.col("payload_size"), 2),
            F.lit("00000000" + "4006" + "0000"),
            address(F.col("src_ip")),
            address(F.col("dst_ip")),
            big(F.col("src_port").cast("bigint"), 2),
            big(F.col("dst_port").cast("bigint"), 2),
            F.lit("00" * 8 + "50"),
            big(bits, 1),
            F.lit("00" * 6),
            F.repeat(F.lit("00"), F.col("payload_size").cast("int")),
        )
    )


HEADER = bytes.fromhex("A1B2C3D4" + "00020004" + "00" * 8 + "0000FFFF" + "00000001")


def rotated_records(packets: DataFrame, file_packets: int) -> DataFrame:
    """path, packet_no and record of numbered packets, a new file after every file_packets; record 0 is the file header."""
    piece = F.floor((F.col("packet_no") - 1) / file_packets)
    suffix = F.when(piece > 0, F.concat(F.lit("."), piece.cast("string"))).otherwise("")
    path = F.concat_ws("/", "label", F.concat("case_id", suffix, F.lit(".pcap")))
    rows = packets.select(path.alias("path"), "packet_no", packet_record(packets).alias("record"))
    first = (F.col("packet_no") - 1) % file_packets == 0
    return rows.unionByName(
        packets.where(first).select(path.alias("path"), F.lit(0).cast("bigint").alias("packet_no"), F.lit(HEADER).alias("record"))
    )


def write_records(records: DataFrame, path: str) -> None:
    """Files of the records (path, packet_no, record), each written by one task, in order of packet_no."""
    register(records.sparkSession)
    ordered = records.repartition("path").sortWithinPartitions("path", "packet_no")
    ordered.select("path", "record").write.format("captures").mode("append").save(path)


def write_captures(packets: DataFrame, path: str, file_packets: int = 1_000_000) -> None:
    """Numbered packets as rotated capture files below a path: label/case.pcap, label/case.1.pcap, ..."""
    write_records(rotated_records(packets, file_packets), path)
