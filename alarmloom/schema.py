"""Column layouts and fixed values shared by the package."""

from pyspark.sql import types as T

# Class labels and alarm labels.
NORMAL = 1
ATTACK = -1
FALSE_ALARM = "FP"
TRUE_ALARM = "TP"

# TCP header bits, in the order in which names are joined.
TCP_FLAG_BITS = [
    (0x02, "SYN"),
    (0x10, "ACK"),
    (0x01, "FIN"),
    (0x04, "RST"),
    (0x08, "PSH"),
    (0x20, "URG"),
]
NO_FLAG = "OTHER"
HTTPS_PORT = 443

# Window features, in column order.
WINDOW_FEATURES = [
    "avg_payload",
    "n_servers",
    "n_user_ports",
    "n_ack",
    "n_syn",
    "n_fin",
    "n_psh",
    "n_rst",
]
COUNTED_FLAGS = ["ACK", "SYN", "FIN", "PSH", "RST"]

# Alarm bands with inclusive upper bounds; the last one is open.
BANDS = [
    ("BAND_0_1", 0.01),
    ("BAND_1_25", 0.25),
    ("BAND_25_75", 0.75),
    ("BAND_75_99", 0.99),
    ("BAND_99_100", None),
]

INGEST_ERROR_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
