"""What differs between the datasets: columns, targets and cleaning rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from netlume.functions.taxonomy import EDGE, FLOW, TELEMETRY, Taxonomy


@dataclass(frozen=True)
class DatasetSpec:
    dataset: str
    kind: str  # "flow", "edge" or "telemetry": the cleaning rules
    taxonomy: Taxonomy
    label: str  # raw column with the attack name
    target_binary: str
    target_multi: str
    target_family: str = "label_family"
    benign: str = "Normal"
    features: list[str] = field(default_factory=list)  # flow only: the columns to keep
    drop: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    sample_n: int | None = None
    encoding: str = "onehot"
    row_key: list[str] | None = None  # columns that order the rows; the whole row if unset

    @property
    def targets(self) -> list[str]:
        return [self.target_binary, self.target_multi, self.target_family]


# Columns and sample sizes of the three public datasets.
FLOW_FEATURES = [
    "Header_Length", "Protocol Type", "Time_To_Live", "Rate",
    "fin_flag_number", "syn_flag_number", "rst_flag_number", "psh_flag_number",
    "ack_flag_number", "ece_flag_number", "cwr_flag_number",
    "ack_count", "syn_count", "fin_count", "rst_count",
    "HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH", "IRC", "TCP", "UDP", "DHCP", "ARP", "ICMP",
    "IGMP", "IPv", "LLC",
    "Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "IAT", "Number", "Variance",
]
EDGE_DROP = [
    "frame.time", "ip.src_host", "ip.dst_host", "arp.dst.proto_ipv4", "arp.src.proto_ipv4",
    "http.file_data", "http.request.uri.query", "http.request.full_uri", "icmp.transmit_timestamp",
    "tcp.options", "tcp.payload", "tcp.srcport", "tcp.dstport", "udp.port", "mqtt.msg",
    "mqtt.msg_decoded_as", "dns.qry.name",
]
EDGE_CATEGORICAL = [
    "http.request.method", "http.referer", "http.request.version", "mqtt.protoname", "mqtt.topic",
]

FLOW_SPEC = DatasetSpec(
    dataset="CICIoT2023",
    kind="flow",
    taxonomy=FLOW,
    label="Label",
    target_binary="label_binary",
    target_multi="label_multi",
    benign="BENIGN",
    features=FLOW_FEATURES,
    sample_n=2_000_000,
)
EDGE_SPEC = DatasetSpec(
    dataset="Edge-IIoTset",
    kind="edge",
    taxonomy=EDGE,
    label="Attack_type",
    target_binary="Attack_label",
    target_multi="Attack_type",
    drop=EDGE_DROP,
    categorical=EDGE_CATEGORICAL,
    sample_n=500_000,
)
TELEMETRY_SPEC = DatasetSpec(
    dataset="TON-IoT",
    kind="telemetry",
    taxonomy=TELEMETRY,
    label="type",
    target_binary="label_binary",
    target_multi="label_multi",
    drop=["date", "time", "label", "type"],
    sample_n=1_000_000,
)
