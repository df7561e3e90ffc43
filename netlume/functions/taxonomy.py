"""Attack label to attack family. A label outside its taxonomy fails the job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The families that all datasets share.
FAMILIES = [
    "benign",
    "ddos_dos",
    "recon",
    "spoofing_mitm",
    "credential",
    "web_injection",
    "malware",
]


@dataclass(frozen=True)
class Taxonomy:
    name: str
    case: str  # "upper", "lower" or "keep"
    labels: dict[str, list[str]]  # family -> exact labels
    prefixes: dict[str, list[str]] = field(default_factory=dict)  # family -> label prefixes

    def family(self, label: Column) -> Column:
        value = F.trim(label)
        value = {"upper": F.upper, "lower": F.lower, "keep": lambda v: v}[self.case](value)
        rules = [(value.isin(names), family) for family, names in self.labels.items()]
        rules += [
            (value.startswith(p), family) for family, ps in self.prefixes.items() for p in ps
        ]
        out = None
        for test, family in rules:
            out = F.when(test, family) if out is None else out.when(test, family)
        unknown = F.concat(
            F.lit(f"Unknown {self.name} attack label: "), F.coalesce(label, F.lit("NULL"))
        )
        return out.otherwise(F.raise_error(unknown))


# Label sets of the three public datasets.
FLOW = Taxonomy(
    name="CICIoT2023",
    case="upper",
    labels={
        "benign": ["BENIGN"],
        "recon": ["VULNERABILITYSCAN"],
        "spoofing_mitm": ["DNS_SPOOFING", "MITM-ARPSPOOFING"],
        "credential": ["DICTIONARYBRUTEFORCE"],
        "web_injection": [
            "BROWSERHIJACKING",
            "COMMANDINJECTION",
            "SQLINJECTION",
            "UPLOADING_ATTACK",
            "XSS",
        ],
        "malware": ["BACKDOOR_MALWARE"],
    },
    prefixes={"ddos_dos": ["DDOS-", "DOS-", "MIRAI-"], "recon": ["RECON-"]},
)
EDGE = Taxonomy(
    name="Edge-IIoTset",
    case="keep",
    labels={
        "benign": ["Normal"],
        "recon": ["Fingerprinting", "Port_Scanning", "Vulnerability_scanner"],
        "spoofing_mitm": ["MITM"],
        "credential": ["Password"],
        "web_injection": ["SQL_injection", "Uploading", "XSS"],
        "malware": ["Backdoor", "Ransomware"],
    },
    prefixes={"ddos_dos": ["DDoS_"]},
)
TELEMETRY = Taxonomy(
    name="TON-IoT",
    case="lower",
    labels={
        "benign": ["normal"],
        "ddos_dos": ["ddos"],
        "recon": ["scanning"],
        "credential": ["password"],
        "web_injection": ["injection", "xss"],
        "malware": ["backdoor", "ransomware"],
    },
)
