"""Scalar derivations as column expressions: time, clamping, tiers, ports, tactics, zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ports counted as common, and codes counted as failed look-ups.
COMMON_PORTS = (80, 443, 22, 53, 25, 445, 3389)
FAILED_LOOKUPS = ("NXDOMAIN", "SERVFAIL")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(timestamp: str) -> Column:
    """Epoch microseconds of a TIMESTAMP_NTZ column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {timestamp})")


def parse_time(text: str | Column) -> Column:
    """A timestamp from ISO 8601 text (with Z, an offset or none, read as UTC) or from an epoch number in text; null where it is neither."""
    text = col(text).cast("string")
    number = text.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), F.timestamp_micros(F.round(number * 1_000_000).cast("long"))), F.try_to_timestamp(text))


def alert_time(text: str | Column) -> Column:
    """A timestamp from ISO 8601 text, with Z, an offset or none (read as UTC); null for anything else, an epoch number among it."""
    text = col(text).cast("string")
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(text))


def clamp(value: str | Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col(value)))


def share_sent(sent: str | Column, total: Column) -> Column:
    """Bytes sent over all bytes; 0 without bytes."""
    return F.when(total > 0, col(sent) / total).otherwise(0.0)


def sent_per_received(sent: str | Column, received: str | Column) -> Column:
    """Bytes sent over bytes received; 1 where none were received."""
    return F.when(col(received) > 0, col(sent) / col(received)).otherwise(1.0)


def is_common_port(port: str | Column, ports: tuple[int, ...] = COMMON_PORTS) -> Column:
    return col(port).isin(*(ports or COMMON_PORTS))


def hour_of_day(us: str | Column) -> Column:
    return F.floor(F.pmod(col(us), F.lit(86_400_000_000)) / 3_600_000_000).cast("int")


def day_of_week(us: str | Column) -> Column:
    """0 for Monday; the epoch began on a Thursday."""
    return F.pmod(F.floor(col(us) / 86_400_000_000) + 3, F.lit(7)).cast("int")


def is_nxdomain(rcode: str | Column) -> Column:
    return col(rcode).isin(*FAILED_LOOKUPS)


def severity_label(score: str | Column) -> Column:
    score = col(score)
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").otherwise("low")


def playbook(label: str | Column, routes: dict[str, str] | None = None) -> Column:
    """The response playbook of a severity label; unknown labels take that of "low"."""
    routes = routes or {"critical": "isolate-host", "high": "block-and-investigate", "medium": "investigate", "low": "log-only"}
    table = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    return F.coalesce(table[col(label)], F.lit(routes["low"]))


#: Address prefixes of the network's zones, in order, and the kind of device in a zone.
ZONES = (("10.0.0.", "dmz"), ("10.1.0.", "core"), ("10.2.0.", "lan"), ("10.3.0.", "iot"), ("10.", "lan"), ("192.168.", "lan"), ("172.", "lan"))
ZONE_KINDS = {"internet": "external", "dmz": "server", "core": "server", "lan": "workstation", "iot": "iot"}


def zone(ip: str | Column, prefixes: tuple[tuple[str, str], ...] = ZONES) -> Column:
    """The first zone whose prefix an address has; none, pseudonyms (more than 15 characters) and others are the internet."""
    ip = F.coalesce(col(ip), F.lit(""))
    out = F.when(F.length(ip) > 15, "internet")
    for prefix, name in prefixes:
        out = out.when(ip.startswith(prefix), name)
    return out.otherwise("internet")


def zone_kind(zone_: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ZONE_KINDS.items() for x in pair])
    return F.coalesce(table[col(zone_)], F.lit("unknown"))


def link_score(total_bytes: str | Column) -> Column:
    return F.when(col(total_bytes) > 1_000_000, 0.85).when(col(total_bytes) > 100_000, 0.55).otherwise(0.25)


def link_is_anomalous(state: str | Column, score: Column) -> Column:
    return F.coalesce(col(state).isin("S0", "REJ", "S1"), F.lit(False)) | (score > 0.7)


def device_risk(incidents: str | Column, high: int = 200_000, medium: int = 100_000, low: int = 50_000) -> Column:
    n = col(incidents)
    return F.when(n > high, "critical").when(n > medium, "high").when(n > low, "medium").otherwise("low")


#: Words of attack tactics and their event types; the first rule that holds wins.
TACTIC_TYPES = (
    (("exfiltration",), "exfiltration"),
    (("command and control", "c2"), "c2_beaconing"),
    (("lateral",), "lateral_movement"),
    (("discovery", "reconnaissance"), "scan"),
    (("credential",), "credential_theft"),
)


def tactic_event_type(tactic: str | Column) -> Column:
    """Event type of an attack tactic: the first rule of which the tactic contains a word; anomaly without one."""
    name, out = F.lower(F.coalesce(col(tactic), F.lit(""))), None
    for words, kind in TACTIC_TYPES:
        hit = name.contains(words[0])
        for word in words[1:]:
            hit = hit | name.contains(word)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("anomaly")


def severity_rank(severity: str | Column, order: tuple[str, ...] = ("low", "medium", "high", "critical")) -> Column:
    """Place in ``order`` from 0, in any case; unknown severities are the lowest."""
    return F.greatest(F.array_position(F.array(*[F.lit(s) for s in order]), F.lower(F.coalesce(col(severity), F.lit("")))) - 1, F.lit(0)).cast("int")


def at_least(severity: str | Column, minimum: str) -> Column:
    return severity_rank(severity) >= severity_rank(F.lit(minimum))


def deterministic_id(*parts: str | Column) -> Column:
    """An id that recomputation gives again, in place of a random one."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)
