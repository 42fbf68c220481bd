"""Predicates over alerts, and the composite report filter."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import in_window
from ..knowledge import NOISE_IPS, USER_AGENTS


def array_any(column: str, values: list[str]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, values)))


def exists(column: str, is_array: bool = False) -> Column:
    c = F.col(column)
    return c.isNotNull() & (F.size(c) > 0) if is_array else c.isNotNull()


def missing(column: str, is_array: bool = False) -> Column:
    return ~exists(column, is_array)


def wildcard(column: str, pattern: str) -> Column:
    """``*`` for any run, ``?`` for one character; other characters stand for themselves."""
    escaped = re.sub(r"([\\%_])", r"\\\1", pattern).replace("*", "%").replace("?", "_")
    return F.col(column).like(escaped)


def mentions_ip(ip: str, columns: list[str], log: str | None = None) -> Column:
    """Equality in any column, or the whole address (not part of another) in the log text."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c) == ip, F.lit(False))
    if log:
        out = out | F.coalesce(F.col(log).rlike(rf"(?<![0-9.]){re.escape(ip)}(?![0-9]|\.[0-9])"), F.lit(False))
    return out


def keyword_search(columns: list[str], all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = (), phrases: list[str] = ()) -> Column:
    """Terms and phrases, without case, in any of the columns."""
    hay = F.lower(F.concat_ws(" ", *columns))
    out = F.lit(True)
    for word in [*all_of, *phrases]:
        out = out & hay.contains(word.lower())
    if any_of:
        some = F.lit(False)
        for word in any_of:
            some = some | hay.contains(word.lower())
        out = out & some
    for word in none_of:
        out = out & ~hay.contains(word.lower())
    return out


def geo_box(lat: str, lon: str, corner: tuple[float, float], other: tuple[float, float]) -> Column:
    """Inside the box of two corners; a box outside the globe filters nothing."""
    (a, b), (c, d) = corner, other
    if not (all(-90 <= x <= 90 for x in (a, c)) and all(-180 <= x <= 180 for x in (b, d))):
        return F.lit(True)
    return F.col(lat).between(min(a, c), max(a, c)) & F.col(lon).between(min(b, d), max(b, d))


def compliance(column: str, values: list[str] | None) -> Column:
    """Any of the values; with none given, any control at all."""
    return array_any(column, values) if values else exists(column, is_array=True)


def vulnerability(cve: str | None = None, severity: str | None = None, columns: tuple[str, str] = ("cve", "severity")) -> Column:
    """Vulnerability rows of a CVE (letters of either case) and a severity."""
    out = F.lit(True)
    if cve:
        out = out & (F.upper(columns[0]) == cve.strip().upper())
    return out & (F.lower(columns[1]) == severity.lower()) if severity else out


def file_change(event: str | None = None, path: str | None = None, columns: tuple[str, str] = ("event", "path")) -> Column:
    """File-integrity rows of an event type whose path fits a wildcard."""
    out = F.lit(True)
    if event:
        out = out & (F.lower(columns[0]) == event.lower())
    return out & wildcard(columns[1], path) if path else out


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")


def is_public_ip(ip: Column) -> Column:
    """A proper IPv4 address outside private, loopback, link-local, shared, multicast and reserved ranges."""
    parts = F.split(ip, r"\.")
    a, b = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    private = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    return F.coalesce(is_ipv4(ip) & ~private, F.lit(False))


def is_noise_ip(ip: Column) -> Column:
    return ip.isin(NOISE_IPS) | ip.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")


def user_agent_label(agent: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, label in reversed(USER_AGENTS):
        out = F.when(agent.rlike(pattern), label).otherwise(out)
    return out


@dataclass
class ReportFilters:
    """Optional dimensions of a report; every one that is given must hold.  Lists mean any of."""

    since: datetime | None = None
    until: datetime | None = None
    srcips: list[str] = field(default_factory=list)
    agents: list[str] = field(default_factory=list)
    agent_ids: list[str] = field(default_factory=list)
    agent_ips: list[str] = field(default_factory=list)
    decoders: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    rule_ids: list[str] = field(default_factory=list)
    response_codes: list[str] = field(default_factory=list)
    methods: list[str] = field(default_factory=list)
    rule_groups: list[str] = field(default_factory=list)
    tactics: list[str] = field(default_factory=list)
    techniques: list[str] = field(default_factory=list)
    min_level: int | None = None
    max_level: int | None = None
    min_response_size: int | None = None
    max_response_size: int | None = None
    min_firedtimes: int | None = None
    max_firedtimes: int | None = None
    has_geo: bool | None = None
    url: str | None = None
    referrer: str | None = None
    domain_pattern: str | None = None
    location: str | None = None
    domain_contains: str | None = None
    user_agent_contains: str | None = None
    description_contains: str | None = None
    box: tuple[tuple[float, float], tuple[float, float]] | None = None

    #: filter -> column (of the flat alert table)
    columns: dict[str, str] = field(default_factory=lambda: dict(srcips="srcip", agents="agent_name", agent_ids="agent_id", agent_ips="agent_ip", decoders="decoder_name", countries="country_name", rule_ids="rule_id", response_codes="response_code", methods="method", rule_groups="rule_groups", tactics="tactic", techniques="technique", level="rule_level", response_size="response_size", firedtimes="firedtimes", url="url", referrer="referrer", domain_pattern="domain", location="location", domain_contains="domain", user_agent_contains="user_agent", description_contains="description", lat="latitude", lon="longitude", ts="ts"))

    def condition(self) -> Column:
        c, out = self.columns, []
        if self.since or self.until:
            out.append(in_window(c["ts"], self.since or datetime(1, 1, 1), self.until or datetime(9999, 1, 1)))
        for name in ("srcips", "agents", "agent_ids", "agent_ips", "decoders", "countries", "rule_ids", "response_codes", "methods"):
            if getattr(self, name):
                out.append(F.col(c[name]).isin(getattr(self, name)))
        out += [array_any(c[n], getattr(self, n)) for n in ("rule_groups", "tactics", "techniques") if getattr(self, n)]
        for name in ("level", "response_size", "firedtimes"):
            if (low := getattr(self, f"min_{name}")) is not None:
                out.append(F.col(c[name]) >= low)
            if (high := getattr(self, f"max_{name}")) is not None:
                out.append(F.col(c[name]) <= high)
        if self.has_geo is not None:
            out.append(F.col(c["lat"]).isNotNull() == F.lit(self.has_geo))
        out += [wildcard(c[n], getattr(self, n)) for n in ("url", "referrer", "domain_pattern", "location") if getattr(self, n)]
        out += [F.col(c[n]).contains(getattr(self, n)) for n in ("domain_contains", "user_agent_contains", "description_contains") if getattr(self, n)]
        if self.box:
            out.append(geo_box(c["lat"], c["lon"], *self.box))
        whole = F.lit(True)
        for one in out:
            whole = whole & one
        return whole

    def given(self) -> list[str]:
        return [f.name for f in fields(self) if f.name != "columns" and getattr(self, f.name) not in (None, [])]


def report_filter(alerts: DataFrame, filters: ReportFilters) -> DataFrame:
    return alerts.where(filters.condition())


def drill_through(alerts: DataFrame, srcip: str | None = None, rule_id: str | None = None, agent: str | None = None, n: int = 50, columns: list[str] | None = None) -> DataFrame:
    """First ``n`` alerts of a slice by time and id."""
    for name, value in (("srcip", srcip), ("rule_id", rule_id), ("agent_name", agent)):
        if value is not None:
            alerts = alerts.where(F.col(name) == value)
    return alerts.select(*(columns or alerts.columns)).orderBy("ts", "alert_id").limit(n)
