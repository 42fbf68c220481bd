"""The alert table: its declared schema and the alert view over an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
_A = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Nested schema of stored alerts; unknown fields go to ``data.rest``.
ALERT = _struct(
    alert_id=_S,
    ts=T.TimestampType(),
    agent=_struct(id=_S, name=_S, ip=_S),
    rule=_struct(id=_S, level=T.IntegerType(), description=_S, groups=_A, firedtimes=T.IntegerType(), mitre=_struct(id=_A, tactic=_A), cis=_A, pci_dss=_A, gdpr=_A, hipaa=_A, nist_800_53=_A),
    data=_struct(srcip=_S, srcip2=_S, dstip=_S, domain=_S, url=_S, method=_S, user_agent=_S, referrer=_S, response_code=_S, response_size=T.LongType(), account=_S, email=_S, srcuser=_S, dstuser=_S, error=_S, rest=T.MapType(_S, _S)),
    geo=_struct(country_name=_S, city_name=_S, latitude=T.DoubleType(), longitude=T.DoubleType()),
    decoder_name=_S,
    location=_S,
    full_log=_S,
    syscheck=_struct(event=_S, path=_S),
    vulnerability=_struct(cve=_S, severity=_S),
)


def _by_type(column: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def alerts_from_events(events: DataFrame) -> DataFrame:
    """Flat alert view of an event table; deterministic, a projection without shuffle."""
    kind, u = F.col("event_type"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("long")
    first = _by_type(kind, {"view": "Reconnaissance", "click": "Discovery", "error": "Credential Access", "signup": "Initial Access", "purchase": "Exfiltration"})
    tactics = F.when(k % 10 == 2, F.array(first, F.lit("Command and Control"))).otherwise(F.array(first))
    octet = lambda by: (F.floor(u / by) % 256).cast("string")
    return events.select(
        F.col("event_id").alias("alert_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws(".", F.lit("45"), octet(65536), octet(256), octet(1)).alias("srcip"),
        (F.floor("value") % 15 + 1).cast("int").alias("rule_level"),
        _by_type(kind, {"view": "33100", "click": "5710", "error": "5712", "signup": "5501", "purchase": "510"}).alias("rule_id"),
        F.array(kind).alias("rule_groups"),
        F.when(~(k % 10).isin(0, 1), tactics).alias("tactic"),
        F.when(k % 10 == 0, F.array(_by_type(kind, {"view": "T1595", "click": "T1046", "error": "T1110", "signup": "T1190", "purchase": "T1041"}))).alias("technique"),
        F.concat(F.lit("agent-"), (k % 8).cast("string")).alias("agent_name"),
        F.col("value"),
    )


def resolve_srcip(*paths: Column) -> Column:
    """First address that is neither null, empty nor ``-``."""
    clean = [F.when((p != "") & (p != "-"), p) for p in paths]
    return F.coalesce(*clean)
