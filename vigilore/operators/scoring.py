"""Risk correlation of source addresses over three categories, and the unified verdict."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import in_window
from ..functions.scanning import on
from ..knowledge import GROUP_TOKENS, TACTICS

CATEGORIES = ("A", "B", "C")
TIERS = ((60, 50.0, 3.0), (1440, 40.0, 2.5), (10080, 35.0, 2.0))  # minutes, threshold, z


def normal_tactic(tactic: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(tactic)), "-", " ")


def _lookup(position: int) -> Column:
    """Map from normal tactic to its category or weight: 14 literals, folded into the plan."""
    entries = [x for name, v in TACTICS.items() for x in (F.lit(name.lower()), F.lit(v[position]))]
    return F.create_map(*entries)


def tactic_category(tactic: Column) -> Column:
    """A, B, C, or null for an unknown tactic."""
    return F.try_element_at(_lookup(0), normal_tactic(tactic))


def tactic_weight(tactic: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(1), normal_tactic(tactic)), F.lit(1.0))


def category_mean(category: str) -> float:
    weights = [w for c, w in TACTICS.values() if c == category]
    return sum(weights) / len(weights)


def category_risks(alerts: DataFrame, techniques: DataFrame | None = None, use_mitre: bool = True, groups: dict[str, list[str]] | None = None, keys: tuple[str, ...] = ("srcip",)) -> DataFrame:
    """(keys, alert_id, category, risk): one row per alert and category it belongs to.

    Tactics decide; only without tactics the techniques do, only without either the
    rule groups.  An alert in a category is charged for all its tactics, a technique
    with its largest weight inside the category, a group with the category's mean.
    ``techniques(technique, tactic)`` is the technique table.
    """
    groups = groups or GROUP_TOKENS
    tactics = F.coalesce("tactic", F.array().cast("array<string>"))
    means = F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), F.lit(category_mean(c)))])
    base = alerts.select(*keys, "alert_id", "rule_level", tactics.alias("tactics"), F.coalesce("technique", F.array().cast("array<string>")).alias("techniques"), "rule_groups")
    by_group = F.array_compact(F.array(*[F.when(F.arrays_overlap("rule_groups", F.array(*map(F.lit, tokens))), c) for c, tokens in groups.items()]))
    group_only = F.lit(True) if not use_mitre else (F.size("tactics") == 0) & (F.size("techniques") == 0)
    from_groups = base.where(group_only).select(*keys, "alert_id", "rule_level", F.explode(by_group).alias("category"))
    from_groups = from_groups.select(*keys, "alert_id", "category", (F.col("rule_level") * F.element_at(means, F.col("category"))).alias("risk"))
    if not use_mitre:
        return from_groups
    categories = F.array_compact(F.array_distinct(F.transform("tactics", lambda t: tactic_category(t))))
    charge = F.aggregate(F.transform("tactics", lambda t: tactic_weight(t)), F.lit(0.0), lambda a, w: a + w)
    from_tactics = base.where(F.size("tactics") > 0).select(*keys, "alert_id", F.explode(categories).alias("category"), (F.col("rule_level") * charge).alias("risk"))
    out = from_tactics.unionByName(from_groups)
    if techniques is not None:
        known = techniques.select(F.upper(F.trim("technique")).alias("_t"), tactic_category(F.col("tactic")).alias("category"), tactic_weight(F.col("tactic")).alias("w")).where("category is not null")
        weights = known.groupBy("_t", "category").agg(F.max("w").alias("w"))
        single = base.where((F.size("tactics") == 0) & (F.size("techniques") > 0)).select(*keys, "alert_id", "rule_level", F.explode("techniques").alias("_x"))
        met = single.join(weights, F.upper(F.trim("_x")) == F.col("_t"))
        per = met.groupBy(*keys, "alert_id", "category", "rule_level").agg(F.max("w").alias("w"))
        out = out.unionByName(per.select(*keys, "alert_id", "category", (F.col("rule_level") * F.col("w")).alias("risk")))
    return out


def engine_a(risks: DataFrame, threshold: float = 35.0, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), keys: tuple[str, ...] = ("srcip",), suppressed: DataFrame | None = None, context: DataFrame | None = None) -> DataFrame:
    """(keys, score_a, score_b, score_c, n_categories, total, triggered) of every address with two categories or more.

    ``suppressed(srcip)`` addresses are dropped first (an anti-join).  ``context``
    (srcip, cluster, ppr, confirmed) lends a cluster's categories to its members and
    adds ``5 * ppr`` and 2 for a confirmed address.
    """
    if suppressed is not None:
        risks = risks.join(suppressed.select("srcip").distinct(), "srcip", "left_anti")
    sums = [F.round(F.sum(F.when(F.col("category") == c, F.col("risk"))), 2).alias(f"score_{c.lower()}") for c in CATEGORIES]
    scores = risks.groupBy(*keys).agg(*sums)
    boost = F.lit(0.0)
    if context is not None:
        scores = scores.join(context, "srcip", "left")
        cluster = scores.groupBy("cluster").agg(*[F.max(f"score_{c.lower()}").alias(f"m_{c.lower()}") for c in CATEGORIES]).where("cluster is not null")
        scores = scores.join(cluster, "cluster", "left").withColumns({f"score_{c}": F.greatest(f"score_{c}", f"m_{c}") for c in "abc"})
        boost = 5 * F.coalesce("ppr", F.lit(0.0)) + F.when(F.col("confirmed"), 2.0).otherwise(0.0)
    present = sum((F.when(F.col(f"score_{c}") > 0, 1).otherwise(0) for c in "abc"), F.lit(0))
    total = sum((F.coalesce(f"score_{c}", F.lit(0.0)) * w for c, w in zip("abc", weights, strict=True)), F.lit(0.0)) + boost
    out = scores.select(*keys, *[F.coalesce(f"score_{c}", F.lit(0.0)).alias(f"score_{c}") for c in "abc"], present.alias("n_categories"), F.round(total, 2).alias("total"))
    return out.where("n_categories >= 2").withColumn("triggered", F.col("total") >= threshold)


def engine_a_stats(risks: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: addresses per category, in two categories, in all three, and triggers."""
    per = risks.agg(*[F.count_distinct(F.when(F.col("category") == c, F.col("srcip"))).alias(f"unique_{c.lower()}") for c in CATEGORIES])
    two = scored.agg(F.count("*").alias("two_or_more"), F.count_if(F.col("n_categories") == 3).alias("all_three"), F.count_if("triggered").alias("triggers"))
    return per.withColumn("_", F.lit(1)).join(two.withColumn("_", F.lit(1)), "_").drop("_")


def multi_resolution(alerts: DataFrame, as_of: datetime, techniques: DataFrame | None = None, tiers=TIERS) -> DataFrame:
    """(srcip, one flag per tier, persistence): triggers over growing windows, from one scan."""
    longest = max(t[0] for t in tiers)
    alerts = alerts.where(in_window("ts", as_of - timedelta(minutes=longest), as_of))
    risks = category_risks(alerts, techniques).join(alerts.select("alert_id", "ts"), "alert_id")
    sums = [
        F.round(F.coalesce(F.sum(F.when(in_window("ts", as_of - timedelta(minutes=m), as_of) & (F.col("category") == c), F.col("risk"))), F.lit(0.0)), 2).alias(f"s_{i}_{c}")
        for i, (m, _, _) in enumerate(tiers)
        for c in CATEGORIES
    ]
    out = risks.groupBy("srcip").agg(*sums)
    for i, (minutes, threshold, _) in enumerate(tiers):
        parts = [F.col(f"s_{i}_{c}") for c in CATEGORIES]
        present = sum((F.when(p > 0, 1).otherwise(0) for p in parts), F.lit(0))
        out = out.withColumn(f"in_{minutes}m", (present >= 2) & (sum(parts, F.lit(0.0)) >= threshold))
    return persistence(out.select("srcip", *[f"in_{m}m" for m, _, _ in tiers]), [f"in_{m}m" for m, _, _ in tiers])


def persistence(flags: DataFrame, columns: list[str]) -> DataFrame:
    """persistent: in all tiers; slow_burn: only the longest; burst: only the shortest; else partial."""
    cols = [F.col(c) for c in columns]
    every = cols[0]
    for c in cols[1:]:
        every = every & c
    only = lambda c: c & ~_any([x for x in cols if x is not c])
    label = F.when(every, "persistent").when(only(cols[-1]), "slow_burn").when(only(cols[0]), "burst").otherwise("partial")
    return flags.where(_any(cols)).withColumn("persistence", label)


def _any(cols: list[Column]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c
    return out


def unified_severity(triggers: Column, anomalies: Column) -> tuple[Column, Column]:
    """(score 0 to 10, NONE / LOW / MEDIUM / HIGH / CRITICAL)."""
    score = F.least(triggers + anomalies + ((triggers > 0) & (anomalies > 0)).cast("long"), F.lit(10))
    return score, F.when(score == 0, "NONE").when(score <= 2, "LOW").when(score <= 5, "MEDIUM").when(score <= 8, "HIGH").otherwise("CRITICAL")


def source_health(alerts: DataFrame, as_of: datetime, stale_minutes: int = 60) -> DataFrame:
    """Rows and newest row per category's groups, and whether the source is stale or empty."""
    category = F.explode(F.array_compact(F.array(*[F.when(F.arrays_overlap("rule_groups", F.array(*map(F.lit, t))), c) for c, t in GROUP_TOKENS.items()])))
    seen = alerts.select(category.alias("category"), "ts").groupBy("category").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))
    every = alerts.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    stale = F.col("newest").isNull() | (F.col("newest") < F.lit(as_of - timedelta(minutes=stale_minutes)))
    return every.join(F.broadcast(seen), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), "newest", stale.alias("degraded"))


def normal_cidr(ip: Column, prefix: int = 24) -> Column:
    """Network of an IPv4 address, host bits cleared; what cannot be read stays as it is."""
    parts = F.split(ip, r"\.")
    good = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    value = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0))
    net = value - value % (1 << (32 - prefix))
    text = F.concat_ws(".", *[(F.floor(net / 256 ** (3 - i)) % 256).cast("string") for i in range(4)])
    return F.when(good, F.concat(text, F.lit(f"/{prefix}"))).otherwise(ip)


_BYTE = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DOTTED = r"^(.*:)" + r"\.".join([_BYTE] * 4) + "$"


def normal_cidr6(ip: Column, prefix: int = 64) -> Column:
    """Network of an IPv6 address in its shortest spelling; what cannot be read stays as it is."""

    def in_hex(low: Column) -> Column:
        byte = [F.regexp_extract(low, _DOTTED, i).try_cast("long") for i in range(2, 6)]
        return F.when(low.rlike(_DOTTED), F.concat(F.regexp_extract(low, _DOTTED, 1), F.hex(byte[0] * 256 + byte[1]), F.lit(":"), F.hex(byte[2] * 256 + byte[3]))).otherwise(low)

    def groups(halves: Column) -> Column:
        """The eight groups, or null."""
        some = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ":"))
        left, right = some(F.get(halves, 0)), some(F.coalesce(F.get(halves, 1), F.lit("")))
        own = F.size(left) + F.size(right)
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - own, F.lit(0)))
        fits = ((F.size(halves) == 1) & (own == 8)) | ((F.size(halves) == 2) & (own <= 7))
        return F.when(fits & F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")), F.concat(left, zeros, right))

    spans = F.array(*[F.lit(1 << (16 - min(16, max(0, prefix - 16 * i)))) for i in range(8)])
    masked = lambda whole: F.zip_with(whole, spans, lambda g, span: F.conv(g, 16, 10).cast("long") - F.conv(g, 16, 10).cast("long") % span)

    def spelled(net: Column) -> Column:
        mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", *[(F.floor(F.get(net, i) / d) % 256).cast("string") for i in (6, 7) for d in (256, 1)]))
        plain = F.lower(F.array_join(F.transform(net, lambda n: F.hex(n)), ":"))
        return on(plain, lambda text: F.when(text.startswith("0:0:0:0:0:ffff:"), mapped).otherwise(shortened(text)))

    def shortened(text: Column) -> Column:
        """The first of the longest runs of zero groups becomes "::"."""
        out = text
        for run in range(2, 9):
            zeros = rf"^(|.*?:)0(?::0){{{run - 1}}}(|:.*)$"
            sides = [F.regexp_extract(text, zeros, i) for i in (1, 2)]
            out = F.when(text.rlike(zeros), F.concat(F.regexp_replace(sides[0], ":$", ""), F.lit("::"), F.regexp_replace(sides[1], "^:", ""))).otherwise(out)
        return out

    whole = on(on(F.lower(ip), in_hex), lambda low: on(F.split(low, "::"), groups))
    network = on(whole, lambda w: F.when(w.isNotNull(), on(masked(w), spelled)))
    return F.when(ip.contains(":"), F.coalesce(F.concat(network, F.lit(f"/{prefix}")), ip)).otherwise(ip)


def by_network(risks: DataFrame, prefix: int = 24, prefix6: int = 64, suppressed: DataFrame | None = None) -> DataFrame:
    """``risks`` of networks, named in ``srcip``: of each category the score of its worst address, for ``engine_a``.

    ``suppressed(srcip)`` addresses are dropped before addresses are made networks.
    """
    if suppressed is not None:
        risks = risks.join(suppressed.select("srcip").distinct(), "srcip", "left_anti")
    worst = risks.groupBy("srcip", "category").agg(F.round(F.sum("risk"), 2).alias("risk"))
    net = F.when(F.col("srcip").contains(":"), normal_cidr6(F.col("srcip"), prefix6)).otherwise(normal_cidr(F.col("srcip"), prefix))
    return worst.groupBy(net.alias("srcip"), "category").agg(F.max("risk").alias("risk"))


def lockouts(alerts: DataFrame, text: str = "full_log", errors: tuple[str, ...] = ("error", "inner_error", "mail_error"), groups: list[str] | None = None) -> DataFrame:
    """Advisory count of account-lockout alerts of category B: ``locked`` in an error field, or a phrase in the log."""
    hit = F.lit(False)
    for name in errors:
        hit = hit | F.coalesce(F.lower(name).rlike(r"\blocked\b"), F.lit(False))
    for phrase in ("account is locked", "account locked", "locked out"):
        hit = hit | F.coalesce(F.lower(text).contains(phrase), F.lit(False))
    of_b = F.arrays_overlap("rule_groups", F.array(*map(F.lit, groups or GROUP_TOKENS["B"])))
    return alerts.agg(F.count_if(of_b & hit).alias("lockouts"))


def graph_context(clusters: DataFrame, ranks: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(srcip, cluster, ppr, confirmed) for ``engine_a`` from graph results."""
    return (
        clusters.select(F.col("node").alias("srcip"), F.col("component").alias("cluster"))
        .join(ranks.select(F.col("node").alias("srcip"), F.col("rank").alias("ppr")), "srcip", "full")
        .join(confirmed.select(F.col("node").alias("srcip"), F.lit(True).alias("confirmed")), "srcip", "full")
        .select("srcip", "cluster", "ppr", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
    )
