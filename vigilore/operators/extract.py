"""Indicators, hunts, page signatures and look-alike domains from text."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scanning import Words, needed_literals, on
from ..knowledge import HOMOGLYPHS, HUNTS, LOGIN_SIGNATURES, SHELL_SIGNATURES, TLD_SWAPS
from .filters import is_noise_ip

IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
URL = r"https?://[^\s<>\"']+"
HASHES = {"md5": r"\b[a-fA-F0-9]{32}\b", "sha1": r"\b[a-fA-F0-9]{40}\b", "sha256": r"\b[a-fA-F0-9]{64}\b"}


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, EMAIL), lambda e: F.lower(e)))


def iocs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, ioc): distinct indicators per text; noise addresses and domains seen only in emails are dropped."""
    text = F.coalesce(text_col, F.lit(""))
    ips = F.filter(_all(text, IPV4), lambda x: ~is_noise_ip(x))
    mails = F.transform(_all(text, EMAIL), lambda e: F.lower(e))
    hosts = F.transform(_all(text, DOMAIN), lambda d: F.lower(d))
    lists = {"ip": ips, "email": mails, "url": _all(text, URL), **{k: F.transform(_all(text, p), lambda h: F.lower(h)) for k, p in HASHES.items()}}
    mail_hosts = F.transform(mails, lambda e: F.substring_index(e, "@", -1))
    found = docs.select(F.col(id_col), *[v.alias(k) for k, v in lists.items()], hosts.alias("_hosts"), mail_hosts.alias("_mail"))
    # A domain counts if it occurs more often than as the domain of an address; texts without addresses need no count.
    found = found.withColumn("domain", F.when(F.size("_mail") == 0, F.col("_hosts")).otherwise(F.array().cast("array<string>")))
    tagged = F.flatten(F.array(*[_tag(k) for k in [*lists, "domain"]]))
    plain = found.select(id_col, F.explode(tagged).alias("x")).select(id_col, "x.*").where("ioc <> ''")
    signed = F.concat(F.transform("_hosts", lambda h: F.struct(h.alias("ioc"), F.lit(1).alias("n"))), F.transform("_mail", lambda h: F.struct(h.alias("ioc"), F.lit(-1).alias("n"))))
    counted = found.where(F.size("_mail") > 0).withColumn("_row", F.monotonically_increasing_id()).select("_row", id_col, F.explode(signed).alias("x")).groupBy("_row", id_col, "x.ioc").agg(F.sum("x.n").alias("n"))
    return plain.unionByName(counted.where("n > 0 and ioc <> ''").select(id_col, F.lit("domain").alias("kind"), "ioc"))


def _tag(kind: str) -> Column:
    return F.transform(F.array_distinct(kind), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("ioc")))


def classify_ioc(value: Column, order: tuple[str, ...] = ("ip", "url", "email", "hash", "domain")) -> Column:
    """Kind of an indicator; ``order`` gives the tests and their order (others are left out)."""
    v = F.trim(value)
    tests = {
        "ip": v.rlike(f"^{IPV4[2:-2]}$") | v.rlike(r"^[0-9a-fA-F:]*:[0-9a-fA-F:]+$"),
        "url": v.startswith("http://") | v.startswith("https://"),
        "email": v.contains("@"),
        "hash": v.rlike(r"^(?:[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$"),
        "domain": v.contains(".") & ~v.contains(" "),
        "hostname": v.rlike(r"^[A-Za-z0-9][A-Za-z0-9-]*$"),
    }
    out = F.lit("other")
    for kind in reversed(order):
        out = F.when(tests[kind], kind).otherwise(out)
    return out


def hunt_matches(text: Column, hunts: dict[str, list[list[str]]] | None = None) -> Column:
    """Names of the hunts whose words all occur, as an array in the order of the table.

    A word must not be part of a longer one on a side where it has a letter or digit.
    """
    ways = hunts or HUNTS
    words = Words((w for own in ways.values() for way in own for w in way), whole=True)

    def tests(found: Column) -> Column:
        every = lambda way: reduce(and_, [words.has(found, w) for w in way])
        return F.array_compact(F.array(*[F.when(reduce(or_, map(every, own)), name) for name, own in ways.items()]))

    return on(words.found(F.lower(F.coalesce(text, F.lit("")))), tests)


def hunt_report(rows: DataFrame, text_col: str, dimension: str) -> DataFrame:
    """(hunt, dimension, n): all hunts in one scan; a missing dimension is N/A."""
    each = rows.select(F.explode(hunt_matches(F.col(text_col))).alias("hunt"), F.coalesce(F.col(dimension).cast("string"), F.lit("N/A")).alias(dimension))
    return each.groupBy("hunt", dimension).agg(F.count("*").alias("n"))


def hunt_breakdowns(rows: DataFrame, text_col: str, dims: dict[str, Column], hunts: dict[str, list[list[str]]] | None = None) -> DataFrame:
    """(hunt, dimension, value, n): every hunt by all dimensions at once; a missing value is N/A."""
    each = rows.select(F.explode(hunt_matches(F.col(text_col), hunts)).alias("hunt"), *[F.coalesce(v.cast("string"), F.lit("N/A")).alias(k) for k, v in dims.items()])
    pairs = F.explode(F.array(F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")), *[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value")) for k in dims]))
    return each.select("hunt", pairs.alias("p")).select("hunt", "p.*").groupBy("hunt", "dimension", "value").agg(F.count("*").alias("n"))


def pick_playbook(alerts: DataFrame, keywords: DataFrame, key: str = "srcip") -> DataFrame:
    """First template by priority whose keyword is in the alert's techniques or groups; else ``c2_beacon``.

    ``keywords(keyword, template, priority)`` is a small table; the join is on exploded terms.
    """
    terms = alerts.select(key, F.explode(F.concat("rule_groups", F.coalesce("technique", F.array().cast("array<string>")))).alias("keyword"))
    met = terms.join(keywords, "keyword").groupBy(key).agg(F.min_by("template", F.struct("priority", "template")).alias("template"))
    return alerts.select(key).distinct().join(met, key, "left").withColumn("template", F.coalesce("template", F.lit("c2_beacon")))


#: The words of which every signature needs some, all looked for in one pass.
_NEEDED = Words(x for p, _, _ in (*SHELL_SIGNATURES, *LOGIN_SIGNATURES) for own in needed_literals(p) for x in own)


def _signs(body: Column) -> Column:
    """(high, medium, low, login_high, families): numbers of signs of each weight, and the families found.

    A signature is tried only on pages that hold the words which it cannot do without.
    """
    some = lambda conditions: sum((c.cast("int") for c in conditions), F.lit(0))

    def tests(found: Column) -> Column:
        def seen(p: str) -> Column:
            may = [reduce(or_, [_NEEDED.has(found, x) for x in own]) for own in needed_literals(p)]
            # Not evaluated where the words are missing.
            return F.when(reduce(and_, may), body.rlike("(?i)" + p)).otherwise(False) if may else body.rlike("(?i)" + p)

        hits = F.array(*[seen(p) for p, _, _ in SHELL_SIGNATURES])
        login = some(seen(p) for p, _, w in LOGIN_SIGNATURES if w == "high")

        def told(h: Column) -> Column:
            at = [F.get(h, i) for i in range(len(SHELL_SIGNATURES))]
            by = [some(x for x, (_, _, w) in zip(at, SHELL_SIGNATURES, strict=True) if w == weight).alias(weight) for weight in ("high", "medium", "low")]
            return F.struct(*by, login.alias("login_high"), F.array_compact(F.array(*[F.when(x, label) for x, (_, label, _) in zip(at, SHELL_SIGNATURES, strict=True)])).alias("families"))

        return on(hits, told)

    return on(_NEEDED.found(F.lower(body)), tests)


def page_signatures(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", chars: int | None = None, others: dict[str, Column] | None = None) -> DataFrame:
    """(id, high, medium, low, login_high, families, others, verdict) of every page; ``chars`` bounds what is read of one."""
    body = F.coalesce(html_col, F.lit(""))
    out = pages.select(id_col, _signs(body if chars is None else F.substring(body, 1, chars)).alias("_signs"), *[v.alias(k) for k, v in (others or {}).items()])
    out = out.select(id_col, "_signs.*", *(others or {}))
    high, medium = F.col("high"), F.col("medium")
    verdict = F.when((high >= 2) | ((high >= 1) & (medium >= 2)), "CONFIRMED").when((high >= 1) | (medium >= 2), "SUSPICIOUS").when(F.col("login_high") > 0, "LOGIN_PAGE").when(high + medium + F.col("low") > 0, "LOW_RISK").otherwise("CLEAN")
    return out.withColumn("verdict", verdict)


def context_columns(html_col: str = "html", k: int = 10) -> dict[str, Column]:
    """Title, first headings, numbers of inputs and forms of a page."""
    h = F.col(html_col)
    return {
        "title": F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1), "headings": F.slice(F.regexp_extract_all(h, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), 1, k),
        "n_inputs": F.regexp_count(h, F.lit(r"(?i)<input\b")), "n_forms": F.regexp_count(h, F.lit(r"(?i)<form\b")),
    }


def page_context(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", k: int = 10) -> DataFrame:
    """(id, title, headings, n_inputs, n_forms)."""
    return pages.select(id_col, *[v.alias(c) for c, v in context_columns(html_col, k).items()])


def page_report(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Signatures, verdict and context of every page in one projection."""
    return page_signatures(pages, id_col, html_col, others=context_columns(html_col))


def email_ranking(rows: DataFrame, text_col: str, dims: dict[str, Column], ts: str) -> DataFrame:
    """(email, docs, first_seen, last_seen, n_<dimension>): texts that mention an address, each once, and what they come from."""
    each = rows.select(F.explode(emails(F.col(text_col))).alias("email"), F.col(ts).alias("_ts"), *[v.alias(k) for k, v in dims.items()])
    return each.groupBy("email").agg(F.count("*").alias("docs"), F.min("_ts").alias("first_seen"), F.max("_ts").alias("last_seen"), *[F.count_distinct(k).alias(f"n_{k}") for k in dims])


def look_alikes(domains: DataFrame, col: str = "domain", most: int | None = None) -> DataFrame:
    """(domain, variant): omission, swap, repetition, look-alike characters, hyphen, other top-level domain."""
    d = F.rtrim(F.lower(F.trim(col)), F.lit("."))
    df = domains.select(F.col(col).alias("domain"), d.alias("d")).where(F.col("d").contains("."))
    df = df.withColumn("s", F.substring_index("d", ".", 1)).withColumn("t", F.expr("substring(d, length(s) + 2)")).withColumn("n", F.length("s")).where("n > 0")
    s, t, n = F.col("s"), F.col("t"), F.col("n")
    at = F.sequence(F.lit(1), n)
    cut = lambda a, b: F.substring(s, a, F.greatest(b, F.lit(0)))
    rest = lambda a: F.substring(s, a, n)
    full = lambda x: F.concat(x, F.lit("."), t)
    glyphs = F.create_map(*[F.lit(x) for kv in HOMOGLYPHS.items() for x in kv])
    none = F.array().cast("array<string>")
    variants = F.concat(
        F.when(n > 1, F.transform(at, lambda i: full(F.concat(cut(F.lit(1), i - 1), rest(i + 1))))).otherwise(none),
        F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: full(F.concat(cut(F.lit(1), i - 1), F.substring(s, i + 1, F.lit(1)), F.substring(s, i, F.lit(1)), rest(i + 2))))).otherwise(none),
        F.transform(at, lambda i: full(F.concat(cut(F.lit(1), i), F.substring(s, i, F.lit(1)), rest(i + 1)))),
        F.transform(F.filter(at, lambda i: F.map_contains_key(glyphs, F.substring(s, i, F.lit(1)))), lambda i: full(F.concat(cut(F.lit(1), i - 1), F.element_at(glyphs, F.substring(s, i, F.lit(1))), rest(i + 1)))),
        F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: full(F.concat(cut(F.lit(1), i), F.lit("-"), rest(i + 1))))).otherwise(none),
        F.transform(F.filter(F.array(*map(F.lit, TLD_SWAPS)), lambda x: x != t), lambda x: F.concat(s, F.lit("."), x)),
    )
    out = F.array_sort(F.array_distinct(F.filter(variants, lambda v: v != F.col("d"))))
    return df.select("domain", F.explode(F.slice(out, 1, most) if most else out).alias("variant"))


def typosquats(domains: DataFrame, hosts: DataFrame, col: str = "domain", host: str = "host") -> DataFrame:
    """Look-alikes that occur among observed hosts."""
    seen = hosts.groupBy(F.lower(host).alias("variant")).agg(F.count("*").alias("n"))
    return look_alikes(domains, col).join(seen, "variant").select("domain", "variant", "n")


def host_suffixes(host: Column) -> Column:
    """All parent domains of a host, itself first."""
    parts = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def asset_lookup(hosts: DataFrame, assets: DataFrame, host: str = "host") -> DataFrame:
    """Longest asset name that is the host or a parent of it, with the asset's columns."""
    each = hosts.select(host).distinct().select(host, F.posexplode(host_suffixes(F.col(host))).alias("_depth", "asset"))
    best = Window.partitionBy(host).orderBy("_depth")
    return each.join(assets, "asset").withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_depth")


def attacker_match(values: DataFrame, registry: DataFrame, col: str = "value") -> DataFrame:
    """Values that are registered, or exactly one level below a registered domain, or whose address domain is."""
    v = F.lower(F.trim(col))
    forms = F.array_distinct(F.array_compact(F.array(v, F.when(v.contains("@"), F.substring_index(v, "@", -1)), F.when(~v.contains("@") & (F.size(F.split(v, r"\.")) > 2), F.expr(f"substring(lower(trim({col})), instr(lower(trim({col})), '.') + 1)")))))
    each = values.select(col, F.explode(forms).alias("ioc"))
    return each.join(registry.select("ioc").distinct(), "ioc", "left_semi").select(col).distinct()


def domain_age(reg: DataFrame, as_of, created: str = "created") -> DataFrame:
    """Flags of a registration table: very new, new, no name servers, on hold."""
    days = F.datediff(F.lit(as_of), F.col(created))
    return reg.withColumn("age_days", days).withColumn("age", F.when(days < 30, "very_new").when(days < 180, "new").otherwise("established")).withColumn("no_nameservers", F.coalesce(F.size("nameservers"), F.lit(0)) == 0).withColumn("on_hold", F.coalesce(F.lower("status").contains("hold"), F.lit(False)))


def stealer_logs(feed: DataFrame) -> DataFrame:
    """One row per log: malware, first five addresses, number of credentials."""
    return feed.select(F.explode("logs").alias("l")).select("l.malware", F.slice("l.ips", 1, 5).alias("ips"), F.coalesce(F.size("l.credentials"), F.lit(0)).alias("credential_count"))


def breach_metadata(feed: DataFrame, keys: tuple[str, ...] = ("name", "date", "domain"), most: int = 10) -> DataFrame:
    """The allowed keys of at most ``most`` breaches."""
    return feed.select("email", F.slice(F.transform("breaches", lambda b: F.struct(*[b[k].alias(k) for k in keys])), 1, most).alias("breaches"))


def condense_pulses(feed: DataFrame, tags: int = 10, families: int = 5) -> DataFrame:
    return feed.select("id", F.slice("tags", 1, tags).alias("tags"), F.slice("families", 1, families).alias("families"), F.coalesce("adversary.name", "adversary.id").alias("adversary"))
