"""Personal data: generators propose spans, boosted trees and calibrated thresholds choose.

Strict patterns with checks give the base spans, which always stay.  Looser
patterns propose further, overlapping spans: disguised addresses, defanged, spaced
and version-6 host addresses, oddly grouped cards, national phone numbers, and
secrets (assigned values and long mixed tokens).  A gradient-boosted classifier on
format and context features scores every proposal that no base span covers.

It learns from a small labelled table of texts (``labelled``, by default the one of
``pii_labels``, made from templates), never from the base checks: only uncovered
proposals are learned from, of at most ``max_training`` texts.  All other labelled
texts, and all proposals of the input whose base check failed and that no cue word
stands before, set the thresholds: a kind gets the smallest one at which the chosen proposals are right in at least
``precision`` of the labelled cases and at most ``1 - precision`` of the failed ones
are chosen; a kind without such a threshold adds nothing.  Everything is a DataFrame
expression or a Spark ML estimator.

Texts are read once.  Positions come from the pieces between matches, summed by a
window per text; what covers a proposal, and how far earlier spans reach, are running
maxima of such windows, so a text with very many matches costs no more than its length.

Defined cases: null text is empty; rows that repeat an id are rows of their own;
tables without proposals add nothing; a labelled table without both labels adds
nothing; an empty table gives an empty result; other columns are ignored (or kept,
by ``redact``).
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pii_labels import labelled_texts
from .runtime import materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Base patterns, written so that a search takes time in proportion to the text:
#: runs are possessive and only tried from their first character.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Kinds that only the method finds are listed behind the base kinds.
ALL_KINDS = (*KINDS, "secret")
_AT = r"(?: ?(?:@|[(\[{] ?(?i:at) ?[)\]}]) ?| (?i:at) )"
_DOT = r"(?:\.| ?[(\[{] ?(?i:dot|\.) ?[)\]}] ?| (?i:dot) )"
#: What a text without ``@`` must hold for an email proposal.
_MARKED_AT = rf"(?i)[(\[{{] ?at ?[)\]}}]| at {_LABEL}+(?:\.{_LABEL}| ?[(\[{{]| dot )"
#: High-recall proposals.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)++",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,4}+(?: ?(?:\.|[(\[{]\.[)\]}]| (?i:dot) ) ?[0-9]{1,4}+){3}+(?![0-9])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9A-Fa-f]{1,4}|:)",
    "card": r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9])(?:(?:\+|00)?[0-9]{1,3}[ ./-]{0,2})?\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ ./-]?[0-9]{3,4}(?![0-9])",
    "secret": r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth[_ -]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,200}|(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{20,200}+",
}
#: Words before a proposal that speak for its kind, and against any.
_CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|address|kontakt|correo)[a-z]*[ :#.]*$",
    "ip": r"(?i)(?:\bip|ipv[46]|host|addr[a-z]*|server|client|from|gateway)[ :#.=]*$",
    "card": r"(?i)(?:card|visa|credit|debit|master|karte|tarjeta|carte)[a-z]*(?: (?:number|no|nr))?[ :#.]*$",
    "phone": r"(?i)(?:call|dial|ring|tel|phone|fax|mobile|cell|ruf|llame|appel)[a-z]*(?: (?:number|no|me|us|at))?[ :#.]*$",
    "secret": r"(?i)(?:key|secret|credential|bearer|login)[a-z]*[ :#.=]*$",
}
_AGAINST = r"(?i)(?:order|invoice|isbn|issn|ref[a-z]*|version|\bv|release|section|part|serial|batch|date|time|year|sum|total|item|sku|id|commit|sha1?|sha256|md5|checksum|hash|mac)(?: (?:number|no|nr))?[ :#.=]*$"
LEFT, RIGHT = 24, 8
MAX_TRAINING = 50_000
PRECISION = 0.98
FEATURES = ["k", "n_chars", "n_digits", "n_seps", "n_letters", "n_groups", "largest_group", "n_words", "n_distinct", "luhn", "small", "quad", "marked", "plus", "paren", "hexed", "assigned", "cue", "against", "left_word", "right_word", "left_digit", "right_digit"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn check of a string of digits; the digits are weighed from the right."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
    weighed = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(weighed, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) % 10 == 0


def base_check(kind: Column, value: Column) -> Column:
    """Whether a match of its kind's base pattern counts."""
    digits = _digits(value)
    n = F.length(digits)
    octets = F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.substring(p, -9, 9).try_cast("int") <= 255)
    return F.when(kind == "email", True).when(kind == "ip", octets).when(kind == "card", n.between(14, 19) & luhn_ok(digits)).otherwise(n.between(10, 15))


def _matches(text: Column, pattern: str, needed: Column) -> Column:
    """Array of (gap, value, left, right): code points since the match before, and what stands around."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(found.alias("v"), pieces.alias("p"), F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))).alias("q"))
    kept = F.filter(zipped, lambda x: x["v"].isNotNull())
    return F.when(needed, F.transform(kept, lambda x: F.struct(F.length(x["p"]).alias("gap"), x["v"].alias("value"), F.right(x["p"], F.lit(LEFT)).alias("left"), F.left(x["q"], F.lit(RIGHT)).alias("right"))))


def find_matches(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_rid`` (row number, unique) and one array of matches per pattern to ``docs``."""
    text = F.col("_text")
    df = docs.withColumn("_rid", F.monotonically_increasing_id()).withColumn("_text", text_or_empty(text_col))
    df = df.withColumn("_digit", F.col("_text").rlike("[0-9]"))
    digit = F.col("_digit")
    needed = {
        "base": {"email": text.contains("@"), "ip": digit & text.contains("."), "card": digit, "phone": digit & text.contains("+")},
        "loose": {"email": text.contains("@") | text.rlike(_MARKED_AT), "ip": digit, "card": digit, "phone": digit, "secret": digit | text.contains("=") | text.contains(":")},
    }
    arrays = {f"{how}_{k}": _matches(text, pattern, needed[how][k]) for how, patterns in (("base", BASE), ("loose", LOOSE)) for k, pattern in patterns.items()}
    return df.withColumns(arrays).drop("_text", "_digit")


def _spans(found: DataFrame) -> DataFrame:
    """(_rid, how, kind, start, end, value, left, right, checks): every match at its place."""
    each = None
    for how, kinds in (("base", KINDS), ("loose", ALL_KINDS)):
        for k in kinds:
            one = found.where(F.size(f"{how}_{k}") > 0).select("_rid", F.lit(how).alias("how"), F.lit(k).alias("kind"), F.posexplode(f"{how}_{k}").alias("i", "m"))
            each = one if each is None else each.unionByName(one)
    order = Window.partitionBy("_rid", "how", "kind").orderBy("i")
    end = F.sum(F.col("m.gap") + F.length("m.value")).over(order)
    out = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("m.value"))
    return out.select("_rid", "how", "kind", "start", "end", "m.value", "m.left", "m.right", base_check(F.col("kind"), F.col("m.value")).alias("checks"))


def _by_kind(values: dict[str, Column], other: Column) -> Column:
    out = other
    for k, value in values.items():
        out = F.when(F.col("kind") == k, value).otherwise(out)
    return out


def _open_proposals(spans: DataFrame) -> DataFrame:
    """The proposals that no base span covers, with features; ``failed`` tells that a base match of the kind lies there whose check failed."""
    is_base = F.col("how") == "base"
    end = F.when(is_base, F.col("end"))
    # Base matches that begin before the proposal's end: the furthest of their ends lies behind its start if one overlaps it.
    before = Window.partitionBy("_rid").orderBy("_at", is_base).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = {"_ok": F.max(F.when(F.col("checks"), end)).over(before), **{f"_bad_{k}": F.max(F.when(~F.col("checks") & (F.col("kind") == k), end)).over(before) for k in KINDS}}
    met = spans.withColumn("_at", F.when(is_base, F.col("start")).otherwise(F.col("end"))).withColumns(reach)
    behind = lambda c: F.coalesce(c > F.col("start"), F.lit(False))
    loose = met.where(~is_base & ~behind(F.col("_ok"))).withColumn("failed", behind(_by_kind({k: F.col(f"_bad_{k}") for k in KINDS}, F.lit(None).cast("bigint"))))
    value, digits = F.col("value"), _digits(F.col("value"))
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    one = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return loose.select(
        "_rid", "kind", "start", "end", "failed",
        _by_kind({k: F.lit(float(i)) for i, k in enumerate(ALL_KINDS)}, F.lit(-1.0)).alias("k"),
        one(F.length(value)).alias("n_chars"),
        one(F.length(digits)).alias("n_digits"),
        one(F.length(F.regexp_replace(value, "[^ ()./_-]", ""))).alias("n_seps"),
        one(F.length(F.regexp_replace(value, "[^A-Za-z]", ""))).alias("n_letters"),
        one(F.size(groups)).alias("n_groups"),
        one(F.array_max(F.transform(groups, lambda g: F.length(g)))).alias("largest_group"),
        one(F.size(F.split(value, " +"))).alias("n_words"),
        one(F.size(F.array_distinct(F.split(value, "")))).alias("n_distinct"),
        one(luhn_ok(digits)).alias("luhn"),
        one(F.forall(groups, lambda g: F.substring(g, -9, 9).try_cast("int") <= 255)).alias("small"),
        one(value.rlike(r"^[0-9]{1,3}([^0-9]+[0-9]{1,3}){3}$")).alias("quad"),
        one(value.rlike(r"[(\[{] ?(?i:at|dot|\.) ?[)\]}]| (?i:dot) ")).alias("marked"),
        one(value.rlike(r"^(?:\+|00)")).alias("plus"),
        one(value.rlike(r"\([0-9]+\)")).alias("paren"),
        one(value.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f:]*[A-Fa-f:]{2}|::|:[0-9A-Fa-f]{3,4}\b")).alias("hexed"),
        one(value.rlike(r"[=:]")).alias("assigned"),
        one(_by_kind({k: F.col("left").rlike(c) for k, c in _CUES.items()}, F.lit(False))).alias("cue"),
        one(F.col("left").rlike(_AGAINST)).alias("against"),
        one(F.col("left").rlike(r"[A-Za-z0-9]$")).alias("left_word"),
        one(F.col("right").rlike(r"^[A-Za-z0-9]")).alias("right_word"),
        one(F.col("left").rlike(r"[0-9][ .,:/-]?$")).alias("left_digit"),
        one(F.col("right").rlike(r"^[ .,:/-]?[0-9]")).alias("right_digit"),
    )


GRID = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


def _chosen(spans: DataFrame, labelled: DataFrame, max_training: int, precision: float) -> DataFrame | None:
    """(_rid, kind, start, end) of the proposals that the trees add, or None if nothing can be learned."""
    rows = labelled.select(F.struct(*labelled.columns).alias("doc"))
    found = materialize(find_matches(rows, "doc.text"), "pii-labelled")
    target = found.select("_rid", F.col("doc.kind").alias("t_kind"), F.col("doc.start").alias("t0"), F.col("doc.end").alias("t1"), F.col("doc.label").alias("t_label"), F.xxhash64("doc.text").alias("h"))
    hit = (F.col("kind") == F.col("t_kind")) & (F.col("start") < F.col("t1")) & (F.col("t0") < F.col("end")) & (F.col("t_label") == 1)
    known = materialize(_open_proposals(_spans(found)).join(target, "_rid").withColumn("label", F.coalesce(hit, F.lit(False)).cast("double")), "pii-known")
    # Three of four labelled texts are for the fit, at most ``max_training`` of them (those of the smallest hashes).
    fold = F.pmod("h", F.lit(4)) != 0
    sample = known.where(fold).orderBy("h", "start", "kind").limit(max_training)
    if sample.select("label").distinct().count() < 2:
        return None
    vector = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=20, maxDepth=5, stepSize=0.3, seed=7)
    model = trees.fit(vector.transform(sample))
    scored = lambda df: model.transform(vector.transform(df)).withColumn("p", vector_to_array("probability")[1])
    told = materialize(scored(_open_proposals(spans)).select("_rid", "kind", "start", "end", (F.col("failed") & (F.col("cue") == 0)).alias("failed"), "p"), "pii-proposals")
    # Five rows at most on either side: one a kind.
    right = scored(known.where(~fold)).groupBy("kind").agg(*[F.sum(F.when(F.col("p") >= t, F.col("label"))).alias(f"r{i}") for i, t in enumerate(GRID)], *[F.count_if(F.col("p") >= t).alias(f"n{i}") for i, t in enumerate(GRID)])
    wrong = told.groupBy("kind").agg(F.count_if("failed").alias("n_failed"), *[F.count_if(F.col("failed") & (F.col("p") >= t)).alias(f"f{i}") for i, t in enumerate(GRID)])
    at = F.lit(2.0)
    for i, t in reversed(list(enumerate(GRID))):
        sure = (F.col(f"n{i}") > 0) & (F.col(f"r{i}") >= precision * F.col(f"n{i}")) & (F.coalesce(f"f{i}", F.lit(0)) <= (1 - precision) * F.coalesce("n_failed", F.lit(0)))
        at = F.when(sure, t).otherwise(at)
    limits = F.broadcast(right.join(wrong, "kind", "left").select("kind", at.alias("limit")))
    return told.join(limits, "kind").where("p >= limit").select("_rid", "kind", "start", "end")


_SPAN = "array<struct<start:bigint,rank:bigint,end:bigint,kind:string,base:boolean,reach:bigint>>"


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _per_text(found: DataFrame, labelled: DataFrame | None, max_training: int, precision: float) -> DataFrame:
    """(_rid, spans): sorted array of (start, rank, end, kind, base, reach) of the texts that have any; ``reach`` is the furthest end before."""
    spans = materialize(_spans(found), "pii-spans")
    good = spans.where("how = 'base' and checks").select("_rid", "kind", "start", "end", F.lit(True).alias("base"))
    added = _chosen(spans, labelled_texts(found.sparkSession) if labelled is None else labelled, max_training, precision)
    if added is not None:
        good = good.unionByName(added.withColumn("base", F.lit(False)))
    good = good.withColumn("rank", F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")))
    before = Window.partitionBy("_rid").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    good = good.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0).cast("long")))
    return good.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "base", "reach"))).alias("spans"))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, max_training: int = MAX_TRAINING, precision: float = PRECISION) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_spans, spans) of every row; spans are ``kind:start:end`` lists.

    ``labelled`` has (text, kind, start, end, label): one span of each text, label 1 or 0.
    """
    found = materialize(find_matches(docs.select(F.col(id_col), F.col(text_col).alias("text"))).drop("text"), "pii")
    some = _per_text(found, labelled, max_training, precision)
    out = found.select("_rid", F.col(id_col)).join(some, "_rid", "left")
    spans = F.coalesce(F.col("spans"), F.array().cast(_SPAN))
    base = F.filter(spans, lambda s: s["base"])
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(id_col, *counts, _listed(base).alias("base_spans"), _listed(spans).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None, max_training: int = MAX_TRAINING, precision: float = PRECISION) -> DataFrame:
    """``docs`` with every span replaced by ``<KIND>``; only texts with matches are shuffled.

    Spans that overlap are taken from left to right, each replacing what is left of it.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    found = materialize(find_matches(rows, f"doc.{text_col}"), "pii-docs")
    some = _per_text(found, labelled, max_training, precision)
    any_match = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in found.columns if c.startswith(("base_", "loose_"))]) > 0
    plain = found.where(~any_match).select("doc")
    held = found.where(any_match).select("_rid", "doc").join(some, "_rid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN)))
    text = F.col(f"doc.{text_col}")
    parts = F.transform("spans", lambda s: F.when(s["start"] >= s["reach"], F.concat(F.substr(text, (s["reach"] + 1).cast("int"), (s["start"] - s["reach"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit("")))
    last = F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"])), F.lit(0).cast("long"))
    new = F.when(F.size("spans") == 0, text).otherwise(F.concat(F.array_join(parts, ""), F.substr(text, (last + 1).cast("int"), F.length(text))))
    return plain.unionByName(held.select(F.col("doc").withField(text_col, new).alias("doc"))).select("doc.*")
