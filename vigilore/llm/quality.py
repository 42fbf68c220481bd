"""Quality rules with thresholds learned from mergeable quantile sketches.

Every document gets a handful of ratios.  A KLL sketch of each ratio is built per
(language, source), merged upwards into language and corpus sketches, and the
quantiles read from it become that group's thresholds: ``median + spread_factor *
spread``, the spread being ``q90 - median`` of the group.  A source that is mostly
junk has junk at its 90th percentile, so its spread is at most ``GUARD`` times that
of its language's merged sketch.  The constants of ``RATIOS`` are the least spreads;
they only count where nine of ten documents have none of a kind (see the README).  A
group with fewer than ``min_rows`` documents uses the merged sketch of its language,
then that of the corpus.  All of it is
DataFrame expressions; the text is read once and never shuffled.

Defined cases: null text counts as empty, has no words and fails the base rule;
null language or source is a group of its own; repeated rows are judged row by
row and each is returned; an empty table gives an empty result; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import WORD_SPLIT, materialize, text_or_empty

#: ratio -> least spread, so that a group in which a ratio never varies does not
#: reject the first document that differs.
RATIOS: dict[str, float] = {
    "symbol_ratio": 0.004,
    "dup_line_ratio": 0.05,
    "repeat_ratio": 0.005,
    "upper_ratio": 0.002,
    "bang_ratio": 0.003,
}
SPREAD_FACTOR = 6.0
GUARD = 2.0
MIN_ROWS = 200
SKETCH_K = 1024


def quality_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts to every row of ``docs`` (columns prefixed ``q_``).

    ``q_repeat_words`` counts the words that lie in a 3-word window found twice
    or more in the text.  Windows are compared by 64-bit hashes within one text;
    rows without a repeated window skip the sort.
    """
    text = F.col("_text")
    n = F.col("q_words")
    df = docs.withColumn("_text", text_or_empty(text_col))
    df = df.withColumn("_words", F.array_remove(F.split("_text", WORD_SPLIT, -1), ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *docs.columns,
        "_text",
        F.size("_words").cast("long").alias("q_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("q_word_chars"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    pairs = F.zip_with("_hashes", F.slice("_hashes", 2, F.greatest(n.cast("int"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice("_hashes", 3, F.greatest(n.cast("int"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    df = df.select(
        *docs.columns,
        "q_words",
        "q_word_chars",
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("q_symbols"),
        F.when(text.contains("!"), F.regexp_count(text, F.lit("!"))).otherwise(0).cast("long").alias("q_bangs"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("q_upper"),
        F.size("_lines").cast("long").alias("q_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("q_dup_lines"),
        F.when(n >= 3, F.slice(triples, 1, F.greatest(n.cast("int") - 2, F.lit(1)))).otherwise(F.array().cast("array<bigint>")).alias("_keys"),
    )
    counts = [c for c in df.columns if c != "_keys"]
    repeated = F.size(F.array_distinct("_keys")) < F.size("_keys")
    df = df.select(*counts, F.when(repeated, F.sort_array(F.transform("_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))).alias("_sorted"))
    shifted = F.arrays_zip(
        F.col("_sorted").alias("a"),
        F.slice("_sorted", 2, F.greatest(n.cast("int"), F.lit(1))).alias("b"),
        F.concat(F.array(F.struct(F.lit(None).cast("long").alias("k"), F.lit(-1).alias("i"))), F.col("_sorted")).alias("p"),
    )
    hit = F.filter(shifted, lambda x: (x["a"]["i"].isNotNull()) & (F.coalesce(x["a"]["k"] == x["b"]["k"], F.lit(False)) | F.coalesce(x["a"]["k"] == x["p"]["k"], F.lit(False))))
    df = df.select(*counts, F.sort_array(F.transform(hit, lambda x: x["a"]["i"])).alias("_at"))
    steps = F.zip_with("_at", F.slice("_at", 2, F.greatest(n.cast("int"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.select(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("q_repeat_words"))


def _ratios() -> dict[str, Column]:
    chars = F.greatest(F.col("q_word_chars"), F.lit(1)).cast("double")
    return {
        "symbol_ratio": F.col("q_symbols") / chars,
        "dup_line_ratio": F.col("q_dup_lines") / F.greatest(F.col("q_lines"), F.lit(1)).cast("double"),
        "repeat_ratio": F.col("q_repeat_words") / F.greatest(F.col("q_words"), F.lit(1)).cast("double"),
        "upper_ratio": F.col("q_upper") / chars,
        "bang_ratio": F.col("q_bangs") / chars,
    }


def base_failed() -> Column:
    return (F.col("q_words") < 50) | (100 * F.col("q_repeat_words") > 50 * F.col("q_words"))


def learn_thresholds(metrics: DataFrame, lang_col: str = "lang", source_col: str = "source", min_rows: int = MIN_ROWS, spread_factor: float = SPREAD_FACTOR, k: int = SKETCH_K) -> DataFrame:
    """One row per (language, source): the upper limit of every ratio.

    Only documents that pass the base rule feed the sketches.  The aggregation is
    partial first, so a source with a third of all rows costs one sketch a task.
    """
    rows = metrics.where(~base_failed()).select(F.col(lang_col).alias("g_lang"), F.col(source_col).alias("g_source"), *[v.alias(r) for r, v in _ratios().items()])
    own = rows.groupBy("g_lang", "g_source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, F.lit(k)).alias(r) for r in RATIOS])
    merged = lambda by: own.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(k)).alias(r) for r in RATIOS])
    lang = merged(["g_lang"]).select(F.col("g_lang").alias("l_lang"), F.col("n").alias("l_n"), *[F.col(r).alias(f"l_{r}") for r in RATIOS])
    corpus = merged([])
    wide = own.join(lang, own.g_lang.eqNullSafe(lang.l_lang), "left").withColumns({f"c_{r}": corpus.select(r).scalar() for r in RATIOS})
    level = F.when(F.col("n") >= min_rows, "own").when(F.col("l_n") >= min_rows, "lang").otherwise("corpus")

    def limit(r: str) -> Column:
        at = lambda sketch, q: F.kll_sketch_get_quantile_double(sketch, F.lit(q))
        spread = lambda sketch: at(sketch, 0.9) - at(sketch, 0.5)
        least = F.lit(RATIOS[r])
        own = F.least(spread(F.col(r)), GUARD * F.greatest(spread(F.col(f"l_{r}")), least))
        fence = lambda sketch, width: at(sketch, 0.5) + spread_factor * F.greatest(width, least)
        lang, corpus = F.col(f"l_{r}"), F.col(f"c_{r}")
        return F.when(level == "own", fence(F.col(r), own)).when(level == "lang", fence(lang, spread(lang))).otherwise(fence(corpus, spread(corpus))).alias(f"max_{r}")

    out = wide.select("g_lang", "g_source", F.col("n").alias("g_rows"), level.alias("g_level"), *[limit(r) for r in RATIOS])
    # Written, so that Spark knows the size of the limits (a few numbers a group) rather than that of the sketches behind them.
    return materialize(out, "limits")


def judge(metrics: DataFrame, thresholds: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Joins the limits to the rows and adds ``q_base_failed`` and ``q_kept``.

    The rows carry no shuffle key of their own: Spark broadcasts the limits while
    they are under its size limit and splits hot sources otherwise.
    """
    on = F.col(lang_col).eqNullSafe(F.col("g_lang")) & F.col(source_col).eqNullSafe(F.col("g_source"))
    within = F.lit(True)
    for r, v in _ratios().items():
        within = within & (v <= F.coalesce(F.col(f"max_{r}"), F.lit(1e9)))
    return metrics.join(thresholds, on, "left").withColumn("q_base_failed", base_failed()).withColumn("q_kept", ~F.col("q_base_failed") & within)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """Counts, base verdict and adaptive verdict of every document (no text in the result)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    metrics = materialize(quality_metrics(slim).drop("text"), "quality")
    return judge(metrics, learn_thresholds(metrics, **options))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged.

    The documents are written once with their counts, so neither counting twice
    nor a shuffle of texts is needed to apply the verdict.  Rows travel as one
    struct, so their column names cannot clash with the counts.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    metrics = materialize(quality_metrics(rows, f"doc.{text_col}"), "quality-docs")
    by = (f"doc.{lang_col}", f"doc.{source_col}")
    return judge(metrics, learn_thresholds(metrics, *by, **options), *by).where("q_kept").select("doc.*")
