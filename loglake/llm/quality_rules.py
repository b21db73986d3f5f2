"""Quality rules with thresholds that adapt to each language and source.

Counts per document are plain column expressions. Their distribution per (language,
source) goes into KLL quantile sketches, which merge: small groups take the sketch of
their language, small languages that of the corpus. A document fails where a ratio lies
beyond the upper fence of its group. Most documents have nothing of what a ratio counts,
so its spread alone says little: a second sketch holds what a few occurrences amount to in
documents as long as the group's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import SPACES, materialize, words_of

WINDOW = 8
#: Groups with fewer documents take the thresholds of the level above.
LEAST_GROUP = 200
#: The fence is q75 + FENCE * (q75 - q50) + EVENTS * q75 of the step, all of the group itself;
#: in a shorter document, whose own step is larger, EVENTS times that. Junk in less than a quarter of a group cannot lift it; on a normal distribution the first
#: part is q90 + 4 * (q90 - q50).
FENCE = 8.5
EVENTS = 2
#: The step of a ratio: what the least occurrence adds to it in a document (one symbol, one
#: line, two windows), for the mean length of words its error. Null where none can occur.
STEPS = {
    "symbol_ratio": "1 / n_words",
    "dup_line_ratio": "if(n_lines > 1, 1 / n_lines, null)",
    "repeat_ratio": f"if(n_words > {WINDOW}, {2 * WINDOW} / n_words, null)",
    "word_length": "word_length / sqrt(n_words)",
}


def rule_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """id (and ``keep``) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], text.alias("_t"), words_of(F.col(text_col)).alias("_w"))
    blank = F.lit(SPACES)
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, blank) != "")
    windows = F.when(F.size("_w") > WINDOW, F.expr(f"transform(sequence(1, size(_w) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW})))"))
    base = base.select(
        "*",
        lines.alias("_l"),
        windows.alias("_h"),
    ).select(
        "*",
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).alias("_r"),
    )
    # starts of the windows that occur twice or more, ascending; each covers up to the next one
    ordered = F.array_sort(F.transform("_r", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("_s", ordered)
    twice = F.expr("""
        array_sort(transform(filter(transform(_s, (x, k) -> struct(x.i as i,
            x.h <=> get(_s, k - 1).h or x.h <=> get(_s, k + 1).h as twice)), y -> y.twice), y -> y.i))
    """)
    base = base.withColumn("_p", F.when(F.col("_s").isNotNull(), twice))
    covered = F.expr(f"aggregate(transform(_p, (x, k) -> least({WINDOW}, coalesce(get(_p, k + 1) - x, {WINDOW}))), 0, (a, b) -> a + b)")
    symbols = F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))
    return base.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def _fences(sketched: DataFrame, keys: list[str], level: str) -> DataFrame:
    q = lambda r, p: F.kll_sketch_get_quantile_double(F.col(r), F.lit(p))
    step = lambda r: F.when(F.kll_sketch_get_n_double(f"{r}_step") > 0, q(f"{r}_step", 0.75))
    spread = lambda r: q(r, 0.75) + FENCE * (q(r, 0.75) - q(r, 0.5))
    fence = lambda r: F.when(step(r).isNotNull(), F.struct(spread(r).alias("spread"), step(r).alias("step")))
    ok = F.col("n") >= (LEAST_GROUP if keys else 1)
    return sketched.filter(ok).select(*keys, *[fence(r).alias(f"{level}_{r}") for r in STEPS])


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, the counts of ``rule_counts``, base_failed, kept.

    base_failed: under 20 words, or over 30 % of words in repeated windows. kept is false
    if base_failed or if a ratio is beyond its group's fence; a ratio for which neither the
    group nor any above it has a step (say, only texts of one line) fails nobody. Null text: no words, so it
    fails. Null language or source: a group of its own. Empty tables give no rows. Other
    columns are not read; their names may clash.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("g_lang"), F.coalesce(F.col(source_col), F.lit("")).alias("g_source"))
    c = rule_counts(docs, "id", "text", "g_lang", "g_source")
    some = F.greatest(F.col("n_words"), F.lit(1))
    c = c.select(
        "*",
        (F.col("n_symbols") / some).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / some).alias("repeat_ratio"),
        (F.col("word_chars") / some).alias("word_length"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )
    c = materialize(c, "rule-counts")
    learned = [*STEPS, *[f"{r}_step" for r in STEPS]]
    c = c.select("*", *[F.when(F.col("n_words") > 0, F.expr(e)).cast("double").alias(f"{r}_step") for r, e in STEPS.items()])
    fine = c.filter(~F.col("base_failed")).groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(r).alias(r) for r in learned])
    fine = materialize(fine, "rule-sketches")
    up = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(r).alias(r) for r in learned]]
    by_lang, corpus = fine.groupBy("g_lang").agg(*up), _fences(fine.agg(*up), [], "c").first()
    j = c.join(_fences(fine, ["g_lang", "g_source"], "s"), ["g_lang", "g_source"], "left").join(_fences(by_lang, ["g_lang"], "l"), ["g_lang"], "left")
    beyond = F.lit(False)
    for r in STEPS:
        known = corpus and corpus[f"c_{r}"]
        top = F.struct(F.lit(known and known.spread).cast("double").alias("spread"), F.lit(known and known.step).cast("double").alias("step"))
        fence = F.coalesce(f"s_{r}", f"l_{r}", top)
        beyond = beyond | F.coalesce(F.col(r) > fence["spread"] + EVENTS * F.greatest(fence["step"], F.col(f"{r}_step")), F.lit(False))
    return j.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"))
