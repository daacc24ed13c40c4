"""Quality rules whose thresholds come from the corpus: mergeable sketches per language and source.

Method. Every document gets a few whole-number measures. A sketch of a measure is a histogram
whose bins keep the six leading bits of the value (a relative error below 1/32), so two sketches
merge by adding counts, in any order, to the same result. Sketches are kept per language and
source, and merged into sketches per language and of the corpus, which stand in where a source
has fewer than ``min_rows`` documents. Fences lie ``reach`` quartile distances outside the
quartiles, and the joined documents must lie within them. Native DataFrame operations only.

Defined cases: a null or empty text has no words and fails the base rule; null languages and
sources are groups of their own; repeated rows are judged alike, one by one; an empty table gives
an empty result; extra columns pass through, but one that has the name of a result gives way to it.
Windows of five words are compared by 64-bit hashes within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS, WS_CLASS, beside_all, with_room, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Measures with a fence below, above. All are per hundred or per thousand words or lines.
MEASURES = {"word_len": (True, True), "symbols": (False, True), "dup_lines": (False, True), "repeats": (False, True)}
#: The quartile distance counts as at least this much, so that a constant measure has a fence with room.
LEAST_SPREAD = {"word_len": 60, "symbols": 40, "dup_lines": 100, "repeats": 60}
REACH = 3
MIN_ROWS = 200
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five counts of ``BASE`` and ``base_failed``; every text is read once, whole."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.split(F.btrim(t, F.lit(WS)), WS_CLASS + "+")
    step = df.withColumn("__w", F.transform(words, lambda w: F.xxhash64(w)))
    step = step.withColumn("n_words", F.when(F.btrim(t, F.lit(WS)) == "", 0).otherwise(F.size("__w")).cast("long"))
    step = step.withColumn("word_chars", (F.length(t) - _removed(t, WS)).cast("long"))
    step = step.withColumn("n_symbols", _removed(t, SYMBOLS).cast("long"))
    step = step.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != ""))
    step = step.withColumn("n_lines", F.size("__l").cast("long"))
    step = step.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    at = lambda i, k: F.get(F.col("__w"), i + k)
    step = step.withColumn(
        "__h",
        F.when(F.col("n_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size("__w") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
        ),
    )
    # Only a document in which some window repeats needs the windows in order of hash, with their places.
    step = step.withColumn(
        "__s",
        F.when(
            F.size(F.array_distinct("__h")) < F.size("__h"),
            F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    s = F.col("__s")
    same = lambda x, i: F.get(s, i)["h"] == x["h"]
    step = step.withColumn(
        "__p",
        F.when(
            s.isNotNull(),
            F.sort_array(F.transform(
                F.filter(s, lambda x, i: F.coalesce(F.when(i > 0, same(x, i - 1)), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False))),
                lambda x: x["i"],
            )),
        ),
    )
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "__p", start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"))
    )["n"]
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return step.withColumn("base_failed", failed).drop("__w", "__l", "__h", "__s", "__p")


def with_measures(df: DataFrame) -> DataFrame:
    """Adds ``m_<measure>``, whole numbers, to a result of ``base_counts``."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    per = lambda top, by: F.floor(top / by).cast("long")
    return (
        df.withColumn("m_word_len", per(100 * F.col("word_chars"), n))
        .withColumn("m_symbols", per(1000 * F.col("n_symbols"), n))
        .withColumn("m_dup_lines", per(1000 * F.col("n_dup_lines"), lines))
        .withColumn("m_repeats", per(1000 * F.col("n_repeat_words"), n))
    )


def sketch_bin(value: Column) -> Column:
    """The lower edge of the value's bin: its six leading bits, the rest zero."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def group_key(col: str) -> Column:
    """The column as a key that tells null from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("-"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang_key, source_key, measure, bin, n): documents that pass the base rule, counted by bin."""
    rows = measured.where(~F.col("base_failed")).select(
        "lang_key", "source_key",
        F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), sketch_bin(F.col(f"m_{m}")).alias("bin")) for m in MEASURES])),
    )
    return rows.groupBy("lang_key", "source_key", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: the bins' counts, added."""
    return sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """For each group: its rows, and ``lo_<measure>`` and ``hi_<measure>`` from the sketch's quartiles."""
    upto = Window.partitionBy(*keys, "measure").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "measure")
    cum = sketch.withColumn("cum", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
    quart = cum.groupBy(*keys, "measure").agg(
        F.first("all").alias("rows"),
        F.min(F.when(4 * F.col("cum") >= F.col("all"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("cum") >= 3 * F.col("all"), F.col("bin"))).alias("q3"),
    )
    spread = F.create_map(*[x for m, v in LEAST_SPREAD.items() for x in (F.lit(m), F.lit(v))])[F.col("measure")]
    quart = quart.withColumn("d", reach * F.greatest(F.col("q3") - F.col("q1"), spread))
    pick = lambda m, value: F.max(F.when(F.col("measure") == m, value))
    aggs = [F.max("rows").alias("rows")]
    for m, (low, high) in MEASURES.items():
        aggs += [pick(m, F.col("q1") - F.col("d")).alias(f"lo_{m}")] * low + [pick(m, F.col("q3") + F.col("d")).alias(f"hi_{m}")] * high
    return quart.groupBy(*keys).agg(*aggs) if keys else quart.agg(*aggs)


def thresholds(sketch: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per language and source: its own fences, or its language's, or the corpus's, by rows."""
    own = fences(sketch, ["lang_key", "source_key"])
    lang = fences(merge_sketches(sketch, ["lang_key"]), ["lang_key"])
    every = fences(merge_sketches(sketch, []), [])
    names = [c for c in own.columns if c[:3] in ("lo_", "hi_")]
    lang = lang.select("lang_key", F.col("rows").alias("rows_l"), *[F.col(c).alias(f"l_{c}") for c in names])
    every = every.select(*[F.col(c).alias(f"e_{c}") for c in names])  # one row
    t = own.join(lang, "lang_key", "left").join(every, F.lit(True), "left")
    level = F.when(F.col("rows") >= min_rows, "source").when(F.col("rows_l") >= min_rows, "language").otherwise("corpus")
    t = t.withColumn("level", level)
    pick = lambda c: F.when(F.col("level") == "source", F.col(c)).when(F.col("level") == "language", F.col(f"l_{c}")).otherwise(F.col(f"e_{c}"))
    return t.select(F.col("lang_key").alias("__lang"), F.col("source_key").alias("__source"), "level", *[pick(c).alias(c) for c in names])


def apply_rules(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``kept``: joined to their group's fences, documents must pass the base rule and every fence."""
    joined = measured.join(limits, (F.col("lang_key") == F.col("__lang")) & (F.col("source_key") == F.col("__source")), "left")
    inside = F.lit(True)
    for m, (low, high) in MEASURES.items():
        if low:
            inside = inside & F.coalesce(F.col(f"m_{m}") >= F.col(f"lo_{m}"), F.lit(True))
        if high:
            inside = inside & F.coalesce(F.col(f"m_{m}") <= F.col(f"hi_{m}"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("__lang", "__source")


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, carry_text: bool = True, min_rows: int = MIN_ROWS) -> DataFrame:
    """All rows of ``df`` with counts, measures, fences and ``kept``.

    The measured table is written once: the sketches and the joined filter both read it. With
    ``carry_text`` false the texts are not in it, nor in the result.
    """
    results = [*BASE, "n_lines", "base_failed", "kept", "lang_key", "source_key", "level", *[f"{p}_{m}" for m in MEASURES for p in ("m", "lo", "hi")]]
    df = with_room(df, [text, lang, source], results)
    measured = with_measures(base_counts(df, text)).withColumn("lang_key", group_key(lang)).withColumn("source_key", group_key(source))
    if not carry_text:
        measured = measured.drop(text)
    measured = written(measured, "measures")
    return apply_rules(measured, beside_all(thresholds(sketches(measured), min_rows), "fences"))
