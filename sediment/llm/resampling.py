"""Importance resampling of documents towards a target distribution, by hashed n-grams.

Method. A text's features are its runs of 1 to ``n`` words, hashed into ``buckets``. A bucket's gain
is the log of how much likelier it is in the target than in the documents; a document's weight is
the mean gain of its features, and its score the weight with seeded Gumbel noise, so that the
highest scores are a draw without replacement in proportion to the weights' exponentials.

Overlap chunking: a text longer than ``long_bytes`` is split at word boundaries into chunks of
``chunk_words`` starting positions. Each chunk carries the n - 1 words after its last position, so
that it alone holds every feature that starts in it, and none is counted twice. The chunks of long
texts are dealt over all tasks; counts and gains of chunks are summed by document. Shorter texts
are one chunk each and stay where they are read. The gains are a table of ``buckets`` rows, which
alone bounds what is sent to the tasks.

The draw: a histogram of the whole-numbered scores gives the score at which the draw ends, and
only documents from there on are laid in order, by ranges.

Defined cases: a null or empty text has no features, weight 0 and is not drawn (unless
``min_words`` is 0); repeated rows and rows of one or no identifier are documents by themselves,
share their noise, and take neighbouring ranks; a null identifier hashes as the empty string and
comes last among ties; an empty table gives an empty result; an empty target leaves the gains to
the documents' counts alone; only the named columns are read. ``docs`` must be stable, as files
are: it is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import named, running, written

N, BUCKETS, SHARE, MIN_WORDS, SEED = 1, 10_000, 10, 20, "2024"
CHUNK_WORDS, LONG_BYTES = 4096, 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order, A-Z not yet lower-cased; a null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def chunks(df: DataFrame, n: int = N, chunk_words: int = CHUNK_WORDS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(rid, id, n_words, w, own): chunks of the documents (rid, id, text). ``own`` of the words in ``w`` are starting positions."""
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes
    short = df.where(~is_long).select("rid", "id", words(F.col("text")).alias("w"))
    short = short.select("rid", "id", F.size("w").cast("long").alias("n_words"), "w", F.size("w").alias("own"))
    cut = df.where(is_long).select("rid", "id", words(F.col("text")).alias("all"))
    cut = cut.select("rid", "id", F.size("all").cast("long").alias("n_words"), F.explode_outer(F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size("all"), F.lit(1)) - 1) / chunk_words).cast("int")),
        lambda k: F.struct(k.alias("chunk"), F.slice("all", k * chunk_words + 1, chunk_words + n - 1).alias("w")),
    )).alias("c"))
    dealt = cut.select("rid", "id", "n_words", "c.*").repartition("rid", "chunk")
    own = F.least(F.size("w"), F.greatest(F.col("n_words") - F.col("chunk") * chunk_words, F.lit(0)), F.lit(chunk_words)).cast("int")
    return short.unionByName(dealt.select("rid", "id", "n_words", "w", own.alias("own")))


def _runs(n: int) -> Column:
    """All features that start at a chunk's own positions."""
    if n == 1:
        return F.col("w")
    from_ = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(n), F.size("w") - i)), lambda k: F.array_join(F.slice("w", i + 1, k), " "))
    return F.when(F.col("own") > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.col("own") - 1), from_))).otherwise(F.array().cast("array<string>"))


def features(chunked: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(rid, id, n_words, bucket): a row for each feature; a document without any has one with a null bucket."""
    each = chunked.select("rid", "id", "n_words", F.explode_outer(_runs(n)).alias("f"))
    return each.select("rid", "id", "n_words", F.pmod(F.crc32(lowered(F.col("f")).cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def _rows(df: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("rid"), (named(id_col).cast("long") if id_col else F.lit(None).cast("long")).alias("id"), named(text_col).alias("text"))


def bucket_counts(df: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS, **cut: int) -> DataFrame:
    """(bucket, count) of a table's features."""
    found = features(chunks(_rows(df, None, text_col), n, **cut), n, buckets)
    return found.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, in thousandths: the log of its smoothed share in the target over that in the raw counts."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("count", "s"), "bucket", "left").join(target.withColumnRenamed("count", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    both = both.join(F.broadcast(sums))  # one row
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(identifier: Column, seed: str = SEED) -> Column:
    """Seeded Gumbel noise in thousandths, from 32 bits of SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, gained: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, buckets: int = BUCKETS, seed: str = SEED, **cut: int) -> DataFrame:
    """(id_col, n_words, n_features, weight, score) of every row of ``docs``."""
    found = features(chunks(_rows(docs, id_col, text_col), n, **cut), n, buckets)
    found = found.join(F.broadcast(gained), "bucket", "left")  # as many rows as the parameter says
    summed = found.groupBy("rid", "id").agg(F.max("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("g"))
    weight = F.when(F.col("n_features") > 0, F.expr("(g - pmod(g, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    out = summed.withColumn("weight", weight)
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"))


def drawn(scored: DataFrame, id_col: str = "doc_id", share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored``, a written table, with ``rank``: of N documents long enough, the floor(share * N / 100) best from 1; else null."""
    fit = F.col("n_words") >= min_words
    hist = scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    # Scores are thousandths of logs: a few ten thousand values, however many documents.
    upto = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score")))
    want = F.floor(F.lit(share) * F.sum("c").over(Window.partitionBy(F.lit(0))) / 100)
    end = hist.select("score", upto.alias("upto"), want.alias("want")).where("want > 0 and upto >= want").agg(F.max("score"), F.min("want"), F.min("upto")).first()
    none = F.lit(None).cast("long").alias("rank")
    if end[0] is None:
        return scored.select("*", none)
    inside = fit & (F.col("score") >= end[0])
    laid = running(scored.where(inside), [F.desc("score"), F.col(id_col).asc_nulls_last()], F.lit(1), "rank", end[2])
    best = laid.withColumn("rank", F.when(F.col("rank") < end[1], F.col("rank") + 1).cast("long"))
    return best.unionByName(scored.where(~inside).select("*", none))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = N, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: str = SEED, chunk_words: int = CHUNK_WORDS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of every document; rank 1 is the first drawn."""
    cut = {"chunk_words": chunk_words, "long_bytes": long_bytes}
    gained = written(gains(bucket_counts(docs, text_col, n, buckets, **cut), bucket_counts(target, target_text, n, buckets, **cut), buckets), "gains")
    scored = written(weighed(docs, gained, id_col, text_col, n, buckets, seed, **cut), "scored")
    return drawn(scored, id_col, share, min_words)
