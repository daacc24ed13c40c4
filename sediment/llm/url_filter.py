"""URL verdicts from host and path rules, by hashed expressions. Native DataFrame operations only.

Method. A url is expanded into expressions: every suffix of its host at a dot, with every prefix
of its path that a rule could have. Expressions and rules meet in an equi-join on the first
``PREFIX`` hexadecimal digits of their SHA-256; a meeting counts only if the full digests agree.
Of a url's rules the longest wins; at equal length the longer host, then ``block``. Without a
rule the verdict is ``default``.

Urls are counted by host and path before they are expanded, so a url that fills a third of the
table is expanded once, and the rules' side is never a hot key. Up to BROADCAST_ROWS rules, which are
counted, are sent to the urls. More are met by distinct expressions; those that have a rule go back to the
urls salted by how many have them, as a third of all urls may end in ``com/``. Rows
are joined to their url's verdict by host and path together, which no two pairs share, as a host
has no slash; a url of many rows is salted there, and urls without a host meet nothing. As the verdicts grow with
the table, they are never sent to all rows.

Path prefixes are those that end in a slash and the whole path; if rules have paths that end
otherwise, also the prefixes of these rules' lengths, of which there are few. No expression is
longer than the rules' longest host and path, so a very long url has no more of them than others.

Defined cases: a null url, or one without ``://``, has empty host and path, and no rule fits it;
equal rows get equal verdicts, each its own row; rules without a host or verdict never fit; an
empty table gives an empty result; extra columns pass through, but one that has
the name of a result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_spread, row_hash, with_room, written

PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, ASCII lower case, and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_suffixes(host: Column, longest: int) -> Column:
    """Of the host and what follows each of its dots, those of at most ``longest`` characters."""
    long = F.length(host) > longest
    parts = F.split(F.when(long, F.right(host, F.lit(longest + 1))).otherwise(host), r"\.")
    # The first part of a long host's end is the rest of a label, or follows no dot within reach.
    first = F.when(long, 2).otherwise(1)
    return F.when(
        F.size(parts) >= first,
        F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")),
    ).otherwise(F.array().cast("array<string>"))


def path_prefixes(path: Column, lengths: list[int], longest: int) -> Column:
    """Of the prefixes that end in a slash, the whole path, and those of the given lengths, all of at most ``longest`` characters."""
    whole = F.when(F.length(path) <= longest, F.array(path)).otherwise(F.array().cast("array<string>"))
    path = F.substr(path, F.lit(1), F.lit(longest))
    parts = F.split(path, "/")
    slashed = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    out = F.concat(F.coalesce(slashed, F.array().cast("array<string>")), whole)
    if lengths:
        cut = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
        out = F.concat(out, F.transform(cut, lambda n: F.substr(path, F.lit(1), n)))
    return F.array_distinct(out)


def _met(digests: DataFrame, rules: DataFrame) -> DataFrame:
    """``digests`` (host, path, ed) with the rule (rk, rd, ...) of each expression that has one.

    Few rules are sent to the urls. Many are met by distinct expressions, each counted, and what is met goes
    back to the urls salted by its count: an expression like ``com/``, which a third of all urls may have, is one row there.
    """
    same = (F.col("ek") == F.col("rk")) & (F.col("ed") == F.col("rd"))
    prefix = F.substring("ed", 1, PREFIX)
    if rules.count() <= BROADCAST_ROWS:
        return digests.withColumn("ek", prefix).join(F.broadcast(rules), same)
    counted = written(digests.groupBy("ed").agg(F.count(F.lit(1)).alias("__en")), "expressions")
    found = counted.withColumn("ek", prefix).join(rules.hint("merge"), same).drop("ek", "ed")
    total = counted.agg(F.sum("__en")).first()[0] or 0
    return join_spread(digests, "ed", written(found, "met"), "rd", "__en", F.xxhash64("host", "path"), total).drop("__en")


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict. ``rules`` has host, path and verdict."""
    df = with_room(df, [url], ["host", "path", "rule", "verdict", "rv"])
    host, path = host_and_path(F.col(url))
    rows = df.withColumn("host", host).withColumn("path", path).withColumn("__by", row_hash(df))
    rows = rows.withColumn("__u", F.when(F.col("host") != "", F.concat("host", "path")))
    valid = rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isNotNull())
    valid = valid.select(F.col("host").alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), F.col("verdict").alias("rv"))
    reach = valid.agg(F.max(F.length("rh")), F.max(F.length("rp"))).first()
    odd = [r[0] for r in valid.where(~F.col("rp").endswith("/")).select(F.length("rp")).distinct().collect()]
    keyed = valid.withColumn("rule", F.concat("rh", "rp")).withColumn("rd", F.sha2(F.concat("rh", F.lit("\n"), "rp"), 256))
    keyed = keyed.groupBy("rd").agg(F.max(F.struct("rule", F.length("rh").alias("hl"), F.length("rule").alias("ln"), "rv")).alias("r"))
    keyed = keyed.select(F.substring("rd", 1, PREFIX).alias("rk"), "rd", "r.*")
    urls = rows.where(F.col("__u").isNotNull()).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    hosts = urls.select("host", "path", "n", F.explode(host_suffixes(F.col("host"), reach[0] or 0)).alias("eh"))
    digests = hosts.select("host", "path", "n", F.explode(F.transform(path_prefixes(F.col("path"), odd, reach[1] or 0), lambda p: F.sha2(F.concat(F.col("eh"), F.lit("\n"), p), 256))).alias("ed"))
    met = _met(digests, written(keyed, "rules"))
    best = met.groupBy("host", "path").agg(F.max(F.struct("ln", "hl", F.col("rv"), "rule")).alias("b"), F.max("n").alias("__n"))
    best = written(best.select(F.concat("host", "path").alias("__bu"), "__n", F.col("b.rule").alias("rule"), F.col("b.rv").alias("rv")), "verdicts")
    out = join_spread(rows, "__u", best, "__bu", "__n", F.col("__by"), df.count(), how="left")
    return out.withColumn("verdict", F.coalesce("rv", F.lit(default))).drop("__u", "__bu", "__n", "__by", "rv")
