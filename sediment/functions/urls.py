"""Column functions on urls: one spelling for each document, hosts, kinds, raw addresses. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Hosts that may not be ingested, parameters that name a document, and hosts by kind.
DENIED = ("gdcvault.com", "vault.gdconf.com")
MEANINGFUL = ("v", "t", "id", "p", "page", "q")
VIDEO_HOSTS = ("youtube.com", "youtu.be")
REPO_HOSTS = ("github.com", "gitlab.com", "sourceforge.net")
BRANCHES = ("HEAD", "main", "master")
READMES = ("README.md", "readme.md", "README.rst", "README")
LICENSES = {"talk": "gdc-youtube-free", "repo": "public-source"}
OTHER_LICENSE = "public-web"


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1)


def host(url: Column) -> Column:
    """The host as written, with its port, lower case, without a leading ``www.``; empty without ``//``."""
    return F.regexp_replace(F.lower(_part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")), r"^www\.", "")


registrable_domain = host


def path(url: Column) -> Column:
    return _part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")


def query(url: Column) -> Column:
    return _part(url, r"^[^?#]*\?([^#]*)")


def _parameter(asked: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(asked, rf"(?:^|&){name}=([^&]+)", 1), F.lit(""))


def parameter(url: Column, name: str) -> Column:
    """The first value of a parameter, if it has one that is not empty."""
    return _parameter(query(url), name)


def _video(h: Column, p: Column, q: Column) -> Column:
    short = F.nullif(F.substring(F.regexp_replace(p, "^/+", ""), 1, 11), F.lit(""))
    watch = F.contains(h, F.lit("youtube.com")) & F.startswith(p, F.lit("/watch"))
    return F.when(F.endswith(h, F.lit("youtu.be")), short).when(watch, F.substring(_parameter(q, "v"), 1, 11))


def video_id(url: Column) -> Column:
    """The eleven characters that name a video; null for other pages."""
    return _video(host(url), path(url), query(url))


def recoded(part: Column) -> Column:
    """A parameter's name or value decoded and coded again, so that spellings of one text are one; broken codes stay as they are."""
    coded = F.url_encode(F.coalesce(F.try_url_decode(part), part))
    return F.replace(F.replace(coded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _tail(q: Column) -> Column:
    """The meaningful parameters in order; a name without a sign is a parameter with an empty value."""
    split = F.transform(F.split(q, "&"), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("name"), F.regexp_replace(p, "^[^=]*=?", "").alias("value")))
    pairs = F.filter(split, lambda p: F.lower(p["name"]).isin(*MEANINGFUL))
    return F.array_join(F.array_sort(F.transform(pairs, lambda p: F.concat(recoded(p["name"]), F.lit("="), recoded(p["value"])))), "&")


def canonical_url(url: Column) -> Column:
    """https, bare lower-case host, no trailing slash, only meaningful parameters, in order; one form for videos.

    Host, path and query are cut out once, as are what is made of them.
    """
    parts = F.struct(host(url).alias("h"), path(url).alias("p"), query(url).alias("q"))
    # A last segment's own parameters, behind a semicolon, name no other document.
    bare = lambda u: F.regexp_replace(F.regexp_replace(u["p"], ";[^/]*$", ""), "/+$", "")
    tail = lambda u: F.when(u["q"] == "", "").otherwise(_tail(u["q"]))
    made = lambda u: F.struct(u["h"].alias("h"), bare(u).alias("p"), tail(u).alias("t"), _video(u["h"], u["p"], u["q"]).alias("v"), _parameter(u["q"], "t").alias("s"))

    def spelled(m: Column) -> Column:
        watch = F.concat(F.lit("https://youtube.com/watch?v="), m["v"], F.coalesce(F.concat(F.lit("&t="), recoded(m["s"])), F.lit("")))
        plain = F.concat(F.lit("https://"), m["h"], F.when(m["p"] == "", "/").otherwise(m["p"]), F.when(m["t"] == "", "").otherwise(F.concat(F.lit("?"), m["t"])))
        return F.when(m["v"].isNotNull(), watch).otherwise(plain)

    return bound(bound(parts, made), spelled)


def is_denied(url: Column) -> Column:
    """Whole hosts are compared, never parts of them."""
    return host(url).isin(*DENIED)


def _any(h: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.contains(h, F.lit(n))
    return out


def is_index_page(url: Column) -> Column:
    """Playlists and channels: a video host without a video."""
    return _any(host(url), VIDEO_HOSTS) & video_id(url).isNull()


def kind_of(url: Column) -> Column:
    return F.when(_any(host(url), VIDEO_HOSTS), "talk").when(_any(host(url), REPO_HOSTS), "repo").otherwise("blog")


def license_of(kind: Column) -> Column:
    out = F.lit(OTHER_LICENSE)
    for k, v in LICENSES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def github_raw_urls(url: Column) -> Column:
    """Candidate addresses of a repository's readme, best first, or of one file; empty for other pages."""
    seg = F.filter(F.split(path(url), "/"), lambda s: s != "")
    base = F.concat(F.lit("https://raw.githubusercontent.com/"), F.get(seg, 0), F.lit("/"), F.get(seg, 1), F.lit("/"))
    readmes = F.array(*[F.concat(base, F.lit(f"{b}/{n}")) for b in BRANCHES for n in READMES])
    file = F.array(F.concat(base, F.get(seg, 3), F.lit("/"), F.array_join(F.slice(seg, 5, F.greatest(F.size(seg) - 4, F.lit(0))), "/")))
    blob = (F.size(seg) > 4) & (F.get(seg, 2) == "blob")
    return F.when(host(url) != "github.com", F.array().cast("array<string>")).when(blob, file).when(F.size(seg) == 2, readmes).otherwise(F.array().cast("array<string>"))


def cache_key(url: Column) -> Column:
    """The name under which a raw response is kept."""
    return F.substring(F.sha2(url, 256), 1, 16)
