"""Column functions on text: cleaning, sentences, fingerprints, labels. Native expressions, but for rare character references."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of interstitial pages, in order of precedence, and how far they are looked for.
CHALLENGE_MARKERS = (
    "making sure you're not a bot",
    "you are seeing this because the administrator of this website",
    "checking your browser before accessing",
    "enable javascript and cookies to continue",
    "verify you are human",
    "just a moment...",
    "ddos protection by",
    "please complete the security check",
)
CHALLENGE_WINDOW = 600
#: The same for link checks, whose window is wider, and the least size of a full page.
WALL_MARKERS = ("not a bot", "just a moment", "attention required", "cf-browser-verification", "checking your browser", "enable javascript and cookies")
WALL_WINDOW = 20_000
MIN_PAGE = 6_000
#: What is dropped from a page, what ends a line in it, what a tag is, and any other character reference.
DROPPED = ("script", "style", "noscript", "svg", "form", "select")
BOILERPLATE = ("nav", "footer", "aside")
LINE_ENDS = r"(?is)<br\s*/?>|</p>|</div>|</li>|</h[1-6]>"
TAG = r"(?s)<[^>]+>"
REFERENCE = r"&(?:#[0-9]|#[xX][0-9A-Fa-f]|[A-Za-z])"
#: A character that no text has, in begins that must not be found.
DEAD = "\uffff"
#: A caption's artefact, and the white space between two sentences.
ARTEFACT = r"\[[^\]]{1,20}\]"
BETWEEN_SENTENCES = r"(?<=[.!?])\s+(?=[A-Z(\"'])"
#: Named character references that are decoded natively; ``&amp;`` comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def collapse(text: Column, unicode_space: bool = False) -> Column:
    """White space runs become one space, none at the ends."""
    space = r"(?U)\s+" if unicode_space else r"\s+"
    return F.btrim(F.regexp_replace(text, space, " "))


def clean_text(text: Column, unicode_space: bool = False) -> Column:
    """Caption artefacts such as ``[Music]`` go, white space collapses; case and marks stay."""
    return collapse(F.regexp_replace(text, ARTEFACT, " "), unicode_space)


def clean_segments(segments: Column) -> Column:
    """Cues with cleaned text; those that are empty then are dropped, missing times are zero."""
    cleaned = F.transform(
        segments,
        lambda s: F.struct(
            clean_text(F.coalesce(s["text"], F.lit(""))).alias("text"),
            F.coalesce(s["start"], F.lit(0.0)).alias("start"),
            F.coalesce(s["duration"], F.lit(0.0)).alias("duration"),
        ),
    )
    return F.filter(cleaned, lambda s: s["text"] != "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is evaluated once however often it is used; no Python within."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def unescape_native(text: Column) -> Column:
    """The named references of ENTITIES decoded."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def needs_full(text: Column) -> Column:
    """Whether a text has a reference that is none of ENTITIES; a name without its semicolon counts too."""
    plain = "|".join(name[1:] for name, _ in ENTITIES)
    return F.regexp_like(text, F.lit(f"&(?!{plain}){REFERENCE[1:]}"))


def unescape_any(text: Column) -> Column:
    """Every reference decoded, hard spaces to plain ones: natively where a text has only those of ENTITIES, else in Arrow batches of such texts alone."""
    return F.translate(F.coalesce(unescape_full(F.when(needs_full(text), text)), unescape_native(text)), "\xa0", " ")


#: So many elements' begins may be searched for their end in vain before they are looked at beforehand.
FEW = 32


def _without_dead(text: Column, names: tuple[str, ...], ends: str) -> Column:
    """``text`` with a mark in begins of elements that no end follows, so that their pattern passes them by.

    A begin is dead if no ``>`` lies between it and the last end of its name.
    """
    for name in names:
        def marked(t: Column, name: str = name) -> Column:
            return bound(F.length(F.regexp_extract(t, f"(?is)^(.*>)[^>]*</{name}>", 1)), lambda n: F.concat(F.left(t, n), F.regexp_replace(F.substring(t, n + 1, F.length(t)), f"(?i)<({name}{ends})", f"<{DEAD}$1")))

        text = bound(text, marked)
    return text


def _elements(text: Column, names: tuple[str, ...], ends: str) -> Column:
    """``text`` with a space for each element of these names, from its begin to the next end of its name; linear in the text's length."""
    begins, whole = f"(?i)<(?:{'|'.join(names)}){ends}", rf"(?is)<({'|'.join(names)}){ends}[^>]*>.*?</\1>"
    dropped = lambda t: F.regexp_replace(t, whole, " ")
    safe = lambda t: F.replace(dropped(_without_dead(t, names, ends)), F.lit(f"<{DEAD}"), F.lit("<"))
    return bound(text, lambda t: F.when(F.regexp_count(t, F.lit(begins)) <= FEW, dropped(t)).otherwise(safe(t)))


def _tags(text: Column) -> Column:
    """``text`` with a space for each tag. Behind the last ``>`` none can end, and it would be searched for from each ``<``."""
    after = lambda t: F.substring_index(t, ">", -1)
    return bound(text, lambda t: F.concat(F.regexp_replace(F.left(t, F.length(t) - F.length(after(t))), TAG, " "), after(t)))


def stripped(page: Column) -> Column:
    """A page without its tags and what is no text in it, lines where blocks end; references are as they were."""
    text = _elements(_elements(page, DROPPED, ""), BOILERPLATE, r"\b")
    return _tags(F.regexp_replace(text, LINE_ENDS, "\n"))


def as_lines(text: Column) -> Column:
    """Lines with white space collapsed, without empty ones."""
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda x: collapse(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def html_to_text(page: Column) -> Column:
    """Text of a page: script-like and boilerplate elements and tags go, blocks become lines.

    Native, so only the references of ENTITIES are decoded; ``page_text`` decodes all.
    """
    return as_lines(unescape_native(stripped(page)))


def page_text(df: DataFrame, page: str, out: str) -> DataFrame:
    """``df`` with ``out``: a column's text as ``html_to_text`` gives it, with every reference decoded.

    Each page is stripped once, in a projection of its own, and only pages with rare references go to Python.
    """
    df = df.withColumn("__stripped", stripped(F.col(page)))
    return df.withColumn(out, as_lines(unescape_any(F.col("__stripped")))).drop("__stripped")


def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape_full(text: Column) -> Column:
    """Every named and numeric reference decoded, in Arrow batches. Filters stay above it, so that no text is decoded twice."""
    return F.pandas_udf(_unescaped, "string").asNondeterministic()(text)


def pseudo_cues(text: Column, max_chars: int = 400) -> Column:
    """Pieces of prose: lines, and sentences of lines that are longer than ``max_chars``."""
    lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), lambda x: clean_text(x)), lambda x: x != "")
    cut = lambda x: F.split(x, BETWEEN_SENTENCES)
    return F.flatten(F.transform(lines, lambda x: F.when(F.length(x) <= max_chars, F.array(x)).otherwise(cut(x))))


def word_count(text: Column) -> Column:
    """Words by white space: the default token counter."""
    bare = F.btrim(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalise(text: Column) -> Column:
    """Lower case, only ASCII letters, digits and single spaces: one class of characters, so that its pattern takes a single pass."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def hash60(text: Column) -> Column:
    """60 uniform bits from md5, the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shingles(words: Column, k: int = 8) -> Column:
    """Distinct hashes of all runs of ``k`` words; fewer words are one shingle.

    ``words`` should be a plain column: each run would evaluate an expression anew. Words are got
    one by one, as a slice would copy the whole array for each run.
    """
    run = lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: hash60(run(i)))
    return F.array_distinct(F.when(F.size(words) < k, F.array(hash60(F.array_join(words, " ")))).otherwise(runs))


def bottom_k(hashes: Column, k: int = 128) -> Column:
    """The sketch: the ``k`` smallest hashes, in order."""
    return F.slice(F.sort_array(hashes), 1, k)


def sketch_jaccard(a: Column, b: Column, k: int = 128) -> Column:
    """Of the ``k`` smallest hashes of both, the share that both have; 0 if either is empty."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(union))


def containment(jaccard: Column, n_a: Column, n_b: Column) -> Column:
    """The share of a's shingles that b has, from the sketches' Jaccard and the counts."""
    shared = jaccard * (n_a + n_b) / (1 + jaccard)
    return F.when((n_a == 0) | (jaccard == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), shared / n_a))


def marker(text: Column, markers: tuple[str, ...], window: int) -> Column:
    """The first of ``markers`` in the text's lowered first ``window`` characters; null if none."""
    head = F.lower(F.substring(text, 1, window))
    return F.coalesce(*[F.when(F.contains(head, F.lit(m)), F.lit(m)) for m in markers])


def challenge_marker(text: Column) -> Column:
    return marker(text, CHALLENGE_MARKERS, CHALLENGE_WINDOW)


def page_status(text: Column, status: Column, thin_ok: Column) -> Column:
    """``error``, ``wall``, ``thin`` or ``ok``, in that precedence."""
    return (
        F.when(status >= 400, "error")
        .when(marker(text, WALL_MARKERS, WALL_WINDOW).isNotNull(), "wall")
        .when((F.length(text) < MIN_PAGE) & ~thin_ok, "thin")
        .otherwise("ok")
    )


def question_key(question: Column) -> Column:
    """What recordings are looked up by: case and white space do not matter."""
    return F.regexp_replace(F.lower(F.btrim(question)), r"\s+", " ")


def timestamp_label(seconds: Column) -> Column:
    """``m:ss``, or ``-`` without a time."""
    s = F.floor(seconds).cast("long")
    label = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))
    return F.when(seconds.isNull(), "-").otherwise(label)


def deep_link(url: Column, seconds: Column) -> Column:
    """A video's url with the whole second at which the passage starts; other urls as they are."""
    video = F.contains(url, F.lit("youtube.com")) | F.contains(url, F.lit("youtu.be"))
    joiner = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    return F.when(seconds.isNotNull() & video, F.concat(url, joiner, F.lit("t="), F.floor(seconds).cast("string"), F.lit("s"))).otherwise(url)


def provenance(kind: Column) -> Column:
    """The three states of a transcript; prose has none."""
    return F.when(kind == "manual", "human-verified").when(kind == "auto", "auto-caption").otherwise("")
