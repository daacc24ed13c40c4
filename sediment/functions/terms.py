"""Query terms: which words of a question count."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9_+#-]+"
MIN_LENGTH = 3
#: Words too common in speech to be evidence.
LOW_SIGNAL = (
    "should", "would", "could", "about", "what", "when", "where", "which", "have", "has", "had", "this", "that", "these", "those", "there", "here", "just", "make", "made",
    "really", "going", "want", "need", "know", "think", "thing", "things", "people", "team", "person", "good", "better", "best", "use", "using", "used", "lot", "bit", "way",
    "ways", "kind", "sort", "the", "and", "for", "with", "from", "into", "over", "under", "you", "your", "our", "are", "was", "were", "but", "not", "can", "will", "how", "why", "who", "its",
    "than", "then",
)


def tokens(text: Column) -> Column:
    """All words of a text in order, lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda t: F.lower(t))


def query_terms(question: Column) -> Column:
    """Distinct significant words in the order of the question."""
    low = F.array(*[F.lit(w) for w in LOW_SIGNAL])
    kept = F.filter(tokens(question), lambda t: (F.length(t) >= MIN_LENGTH) & ~F.array_contains(low, t))
    return F.array_distinct(kept)


def terms_of(question: str) -> list[str]:
    """The same for one question on the driver."""
    words = (w.lower() for w in re.findall(WORD, question))
    return list(dict.fromkeys(w for w in words if len(w) >= MIN_LENGTH and w not in LOW_SIGNAL))


def or_query(terms: list[str]) -> str:
    """The text of a query that any of the terms satisfies; empty if there are none."""
    return " | ".join(f"'{t}'" for t in terms)
