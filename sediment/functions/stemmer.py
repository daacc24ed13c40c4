"""English stems of words: the published Porter2 rules, for words of a vocabulary, each once.

A word is stripped from the right in fixed steps. Where a step has several endings the longest that
the word has decides, whether its condition holds or not. ``R1`` begins behind the first consonant that
follows a vowel, ``R2`` is the same within ``R1``; a capital Y is a y that is a consonant.

Words with anything but ASCII letters and apostrophes, and those of two letters, are their own stem.
"""

from __future__ import annotations

import re

# The rules' endings, exceptions and the usual English stop list.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful",
    "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now"
).split()

_WORD = re.compile("[a-z']{3,}")
_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _regions(word: str) -> tuple[int, int]:
    given = re.match("gener|commun|arsen", word)
    first = given or _REGION.search(word)
    if first is None:
        return len(word), len(word)
    second = _REGION.search(word, first.end())
    return first.end(), second.end() if second else len(word)


def _longest_first(endings) -> tuple[str, ...]:
    return tuple(sorted(endings, key=len, reverse=True))


_ENDINGS1 = _longest_first(("eed", "eedly", "ed", "edly", "ing", "ingly"))
_ENDINGS2, _ENDINGS3, _ENDINGS4 = _longest_first(STEP2), _longest_first(STEP3), _longest_first(STEP4)


def _ending(word: str, endings: tuple[str, ...]) -> str | None:
    """The longest of the endings that the word has; they come longest first."""
    return next(filter(word.endswith, endings)) if word.endswith(endings) else None


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _participle(word: str, r1: int) -> str:
    end = _ending(word, _ENDINGS1)
    if end is None:
        return word
    rest = word[: -len(end)]
    if end.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else word
    if not _VOWEL.search(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _DOUBLE.search(rest):
        return rest[:-1]
    return rest + "e" if len(rest) <= r1 and _SHORT.search(rest) else rest


def _derived(word: str, r1: int, r2: int) -> str:
    end = _ending(word, _ENDINGS2)
    if end and len(word) - len(end) >= r1:
        rest = word[: -len(end)]
        if end == "ogi":
            word = rest + "og" if rest.endswith("l") else word
        elif end != "li" or rest[-1:] in set("cdeghkmnrt"):
            word = rest + STEP2[end]
    end = _ending(word, _ENDINGS3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP3[end]
    end = _ending(word, _ENDINGS4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if not _WORD.fullmatch(word):
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    r1, r2 = _regions(word)
    word = _plural(re.sub("'s'$|'s$|'$", "", word))
    if word in FINISHED:
        return word
    word = _participle(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT.search(word[:-1]))) or (word.endswith("ll") and at >= r2):
        word = word[:-1]
    return word.replace("Y", "y")
