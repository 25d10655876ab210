"""English stems by the published Porter2 rules, and the stop words that go with them."""

from __future__ import annotations

import re
from functools import lru_cache

#: Words that a search leaves out.
ENGLISH_STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: Words with stems of their own, and words that the later steps leave alone.
OWN_STEMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Suffixes of steps 2 to 4 with what takes their place.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
LI_ENDINGS = "cdeghkmnrt"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

VOWEL = re.compile("[aeiouy]")
REGION = re.compile("[aeiouy][^aeiouy]")
SPECIAL_REGION = re.compile("gener|commun|arsen")
#: A short syllable at the end; upper-case Y is a consonant.
SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and again within R1."""
    m = SPECIAL_REGION.match(word) or REGION.search(word)
    r1 = m.end() if m else len(word)
    m = REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def plural(w: str) -> str:
    s = longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        return w[:-2]
    if s in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    if s == "s" and VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def past(w: str, r1: int) -> str:
    s = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        return w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    if s is None or not VOWEL.search(w[: -len(s)]):
        return w
    w = w[: -len(s)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if r1 >= len(w) and SHORT.search(w) else w


def derived(w: str, r1: int, r2: int) -> str:
    """Steps 2 to 5."""
    if (s := longest(w, STEP_2)) and len(w) - len(s) >= r1 and {"ogi": w[-4:-3] == "l", "li": w[-3:-2] in LI_ENDINGS}.get(s, True):
        w = w[: -len(s)] + STEP_2[s]
    if (s := longest(w, STEP_3)) and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + STEP_3[s]
    if (s := longest(w, STEP_4)) and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or (at >= r1 and not SHORT.search(w[:-1]))):
        return w[:-1]
    return w[:-1] if w.endswith("ll") and at >= r2 else w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and of other scripts, stay."""
    if len(word) < 3:
        return word
    if word in OWN_STEMS:
        return OWN_STEMS[word]
    w = re.sub("^y|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    r1, r2 = regions(w)
    s = longest(w, ("'", "'s", "'s'"))
    w = plural(w.removesuffix(s) if s else w)
    if w in KEPT:
        return w
    w = past(w, r1)
    if w[-1:] in ("y", "Y") and len(w) > 2 and not VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    return derived(w, r1, r2).lower()
