"""English stemming after the published Porter2 (Snowball English) algorithm,
run on Arrow batches with each distinct word stemmed once per batch."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F, types as T

# The published English stop word list.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()

# Words the published algorithm treats apart.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
STOP_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
]
STEP4 = (
    "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic"
).split()

_V = "[aeiouy]"
_REGION = re.compile(rf"{_V}[^aeiouy]")
_SHORT_END = re.compile(rf"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", re.S)


def _regions(word: str) -> tuple[int, int]:
    lead = re.match(r"gener|commun|arsen", word)
    hit = lead or _REGION.search(word)
    r1 = hit.end() if hit else len(word)
    hit = _REGION.search(word, r1)
    return r1, hit.end() if hit else len(word)


def _has_vowel(text: str) -> bool:
    return re.search(_V, text) is not None


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub(r"(?<=[aeiouy])y|^y", "Y", word)
    r1, r2 = _regions(w)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in STOP_AFTER_1A:
        return w

    ending = re.search(r"(eedly|ingly|edly|eed|ing|ed)$", w)
    if ending:
        tail, head = ending.group(1), w[: ending.start()]
        if tail in ("eed", "eedly"):
            w = head + "ee" if ending.start() >= r1 else w
        elif _has_vowel(head):
            if head.endswith(("at", "bl", "iz")):
                w = head + "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", head):
                w = head[:-1]
            elif len(head) <= r1 and _SHORT_END.match(head):
                w = head + "e"
            else:
                w = head
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    for old, new in STEP2:
        if w.endswith(old):
            at = len(w) - len(old)
            allowed = at >= r1
            if old == "ogi":
                allowed = allowed and w[:at].endswith("l")
            elif old == "li":
                allowed = allowed and at > 0 and w[at - 1] in "cdeghkmnrt"
            w = w[:at] + new if allowed else w
            break
    for old, new in STEP3:
        if w.endswith(old):
            at = len(w) - len(old)
            if at >= (r2 if old == "ative" else r1):
                w = w[:at] + new
            break
    for old in STEP4:
        if w.endswith(old):
            at = len(w) - len(old)
            if at >= r2 and (old != "ion" or w[:at].endswith(("s", "t"))):
                w = w[:at]
            break

    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _SHORT_END.match(w[:at])):
            w = w[:at]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_batch(tokens: pd.Series) -> pd.Series:
    """Stems of token lists: every distinct token of a batch is stemmed once."""
    import numpy as np

    lengths = np.array([0 if row is None else len(row) for row in tokens], dtype=np.int64)
    flat = [t for row in tokens if row is not None for t in row]
    codes, distinct = pd.factorize(np.array(flat, dtype=object))  # a null token has code -1
    stems = np.array([stem(t) for t in distinct] + [None], dtype=object)[codes]
    ends = np.cumsum(lengths)
    return pd.Series([None if row is None else stems[e - n : e] for row, e, n in zip(tokens, ends, lengths)], index=tokens.index)
