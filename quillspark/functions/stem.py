"""English stemming (the published Porter2 rules), as an analyser for indexes and queries."""

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.functions.workers import ship_package

# Words with stems of their own, words that are not stemmed further, endings and what replaces them.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINAL = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_VOWEL = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _region(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", word))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; other scripts and short words stay."""
    if len(word) < 3:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub(r"'s?'?$", "", w)
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].+s$", w):
        w = w[:-1]
    if w in FINAL:
        return w
    # Past and progressive forms.
    if m := re.search(r"(eed|eedly)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(edly|ingly|ed|ing)$", w)) and re.search(f"[{_VOWEL}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    w = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", w)
    # Derived forms, longest ending first.
    if m := re.search(rf"({'|'.join(sorted([*SECOND, 'ogi', 'li'], key=len, reverse=True))})$", w):
        end, kept = m[1], w[: m.start()]
        if m.start() >= r1:
            if end == "ogi":
                w = kept + "og" if kept.endswith("l") else w
            elif end == "li":
                w = kept if kept[-1:] in "cdeghkmnrt" and kept else w
            else:
                w = kept + SECOND[end]
    if m := re.search(rf"({'|'.join(sorted([*THIRD, 'ative'], key=len, reverse=True))})$", w):
        if m[1] == "ative":
            w = w[: m.start()] if m.start() >= r2 else w
        elif m.start() >= r1:
            w = w[: m.start()] + THIRD[m[1]]
    if m := re.search(rf"({'|'.join(FOURTH)}|ion)$", w):
        if m.start() >= r2 and (m[1] != "ion" or w[: m.start()].endswith(("s", "t"))):
            w = w[: m.start()]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed_tokens(text: Column | str) -> Column:
    """tokens() of a text, stemmed; give it to build_index() as the analyser, and to the terms of its queries."""
    ship_package()

    @F.pandas_udf("array<string>")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: [stem(w) for w in ws] if ws is not None else [])

    return run(tokens(text))
