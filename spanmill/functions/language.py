"""Which language a text is in, by its script and its commonest short words; sure with twenty letters or more."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanmill.functions.text import SCRIPT_BLOCKS

SURE = 20
# fixed values: the commonest short words of languages in Latin script, languages that have a script to themselves, and code aliases
WORDS = {
    "en": "the of and to in is that it was for on with as be this are not you have from at by", "fr": "le la les de des et est en un une du que qui dans pour pas sur au avec ce il",
    "de": "der die das und ist nicht ein eine zu den von mit sich auf für dem im auch es an werden", "es": "el la los las de que y en un una es por con para del se no su al lo como más",
    "pt": "o a os as de que e em um uma do da não para com por se na no mais como", "it": "il la di che e un una in per non con del della sono si da come più gli", "nl": "de het een en van is dat niet te op met voor zijn er aan ook als die",
    "ms": "yang dan di untuk dengan ini itu dari pada adalah tidak ke dalam akan orang juga",
}
ONLY = {"Greek": "el", "Hebrew": "he", "Arabic": "ar", "Devanagari": "hi", "Thai": "th", "Hangul": "ko", "Hiragana": "ja", "Katakana": "ja", "Han": "zh", "Cyrillic": "ru"}
ALIASES = {"id": "ms", "ind": "ms", "zsm": "ms", "msa": "ms", "may": "ms", "cmn": "zh", "zho": "zh", "chi": "zh", "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl", "rus": "ru", "jpn": "ja", "kor": "ko", "ara": "ar", "heb": "he", "ell": "el", "hin": "hi", "tha": "th"}
_KNOWN = {lang: set(words.split()) for lang, words in WORDS.items()}
_WORD = re.compile(r"[^\W\d_]+")


def canonical(code: str) -> str:
    """A language code in lower case, two letters where known, without region or script."""
    base = re.split("[-_]", code.strip().lower())[0]
    return ALIASES.get(base, base)


def detect(text: str | None) -> str | None:
    """The language of a text, or None where it can't be told; ties go to the first in alphabetical order."""
    words = _WORD.findall((text or "").lower())
    letters = "".join(words)
    if not letters:
        return None
    counts = {s: sum(any(a <= ord(c) <= b for a, b in blocks) for c in letters) for s, blocks in SCRIPT_BLOCKS.items()}
    counts["Hiragana"] *= 1 + 2 * (counts["Hiragana"] > 0)  # Japanese is written in Han characters too
    script = max(counts, key=lambda s: counts[s])
    if not counts[script] or len(letters) < SURE and script == "Latin":
        return None
    if script != "Latin":
        return ONLY[script]
    hits = {lang: sum(w in known for w in words) for lang, known in sorted(_KNOWN.items())}
    best = max(hits, key=lambda lang: hits[lang])
    return best if hits[best] else None


@F.pandas_udf(StringType())
def _detected(text: pd.Series) -> pd.Series:
    return text.map(detect)


def detected(text: Column) -> Column:
    return _detected(text)


def canonical_code(code: Column) -> Column:
    """``canonical`` in column form."""
    base = F.split(F.lower(F.trim(code)), "[-_]")[0]
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))[base], base)
