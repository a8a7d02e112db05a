"""Text helpers that SQL lacks: normal forms, edit distances, scripts, JSON Schema; one Arrow batch at a time."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# fixed values: scripts by language, and the blocks a script's letters lie in
LANGUAGE_SCRIPTS = {"en": "Latin", "fr": "Latin", "de": "Latin", "es": "Latin", "ms": "Latin", "ru": "Cyrillic", "uk": "Cyrillic", "ar": "Arabic", "fa": "Arabic", "ur": "Arabic", "he": "Hebrew", "el": "Greek", "hi": "Devanagari", "th": "Thai", "zh": "Han", "ja": "Han,Hiragana,Katakana", "ko": "Hangul"}
SCRIPT_ALIASES = {"jawi": "Arabic", "chinese": "Han", "hanzi": "Han", "kanji": "Han", "korean": "Hangul"}
SCRIPT_BLOCKS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)], "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "Cyrillic": [(0x400, 0x52F)], "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)], "Devanagari": [(0x900, 0x97F)], "Thai": [(0xE00, 0xE7F)],
    "Hiragana": [(0x3040, 0x309F)], "Katakana": [(0x30A0, 0x30FF)], "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}


def normal_text(text: str) -> str:
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).lower()).strip()


@F.pandas_udf(StringType())
def _normalised(text: pd.Series) -> pd.Series:
    return text.map(normal_text, na_action="ignore")


def normalised(text: Column) -> Column:
    """NFKC, lower case, NFKC, trimmed."""
    return _normalised(text)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points, a column of the table at a time as bits of whole numbers (Myers, Hyyrö)."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    up, down = every, 0  # where the column rises and falls by one
    for c in b:
        same = at.get(c, 0)
        flat = same | down
        slant = ((same & up) + up ^ up | same) & every
        right, left = down | (slant | up) ^ every, up & slant
        right = (right << 1 | 1) & every
        up, down = left << 1 & every | (flat | right) ^ every, right & flat
    return len(b) + up.bit_count() - down.bit_count()


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def distance(a: Column, b: Column) -> Column:
    """``edit_distance``, once a row however often it is used; NULL where a text is."""
    return _distance(a, b)


def scripts_of(wanted: str) -> list[str] | None:
    """Script names for a script, alias or language; None if unknown."""
    key = wanted.strip().lower()
    named = SCRIPT_ALIASES.get(key) or LANGUAGE_SCRIPTS.get(key.split("-")[0]) or next((s for s in SCRIPT_BLOCKS if s.lower() == key), None)
    return named.split(",") if named else None


def share(text: str, wanted: str) -> float | None:
    """Letters of the wanted scripts among all letters; None without letters or for an unknown script."""
    scripts = scripts_of(wanted)
    letters = [ord(c) for c in text if c.isalpha()]
    if not scripts or not letters:
        return None
    blocks = [b for s in scripts for b in SCRIPT_BLOCKS[s]]
    return sum(any(a <= c <= b for a, b in blocks) for c in letters) / len(letters)


def _class(runs: list[tuple[int, int]]) -> str:
    """A class of code points from sorted runs: halves behind their own bounds, so that a character meets few of the runs."""
    if len(runs) <= 8:
        return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"
    halves = runs[: len(runs) // 2], runs[len(runs) // 2 :]
    return "[" + "".join(f"[\\x{{{half[0][0]:X}}}-\\x{{{half[-1][1]:X}}}&&{_class(half)}]" for half in halves) + "]"


@cache
def letters(scripts: str | None = None) -> str:
    """A pattern for letters of some scripts, or of any; the same letters as ``str.isalpha`` has, whatever the JVM's Unicode."""
    blocks = [b for s in scripts.split(",") for b in SCRIPT_BLOCKS[s]] if scripts else [(0, sys.maxunicode)]
    runs: list[tuple[int, int]] = []
    for c in (c for a, b in sorted(blocks) for c in range(a, b + 1) if chr(c).isalpha()):
        runs[-1:] = [(runs[-1][0], c)] if runs and runs[-1][1] == c - 1 else [*runs[-1:], (c, c)]
    return _class(runs) + "+"


def script_share(text: Column, wanted: Column) -> Column:
    """``share`` in column form: the text is cut down to what is no letter of the wanted scripts, then to what is no letter at all."""
    key = F.lower(F.btrim(wanted, F.lit("".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()))))
    found = lambda names, k: F.create_map(*(F.lit(x) for name, s in names.items() for x in (name, letters(s))))[k]
    pattern = F.coalesce(found(SCRIPT_ALIASES, key), found(LANGUAGE_SCRIPTS, F.split(key, "-")[0]), found({s.lower(): s for s in SCRIPT_BLOCKS}, key))
    others = F.regexp_replace(text, pattern, F.lit(""))
    rest = F.regexp_replace(others, F.lit(letters()), F.lit(""))
    return F.try_divide(F.length(text) - F.length(others), F.length(text) - F.length(rest))


def prompt_text(value: str) -> str:
    """The content and text strings of chat JSON; anything else as it is."""
    try:
        found: list[str] = []
        _collect(json.loads(value), found)
        return "\n".join(found) or value
    except ValueError:
        return value


def _collect(node, found: list[str]) -> None:
    if isinstance(node, dict):
        for key, own in node.items():
            if key in ("content", "text") and isinstance(own, str):
                found.append(own)
            else:
                _collect(own, found)
    elif isinstance(node, list):
        for own in node:
            _collect(own, found)


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return isinstance(value, _TYPES[kind])


def schema_error(value, schema, at: str = "$") -> str | None:
    """The first way in which value breaks a JSON Schema; references are not followed."""
    if isinstance(schema, bool):
        return None if schema else f"{at}: not allowed"
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not of type {kinds}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if "const" in schema and value != schema["const"]:
        return f"{at}: not the constant"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        for key, bad in (("minimum", lambda x: value < x), ("maximum", lambda x: value > x), ("exclusiveMinimum", lambda x: value <= x), ("exclusiveMaximum", lambda x: value >= x), ("multipleOf", lambda x: value % x != 0)):
            if key in schema and bad(schema[key]):
                return f"{at}: {key}"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            return f"{at}: length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{at}: pattern"
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            return f"{at}: number of items"
        if schema.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in value}) < len(value):
            return f"{at}: repeated items"
        for k, own in enumerate(value):
            if "items" in schema and (found := schema_error(own, schema["items"], f"{at}[{k}]")):
                return found
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for key in schema.get("required", []):
            if key not in value:
                return f"{at}: {key} is missing"
        for key, own in value.items():
            rule = known.get(key, schema.get("additionalProperties", True))
            if found := schema_error(own, rule, f"{at}.{key}"):
                return found
    for rule in schema.get("allOf", []):
        if found := schema_error(value, rule, at):
            return found
    if "anyOf" in schema and all(schema_error(value, r, at) for r in schema["anyOf"]):
        return f"{at}: anyOf"
    if "oneOf" in schema and sum(schema_error(value, r, at) is None for r in schema["oneOf"]) != 1:
        return f"{at}: oneOf"
    return f"{at}: not" if "not" in schema and schema_error(value, schema["not"], at) is None else None


def json_schema_errors(schema_text: str):
    """A column function: NULL where a JSON text fits the schema, else what is wrong; text that isn't JSON is wrong."""
    schema = json.loads(schema_text)

    def check(text: str | None) -> str | None:
        try:
            return schema_error(json.loads(text), schema) if text is not None else "no output"
        except ValueError:
            return "not JSON"

    @F.pandas_udf("string")
    def errors(text: pd.Series) -> pd.Series:
        return pd.Series([check(None if t is None else t) for t in text], dtype="object")

    return errors
