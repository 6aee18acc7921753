"""Text keys, search helpers, languages, topics and secrets."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from furrow.functions import js

ZERO_WIDTH = "[\\x{200B}-\\x{200D}\\x{FEFF}]"
ARABIC = "[\\x{0600}-\\x{06FF}]"

# Topics in the order in which they are looked for, and their keywords.
TOPICS = {
    "tomato": ["tomato", "tomatoes", "lycopersicon"],
    "cucumber": ["cucumber", "cucumbers"],
    "date_palm": ["date", "palm", "phoenix", "dactylifera"],
    "fertilizer": ["fertilizer", "npk", "nutrition", "nutrient"],
    "irrigation": ["irrigation", "water", "watering"],
    "pest": ["pest", "disease", "bug", "worm", "insect"],
}
GREETING = "^(hi|hello|hey|greetings)"
FOLLOW_UP = "^(more|detail|continue|what else|again|info)"
SECRET_KEYS = ("token", "password", "apikey", "api_key", "secret")
MASK = "***"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normal_key(text: Column, compatibility: bool = True) -> Column:
    """Compatibility form (where other than ASCII is there), no zero-width characters, trimmed, lower case."""
    form = F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(text)).otherwise(text) if compatibility else text
    return F.lower(F.trim(F.regexp_replace(form, ZERO_WIDTH, "")))


def token(text: Column) -> Column:
    """Capital letters and digits only."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def file_name(text: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_"), 1, most)


def service_url(url: Column) -> Column:
    """Without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/+$", "")


def cookies(header: Column) -> Column:
    pairs = F.filter(F.transform(F.split(header, ";"), lambda p: F.trim(p)), lambda p: F.contains(p, F.lit("=")))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.trim(F.substr(p, F.instr(p, "=") + 1)))))


def language(text: Column) -> Column:
    return F.when(text.rlike(ARABIC) | F.contains(F.lower(text), F.lit("arabic")), "ar").otherwise("en")


def topic(text: Column) -> Column:
    """The first topic with a keyword anywhere in the text, or null."""
    lower = F.lower(text)
    out = None
    for name, words in TOPICS.items():
        hit = lower.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def intent(text: Column) -> Column:
    """greeting, identity, help, follow_up or question; the first that fits."""
    lower = F.lower(text)
    return (
        F.when(lower.rlike(GREETING), "greeting").when(lower.rlike("who are you|your name"), "identity").when(lower.rlike("help|what can you do"), "help")
        .when(lower.rlike(FOLLOW_UP) | (F.size(F.split(lower, " ")) <= 3), "follow_up").otherwise("question")
    )


def wants_detail(text: Column) -> Column:
    return F.lower(text).rlike("detail|more|full")


# What is added to a message about the weather, or else about pests.
CONTEXTS = {
    "weather|rain|temperature": "[System Injection - Mock Weather Data]\nCurrent Conditions: 36.2°C, 42% Humidity. Risk: High Temp.",
    "pest|bug|worm": "[System Injection - Mock Database]\nFound Organic Remedy: Neem Oil Solution (2%). Application: Evening spray.",
}
CONTEXT_FRAME = "{}\n\nCONTEXT_DATA:\n{}\n\nInstruction: Use the provided context data to answer the user's question."
PLANTS = {"tomato": "Tomato", "cucumber": "Cucumber", "date|palm": "Date Palm"}


def with_context(message: Column) -> Column:
    """The message with the first context that a word of it asks for."""
    before, between, after = CONTEXT_FRAME.split("{}")
    context = F.lit(None).cast("string")
    for words, added in reversed(CONTEXTS.items()):
        context = F.when(F.lower(message).rlike(words), added).otherwise(context)
    return F.coalesce(F.concat(F.lit(before), message, F.lit(between), context, F.lit(after)), message)


def guessed_plant(message: Column) -> Column:
    plant = F.lit("Unidentified")
    for words, name in reversed(PLANTS.items()):
        plant = F.when(F.lower(message).rlike(words), name).otherwise(plant)
    return plant


def filled_time(time: Column, ref_ts: Column) -> Column:
    """A blank time as hours and minutes of ref_ts."""
    return F.coalesce(js.nonblank(time), F.date_format(ref_ts, "HH:mm"))


def without_bold(text: Column) -> Column:
    return F.replace(text, F.lit("**"), F.lit(""))


def display_text(value: Column, kind: str) -> Column:
    """Any value as a popup shows it; nested ones as JSON."""
    return F.coalesce(F.to_json(value) if kind.startswith(("struct", "map", "array")) else value.cast("string"), F.lit(""))


def ymd(epoch_ms: Column) -> Column:
    """The UTC date as year, month and day; years have four digits or as many as they need, and no plus sign. Null beyond the dates that Spark has."""
    days = F.floor(epoch_ms / 86_400_000).try_cast("int")
    return F.regexp_replace(F.date_from_unix_date(days).cast("string"), r"^\+|(?<=^-)0+", "")


def local_minutes(epoch_ms: Column, zone: str) -> Column:
    """A date and time of a zone as an input field takes it, to the minute; empty for anything but a number."""
    shown = F.date_format(F.from_utc_timestamp(F.timestamp_millis(epoch_ms.try_cast("long")), zone), "yyyy-MM-dd'T'HH:mm")
    return F.coalesce(shown, F.lit(""))


def password_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def mask_map(props: Column) -> Column:
    """A map's values masked where the key names a secret."""
    return F.transform_values(props, lambda k, v: F.when(F.lower(k).rlike("|".join(SECRET_KEYS)), F.lit(MASK)).otherwise(v))


def _masked(value: object) -> object:
    if isinstance(value, dict):
        return {k: MASK if any(s in k.lower() for s in SECRET_KEYS) else _masked(v) for k, v in value.items()}
    return [_masked(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def mask_json(text: pd.Series) -> pd.Series:
    """JSON with secrets masked at any depth; what isn't JSON gives null."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(_masked(json.loads(t)), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def signature(secret: str, body: Column) -> Column:
    """sha256= and the HMAC-SHA256 of a body as hexadecimal: two hashes over the key's pads of 64 bytes."""
    key = secret.encode()
    key = (sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(inner, F.encode(F.coalesce(body, F.lit("")), "UTF-8")), 256)
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, F.unhex(first)), 256))


def signature_holds(secret: str) -> Callable[[Column, Column], Column]:
    """A function of (body, signature) columns: whether the signature is that of the body."""
    return lambda body, given: F.coalesce(signature(secret, body) == given, F.lit(False))


