"""Ways to hide secrets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "***"
DEFAULT_REPLACEMENT = "***REMOVED***"


def mask_first4(secret: Column) -> Column:
    """The first four characters, and a star for each other."""
    return F.concat(F.substring(secret, 1, 4), F.repeat(F.lit("*"), F.greatest(F.length(secret) - 4, F.lit(0))))


def mask_percent(secret: Column, percent: int) -> Column:
    """Hides ``percent`` of the characters behind dots; what is kept is rounded half to even. Empty stays empty."""
    share = 100 - min(percent, 100)
    keep = F.bround(F.length(secret) * F.lit(float(share)) / 100.0).cast("int")
    return F.when(F.length(secret) == 0, secret).otherwise(F.concat(F.left(secret, keep), F.lit("...")))


def mask_gate(secret: Column) -> Column:
    """Up to four characters become stars; of longer ones four are kept before six stars."""
    n = F.length(secret)
    return F.when(n == 0, F.lit("<redacted>")).when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(secret, 1, 4), F.lit("******")))


def mask_counted(secret: Column) -> Column:
    """Four characters and the number of all."""
    return F.concat(F.substring(secret, 1, 4), F.lit("… ("), F.length(secret).cast("string"), F.lit(" chars)"))


def redact_credentials(text: Column) -> Column:
    """Hides passwords, or lone user names, in URLs, and values of Authorization headers."""
    named = F.regexp_replace(text, r"([a-zA-Z][a-zA-Z0-9+.\-]*://[^/@\s:]*):[^/@\s]*@", "$1:" + MASK + "@")
    lone = F.regexp_replace(named, r"([a-zA-Z][a-zA-Z0-9+.\-]*://)[^/@\s:]+@", "$1" + MASK + "@")
    return F.regexp_replace(lone, r"(?i)(authorization:\s*[a-z]+\s+)\S+", "$1" + MASK)


def redact_finding(field: Column, secret: Column, percent: int) -> Column:
    """``field`` with the secret in it hidden; all of it at 100 percent."""
    shown = F.lit("REDACTED") if percent >= 100 else mask_percent(secret, percent)
    return F.when(F.length(secret) > 0, F.replace(field, secret, shown)).otherwise(field)


def replace_text(text: Column, literals: list[tuple[str, str]], patterns: list[tuple[str, str]] = ()) -> Column:
    """Literal replacements in order, then patterns whose replacements are literal too."""
    for old, new in literals:
        text = F.replace(text, F.lit(old), F.lit(new))
    for pattern, new in patterns:
        text = F.regexp_replace(text, pattern, new.replace("\\", "\\\\").replace("$", "\\$"))
    return text
