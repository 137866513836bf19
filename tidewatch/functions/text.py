"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: address literals inside free text and the characters kept in safe text
IPV4_LITERAL = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])"
IPV6_LITERAL = (
    r"(?<![\w:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,6}:(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?"
    r"|::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6}))(?![\w:])"
)
UNSAFE = r"(?U)[^\w\s.,:;/\-@()%+=#]"
IP_PLACEHOLDER = "(source ip)"
CONTROL = r"[\x00-\x1f\x7f]"


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def safe_text(c: Column, n: int = 80) -> Column:
    """Control characters, unsafe characters and address literals removed, cut to ``n``."""
    s = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), CONTROL, " ")
    s = F.regexp_replace(s, UNSAFE, "")
    s = F.regexp_replace(F.regexp_replace(s, IPV4_LITERAL, IP_PLACEHOLDER), IPV6_LITERAL, IP_PLACEHOLDER)
    return F.left(collapse_space(s), F.lit(n))


def clean_text(c: Column, n: int = 300) -> Column:
    """Third-party text: control characters out, spaces collapsed, cut to ``n`` with an ellipsis."""
    s = collapse_space(F.regexp_replace(c.cast("string"), CONTROL, " "))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.left(s, F.lit(n - 1)), F.lit("\u2026")))


def model_text(c: Column, n: int) -> Column:
    """Model-authored text: control characters and angle brackets removed, cut to ``n``."""
    s = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), CONTROL, " "), "<>", "")
    return F.left(collapse_space(s), F.lit(n))


def clean_comment(c: Column, n: int = 2000) -> tuple[Column, Column]:
    """(cleaned comment or NULL, rejected flag). Tabs and newlines are kept."""
    s = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"(?U)^\s+|\s+$", "")
    too_long = F.coalesce(F.length(s) > n, F.lit(False))
    return F.when(~too_long & (s != ""), s), too_long


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))
