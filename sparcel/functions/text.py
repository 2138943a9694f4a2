"""White space, trimming and word boundaries that do not depend on the JVM's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space (a superset of the JVM's ``\s``).
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = f"[{SPACES}]"
NON_WS = f"[^{SPACES}]"

# ASCII word boundaries: the JVM's ``\b`` treats accented letters as word characters.
WORD_START = r"(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])"
WORD_END = r"(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])"
WORD_EDGE = f"(?:{WORD_START}|{WORD_END})"


def trimmed(text: Column) -> Column:
    """Strip every kind of white space from both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def whole(pattern: str) -> str:
    """Pattern that must cover the trimmed text, without building the trimmed text."""
    return f"^{WS}*(?:{pattern}){WS}*$"
