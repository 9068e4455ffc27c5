"""White space the way Python's str.strip() sees it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of a Java or RE2 character class; wider than \s, as it has no-break spaces.
SPACE_CLASS = r"\s\x0B\x1c-\x1f\x85\p{Z}"
SPACE = f"[{SPACE_CLASS}]"


def strip(text: str | Column) -> Column:
    """Without white space at both ends. A run of spaces inside is tried once only."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, rf"\A{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")
