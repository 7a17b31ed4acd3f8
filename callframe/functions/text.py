"""Text primitives shared by the operators.

Column functions stay in the JVM; the plain Python functions are for use inside
Arrow-batched operators.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Han character is a word by itself; otherwise a longest run of letters and digits.
WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")

#: Unicode white space as Python's str.split sees it (no-break and ideographic space too).
SPACES = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def words(text: str | None) -> list[str]:
    """Words of a text in order; NULL and empty texts have none."""
    return WORD.findall(text.lower()) if text else []


def user_text(messages: Column | str) -> Column:
    """Contents of the user messages in order, joined by a newline.

    NULL contents are skipped; a NULL or empty message list gives the empty text.
    """
    m = F.col(messages) if isinstance(messages, str) else messages
    users = F.transform(F.filter(m, lambda x: x["role"] == "user"), lambda x: x["content"])
    return F.coalesce(F.array_join(users, "\n"), F.lit(""))


def collapse_space(text: Column) -> Column:
    """Lower-case, every run of Unicode white space one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


def group_key(text: Column) -> Column:
    """SHA-256 of the collapsed text: equal keys are equal requests."""
    return F.sha2(collapse_space(text), 256)
