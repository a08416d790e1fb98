"""Tokens shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The public WordPunct tokenizer.
TOKEN = re.compile(r"\w+|[^\w\s]+")
# Python's \w and \s spelled out for Java and RE2: letters, numbers and _; white space as str.isspace() has it.
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN_PATTERN = rf"[{_WORD}]+|[^{_WORD}{_SPACE}]+"


def token_count(text: Column) -> Column:
    """Number of WordPunct tokens, counted in the JVM; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0)).cast("long")
