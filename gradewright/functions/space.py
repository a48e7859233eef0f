"""White space: one rule for every text that is stripped or asked whether it is blank.

The set is Unicode white space with the four ASCII separators, so line ends, form feeds and no-break spaces of
reader output count as blank. Spark's own ``trim`` removes the plain space only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACES = f"[{WHITE_SPACE}]+"  # as a regular expression, in the engine and in SQL


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def strip(text) -> Column:
    return F.trim(_col(text), F.lit(WHITE_SPACE))


def is_blank_text(text) -> Column:
    """Whether a text is null, empty or white space only."""
    return F.coalesce(strip(text), F.lit("")) == ""
