"""How keys compare: one Column function per kind of key. A blank or NULL key comes out as NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = "^[\\s\\u00a0\\u3000]+|[\\s\\u00a0\\u3000]+$"


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def _no_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def plain_key(c: Column | str) -> Column:
    """Case and surrounding blanks do not count."""
    return _no_blank(F.lower(_trimmed(_text(c))))


def func_key(c: Column | str) -> Column:
    """As ``plain_key``; one leading ``0x`` does not count."""
    return _no_blank(F.regexp_replace(F.lower(_trimmed(_text(c))), "^0x", ""))


def task_key(c: Column | str) -> Column:
    """As ``plain_key``; ``_`` is ``-``."""
    return _no_blank(F.translate(F.lower(_trimmed(_text(c))), "_", "-"))


def taint_key(c: Column | str) -> Column:
    """Case counts; blanks, one leading receiver and trailing parentheses do not."""
    bare = F.regexp_replace(_text(c), "[\\s\\u00a0\\u3000]+", "")
    return _no_blank(F.regexp_replace(F.regexp_replace(bare, "^(?:this|self)(?:->|\\.)", ""), "[()]+$", ""))
