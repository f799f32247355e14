"""JSON text from outside: accepted only when it is one whole value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_whole(text: Column, schema: T.DataType) -> Column:
    """``from_json`` that is null for malformed or cut-off text.

    ``from_json`` alone yields a struct of nulls for some malformed input. The
    outer brackets catch text after the value, which the parser does not look at.
    """
    opening, closing = ("[", "]") if isinstance(schema, T.ArrayType) else ("{", "}")
    whole = (
        F.startswith(text, F.lit(opening))
        & F.endswith(text, F.lit(closing))
        & F.try_parse_json(text).isNotNull()
    )
    return F.when(whole, F.from_json(text, schema))
