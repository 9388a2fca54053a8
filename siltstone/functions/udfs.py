"""Arrow-batched wrappers of the syntax functions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType

from siltstone.functions import syntax

#: Rows whose values are Python objects at a time.
ROWS = 256


def by_rows(function: Callable, returns: DataType, *columns: pa.Array) -> pa.Array:
    """A function of each row's values. Only a few rows at a time are Python objects: a batch of whole texts is large enough."""
    kind = to_arrow_type(returns)
    parts = [zip(*(c.slice(a, ROWS) for c in columns), strict=True) for a in range(0, len(columns[0]), ROWS)]
    return pa.concat_arrays([pa.array([], kind), *(pa.array([function(*(v.as_py() for v in row)) for row in part], kind) for part in parts)])


def over(function, returns: DataType):
    @F.arrow_udf(returns)
    def run(s: pa.Array) -> pa.Array:
        return by_rows(function, returns, s)

    return run


def black_text(source: str | None) -> str | None:
    """Formatted by black where it is installed; the text as it is if not, or if that fails."""
    try:
        import black

        return black.format_str(source, mode=black.Mode())
    except Exception:  # black's own errors are many; the original is always good enough
        return source


functions = over(syntax.functions, ArrayType(StringType()))
main_name = over(syntax.main_name, StringType())
complexity = over(syntax.complexity, IntegerType())
annotated = over(syntax.annotated, BooleanType())
docstring = over(syntax.docstring, StringType())
return_type = over(syntax.return_type, StringType())
parameters = over(syntax.parameters, ArrayType(StringType()))
returns = over(syntax.returns, BooleanType())
formatted = over(black_text, StringType())
annotation_marks = over(syntax.annotation_marks, BooleanType())
