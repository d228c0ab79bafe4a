"""Columns of a caller whose names an operator can't have beside its own.

Spark takes no notice of case in names and reads a dot as a field of a struct. So a table
with such a column goes through an operator under plain names and gets its own back
behind it. A column that is named like one that the operator makes, in whatever case, is replaced by it.
Tables without such names go in as they are.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain_names(*made: str, roles: Sequence[str] = ("id_col", "text_col"), columns: Sequence[str] = ()) -> Callable:
    """For an operator whose first argument is a table: ``made`` are the columns that it adds, ``roles`` its parameters that name
    columns, ``columns`` those that are expressions over the table."""
    own = {m.lower() for m in made}

    def wrap(op: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(op)

        @functools.wraps(op)
        def run(docs: DataFrame, *args, **more) -> DataFrame:
            given = signature.bind(docs, *args, **more)
            given.apply_defaults()
            named = {given.arguments[p]: p for p in roles if p in given.arguments}
            clash = any(c.lower() in own and c not in made and c not in named for c in docs.columns)
            if not clash and not any("." in c or "`" in c for c in docs.columns):
                return op(docs, *args, **more)
            first = next(iter(signature.parameters))
            table = docs.withColumns({f"__plain_{p}": given.arguments[p] for p in columns}) if columns else docs
            plain = [f"__plain_{named[c]}" if c in named else c if c.startswith("__plain_") else f"__plain{i}" for i, c in enumerate(table.columns)]
            kept = [new for c, new in zip(table.columns, plain, strict=True) if c in named or c.lower() not in own]
            given.arguments |= {first: table.toDF(*plain).select(*kept)} | {p: f"__plain_{p}" for p in named.values()} | {p: F.col(f"__plain_{p}") for p in columns}
            out = op(*given.args, **given.kwargs)
            back = dict(zip(plain, table.columns, strict=True))
            return out.select(*(F.col(c).alias(back.get(c, c)) for c in out.columns if c not in [f"__plain_{p}" for p in columns]))

        return run

    return wrap
