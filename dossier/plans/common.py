"""How queries and their SQL are registered."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


def register(queries: dict, oracle: dict, sql: str | None, dates: tuple[str, ...] = ()):
    """Keep a query (and its SQL) under its name; date columns become text, which compares alike in both engines."""

    def keep(f):
        @wraps(f)
        def run(spark, sf_dir):
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else out

        queries[f.__name__] = run
        if sql is not None:
            oracle[f.__name__] = "select * replace (" + ", ".join(f'"{c}"::varchar as "{c}"' for c in dates) + f") from ({sql}) x" if dates else sql
        return f

    return keep
