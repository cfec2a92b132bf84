"""Work over arrays in linear time, and Unicode forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sums that are appended to one array: appending copies it, so long arrays are summed in runs.
RUN = 128


def let(value: Column, made) -> Column:
    """made(value), where value is worked out once."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """For each number the sum of those before it."""
    zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    scan = lambda values, at: F.aggregate(values, zero(at), step, lambda acc: acc["out"])
    total = lambda run: F.aggregate(run, F.lit(0), lambda a, n: a + n)

    def summed(values: Column) -> Column:
        starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        runs = F.transform(starts, lambda i: F.slice(values, i, F.lit(RUN)))
        return let(runs, lambda r: F.flatten(F.zip_with(r, scan(F.transform(r, total), F.lit(0)), lambda run, at: scan(run, at))))

    return let(numbers, summed)  # else they would be worked out again for each run


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, value>>: all matches with their places, from the gaps between them."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.zip_with(gaps, hits, lambda g, h: F.struct(F.char_length(g).alias("gap"), h.alias("hit")))

    def placed(p: Column) -> Column:
        lengths = F.transform(p, lambda x: (x["gap"] + F.coalesce(F.char_length(x["hit"]), F.lit(0))).cast("int"))

        def span(x: Column, at: Column) -> Column:
            start = (at + x["gap"]).cast("int")
            return F.when(x["hit"].isNotNull(), F.struct(start.alias("start"), (start + F.char_length(x["hit"])).cast("int").alias("end"), x["hit"].alias("value")))

        return F.array_compact(F.zip_with(p, running_sums(lengths), span))

    return let(pieces, placed)


@F.pandas_udf(T.StringType())
def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def composed(text: Column) -> Column:
    """The compatibility form NFKC, which Spark has no function for; pure ASCII text is not looked at."""
    return F.coalesce(_composed(F.when(F.octet_length(text) != F.char_length(text), text)), text)
