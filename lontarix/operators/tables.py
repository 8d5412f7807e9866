"""Table functions for SQL: a text's chunks and windows by ``LATERAL``, with splitters that a caller may bring."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .structure import split_chunks, split_windows

#: Names and columns of the functions that are there from the start.
SPLITTERS: dict[str, tuple[Callable[[str], Iterable[tuple]], str]] = {
    "text_chunks": (split_chunks, "start: bigint, stop: bigint, tokens: bigint"),
    "text_windows": (split_windows, "start: bigint, stop: bigint"),
}


def register(spark: SparkSession, splitters: dict[str, tuple[Callable[[str], Iterable[tuple]], str]] | None = None) -> None:
    """Make ``name(text)`` a table function of the session for each (function of a text, columns); a null text has no rows.

    ``SELECT d.id, c.* FROM d, LATERAL text_chunks(d.text) c`` splits within tasks, in Arrow batches, without a shuffle.
    """
    for name, (split, columns) in (SPLITTERS if splitters is None else splitters).items():

        class Splitter:
            _split = staticmethod(split)

            def eval(self, text: str):
                if text is not None:
                    yield from self._split(text)

        spark.udtf.register(name, udtf(Splitter, returnType=columns, useArrow=True))
