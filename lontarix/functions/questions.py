"""Question normalization with a trace: NFC and white space outside quotations; quoted text keeps its bytes."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 64 << 10
_W = r"[^\W_]"
#: A quotation (to its end, or to the end of the text if it isn't closed), a run of white space, or anything up to either.
_PART = re.compile(
    rf"""(?P<quote>"(?:\\.|[^"\\])*"?|“(?:\\.|[^”\\])*”?|‘(?:\\.|[^’\\]|(?<={_W})’(?={_W}))*’?|(?<!{_W})'(?:\\.|[^'\\]|(?<={_W})'(?={_W}))*'?)|(?P<space>\s+)|(?P<text>(?:(?!["“‘]|(?<!{_W})')\S)+)""",
    re.DOTALL,
)


def mechanical(question: str) -> tuple[str, list[tuple[int, int, int, int, str]]]:
    """(search text, edits): an edit is (start, stop) in the question, (start, stop) in the result, in bytes, and its kind."""
    if not question.strip() or len(question.encode()) > MAX_BYTES or "\0" in question:
        raise ValueError("a nonblank question within 64 KiB is needed")
    out, edits, at, made = [], [], 0, 0
    for m in _PART.finditer(question):
        raw = m.group()
        if m.lastgroup == "space":
            new = "" if not made or m.end() == len(question) else " "
        else:
            new = raw if m.lastgroup == "quote" else unicodedata.normalize("NFC", raw)
        a, b = len(raw.encode()), len(new.encode())
        if new != raw:
            edits.append((at, at + a, made, made + b, "whitespace" if m.lastgroup == "space" else "nfc"))
        out.append(new)
        at, made = at + a, made + b
    return "".join(out), edits


_EDIT = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "stop", "search_start", "search_stop")] + [T.StructField("kind", T.StringType())])
_TRACE = T.StructType([T.StructField("search", T.StringType()), T.StructField("edits", T.ArrayType(_EDIT))])


@F.pandas_udf(_TRACE)
def trace(question: pd.Series) -> pd.DataFrame:
    """Struct (search, edits) of a question; null for null, an error for what isn't a question."""
    rows = [(None, None) if q is None else mechanical(q) for q in question]
    names = [f.name for f in _EDIT.fields]
    return pd.DataFrame({"search": [r[0] for r in rows], "edits": [None if r[1] is None else [dict(zip(names, e, strict=True)) for e in r[1]] for r in rows]})
