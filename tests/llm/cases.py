"""Odd inputs that every operator must take, and plain versions to compare with."""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = "Kata demi kata. " * 12_000
ROWS = [
    (1, "Satu dua tiga empat lima enam.\nSama di mana-mana\n", "a"),
    (2, None, None),
    (3, "", "a"),
    (4, " \t\n\n ", "b"),
    (5, LONG, "a"),
    (6, "x" * 60_000, "b"),
    (7, "éÉ ñ 日本語 🙂 <|endoftext|> ｆｕｌｌ", "b"),
    (8, "sama persis dengan yang lain ya", "a"),
    (8, "sama persis dengan yang lain ya", "a"),
    (9, "sama persis dengan yang lain ya", "a"),
    (None, "tanpa nomor tetapi ada isinya juga", "a"),
    (10, "a b", None),
    (11, "\r\n\x0b\x0c baris\r\n", "a"),
]
#: Names that clash with what operators call their own columns.
CLASHES = "id row key h g n sha length piece start ids sequence_id offset n_words kept shard depth n_bytes refs label component bytes text_ score rest n_lines n_dropped".split()


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for i, c in enumerate(CLASHES):
        df = df.selectExpr("*", f"'{c}-{i}' AS `{c}`")
    return df


def empty(spark):
    return docs(spark, [])


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)
