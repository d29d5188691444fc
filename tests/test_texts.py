"""Literals' places, and rows of tables with what they stand under."""

import re

from tallyproof.functions import text as T

TEXT = """# Fields

Some prose | with a bar.

| `name` | unit |
| :--- | ---: |
| `orders` | count |
|`amount`|yuan|

## Ranks
| a | b |
| 1 | 2 |
### not a table
| alone |"""


def test_table_rows_carry_heading_and_header(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "no table"), (3, None), (4, "| h |\n| r |\n\n| r |")], "id int, body string")
    got = sorted((r.id, r.line_no, r.heading, r.header, r.chunk) for r in T.table_rows(df, "id", "body").collect())
    head = "| `name` | unit |"
    assert got[:2] == [(1, 7, "Fields", head, "| `orders` | count |"), (1, 8, "Fields", head, "|`amount`|yuan|")]
    assert got[2:] == [(1, 12, "Ranks", "| a | b |", "| 1 | 2 |"), (4, 2, None, "| h |", "| r |")]


CASES = [(1, "aa b aa\nxaaaa\n", "aa"), (2, "1.5 1x5 1.5", "1.5"), (3, "a\\Eb \\E", "\\E"), (4, "日本 日本", "本"), (5, None, "a"), (6, "abc", ""), (7, "none", "zz"), (8, "a.b\n" * 3, ".")]


def test_every_occurrence_has_its_place(spark):
    df = spark.createDataFrame(CASES, "id int, body string, literal string")
    got = sorted((r.id, r.line_no, r.ordinal, r.column_start, r.column_end) for r in T.occurrences(df, "id", "body", "literal").collect())
    want = [(i, n, k, m.start() + 1, m.end()) for i, body, lit in CASES if body and lit for n, line in enumerate(body.split("\n"), 1) for k, m in enumerate(re.finditer(re.escape(lit), line), 1)]
    assert got == sorted(want) and len(want) > 10


def test_the_nth_use_is_the_nth_occurrence(spark):
    df = spark.createDataFrame([(1, "5 of 5\n5 and 5 and 5", "5")], "id int, body string, literal string")
    uses = spark.createDataFrame([(1, 2, "5", "b"), (1, 2, "5", "a"), (1, 1, "5", "x"), (1, 1, "5", "y"), (1, 1, "5", "z")], "id int, line_no int, literal string, field string")
    got = {r.field: (r.column_start, r.column_end) for r in T.located(uses, T.occurrences(df, "id", "body", "literal"), "id", "literal", "field").collect()}
    assert got == {"a": (1, 1), "b": (7, 7), "x": (1, 1), "y": (6, 6), "z": (None, None)}
