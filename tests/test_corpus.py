"""Units of a corpus: literal files, facts of every shape, digests."""

import re

from pyspark.sql import functions as F

from tallyproof.operators import corpus as C
from tallyproof.sources import files as S

NOTE = "A note that is long enough to be kept, as it has more than eighty characters in all, this one."
TEXT = f"# Fields\n\n{NOTE}\n \t\nshort\n\n| name | unit |\n|---|---|\n  | `orders` | `count` |  \n|`amount`| yuan |\n| ` | none |\n\n\n\n  {NOTE}\n"


def plain(name, text):
    """What a reader of one file makes of it."""
    out = set()
    for n, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if line.startswith("| `"):
            found = re.search(r"`([^`]+)`", line)
            slot = found.group(1) if found else ""
            out.add((f"{name}:L{n}", slot, f"source_file: {name}\nline: {n}\nslot: {slot}\ncontent: {line}"))
    for n, part in enumerate(re.split(r"\n\s*\n", text)):
        if len(part.strip()) >= 80:
            out.add((f"{name}:chunk:{n}", "", f"source_file: {name}\nchunk: {n}\ncontent:\n{part.strip()}"))
    return out


def test_markdown_files_are_scanned_whole(spark, tmp_path):
    for name, text in (("a.md", TEXT), ("empty.md", ""), ("b.md", "| `x` |" * 30), ("skipped.csv", TEXT)):
        (tmp_path / name).write_text(text, encoding="utf-8")
    files = S.read_markdown(spark, f"file://{tmp_path}")
    got = C.units([], files).collect()
    assert {(r.doc_id, r.slot, r.text) for r in got} == plain("a.md", TEXT) | plain("b.md", "| `x` |" * 30)
    assert len(got) == 2 + 3 + 2 and all(r.source_path == r.source_file and r.entity_id == "" for r in got)


def test_facts_without_a_name_go_by_their_place(spark):
    rows = [("f1", "s", "2024-01", None, 2, 0, [1, 2]), (None, "s", "", "march", None, 1, []), ("", None, None, None, None, 2, None)]
    facts = spark.createDataFrame(rows, "fact_id string, entity_id string, period_label string, period string, amount int, index int, limitations array<int>")
    got = {r.doc_id: r for r in C.fact_units(facts, "out/facts.json").collect()}
    assert set(got) == {"f1", "facts.json:1", "facts.json:2"}
    assert (got["f1"].period_label, got["facts.json:1"].period_label, got["facts.json:2"].period_label) == ("2024-01", "march", "")
    for i, (name, store, first, second, amount, _, lists) in enumerate(rows):
        known = {"source_file": "out/facts.json", "fact_id": name or "", "entity_id": store or "", "period_label": first or second or "", "observed_values": "{}", "source_fields": "[]", "supporting_source_paths": "[]", "limitations": str(lists or []).replace(" ", "")}
        lines = [f"{c}: {known.get(c, '')}" for c in C.FACT_LINES] + [f"amount: {'' if amount is None else amount}", f"period: {second or ''}"]
        assert got[name or f"facts.json:{i}"].text == "\n".join(lines)
    assert got["facts.json:2"].entity_id == "" and got["f1"].source_file == "out/facts.json"


def test_digests_tell_changed_lost_and_repeated_units(spark):
    files = spark.createDataFrame([("a", TEXT), ("b", f"{NOTE}\n\n{NOTE}")], "source_file string, text string")
    units = C.units([], files)
    of = lambda df: {r.source_file: (r.n, r.digest) for r in C.digests(df).collect()}
    was = of(units)
    assert was["a"][0] == 5 and was["b"][0] == 2 and was == of(units.orderBy(F.desc("text")))
    one = units.where("doc_id = 'b:chunk:1'")
    for other in (units.where("doc_id <> 'b:chunk:1'"), units.unionByName(one), units.withColumn("slot", F.when(F.col("doc_id") == "b:chunk:1", "s").otherwise(F.col("slot")))):
        now = of(other)
        assert now["a"] == was["a"] and now["b"] != was["b"]
