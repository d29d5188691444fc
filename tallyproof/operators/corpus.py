"""Units of a retrieval corpus: facts, field rows and notes of markdown files in one
schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import ledger as L

#: Columns of every unit besides its text; an absent one is an empty string.
ABOUT = ("doc_id", "doc_type", "source_file", "entity_id", "slot", "period_label", "period_start", "period_end", "source_path")
# The lines of a fact's text, in this order, and what stands for an absent list.
FACT_LINES = (
    "source_file", "fact_id", "kind", "type", "entity_id", "slot", "period_label", "period_start", "period_end", "value", "observed_values",
    "calculation", "source_fields", "source_path", "supporting_source_paths", "lineage_path", "confidence", "limitations", "is_active",
)
ABSENT = {"observed_values": "{}", "source_fields": "[]", "supporting_source_paths": "[]", "limitations": "[]"}
#: A field row: a table row whose first cell is a field's name in backticks.
FIELD_ROW = r"^\| `"
FIELD = r"`([^`]+)`"


def _unit(given: dict[str, Column]) -> list[Column]:
    cell = lambda c: F.coalesce(given[c].cast("string"), F.lit("")) if c in given else F.lit("")
    return [cell(c).alias(c) for c in (*ABOUT, "text")]


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def fact_units(facts: DataFrame, source_file: str, label: tuple[str, ...] = ("period_label", "period")) -> DataFrame:
    """A unit for each fact. One without fact_id, or with an empty one, is named by its
    file and its place in it, the column `index`. The label is the first of those columns
    that has text. The unit's text has a line for each of FACT_LINES, empty where the fact
    has no such column or a null in it, then one for each other column of a plain type, by
    name; lists and structures are written as JSON."""
    kinds = {f.name: f.dataType.typeName() for f in facts.schema.fields}
    nested = {c for c, kind in kinds.items() if kind in ("array", "struct", "map")}
    cell = lambda c: F.to_json(c) if c in nested else F.col(c).cast("string")
    filled = lambda c: F.when(cell(c) != "", cell(c))
    own = {c: F.coalesce(cell(c), F.lit(ABSENT.get(c, ""))) for c in kinds}
    labels = [filled(c) for c in label if c in kinds]
    own |= {"source_file": F.lit(source_file), "period_label": F.coalesce(*labels, F.lit(""))}
    file = F.element_at(F.split(F.lit(source_file), "/"), -1)
    names = [*([filled("fact_id")] if "fact_id" in kinds else []), *([F.concat_ws(":", file, cell("index"))] if "index" in kinds else [])]
    more = sorted(c for c in kinds if c not in FACT_LINES and c not in nested and c != "index")
    text = F.concat_ws("\n", *(_line(c, own.get(c, F.lit(ABSENT.get(c, "")))) for c in (*FACT_LINES, *more)))
    return facts.select(*_unit({c: own[c] for c in ABOUT if c in own} | {"doc_id": F.coalesce(*names, F.lit("")), "doc_type": F.lit("generated_memory_fact"), "text": text}))


def field_units(files: DataFrame) -> DataFrame:
    """A unit for each field row of the files (source_file, text), named by its line from
    1 on; its slot is the first name in backticks."""
    lines = files.select("source_file", F.posexplode(F.split("text", r"\r\n|\r|\n", -1)).alias("at", "line"))
    rows = lines.select("source_file", (F.col("at") + 1).alias("line_no"), F.regexp_replace("line", r"^\s+|\s+$", "").alias("content")).where(F.col("content").rlike(FIELD_ROW))
    name, slot = F.col("source_file"), F.regexp_extract("content", FIELD, 1)
    text = F.concat_ws("\n", _line("source_file", name), _line("line", F.col("line_no").cast("string")), _line("slot", slot), _line("content", F.col("content")))
    return rows.select(*_unit({"doc_id": F.concat(name, F.lit(":L"), F.col("line_no")), "doc_type": F.lit("field_contract_row"), "source_file": name, "source_path": name, "slot": slot, "text": text}))


def note_units(files: DataFrame, least: int = 80) -> DataFrame:
    """A unit for each paragraph of at least so many characters, named by its number
    among all paragraphs of its file, from 0 on; white space at its ends is no part of it."""
    parts = files.select("source_file", F.posexplode(F.split("text", r"\n\s*\n", -1)).alias("at", "part"))
    notes = parts.withColumn("part", F.regexp_replace("part", r"^\s+|\s+$", "")).where(F.char_length("part") >= least)
    name, at = F.col("source_file"), F.col("at").cast("string")
    text = F.concat_ws("\n", _line("source_file", name), _line("chunk", at), F.lit("content:"), F.col("part"))
    return notes.select(*_unit({"doc_id": F.concat(name, F.lit(":chunk:"), at), "doc_type": F.lit("field_contract_note"), "source_file": name, "source_path": name, "text": text}))


def units(facts: list[DataFrame], files: DataFrame | None = None, least: int = 80) -> DataFrame:
    """The corpus of fact units and of the units of markdown files."""
    every = [*facts, *([field_units(files), note_units(files, least)] if files is not None else [])]
    return reduce(DataFrame.unionByName, every)


def digests(corpus: DataFrame) -> DataFrame:
    """(source_file, n, digest): a digest of the units of each file, whatever their order,
    so that a changed, lost or repeated unit shows. Lengths stand before the cells, so that
    no two units are written alike."""
    cells = (F.concat(F.char_length(c).cast("string"), F.lit("="), F.col(c)) for c in (*ABOUT, "text"))
    return L.set_digest(corpus.select("source_file", F.sha2(F.concat_ws("|", *cells), 256).alias("h")), "source_file", "h")
