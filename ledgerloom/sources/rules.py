"""Supplier rules: a YAML file with the standard columns and, by supplier, identifiers, column mapping and note columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.constants import STANDARD_COLUMNS


@dataclass
class Profile:
    identifiers: list[str] = field(default_factory=list)
    columns: dict[str, str] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)

    @property
    def header_names(self) -> list[str]:
        return [*self.columns, *self.notes]


@dataclass
class Rules:
    standard_columns: list[str] = field(default_factory=lambda: list(STANDARD_COLUMNS))
    suppliers: dict[str, Profile] = field(default_factory=dict)

    @property
    def identifiers(self) -> dict[str, list[str]]:
        return {k: p.identifiers for k, p in self.suppliers.items()}

    @staticmethod
    def of(data: dict) -> Rules:
        suppliers = {k: Profile(list(p.get("identifiers") or []), dict(p.get("columns_mapping") or {}), dict(p.get("notes_columns") or {})) for k, p in (data.get("suppliers") or {}).items()}
        return Rules(list(data.get("standard_columns") or STANDARD_COLUMNS), suppliers)


def load_rules(path: str | Path) -> Rules:
    import yaml

    return Rules.of(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def rule_tables(spark: SparkSession, rules: Rules) -> dict[str, DataFrame]:
    """identifiers, columns, notes and header labels as small tables that keep the file's order."""
    ident = [(k, i, m) for i, (k, p) in enumerate(rules.suppliers.items()) for m in p.identifiers]
    columns = [(k, i, h, c) for k, p in rules.suppliers.items() for i, (h, c) in enumerate(p.columns.items())]
    notes = [(k, i, h, n) for k, p in rules.suppliers.items() for i, (h, n) in enumerate(p.notes.items())]
    return {
        "supplier_identifiers": spark.createDataFrame(ident, "supplier string, decl_order int, identifier string"),
        "supplier_columns": spark.createDataFrame(columns, "supplier string, key_order int, source_header string, standard_column string"),
        "supplier_labels": spark.createDataFrame([(k, n) for k, p in rules.suppliers.items() for n in p.header_names], "supplier string, label string"),
        "supplier_notes": spark.createDataFrame(notes, "supplier string, key_order int, source_header string, label string"),
    }
