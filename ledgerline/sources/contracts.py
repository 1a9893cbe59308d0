"""Contracts as data: YAML documents, checked strictly, as small tables."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Semantic types of fields.
TYPES = frozenset("text code country date quantity money container_number hs_code party".split())
FIELD_KEYS = frozenset("name type required budget unit rules anchors".split())
CONTRACT_KEYS = frozenset("document_type version fields".split())


class ContractError(ValueError):
    """A contract that does not say what it must, or says what nothing knows."""


def _strict(row: dict[str, Any], known: frozenset[str], needed: tuple[str, ...], where: str) -> None:
    if extra := set(row) - known:
        raise ContractError(f"{where}: unknown {sorted(extra)}")
    if lacking := [k for k in needed if row.get(k) is None]:
        raise ContractError(f"{where}: missing {lacking}")


def check(contract: dict[str, Any]) -> dict[str, Any]:
    """The contract, if it is whole: known keys only, known types, budgets within 0 and 1, names once."""
    _strict(contract, CONTRACT_KEYS, ("document_type", "fields"), "contract")
    seen: set[str] = set()
    for field in contract["fields"]:
        where = f"{contract['document_type']}.{field.get('name')}"
        _strict(field, FIELD_KEYS, ("name", "type", "budget"), where)
        if field["type"] not in TYPES:
            raise ContractError(f"{where}: unknown type {field['type']}")
        if not 0 < float(field["budget"]) < 1:
            raise ContractError(f"{where}: budget {field['budget']}")
        if field["name"] in seen:
            raise ContractError(f"{where}: twice")
        seen.add(field["name"])
    return contract


def load(paths: list[str]) -> list[dict[str, Any]]:
    """Contracts of YAML files, checked one by one and together: no document type twice, one type for each field name."""
    import yaml

    contracts = [check(yaml.safe_load(Path(p).read_text())) for p in paths]
    types: dict[str, str] = {}
    names: set[str] = set()
    for c in contracts:
        if c["document_type"] in names:
            raise ContractError(f"{c['document_type']}: twice")
        names.add(c["document_type"])
        for f in c["fields"]:
            if types.setdefault(f["name"], f["type"]) != f["type"]:
                raise ContractError(f"{f['name']}: {f['type']} and {types[f['name']]}")
    return contracts


def fields(spark: SparkSession, contracts: list[dict[str, Any]]) -> DataFrame:
    """document_type, field, type, budget, unit, required; a table of a few rows for joins."""
    rows = [(c["document_type"], f["name"], f["type"], float(f["budget"]), f.get("unit"), bool(f.get("required", False))) for c in contracts for f in c["fields"]]
    return spark.createDataFrame(rows, "document_type string, field string, type string, budget double, unit string, required boolean")


def anchors(spark: SparkSession, contracts: list[dict[str, Any]]) -> DataFrame:
    """document_type, field, language, caption."""
    rows = [(c["document_type"], f["name"], lang, caption) for c in contracts for f in c["fields"] for lang, captions in (f.get("anchors") or {}).items() for caption in captions]
    return spark.createDataFrame(rows, "document_type string, field string, language string, caption string")
