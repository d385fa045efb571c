"""Contracts: clauses, their document form, and the SQL tests that they amount to."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

DATE_TIME_START = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T"
UUID_TEST = r"^[0-9a-fA-F-]{36}$"


@dataclass(frozen=True)
class Clause:
    """What a contract says of one column."""

    name: str
    type: str | None = None
    required: bool = False
    format: str | None = None
    pattern: str | None = None
    enum: tuple[str, ...] = ()
    minimum: float | None = None
    maximum: float | None = None
    description: str = ""
    profile: dict[str, Any] = field(default_factory=dict, compare=False)

    @classmethod
    def of(cls, name: str, clause: dict[str, Any]) -> Clause:
        known = {k: clause[k] for k in ("type", "format", "pattern", "minimum", "maximum", "description") if clause.get(k) is not None}
        return cls(name, required=clause.get("required") is True, enum=tuple(str(v) for v in clause.get("enum") or ()), profile=dict(clause.get("profile") or {}), **known)

    def document(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": self.type, "description": self.description}
        if self.required:
            out["required"] = True
        out |= {k: v for k in ("format", "pattern") if (v := getattr(self, k))}
        if self.enum:
            out["enum"] = list(self.enum)
        out |= {k: v for k in ("minimum", "maximum") if (v := getattr(self, k)) is not None}
        return out | ({"profile": self.profile} if self.profile else {})


@dataclass(frozen=True)
class Contract:
    id: str
    clauses: tuple[Clause, ...]
    profiled_rows: int = 0

    @classmethod
    def of(cls, document: dict[str, Any]) -> Contract:
        schema = document.get("schema")
        clauses = tuple(Clause.of(k, v) for k, v in (schema if isinstance(schema, dict) else {}).items())
        return cls(str(document.get("id", "")), clauses, int((document.get("observations") or {}).get("profiled_row_count", 0)))

    def document(self, **more: Any) -> dict[str, Any]:
        head = {"kind": "DataContract", "apiVersion": "v3.0.0", "id": self.id, "observations": {"profiled_row_count": self.profiled_rows}}
        return head | more | {"schema": {c.name: c.document() for c in self.clauses}}


def sql_tests(clause: Clause, profiled_rows: int = 0) -> list[tuple[str, dict[str, Any]]]:
    """(test, arguments) of a clause: not_null, unique, accepted_values, between, matches."""
    out: list[tuple[str, dict[str, Any]]] = []
    if clause.required:
        out.append(("not_null", {}))
    distinct = clause.profile.get("cardinality_estimate")
    if clause.name.endswith("_id") and distinct and distinct == profiled_rows and clause.profile.get("null_fraction") == 0.0:
        out.append(("unique", {}))
    if clause.enum:
        out.append(("accepted_values", {"values": list(clause.enum)}))
    if clause.minimum is not None or clause.maximum is not None:
        out.append(("between", {k: v for k, v in (("min_value", clause.minimum), ("max_value", clause.maximum)) if v is not None}))
    if clause.pattern:
        out.append(("matches", {"regex": clause.pattern}))
    if clause.format == "uuid":
        out.append(("matches", {"regex": UUID_TEST}))
    if clause.format == "date-time":
        out.append(("matches", {"regex": DATE_TIME_START}))
    return out


def model_document(contract: Contract, model: str) -> dict[str, Any]:
    """The tests as a model description for a SQL test runner."""
    names = {"between": "expect_column_values_to_be_between", "matches": "expect_column_values_to_match_regex"}
    columns = []
    for c in contract.clauses:
        tests: list[Any] = [names.get(t, t) if not a else {names.get(t, t): {"arguments": a}} for t, a in sql_tests(c, contract.profiled_rows)]
        columns.append({"name": c.name, "description": c.description} | ({"data_tests": tests} if tests else {}))
    return {"version": 2, "models": [{"name": model, "columns": columns}]}


def normalize_tests(value: Any) -> Any:
    """A tree of tests without package prefixes, arguments under ``arguments``."""
    if isinstance(value, list):
        return [normalize_tests(v) for v in value]
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            name = k.rpartition(".")[2] if "." in k else k
            wrap = (name.startswith("expect_") or name == "accepted_values") and isinstance(v, dict) and "arguments" not in v
            out[name] = {"arguments": normalize_tests(v)} if wrap else normalize_tests(v)
        return out
    return value


def check_document(document: dict[str, Any], needs_confidence: bool = True) -> None:
    """Raises ValueError if a contract document isn't fit for use."""
    schema = document.get("schema") or {}
    if not schema:
        raise ValueError("a contract has to have a schema")
    if any(not c.get("description") for c in schema.values()):
        raise ValueError("each clause has to have a description")
    confidence = {k: c for k, c in schema.items() if "confidence" in k}
    if needs_confidence and not confidence:
        raise ValueError("no clause is about a confidence")
    if any(c.get("minimum") != 0.0 or c.get("maximum") != 1.0 for c in confidence.values()):
        raise ValueError("confidences have to lie between 0 and 1")
    if (document.get("registry") or {}).get("role", "primary_blast_radius_source") != "primary_blast_radius_source":
        raise ValueError("the registry has to be the primary source of the blast radius")
    if (document.get("lineage") or {}).get("role", "enrichment_only") != "enrichment_only":
        raise ValueError("lineage may only enrich")


def check_model(document: dict[str, Any]) -> None:
    """Raises ValueError if a model description isn't fit for use."""
    models = document.get("models") or []
    if document.get("version") != 2 or not models or not models[0].get("columns"):
        raise ValueError("a model description has version 2 and a model with columns")
    columns = models[0]["columns"]
    if not any(c.get("data_tests") for c in columns):
        raise ValueError("no column is tested")
    for c in columns:
        if "confidence" in c["name"] and not any("between" in str(t) for t in c.get("data_tests") or []):
            raise ValueError(f"{c['name']} has no range test")
