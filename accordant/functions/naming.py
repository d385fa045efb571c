"""Names that follow from where a data set lies: its folder and its file."""

from __future__ import annotations

from pathlib import PurePosixPath


def _place(source: str) -> tuple[str, str]:
    path = PurePosixPath(source.replace("\\", "/"))
    return path.parent.name, path.stem


def contract_slug(source: str, given: str | None = None) -> str:
    return given.strip() if given else "-".join(_place(source))


def file_name(source: str, suffix: str = ".yaml") -> str:
    """Name of the contract's file; with ``_dbt.yml`` that of its SQL tests."""
    return "_".join(_place(source)) + suffix


def model_name(source: str) -> str:
    return "_".join(_place(source)).replace("-", "_")


def contract_title(source: str) -> str:
    return " ".join([*(x.replace("_", " ").title() for x in _place(source)), "Contract"])


def contract_info(source: str) -> dict[str, str]:
    """Title, description and usage of a contract document."""
    folder, stem = _place(source)
    return {
        "title": contract_title(source),
        "description": f"Inferred from the records of {folder}/{stem} as they are now.",
        "usage": f"Between the systems that write and read {source.replace(chr(92), '/')}.",
    }


def source_terms(source: str, more: dict[str, list[str]] | None = None) -> list[str]:
    """Terms by which a lineage names the data set: folder, file, and what ``more`` has for the folder."""
    folder, stem = (x.lower() for x in _place(source))
    return sorted({folder, stem, *(more or {}).get(folder, [])})


def ordered_columns(columns: list[str], preferred: list[str]) -> list[str]:
    """The preferred ones that there are, in their order, then the others in theirs."""
    first = [c for c in preferred if c in columns]
    return first + [c for c in columns if c not in first]
