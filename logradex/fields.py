"""Roles of address columns, and checks of arguments."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

ROLES = tuple("logradouro numero cep localidade municipio estado".split())


@dataclass(frozen=True)
class AddressFields:
    """Which input column plays which role; None where the input has no such column."""

    logradouro: str | None = None
    numero: str | None = None
    cep: str | None = None
    localidade: str | None = None
    municipio: str | None = None
    estado: str | None = None

    def __post_init__(self) -> None:
        given = self.mapping()
        if not given:
            raise ValueError("at least one role needs a column")
        for role, column in given.items():
            if not isinstance(column, str):
                raise TypeError(f"{role}: a column name is a string, not {type(column).__name__}")
        if len(set(given.values())) < len(given):
            raise ValueError("one column plays several roles")

    @classmethod
    def of(cls, mapping: AddressFields | dict[str, str]) -> AddressFields:
        if isinstance(mapping, cls):
            return mapping
        unknown = set(mapping) - set(ROLES)
        if unknown:
            raise ValueError(f"unknown roles: {', '.join(sorted(unknown))}")
        return cls(**mapping)

    def mapping(self) -> dict[str, str]:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}

    def check(self, df: DataFrame) -> None:
        """Every mapped column exists; state and city are mapped; names are plain."""
        missing = [c for c in self.mapping().values() if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the input: {', '.join(missing)}")
        absent = [r for r in ("estado", "municipio") if getattr(self, r) is None]
        if absent:
            raise ValueError(f"roles that need a column: {', '.join(absent)}")
        odd = [c for c in df.columns if not re.fullmatch(r"[A-Za-z0-9_]+", c)]
        if odd:
            raise ValueError(f"column names may have letters, digits and underscores: {', '.join(odd)}")


def check_flag(name: str, value: object) -> None:
    if not isinstance(value, bool):
        raise TypeError(f"{name} is True or False, not {value!r}")


def check_h3(res: int | list[int] | None) -> list[int]:
    """Resolutions as a sorted list without repeats."""
    if res is None:
        return []
    values = [res] if isinstance(res, int) else list(res)
    for v in values:
        if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v <= 15:
            raise ValueError(f"a resolution is a whole number from 0 to 15, not {v!r}")
    return sorted(set(values))
