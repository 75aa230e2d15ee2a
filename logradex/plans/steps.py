"""The catalogue of match steps, strictest first."""

from __future__ import annotations

from dataclasses import dataclass

_KEYS = """
n01 logradouro numero cep localidade
n02 logradouro numero cep
n03 logradouro numero localidade
n04 logradouro numero
l01 logradouro cep localidade
l02 logradouro cep
l03 logradouro localidade
l04 logradouro
c01 cep localidade
c02 cep
b01 localidade
m01
"""
KEYS = {words[0]: tuple(words[1:]) for line in _KEYS.split("\n") if (words := line.split())}
NCL = "municipio_logradouro_numero_cep_localidade"
NL = "municipio_logradouro_numero_localidade"
CL = "municipio_logradouro_cep_localidade"
L = "municipio_logradouro_localidade"
TABLES = (NCL, NL, CL, L, "municipio_cep_localidade", "municipio_cep", "municipio_localidade", "municipio")
PRECISION = {
    "n": "numero", "a": "numero_aproximado", "l": "logradouro", "c": "cep", "b": "localidade", "m": "municipio",
}


@dataclass(frozen=True)
class MatchStep:
    """One way of finding an address: by which keys, in which table, how strictly."""

    code: str
    order: int
    table: str
    cutoff: float | None = None

    @property
    def fuzzy(self) -> bool:
        return self.cutoff is not None

    @property
    def interpolated(self) -> bool:
        return self.code[1] == "a"

    @property
    def keys(self) -> tuple[str, ...]:
        """All key columns; an interpolated step needs a number but doesn't join on it."""
        return ("estado", "municipio", *KEYS[self.code[1:].replace("a", "n")])

    @property
    def join_keys(self) -> tuple[str, ...]:
        return tuple(k for k in self.keys if not (self.interpolated and k == "numero"))

    @property
    def block_keys(self) -> tuple[str, ...]:
        """What a street must share with the input's to be compared with it."""
        return tuple(k for k in self.keys if k not in ("numero", "logradouro"))

    @property
    def precision(self) -> str:
        return PRECISION[self.code[1]]

    @property
    def dictionary(self) -> str:
        """The table that the streets to compare come from."""
        return L if self.code.endswith("03") else CL


def _steps() -> tuple[MatchStep, ...]:
    tables = {
        "dn01": NCL, "da01": NCL, "pn01": NCL, "pa01": NCL, "dn02": NCL, "da02": NCL, "pn02": NCL, "pa02": NCL,
        "dn03": NCL, "da03": NL, "pn03": NCL, "pa03": NL, "dn04": NL, "da04": NL, "dl01": CL, "pl01": CL, "dl02": CL,
        "pl02": CL, "dl03": CL, "pl03": CL, "dl04": L, "dc01": "municipio_cep_localidade", "dc02": "municipio_cep",
        "db01": "municipio_localidade", "dm01": "municipio",
    }
    out = []
    for order, (code, table) in enumerate(tables.items(), 1):
        cutoff = (0.85 if code.endswith("01") else 0.9) if code[0] == "p" else None
        out.append(MatchStep(code, order, table, cutoff))
    return tuple(out)


STEPS = _steps()
STEP = {s.code: s for s in STEPS}
#: Comparisons of streets, in the order in which the steps make them (pa0x reuses what pn0x found).
ATTEMPTS = tuple(s for s in STEPS if s.fuzzy and not s.interpolated)
