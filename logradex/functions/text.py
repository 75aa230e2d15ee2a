"""Standardisers of address parts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "ÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
_PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUCNY"

STATES = {
    "11": ("RO", "RONDONIA"), "12": ("AC", "ACRE"), "13": ("AM", "AMAZONAS"), "14": ("RR", "RORAIMA"),
    "15": ("PA", "PARA"), "16": ("AP", "AMAPA"), "17": ("TO", "TOCANTINS"), "21": ("MA", "MARANHAO"),
    "22": ("PI", "PIAUI"), "23": ("CE", "CEARA"), "24": ("RN", "RIO GRANDE DO NORTE"), "25": ("PB", "PARAIBA"),
    "26": ("PE", "PERNAMBUCO"), "27": ("AL", "ALAGOAS"), "28": ("SE", "SERGIPE"), "29": ("BA", "BAHIA"),
    "31": ("MG", "MINAS GERAIS"), "32": ("ES", "ESPIRITO SANTO"), "33": ("RJ", "RIO DE JANEIRO"),
    "35": ("SP", "SAO PAULO"), "41": ("PR", "PARANA"), "42": ("SC", "SANTA CATARINA"),
    "43": ("RS", "RIO GRANDE DO SUL"), "50": ("MS", "MATO GROSSO DO SUL"), "51": ("MT", "MATO GROSSO"),
    "52": ("GO", "GOIAS"), "53": ("DF", "DISTRITO FEDERAL"),
}

STREET_TYPES = {
    "R": "RUA", "AV": "AVENIDA", "AVE": "AVENIDA", "TV": "TRAVESSA", "TRAV": "TRAVESSA", "AL": "ALAMEDA",
    "PCA": "PRACA", "PC": "PRACA", "ROD": "RODOVIA", "EST": "ESTRADA", "ESTR": "ESTRADA", "LGO": "LARGO",
    "LG": "LARGO", "BC": "BECO", "VL": "VILA", "QD": "QUADRA", "CJ": "CONJUNTO", "CONJ": "CONJUNTO", "LAD": "LADEIRA",
}
STREET_WORDS = {
    "DR": "DOUTOR", "DRA": "DOUTORA", "PROF": "PROFESSOR", "PROFA": "PROFESSORA", "STA": "SANTA", "STO": "SANTO",
    "CEL": "CORONEL", "GEN": "GENERAL", "CAP": "CAPITAO", "TEN": "TENENTE", "MAL": "MARECHAL", "PRES": "PRESIDENTE",
    "ENG": "ENGENHEIRO", "PE": "PADRE", "D": "DOM", "GOV": "GOVERNADOR", "SEN": "SENADOR", "DEP": "DEPUTADO",
    "VER": "VEREADOR", "BR": "BR", "N": "NOSSA", "SRA": "SENHORA",
}
PLACE_WORDS = {
    "JD": "JARDIM", "JDIM": "JARDIM", "VL": "VILA", "PQ": "PARQUE", "PRQ": "PARQUE", "STA": "SANTA", "STO": "SANTO",
    "CJ": "CONJUNTO", "CONJ": "CONJUNTO", "RES": "RESIDENCIAL", "LOT": "LOTEAMENTO", "CTO": "CENTRO",
}
NO_NAME = r"^(?:RUA |AVENIDA )?(?:S/?N|SEM (?:NOME|DENOMINACAO?)|NAO INFORMADO)$"


def plain(c: Column) -> Column:
    """Upper case without accents, single spaces, null if nothing is left."""
    x = F.translate(F.upper(c), _ACCENTED, _PLAIN)
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.nullif(x, F.lit(""))


def _expand(words: dict[str, str], first: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """Replace whole words out of a dictionary, the first word out of another one before."""
    table = F.create_map(*[F.lit(x) for p in words.items() for x in p])
    heads = F.create_map(*[F.lit(x) for p in (first or {"": ""}).items() for x in p])

    def one(w: Column, i: Column) -> Column:
        bare = F.regexp_replace(w, r"\.$", "")
        head = F.when(i == 0, F.try_element_at(heads, bare)) if first else F.lit(None).cast("string")
        return F.coalesce(head, F.try_element_at(table, bare), bare)

    return lambda c: F.array_join(F.transform(F.split(c, " "), one), " ")


def state(c: Column) -> Column:
    """Two-letter code from a code, a full name or the census number; null if unknown."""
    pairs = {}
    for number, (code, name) in STATES.items():
        pairs |= {number: code, code: code, name: code}
    table = F.create_map(*[F.lit(x) for p in pairs.items() for x in p])
    return F.try_element_at(table, plain(c.cast("string")))


def city(c: Column) -> Column:
    return plain(F.regexp_replace(c.cast("string"), r"['`´-]", " "))


def street(c: Column) -> Column:
    """Street name with its type spelled out; null for streets without a name."""
    x = plain(F.regexp_replace(c, r"[,;\"]", " "))
    x = F.regexp_replace(F.regexp_replace(x, r"\.(?=\S)", ". "), r"\s+", " ")
    x = _expand(STREET_WORDS, STREET_TYPES)(x)
    return F.when(~x.rlike(NO_NAME), x)


def district(c: Column) -> Column:
    return _expand(PLACE_WORDS)(plain(F.regexp_replace(c, r"[,;\"]", " ")))


def number(c: Column) -> Column:
    """House number; 0, "S/N" and anything but digits give null."""
    digits = F.trim(c.cast("string"))
    value = F.when(digits.rlike(r"^[0-9]{1,9}(?:\.0+)?$"), F.regexp_extract(digits, r"^[0-9]+", 0).try_cast("int"))
    return F.nullif(value, F.lit(0))


def cep(c: Column) -> Column:
    """Postal code as NNNNN-NNN; null if it has not eight digits (seven get a leading zero)."""
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    padded = F.when(F.length(digits).isin(7, 8), F.lpad(digits, 8, "0"))
    return F.concat(F.substring(padded, 1, 5), F.lit("-"), F.substring(padded, 6, 3))
