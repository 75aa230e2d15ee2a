"""Street names that occur all over a city and so identify little."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = "RUA|TRAVESSA|RAMAL|BECO|BLOCO|AVENIDA|RODOVIA|ESTRADA"
_CODES = "[A-Z]{1,2}-?|[0-9]{1,3}|[A-Z]{1,2}-?[0-9]{1,3}|[A-Z]{1,2}\\s+[0-9]{1,3}|[0-9]{1,3}-?[A-Z]{1,2}"
CODED = rf"^(?:{_TYPES})\s+(?:{_CODES})(?:\s+KM(?: [0-9]+)?)?$"
LOW_NUMBERS = "UM DOIS TRES CINCO SEIS SETE OITO NOVE DEZ ONZE DOZE TREZE".split()
SPELLED = rf"RUA\s+(?:{'|'.join(LOW_NUMBERS)})$"
_MONTHS = "JANEIRO FEVEREIRO MARCO ABRIL MAIO JUNHO JULHO AGOSTO SETEMBRO OUTUBRO NOVEMBRO DEZEMBRO".split()
DATED = rf"\bDE (?:{'|'.join(_MONTHS)})\b"
HIGH_NUMBERS = (
    "QUATRO QUATORZE QUINZE DEZESSEIS DEZESSETE DEZOITO DEZENOVE VINTE TRINTA QUARENTA CINQUENTA SESSENTA SETENTA"
    " OITENTA NOVENTA"
).split()
SPELLED_HIGH = rf"RUA (?:{'|'.join(HIGH_NUMBERS)})"


def is_ambiguous(street: Column) -> Column:
    """Coded or numbered streets that are not named after a date; false for null."""
    return F.coalesce((street.rlike(CODED) | street.rlike(SPELLED)) & ~street.rlike(DATED), F.lit(False))
