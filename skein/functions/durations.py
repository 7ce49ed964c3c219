"""Spoken numbers and durations, as column expressions over a table of number words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Our own table: small numbers in the languages of the tables.
NUMBERS = {"one": 1, "two": 2, "three": 3, "five": 5, "ten": 10, "fifteen": 15, "twenty": 20, "thirty": 30, "un": 1, "deux": 2, "cinq": 5, "dix": 10, "zwei": 2, "fünf": 5, "zehn": 10, "dos": 2, "cinco": 5, "diez": 10}


def spoken_number(word: Column, numbers: dict[str, int] = NUMBERS) -> Column:
    """Digits or a known number word; null for anything else."""
    table = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    return F.coalesce(word.try_cast("int"), F.try_element_at(table, F.lower(word)))


def seconds(text: Column, most: int = 86_400) -> Column:
    """The first "number unit" in the text in seconds, within 1 and ``most``; null without one."""
    pattern = r"(?iU)(\d+|\p{L}+)\s*(seconds?|secondes?|sekunden?|segundos?|minutes?|minuten?|minutos?|hours?|heures?|stunden?|horas?)\b"
    number = spoken_number(F.regexp_extract(text, pattern, 1))
    unit = F.lower(F.substring(F.regexp_extract(text, pattern, 2), 1, 2))
    scale = F.when(unit.isin("se"), 1).when(unit == "mi", 60).when(unit.isin("ho", "he", "st"), 3600)
    return F.when(number.isNotNull() & scale.isNotNull(), F.greatest(F.lit(1), F.least(number * scale, F.lit(most))))
