"""Code and label mappings as native expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorkit.functions.values import _col

# First letter of a diagnosis code -> chapter. D and H are divided by the
# second character; every other code is chapter 0.
CHAPTER_OF_LETTER = {
    "A": 1, "B": 1, "C": 2, "E": 4, "F": 5, "G": 6, "I": 9, "J": 10, "K": 11, "L": 12, "M": 13,
    "N": 14, "O": 15, "P": 16, "Q": 17, "R": 18, "S": 19, "T": 19, "U": 22, "V": 20, "W": 20,
    "X": 20, "Y": 20, "Z": 21,
}
CHAPTER_OF_D = [("0", "4", 2), ("5", "8", 3)]
CHAPTER_OF_H = [("0", "5", 7), ("6", "9", 8)]
N_CHAPTERS = 22
#: All characters that are white space in Unicode text.
WHITE = "".join(x for x in map(chr, range(0x3001)) if x.isspace())

# Care-unit names -> compact labels.
UNIT_LABELS = {
    "Coronary Care Unit (CCU)": "CCU",
    "Medical Intensive Care Unit (MICU)": "MICU",
    "Medical/Surgical Intensive Care Unit (MICU/SICU)": "MICU_SICU",
    "Surgical Intensive Care Unit (SICU)": "SICU",
    "Trauma SICU (TSICU)": "TSICU",
    "Neuro Surgical Intensive Care Unit (Neuro SICU)": "Neuro_SICU",
    "Cardiac Vascular ICU": "CVICU",
    "Neuro Intermediate": "Neuro_Intermediate",
    "Neuro Stepdown": "Neuro_Stepdown",
    "MICU/SICU": "MICU_SICU",
}

# The first label one of whose texts occurs in the upper-cased input wins.
ADMISSION_TYPE_RULES = [
    ("Elective", ["ELECTIVE", "SURGICAL SAME DAY"]),
    ("Urgent", ["URGENT"]),
    ("Emergency", ["EMER", "EW "]),
]
ADMISSION_LOCATION_RULES = [
    ("Emergency Room", ["EMERGENCY"]),
    ("Transfer from SNF", ["SNF", "SKILLED"]),
    ("Transfer from Hospital", ["TRANSFER", "HOSPITAL"]),
    ("Clinic Referral", ["CLINIC"]),
    ("Physician Referral", ["PHYSICIAN"]),
    ("Walk-in/Self Referral", ["WALK", "SELF"]),
]


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def trimmed(c: str | Column) -> Column:
    """Strip white space of any kind."""
    return F.btrim(_col(c), F.lit(WHITE))


def code_chapter(code: str | Column) -> Column:
    """Diagnosis code to chapter 0..22; case and outer blanks do not matter, NULL is 0."""
    text = F.upper(trimmed(code))
    letter, second = F.substring(text, 1, 1), F.substring(text, 2, 1)
    split = F.lit(None).cast("int")
    for head, ranges in (("D", CHAPTER_OF_D), ("H", CHAPTER_OF_H)):
        for low, high, chapter in ranges:
            split = F.when((letter == head) & second.between(low, high), chapter).otherwise(split)
    return F.coalesce(split, F.try_element_at(literal_map(CHAPTER_OF_LETTER), letter), F.lit(0))


def first_label(text: str | Column, rules: list[tuple[str, list[str]]], default: str = "Other") -> Column:
    """Ordered substring tests; a missing text gets ``default``."""
    upper = F.upper(_col(text))
    out = F.lit(default)
    for label, needles in reversed(rules):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | upper.contains(needle)
        out = F.when(hit, label).otherwise(out)
    return out


def admission_type(text: str | Column) -> Column:
    return first_label(text, ADMISSION_TYPE_RULES)


def admission_location(text: str | Column) -> Column:
    return first_label(text, ADMISSION_LOCATION_RULES)


def unit_label(text: str | Column, labels: dict[str, str] | None = None, missing: str = "Unknown") -> Column:
    """Exact replacement of trimmed names; unmapped names stay, NULL becomes ``missing``."""
    name = trimmed(text)
    table = literal_map(UNIT_LABELS if labels is None else labels)
    return F.coalesce(F.try_element_at(table, name), name, F.lit(missing))
