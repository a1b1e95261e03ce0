"""Column expressions shared by the jobs (all built-in, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters PHP's trim() strips by default
# (space, tab, newline, carriage return, NUL, vertical tab).
TRIM_CHARS = " \t\n\r\x00\x0b"

# The position forced by the consultant flag, and the
# positions the junior-doctor report selects.
CONSULTANT_POSITION = "consultant"
JUNIOR_POSITIONS = ("junior houseman(jh)", "student(s)")

# Nurse role tables in priority order with the labels used by
# the ward form / nurse listing, the nurse form's role codes, and the labels
# of the staff-position report (which spells the last one out).
NURSE_ROLES = ("day_sister", "night_sister", "staff_nurse", "non_reg_nurse")
ROLE_LABELS = {
    "day_sister": "Day Sister",
    "night_sister": "Night Sister",
    "staff_nurse": "Staff Nurse",
    "non_reg_nurse": "Non-Reg Nurse",
}
ROLE_FORM_CODES = {
    "day_sister": "day_sister",
    "night_sister": "night_sister",
    "staff_nurse": "staff_nurse",
    "non_reg": "non_reg_nurse",
}
POSITION_COUNT_LABELS = {
    "day_sister": "Day Sister",
    "night_sister": "Night Sister",
    "staff_nurse": "Staff Nurse",
    "non_reg_nurse": "Non-Registered Nurse",
}
WARD_FORM_ROLE_FALLBACK = "Nurse"
NURSE_LIST_ROLE_FALLBACK = "Unassigned"


def clean_text(c: Column | str) -> Column:
    """Strip the same characters as PHP trim()."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(TRIM_CHARS))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, NULL when it is empty (optional form fields)."""
    cleaned = clean_text(c)
    return F.when(cleaned == F.lit(""), F.lit(None)).otherwise(cleaned)


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == F.lit(""))


def yes_no(present: Column) -> Column:
    """'Yes' when the looked-up key is present, else 'No'."""
    return F.when(present.isNotNull(), F.lit("Yes")).otherwise(F.lit("No"))


def format_key(prefix: str, number: Column) -> Column:
    """PREFIX-NNN with at least three digits; never truncates (PAT-1000)."""
    return F.format_string(f"{prefix}-%03d", number)


def key_number(key: Column, prefix: str) -> Column:
    """Numeric suffix after 'PREFIX-', NULL when it is not a number."""
    return F.substring(key, len(prefix) + 2, 99).try_cast("long")


def php_intval(c: Column, default: int) -> Column:
    """PHP intval() of a form string: the leading numeric prefix after
    whitespace (sign, digits, optional fraction and exponent) truncated
    toward zero; no numeric prefix gives 0.

    A missing field (NULL) takes ``default`` like ``?? default`` in the form
    handler. A value outside the INT range gives NULL, which the ward insert
    refuses as ``invalid_value``.
    """
    number = F.regexp_extract(
        c, r"^[ \t\n\r\x0b\f]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1)
    parsed = F.when(number == F.lit(""), F.lit(0)).otherwise(
        number.try_cast("double").try_cast("int"))
    return F.when(c.isNull(), F.lit(default)).otherwise(parsed)
