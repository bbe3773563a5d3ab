"""Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accented lower-case letters and the plain letter each one becomes.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüç"
PLAIN = "aaaaaeeeeiiiiooooouuuuc"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_accents(c: Column | str) -> Column:
    """Lower-case text with the accents of ``ACCENTED`` removed; other letters stay."""
    return F.translate(F.lower(col(c)), ACCENTED, PLAIN)


def positive_log(c: Column | str) -> Column:
    """Natural log; NULL (missing) for zero and negative values."""
    return F.when(col(c) > 0, F.ln(col(c)))


def ratio(num: Column | str, den: Column | str) -> Column:
    return F.try_divide(col(num), col(den))


def extract_year(c: Column | str) -> Column:
    """First run of four digits in a period label, as INT; NULL if there is none."""
    return F.regexp_extract(col(c), r"\d{4}", 0).try_cast("int")


def prefix_key(c: Column | str, length: int = 6) -> Column:
    """The first ``length`` characters of a numeric key, as INT."""
    return F.substring(col(c).cast("string"), 1, length).try_cast("int")


def parse_date(c: Column | str, fmt: str = "dd/MM/yyyy") -> Column:
    return F.try_to_timestamp(col(c), F.lit(fmt)).cast("date")


def treated_flag(start: Column | str, year: Column | str) -> Column:
    """1 from the first treated year on, 0 before it and for units never treated.
    A start of 0 means never treated, just as NULL does."""
    start = col(start)
    return F.when(start.isNull() | (start == 0) | (start > col(year)), 0).otherwise(1)


def arm_label(start: Column | str, lo: int, hi: int) -> Column:
    """"Treated" when treatment starts inside the window, else "Untreated"."""
    inside = F.coalesce(col(start), F.lit(0)).between(lo, hi)
    return F.when(inside, "Treated").otherwise("Untreated")


def shifted_start(start: Column | str, date: Column | str, month: int = 10) -> Column:
    """Start year moved one year on when adoption falls in ``month`` or later."""
    start = col(start)
    return F.when(F.month(col(date)) >= month, start + 1).otherwise(start)


def number_text(c: Column | str, digits: int = 3) -> Column:
    """Half-even rounded number as text without trailing zeros ("0.1", "12", "-0.013")."""
    fixed = F.format_string(f"%.{digits}f", F.bround(col(c), digits))
    if digits <= 0:
        return fixed
    trimmed = F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")
    return F.when(trimmed == "-0", "0").otherwise(trimmed)


def interval_text(lo: Column | str, hi: Column | str, digits: int = 3, percent: bool = False) -> Column:
    """"[lo, hi]", or "[lo%, hi%]" with both ends multiplied by 100."""
    scale, unit = (100.0, "%") if percent else (1.0, "")
    left = number_text(col(lo) * scale, digits)
    right = number_text(col(hi) * scale, digits)
    return F.concat(F.lit("["), left, F.lit(f"{unit}, "), right, F.lit(f"{unit}]"))


def star(lo: Column | str, hi: Column | str) -> Column:
    """"*" when both ends have the same sign, so that the interval leaves out 0."""
    return F.when(col(lo) * col(hi) > 0, "*").otherwise("")


def code_label(c: Column | str, labels: dict[str, str]) -> Column:
    """Display label of a code; NULL for a code that is not listed."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), col(c))


def code_rank(c: Column | str, labels: dict[str, str]) -> Column:
    """Position (from 1) of a code in the label order."""
    pairs = [F.lit(x) for i, code in enumerate(labels, 1) for x in (code, i)]
    return F.try_element_at(F.create_map(*pairs), col(c))
