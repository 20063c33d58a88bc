"""Row rules as native column expressions.

A rule is a function from the row's trimmed cells (name -> Column) to a message, or
to null where the row passes. A rule set names its columns, its rules in the order
of their messages, and the columns' identity; swap one for another to accept
another kind of file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.config import Limits
from sluice.functions.cells import ascii_lower

Cells = dict[str, Column]
Rule = Callable[[Cells], Column]


def _nothing() -> Column:
    return F.lit(None).cast("string")


def required(column: str) -> Rule:
    return lambda cells: F.when(F.coalesce(cells[column], F.lit("")) == "", F.lit(f"{column} is required"))


def max_length(column: str, most: int) -> Rule:
    """Characters are code points; an empty cell passes."""
    return lambda cells: F.when(F.length(cells[column]) > most, F.lit(f"{column} is longer than {most} characters"))


def whole_number(column: str, least: int = 1, most: int | None = None) -> Rule:
    """A sign at most, no leading zero, no fraction, within 64 bits."""

    def rule(cells: Cells) -> Column:
        value = integer(cells[column])
        fits = cells[column].rlike("^([+-]?[1-9][0-9]*|[+-]?0)$") & (value >= least)
        text = "must be a positive whole number" if most is None else f"must be a whole number from {least} to {most}"
        return F.when(F.coalesce(fits if most is None else fits & (value <= most), F.lit(False)), _nothing()).otherwise(F.lit(f"{column} {text}"))

    return rule


def one_of(column: str, *names: str) -> Rule:
    """One of the names, in any case."""
    allowed = [n.lower() for n in names]
    return lambda cells: F.when(F.coalesce(ascii_lower(cells[column]), F.lit("")).isin(allowed), _nothing()).otherwise(F.lit(f"{column} must be one of: {', '.join(names)}"))


def integer(cell: Column) -> Column:
    """The cell as a 64-bit integer, null where it is none."""
    return cell.try_cast("bigint")


@dataclass(frozen=True)
class RuleSet:
    columns: tuple[str, ...]
    rules: tuple[Rule, ...]
    key: Callable[[Cells], Column]

    def errors(self, cells: Cells) -> Column:
        """Messages of all failing rules, in order."""
        return F.array_compact(F.array(*(rule(cells) for rule in self.rules)))


def error_text(errors: Column) -> Column:
    return F.concat_ws("; ", errors)


def consent_rules(limits: Limits = Limits()) -> RuleSet:
    """Consent records: a code may repeat with another version."""
    code, name, description, purpose, version, status = columns = ("Consent code", "Consent name", "Description", "Purpose", "Version", "Status")
    return RuleSet(
        columns,
        (
            required(code), max_length(code, limits.code_chars),
            required(name), max_length(name, limits.name_chars),
            max_length(description, limits.description_chars),
            required(purpose), max_length(purpose, limits.purpose_chars),
            whole_number(version), one_of(status, "Active", "Inactive"),
        ),
        lambda cells: F.struct(cells[code].alias("code"), integer(cells[version]).alias("version")),
    )
