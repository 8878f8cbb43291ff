"""Validation of records by predicates: an array of error codes for each row, and what passes or goes to quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar

#: Something, an @, labels and a dot; narrower than any mail standard.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\z"


def required(c: Column) -> Column:
    return scalar.truthy(c)


def min_length(c: Column, n: int) -> Column:
    """Missing and empty values pass, as in the form whose rule this is; `required` is for these."""
    return ~scalar.truthy(c) | (F.length(c) >= n)


def email(c: Column) -> Column:
    return ~scalar.truthy(c) | c.rlike(EMAIL_PATTERN)


def matches(c: Column, other: Column) -> Column:
    """A missing or empty repeat is no mismatch."""
    return ~scalar.truthy(c) | (c.eqNullSafe(other))


def registration_rules(prefix: str = "") -> dict[str, Column]:
    """Rules of a registration, in the order in which their codes are listed."""
    col = lambda c: F.col(prefix + c)
    return {
        "first_name.required": required(col("first_name")), "first_name.minlength": min_length(col("first_name"), 2),
        "last_name.required": required(col("last_name")), "last_name.minlength": min_length(col("last_name"), 2),
        "email.required": required(col("email")), "email.email": email(col("email")),
        "phone_number.phoneInvalid": scalar.valid_phone(col("phone_number")),
        "password.required": required(col("password")), "password.minlength": min_length(col("password"), 8),
        "confirm_password.required": required(col("confirm_password")), "confirm_password.passwordMismatch": matches(col("confirm_password"), col("password")),
    }


def with_errors(rows: DataFrame, rules: dict[str, Column], name: str = "errors") -> DataFrame:
    """`rows` with the codes of the rules that a row breaks; a rule that is null is broken."""
    codes = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]
    return rows.withColumn(name, F.array_compact(F.array(*codes)))


def split(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their errors)."""
    checked = with_errors(rows, rules)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
