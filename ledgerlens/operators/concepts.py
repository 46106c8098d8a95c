"""Financial concepts of columns, found by their names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from ledgerlens.functions.text import WHITESPACE, let_sql, sql_text, strip_sql

# Concepts and the normalized column names that stand for them.
ALIASES = {
    "transaction_date": ("date", "posted date", "posting date", "transaction date"),
    "amount": ("amount", "net amount", "total", "transaction amount"),
    "debit": ("debit", "debit amount", "withdrawal", "withdrawals"),
    "credit": ("credit", "credit amount", "deposit", "deposits"),
    "balance": ("account balance", "balance", "running balance"),
    "identifier": ("id", "reference", "reference number", "transaction id"),
}
CONCEPTS = tuple(ALIASES)
MONEY = ("amount", "debit", "credit", "balance")
NOT_NULL = ("transaction_date", *MONEY)


_ALIAS_TABLE = ", ".join(f"'{alias}', '{concept}'" for concept, names in ALIASES.items() for alias in names)


def normalize_name_sql(name: str) -> str:
    spaced = strip_sql(f"translate(lower({strip_sql(name)}), '-_', '  ')")
    return f"regexp_replace({spaced}, concat('[', {sql_text(WHITESPACE)}, ']+'), ' ')"


def normalize_name(name: str) -> Column:
    return F.expr(normalize_name_sql(name))


def concepts_of(names: str) -> Column:
    """Concept of every position of an array of names (a column).

    A concept belongs to the first name that means it. A later column with another name is an ordinary
    column, one with the very same name shares the concept.
    """
    single = f"transform({names}, _n -> try_element_at(map({_ALIAS_TABLE}), {normalize_name_sql('_n')}))"
    owner = f"get({names}, int(array_position(_ids, get(_ids, _i))) - 1)"
    owned = f"transform({names}, (_n, _i) -> if({owner} = _n, get(_ids, _i), NULL))"
    return F.expr(let_sql("_ids", single, owned))


def literal_concepts(spark: SparkSession, names: list[str]) -> list[str | None]:
    """Concepts of names known when the plan is built."""
    array = F.array(*[F.lit(name) for name in names])
    return spark.sql("SELECT 1").select(array.alias("names")).select(concepts_of("names").alias("c")).first()["c"]


def concept_position(concepts: Column, concept: str) -> Column:
    """Zero-based first position of a concept, NULL when absent."""
    position = F.array_position(concepts, concept).cast("int")
    return F.when(position > 0, position - 1)
