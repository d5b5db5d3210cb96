"""Columns as SQL text, for functions of a session whose bodies are SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession

#: A string literal, or an operator written as a function.
TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])([=<>!+\-*/%]+|and|or|not)\(", re.S)


def sql_text(column: Column) -> str:
    """SQL of a column made of functions, cases, casts, literals and lambdas; operators become functions in backticks."""
    text = str(column).removeprefix("Column<'").removesuffix("'>")
    return TOKEN.sub(lambda m: f"`{m[1]}`(" if m[1] else m[0], text)


def create(spark: SparkSession, name: str, parameters: str, returns: str, body: Column) -> None:
    """A function of the session whose calls the optimiser replaces by ``body``, which names the parameters as columns."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {sql_text(body)}")
