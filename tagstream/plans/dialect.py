"""One declarative text for each relational query: Spark SQL runs it, and so does the oracle engine.

A query is a function of a dialect, which spells the few expressions that differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import ADAPTERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = ("lineitem", "orders", "events", "embeddings")


class Spark:
    once = ""

    def __init__(self, sf_dir: str):
        self.tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}

    def int(self, x):
        return f"CAST({x} AS BIGINT)"

    def even(self, x, n=0):
        return f"bround({x}, {n})"

    def xor(self, a, b):
        return f"({a} ^ {b})"

    def match(self, x, pattern):
        return f"({x} RLIKE '^(?:{pattern})$')"

    def extract(self, x, pattern, group):
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def pad(self, x, n):
        return f"lpad(CAST({x} AS STRING), {n}, '0')"

    def char(self, x):
        return f"chr({x})"

    def last_value(self, x):
        return f"last_value({x}) IGNORE NULLS"

    def hexed(self, x):
        """A hexadecimal text of up to 8 digits as a number."""
        return f"CAST(conv({x}, 16, 10) AS BIGINT)"

    def replaced(self, x, pattern, by):
        return f"regexp_replace({x}, r'{pattern}', '{by}')"

    def explode(self, a, b):
        return f"LATERAL explode(sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT)))"


class Duck(Spark):
    once = "MATERIALIZED "

    def __init__(self):
        self.tables = {t: t for t in TABLES}

    def int(self, x):
        return f"CAST(trunc({x}) AS BIGINT)"

    def even(self, x, n=0):
        return f"round_even({x}, {n})"

    def xor(self, a, b):
        return f"xor({a}, {b})"

    def match(self, x, pattern):
        return f"regexp_full_match({x}, '{pattern}')"

    def extract(self, x, pattern, group):
        return f"regexp_extract({x}, '{pattern}', {group})"

    def pad(self, x, n):
        return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"

    def last_value(self, x):
        return f"last_value({x} IGNORE NULLS)"

    def hexed(self, x):
        return f"CAST(concat('0x', {x}) AS BIGINT)"

    def replaced(self, x, pattern, by):
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def explode(self, a, b):
        return f"LATERAL unnest(generate_series(CAST({a} AS BIGINT), CAST({b} AS BIGINT)))"


def views(d: Spark, names: tuple[str, ...], more: dict | None = None) -> str:
    parts = [f"{n} AS ({ADAPTERS[n].format(**d.tables)})" for n in names]
    parts += [f"{n} AS {d.once}({text(d)})" for n, text in (more or {}).items()]
    return ",\n".join(parts)


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(ADAPTERS[name].format(**Spark(sf_dir).tables))


def relational(name: str, *names: str, more: dict | None = None):
    """Register text(dialect) as a Spark query and as its oracle."""

    def add(text: Callable[[Spark], str]):
        def whole(d):
            return f"WITH {views(d, names, more)}\n{text(d)}"

        QUERIES[name] = lambda spark, sf_dir: spark.sql(whole(Spark(sf_dir)))
        SQL[name] = whole(Duck())
        return text

    return add


def frame(name: str, oracle: str | None = None, names: tuple[str, ...] = (), more: dict | None = None):
    """Register a DataFrame function of (spark, sf_dir), with an oracle text over adapters if SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = (f"WITH {views(Duck(), names, more)}\n" if names or more else "") + oracle
        return f

    return add
