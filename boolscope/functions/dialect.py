"""The few words in which Spark SQL and the oracle's SQL differ; all operators write their SQL through these."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Dialect:
    """Spark SQL."""

    name = "spark"

    def __init__(self, tables: str = "", spark: SparkSession | None = None, drawn: bool = False):
        """drawn: queries over all networks of three nodes run over those that lineitem's rows draw."""
        self.tables, self.spark, self.drawn = tables, spark, drawn

    def named(self, name: str, text: str) -> str:
        """A small relation that depends on nothing but its name: kept in memory for the session, where there is one."""
        if self.spark is None:
            return text
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"SELECT * FROM {text} AS kept").cache().createOrReplaceTempView(name)
        return name

    def table(self, name: str) -> str:
        return f"parquet.`{self.tables}/{name}.parquet`"

    def div(self, a: str, b: object) -> str:
        return f"(({a}) DIV {b})"

    def xor(self, a: str, b: str) -> str:
        return f"(({a}) ^ ({b}))"

    def ones(self, a: str) -> str:
        return f"CAST(bit_count({a}) AS BIGINT)"

    def at(self, xs: str, i: object) -> str:
        """The element of an array at a place counted from 0."""
        return f"element_at({xs}, CAST(({i}) + 1 AS INT))"

    def each(self, xs: str, x: str, body: str) -> str:
        return f"transform({xs}, {x} -> {body})"

    def total(self, xs: str) -> str:
        return f"aggregate({xs}, CAST(0 AS DOUBLE), (a, b) -> a + b)"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def least_of(self, xs: str) -> str:
        return f"array_min({xs})"

    def ascending(self, xs: str) -> str:
        return f"array_sort({xs})"

    def joined(self, items: str, sep: str) -> str:
        return f"array_join({items}, '{sep}')"

    def bits(self, a: str, n: int) -> str:
        """A number as a string of n bits, bit 0 first."""
        return f"reverse(lpad(bin({a}), {n}, '0'))"

    def number(self, bits: str) -> str:
        return f"CAST(conv(reverse({bits}), 2, 10) AS BIGINT)"

    def sorted_list(self, x: str) -> str:
        return f"array_sort(collect_list({x}))"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def matches(self, x: str, pattern: str) -> str:
        return f"{x} rlike '{pattern}'"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def median(self, x: str) -> str:
        return f"percentile({x}, 0.5)"

    def find(self, x: str, part: str) -> str:
        return f"instr({x}, {part})"

    def explode(self, relation: str, xs: str, x: str) -> str:
        return f"{relation} LATERAL VIEW explode({xs}) AS {x}"

    def explode_at(self, relation: str, xs: str, n: int, i: str, x: str) -> str:
        """Rows of an array of n elements with their places counted from 0."""
        return f"{relation} LATERAL VIEW posexplode({xs}) AS {i}, {x}"

    def squared_distance(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), CAST(0 AS DOUBLE), (s, x) -> s + x)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * y), CAST(0 AS DOUBLE), (s, x) -> s + x)"


class Oracle(Dialect):
    """DuckDB."""

    name = "duckdb"

    def table(self, name: str) -> str:
        return name

    def div(self, a: str, b: object) -> str:
        return f"(({a}) // {b})"

    def xor(self, a: str, b: str) -> str:
        return f"xor({a}, {b})"

    def at(self, xs: str, i: object) -> str:
        return f"{xs}[({i}) + 1]"

    def each(self, xs: str, x: str, body: str) -> str:
        return f"[{body} for {x} in {xs}]"

    def total(self, xs: str) -> str:
        return f"list_sum({xs})"

    def array(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def least_of(self, xs: str) -> str:
        return f"list_min({xs})"

    def ascending(self, xs: str) -> str:
        return f"list_sort({xs})"

    def joined(self, items: str, sep: str) -> str:
        return f"array_to_string({items}, '{sep}')"

    def bits(self, a: str, n: int) -> str:
        return f"reverse(lpad(bin({a}), {n}, '0'))"

    def number(self, bits: str) -> str:
        return f"CAST(list_sum([CASE WHEN substr({bits}, CAST(i + 1 AS INT), 1) = '1' THEN 1 << CAST(i AS INT) ELSE 0 END for i in range(length({bits}))]) AS BIGINT)"

    def sorted_list(self, x: str) -> str:
        return f"list_sort(list({x}))"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def median(self, x: str) -> str:
        return f"median({x})"

    def find(self, x: str, part: str) -> str:
        return f"strpos({x}, {part})"

    def explode(self, relation: str, xs: str, x: str) -> str:
        return f"(SELECT *, unnest({xs}) AS {x} FROM {relation})"

    def explode_at(self, relation: str, xs: str, n: int, i: str, x: str) -> str:
        return f"(SELECT *, {xs}[{i} + 1] AS {x} FROM {relation} CROSS JOIN range({n}) AS places({i}))"

    def squared_distance(self, a: str, b: str) -> str:
        return f"power(list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 2)"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
