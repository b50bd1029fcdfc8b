"""Analytical blocks as data: a grain, dimensions, measures and what follows the grouping.

A block builds one DataFrame plan. Its expressions are plain SQL text, which keeps a block a single
declaration: `spark` builds the plan from the star's DataFrames, `sql` writes the same block over the
SQL twin of the star for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.commerce import STAR_SQL, star


def ratio(a: str, b: str) -> str:
    """a / b as doubles, NULL where b is 0."""
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


def total(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE)"


def count(what: str = "*") -> str:
    return f"CAST(count({what}) AS BIGINT)"


#: Measures over the order, item and delivery facts.
ORDER = {
    "orders": count(), "clients": count("DISTINCT client_id"), "units": total("units"), "gross": total("gross"), "discount": total("discount"),
    "net": total("net"), "cost": total("cost"), "margin": total("margin"), "ticket": ratio("sum(net)", "count(*)"),
    "items_per_order": ratio("sum(units)", "count(*)"), "discount_pct": ratio("sum(discount)", "sum(gross)"), "margin_pct": ratio("sum(margin)", "sum(net)"),
}
ITEM = {
    "lines": count(), "orders": count("DISTINCT order_id"), "clients": count("DISTINCT client_id"), "products": count("DISTINCT product_id"),
    "units": total("qty"), "gross": total("gross"), "discount": total("discount"), "net": total("net"), "cost": total("cost"), "margin": total("margin"),
    "discount_pct": ratio("sum(discount)", "sum(gross)"), "margin_pct": ratio("sum(margin)", "sum(net)"),
}
DELIVERY = {
    "deliveries": count(), "late": count("CASE WHEN status = 'Atrasado' THEN 1 END"), "early": count("CASE WHEN status = 'Adiantado' THEN 1 END"),
    "late_rate": ratio("count(CASE WHEN status = 'Atrasado' THEN 1 END)", "count(*)"),
    "service_level": ratio("count(CASE WHEN status <> 'Atrasado' THEN 1 END)", "count(*)"),
    "mean_promised": ratio("sum(promised)", "count(*)"), "mean_actual": ratio("sum(actual)", "count(*)"),
    "mean_late_days": ratio("sum(CASE WHEN late_days > 0 THEN late_days END)", "count(CASE WHEN late_days > 0 THEN 1 END)"),
    "mean_rating": ratio("sum(rating)", "count(rating)"), "net": total("net"),
}


#: Columns besides the key that two tables of the star have in common; the left table's count.
SHARED = {
    ("item", "ord"): "client_id, order_date, ym, gross, net, cost, discount, margin",
    ("delivery", "ord"): "client_id, order_date, ym, gross, net, margin, units",
}


def pick(measures: dict[str, str], *names: str) -> dict[str, str]:
    return {n: measures[n] for n in names}


@dataclass
class Block:
    """One analytical query.

    grain: table of the star, joined with `joins` (table, key) if any. dims and measures: name ->
    SQL. post: columns made after the grouping, by further SQL (windows run over grouped rows).
    then: a second grouping, (dims, measures). top: (ordering, n).
    """

    grain: str
    dims: dict[str, str]
    measures: dict[str, str]
    where: str | None = None
    joins: list[tuple[str, str]] = field(default_factory=list)
    then: tuple[dict[str, str], dict[str, str]] | None = None
    post: list[dict[str, str]] = field(default_factory=list)
    keep: str | None = None
    top: tuple[str, int] | None = None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = star(spark, sf_dir)
        df = tables[self.grain]
        for table, key in self.joins:
            right = tables[table]
            df = df.join(right.select(key, *[c for c in right.columns if c not in df.columns]), key)
        if self.where:
            df = df.filter(self.where)
        df = self._grouped(df, self.dims, self.measures)
        if self.then:
            df = self._grouped(df, *self.then)
        for more in self.post:
            df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in more.items()])
        if self.keep:
            df = df.filter(self.keep)
        if self.top:
            df = df.orderBy(*[F.expr(x.removesuffix(" DESC")).desc() if x.endswith(" DESC") else F.expr(x) for x in self.top[0].split(", ")]).limit(self.top[1])
        return df

    @staticmethod
    def _grouped(df: DataFrame, dims: dict[str, str], measures: dict[str, str]) -> DataFrame:
        df = df.withColumns({f"__{n}": F.expr(e) for n, e in dims.items()}) if dims else df
        keys = [F.col(f"__{n}").alias(n) for n in dims]
        return df.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in measures.items()])

    def sql(self) -> str:
        source = self.grain
        for t, k in self.joins:
            shared = SHARED.get((self.grain, t))
            source += f" JOIN (SELECT {'* EXCLUDE (' + shared + ')' if shared else '*'} FROM {t}) USING ({k})"
        listed = lambda x: ", ".join(f"{e} AS {n}" for n, e in x.items())
        group = lambda d: " GROUP BY " + ", ".join(d.values()) if d else ""
        parts = [f"q0 AS (SELECT {listed(self.dims | self.measures)} FROM {source}{' WHERE ' + self.where if self.where else ''}{group(self.dims)})"]
        if self.then:
            d, m = self.then
            parts.append(f"q{len(parts)} AS (SELECT {listed(d | m)} FROM q{len(parts) - 1}{group(d)})")
        for more in self.post:
            parts.append(f"q{len(parts)} AS (SELECT *, {listed(more)} FROM q{len(parts) - 1})")
        tail = (f" WHERE {self.keep}" if self.keep else "") + (f" ORDER BY {self.top[0]} LIMIT {self.top[1]}" if self.top else "")
        text = f"WITH {STAR_SQL}, {', '.join(parts)} SELECT * FROM q{len(parts) - 1}{tail}"
        return text.replace("weekday(order_date) + 1", "isodow(order_date)")
