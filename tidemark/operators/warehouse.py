"""Keys of a star: surrogates of many small dimensions at once, many-to-one lookups that fail the query
that would double rows, all foreign keys in one pass, and dimensions that keep what has not changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import ordering
from tidemark.operators.checks import union


def value_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """dimension, value, sk: dense keys 1, 2, ... of the known values of each column, in their order.

    One scan, one grouping and one two-phase order for all columns, so a column may have any number of
    values. Rows are numbered over all columns; a column's keys start behind the columns before it.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]))
    values = df.select(each.alias("x")).select("x.*").filter("value IS NOT NULL").distinct()
    placed = ordering.running(values, [F.col("dimension"), F.col("value")], {}, rank="place")
    before = placed.groupBy("dimension").agg((F.min("place") - 1).alias("before"))
    return placed.join(before, "dimension").select("dimension", "value", (F.col("place") - F.col("before")).alias("sk"))


def lookup(dim: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """natural key and surrogate key, for a many-to-one join.

    A natural key that the dimension holds twice raises an error in the query that joins it: the test is
    part of the expression of the key, so no extra job runs and no pruning can remove it.
    """
    told = F.concat(F.lit(f"{key} is not unique for "), F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in natural]))
    return dim.groupBy(*natural).agg(F.when(F.count("*") > 1, F.raise_error(told).cast("bigint")).otherwise(F.max(key).cast("bigint")).alias(key))


def mapped(fact: DataFrame, lookups: Sequence[tuple[DataFrame, Mapping[str, str], str]]) -> DataFrame:
    """fact with a surrogate key for each (dimension, {column of the fact: natural key}, key): left joins
    that neither lose nor double rows; an unknown or null natural key gives a null."""
    out = fact
    for i, (dim, columns, key) in enumerate(lookups):
        names = {n: f"__{i}_{n}" for n in columns.values()}
        keys = lookup(dim, list(columns.values()), key).withColumnsRenamed(names)
        on = [out[c] == keys[names[n]] for c, n in columns.items()]
        out = out.join(keys, on, "left").drop(*names.values())
    return out


def key_use(facts: Mapping[str, DataFrame], relations: Sequence[tuple[str, str, str]], dims: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """relation, dimension, key, rows, known: every key that a fact's foreign key takes (null too), its
    rows, and whether the dimension has it.

    relations: (fact, column, dimension); dims: table and key column (without any, known is null). A fact is scanned once for all its
    relations; keys are counted before they are shuffled, so a key that holds most rows is one row a
    task, and there is one join, with the keys of all dimensions.
    """
    used = []
    for name, df in facts.items():
        mine = [F.struct(F.lit(f"{name}.{c}").alias("relation"), F.lit(d).alias("dimension"), F.col(c).cast("bigint").alias("key")) for f, c, d in relations if f == name]
        used.append(df.select(F.explode(F.array(*mine)).alias("k")).select("k.*"))
    counted = union(used).groupBy("relation", "dimension", "key").agg(F.count("*").alias("rows"))
    if not dims:
        return counted.withColumn("known", F.lit(None).cast("boolean"))
    there = union([df.select(F.lit(d).alias("dimension"), F.col(k).cast("bigint").alias("key")) for d, (df, k) in dims.items()]).distinct()
    return counted.join(there.withColumn("known", F.lit(True)), ["dimension", "key"], "left").select("relation", "dimension", "key", "rows", F.coalesce("known", F.lit(False)).alias("known"))


def coverage(use: DataFrame) -> DataFrame:
    """One row per relation of `key_use`: rows, keys, null rows, orphans as keys and as rows, percentage covered, status."""
    lost = ~F.col("known") & F.col("key").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = use.groupBy("relation", "dimension").agg(
        F.sum("rows").alias("rows"), F.count("key").alias("keys"), zero(F.sum(F.when(F.col("key").isNull(), F.col("rows")))).alias("null_rows"),
        F.count_if(lost).alias("orphan_keys"), zero(F.sum(F.when(lost, F.col("rows")))).alias("orphan_rows"),
    )
    fine = (F.col("null_rows") == 0) & (F.col("orphan_keys") == 0)
    return out.withColumns({"covered": T.percent(F.col("rows") - F.col("null_rows") - F.col("orphan_rows"), F.col("rows")), "status": F.when(fine, "APROVADO").otherwise("REPROVADO")})


def first_known(df: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key with the first known value of every column, in the given order of rows; null where
    none is known. All columns in one aggregate; a key with any number of rows is combined in each task."""
    at = F.struct(*order)
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def merged_dimension(last: DataFrame, now: DataFrame, natural: str, key: str, loaded: Column) -> DataFrame:
    """The dimension after a load, overwriting changed attributes (no versions are kept).

    last: the dimension so far (key, natural, attributes, attribute_hash, loaded_at, updated_at); now:
    natural, attributes, attribute_hash. Rows with an unchanged hash stay as they are; changed ones take
    the new attributes, keep key and load time and are updated at `loaded`; new ones get the keys after
    the last one, in the order of the natural key; what the load does not have stays. change: SEM_MUDANCA,
    ATUALIZADO, NOVO or AUSENTE.
    """
    attributes = [c for c in now.columns if c not in (natural, "attribute_hash")]
    top = last.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))  # one row
    fresh = now.join(last.select(natural), natural, "left_anti")
    keys = ordering.running(fresh.select(natural), [F.col(natural)], {}, rank="__rank")
    added = fresh.join(keys, natural).crossJoin(F.broadcast(top)).select(
        (F.col("__rank") + F.col("__top")).alias(key), natural, *attributes, "attribute_hash", loaded.alias("loaded_at"), loaded.alias("updated_at"), F.lit("NOVO").alias("change"))
    new = now.select(F.col(natural), *[F.col(c).alias(f"__{c}") for c in (*attributes, "attribute_hash")])
    both = last.join(new, natural, "left")
    absent, same = F.col("__attribute_hash").isNull(), F.col("__attribute_hash") == F.col("attribute_hash")
    change = F.when(absent, "AUSENTE").when(same, "SEM_MUDANCA").otherwise("ATUALIZADO")
    moved = change == "ATUALIZADO"
    taken = [F.when(moved, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in (*attributes, "attribute_hash")]
    stayed = both.select(key, natural, *taken, "loaded_at", F.when(moved, loaded).otherwise(F.col("updated_at")).alias("updated_at"), change.alias("change"))
    return stayed.unionByName(added)


def group_members(df: DataFrame, keys: Sequence[str], row_id: str, least: int = 2) -> DataFrame:
    """group_no, keys, row_id, group_size, place: all rows of the groups that have `least` rows or more.

    Groups are numbered 1, 2, ... in the order of their keys (nulls first), in two phases over the
    grouped keys. Members are rows, never lists; a place within a group is the row's rank by `row_id`.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("group_size")).filter(F.col("group_size") >= least)
    numbered = ordering.running(sizes, [F.col(k).asc_nulls_first() for k in keys], {}, rank="group_no")
    same = [df[k].eqNullSafe(numbered[k]) for k in keys]
    members = df.select(*keys, row_id).join(numbered, same).select("group_no", *[df[k] for k in keys], row_id, "group_size")
    # ranks over all members by (group, row), then from the group's first one: a group of any size is no single task
    placed = ordering.running(members, [F.col("group_no"), F.col(row_id)], {}, rank="__at")
    first = placed.groupBy("group_no").agg(F.min("__at").alias("__first"))
    return placed.join(first, "group_no").withColumn("place", F.col("__at") - F.col("__first") + 1).drop("__at", "__first")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of which one table holds more than the other, with `surplus`: how many more `a` has
    (below zero: `b`). One union of signed rows and one grouping; repeated rows count."""
    signed = a.withColumn("surplus", F.lit(1)).unionByName(b.select(*a.columns).withColumn("surplus", F.lit(-1)))
    return signed.groupBy(*a.columns).agg(F.sum("surplus").alias("surplus")).filter("surplus <> 0")


def ordered_fingerprint(df: DataFrame, order: Sequence[Column], fan: int = 1024, most: int | None = None) -> DataFrame:
    """One row: rows, levels, fingerprint of df in the given (unique) order.

    A hash tree: digests of rows in runs of `fan` ranks, digests of these in runs of `fan`, until one is
    left. Runs go by rank, so the result depends on order and content only, never on partitions; no task
    holds more than a run's digests. An empty table has the digest of the empty text. most: levels after which
    the greatest digest stands for what is left; a change elsewhere is then not seen.
    """
    digest = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    level = ordering.running(df.select(*[c.alias(f"__o{i}") for i, c in enumerate(order)], digest.alias("d")), [F.col(f"__o{i}") for i in range(len(order))], {}, rank="at").select("at", "d")
    rows, levels = level.agg(F.count("*")).first()[0], 0
    size = rows
    while (size > 1 or (levels == 0 and rows)) and levels != most:
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), "")
        level = level.groupBy(F.floor((F.col("at") - 1) / fan).alias("run")).agg(F.sha2(run, 256).alias("d")).select((F.col("run") + 1).alias("at"), "d")
        size, levels = -(-size // fan), levels + 1
    return level.agg(F.lit(rows).cast("bigint").alias("rows"), F.lit(levels).alias("levels"), F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("fingerprint"))


def recalculated(orders: DataFrame, informed: DataFrame, tolerance: Mapping[str, float]) -> DataFrame:
    """Per client the figures made from its orders beside the informed ones (their mode, ties to the smallest).

    orders: client_id, order_date, value (one row an order). informed: client_id and a column for each name in
    `tolerance` among mean_interval and mean_ticket, plus lifecycle; any number of rows a client. For
    each name: <name>, <name>_informed, <name>_difference, <name>_diverges. Clients are grouped once for
    what is made and once for all modes together.
    """
    w = Window.partitionBy("client_id").orderBy("order_date")
    days = orders.groupBy("client_id", "order_date").agg(F.count("*").alias("orders"), F.sum("value").alias("value")).withColumn("gap", F.datediff("order_date", F.lag("order_date").over(w)))
    last = days.agg(F.max("order_date").alias("reference"))  # one row
    made = days.groupBy("client_id").agg(
        F.sum("orders").alias("orders"), F.count("*").alias("purchase_days"), F.min("order_date").alias("first_purchase"), F.max("order_date").alias("last_purchase"),
        F.avg("gap").alias("mean_interval"), T.ratio(F.sum("value"), F.sum("orders")).alias("mean_ticket"), F.sum("value").cast("double").alias("total"))
    names = [*tolerance, "lifecycle"]
    told = informed.select("client_id", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in names])).alias("x")).select("client_id", "x.*")
    counted = told.filter("v IS NOT NULL").groupBy("client_id", "name", "v").agg(F.count("*").alias("n"))
    number = F.col("v").try_cast("double")
    mode = lambda c: F.min_by("v", F.when(F.col("name") == c, F.struct(-F.col("n"), number, F.col("v"))))
    modes = counted.groupBy("client_id").agg(*[mode(c).alias(f"{c}_informed") for c in names], F.count_if(F.col("name") == "lifecycle").alias("lifecycles"))
    out = made.crossJoin(F.broadcast(last)).join(modes, "client_id", "left")
    for c, most in tolerance.items():
        out = out.withColumn(f"{c}_informed", F.col(f"{c}_informed").cast("double")).withColumn(f"{c}_difference", F.col(f"{c}_informed") - F.col(c))
        out = out.withColumn(f"{c}_diverges", F.abs(f"{c}_difference") > most)
    recency = F.datediff("reference", "last_purchase")
    return out.withColumn("recency", recency).withColumn("recency_ratio", F.when(F.col("mean_interval") > 0, recency / F.col("mean_interval"))).drop("reference")


def grouped_quantiles(df: DataFrame, key: str, values: Sequence[str], at: Mapping[str, float]) -> DataFrame:
    """key, variable, n and the quantiles of each variable within each key, in long form: all variables
    are put in order together, by ranges, so no key and no variable is a task of its own."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in values]))
    known = F.coalesce(F.col(key), F.lit("<NULO>")).alias(key)
    counted = df.select(known, each.alias("x")).select(key, "x.*").filter("value IS NOT NULL").groupBy(key, "variable", "value").agg(F.count("*").alias("n"))
    sizes = counted.groupBy(key, "variable").agg(F.sum("n").alias("n"))
    return ordering.quantiles(counted, [key, "variable"], "value", "n", dict(at)).join(sizes, [key, "variable"])
