"""Seeded choice of replacements without a sequential generator.

A draw depends on the seed and the item's own key alone: the first 13 hex digits
of an md5.  Items meet the pool through an equi-join on the drawn place, so
neither side is enumerated against the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, broadcast_if_small

#: Hex digits of a draw, and the number of draws they tell apart.
DIGITS, SPAN = 13, 16**13
#: Buckets of the cumulative weights.
BUCKETS = 4096


def draw(*parts: Column) -> Column:
    """A bigint in [0, 16^13) out of the parts' text."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("bigint")


def numbered(pool: DataFrame, by: list[str], lemma: str = "lemma") -> DataFrame:
    """The pool with each lemma's place (from 0, by name) and the size of its group."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    return pool.withColumns({"pos": F.row_number().over(w.orderBy(lemma)) - 1, "size": F.count("*").over(w)})


def pick_uniform(items: DataFrame, pool: DataFrame, by: list[str], key: list[str], seed: int, tries: int = 1) -> DataFrame:
    """Each item with ``tries`` drawn lemmas of its group's pool, ``attempt`` from 0.

    ``by`` are columns of both sides that name the pool (none: one pool); items
    without a pool drop out.  The caller keeps the first attempt that fits.
    """
    placed = numbered(pool, by)
    more = [c for c in pool.columns if c not in (*by, "lemma")]
    sizes = placed.select(*by, "size").distinct()
    if by:
        known = items.join(broadcast_if_small(sizes), by)
    else:  # one row: the size of the only pool
        n = sizes.first()
        if n is None:
            return items.withColumns({"attempt": F.lit(0), "lemma": F.lit(None).cast("string")}).limit(0)
        known = items.withColumn("size", F.lit(n["size"]))
    tried = known.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    at = F.pmod(draw(F.lit(seed), *[F.col(k) for k in key], F.col("attempt")), F.col("size").cast("bigint")).cast("int")
    drawn = tried.withColumn("pos", at).drop("size")
    return drawn.join(broadcast_if_small(placed.select(*by, "pos", "lemma", *more)), [*by, "pos"]).drop("pos")


def whole_pool(items: DataFrame, pool: DataFrame, by: list[str], key: list[str], seed: int) -> DataFrame:
    """Each item with ``lemmas``: its group's whole pool, with its other columns, in an order of the item's own.

    For the few items that no drawn lemma fits; the pool stays one array per
    group, so that items aren't multiplied by lemmas.
    """
    few = pool.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    more = [c for c in pool.columns if c not in (*by, "lemma")]
    groups = pool.groupBy(*by).agg(F.collect_list(F.struct("lemma", *more)).alias("lemmas"))
    place = lambda x: F.struct(draw(F.lit(seed), *[F.col(k) for k in key], x["lemma"]), x["lemma"])
    before = lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0)
    got = items.join(F.broadcast(groups) if few else groups, by)
    return got.withColumn("lemmas", F.array_sort("lemmas", before))


#: Parts of a weight that integer intervals tell apart, so that no lemma's share is rounded away.
PARTS = 1 << 20


def _intervals(pool: DataFrame, temperature: float) -> tuple[DataFrame, int]:
    """Each lemma's half-open interval of whole numbers, as long as its weight, and their total.

    The running sum goes over buckets of lemmas first, so no task holds the pool.
    """
    w = F.floor(F.greatest(F.pow(F.lit(10.0), F.col("zipf") / temperature), F.lit(0.001)) * PARTS).cast("decimal(38,0)")
    parts = pool.groupBy("lemma").agg(F.max("zipf").alias("zipf")).withColumns({"w": w, "_p": F.substring("lemma", 1, 2)})
    sums = parts.groupBy("_p").agg(F.sum("w").cast("decimal(38,0)").alias("s"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per pair of first letters
    starts = sums.select("_p", F.coalesce(F.sum("s").over(before), F.lit(0)).cast("decimal(38,0)").alias("base"))
    within = Window.partitionBy("_p").orderBy("lemma").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = (F.col("base") + F.sum("w").over(within)).cast("decimal(38,0)")
    got = parts.join(starts, "_p").withColumn("hi", hi).withColumn("lo", (F.col("hi") - F.col("w")).cast("decimal(38,0)"))
    total = sums.agg(F.sum("s")).first()[0]
    return got.select("lemma", "lo", "hi"), int(total or 0)


def pick_weighted(items: DataFrame, pool: DataFrame, key: list[str], seed: int, temperature: float = 1.0, draws: int | None = None) -> DataFrame:
    """Lemmas per item, drawn in proportion to ``10^(zipf / temperature)``; ``draws``: that many, ``attempt`` from 0.

    Weights are whole numbers; their running sums are cut into buckets, an item
    joins its bucket and keeps the lemma whose interval holds its draw.  An
    empty pool gives no rows.
    """
    cdf, total = _intervals(pool, temperature)
    if not total:
        return items.withColumn("lemma", F.lit(None).cast("string")).limit(0)
    size = -(-total // BUCKETS)
    bucket = lambda c: F.floor(c / F.lit(size).cast("decimal(38,0)")).cast("bigint")
    spread = cdf.select("lemma", "lo", "hi", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi") - 1))).alias("_b"))
    tried = items if draws is None else items.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = draw(F.lit(seed), *[F.col(k) for k in key], *([F.col("attempt")] if draws is not None else []))
    # the draw's share of the total, rounded down, in whole numbers
    at = F.floor(u.cast("decimal(18,0)") * F.lit(total).cast("decimal(20,0)") / F.lit(SPAN).cast("decimal(18,0)")).cast("decimal(38,0)")
    drawn = tried.withColumn("_u", at).withColumn("_b", bucket(F.col("_u")))
    hit = drawn.join(broadcast_if_small(spread), "_b").where((F.col("lo") <= F.col("_u")) & (F.col("_u") < F.col("hi")))
    return hit.drop("_b", "_u", "lo", "hi")


def weighted_order(items: DataFrame, pool: DataFrame, key: list[str], seed: int, most: int = 64, temperature: float = 1.0) -> DataFrame:
    """``lemmas``: each item's lemmas in the order of weighted draws with replacement, each once.

    At most ``most`` draws; a pool that isn't larger is drawn as often as it has
    lemmas, and those never drawn follow in order of name.
    """
    names = [r["lemma"] for r in pool.select("lemma").distinct().orderBy("lemma").limit(most + 1).collect()]
    draws = min(most, len(names))
    if not draws:
        return items.withColumn("lemmas", F.array().cast("array<string>")).limit(0)
    drawn = pick_weighted(items, pool, key, seed, temperature, draws)
    first = drawn.groupBy(*key, "lemma").agg(F.min("attempt").alias("attempt"))
    got = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("attempt", "lemma"))).alias("_d"))
    order = F.transform("_d", lambda x: x["lemma"])
    if len(names) <= most:
        order = F.concat(order, F.array_except(F.array(*map(F.lit, names)), order))
    return got.select(*key, order.alias("lemmas"))


def weighted_permutation(items: DataFrame, pool: DataFrame, by: list[str], key: list[str], seed: int, temperature: float = 1.0) -> DataFrame:
    """``lemmas``: each item's whole group pool, weighted and without replacement.

    Sorted by ``-ln(u) / w`` (Efraimidis and Spirakis 2006), u drawn from the
    item and the lemma.  The pool stays one array per group; for the items
    whose slots no drawn lemma fits.
    """
    w = F.greatest(F.pow(F.lit(10.0), F.col("zipf") / temperature), F.lit(0.001))
    groups = pool.withColumn("w", w).groupBy(*by).agg(F.collect_list(F.struct("lemma", "w")).alias("_pool"))
    few = pool.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    got = items.join(F.broadcast(groups) if few else groups, by) if by else items.crossJoin(F.broadcast(groups))  # one row
    u = lambda x: (draw(F.lit(seed), *[F.col(k) for k in key], x["lemma"]) + 1) / F.lit(float(SPAN + 1))
    keyed = F.transform("_pool", lambda x: F.struct((-F.log(u(x)) / x["w"]).alias("k"), x["lemma"].alias("lemma")))
    return got.select(*items.columns, F.transform(F.array_sort(keyed), lambda x: x["lemma"]).alias("lemmas"))


def seeded_order(df: DataFrame, key: list[str], seed: int, limit: int) -> DataFrame:
    """A seeded sample of at most ``limit`` rows: those with the least draws."""
    return df.withColumn("_u", draw(F.lit(seed), *[F.col(k) for k in key])).orderBy("_u", *key).limit(limit).drop("_u")
