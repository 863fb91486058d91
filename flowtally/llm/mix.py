"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: sources share ``budget`` (150 %) of all words by weight; a target stops at
   ``epochs`` (2) times its source's size and the excess is shared again by weight.  The
   fixed point is found at once: in ascending order of cap / weight, a source is capped
   while the level that the rest would reach is at or above its ratio.
2. Blocks: the words bought are blocks of ``block`` words.  Seats go to the highest
   quotients target / (2j + 1).  Each source first gets its rounded quota; this is the
   apportionment for the divisor ``block``, and only the seats by which the sum is off
   are settled by comparing quotients.
3. Shards: each source's words are dealt into shards of about ``shard_words`` words by
   the hash of the row.  A source's seats go down a tree over its shards, each node's
   seats to its at most ``FAN`` children by the same rule, so no step compares more than
   ``FAN`` rows however large a source is.
4. Selection: a shard of m words has n = round(m / block) equal blocks; k seats are
   k div n whole passes and k mod n blocks spaced evenly from a seeded start.  What a
   document gives follows from where its words lie, so no block is ever a row.

Cases: null or blank texts have size 0 and give 0 words; a null source is a source of
its own, last in order; repeated rows take places of their own; an empty table gives an
empty result; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtally.llm.common import fresh, n_words, store, with_row_ids

WEIGHTS, BUDGET, EPOCHS, BLOCK, SHARD_WORDS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 16, 1 << 14, 17
FAN_BITS = 6
FAN = 1 << FAN_BITS


def water_levels(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS) -> DataFrame:
    """Adds ``target`` to one row per source (columns source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    everything = Window.partitionBy()
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, onward = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("all_words", F.sum("source_size").over(everything) * F.lit(float(budget)))
    ranked = ranked.withColumn("level", (F.col("all_words") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(onward))
    capped = F.col("level") * F.col("weight") >= F.col("cap")
    # The first source that is not capped sets the level of all that follow.
    level = F.first(F.when(~capped, F.col("level")), ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("final", level).select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def apportion(claims: DataFrame, within: list[str], order: list[str], votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: the integer seats of each row under Sainte-Lague, in each group ``within``.

    ``claims`` holds votes (double) and the seats of its group (long, equal in a group).
    With the group's mean price per seat as divisor every row gets its rounded quota; by
    as many seats as their sum is off, the highest next quotients gain or the lowest held
    quotients lose one; of equal quotients the first in ``order`` keeps or gains.  With n rows and d seats to settle, a row with the
    share v of all votes moves by at most v * (d + n) + 1 seats, so about d + 3 n quotients
    are compared.
    """
    group = Window.partitionBy(*within)
    start = claims.withColumn("_all", F.sum(votes).over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    start = start.withColumn("_fair", F.when(F.col("_all") > 0, F.col(votes) * F.col(seats) / F.col("_all")).otherwise(F.lit(0.0)))
    start = start.withColumn("_base", F.floor(F.col("_fair") + 0.5).cast("long"))
    start = start.withColumn("_off", (F.when(F.col("_all") > 0, F.col(seats)).otherwise(F.lit(0)) - F.sum("_base").over(group)).cast("long"))
    start = store(start, "quotas")
    most = F.least(F.abs("_off"), F.ceil(F.try_divide(F.col(votes) * (F.abs("_off") + F.col("_n")), F.col("_all"))).cast("long") + 1)
    held = F.when(F.col("_off") > 0, F.col("_base") + F.col("_step") - 1).otherwise(F.col("_base") - F.col("_step"))
    keys = [*within, *order]
    wanted = start.where("_off <> 0").select(*keys, votes, "_off", "_base", F.explode(F.sequence(F.lit(1).cast("long"), most)).alias("_step")).withColumn("_j", held).where("_j >= 0")
    falling = Window.partitionBy(*within).orderBy(-F.col(votes) / (2 * F.col("_j") + 1), *[F.col(c).asc_nulls_last() for c in order], "_j")
    ranked = wanted.withColumn("_rank", F.row_number().over(falling)).withColumn("_last", F.count(F.lit(1)).over(group))
    changed = ranked.where(F.when(F.col("_off") > 0, F.col("_rank") <= F.col("_off")).otherwise(F.col("_rank") > F.col("_last") + F.col("_off")))
    changed = changed.groupBy(*keys).agg(F.sum(F.signum("_off")).cast("long").alias("_plus"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
    joined = start.alias("l").join(changed.alias("r"), same, "left")
    return joined.select(*[F.col(f"l.{c}") for c in claims.columns], (F.col("l._base") + F.coalesce(F.col("r._plus"), F.lit(0))).alias("quota"))


def shard_quotas(loads: DataFrame) -> DataFrame:
    """``loads`` (source, shard, words, source_quota) with ``quota``: the source's seats handed down a tree over its shards.

    A node's children are the shards (or nodes) whose numbers agree but for the last ``FAN_BITS`` bits.
    """
    loads = store(loads.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "loads")
    last, level, have = loads.agg(F.max("shard")).first()[0] or 0, 0, None
    while last >> (FAN_BITS * (level + 1)):
        level += 1
    for k in range(level, -1, -1):
        node = F.shiftright("shard", FAN_BITS * k)
        claims = loads.groupBy("src", node.alias("node")).agg(F.max("source").alias("source"), F.sum("words").alias("words"), F.max("source_quota").alias("seats")).withColumn("parent", F.shiftright("node", FAN_BITS))
        if have is not None:
            claims = claims.drop("seats").join(have.select("src", F.col("node").alias("parent"), F.col("quota").alias("seats")), ["src", "parent"])
        have = apportion(claims, ["src", "parent"], ["node"], "words", "seats")
    return have.select("source", F.col("node").alias("shard"), "words", "quota")


def _given(point: Column) -> Column:
    """Words of the partial pass that lie before ``point`` on the shard's axis of words."""
    block = F.least(F.floor(point * F.col("n") / F.col("words")), F.col("n") - 1).cast("long")
    edge = lambda b: b * F.col("words") / F.col("n")
    chosen = lambda b: F.floor((b * F.col("part") + F.col("phase")) / F.col("n"))
    full = chosen(block) * F.col("words") / F.col("n")
    return F.when(F.col("part") > 0, full + F.when(chosen(block + 1) > chosen(block), point - edge(block)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))


def take(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """``rows`` (stored: rid, key, source, size) with source_size, target, taken and copies.

    ``taken`` counts words; ``copies`` counts whole documents, with the document taken in
    a pass if the block that holds its middle word is.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = store(water_levels(sizes, weights, budget, epochs).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")).withColumn("all", F.lit(1)), "targets")
    quotas = apportion(targets, ["all"], ["source"], "target", "seats").select(F.col("source").alias("_s"), "source_size", "target", "shards", F.col("quota").alias("source_quota"))
    dealt = rows.join(quotas, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("shard", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("shards")))
    loads = dealt.groupBy("source", "shard").agg(F.sum("size").cast("double").alias("words"), F.max("source_quota").alias("source_quota"))
    shards = shard_quotas(loads).select(F.col("source").alias("_s"), F.col("shard").alias("_shard"), "words", "quota", F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("long").alias("n"))
    shards = shards.withColumn("seats", F.least(F.col("quota"), (F.col("n") * F.lit(epochs)).cast("long")))
    shards = shards.select("_s", "_shard", "words", "n", F.floor(F.col("seats") / F.col("n")).alias("passes"), F.pmod("seats", "n").alias("part"), F.pmod(F.xxhash64("_s", "_shard", F.lit(seed + 1)), F.col("n")).alias("phase"))
    axis = Window.partitionBy("source", "shard").orderBy(F.xxhash64("key", F.lit(seed + 2)), "key", "rid").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(axis)).withColumn("start", F.col("end") - F.col("size"))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_shard")))
    part = F.round(_given(F.col("end"))) - F.round(_given(F.col("start")))
    taken = F.when(F.col("size") > 0, F.least(F.col("passes") * F.col("size") + part, F.col("size") * F.lit(epochs))).otherwise(F.lit(0)).cast("long")
    middle = (F.col("start") + F.floor(F.col("size") / 2)).cast("double")
    hit = F.least(F.floor(middle * F.col("n") / F.col("words")), F.col("n") - 1)
    chosen = lambda b: F.floor((b * F.col("part") + F.col("phase")) / F.col("n"))
    copies = F.when(F.col("size") > 0, F.col("passes") + (chosen(hit + 1) - chosen(hit))).otherwise(F.lit(0)).cast("int")
    return placed.select("rid", "source", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    key = F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), key.alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row."""
    rows = store(_sized(docs, doc_id, text, source), "sizes")
    # Rows of one size whose key repeats are equal in all that counts, so their order does not matter.
    got = take(rows.withColumn("rid", F.struct("rid", "doc_id")).drop("doc_id"), **options)
    return got.select(F.col("rid.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` in the mix, each as often as it is taken."""
    copies, taken_id = fresh(docs, "_copies", "_taken_row")
    rows, rid = with_row_ids(docs, "docs")
    sized = store(rows.select(F.col(rid).alias("rid"), F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size")), "sizes")
    got = take(sized, **options).where("copies > 0").select(F.col("rid").alias(taken_id), F.col("copies").alias(copies))
    return rows.join(got, F.col(rid) == F.col(taken_id)).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
