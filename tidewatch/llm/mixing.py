"""Mixing sources to target weights, with DataFrame operations only.

Every source is cut into blocks of about ``BLOCK`` words by a hash of the documents, so that a block's number is its
place in a random permutation. A source's target is met by whole passes over it and, of one more pass, the blocks up to
the target, the last of them up to a document. A splitting tree then halves the shards again and again: at each node the
left half draws, for one source after the other, a hypergeometric share of the blocks that the node has, which is a
multivariate hypergeometric draw. A shard so gets exact quotas of each source's blocks, takes disjoint ones in permuted
order, and shuffles within itself.

Rows with equal doc_id, source and size are one unit and are taken equally often. A null text has size 0 and a null source is a
source of its own, the last one. A source without words has target 0; an empty table gives an empty result. Other columns
are ignored. Equal tables give equal results, whatever the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.plans.lineage import stage

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 65_536
SHARD = 1 << 22
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: a prime above any number of blocks, so that multiplying by it permutes them.
STRIDE = (1 << 31) - 1


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: its rank, size and target. Targets stop at ``most`` times the size; the rest is shared by weight anew.

    Ordered by the size a unit of weight has, the sources that stop come first; from the first that doesn't, all get the
    same words a unit of weight. The windows hold one row a source.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = one.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))) + 1)
    cap = (F.col("source_size") * most).cast("double")
    line = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    shared = (
        ordered.withColumn("weight", weight)
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("total", total.cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(cap).over(line), F.lit(0.0))) / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(line), F.lit(0.0))))
        .withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(Window.partitionBy()))
    )
    target = F.when(F.col("first").isNull() | (F.col("ratio") < F.col("first.ratio")), cap).otherwise(F.least(cap, F.col("weight") * F.col("first.level")))
    return shared.select("source", "rank", "source_size", target.alias("target"))


def draws(sized: DataFrame, goals: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Each unit's block and copies, and the number of its source's blocks and of whole passes."""
    units = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    blocks = F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    dealt = (
        units.join(goals, units["source"].eqNullSafe(goals["source"])).drop(goals["source"])
        .withColumn("blocks", blocks)
        .withColumn("passes", passes)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), "blocks"))
        .withColumn("words", F.col("size") * F.col("rows"))
    )
    held = dealt.groupBy("rank", "block").agg(F.sum("words").alias("held"))
    before = held.withColumn("before", F.sum("held").over(Window.partitionBy("rank").orderBy("block")) - F.col("held"))
    placed = dealt.join(before, ["rank", "block"])
    cut = placed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("held") > F.col("rest")))
    # The last block of a source, one row: longest first, every document that still fits, and the shortest of those that
    # don't if it is nearer to the target than none. It has at most about ``block`` units, as those without words aren't among them.
    unit = F.struct((-F.col("words")).alias("less"), F.xxhash64(F.lit(seed + 1), "doc_id", "size").alias("mixed"), "doc_id", "size", "source")
    held_docs = F.array_sort(F.collect_list(unit))
    start = F.struct(F.col("rest").alias("left"), F.array().cast("array<long>").alias("took"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("past"))

    def fit(a: Column, x: Column) -> Column:
        fits = a.left + x.less >= 0
        return F.struct(F.when(fits, a.left + x.less).otherwise(a.left).alias("left"), F.when(fits, F.array_append(a.took, a.n)).otherwise(a.took).alias("took"), (a.n + 1).alias("n"), F.when(fits, a.past).otherwise(a.n).alias("past"))

    def end(a: Column) -> Column:
        nearer = (a.past >= 0) & (-F.get("units", a.past.cast("int"))["less"] < 2 * a.left)
        return F.when(nearer, F.array_append(a.took, a.past)).otherwise(a.took)

    last = cut.where("words > 0").groupBy("rank", "block").agg(held_docs.alias("units"), F.min(F.col("rest") - F.col("before")).alias("rest"))
    last = last.withColumn("took", F.aggregate("units", start, fit, end))
    last = last.select("rank", F.explode(F.transform("took", lambda i: F.get("units", i.cast("int")))).alias("u"))
    last = last.select(F.col("rank").alias("_rank"), F.col("u.doc_id").alias("_doc"), F.col("u.source").alias("_src"), F.col("u.size").alias("_size"))
    same = (F.col("rank") == F.col("_rank")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col("size") == F.col("_size"))
    edge = cut.join(last, same, "left").withColumn("more", F.col("_rank").isNotNull().cast("long")).drop("_rank", "_doc", "_src", "_size")
    clear = placed.where(~((F.col("before") < F.col("rest")) & (F.col("before") + F.col("held") > F.col("rest"))))
    clear = clear.withColumn("more", (F.col("before") + F.col("held") <= F.col("rest")).cast("long"))
    both = clear.unionByName(edge)
    return both.withColumn("copies", F.col("passes") + F.when(F.col("words") > 0, F.col("more")).otherwise(0))


def hypergeometric(total: Column, marked: Column, drawn: Column, chance: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``marked``, by inversion at ``chance`` (0 to 1).

    Weights follow from each other by the ratio of neighbours; twelve standard deviations round the mode are summed,
    beyond which lies less than the rounding of a double.
    """
    total, marked, drawn = (x.cast("double") for x in (total, marked, drawn))
    share = marked / F.greatest(total, F.lit(1.0))
    spread = F.sqrt(F.greatest(drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1.0)), F.lit(0.0)))
    mode, reach = F.floor((drawn + 1) * (marked + 1) / (total + 2)), F.ceil(spread * 12) + 10
    low = F.greatest(F.lit(0), drawn.cast("long") + marked.cast("long") - total.cast("long"), mode - reach)
    high = F.least(drawn.cast("long"), marked.cast("long"), mode + reach)
    steps = F.sequence(low.cast("long"), F.greatest(low, high).cast("long"))

    def after(p: Column, k: Column) -> Column:
        k = k.cast("double")
        return F.greatest(p * (marked - k) * (drawn - k) / F.greatest((k + 1) * (total - marked - drawn + k + 1), F.lit(1.0)), F.lit(0.0))

    mass = F.aggregate(steps, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("z")), lambda a, k: F.struct(after(a.p, k).alias("p"), (a.z + a.p).alias("z")), lambda a: a.z)
    return F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("z"), F.lit(-1).cast("long").alias("at")),
        lambda a, k: F.struct(after(a.p, k).alias("p"), (a.z + a.p).alias("z"), F.when((a["at"] < 0) & (a.z + a.p >= chance * mass), k).otherwise(a["at"]).alias("at")),
        lambda a: F.when(a["at"] < 0, F.greatest(low, high).cast("long")).otherwise(a["at"]),
    )


def _halved(nodes: DataFrame, level: int, seed: int) -> DataFrame:
    """Two children of each node; the left one draws from each source after the other."""
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)

    def share(a: Column, x: Column) -> Column:
        chance = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), F.size(a.got)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        took = hypergeometric(a.total, x, a.draw, chance)
        return F.struct((a.total - x).alias("total"), (a.draw - took).alias("draw"), F.concat(a.got, F.array(took)).alias("got"))

    start = F.struct(total.alias("total"), F.floor(total / 2).cast("long").alias("draw"), F.array().cast("array<long>").alias("got"))
    halves = nodes.withColumn("left", F.aggregate("n", start, share, lambda a: a.got))
    right = F.zip_with("n", "left", lambda a, b: a - b)
    children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("n")))
    return halves.select(F.explode(children).alias("c")).select("c.node", "c.n")


def quotas(counts: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """counts: rank, n (blocks drawn of a source, every rank from 0 once). Returns shard, rank, n: each shard's blocks of each source.

    A node is one row that has a count for each source.
    """
    nodes = counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n"))), lambda x: x.n).alias("n")).select(F.lit(0).cast("long").alias("node"), "n")
    for level in range(levels):
        nodes = _halved(nodes, level, seed)
    return nodes.select(F.col("node").alias("shard"), F.posexplode("n").alias("rank", "n"))


def mix(sized: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(units with their copies, one row for each copy: doc_id, source, size, copy, shard, place).

    ``sized`` is read several times: hand in a stored table.
    """
    goals = stage(targets(sized))
    drawn = stage(draws(sized, goals, block, seed))
    whole = F.max("passes") * F.max("blocks") + F.coalesce(F.max(F.when(F.col("more") > 0, F.col("block") + 1)), F.lit(0))
    counts = goals.select("rank").join(drawn.groupBy("rank").agg(whole.alias("n")), "rank", "left").fillna(0, ["n"])
    counts = stage(counts.withColumn("n", F.col("n").cast("long")))
    words = goals.agg(F.sum("target")).first()[0] or 0.0
    levels = max(0, int(-(-words // shard)) - 1).bit_length()
    quota = quotas(counts, levels, seed)
    upto = F.sum("n").over(Window.partitionBy("rank").orderBy("shard"))
    spans = quota.withColumn("end", upto).where("n > 0").select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("spot"))
    copies = drawn.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    copies = copies.join(counts.withColumnRenamed("n", "drawn"), "rank")
    unit = F.col("copy") * F.col("blocks") + F.col("block")
    placed = copies.withColumn("spot", F.pmod(unit * STRIDE + F.col("rank"), F.greatest("drawn", F.lit(1)))).join(spans, ["rank", "spot"])
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "doc_id", "copy"), "doc_id", "source", "size", "copy")) - 1
    return drawn, placed.select("doc_id", "source", "size", "rows", "copy", "shard", place.cast("long").alias("place"))


def _counted(copies: DataFrame) -> DataFrame:
    """How often each unit is drawn."""
    count = copies.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_n"))
    return count.select(F.col("doc_id").alias("_doc2"), F.col("source").alias("_src2"), F.col("size").alias("_size2"), "_n")


def taken(sized: DataFrame) -> DataFrame:
    """Per row of ``sized``: doc_id, size, source_size, target, taken."""
    drawn, copies = mix(sized)
    count = _counted(copies)
    same = F.col("doc_id").eqNullSafe(F.col("_doc2")) & F.col("source").eqNullSafe(F.col("_src2")) & (F.col("size") == F.col("_size2"))
    taken = (F.col("size") * F.coalesce("_n", F.lit(0))).cast("long").alias("taken")
    units = drawn.join(count, same, "left").select("doc_id", "size", "source_size", "target", taken, "rows")
    return units.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("_copy", "rows")


def repeat(docs: DataFrame) -> DataFrame:
    """The mixed documents: each as often as it is drawn, with the columns of ``docs``."""
    names = docs.columns
    keyed = docs.select(*names, *(c.alias(f"_{k}") for c, k in zip((F.col("doc_id").cast("long"), F.col("source").cast("string"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")), ("doc", "src", "size"))))
    drawn, copies = mix(stage(sizes(docs)))
    count = _counted(copies)
    same = F.col("_doc").eqNullSafe(F.col("_doc2")) & F.col("_src").eqNullSafe(F.col("_src2")) & (F.col("_size") == F.col("_size2"))
    return keyed.join(count, same).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select(*names)
