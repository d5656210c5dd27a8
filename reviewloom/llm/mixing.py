"""Mixing sources to target weights by hierarchical budgets (native).

Leaves of a tree (by default domain, language, source) hold the documents. A token
budget goes down the tree: a node divides its budget among its children by weight,
and no child gets more than its subtree can give, which is its tokens times
``epochs``. What a child cannot use goes to its siblings first; only if all of them
together fall short does their parent take less, which then goes to the parent's
siblings. With children ordered by capacity over weight that is one expression per
level: the water level is the largest (budget - capacity before) / (weight from here
on), and a child gets the smaller of its capacity and weight times level.

Each epoch orders a leaf's documents by a seeded digest. A leaf's selection is the
first part of its epochs laid end to end. Running totals are made in two steps, per
slice of digests and inside slices, and a leaf gets slices in proportion to its
rows, so a leaf with a third of all rows is spread like any other part. Rows that repeat an
id and its length are one row with their number until the end.

Defined cases: nulls in tree columns count as empty names; a name without a weight
gets ``DEFAULT_WEIGHT`` and a weight of 0 takes nothing; null and empty texts have no
tokens and come along where their place is reached; a leaf without tokens gives
nothing; repeated rows are documents of their own and ties are ordered by id and
tokens. An empty table gives an empty table. Other columns are not read by
``select_prefixes``; ``mixed`` returns them all unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.session import stored

TREE = ("domain", "lang", "source")
DEFAULT_WEIGHT = 1
#: Slices of digests per shuffle partition.
SLICES = 8


def domain_of(source: Column) -> Column:
    """The domain a source belongs to: by the number in its name, modulo four."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})", 1)
    return F.when(number != "", F.concat(F.lit("domain"), F.pmod(number.cast("long"), F.lit(4)))).otherwise("domain")


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _digest(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def _weight(column: str, weights: dict[str, int]) -> Column:
    """The given weight of a name; ``weights`` is configuration, not data."""
    known = [x for name, weight in weights.items() for x in (F.lit(name), F.lit(float(weight)))]
    if not known:
        return F.lit(float(DEFAULT_WEIGHT))
    return F.coalesce(F.create_map(*known)[F.col(column)], F.lit(float(DEFAULT_WEIGHT)))


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]], epochs: int,
            tree: tuple[str, ...] = TREE) -> DataFrame:
    """The budget (a fraction of a token may remain) of each leaf; ``leaves`` has the tree columns and tokens.

    ``total`` may use ``all_tokens``, the tokens of all leaves.
    """
    # tables of names are written, so that each level reads the one above and does not compute it again
    able = stored(leaves.withColumns({"capacity": F.col("tokens") * epochs, "root": F.lit(0)}), "leaves")
    sums = [F.sum("capacity").cast("double").alias("capacity"), F.sum("tokens").alias("all_tokens")]
    parent = stored(able.groupBy("root").agg(*sums).select(
        "root", F.least(total.cast("double"), F.col("capacity")).alias("budget")), "root")
    for depth, name in enumerate(tree):
        above, here = ["root", *tree[:depth]], ["root", *tree[:depth + 1]]
        nodes = able.groupBy(*here).agg(*sums).withColumn("weight", _weight(name, weights.get(name, {})))
        levels = _levels(nodes.join(parent, above), above)
        parent = stored(nodes.join(levels, above).select(
            *here, F.least("capacity", F.col("level") * F.col("weight")).alias("budget")), "budgets")
    return parent.drop("root")


def _levels(nodes: DataFrame, above: list[str]) -> DataFrame:
    """The water level of each group of siblings: each gets its weight times it, or its capacity if that is less.

    Siblings count in order of capacity by weight, equal ones together. A group may have any number of them, so
    it is cut into ranges of that order, and one row per range carries the sums over.
    """
    ratio = F.col("capacity") / F.nullif("weight", F.lit(0.0))
    steps = nodes.withColumn("ratio", ratio).groupBy(*above, "budget", "ratio").agg(
        F.sum("capacity").alias("capacity"), F.sum("weight").alias("weight"))
    # at most 64 ranges for each doubling; what weighs nothing comes last
    steps = steps.withColumn("range", F.when(F.col("ratio").isNull(), F.lit(1 << 20)).when(F.col("ratio") <= 0, F.lit(-(1 << 20)))
                             .otherwise(F.floor(F.log2("ratio") * 64)).cast("int"))
    inside = Window.partitionBy(*above, "range").orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    ranges, earlier = Window.partitionBy(*above), Window.partitionBy(*above).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0.0)
    offsets = steps.groupBy(*above, "range").agg(F.sum("capacity").alias("c"), F.sum("weight").alias("w")).select(
        *above, "range", F.coalesce(F.sum("c").over(earlier), nothing).alias("c_before"),
        F.coalesce(F.sum("w").over(earlier), nothing).alias("w_before"), F.sum("w").over(ranges).alias("w_all"))
    before = F.col("c_before") + F.coalesce("c_inside", nothing)
    onward = F.col("w_all") - F.col("w_before") - F.coalesce("w_inside", nothing)
    return (
        steps.withColumns({"c_inside": F.sum("capacity").over(inside), "w_inside": F.sum("weight").over(inside)})
        .join(offsets, [*above, "range"])
        .groupBy(*above).agg(F.coalesce(F.max((F.col("budget") - before) / F.nullif(onward, nothing)), nothing).alias("level"))
    )


def _rows(docs: DataFrame, tree: tuple[str, ...], places: dict[str, Column], id_column: str,
          text_column: str) -> DataFrame:
    named = [F.coalesce(places[c] if c in places else F.col(c), F.lit("")).cast("string").alias(c) for c in tree]
    return docs.select(F.col(id_column).alias("doc_id"), *named, token_count(F.col(text_column)).alias("tokens"))


def select_prefixes(docs: DataFrame, weights: dict[str, dict[str, int]], share: float = 1.0, epochs: int = 4,
                    seed: int = 7, tree: tuple[str, ...] = TREE, places: dict[str, Column] | None = None,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per selected document and epoch: doc_id, the tree, epoch, start, tokens, taken, digest.

    ``share`` times all tokens is the budget; ``start`` is a document's first token
    in its leaf's line of epochs, and ``taken`` the tokens of it inside the budget.
    """
    places = {"domain": domain_of(F.col("source"))} if places is None else places
    # rows of one id and length are one row with their number, so an id that repeats fills no slice
    rows = _rows(docs, tree, places, id_column, text_column).groupBy("doc_id", *tree, "tokens").agg(F.count(F.lit(1)).alias("copies"))
    leaves = stored(rows.groupBy(*tree).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("rows")),
                    "leaf-sizes")
    given = budgets(leaves, F.floor(F.col("all_tokens") * share), weights, epochs, tree)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(1, docs.count())
    plan = (
        leaves.withColumn("slices", F.ceil(F.col("rows") * F.lit(SLICES * partitions) / F.lit(count)))
        .join(given, list(tree)).where("tokens > 0 AND budget > 0")
        .withColumn("rounds", F.least(F.lit(epochs), F.ceil(F.col("budget") / F.col("tokens"))).cast("int"))
        .select(*tree, F.col("tokens").alias("leaf_tokens"), "slices", "budget", "rounds")
    )
    drawn = (
        rows.join(plan, list(tree))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
        .withColumn("digest", _digest(seed, F.col("epoch"), F.col("doc_id")))
        .withColumn("slice", F.floor(F.conv(F.left("digest", F.lit(8)), 16, 10).cast("double") / 2**32 * F.col("slices")))
    )
    slices = [*tree, "epoch", "slice"]
    earlier = Window.partitionBy(*tree, "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.col("tokens") * F.col("copies")
    offsets = drawn.groupBy(*slices).agg(F.sum(sizes).alias("sum")).select(
        *slices, F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*slices).orderBy("digest", "doc_id", "tokens").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        drawn.join(offsets, slices)
        .where(F.col("epoch") * F.col("leaf_tokens") + F.col("before") < F.col("budget"))
        .withColumn("start", F.col("epoch") * F.col("leaf_tokens") + F.col("before")
                    + F.coalesce(F.sum(sizes).over(inside), F.lit(0)))
        .where("start < budget")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("start", F.col("start") + F.col("tokens") * F.col("copy"))
        .where("start < budget")
        .select("doc_id", *tree, "epoch", "start", "tokens",
                F.least("tokens", F.ceil(F.col("budget") - F.col("start"))).alias("taken"), "digest")
    )


def mixed(docs: DataFrame, weights: dict[str, dict[str, int]], share: float = 1.0, epochs: int = 4, seed: int = 7,
          tree: tuple[str, ...] = TREE, places: dict[str, Column] | None = None, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """The selected documents with their own columns, once per epoch that selects them.

    The last document of a leaf is kept whole. Each leaf's selection ends at one
    place of its order, so texts are compared with that place and not joined by id.
    """
    places = {"domain": domain_of(F.col("source"))} if places is None else places
    chosen = select_prefixes(docs, weights, share, epochs, seed, tree, places, id_column, text_column)
    leaf = [f"leaf_{k}" for k in range(len(tree))]
    ends = chosen.groupBy(*(F.col(c).alias(n) for c, n in zip(tree, leaf))).agg(
        F.max(F.struct("epoch", "digest")).alias("end"))
    named = [F.coalesce(places[c] if c in places else F.col(c), F.lit("")).cast("string").alias(n)
             for c, n in zip(tree, leaf)]
    return (
        docs.select(F.struct("*").alias("row"), *named).join(ends, leaf)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("end.epoch"))))
        .where(F.struct("epoch", _digest(seed, F.col("epoch"), F.col("row")[id_column]).alias("digest")) <= F.col("end"))
        .select("row.*")
    )
