"""Mixing sources to target weights: a budget of tokens goes down a tree of domain, language and source.

Siblings share their parent's budget by weight. A node can't take more than its supply (its tokens times MAX_EPOCHS); what it
can't take goes to its siblings by their weights. As the supply of a node is that of its leaves, a shortage leaves a family only
when the whole family is short, and then reaches the parent's siblings. Leaves are filled from seeded epochs: each epoch is a
permutation of the leaf's documents, and the leaf takes the longest prefix of the epochs that its budget allows.

Prefixes need running sums over a leaf, which may hold a third of all rows. The permutation key, uniform in [0, 1), is cut into
as many slices as the leaf has thousands of rows: slice totals are summed first, and only the slice at the budget's edge is
looked at row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlake.llm.common import register, table, written

SEED = "mix-1"
MAX_EPOCHS = 2
BUDGET_PERCENT = 80
LEVELS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"domain0": 4, "domain1": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}  # every other node weighs 1
SLICE_ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def with_domain(documents: DataFrame) -> DataFrame:
    """The given table's sources fall into four domains by the last figures of their names."""
    number = F.regexp_extract("source", "([0-9]{1,9})$", 1)
    return documents.withColumn("domain", F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("domain"), number.cast("long") % 4)).otherwise("other"))


def _weight(level: str, weights: dict[str, dict[str, int]]):
    out = F.lit(1)
    for value, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return out.cast("double")


def budgets(leaves: DataFrame, budget: DataFrame, levels: tuple[str, ...], weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves (levels..., supply) with the token budget of each leaf. budget: one row (share), the budget of the root.

    Water is filled to one level in each family: in the order of supply / weight, a node is full if the parent's budget covers
    all nodes before it and the same level for the others. Nodes of weight 0 get nothing. Budgets are rounded down.
    """
    nodes = [leaves]
    for depth in range(len(levels) - 1, 0, -1):
        nodes.append(nodes[-1].groupBy(*levels[:depth]).agg(F.sum("supply").alias("supply")))
    parent = budget
    for depth, own in enumerate(reversed(nodes), 1):
        family = list(levels[:depth - 1])
        placed = own.withColumn("weight", _weight(levels[depth - 1], weights)).join(parent, family) if family else own.withColumn(
            "weight", _weight(levels[depth - 1], weights)).crossJoin(parent)  # the budget is one row
        full_at = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight"))
        placed = placed.withColumn("full_at", F.coalesce(full_at, F.lit(float("inf"))))
        order = Window.partitionBy(*family).orderBy("full_at", levels[depth - 1])
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        all_ = Window.partitionBy(*family)
        placed = (placed.withColumn("below", F.sum(F.when(F.col("weight") > 0, F.col("supply")).otherwise(0)).over(upto))
                  .withColumn("after", F.sum("weight").over(all_) - F.sum("weight").over(upto))
                  .withColumn("is_full", (F.col("weight") > 0) & (F.col("below") + F.col("full_at") * F.col("after") <= F.col("share"))))
        placed = (placed.withColumn("gone", F.sum(F.when(F.col("is_full"), F.col("supply")).otherwise(0)).over(all_))
                  .withColumn("open", F.sum(F.when(F.col("is_full"), F.lit(0.0)).otherwise(F.col("weight"))).over(all_)))
        level = (F.col("share") - F.col("gone")) / F.when(F.col("open") > 0, F.col("open"))
        share = F.when(F.col("is_full"), F.col("supply")).when(F.col("weight") > 0, F.least(F.col("supply"), F.floor(level * F.col("weight")))).otherwise(0)
        parent = placed.select(*levels[:depth], "supply", share.cast("long").alias("share"))
        if depth < len(levels):
            parent = parent.drop("supply")
    return parent


def _place(epoch, seed: str):
    """Uniform in [0, 1): the place of a document in the permutation of an epoch."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.col("doc_id").cast("string"))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def mix(documents: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, levels: tuple[str, ...] = LEVELS,
        budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, levels..., epoch, tokens): the chosen documents, once for each epoch that takes them.

    Tokens are words `[^\\x20\\x09-\\x0D]+`; the budget is budget_percent of all tokens. A leaf takes whole documents while their
    running total stays within its budget, in the order (epoch, place, doc_id); documents without words cost nothing and follow
    the same order. Null level values are a node of their own, named ''. Rows without a doc_id share one place each epoch and
    come or go with their row's turn. Rows that repeat a doc_id are counted and chosen each. An empty table gives an empty result.
    """
    levels = tuple(levels)
    flat = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels],
                                    F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens")), "mix")
    totals = written(flat.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "mix-leaves")
    root = totals.agg(F.expr(f"coalesce(sum(tokens), 0) * {int(budget_percent)} div 100").alias("share"))
    leaves = budgets(totals.select(*levels, (F.col("tokens") * max_epochs).alias("supply")), root, levels, weights).drop("supply")
    leaves = (totals.join(leaves, list(levels)).withColumn("slices", F.ceil(F.col("n") / SLICE_ROWS))
              # whole epochs first: full_epochs are taken entirely, the next one as a prefix of `rest` tokens
              .withColumn("full_epochs", F.least(F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(1), F.lit(max_epochs)))
              .withColumn("rest", F.col("share") - F.col("full_epochs") * F.col("tokens")))
    leaves = written(leaves.select(*levels, "slices", "full_epochs", "rest"), "mix-budgets")
    turns = flat.join(leaves, list(levels)).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.least(F.col("full_epochs") + 1, F.lit(max_epochs)).cast("int"))))
    whole = turns.where(F.col("epoch") <= F.col("full_epochs")).select("doc_id", *levels, "epoch", "tokens")
    part = (turns.where((F.col("epoch") > F.col("full_epochs")) & (F.col("rest") > 0)).withColumn("place", F.coalesce(_place(F.col("epoch"), seed), F.lit(0.0)))
            .withColumn("slice", F.floor(F.col("place") * F.col("slices"))))
    slices = part.groupBy(*levels, "slice").agg(F.sum("tokens").alias("in_slice"))
    before = Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("in_slice").over(before), F.lit(0)))
    cut = part.join(slices, [*levels, "slice"]).where(F.col("before") <= F.col("rest"))
    taken = cut.where(F.col("before") + F.col("in_slice") <= F.col("rest"))
    edge = cut.where(F.col("before") + F.col("in_slice") > F.col("rest"))
    running = Window.partitionBy(*levels, "slice").orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("tokens").over(running)).where(F.col("upto") <= F.col("rest"))
    names = ["doc_id", *levels, "epoch", "tokens"]
    return whole.select(names).unionByName(taken.select(names)).unionByName(edge.select(names))


def _level_sql(depth: int) -> str:
    family = ", ".join(LEVELS[:depth - 1])
    by, own = (f"PARTITION BY {family}" if family else ""), LEVELS[depth - 1]
    cases = "".join(f" WHEN {own} = '{v}' THEN {w}" for v, w in sorted(WEIGHTS.get(own, {}).items()))
    weight = f"CAST(CASE{cases} ELSE 1 END AS DOUBLE)" if cases else "1.0::DOUBLE"
    cols = ", ".join(LEVELS[:depth])
    parent = f"JOIN b{depth - 1} USING ({family})" if family else "CROSS JOIN b0"
    return f"""w{depth} AS (SELECT n.*, share, supply / n.weight AS full_at FROM
        (SELECT {cols}, {weight} AS weight, CAST(sum(tokens) * {MAX_EPOCHS} AS BIGINT) AS supply FROM leaf GROUP BY {cols}) n {parent}),
      f{depth} AS (SELECT *, (SELECT coalesce(sum(y.supply), 0) FROM w{depth} y WHERE {' AND '.join([f'y.{c} = x.{c}' for c in LEVELS[:depth - 1]] + ['true'])}
            AND (y.full_at, y.{own}) <= (x.full_at, x.{own})) + full_at * (SELECT coalesce(sum(y.weight), 0) FROM w{depth} y
            WHERE {' AND '.join([f'y.{c} = x.{c}' for c in LEVELS[:depth - 1]] + ['true'])} AND (y.full_at, y.{own}) > (x.full_at, x.{own})) <= share AS is_full FROM w{depth} x),
      b{depth} AS (SELECT {cols}, CAST(CASE WHEN is_full THEN supply ELSE least(supply, floor((share - coalesce(sum(supply) FILTER (is_full) OVER ({by}), 0))
            / (sum(weight) FILTER (NOT is_full) OVER ({by})) * weight)) END AS BIGINT) AS share FROM f{depth})"""


MIX_SQL = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN 'domain' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4) ELSE 'other' END AS domain,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
      leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM d GROUP BY ALL),
      b0 AS (SELECT CAST(coalesce(sum(tokens), 0) * {BUDGET_PERCENT} // 100 AS BIGINT) AS share FROM leaf),
      {', '.join(_level_sql(i) for i in (1, 2, 3))},
      copies AS (SELECT d.*, epoch, share, CAST('0x' || substr(md5('{SEED}:' || epoch || ':' || doc_id), 1, 12) AS BIGINT) / {1 << 48}.0::DOUBLE AS place
        FROM d JOIN b3 USING (domain, lang, source), (SELECT unnest(range(1, {MAX_EPOCHS + 1})) AS epoch)),
      total AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, place, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM copies)
    SELECT doc_id, domain, lang, source, epoch, tokens FROM total WHERE upto <= share"""


@register("op4_mix_sources", MIX_SQL)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(with_domain(table(spark, sf_dir, "documents")))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixture of the documents; a document that two epochs take is there twice.

    Rows that share a doc_id (or have none) come together in the epochs that chose any of them.
    """
    named = with_domain(docs)
    turns = mix(named).groupBy("doc_id").agg(F.collect_set("epoch").alias("turns"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    out = rows.join(turns, F.col("row.doc_id").eqNullSafe(F.col("doc_id")))
    return out.select("row", F.explode("turns")).select("row.*")
