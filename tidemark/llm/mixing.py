"""Mixing sources to target weights: hierarchical budgets and token prefixes of seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh

#: Leaves that are broadcast at most; beyond it the join shuffles on the leaf.
BROADCAST_LEAVES = 100_000
#: Hex digits of a document's key that name its part of the leaf's order (16 to that power parts).
PART_DIGITS = 3
#: White space between tokens.
SPACE = "[\\x20\\x09-\\x0D]+"


def token_count(text: Column) -> Column:
    """Words between runs of ASCII white space; null counts as empty."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def _shares(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Split each parent's ``budget`` over its children by weight ``_w``, within supplies ``_s``.

    A child whose supply falls short of its share gives all it has; what is
    missing goes to its siblings by weight, over and over. With the children in
    order of supply per weight, those are a prefix of the order, so running sums
    find them in one pass. All arithmetic is on whole numbers; the few tokens
    that rounding leaves over go one each to the first children by name.
    """
    dec = "decimal(38,0)"
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.col("_s").cast("double") / F.col("_w"), name).rowsBetween(Window.unboundedPreceding, -1)
    held = nodes.withColumn("_s_before", F.coalesce(F.sum("_s").over(order), F.lit(0)).cast(dec))
    held = held.withColumn("_w_left", F.sum("_w").over(siblings).cast(dec) - F.coalesce(F.sum("_w").over(order), F.lit(0)).cast(dec))
    short = F.col("_s").cast(dec) * F.col("_w_left") <= F.col("_w").cast(dec) * (F.col("budget").cast(dec) - F.col("_s_before"))
    held = held.withColumn("_short", short)
    held = held.withColumn("_rest", F.col("budget") - F.sum(F.when(F.col("_short"), F.col("_s")).otherwise(0)).over(siblings))
    held = held.withColumn("_rest_w", F.sum(F.when(F.col("_short"), 0).otherwise(F.col("_w"))).over(siblings))
    part = F.expr("cast((cast(_w as decimal(38,0)) * cast(_rest as decimal(38,0))) div cast(_rest_w as decimal(38,0)) as bigint)")
    held = held.withColumn("_part", F.when(~F.col("_short"), part).otherwise(F.lit(0)).cast("long"))
    held = held.withColumn("_over", F.col("_rest") - F.sum("_part").over(siblings))
    held = held.withColumn("_place", F.row_number().over(siblings.orderBy("_short", name)))
    given = F.when(F.col("_short"), F.col("_s")).otherwise(F.col("_part") + F.when(F.col("_place") <= F.col("_over"), 1).otherwise(0))
    return held.withColumn("budget", given.cast("long")).drop("_s_before", "_w_left", "_short", "_rest", "_rest_w", "_part", "_over", "_place")


def _weight(levels: Sequence[str], weights: Mapping[tuple, int]) -> Column:
    chosen = F.lit(1)
    for path, w in weights.items():
        if len(path) == len(levels):
            same = F.lit(True)
            for level, value in zip(levels, path, strict=True):
                same = same & (F.col(level) == F.lit(value))
            chosen = F.when(same, F.lit(int(w))).otherwise(chosen)
    return chosen.cast("long")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int], total: int | None, max_epochs: int) -> DataFrame:
    """Token budgets of the leaves of a weight tree.

    ``leaves``: the level columns and ``tokens``. A leaf supplies its tokens
    ``max_epochs`` times; ``total`` (null: all tokens once) is cut to the whole
    supply. From the root down, :func:`_shares` splits each node's budget, so a
    shortage is made up by siblings before it reaches the parent's siblings.
    ``weights`` maps paths (tuples of level values) to positive whole numbers;
    paths that aren't named weigh 1. Adds _s (supply), _w (weight), budget.
    """
    sums = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("root_tokens"))
    tree = leaves.select(*levels, "tokens", (F.col("tokens") * max_epochs).alias("_leaf_s"))
    whole = sums.select(F.least(F.lit(total) if total is not None else F.col("root_tokens"), F.col("root_tokens") * max_epochs).cast("long").alias("budget"))
    above = whole  # one row
    for k in range(1, len(levels) + 1):
        path = list(levels[:k])
        nodes = tree.groupBy(*path).agg(F.sum("_leaf_s").cast("long").alias("_s")).withColumn("_w", _weight(path, weights))
        nodes = nodes.crossJoin(F.broadcast(above)) if k == 1 else nodes.join(above.select(*path[:-1], "budget"), path[:-1])
        above = _shares(nodes, path[:-1], path[-1])
    return above.join(leaves.select(*levels, "tokens"), list(levels))


def _key(epoch: Column, seed: int, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def plan_mix(rows: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int], scratch: Scratch, total: int | None = None, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """For every leaf: budget, whole epochs, and where the prefix of the last epoch ends.

    ``rows``: doc_id, the level columns, tokens. A budget buys whole epochs of
    the leaf and a prefix of one more. In each epoch the documents come in the
    order of md5(seed:epoch:doc_id). The end of the prefix is found in two
    steps: tokens per part of the order (4096 parts by the key's first digits)
    name the part it falls in, and only that part's documents are ranked. So no
    task holds a whole leaf, even if one leaf has a third of all rows.
    """
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").cast("long").alias("tokens"))
    budgets = leaf_budgets(leaves, levels, weights, total, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("int")
    budgets = scratch.put(budgets.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "budgets")
    keyed = rows.join(_small(budgets.where("rest > 0").select(*levels, "epochs", "rest")), list(levels))
    keyed = keyed.withColumn("key", _key(F.col("epochs"), seed, F.col("doc_id"))).withColumn("part", F.substring("key", 1, PART_DIGITS))
    before = Window.partitionBy(*levels).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keyed.groupBy(*levels, "part", "rest").agg(F.sum("tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = scratch.put(parts.where("before < rest and before + n >= rest").select(*levels, "part", "before"), "ends")
    run = Window.partitionBy(*levels, "part").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.join(_small(ends), [*levels, "part"]).withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(run), F.lit(0)))
    last = inside.where("start < rest").groupBy(*levels).agg(F.max(F.struct("key", "doc_id", "start")).alias("end"))
    return budgets.join(last.select(*levels, F.col("end.key").alias("end_key"), F.col("end.doc_id").alias("end_id"), F.col("end.start").alias("end_start")), list(levels), "left")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of leaves if its checked size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_LEAVES else df


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, int], total: int | None = None, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", annotate: bool = True) -> DataFrame:
    """The mixture: all columns of ``docs`` and mix_epoch, mix_tokens, mix_taken, one row per document and epoch.

    ``levels`` names the tree's levels from the root down, each with its
    expression over ``docs``; null values count as the empty name. A document
    is in the last epoch's prefix if it comes no later than the one in which the
    budget ends; that one is given whole, with mix_taken telling how many of its
    tokens the budget covers. The text is read twice and never shuffled while
    there are at most ``BROADCAST_LEAVES`` leaves.

    Documents without tokens come once per whole epoch. Rows that repeat an id
    are rows of their own; where such rows tie at the end of a prefix, all of
    them are in it. An empty table gives an empty result. Work columns have
    names that ``docs`` hasn't; a caller's columns called mix_epoch, mix_tokens
    or mix_taken are replaced, and kept with ``annotate=False``, which gives the
    columns of ``docs`` alone.
    """
    if max_epochs < 1 or not all(int(w) > 0 for w in weights.values()):
        raise ValueError("max_epochs and all weights must be positive")
    scratch = Scratch(docs.sparkSession, "mix")
    outputs = ("mix_epoch", "mix_tokens", "mix_taken")
    kept = [c for c in docs.columns if not annotate or c.lower() not in outputs]
    names = [f"_mix_{k}" for k in levels]
    end = ("epochs", "rest", "end_key", "end_id", "end_start")
    work_names = fresh(docs, *names, *[f"_mixed_{c}" for c in (*end, "key", "last", "epoch", "tokens")])
    level_names, (epochs, rest, end_key, end_id, end_start, key, last, epoch, tokens) = work_names[: len(names)], work_names[len(names) :]
    paths = {tuple(p): w for p, w in weights.items()}
    work = docs.select("*", *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(level_names, levels.values(), strict=True)], token_count(F.col(text_col)).alias(tokens))
    rows = scratch.put(work.select(F.col(id_col).alias("doc_id"), *[F.col(a).alias(n) for a, n in zip(level_names, names, strict=True)], F.col(tokens).alias("tokens")), "rows")
    plan = plan_mix(rows, names, paths, scratch, total, max_epochs, seed)
    aliases = [F.col(c).alias(n) for c, n in zip((*names, *end), (*level_names, epochs, rest, end_key, end_id, end_start), strict=True)]
    plan = scratch.put(plan.select(*aliases), "plan")
    scratch.drop("rows", "budgets", "ends")
    at_end = (F.col(key) == F.col(end_key)) & F.col(id_col).eqNullSafe(F.col(end_id))
    is_last = F.coalesce((F.col(key) < F.col(end_key)) | at_end, F.lit(False))
    chosen = work.join(_small(plan), level_names).withColumn(key, _key(F.col(epochs), seed, F.col(id_col))).withColumn(last, is_last)
    copies = F.col(epochs) + F.col(last).cast("int")
    chosen = chosen.where(copies > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0), copies - 1)))
    cut = (F.col(epoch) == F.col(epochs)) & at_end
    taken = F.when(cut, F.least(F.col(tokens), F.col(rest) - F.col(end_start))).otherwise(F.col(tokens))
    added = [F.col(epoch).alias(outputs[0]), F.col(tokens).alias(outputs[1]), taken.alias(outputs[2])] if annotate else []
    return chosen.select(*[F.col(f"`{c}`") for c in kept], *added)


def document_levels() -> dict[str, Column]:
    """Domain, language, source of the ``documents`` table: sources of one digit are 'web', others 'curated'."""
    return {"domain": F.when(F.col("source").rlike("^src[0-9]$"), "web").otherwise("curated"), "lang": F.col("lang"), "source": F.col("source")}


#: Weights of the registered queries; other paths weigh 1.
DOCUMENT_WEIGHTS = {
    ("web",): 3, ("curated",): 2,
    ("web", "en"): 4, ("web", "de"): 2, ("web", "fr"): 2, ("web", "es"): 1,
    ("curated", "en"): 3, ("curated", "de"): 2, ("curated", "fr"): 2, ("curated", "es"): 2,
}
