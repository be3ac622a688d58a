"""Splits that keep related families, and their records, together."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import cut, join_hot
from .differencing import difference

SPLITS = {"train": 0.8, "dev": 0.1, "test": 0.1}
#: Components differenced together, bins made of them, and bins that are allocated at last.
GROUP_ITEMS, GROUP_BINS, LAST_BINS = 4000, 500, 200


def outer_clean(column: Column) -> Column:
    """Lower case without blanks around."""
    return F.regexp_replace(F.lower(column), r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")


def present(cleaned: Column) -> Column:
    """cleaned, or null where it stands for a missing value."""
    return F.when(cleaned.isin("", "unknown", "n/a", "none", "-") | cleaned.rlike("^0+$"), None).otherwise(cleaned)


def id_key(column: Column) -> Column:
    """Key of an id, hash or signature: case and outer blanks ignored, null where missing."""
    return present(outer_clean(column))


def name_key(column: Column) -> Column:
    """Key of a name: case, outer blanks and any of _ - . and blanks ignored, null where missing."""
    return present(F.regexp_replace(id_key(column), r"[_\-.\p{Z}\s]+", ""))


def spaced_name(column: Column) -> Column:
    """A name in lower case, without outer blanks, each run of _ - . and blanks made one _."""
    return F.regexp_replace(outer_clean(column), r"[_\-.\p{Z}\s]+", "_")


def components(links: DataFrame) -> DataFrame:
    """(node, component) from links(node bigint, key): nodes that share a key, also through others; component is the smallest node.

    Links with a null key or node join nothing; a node without any key is a component of its own. Each round takes the smallest label over each node's
    keys (aggregated before the shuffle, so a hot key costs no more than a row a task), then follows labels to their labels. A hot key meets its nodes where they lie (join_hot). The joins of
    all nodes of a large component have one row on their other side and a shuffle on both, so adaptive execution splits them where such a component makes a part too large.
    """
    nodes = links.where("node is not null").select("node").distinct()
    shared = cut(links.where("node is not null and key is not null").select("node", "key").distinct())
    first = cut(shared.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").drop("high"))
    # a star for each key
    star = join_hot(shared, first, ["key"]).where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    star = cut(star.union(star.select("b", "a")))
    label = cut(star.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = star.join(label, star.b == label.node).groupBy("a").agg(F.min("component").alias("least"))
        step = label.join(near, label.node == near.a, "left").select("node", F.least("component", "least").alias("component"), F.col("component").alias("was"))
        up = step.select(F.col("node").alias("up_node"), F.col("component").alias("up"))
        step = cut(step.join(up, step.component == up.up_node, "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "was"))
        label = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            break
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def related_families(specs: DataFrame) -> DataFrame:
    """(spec_id, group_id): the related group of every spec; group_id is its smallest spec_id."""
    keys = F.array(
        F.concat(F.lit("f:"), name_key(F.col("template_family"))),
        F.concat(F.lit("s:"), id_key(F.col("semantic_signature"))),
        F.concat(F.lit("v:"), id_key(F.col("seed_value_hash"))),
    )
    links = specs.select(F.col("spec_id").cast("bigint").alias("node"), F.explode(keys).alias("key"))
    return components(links).select(F.col("node").alias("spec_id"), F.col("component").alias("group_id"))


def broken_groups(specs: DataFrame, records: DataFrame) -> DataFrame:
    """(spec_id, group_id): the specs of assigned groups in which more than one intended_split occurs, missing ones left out: no assignment of whole groups can keep all of these."""
    return assign_splits(specs, records).where("broken").select("spec_id", "group_id").distinct()


def _into_bins(bins: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["weight", "item"], ascending=[False, True], kind="stable")
        of = difference(group.weight.to_numpy(), min(bins, max(1, len(group))))
        return pd.DataFrame({"item": group.item, "bin": of + int(group.g.iloc[0]) * bins, "weight": group.weight})

    return run


def balance(weights: DataFrame, targets: dict[str, float] = SPLITS) -> DataFrame:
    """(item, split) from weights(item bigint, weight bigint): whole items into splits near the proportions.

    Largest differencing: items are differenced into many near-equal bins, in groups of bounded size, the bins of all groups again, until one group
    is left; its bins, bounded in number, are allocated whole, the heaviest first, to the split that lacks most. Items without weight count 0.
    """
    level = cut(weights.select("item", F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight")))
    maps = []
    while True:
        count = level.count()
        last = count <= GROUP_ITEMS
        groups = 1 if last else -(-count // GROUP_ITEMS)

        run = _into_bins(LAST_BINS if last else GROUP_BINS)
        binned = cut(level.withColumn("g", F.pmod(F.xxhash64("item"), F.lit(groups))).groupBy("g").applyInPandas(run, "item bigint, bin bigint, weight bigint"))
        maps.append(binned.select("item", "bin"))
        level = binned.groupBy("bin").agg(F.sum("weight").alias("weight")).select(F.col("bin").alias("item"), "weight")
        if last:
            break
    names = list(targets)
    bins = sorted(level.collect(), key=lambda r: (-r.weight, r.item))  # at most LAST_BINS rows
    total = sum(r.weight for r in bins)
    have = dict.fromkeys(names, 0)
    chosen = []
    for r in bins:
        split = max(names, key=lambda s: (targets[s] * total - have[s], targets[s]))
        have[split] += r.weight
        chosen.append((r.item, split))
    out = weights.sparkSession.createDataFrame(chosen, "bin bigint, split string")
    for m in reversed(maps):
        out = m.join(out, "bin").select("item", "split")
        if m is not maps[0]:
            out = out.withColumnRenamed("item", "bin")
    return out


def assign_splits(specs: DataFrame, records: DataFrame, targets: dict[str, float] = SPLITS) -> DataFrame:
    """(spec_id, group_id, group_records, assigned_split, intended_split, keeps_intent, broken): a split for every spec, whole groups together.

    A group weighs the records of its families (a family listed again counts once). keeps_intent is false where intended_split differs from the assignment,
    null where it is missing; broken is true where the group's specs intend more than one split. Families without records weigh nothing.
    """
    groups = cut(related_families(specs))
    own = specs.select(F.col("spec_id").cast("bigint").alias("spec_id"), "template_family", F.nullif(outer_clean(F.col("intended_split")), F.lit("")).alias("intended_split"))
    counts = records.groupBy(F.col("meta.template_family").alias("template_family")).agg(F.count(F.lit(1)).alias("n")).where("template_family is not null")
    grouped = own.join(groups, "spec_id")
    weight = grouped.select("group_id", "template_family").distinct().join(counts, "template_family", "left").groupBy("group_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("group_records"))
    intents = grouped.groupBy("group_id").agg(F.coalesce(F.min("intended_split") != F.max("intended_split"), F.lit(False)).alias("broken"))
    weight = cut(weight.join(intents, "group_id"))
    split = balance(weight.select(F.col("group_id").alias("item"), F.col("group_records").alias("weight")), targets).select(F.col("item").alias("group_id"), F.col("split").alias("assigned_split"))
    return (
        grouped.join(weight, "group_id").join(split, "group_id")
        .select("spec_id", "group_id", "group_records", "assigned_split", "intended_split", (F.col("intended_split") == F.col("assigned_split")).alias("keeps_intent"), "broken")
    )
