"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed over cells (source, language, topic).  The cells' weights are raked until the weighted tokens of every
source, every language and every topic have the wanted shares; then each document is kept with a probability in proportion
to its cell's weight, by a hash of its id and text, so that the same row is always decided alike.

A topic is a band of form that the whole text shows: lists, figures, symbols, short or long prose.  Where no shares are
given, no level of a bounded margin may have more than ``MOST`` of the sample's tokens (twice an even share, if that is
more): levels over that bound get it, and the others share the rest as they did.  Margins are gone through in turn, each
with the masses that the targets before it leave, and margins without a bound keep the shares of those.  With one bounded
margin, only its hot levels are thinned and all else is kept whole.  With several, as for ``op6_mixing``, whose sources and
languages are both bounded, thinning one margin moves the other where the two go together, and it takes the fit to meet both.
Null sources and languages are cells of their own; null and empty texts have no tokens and go with their cell, and cells
without any tokens are kept.  Repeated rows with equal ids and texts are kept or dropped
together.  Cells are summed before anything leaves a task, so hot sources need no care; up to ``CELLS`` cells are raked on
the driver, more of them as a table.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import drop_tables, written

MARGINS = ("source", "lang", "topic")
MOST = 0.25
ROUNDS, TOLERANCE = 100, 1e-9
CELLS = 100_000
SEED = 17


def topic(text: Column) -> Column:
    n = F.greatest(F.length(text), F.lit(1))
    lines = F.regexp_count(text, F.lit("\n")) + 1
    figures = F.regexp_count(text, F.lit("[0-9]"))
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]"))
    return F.when(symbols * 20 > n, "symbols").when(figures * 20 > n, "figures").when(lines * 60 > n, "lists").when(n < 1000, "short").otherwise("long")


def tokens(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def rake(cells: dict[tuple, float], targets: list[dict]) -> dict[tuple, float]:
    """Weights for the cells (keys: a level of each margin) whose weighted mass has the targets' shares."""
    keys = list(cells)
    mass = np.array([cells[k] for k in keys], float)
    fitted = mass.copy()
    levels = [{v: j for j, v in enumerate(dict.fromkeys(k[i] for k in keys))} for i in range(len(targets))]
    at = [np.array([levels[i][k[i]] for k in keys], np.int64) for i in range(len(targets))]
    wanted = [np.array([t.get(v, 0.0) for v in own], float) for t, own in zip(targets, levels)]
    for _ in range(ROUNDS):
        worst = 0.0
        for index, want in zip(at, wanted):
            have = np.bincount(index, fitted, len(want))
            scale = np.where(have > 0, want * mass.sum() / np.where(have > 0, have, 1), 0)
            worst = max(worst, float(np.abs(scale[have > 0] - 1).max(initial=0)))
            fitted *= scale[index]
        if worst < TOLERANCE:
            break
    return {k: float(f / m) if m else 0.0 for k, f, m in zip(keys, fitted, mass)}


def rake_table(cells: DataFrame, targets: list[DataFrame], margins: tuple[str, ...] = MARGINS, rounds: int = ROUNDS) -> DataFrame:
    """``rake`` for cells too many for the driver: (margins..., mass) to (margins..., weight), cut from its lineage each round."""
    spark = cells.sparkSession
    now = written(cells.withColumn("fitted", F.col("mass")), "rake")
    total = now.agg(F.sum("mass")).first()[0] or 0.0
    for _ in range(rounds):
        worst = 0.0
        for m, t in zip(margins, targets):
            have = now.groupBy(m).agg(F.sum("fitted").alias("have"))
            scale = have.join(t, have[m].eqNullSafe(t[m]), "left").select(have[m].alias("level"), F.when(F.col("have") > 0, F.coalesce(F.col("share"), F.lit(0.0)) * total / F.col("have")).otherwise(1.0).alias("scale"))
            worst = max(worst, scale.agg(F.max(F.abs(F.col("scale") - 1))).first()[0] or 0.0)
            after = written(now.join(scale, F.col(m).eqNullSafe(F.col("level")), "left").withColumn("fitted", F.col("fitted") * F.coalesce("scale", F.lit(0.0))).drop("level", "scale"), "rake")
            drop_tables(now)
            now = after
        if worst < TOLERANCE:
            break
    return now.select(*margins, "mass", F.when(F.col("mass") > 0, F.col("fitted") / F.col("mass")).otherwise(0.0).alias("weight"))


def ceiling(hottest: list[float], total: float, levels: int, most: float = MOST) -> float:
    """The mass to which hot levels are thinned, so that none has more than ``most`` of what then remains.

    Asks for the heaviest levels, heaviest first: the ``1 / most`` first ones at least.
    """
    most = max(most, 2 / max(levels, 1))
    for hot in range(len(hottest) + 1):
        if hot * most >= 1:
            break
        cap = most * max(total - sum(hottest[:hot]), 0.0) / (1 - hot * most)
        if hot == len(hottest) or hottest[hot] <= cap * (1 + 1e-12):
            return cap if hot else total
    return total


def tempered(mass: Mapping, most: float = MOST) -> dict:
    """The shares of levels whose hot ones are thinned to the bound."""
    some = sorted((v for v in mass.values() if v > 0), reverse=True)
    cap = ceiling(some, sum(some), len(some), most)
    scaled = {k: min(v, cap) for k, v in mass.items()}
    total = sum(scaled.values()) or 1.0
    return {k: v / total for k, v in scaled.items()}


def weighed(docs: DataFrame, targets: Mapping[str, Mapping] | None = None, most: float = MOST, bounded: Collection[str] = ("source",)) -> DataFrame:
    """``docs`` with mix_topic, mix_tokens, mix_weight, mix_probability and mix_kept.

    The largest weight has probability 1, so that the sample is the largest one of these shares without repeats.
    ``targets`` may give the shares of a margin's levels; without them a level of the ``bounded`` margins has at most
    ``most``, and the other margins follow.
    """
    spark, targets = docs.sparkSession, targets or {}
    text = F.col("text").cast("string")
    rows = docs.withColumn("mix_topic", F.coalesce(topic(text), F.lit("short"))).withColumn("mix_tokens", tokens(text))
    cell = [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("mix_topic").alias("topic")]
    cells = written(rows.groupBy(*cell).agg(F.sum("mix_tokens").cast("double").alias("mass"), F.count(F.lit(1)).alias("docs")), "cells")
    if cells.count() <= CELLS:
        mass = {tuple(r[:3]): r[3] for r in cells.collect()}
        after, shares = dict(mass), []
        for i, m in enumerate(MARGINS):
            own, total = _sums(after, i), sum(after.values())
            shares.append(dict(targets[m]) if m in targets else tempered(own, most) if m in bounded else _shares(own))
            after = {k: v * shares[-1].get(k[i], 0.0) * total / own[k[i]] if own[k[i]] else 0.0 for k, v in after.items()}
        raked = rake(mass, shares)
        whole = max(raked.values(), default=0.0)
        found = [(*k, w if mass[k] else whole) for k, w in raked.items()]
        weights = F.broadcast(spark.createDataFrame(found, "source string, lang string, topic string, weight double").coalesce(1))
    else:
        after, frames = cells.withColumn("now", F.col("mass")), []
        for m in MARGINS:
            own = written(after.groupBy(m).agg(F.sum("now").alias("own")), "levels")
            total, levels = own.filter("own > 0").agg(F.sum("own"), F.count(F.lit(1))).first()
            if m in targets:
                share = spark.createDataFrame(list(targets[m].items()), f"{m} string, share double")
            elif m in bounded:
                hottest = [r[0] for r in own.select("own").orderBy(F.desc("own")).limit(int(1 / most) + 1).collect()]
                share = _shared(own.select(m, F.least("own", F.lit(ceiling(hottest, total or 0.0, levels, most))).alias("share")))
            else:
                share = _shared(own.select(m, F.col("own").alias("share")))
            frames.append(share)
            thin = own.join(share.withColumnRenamed(m, "level"), F.col(m).eqNullSafe(F.col("level")), "left").select("level", (F.coalesce("share", F.lit(0.0)) * (total or 0.0) / F.when(F.col("own") > 0, F.col("own"))).alias("thin"))
            after = after.join(thin, F.col(m).eqNullSafe(F.col("level")), "left").drop("level").withColumn("now", F.col("now") * F.coalesce("thin", F.lit(0.0))).drop("thin")
        weights = rake_table(cells.drop("docs"), frames)
        whole = weights.agg(F.max("weight")).first()[0] or 0.0
        weights = weights.select(*MARGINS, F.when(F.col("mass") > 0, F.col("weight")).otherwise(F.lit(whole)).alias("weight"))
    weights = weights.toDF("mix_s", "mix_l", "mix_t", "mix_weight")
    joined = rows.join(weights, rows["source"].cast("string").eqNullSafe(weights["mix_s"]) & rows["lang"].cast("string").eqNullSafe(weights["mix_l"]) & rows["mix_topic"].eqNullSafe(weights["mix_t"]), "left").drop("mix_s", "mix_l", "mix_t")
    chance = F.when(F.col("mix_weight") >= whole * (1 - 1e-9), F.lit(1.0)).otherwise(F.col("mix_weight") / F.lit(whole or 1.0))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return joined.withColumn("mix_probability", F.least(chance, F.lit(1.0))).withColumn("mix_kept", draw < F.col("mix_probability"))


def _sums(mass: Mapping[tuple, float], i: int) -> dict:
    out: dict = {}
    for k, v in mass.items():
        out[k[i]] = out.get(k[i], 0.0) + v
    return out


def _shares(mass: Mapping) -> dict:
    total = sum(mass.values()) or 1.0
    return {k: v / total for k, v in mass.items()}


def _shared(levels: DataFrame) -> DataFrame:
    return levels.withColumn("share", F.col("share") / F.lit(levels.agg(F.sum("share")).first()[0] or 1.0))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return weighed(docs, bounded=("source", "lang")).select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))
