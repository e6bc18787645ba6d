"""Attaching states, features, identifiers; checks that two row sets do not meet."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def join_states_by_id(units: DataFrame, states: DataFrame, order: str | None = None) -> DataFrame:
    """States of every unit. With ``order`` the later listing of a unit overrides the earlier (an aggregate, so many
    listings of one unit do not meet in one window); a unit without a state fails the job."""
    cols = [c for c in states.columns if c not in ("unit_id", order)]
    if order:
        states = states.groupBy("unit_id").agg(F.max_by(F.struct(*cols), order).alias("__s")).select("unit_id", "__s.*")
    j = units.join(states.withColumn("__has", F.lit(True)), "unit_id", "left")
    ok = F.when(F.col("__has"), True).otherwise(F.raise_error(F.concat(F.lit("no state for unit "), F.col("unit_id").cast("string"))).cast("boolean"))
    return j.where(ok).drop("__has")


def missing_states(units: DataFrame, states: DataFrame) -> DataFrame:
    return units.select("unit_id").join(states.select("unit_id"), "unit_id", "left_anti")


def harmonise_features(counts: DataFrame, mapping: dict[str, list[str]], units: DataFrame) -> DataFrame:
    """Our features from a source's: exact name, alias, or the mean of several clones; a feature without sources is
    NULL and not present. A source feature may be used once. mapping: ours -> [source features]."""
    used = [s for v in mapping.values() for s in v]
    if len(used) != len(set(used)):
        raise ValueError("a source feature is used twice")
    m = counts.sparkSession.createDataFrame([(o, s, len(v)) for o, v in mapping.items() for s in v], "ours string, feature string, n_sources int")
    g = counts.join(F.broadcast(m), "feature").groupBy("unit_id", "ours").agg((F.sum("count") / F.first("n_sources")).alias("value"))      # m: one row per declared source
    ours = F.array(*[F.struct(F.lit(o).alias("ours"), F.lit(bool(v)).alias("present")) for o, v in mapping.items()])
    grid = units.select("unit_id", F.inline(ours))
    j = grid.join(g, ["unit_id", "ours"], "left")
    return j.withColumn("value", F.when(F.col("present"), F.coalesce(F.col("value"), F.lit(0.0))))


def symbol_to_id_unique(features: DataFrame, symbol: str, fid: str, line: str) -> DataFrame:
    """alias -> id: the first use of a symbol is bare, its k-th repeat is SYMBOL.k and SYMBOL-k; an alias that two
    features share fails. A feature file is read, so a symbol has few lines."""
    w = Window.partitionBy(symbol).orderBy(line)
    d = features.withColumn("__k", F.row_number().over(w) - 1)
    k = F.col("__k").cast("string")
    alias = F.when(F.col("__k") == 0, F.array(F.col(symbol))).otherwise(F.array(F.concat_ws(".", F.col(symbol), k), F.concat_ws("-", F.col(symbol), k)))
    a = d.select(F.explode(alias).alias("alias"), F.col(fid).alias("id"))
    g = a.groupBy("alias").agg(F.count_distinct("id").alias("__n"), F.min("id").alias("id"))
    ok = F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("name clash: "), F.col("alias"))).cast("boolean"))
    return g.where(ok).drop("__n")


def two_source_id_map(features: DataFrame, reference: DataFrame, vocab: DataFrame) -> DataFrame:
    """symbol -> id and its source. The reference id if it is in the vocabulary or the file's own is not; else the
    file's own id if in the vocabulary; else none. features: symbol, own_id; reference: symbol, ref_id; vocab: id."""
    v = vocab.select("id").distinct()
    d = (features.join(reference, "symbol", "left")
         .join(v.select(F.col("id").alias("ref_id"), F.lit(True).alias("__r")), "ref_id", "left")
         .join(v.select(F.col("id").alias("own_id"), F.lit(True).alias("__o")), "own_id", "left"))
    r, o = F.coalesce(F.col("__r"), F.lit(False)), F.coalesce(F.col("__o"), F.lit(False))
    take_ref = F.col("ref_id").isNotNull() & (r | ~o)
    return d.select("symbol", F.when(take_ref, F.col("ref_id")).when(o, F.col("own_id")).alias("id"),
                    F.when(take_ref, "reference").when(o, "file").otherwise("none").alias("source"))


def id_map_coverage(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def disjointness_check(evaluated: DataFrame, fit: DataFrame) -> DataFrame:
    """Evaluated units and groups that occur among the fit rows; both counts must be 0."""
    u = evaluated.select("unit_id").join(fit.select("unit_id"), "unit_id", "left_semi").agg(F.count(F.lit(1)).alias("n_units"))
    g = evaluated.select("group_id").distinct().join(fit.select("group_id"), "group_id", "left_semi").agg(F.count(F.lit(1)).alias("n_groups"))
    return u.withColumn("n_groups", g.scalar()).withColumn("passed", (F.col("n_units") == 0) & (F.col("n_groups") == 0))
