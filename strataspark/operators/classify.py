"""Row classification: gates from clause data, keys, scores, calls, margins, re-decisions."""
from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def _all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)


# ---- predicates and labels
def split_by_modality(df: DataFrame, column: str, rna: str = fixed.RNA_PATTERN, adt: str = fixed.ADT_PATTERN) -> DataFrame:
    """'rna' / 'adt' / NULL by case-insensitive patterns"""
    c = F.col(column)
    return df.withColumn("modality", F.when(c.rlike(f"(?i){rna}"), "rna").when(c.rlike(f"(?i){adt}"), "adt"))


def first_present_column(df: DataFrame, candidates: list[str], out: str) -> DataFrame:
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of the columns {candidates} is present")
    return df.withColumn(out, F.col(found).cast("string"))


def is_high(value: Column, threshold: Column) -> Column:
    """Strictly above; missing (NULL or NaN) is never high."""
    v = value.cast("double")
    return F.coalesce((v > threshold) & ~F.isnan(v), F.lit(False))


def high_flags(wide: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    return wide.select("unit_id", *[is_high(F.col(f), F.lit(float(t))).alias(f"h_{f}") for f, t in thresholds.items()])


def reduced_gate(rules: list[dict], present: list[str]) -> list[dict]:
    """Conditions on absent features are removed; a rule that can no longer pass (an absent all-high
    feature, an empty any-of set, too few count features) is dropped."""
    have, out = set(present), []
    for r in rules:
        q = {"label": r["label"]}
        dead = False
        if "all_high" in r:
            q["all_high"] = r["all_high"]
            dead |= not have.issuperset(r["all_high"])
        if "any_high" in r:
            q["any_high"] = [f for f in r["any_high"] if f in have]
            dead |= not q["any_high"]
        if "count_high" in r:
            fs = [f for f in r["count_high"]["features"] if f in have]
            q["count_high"] = {"features": fs, "min": r["count_high"]["min"]}
            dead |= len(fs) < r["count_high"]["min"]
        if "none_high" in r:
            q["none_high"] = [f for f in r["none_high"] if f in have]
        if not dead:
            out.append(q)
    return out


def gate(rules: list[dict], default: str = "OUT", prefix: str = "h_") -> Column:
    """First matching rule of a declared gate over boolean high flags."""
    h = lambda f: F.col(f"{prefix}{f}")
    out = None
    for r in rules:
        parts = [h(f) for f in r.get("all_high", [])] + [~h(f) for f in r.get("none_high", [])]
        if r.get("any_high"):
            parts.append(_any([h(f) for f in r["any_high"]]))
        if r.get("count_high"):
            parts.append(reduce(lambda a, b: a + b, [h(f).cast("int") for f in r["count_high"]["features"]]) >= r["count_high"]["min"])
        cond = _all(parts) if parts else F.lit(True)
        out = F.when(cond, r["label"]) if out is None else out.when(cond, r["label"])
    return out.otherwise(default)


def gate_per_batch(long: DataFrame, batch_of: DataFrame, thresholds: DataFrame, features: list[str], rules: list[dict],
                   value: str = "measured", default: str = "OUT") -> DataFrame:
    """The gate with (batch, feature) thresholds: flags on the long table, then one row per unit."""
    d = long.join(batch_of.select("unit_id", "batch"), "unit_id").join(thresholds, ["batch", "feature"], "left")
    flags = [F.coalesce(F.bool_or(F.when(F.col("feature") == f, is_high(F.col(value), F.col("threshold")))), F.lit(False)).alias(f"h_{f}") for f in features]
    return d.groupBy("unit_id", "batch").agg(*flags).select("unit_id", "batch", gate(rules, default).alias("gated"))


def map_expr(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*mapping.items())])


def label_map(df: DataFrame, column: str, mapping: dict[str, str], out: str) -> DataFrame:
    """Strict map: a label without a class fails the job."""
    c = map_expr(mapping)[F.col(column)]
    return df.withColumn(out, F.coalesce(c, F.raise_error(F.concat(F.lit("label without a class: "), F.col(column))).cast("string")))


def keyword_label(column: str, rules: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """First rule whose keyword occurs in the lower-cased label."""
    c, out = F.lower(F.col(column)), None
    for label, words in rules:
        cond = _any([c.contains(w) for w in words])
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(other)


def map_to_vocab(features: DataFrame, vocab: DataFrame, strip_version: bool = False, min_mapped: int = 100) -> DataFrame:
    """(feature, id, n_as_is, n_stripped) of features in the vocabulary, compared as they are or, where ``strip_version``
    is declared, without their version suffix. Both numbers of hits are reported; fewer than ``min_mapped`` hits of
    the declared kind fail the job. Spark picks the joins."""
    v = vocab.select("id").distinct()
    bare = F.split("feature", "\\.")[0]
    hits = lambda c: features.select("feature", c.alias("id")).join(v, "id", "left_semi")
    n1 = hits(F.col("feature")).agg(F.count(F.lit(1)).alias("n")).scalar()
    n2 = hits(bare).agg(F.count(F.lit(1)).alias("n")).scalar()
    enough = (n2 if strip_version else n1) >= min_mapped
    pick = F.when(enough, bare if strip_version else F.col("feature")).otherwise(F.raise_error(F.lit("too few features map to the vocabulary")).cast("string"))
    return features.select("feature", pick.alias("id")).join(v, "id", "left_semi").withColumn("n_as_is", n1).withColumn("n_stripped", n2)


def target_from_guides(guides: str, pattern: str, controls: list[str], sep: str = ";") -> Column:
    """'' if no guide; 'control' if every guide is a control; the gene if all others hit one gene; '' if two."""
    parts = F.filter(F.transform(F.split(F.col(guides), sep), lambda x: F.trim(x)), lambda x: x != "")
    gene = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")), x)
    others = F.array_distinct(F.transform(F.filter(parts, lambda x: ~x.isin(controls)), gene))
    return (F.when(F.coalesce(F.size(parts), F.lit(0)) < 1, "").when(F.size(others) == 0, "control")
             .when(F.size(others) == 1, others[0]).otherwise(""))


def select_treated_control(df: DataFrame, target: str, treated: list[str], treated_pattern: str | None, control: list[str],
                           strata: dict[str, list[str]] | None = None) -> DataFrame:
    """a = 1 / 0 rows; cluster = target for treated rows and the unit itself for controls."""
    t = F.col(target)
    is_t = t.isin(treated)
    if treated_pattern:
        is_t = is_t | t.rlike(f"^(?:{treated_pattern})")
    is_c = t.isin(control)
    d = df.withColumn("a", F.when(is_c, 0).when(is_t, 1)).where(F.col("a").isNotNull())
    for c, allowed in (strata or {}).items():
        d = d.where(F.col(c).isin(allowed))
    return d.withColumn("cluster", F.when(F.col("a") == 1, t).otherwise(F.concat(F.lit("unit:"), F.col("unit_id").cast("string"))))


def registered_split_filter(units: DataFrame, split: list[str] | None = None, sites: list[str] | None = None,
                            groups: list[str] | None = None) -> DataFrame:
    """Units whose split, site and group are all in the declared lists."""
    d = units
    for c, v in (("split", split), ("site", sites), ("group_id", groups)):
        if v is not None:
            d = d.where(F.col(c).isin(v))
    return d


def donor_overlap(units: DataFrame) -> DataFrame:
    """Groups of the test split: 'secondary' when they also occur in train, else 'primary'."""
    test = units.where("split = 'test'").select("group_id").distinct()
    train = units.where("split = 'train'").select("group_id").distinct().withColumn("__t", F.lit(True))
    return test.join(train, "group_id", "left").select("group_id", F.when(F.col("__t"), "secondary").otherwise("primary").alias("role"))


def final_units_guard(run_units: DataFrame, final_units: DataFrame, is_final: bool, hypotheses: list[str]) -> DataFrame:
    """Units set aside for a final audit that occur in the run; allowed only in a declared final run with hypotheses."""
    hit = run_units.join(final_units.select("unit_id"), "unit_id", "left_semi")
    ok = bool(is_final and hypotheses)
    return hit.agg(F.count(F.lit(1)).alias("n_final_units")).withColumn("allowed", (F.col("n_final_units") == 0) | F.lit(ok))


# ---- keys
def agreement(a: str, b: str) -> Column:
    return F.when(F.col(a) == F.col(b), F.col(a)).otherwise("unscored")


def agreement_variants(df: DataFrame, annot: str, gated: str, label: str, excluded: list[str]) -> DataFrame:
    """key (agreement), key_annotation (annotation alone), key_excluding (one label made unscored)"""
    key = agreement(annot, gated)
    return df.select("*", key.alias("key_agreement"), F.col(annot).alias("key_annotation"),
                     F.when(F.col(label).isin(excluded), "unscored").otherwise(key).alias("key_excluding"))


def question_key(key: str, label: str, cls: str, kept: list[str], turned_out: list[str], anchor_high: Column) -> Column:
    """Key under a changed question: ``cls`` is kept only with a kept label and a high anchor, becomes OUT with
    a turned-out label and no high anchor, and is unscored otherwise; other classes keep their key."""
    k, t = F.col(key), F.col(label)
    return (F.when(k != cls, k).when(t.isin(kept) & anchor_high, cls).when(t.isin(turned_out) & ~anchor_high, "OUT").otherwise("unscored"))


# ---- scores and calls
def class_scores(evidence: DataFrame, panel: dict[str, list[str]], value: str = "v") -> DataFrame:
    """Equal-weight mean of the evidence over each class panel, one column per class; absent evidence is 0.
    The panel is a literal map, so the whole step is one partial + final aggregate by unit."""
    if any(not fs for fs in panel.values()):
        raise ValueError("a class has an empty panel")
    f = F.col("feature")
    return evidence.groupBy("unit_id").agg(*[(F.coalesce(F.sum(F.when(f.isin(fs), F.col(value))), F.lit(0.0)) / len(fs)).alias(c) for c, fs in panel.items()])


def reduced_panel(panel: dict[str, list[str]], present: list[str]) -> dict[str, list[str]]:
    """Panel restricted to the present features; a class left without any fails."""
    out = {c: [f for f in fs if f in set(present)] for c, fs in panel.items()}
    if any(not v for v in out.values()):
        raise ValueError("a class has no present panel feature")
    return out


def top_score(classes: list[str]) -> Column:
    return F.greatest(*[F.col(c) for c in classes])


def scores_array(classes: list[str]) -> Column:
    return F.array(*[F.col(c) for c in classes])


def argmax_class(classes: list[str]) -> Column:
    """First class in class order among the largest scores."""
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(scores_array(classes), top_score(classes)).cast("int"))


def sorted_scores(classes: list[str]) -> Column:
    return F.sort_array(scores_array(classes), asc=False)


def margin(classes: list[str]) -> Column:
    s = sorted_scores(classes)
    return s[0] - s[1]


def argmax_call(classes: list[str], bar: float | Column, min_margin: float | None = None) -> Column:
    """Class with the largest score when it reaches ``bar`` (and its lead reaches ``min_margin``), else ''."""
    ok = top_score(classes) >= (bar if isinstance(bar, Column) else F.lit(float(bar)))
    if min_margin is not None:
        ok = ok & (margin(classes) >= F.lit(float(min_margin)))
    return F.when(ok, argmax_class(classes)).otherwise("")


def expected_label(classes: list[str], min_margin: float) -> Column:
    """Top class of the measured scores when its lead reaches the margin, else NULL."""
    return F.when(margin(classes) >= F.lit(float(min_margin)), argmax_class(classes))


def signed_margin(classes: list[str], fixed: Column) -> Column:
    """Score of a fixed class minus the best other score."""
    own = F.coalesce(*[F.when(fixed == c, F.col(c)) for c in classes])
    other = F.greatest(*[F.when(fixed != c, F.col(c)) for c in classes])
    return own - other


def tied_top(classes: list[str]) -> Column:
    top = top_score(classes)
    return F.size(F.filter(scores_array(classes), lambda x: x == top)) > 1


def entropy_confidence(classes: list[str]) -> Column:
    """1 - H(q) / log K with q = S / sum S; a zero sum is the uniform case (0)."""
    s = F.transform(scores_array(classes), lambda x: F.greatest(x, F.lit(0.0)))
    tot = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    h = F.aggregate(s, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / tot * F.log(x / tot)).otherwise(0.0))
    return F.when(tot > 0, 1 - h / F.log(F.lit(float(len(classes))))).otherwise(0.0)


# ---- perturbed cases
def lost(base: str, pert: str, key: str) -> Column:
    return (F.col(base) != "") & (F.col(base) == F.col(key)) & (F.col(pert) != F.col(key))


def lost_label(probe: str, argmax: str, key: str) -> Column:
    """Where the right answer was lost: representation, head or decision (first that is wrong)."""
    return F.when(F.col(probe) != F.col(key), "representation").when(F.col(argmax) != F.col(key), "head").otherwise("decision")


def pair_class(flags: list[tuple[str, Column]], other: str = "other") -> Column:
    out = None
    for name, cond in flags:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(other)


def nudge_class(up: Column, down: Column, half_up: Column, half_down: Column) -> Column:
    """G4 asymmetric in the response to +-eps or +-eps/2; G3 flips at half a step; G2 at a full step; G1 never."""
    return (F.when((up != down) | (half_up != half_down), "G4").when(half_up & half_down, "G3").when(up & down, "G2").otherwise("G1"))
