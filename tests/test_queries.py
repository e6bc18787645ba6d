"""Registered queries against their SQL. A short list runs by default; ALL_QUERIES=1 runs every one."""
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from check_oracle import compare, connect  # noqa: E402
from strataspark.plans import catalogue  # noqa: E402

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
SHORT = ["counts_long_filtered", "table_profile", "donor_site_split", "gate_per_batch", "agreement_report", "selective_accuracy", "accuracy_at_matched_coverage", "knn_within_group", "gap_ratio",
         "decision_under_edit", "bootstrap_two_stage", "marker_share_null", "unexplained_fraction", "arms_family", "contrast_arms", "ledger_rules", "poison_invariance",
         "read_mtx_long", "read_events_jsonl", "counts_integrity", "map_to_vocab", "select_treated_control", "id_regex_share", "random_fourier_features", "median_scaled", "donor_eligibility", "nested_draw", "bootstrap_cluster", "auroc", "threshold_otsu", "pool_closure", "heterogeneity_q", "hypothesis_test",
         "thin_counts", "distinguishable_counts", "conflict_classes", "svd_components", "linear_field_score"]
NAMES = sorted(catalogue.QUERIES) if os.environ.get("ALL_QUERIES") else SHORT


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        assert compare(got, con.execute(catalogue.ORACLES[name]).df()) == ""


def test_every_oracle_has_its_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 200


def test_entry(spark):
    import __spark_entry__ as e
    assert set(e.queries()) >= set(catalogue.QUERIES) and set(e.oracle_sql()) >= set(catalogue.ORACLES)
    if os.path.isdir(e.SMOKE_DIR):
        assert e.entry(spark).count() > 0


def test_fits_run_from_any_folder(tmp_path):
    """Their Python stages get the package from the session, not from the folder that the driver runs in."""
    import subprocess
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    code = f"import sys; sys.path.insert(0, {ROOT!r}); from strataspark.session import local_session; from strataspark.plans import catalogue; print('rows', catalogue.QUERIES['ridge'](local_session('2'), {SF!r}).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout and int(done.stdout.split("rows")[1]) > 0, done.stderr[-2000:]


def test_units_without_lines_have_no_key(spark, tmp_path):
    """label_map_strict lists the units of its SQL: not those without any order."""
    import shutil
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    for t in ("customer", "nation", "region", "lineitem", "part"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    connect(SF).execute(f"COPY (SELECT * FROM orders WHERE o_custkey <> (SELECT min(o_custkey) FROM orders)) TO '{tmp_path}/orders.parquet'")
    got = catalogue.QUERIES["label_map_strict"](spark, str(tmp_path)).toPandas()
    assert compare(got, connect(str(tmp_path)).execute(catalogue.ORACLES["label_map_strict"]).df()) == ""


def test_shares_do_not_depend_on_the_order_of_rows(spark):
    from pyspark.sql import functions as F
    from strataspark.operators import prepare as P
    d = spark.range(1, 400).select(F.lit(1).alias("unit_id"), F.format_string("f%03d", "id").alias("feature"), F.when(F.col("id") == 1, F.log1p(F.lit(1e16))).otherwise(F.log1p(F.lit(1.0))).alias("stored"))
    one, two = (P.panel_free_shares(d.coalesce(1).sortWithinPartitions(F.col("feature").desc() if x else F.col("feature")), ["none"]).select("feature", "w").collect() for x in (0, 1))
    assert sorted(one) == sorted(two)


def test_response_needs_no_fit(spark, con, monkeypatch):
    """The frozen output is given; no scope has to be fitted for the response."""
    from strataspark.operators import scope

    def fitted(*a, **k):
        raise AssertionError("a scope was fitted")
    monkeypatch.setattr(scope, "scope_predict", fitted)
    got = catalogue.QUERIES["response"](spark, SF).toPandas()
    assert compare(got, con.execute(catalogue.ORACLES["response"]).df()) == ""


def test_forecast_ceilings_keep_one_row_a_unit(spark, monkeypatch):
    """Arms, targets and draws lie in the row of a unit: no stored table has a row for each of them."""
    from strataspark.operators import fit, ranking, resample, scope
    from strataspark.plans.audit_queries import donor_rows
    from strataspark.plans.bindings import Inputs
    sf = os.path.join(os.path.dirname(SF), "sf0.01")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    sizes, store = [], scope.checkpointed

    def counted(df):
        d = store(df)
        sizes.append(d.count())
        return d
    for m in (fit, ranking, resample, scope):
        monkeypatch.setattr(m, "checkpointed", counted)
    units = donor_rows(Inputs(spark, sf)).count()
    got = catalogue.QUERIES["forecast_ceilings"](spark, sf).toPandas()
    assert compare(got, connect(sf).execute(catalogue.ORACLES["forecast_ceilings"]).df()) == ""
    # 10 a unit for the outputs of the arms; the donors' cross products do not grow with the units
    assert units <= max(sizes) < 5 * units
