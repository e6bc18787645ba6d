"""The pipeline stage by stage on planted documents, and its registration."""

import corpus_pipeline
from conftest_llm import frame, words
from test_corpus_jobs import brute_contamination, brute_near


def planted(rng):
    base, item = words(rng, 120), words(rng, 25)
    rows = [(i, words(rng, rng.randint(20, 200), ("aa", "bb")[i % 2]), ("aa", "bb")[i % 2]) for i in range(60)]
    rows += [(100, base, "aa"), (101, base, "aa"), (102, base + " more", "aa"), (103, f"{words(rng, 30)} {item} {words(rng, 30)}", "aa"), (104, words(rng, 40) + " password=abcdef123456 " + words(rng, 5), "aa"), (105, None, "aa"), (106, "123 456", None), (107, "", None)]
    return rows, [(1, item)]


def test_stages(spark, rng, tmp_path):
    rows, items = planted(rng)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, rows)
    columns = docs.columns
    alive = {i: t for i, t, *_ in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(alive)
            break
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id: r for r in docs.collect()}
        if name == "language":
            alive = {i: t for i, t in alive.items() if i not in (105, 106, 107)}
        elif name == "near_duplicates":
            near = brute_near(alive.items(), 80)
            alive = {i: t for i, t in alive.items() if near[i][2]}
            assert 100 in alive and not {101, 102} & set(alive)
        elif name == "decontamination":
            bad = brute_contamination(alive.items(), items)
            alive = {i: t for i, t in alive.items() if not bad[i][0][4]}
            assert 103 not in alive
        elif name == "secrets":
            alive[104] = alive[104].replace("password=abcdef123456", "[SECRET]")
            assert got[104].n_chars == len(alive[104])
        assert docs.columns == columns and {i: r.text for i, r in got.items()} == alive, (k, name)


def test_run_and_empty(spark, rng, tmp_path):
    rows, items = planted(rng)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {i for i, *_ in rows} - {101, 102, 103, 105, 106, 107}
    docs = frame(spark, rows).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, str(tmp_path))
        assert docs_out.count() == 0, name


def test_language_stage_without_labels(spark, rng):
    rows = [(1, words(rng, 30), None), (2, "1 a", None), (3, "123 456", None), (4, "", None), (5, None, None), (6, "привет", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()} == {1, 2, 6}


def test_registered():
    import __spark_entry__ as e
    names = e.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
