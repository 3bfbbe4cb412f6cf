"""The pipeline's stages, each against what its operator says, and its registered queries."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from quarry.llm import decontaminate, ngram_join, stages, toxicity
from quarry.llm.common import stored, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    repeated = docs.union(docs.limit(3)).union(docs.limit(2).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "lang", "source", "n_chars"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, repeated, sf)
        assert out.columns == columns and 0 < out.count() <= repeated.count(), name
        assert stage(spark, docs.limit(0), sf).count() == 0
    kept = stages.one_of_each_group(spark, repeated, sf)
    firsts = {r.doc_id for r in ngram_join.near_duplicates(docs).where("doc_id = component_id").collect()}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(firsts)
    assert kept.where("doc_id is null").count() == 2
    hits = {r.doc_id for r in decontaminate.find_contamination(docs, table(spark, sf, "benchmark")).collect()}
    clean = {r.doc_id for r in stages.without_benchmark(spark, docs, sf).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - hits


#: Columns whose names stages use inside, or that need quoting.
CLASH = ("odd_id", "own_id", "fp", "kept_fp", "label", "row", "order", "Rows", "a`b", "x.y", "_fp", "component_id")


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated ids and rows, near copies, a benchmark passage, clashing columns."""
    rng = random.Random(3)
    say = lambda n, k: " ".join(f"{k}{rng.randint(0, 400)}" for _ in range(n))
    base = say(80, "w").split()
    near = [*base[:40], "other", *base[41:]]
    item = say(30, "item")
    rows = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base).upper()), (3, " ".join(base).upper()), (3, say(50, "z")), (4, None), (5, ""), (5, ""), (None, None), (None, " ".join(base)),
        (6, say(60_000, "v")), (7, say(40, "t") + " " + item + " " + say(40, "t")), (8, say(20, "q") + " vile scum " + say(20, "q")), (9, say(30, "c")), (9, say(30, "c")), (-4, "\u0130 \U0001d518 \x00 short"),
    ]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n_chars long").repartition(3)
    for k, name in enumerate(CLASH):
        docs = docs.withColumn(name, F.lit(k) if k % 2 else F.concat(F.lit("c"), F.col("doc_id").cast("string")))
    return docs, item


def keyed(rows):
    return Counter(tuple(map(str, r)) for r in rows)


def test_stages_keep_odd_rows(spark, tmp_path, monkeypatch):
    docs, item = odd_documents(spark)
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, int(k == 8)) for k in range(1, 10)] + [(None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    whole = docs.collect()
    for stage in (stages.reject_toxic, stages.one_of_each_group, stages.without_benchmark):
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and not keyed(out.collect()) - keyed(whole)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    # A model that knows two words: the stage and the operator reject the same row.
    model = toxicity.Model(scores={"vile": 6.0, "scum": 6.0}, other=-1.0, lam=1.0, k=0.01, weights=(-3.0, 3.0, 1.0))
    monkeypatch.setattr(stages.toxicity, "fit", lambda *_: model)
    kept = stages.reject_toxic(spark, docs, str(tmp_path)).collect()
    assert keyed(kept) == keyed(r for r in whole if r.doc_id != 8)
    # One row of each group, by hand: 1, 2 and 3 are near copies; the third text of id 3 is its own.
    kept = stages.one_of_each_group(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for k, r in enumerate(sorted(whole, key=lambda r: r.n_chars)) if k not in (1, 2, 3, 7))
    assert [r.n_chars for r in kept if r.doc_id == 5] == [6]  # of rows alike the least by all columns
    kept = stages.without_benchmark(spark, docs, str(tmp_path)).collect()
    assert keyed(kept) == keyed(r for r in whole if r.doc_id != 7)
    pieces = stages.packed(spark, docs, str(tmp_path)).collect()
    tokens = {r.doc_id: r.doc_tokens for r in pieces if r.doc_id in (1, 2, 4, 6, 7, 8)}
    assert tokens[4] == 1 and tokens[6] > 100_000
    for d, n in tokens.items():
        assert sum(r.length for r in pieces if r.doc_id == d) == n
    assert stages.packed(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run(spark, sf):
    """The pipeline's packed documents are those that every stage's own operator leaves."""
    packed = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    clean = docs.join(toxicity.score_documents(docs, model).where("predicted = 0").select("doc_id"), "doc_id").select(*docs.columns)
    clean = stored(clean)
    firsts = clean.join(ngram_join.near_duplicates(clean).where("doc_id = component_id").select("doc_id"), "doc_id")
    hits = {r.doc_id for r in decontaminate.find_contamination(firsts, table(spark, sf, "benchmark")).collect()}
    assert packed == {r.doc_id for r in firsts.collect()} - hits and packed


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and {int(k[2:].split("_")[0]) for k in names if k.startswith("op") and k[2].isdigit()} == set(range(1, 11))
    assert e.oracle_sql().keys() <= names.keys()


def test_texts_of_a_repeated_id_are_judged_one_by_one(spark, sf):
    text = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [(1, text("a")), (2, text("b")), (2, text("a")), (3, text("c")), (3, text("d")), (3, text("d")), (4, text("d")), (5, ""), (5, text("e")), (None, text("a"))]
    docs = spark.createDataFrame([(k, t, k) for k, t in rows], "doc_id long, text string, n long")
    kept = stages.one_of_each_group(spark, docs, sf)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text) for r in kept.collect()))
    assert got == sorted([(0, text("a")), (1, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (5, ""), (5, text("e"))])
