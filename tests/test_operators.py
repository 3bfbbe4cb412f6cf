"""Operators on small fixtures with known results."""

import math
import os
from datetime import date, datetime
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import huffman_codes, lzw_codes, lzw_text, stemmed
from quarry.operators import frame, mining, models, relational, stats, text, vector
from quarry.plans import QUERIES, surface
from quarry.sources import sinks, tables
from quarry.streaming import windows

#: Ten baskets of own making: apple in 6, pear in 5, plum in 4, fig in 3; apple with pear in 4, apple with plum in 2.
BASKETS = ["apple,pear", "apple,pear,plum", "apple,pear,fig", "apple,pear", "apple,plum", "apple,kiwi", "pear", "plum,fig", "plum", "fig,kiwi"]


def test_association_rules(spark):
    baskets = spark.createDataFrame(list(enumerate(BASKETS)), "basket int, line string").select("basket", F.explode(F.split("line", ",")).alias("item"))
    sets = {tuple(r["items"]): r.support for r in mining.frequent_itemsets(baskets, 0.2).collect()}
    assert sets == {("apple",): 0.6, ("pear",): 0.5, ("plum",): 0.4, ("fig",): 0.3, ("kiwi",): 0.2, ("apple", "pear"): 0.4, ("apple", "plum"): 0.2}
    rules = {(tuple(r.antecedent), tuple(r.consequent)): r for r in mining.association_rules(mining.frequent_itemsets(baskets, 0.1), 0.1).collect()}
    r = rules[("apple",), ("pear",)]  # 4 of 6; over 5 of 10; (1 - .5) / (1 - 2/3)
    assert math.isclose(r.confidence, 2 / 3) and math.isclose(r.lift, 4 / 3) and math.isclose(r.conviction, 1.5)
    assert (("apple",), ("pear", "plum")) in rules


def test_building_roll_up(spark):
    """Two floors: areas 30 and 60, volumes 100 and 80; light 12 / 30 and 30 / 60, energy 50 / 100 and 20 / 80."""
    rooms = [("b", 1, 10.0, 40.0, 4.0, 20.0), ("b", 1, 20.0, 60.0, 8.0, 30.0), ("b", 2, 60.0, 80.0, 30.0, 20.0)]
    df = spark.createDataFrame(rooms, "building string, floor int, a double, v double, l double, e double")
    r = stats.roll_up_tree(df, "building", "floor", "a", "v", "l", "e").first()
    assert (r.area, r.volume) == (90, 180) and math.isclose(r.light, 0.45) and math.isclose(r.energy, 0.375)


def test_band_join_equals_nested_loop(spark):
    left = spark.range(200).select((F.col("id") / 3.0).alias("x"))
    right = spark.range(40).select(F.col("id").alias("b"), (F.col("id") * 1.5 - 3).alias("lo"), (F.col("id") * 1.5 + F.col("id") % 7).alias("hi"))
    got = relational.band_join(left, right, "x", "lo", "hi", 2.0).select("x", "b")
    want = left.crossJoin(right).where("x between lo and hi").select("x", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_violations_and_cascade(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "a", None), (3, "c", -5)], "k int, name string, x int")
    other = spark.createDataFrame([(1,), (2,)], "k int")
    got = {r["constraint"]: r["rows"] for r in relational.violations(df, ["name"], ["x"], {"x": F.col("x") > 0}, {"k": (other, "k")}).collect()}
    assert got == {"unique name": 2, "not null x": 1, "check x": 1, "foreign key k": 1}


def test_hierarchy_depth_first(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 5)], "n int, p int")
    rows = relational.hierarchy(nodes, "n", "p").orderBy("path").collect()
    assert [(r.n, r.level) for r in rows] == [(1, 1), (2, 2), (4, 3), (3, 2)]


def test_sequence_is_gapless(spark):
    got = relational.next_values(spark.range(500).repartition(7), ["id"], "number", 5, 2).orderBy("id").collect()
    assert [r.number for r in got] == [5 + 2 * k for k in range(500)]


def test_scaling_a_constant_gives_null(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r.s for r in frame.scaled(df, "x", "s").collect()] == [None, None]


def test_codecs_round_trip():
    for t in ("", "a", "abababababa", "żółć " * 50, "x" * 3000):
        assert lzw_text(lzw_codes(t)) == t
    codes = huffman_codes({"a": 5, "b": 2, "c": 1})
    assert sorted(map(len, codes.values())) == [1, 2, 2] and len(codes["a"]) == 1
    assert huffman_codes({"z": 9}) == {"z": "0"}


def test_nearest_words_equals_all_pairs(spark):
    words = spark.createDataFrame([("cat",), ("hose",), ("zzzzz",), ("a",)], "word string")
    vocabulary = spark.createDataFrame([("cart",), ("house",), ("horse",), ("at",), ("b",)], "word string")
    got = {r.word: (r.distance, r.nearest) for r in text.nearest_words(words, vocabulary).collect()}
    assert got == {"cat": (1, "at"), "hose": (1, "horse"), "a": (1, "at")}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;x\n1;2,5\n2;oops\n")
    df = tables.read_delimited(spark, str(tmp_path / "a.csv"), "k int, x string", sep=";").select("k", tables.decimal_comma(F.col("x")).alias("x"))
    assert sorted(map(tuple, df.collect())) == [(1, 2.5), (2, None)]
    (tmp_path / "b.txt").write_text("milk, bread\n\neggs\n")
    assert sorted(r["items"] for r in tables.read_transactions(spark, str(tmp_path / "b.txt")).collect()) == [[], ["eggs"], ["milk", "bread"]]
    (tmp_path / "v.txt").write_text("king 1 2.5\nqueen 3 x\n")
    assert {r.word: r.vector for r in tables.read_word_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"king": [1.0, 2.5], "queen": [3.0, None]}
    lines = spark.createDataFrame([(1, "[one]"), (2, "a=1"), (3, "b = x=y"), (4, "[two]"), (5, "a=2"), (6, "note")], "line int, value string")
    assert sorted((r.section, r.key, r.value) for r in tables.read_sections(lines).collect()) == [("one", "a", "1"), ("one", "b", "x=y"), ("two", "a", "2")]
    name, number = tables.name_and_number(F.col("value"))
    one = spark.createDataFrame([("Max Power 33",), ("None",)], "value string").select(name.alias("n"), number.alias("k")).collect()
    assert [tuple(r) for r in one] == [("Max Power", 33), ("None", None)]
    page = spark.createDataFrame([("<p>a &lt;b&gt;</p><script>x</script><!-- c -->d",)], "h string").select(tables.html_text(F.col("h")).alias("t")).first()
    assert page.t == "a <b> d"


def test_streaming_windows_equal_batch(spark, sf, tmp_path):
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").write_bytes(open(path, "rb").read())
    stream = windows.windowed_counts(windows.read_event_stream(spark, str(tmp_path / "in"), schema), "1 day", late="1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = windows.windowed_counts(windows.with_event_time(spark.read.parquet(path)), "1 day")
    key = lambda r: (r.window_start, r.event_type, r.n)
    assert sorted(map(key, spark.table("daily").collect())) == sorted(map(key, batch.collect()))


def test_audit_log(spark, sf, tmp_path):
    path = f"{sf}/events.parquet"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").write_bytes(open(path, "rb").read())
    stream = windows.read_event_stream(spark, str(tmp_path / "in"), spark.read.parquet(path).schema)
    windows.append_audit(stream, str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == spark.read.parquet(path).count()


def test_parameter_types(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 1.0)], "d date, x double")
    assert frame.numeric_columns(df) == ["x"]


@pytest.mark.parametrize("label, score, auc", [([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75), ([0, 1], [0.5, 0.5], 0.5)])
def test_roc_auc(spark, label, score, auc):
    df = spark.createDataFrame(list(zip(label, score, strict=True)), "y int, s double")
    assert stats.roc_auc(df, "y", "s").first().auc == auc


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_in_blocks(spark, metric):
    rows = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id"), (F.col("id") % 7).cast("double")).alias("embedding"))
    whole = vector.nearest(rows, rows, 4, metric).collect()
    assert len(whole) == 240
    blocks = vector.nearest(rows, rows, 4, metric, most_queries=7, block_rows=11).select(*whole[0].asDict()).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, whole))


def test_nearest_words_of_every_word(spark):
    words = spark.createDataFrame([("cat",), ("hose",), ("zzzzz",), ("a",), ("houses and",)], "word string")
    vocabulary = spark.createDataFrame([("cart",), ("house",), ("horse",), ("at",), ("b",)], "word string")
    got = {(r.word, r.nearest, r.distance) for r in text.nearest_words(words, vocabulary, every=True).collect()}
    assert got == {("cat", "at", 1), ("hose", "horse", 1), ("a", "at", 1), ("zzzzz", "at", 5), ("houses and", "house", 5)}


def test_language_is_fitted_on_all_ids(spark, tmp_path):
    rows = [(k, "alpha beta gamma " * 5 if k % 2 else "opus ruit dolor " * 5, "aa" if k % 2 else "bb") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["model_language"](spark, str(tmp_path)).collect()
    assert len(got) == 40 and all(r.predicted == r.lang for r in got)


def test_queries_keep_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    for name, table in (("influence", "part"), ("orderby_sub_rewrite", "customer")):
        assert QUERIES[name](spark, sf).count() == tables.load(spark, sf, table).count()
    assert QUERIES["word_ngrams"](spark, sf).where("n <= 5").count() > 0


def test_itemsets_of_all_sizes(spark):
    rows = spark.createDataFrame([(b, x) for b in range(4) for x in "abcde"] + [(9, "a")], "basket int, item string")
    sets = mining.frequent_itemsets(rows, 0.5)
    assert sorted("".join(r["items"]) for r in sets.collect()) == sorted("".join(c) for k in range(1, 6) for c in combinations("abcde", k))
    assert mining.association_rules(sets, 0.1).where("size(antecedent) + size(consequent) = 5").count() == 30


def test_density_clusters_of_a_long_chain(spark):
    points = spark.range(120).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert {r.cluster for r in models.density_clusters(points, 1.0, 2).collect()} == {0}


def test_running_total_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 5).alias("v")).repartition(7)
    got = {r.k: r.upto for r in relational.running_total(rows, ["k"], F.col("v"), "upto").collect()}
    total = 0
    for k, v in sorted((r.k, r.v) for r in rows.collect()):
        total += v
        assert got[k] == total


@pytest.mark.parametrize("one_pass", [10**6, 0])
def test_percentiles(spark, monkeypatch, one_pass):
    monkeypatch.setattr(frame, "ONE_PASS", one_pass)
    monkeypatch.setattr(frame, "BINS", 16)
    rows = spark.range(501).select(F.when(F.col("id") % 10 != 3, F.pow(F.col("id") % 97, F.lit(3))).alias("x"))
    want = rows.agg(F.percentile("x", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.9, 1.0)])).alias("p")).first()["p"]
    assert frame.percentiles(rows, "x", [0.0, 0.25, 0.5, 0.9, 1.0]) == pytest.approx(want)
    assert frame.percentiles(rows.where("x is null"), "x", [0.5]) == [None]


def test_refusals(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "k int, s string, x double")
    with pytest.raises(ValueError):
        frame.projected(df, {"s": 1, "x": 0}, "k")
    with pytest.raises(KeyError):
        frame.without_labels(df, "k", [1, 9])
    with pytest.raises(ValueError):
        relational.guarded_delete(df, "k", df, df, "k")


def test_pairing_keeps_state_between_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    days = [[(1, "in"), (2, "in"), (1, "out")], [(2, "out"), (1, "in")], [(1, "in"), (2, "out"), (1, "out")]]
    n = 0
    for d, events in enumerate(days):
        rows = []
        for user, kind in events:
            n += 1
            rows.append((n, datetime(2024, 1, 1 + d, 0, n), user, kind, 0.0))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"d{d}"))
        (file,) = (tmp_path / f"d{d}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        file.rename(tmp_path / "in" / f"{d}.parquet")
        os.utime(tmp_path / "in" / f"{d}.parquet", (1000 + d, 1000 + d))
    stream = windows.read_event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    got = windows.drained(windows.paired_stream(stream, "in", "out"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted((r.user_id, r.event_id, r.left_at.minute) for r in got.collect()) == [(1, 1, 3), (1, 6, 8), (2, 2, 4)]
    counts = windows.drained(windows.kept_counts(stream), str(tmp_path / "out2"), str(tmp_path / "c2"), "update")
    last = counts.groupBy("event_type").agg(F.max_by("n", "batch").alias("n")).collect()
    assert {r.event_type: r.n for r in last} == {"in": 4, "out": 4}


def test_stems_and_generation(spark):
    words = spark.createDataFrame([(["walks", "walked", "walking", "walk", "is"],)], "w array<string>")
    assert words.select(F.transform("w", stemmed).alias("s")).first().s == ["walk", "walk", "walk", "walk", "is"]
    counts = text.markov_counts(spark.createDataFrame([("abcabcabd",)], "text string"), 2, unit="char")
    assert text.generated(counts, "ab", 5).first().text == "abcabca"


def test_kernel_of_a_cycle_ends(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    edges = spark.createDataFrame([("a", "b"), ("c", "d"), ("d", "c")], "a string, b string")
    assert {r.name for r in surface.kernel(edges, names).collect()} == {"a"}
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(6)], "a string, b string")
    assert {r.name for r in surface.kernel(chain, spark.createDataFrame([(f"n{k}",) for k in range(7)], "name string")).collect()} == {"n0", "n2", "n4", "n6"}


def test_sessions_by_gap_to_the_microsecond(spark):
    at = lambda s, micros: datetime(2024, 1, 1, 10, 0, s, micros)
    rows = [(1, 1, at(0, 900_000)), (2, 1, at(10, 100_000)), (3, 1, at(20, 100_000)), (4, 1, None)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    # 9.2 seconds go on, though whole seconds are 10 apart; 10.0 seconds don't; an event without a time comes last.
    assert [(r.session, r.n) for r in windows.sessions_by_gap(events, 10).orderBy("session").collect()] == [(1, 2), (2, 1), (3, 1)]


def test_packed_records_are_bounded(spark):
    rows = spark.range(0, 1000, numPartitions=3).select((F.col("id") * 7).alias("code"))
    records = sinks.packed_records(rows, F.col("code") % 2, "code", most=50)
    assert records.count() >= 40 and records.agg(F.max(F.octet_length("packed"))).first()[0] <= 4 * 50
    assert sorted(r.c for r in records.select(F.explode(sinks.unpack_codes(F.col("packed"))).alias("c")).collect()) == [7 * k for k in range(1000)]


def test_nearest_of_all_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 60)
    rows = [(k, [float((k * 7 + j * j) % 5) for j in range(6)], "ab"[k % 2]) for k in range(200)]  # many ties
    rows += [(k, [1e-4 * k + j * 1e3 for j in range(6)], "c") for k in range(200, 260)] + [(260, None, "d"), (261, [1e25] * 6, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(5)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.label, r.value) for r in vector.nearest_of_all(df, df, 4, "label").collect()}
    near = vector.nearest(df.where("vec_id < 260"), df.where("embedding is not null"), 4, "euclidean").collect()
    assert len(near) == 260 * 4 and all(got[r.query_id, r["rank"]] == (r.vec_id, r.label, r.value) for r in near)
    assert [got[260, k] for k in (1, 2)] == [(0, "a", None), (1, "b", None)] and len(got) == 262 * 4
    folds = df.where("vec_id < 260").withColumn("fold", F.col("vec_id") % 3)
    other = vector.nearest(folds.where("fold = 0"), folds.where("fold != 0"), 4, "euclidean").collect()
    got = {(r.query_id, r["rank"]): r.vec_id for r in vector.nearest_of_all(folds, folds, 4, "label", "fold").collect()}
    assert all(got[r.query_id, r["rank"]] == r.vec_id for r in other) and len(got) == 260 * 4


def test_density_clusters_of_crowded_cells(spark):
    """Many points in two places: pairs of all with all would be 1,600,000,000."""
    place = F.when(F.col("id") % 2 == 0, 0.0).otherwise(5.0)
    points = spark.range(40_000).select("id", (place + F.col("id") / 400_000).alias("x"), F.lit(0.0).alias("y")).union(spark.sql("select 40000L, 2.5D, 0D union all select 40001L, double('NaN'), 0D"))
    got = {(r.cluster, r.n) for r in models.density_clusters(points, 1.0, 3).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 20_000), (1, 20_000), (None, 2)}
