import pytest
from pyspark.sql import functions as F

from plexmatch import cli
from plexmatch.operators import vertex_program
from plexmatch.operators.bloom import BloomFilter, Shape
from plexmatch.operators.candidates import by_label_and_degree, refine, sizes
from plexmatch.operators.rank import global_rank
from plexmatch.plans.pattern import Pattern
from plexmatch.plans.planner import plan
from plexmatch.plans.report import batch, summary
from plexmatch.queries import QUERIES, toy_graph
from plexmatch.sources.adjacency import read_graph, to_lines, wrong_labels
from plexmatch.sources.patterns import read_pattern, read_patterns
from plexmatch.sources.sinks import exists, fastq_sequences, upload, write_lines, write_mappings
from plexmatch.operators.matcher import match
from plexmatch.streaming.edges import label_degrees, stream_edges

TEXT = "# toy\n1 a 2 c 4 c\n2 c 1 a 3 b\n\n3 b 2 c 4 c\n4\tc 1 a 3 b\n5 d\n"


def test_text_graph_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text(TEXT)
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "square").write_text("1 a 2 c 4 c\n2 c 3 b\n3 b 4 c\n4 c\n")
    (tmp_path / "q" / "edge").write_text("1 a 2 c\n2 c\n")
    g = read_graph(spark, str(tmp_path / "g.txt"))
    assert g.labels == ["a", "b", "c", "d"]
    assert sorted(r[0] for r in to_lines(g).collect()) == ["1 a 2 c 4 c", "2 c 1 a 3 b", "3 b 2 c 4 c", "4 c 1 a 3 b", "5 d"]
    assert [p.name for p in read_patterns(str(tmp_path / "q"))] == ["edge", "square"]
    assert read_patterns("file://" + str(tmp_path / "q"), spark)[1] == read_pattern(str(tmp_path / "q" / "square"))
    assert cli.main(["-d", str(tmp_path / "g.txt"), "-q", str(tmp_path / "q"), "-order", "dad", "-filter", "on", "-report", "long"]) == 0
    said = capsys.readouterr().out
    assert "edge degree: Mapping count = 2" in said and "square anti-degree: Mapping count = 2" in said
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_graph(spark, str(tmp_path / "none")).labels


def test_wrong_labels(spark):
    lines = spark.createDataFrame([("1 a 2 c",), ("2 b 1 a",)], "value string")
    assert [tuple(r) for r in wrong_labels(lines).collect()] == [(1, 2, "c", "b")]


def test_text_is_not_broadcast(spark, sf):
    for name in ("s_text_round_trip", "g_vertex_values", "t_wrong_labels"):
        df = QUERIES[name](spark, sf)
        assert df.count() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString(), name
    edges = {tuple(r) for r in QUERIES["g_pair_histogram"](spark, sf).collect()}
    assert {tuple(r) for r in QUERIES["s_text_round_trip"](spark, sf).collect()} == edges and len(edges) == 12


def test_writers(spark, tmp_path):
    p = Pattern.of("acb", "01 12")
    rows = match(toy_graph(spark), plan(p)).coalesce(1)
    out = str(tmp_path / "m")
    write_mappings(rows, p, out, lines_per_file=3)
    parts = sorted((tmp_path / "m").glob("part-*"))
    assert len(parts) == 3 and parts[0].read_text().count("# Match") == 3
    with pytest.raises(Exception, match="already exists"):
        write_lines(spark.createDataFrame([("x",)], "value string"), out)
    write_lines(spark.createDataFrame([("x",)], "value string"), out, overwrite=True)
    assert spark.read.text(out).count() == 1
    (tmp_path / "f").write_text("hello")
    upload(spark, str(tmp_path / "f"), str(tmp_path / "g"))
    assert exists(spark, str(tmp_path / "g"))
    with pytest.raises(FileExistsError):
        upload(spark, str(tmp_path / "f"), str(tmp_path / "g"))
    fastq = spark.createDataFrame(list(enumerate(["@r1", "ACGT", "+", "!!!!", "@r2", "GG", "+", "!!"])), "line_no bigint, value string")
    assert [r["value"] for r in fastq_sequences(fastq).orderBy("line_no").collect()] == ["ACGT", "GG"]


def test_candidates(spark):
    g, p = toy_graph(spark), Pattern.of("acbc", "01 12 23 30")
    loose = by_label_and_degree(g, p)
    tight = refine(g, p, loose)
    a = {r[0]: r[1] for r in sizes(loose).collect()}
    b = {r[0]: r[1] for r in sizes(tight).collect()}
    assert all(b[u] <= a[u] for u in a)
    assert match(g, plan(p), candidates=tight).count() == 4


def test_bloom(spark):
    assert Shape.of(1000, 0.01) == Shape(7, 9586) and Shape.of(1, 0.9).hashes == 3 and Shape.of(1, 1e-90).hashes == 128
    pairs = spark.range(500).select(F.col("id").alias("a"), (F.col("id") * 7).alias("b"))
    sieve = BloomFilter.build(pairs, ["a", "b"], 500, 0.01)
    assert sieve.may_contain(pairs, ["a", "b"]).count() == 500
    others = spark.range(500, 2500).select(F.col("id").alias("a"), (F.col("id") * 7).alias("b"))
    assert sieve.may_contain(others, ["a", "b"]).count() < 80


def test_bloom_joined(spark, monkeypatch):
    """A filter too large to broadcast loses no row, also where rows come in another order each time they are read."""
    import numpy as np

    from plexmatch.operators import bloom

    monkeypatch.setattr(bloom, "BROADCAST_BITS", 0)

    def mixed(batches):
        for b in batches:
            yield b.take(np.random.default_rng().permutation(b.num_rows))

    rows = spark.range(0, 300_000, 1, 3).select((F.col("id") * 7919 % 150_000).alias("a"), F.col("id").alias("other")).mapInArrow(mixed, "a bigint, other bigint")
    sieve = BloomFilter.build(rows.filter("a < 100000"), ["a"], 100_000, 0.01)
    kept = sieve.may_contain(rows, ["a"])
    assert kept.columns == ["a", "other"]
    assert kept.filter("a < 100000").distinct().count() == 200_000 and kept.filter("a >= 100000").count() < 1500


def test_bloom_semi_join_of_null_keys(spark, sf, tmp_path):
    """A null key is a key too, as in the SQL."""
    from plexmatch.queries import QUERIES

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines = lines.unionByName(lines.limit(40).withColumn("l_partkey", F.lit(None).cast("bigint")))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {tuple(r) for r in lines.filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey").collect()}
    got = [tuple(r) for r in QUERIES["f_bloom_semi_join"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and any(p is None for _, p in got)


def test_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") > 0, F.col("id")).alias("other"))
    got = global_rank(df, ["k"], partitions=7).collect()
    assert sorted((r["k"], r["rank"]) for r in got) == [(i, i) for i in range(1000)]
    assert global_rank(df.limit(0), ["k"]).count() == 0


def test_vertex_programs(spark):
    v = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "vid bigint")
    e = spark.createDataFrame([(a, b) for x, y in ((1, 2), (2, 3), (3, 4)) for a, b in ((x, y), (y, x))], "src bigint, dst bigint")
    assert dict(map(tuple, vertex_program.least_reachable(v, e, 3).collect())) == {1: 1, 2: 1, 3: 1, 4: 2, 9: 9}

    def grow(rows, step):
        messages = rows.select(F.lit(2).cast("bigint").alias("dst"), F.col("vid").alias("payload")) if step == 1 else None
        added = spark.createDataFrame([(7, 0), (2, 99)], "vid bigint, n bigint") if step == 1 else None
        unknown = rows.select(F.lit(1000).cast("bigint").alias("dst"), F.col("vid").alias("payload"))
        state = rows.withColumn("n", F.size("inbox").cast("bigint") if step == 2 else F.col("n")).withColumn("active", F.lit(False))
        return vertex_program.Step(state, messages.unionByName(unknown) if messages is not None else None, added)

    end = vertex_program.run(v.withColumn("n", F.lit(0).cast("bigint")), grow, 5, stop_when_quiet=True)
    got = {r["vid"]: r["n"] for r in end.collect()}
    assert got[2] == 5 and got[7] in (0, -1, None) and set(got) == {1, 2, 3, 4, 7, 9}


def test_report(spark):
    rows = batch(toy_graph(spark), [Pattern.of("acbc", "01 12 23 30", "square")], "dad")
    assert [r["mappings"] for r in rows] == [4, 4] and {r["order"] for r in rows} == {"degree", "anti-degree"}
    assert summary(rows)["mappings"] == 8 and summary([])["average_time"] == 0.0


def test_streamed_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXT)
    q = label_degrees(stream_edges(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("streamed_degrees").start()
    try:
        q.processAllAvailable()
        assert {(r["src"], r["dst_label"], r["deg"]) for r in spark.table("streamed_degrees").collect()} == {(1, "c", 2), (2, "a", 1), (2, "b", 1), (3, "c", 2), (4, "a", 1), (4, "b", 1)}
    finally:
        q.stop()


def test_edge_store(spark, tmp_path):
    from plexmatch.operators.counter import count
    from plexmatch.sources.edge_store import open_graph, write_bucketed, write_graph

    g = toy_graph(spark)
    write_graph(g, str(tmp_path / "g"))
    back = open_graph(spark, str(tmp_path / "g"))
    assert back.labels == ["a", "b", "c", "d"]
    assert count(back, plan(Pattern.of("acbc", "01 12 23 30"))).first()[0] == 4
    plan_text = back.edges("a", "c")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan_text
    table = write_bucketed(g, "c", "b", "edges_c_b", 4)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, g.edges("c", "b").collect()))
    spark.sql("drop table edges_c_b")
