"""Pipeline stages, each against what brute force keeps of its input."""

import collections
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    from plexmatch.llm import decontaminate, language_id

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    read, kept = docs, {}
    for name, stage in pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, read, sf).write.parquet(out)
        kept[name], read = read, spark.read.parquet(out)
        if name != "packing":
            assert read.columns == COLUMNS
    after = {name: spark.read.parquet(str(tmp_path / name)) for name, _ in pipeline.STAGES}
    ids = {name: [r["doc_id"] for r in df.select("doc_id").collect()] for name, df in after.items()}

    assert set(ids["language"]) == {r["doc_id"] for r in language_id.identify_documents(docs).filter("accepted").collect()}
    assert len(ids["language"]) > 0.98 * docs.count()

    blank = re.compile(r"[\x20\x09-\x0D]")
    groups = collections.defaultdict(list)
    for r in kept["exact"].collect():
        groups[blank.sub("", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    assert sorted(ids["exact"]) == sorted(min(g)[1] for g in groups.values())

    from test_llm_operators import classes

    rows = [(r["doc_id"], r["text"]) for r in kept["near"].orderBy("doc_id").collect()]
    assert sorted(ids["near"]) == sorted({rows[c][0] for c in classes(rows)})

    bad = {r["doc_id"] for r in decontaminate.contaminated(kept["decontaminate"], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in kept["decontaminate"].collect():
        words = " ".join(re.findall(r"[^\W_]+", r["text"].lower()))
        if any(" ".join(i) in words for i in items):
            assert r["doc_id"] in bad
    assert sorted(ids["decontaminate"]) == sorted(r["doc_id"] for r in kept["decontaminate"].collect() if r["doc_id"] not in bad)

    pieces = after["packing"].collect()
    tokens = collections.Counter()
    for r in pieces:
        tokens[r["doc_id"]] += r["length"]
    assert all(tokens[r["doc_id"]] == r["doc_tokens"] for r in pieces) and set(tokens) == set(ids["decontaminate"])


def test_stages_take_odd_rows(spark, sf, tmp_path):
    rows = [(1, "a b", None, None, None, 1), (None, None, "en", "s", 3, 2), (2, "", "de", "s", 0, 3), (2, "", "de", "s", 0, 3), (3, "the cat and the dog and the bird", "en", "t", 5, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, document long")
    df.write.parquet(str(tmp_path / "odd"))
    for frame in (spark.read.parquet(str(tmp_path / "odd")), spark.read.parquet(str(tmp_path / "odd")).limit(0)):
        for name, stage in pipeline.STAGES:
            got = stage(spark, frame, sf)
            assert got.count() <= 5
            if name != "packing":
                assert got.columns == frame.columns


def test_rows_keep_their_place_however_scans_are_cut(spark, tmp_path):
    """What one pass finds is dropped by another that reads the files in other pieces, or on another number of cores."""
    from plexmatch.llm import common, exact_dedup, minhash

    texts = [(i, f"text number {i % 300} of the copies and words", "x" * 50) for i in range(900)]
    spark.createDataFrame(texts, "doc_id long, text string, place string").repartition(3).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "d"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    docs = spark.read.parquet(str(tmp_path / "d"))
    try:
        for find, first, second in ((exact_dedup.exact_dedup, "128m", "2k"), (minhash.near_duplicates, "2k", "128m")):
            for n, v in zip(names, (first, "1k"), strict=True):
                spark.conf.set(n, v)
            dropped = common.store(find(docs, placed=True).filter("not kept"))
            spark.conf.set(names[0], second)
            left = common.without(docs, dropped)
            assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == list(range(300))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
