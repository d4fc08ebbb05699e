"""The ten operators against brute force, on small tables with nulls, ties, repeats and odd columns."""

import collections
import hashlib
import math
import re
import zlib
from array import array

import pytest
from pyspark.sql import functions as F

from plexmatch.llm import decontaminate, exact_dedup, fm_index, language_id, lattice, lm_scoring, minhash, packing, pii, quality, sharding, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
BASE = " ".join(f"base{i}" for i in range(80))
TEXTS = [
    (1, "a b c"), (2, "abc"), (3, "ab\tc \n"), (4, None), (5, ""), (6, " \n"), (7, LONG), (8, LONG + " end"), (None, "abc"), (2, "abc"),
    (9, BASE), (10, BASE + " tail"), (11, "head " + BASE), (12, "Grüße aus dem Süden, ñandú."), (13, "x " * 100), (14, " ".join(f"q{i}" for i in range(40)) + " mid " + BASE),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, `odd name.x` string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, k, None, None, "z") for k, (i, t) in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_op1_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    docs = spark.createDataFrame([(1, "same")] * 50 + [(2, "other"), (None, None), (None, None)], "doc_id long, text string")
    got = sharding.feistel_shards(docs, shards=4).collect()
    assert sorted(r["place"] for r in got) == list(range(53)) and sum(r["doc_id"] == 1 for r in got) == 50


def test_op1_places_are_a_permutation(spark, docs, none):
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(sharding.permuted(x, n) for x in range(n)) == list(range(n))
    got = sharding.feistel_shards(docs, shards=5).collect()
    assert len(got) == len(TEXTS)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    by = collections.defaultdict(list)
    for r in got:
        assert r["place"] == sharding.permuted(r["row_no"], len(TEXTS)) and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.feistel_shards(none).count() == 0
    again = {(r["row_no"], r["place"]) for r in sharding.feistel_shards(docs.repartition(2), shards=5).collect()}
    assert again == {(r["row_no"], r["place"]) for r in got}


def test_op7_groups(docs, none):
    blank = re.compile(r"[\x20\x09-\x0D]")
    norm = [blank.sub("", t or "") for _, t in TEXTS]
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(TEXTS)
    sizes = collections.Counter(norm)
    keep = {n: min(((-len(t or ""), i is None, i) for (i, t), m in zip(TEXTS, norm, strict=True) if m == n))[2] for n in sizes}
    want = collections.Counter((i, keep[n], sizes[n], hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(TEXTS, norm, strict=True))
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(sizes) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(none).count() == 0


def test_op7_more_partitions_than_lanes(spark):
    for n, limit in ((96, None), (240, "4k")):  # lanes: 64; the small limit reads each file of a run on its own
        if limit:
            before = spark.conf.get("spark.sql.files.maxPartitionBytes")
            spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            docs = spark.range(0, 2 * n, 1, n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "copied text").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
            got = exact_dedup.exact_dedup(docs).collect()
        finally:
            if limit:
                spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert sorted(r["doc_id"] for r in got) == list(range(2 * n))
        assert all((r["keep_id"], r["group_size"]) == ((0, n) if r["doc_id"] % 2 == 0 else (r["doc_id"], 1)) for r in got)
        assert sum(r["kept"] for r in got) == n + 1


def shingles(t):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(texts):
    sets = [shingles(t) for _, t in texts]
    at = list(range(len(sets)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-12:
                at[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def test_op2_classes(docs, none):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    comp = classes(TEXTS)
    least = {c: min((i is None, i) for (i, _), d in zip(TEXTS, comp, strict=True) if d == c)[1] for c in comp}
    want = collections.Counter((i, least[c], comp.count(c)) for (i, _), c in zip(TEXTS, comp, strict=True))
    assert collections.Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(set(comp))
    assert minhash.near_duplicates(none).count() == 0


def test_op2_large_group_of_near_copies(spark, tmp_path, monkeypatch):
    import random

    rng, words = random.Random(3), [f"v{i}" for i in range(120)]
    texts = []
    for i in range(120):
        w = list(words)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        texts.append((i, " ".join(w)))
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(minhash, "BLOCK", 32)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert [got[i] for i, _ in texts] == classes(texts)


def test_op2_weighted_classes(spark):
    """Repeated runs of words count as often as they stand; hot buckets, leads and hubs take their own way."""
    head, tail = " ".join(f"h{i}" for i in range(40)), " ".join(f"t{i}" for i in range(12))
    texts = [(0, f"{head} {tail}"), (1, f"{head} {tail} {tail} {tail}"), (2, f"{head} {tail}  {tail} {tail} x"), (3, f"{head} {tail} y")]
    got = {c: {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), counted=c).collect()} for c in (False, True)}

    def alike(a, b, counted):
        x, y = (collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a.split(), b.split()))
        x, y = (x, y) if counted else (dict.fromkeys(x, 1), dict.fromkeys(y, 1))
        both = sum(min(x.get(k, 0), y.get(k, 0)) for k in x)
        return both >= 0.8 * (sum(x.values()) + sum(y.values()) - both)

    for counted in (False, True):
        for i, a in texts:
            for j, b in texts:
                assert not alike(a, b, counted) or got[counted][i] == got[counted][j]
    assert got[False] == {0: 0, 1: 0, 2: 0, 3: 0} and got[True] == {0: 0, 1: 1, 2: 1, 3: 0}


def test_op2_hot_groups(spark, tmp_path, monkeypatch):
    import random

    from plexmatch.llm import common

    rng, words = random.Random(8), [f"v{i}" for i in range(90)]
    texts = []
    for i in range(80):
        w = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        texts.append((i, " ".join(w)))
    spark.createDataFrame([*texts, *[(i + 100, t) for i, t in texts[:30]]], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    for module, name, value in ((common, "HOT_LEAST", 3), (minhash, "HOT_LEAST", 3), (minhash, "HOT_LEADS", 4), (minhash, "BLOCK", 8)):
        monkeypatch.setattr(module, name, value)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert [got[i] for i, _ in texts] == classes(texts) and all(got[i + 100] == got[i] for i, _ in texts[:30])


def test_op2_dart_signatures_estimate_weighted_similarity():
    import numpy as np

    from plexmatch.llm.textkit import mix

    e = mix(np.arange(1, 401, dtype=np.uint64))
    a, b = np.r_[np.full(200, 1.0), np.full(100, 3.0), np.zeros(100)], np.r_[np.full(200, 1.0), np.full(100, 1.0), np.full(100, 2.0)]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    keep_a, keep_b = a > 0, b > 0
    sig = minhash.dart_signatures(np.r_[e[keep_a], e[keep_b]], np.r_[a[keep_a], b[keep_b]], np.r_[np.zeros(keep_a.sum(), int), np.ones(keep_b.sum(), int)], 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.06
    alone = minhash.dart_signatures(e[keep_a], a[keep_a], np.zeros(keep_a.sum(), int), 1, 1024)
    assert (alone[0] == sig[0]).all()


def test_op2_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (33, 31), (40, 41)], "a long, b long")
    got = {r["node"]: r["comp"] for r in minhash.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 21), 1), 30: 30, 31: 30, 33: 30, 40: 40, 41: 40}
    assert minhash.components(links.limit(0)).count() == 0


def brute_windows(texts, k):
    words = [WORD.findall(t or "") for _, t in texts]
    n = collections.Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(texts, words, strict=True):
        gone = {j for s in range(len(w) - k + 1) if n[tuple(w[s : s + k])] > 1 for j in range(s, s + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_op3_windows(docs, none, hot):
    got = substring_dedup.repeated_words(docs, hot=hot)
    assert collections.Counter(map(tuple, got.collect())) == brute_windows(TEXTS, 35)
    assert substring_dedup.repeated_words(none).count() == 0


def test_op3_random_texts(spark):
    import random

    rng = random.Random(1)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))] for _ in range(12)]
    texts = [(i, " ".join(sum((rng.choice(pool) for _ in range(rng.randint(0, 6))), []))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = substring_dedup.repeated_words(df, window=12, gram=5)
    assert collections.Counter(map(tuple, got.collect())) == brute_windows(texts, 12)


def test_op3_index_counts():
    import numpy as np

    rng = np.random.default_rng(0)
    lengths = rng.integers(3, 30, 40)
    text = rng.integers(1, 6, lengths.sum())
    index = fm_index.FMIndex(text, lengths, 40)
    ends = np.cumsum(lengths)
    pieces = [text[e - n : e].tolist() for n, e in zip(lengths, ends, strict=True)]
    for _ in range(200):
        p = rng.integers(1, 6, rng.integers(1, 5)).tolist()
        lo, hi = np.array([0]), np.array([index.n])
        for s in reversed(p):
            lo, hi = index.step(np.array([s]), lo, hi)
        assert hi[0] - lo[0] == sum(x[i : i + len(p)] == p for x in pieces for i in range(len(x)))


def test_op4_round_trip(docs, none):
    
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for i, t in TEXTS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 4096):
            part = ids[s : s + 4096]
            want[(i, s, len(part), zlib.crc32(array("I", part).tobytes()), len(ids))] += 1
    got = packing.packed(docs).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    rows = collections.defaultdict(list)
    for r in packing.packed(docs, group_tokens=20_000).collect():
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in rows.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.packed(none).count() == 0


def test_op4_letters_that_end_in_a_mark():
    
    ids = packing.Ids(packing.default_tokenizer())
    words = [w + c + e for w in ("", "a", "\u0915") for c in "\u0130\u0958\u09dc\u0a33\ufb2a\u00e9\u1e9e\uac01e" for e in ".,"]
    got, begin = ids([w.encode() for w in words])
    for w, a, b in zip(words, begin[:-1], begin[1:], strict=True):
        assert got[a:b].tolist() == [*ids.tokenizer.encode(w, add_special_tokens=False).ids, packing.END_ID], ascii(w)


def test_op4_first_fit_decreasing():
    import random

    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    free, want = [], {}
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == [want[i] for i in range(300)]
    assert packing.first_fit_decreasing([], 100) == []


BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(t):
    out = []
    for kind, p in BASE_PATTERNS.items():
        for m in re.finditer(p, t):
            digits = re.sub(r"[^0-9]", "", m[0])
            total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and total % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], list(BASE_PATTERNS).index(x[0])))


def test_op5_base_spans_and_disguises(spark, docs, none, sf):
    import random

    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice("ab1.2@+ -()4é") for _ in range(rng.randint(0, 40)))
        assert pii.detect(t) == plain_spans(t), t
    cases = {
        "write to john (at) site (dot) com now": "john (at) site (dot) com",
        "jane at foo dot co dot uk": "jane at foo dot co dot uk",
        "раul@exаmple.com": "раul@exаmple.com",
        "card four one one one one one one one one one one one one one one one.": "four one one one one one one one one one one one one one one one",
        "a​b@c.de": "a​b@c.de",
        "host 192 dot 168 dot 1 dot 20": "192 dot 168 dot 1 dot 20",
        "call ＋４９ 30 1234567": "＋４９ 30 1234567",
    }
    for text, found in cases.items():
        base, every = pii.find(text)
        assert found in {text[s:e] for _, s, e in every} and set(base) <= set(every), text
    for clean in ("we met at example.com", "one of the two dots", "the dot at the end. one two", "version 1.2.3.400"):
        assert pii.find(clean)[1] == []
    got = pii.personal_data(docs).collect()
    assert len(got) == len(TEXTS) and all(r["spans"] == "" for r in got)
    assert pii.personal_data(none).count() == 0
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for r, t in zip(pii.op5_personal_data(spark, sf).orderBy("doc_id").collect(), table.orderBy("doc_id").collect(), strict=True):
        want = plain_spans(t["text"])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert r["n_email"] == sum(k == "email" for k, _, _ in want)


def test_op5_case_kin_and_long_texts():
    import time

    for text in ("\u017fix \u017feven", "f\u0130ve s\u0130x", "s\u0131x F\u00dcNF", "+4\u212a one two three"):
        pii.find(text)
    for w in pii.DIGIT_WORDS:
        for i in range(len(w)):
            for c in [*map(chr, range(0x250)), "\u1e9e", "\u212a", "\u212b"]:
                pii.find(f"{w[:i]}{c}{w[i + 1 :]} {w}")
    assert pii.deobfuscated("f\u0130ve \u017fix").text == "56"
    n = 200_000
    long = ["(at)" + " " * n, " " * n + "(at)", "x dot" + " " * n + "dot y", "a@b.co " * (n // 7) + " x (at) y.com", "( " * n, "one " * n, "at a " * n, "+1" + "(" * n, "a@" + "b" * n]
    began = time.perf_counter()
    found = [len(pii.find(t)[1]) for t in long]
    assert time.perf_counter() - began < 60 and found[3] == n // 7 + 1


def test_op5_spans_lead_back_to_the_source():
    import random

    rng, parts = random.Random(2), ["user", "one two", " ", "(at)", " dot ", "com", "\u0430", "\u200b", "\uff11", "x", " at ", "-", "192.168.1.1", "@", "."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        tape = pii.deobfuscated(text)
        for i, c in enumerate(tape.text):
            s, e = tape.source(i, i + 1)
            assert 0 <= s < e <= len(text)
            if e - s == 1 and text[s].isascii() and text[s].isalnum():
                assert text[s] == c
    assert pii.find("mail: user (at) site [dot] org!")[1] == [("email", 6, 30)]


def test_op6_accuracy_and_evidence(spark, docs, none):

    got = language_id.op6_language_id(spark, "/root/testdata/sf0.01")
    held = got.filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["language"] == r["lang"] for r in held) / len(held) > 0.98
    mine = language_id.identify_documents(docs).collect()
    assert len(mine) == len(TEXTS) and all(not r["accepted"] for r in mine if r["n_grams"] == 0)
    assert language_id.identify_documents(none).count() == 0
    kept = language_id.accepted_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["accepted"] for r in mine)
    # markup, address and host decide where the text says nothing
    train = spark.createDataFrame([("der die das und nicht", "de"), ("the and not with you", "en")] * 5, "text string, label string")
    hosts = spark.createDataFrame([("a.example.com", "example.com", "de")] * 40 + [("b.example.com", "example.com", "en")] * 2, "host string, domain string, label string")
    rows = spark.createDataFrame([(1, "<html lang='de'>zzzz", "http://x.org/q", None), (2, "zzzz", "https://x.de/", None), (3, "zzzz", None, "a.example.com"), (4, "zzzz", "http://h.net/en/1", None), (5, "zzzz", "https://x.com", "none.org")], "key int, text string, url string, host string")
    model = language_id.learn(train)
    out = {r["key"]: r["language"] for r in language_id.identify(language_id.evidence(rows.withColumn("label", F.lit(None).cast("string"))), model, hosts, ["key"]).collect()}
    assert {k: out[k] for k in (1, 2, 3, 4)} == {1: "de", 2: "de", 3: "de", 4: "en"}


def test_op6_pages(spark):
    from plexmatch.llm import registry

    sf = "/root/testdata/sf0.01"
    pages, docs = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    tag = {r["page_id"]: r["tag"] for r in pages.select("page_id", F.regexp_extract("html", 'lang="(..)"', 1).alias("tag")).collect()}
    got = registry.queries()["op6_page_languages"](spark, sf).collect()
    assert sorted(r["page_id"] for r in got) == sorted(tag)
    assert sum(r["language"] == tag[r["page_id"]] and r["accepted"] for r in got) > 0.95 * len(tag)
    # the text says nothing: markup and address decide
    odd = [(1, None, "<html lang=fr><p>zzzz"), (2, "http://x.example.net/es/7", "<p>zzzz"), (3, "http://x.example.de/7", "<p>zzzz</p><script>the and of"), (None, None, None)]
    out = {r["page_id"]: r["language"] for r in language_id.identify_pages(spark.createDataFrame(odd, "page_id long, url string, html string"), docs).collect()}
    assert out == {1: "fr", 2: "es", 3: "de", None: "und"}


def test_op6_texts_without_n_grams(spark):
    train = [(k, f"the and not with you {k}", "en", "s") for k in range(20)]
    odd = [(100, "A."), (101, "\u00e9"), (102, ""), (103, None), (104, " \n")]
    docs = spark.createDataFrame([*train, *[(*x, None, "s") for x in odd]], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in language_id.identify_documents(docs).collect() if r["doc_id"] >= 100}
    assert {k: (r["language"], r["accepted"]) for k, r in got.items()} == {100: ("en", True), 101: ("en", True), 102: ("und", False), 103: ("und", False), 104: ("und", False)}
    assert got[100]["posterior"] > 0.9 and got[102]["posterior"] == 0


def test_op6_more_languages_than_a_block_holds(spark, monkeypatch):
    rows = [(20 * k + i, f"{chr(97 + k) * 3}{chr(98 + k) * 4} {chr(99 + k) * 5} " * 4, f"l{k}", "s") for k in range(7) for i in range(10 + k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = {r["doc_id"]: (r["language"], round(r["posterior"], 6)) for r in language_id.identify_documents(docs).collect()}
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    assert {r["doc_id"]: (r["language"], round(r["posterior"], 6)) for r in language_id.identify_documents(docs).collect()} == whole
    assert all(whole[i][0] == lang for i, _, lang, _ in rows)
    assert language_id.accepted_documents(docs).count() == len(rows)


def test_op6_posteriors_against_brute_force(spark, monkeypatch):
    """The sum of all four witnesses in plain Python; taking one away changes it."""
    import numpy as np
    from plexmatch.llm.textkit import byte_grams, joined

    train = [("der die das und nicht", "de"), ("the and not with you", "en"), ("le la les et pas", "fr"), ("the end", "en")]
    hosts = [("a.x.org", "x.org", "de"), ("a.x.org", "x.org", "en"), ("b.x.org", "x.org", "en"), ("c.y.org", "y.org", "fr")]
    rows = [(1, "<html lang=fr> the and", "http://q.de/", "a.x.org"), (2, "das und", "https://w.w/en/1", "z.x.org"), (3, "nicht the", None, None), (4, "et pas", "http://c.y.org/", None)]
    names, grams = ["de", "en", "fr"], lambda t: byte_grams(*joined([t.encode()]), 3, 14)[0]
    counts = {x: np.full(1 << 14, 0.1) for x in names}
    for t, x in train:
        np.add.at(counts[x], grams(t), 1)
    prior = {x: (1 - 1e-3) * (sum(y == x for _, y in train) + 1) / (len(train) + 3) for x in names} | {"und": 1e-3}

    def share(key, level, parent):
        have = [h[2] for h in hosts if h[level] == key]
        return {x: (have.count(x) + 20 * parent[x]) / (len(have) + 20) for x in parent} if have else parent

    def posterior(text, url, host, witnesses="dah"):
        import re

        tag = re.search("lang=(..)", text)
        path, top = re.search("//[^/]*/([a-z]{2})(?:/|$)", url or ""), re.search(r"//[^/]*\.([a-z]{2})(?:/|$)", url or "")
        place = path or top
        said = {"d": (tag and tag[1], 0.9), "a": (place and place[1], 0.8)}
        host = host or (re.search("//([^/]*)", url)[1] if url else "")
        known = host in {h[0] for h in hosts}
        p = share(host, 0, share(".".join(host.split(".")[-2:]), 1, prior)) if known and "h" in witnesses else prior
        total = {}
        for x in [*names, "und"]:
            like = np.log(counts[x] / counts[x].sum())[grams(text)].sum() if x != "und" else -14 * math.log(2) * len(grams(text))
            total[x] = 0.25 * like + math.log(p[x])
            for w, (what, sure) in said.items():
                if w in witnesses and what in names and x != "und":
                    total[x] += math.log(sure if what == x else (1 - sure) / 3)
        best = max(total, key=total.get)
        return best, 1 / sum(math.exp(v - total[best]) for v in total.values())

    frame = spark.createDataFrame([(*r, None) for r in rows], "key long, text string, url string, host string, label string")
    model = language_id.learn(spark.createDataFrame(train, "text string, label string"))
    for most in (50_000, 0):  # hosts broadcast, and joined
        monkeypatch.setattr(language_id, "MAX_BROADCAST_HOSTS", most)
        found = language_id.identify(language_id.evidence(frame), model, spark.createDataFrame(hosts, "host string, domain string, label string"), ["key"]).collect()
        assert len(found) == len(rows)
        for r in found:
            want = posterior(*rows[r["key"] - 1][1:])
            assert r["language"] == want[0] and abs(r["posterior"] - want[1]) < 1e-5
    for w in "dah":
        assert any(abs(posterior(*r[1:])[1] - posterior(*r[1:], "dah".replace(w, ""))[1]) > 1e-4 for r in rows)


def test_op8_held_out_accuracy(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op8_quality_scores(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    high, low = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert sum(a > b for a in high for b in low) / (len(high) * len(low)) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    marks = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (7, None)], "doc_id long, quality int")
    scored = quality.quality_scores(docs, marks).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scored)
    assert {r["score"] for r in quality.quality_scores(docs, marks.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, marks).count() == 0


def test_op9_substitutions(spark, docs, none):
    import random

    rng, item = random.Random(4), [f"item{i}" for i in range(30)]
    noise = lambda n: [f"x{rng.random()}" for _ in range(n)]
    swapped = list(item)
    for i in (5, 11, 17, 23):
        swapped[i] = "other"
    texts = [(1, " ".join(noise(50) + item + noise(9))), (2, " ".join(noise(3) + swapped)), (3, " ".join(noise(60))), (4, " ".join(item[:6] + noise(40))), (5, " ".join(x.upper() + "," for x in item)), (6, None), (6, " ".join(item[10:24])), (7, "one two three four five")]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, None), (2, "a b"), (3, "one two three four five"), (0, " ".join(item))], "item_id long, text string")
    frame = spark.createDataFrame([(*x, 1, "m") for x in texts], "doc_id long, text string, item_id int, b string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == {(1, 0), (2, 0), (5, 0), (6, 0), (7, 3)}
    left = decontaminate.decontaminated(frame, bench)
    assert left.columns == frame.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 6]
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_op8_votes_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnr"]
    texts = [(i, " ".join(rng.choice(words[: 40 if i % 2 else 80], 30))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, marks).collect()}
    f = quality._frequencies([t.encode() for _, t in texts]).astype(float)
    grams = f[:, : 1 << quality.BITS]
    idf = np.r_[np.log((1 + len(texts)) / (1 + (grams > 0).sum(axis=0))) + 0.3, np.ones(quality.SHARES)]
    taught = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    x = f[taught].astype(np.float16).astype(float) * idf
    _, _, v = np.linalg.svd(x, full_matrices=False)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit((f * idf) @ v.T) @ unit(x @ v.T).T
    for i, row in enumerate(near):
        top = sorted(range(len(taught)), key=lambda k: -row[k])[: quality.NEIGHBOURS]
        weight = np.maximum(row[top], 0) ** quality.SHARPNESS
        assert abs(got[i] - (weight * [taught[k] % 2 for k in top]).sum() / weight.sum()) < 5e-3


@pytest.mark.parametrize(("least", "seeds"), [(5, 500_000), (2, 150)])
def test_op9_short_items_against_brute_force(spark, least, seeds):
    """All patterns of substitutions in items of 2 to 13 words, the benchmark in one block and in many."""
    from itertools import combinations

    items = {n: [f"i{n}w{j}" for j in range(n)] for n in range(least, 14)}
    texts = []
    for n, item in items.items():
        for k in range(1, n - math.ceil(0.8 * n) + 2):  # up to one substitution too many
            for gone in combinations(range(n), k):
                swapped = ["other" if j in gone else w for j, w in enumerate(item)]
                texts.append(" ".join(["x"] * (len(texts) % 3) + swapped + ["y"] * (len(texts) % 2)))
        texts += [" ".join(item[1:]), " ".join(item[:-1])]

    def best(words, item):
        return max(sum(0 <= s + j < len(words) and words[s + j] == w for j, w in enumerate(item)) for s in range(-len(item), len(words)))

    want = {(d, n, best(t.split(), item)) for d, t in enumerate(texts) for n, item in items.items() if best(t.split(), item) >= math.ceil(0.8 * n)}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.contaminated(frame, bench, least_words=least, block_seeds=seeds).collect()} == want


def test_op10_scores(docs, none):
    got = lm_scoring.lm_scores(docs, head_words=3).collect()
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    toks = [[*WORD.findall((t or "").translate(low)), "\n"] for _, t in TEXTS]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in TEXTS]
    c = collections.Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, h, len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, _), h, t in zip(TEXTS, held, toks, strict=True))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    same = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm_scoring.lm_scores(docs).collect()}
    assert all(abs(same[(r["doc_id"], r["n_tokens"])] - r["score"]) < 1e-6 for r in got)
    assert lm_scoring.lm_scores(none).count() == 0


def test_op10_document_scores_against_brute_force(spark):
    units, log_p = lattice.read_units(lm_scoring.default_vocabulary())
    p = dict(zip(units, log_p.tolist(), strict=True))

    def word(w):
        w, alpha = b" " + w, [0.0]
        for j in range(1, len(w) + 1):
            terms = [alpha[i] + p[w[i:j]] for i in range(max(0, j - 40), j) if w[i:j] in p]
            alpha.append(math.log(sum(math.exp(t - max(terms)) for t in terms)) + max(terms))
        return alpha[-1]

    rows = [(1, "The cat\tsat on the Mat."), (2, "n\u00e4chste \u65e5\u672c " + "unbroken" * 700), (3, None), (4, "")]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), em_rounds=0, head_words=2).collect()}
    for i, t in rows:
        words = [w.encode().lower() for w in (t or "").split()]
        want = (sum(map(word, words)) + math.log(lm_scoring.END_SHARE)) / math.log(10)
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want))


def test_words_with_equal_linear_hashes(spark):
    """A Thue-Morse word and its complement agree in every polynomial hash modulo a power of two."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rest = " ".join(f"w{i}" for i in range(40))
    texts = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {one} {two}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    # of 41 words the shared 40 are removed, the first one stays
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.repeated_words(docs).collect()}
    assert removed == {1: (41, 40), 2: (41, 40), 3: (3, 0)}
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    c = collections.Counter(w for i, t in texts if i not in held for w in [*t.split(), "\n"])
    n, v = sum(c.values()), len(c)
    for r in lm_scoring.lm_scores(docs).collect():
        toks = [*dict(texts)[r["doc_id"]].split(), "\n"]
        assert r["n_known"] == sum(c[w] > 0 for w in toks)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks)) < 1e-9


def test_op10_lattice_sums_all_segmentations():
    import numpy as np

    units, p = [b" ", b"a", b"b", b"ab", b" a", b"ba"], [0.2, 0.1, 0.3, 0.15, 0.2, 0.05]
    lat = lattice.Lattice(units, np.log(p))

    def ways(s):
        if not s:
            return [[]]
        return [[i, *rest] for i, u in enumerate(units) if s.startswith(u) for rest in ways(s[len(u) :])]

    words = [b"ab", b"abba", b"b", b"aab" * 5]
    use = np.zeros(len(units))
    for w, got in zip(words, lat.log_prob(words), strict=True):
        every = [(math.prod(p[i] for i in x), x) for x in ways(b" " + w)]
        total = sum(q for q, _ in every)
        assert abs(math.exp(got) / total - 1) < 1e-9
        for q, x in every:
            for i in x:
                use[i] += 2 * q / total
    assert np.allclose(lat.expected(words, np.full(len(words), 2.0)), use)
