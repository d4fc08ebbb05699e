"""Near duplicates by DartMinHash signatures and banding, with exact verification.

Each element of a document's weighted set owns a region, its weight wide and endless in rank. Darts,
hashed from the element alone, fall into that region at rate one per unit of area; a dart belongs to
one of K coordinates, and the dart of least rank in a coordinate is the signature's value there. Only
ranks up to about (K ln K + 2 K) / weight need be looked at, so a signature costs one draw per
element and some K ln K darts, however heavy the document.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_LEAST, discard, from_files, joined_by_size, only, place, sliced, store, table, texts, trimmed, without
from .textkit import GOLDEN, Words, mix, shingles

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5  # a pair at 0.8 shares a band with probability 1 - (1 - 0.8**5)**26 = 0.99997
K = BANDS * ROWS
LEAST_AGREEMENT = 0.64  # of K coordinates; a pair at 0.8 is below with probability under 1e-5
BLOCK, BLOCK_BYTES = 512, 1 << 20  # members of a bucket, and bytes of their sets, looked at against another block
LARGE = 100  # a component of one in so many of a bucket's members may have blocks of its own, so a bucket has at most that many such
HOT_LEADS, LEAD_BYTES = 256, 4 << 20  # sets, and their bytes, that meet one copy of a lead's set
SEED = 0x5EED


def _element_sets(documents: list[bytes], counted: bool):
    """(element, weight, text) sorted by text and element, without repeats."""
    import numpy as np

    w = Words(documents)
    h, owner = shingles(w.hashes(), w.places, SHINGLE)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, np.int64)
    weight = np.diff(np.r_[first, len(h)]).astype(float) if counted else np.ones(len(first))
    return h[first], weight, owner[first]


def dart_signatures(elements, weights, owner, n: int, k: int = K):
    """n x k signature values of weighted sets; rows of sets without elements are zero.

    Weight is cut into fixed cells [0, 1), [1, 2), [2, 4), ...; the darts of a cell arrive in rank
    order, by exponential gaps, so the same element throws the same darts in every document.
    """
    import numpy as np

    inside = np.float64(2.0**-53)
    signature = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weights, minlength=n)
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(n)
    reach[todo] = (k * np.log(max(k, 2)) + 2 * k) / total[todo]
    low, width = [], []
    top = weights.max(initial=0.0)
    edge = 0.0
    while edge < top:  # cells, as many as the heaviest element needs
        low.append(edge)
        width.append(max(1.0, edge))
        edge += width[-1]
    while len(todo):
        rank = np.full(n * k, np.inf)
        value = np.zeros(n * k, np.uint64)
        mine = np.zeros(n, bool)
        mine[todo] = True
        for c, (lo, wide) in enumerate(zip(low, width, strict=True)):
            e = np.flatnonzero(mine[owner] & (weights > lo))
            key = mix(elements[e] + np.uint64((SEED + c) * GOLDEN % (1 << 64)))
            at, limit, who, over = np.zeros(len(e)), reach[owner[e]], owner[e], weights[e] - lo
            j = 0
            while len(e):
                j += 1
                a = mix(key + np.uint64(2 * j * GOLDEN % (1 << 64)))
                at = at - np.log((a >> np.uint64(11)).astype(float) * inside + inside) / wide
                live = at < limit
                if not live.all():
                    e, key, at, limit, who, over, a = e[live], key[live], at[live], limit[live], who[live], over[live], a[live]
                    if not len(e):
                        break
                b = mix(a + np.uint64(GOLDEN))
                place = who * k + ((b >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
                hit = slice(None) if wide == 1.0 and (over >= 1.0).all() else ((b & np.uint64(0xFFFFFFFF)).astype(float) / 2**32 * wide) < over
                p, r, v = place[hit], at[hit], b[hit]
                np.minimum.at(rank, p, r)
                won = rank[p] == r
                value[p[won]] = v[won]
        full = np.isfinite(rank.reshape(n, k)).all(axis=1)
        done = todo[full[todo]]
        signature[done] = value.reshape(n, k)[done]
        todo = todo[~full[todo]]
        reach[todo] *= 2  # a coordinate without a dart: look further
    return signature


def _signed(counted: bool, carried: bool):
    """With `carried`, a row's column place goes along."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, "text"):
            n = batch.num_rows
            e, weight, owner = _element_sets(texts(batch.column("text")), counted)
            cut = np.searchsorted(owner, np.arange(n + 1))
            sig = dart_signatures(e, weight, owner, n)
            bands = np.zeros((n, BANDS), np.uint64)
            for j in range(ROWS):
                bands = mix(bands * np.uint64(GOLDEN) + sig[:, j::ROWS][:, :BANDS])
            bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64)[None])
            small = mix(sig).astype(np.uint8)
            digest = [hashlib.md5(e[a:b].tobytes() + (weight[a:b].tobytes() if counted else b"")).digest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            offsets = pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("text_md5"), pa.array(digest, pa.binary()), pa.array(np.diff(cut)), pa.ListArray.from_arrays(offsets, pa.array(bands.view(np.int64).ravel())), pa.array([x.tobytes() for x in small], pa.binary()), *([batch.column("place")] if carried else [])],
                names=["row", "doc_id", "text_md5", "digest", "elements", "bands", "small", *(["place"] if carried else [])],
            )
            row += n

    return run


_SIGNED = "row long, doc_id long, text_md5 string, digest binary, elements long, bands array<long>, small binary"


def _sets(counted: bool):
    """Elements of a document as sorted 64-bit words; of a counted one with their numbers behind."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, "text"):
            e, weight, owner = _element_sets(texts(batch.column("text")), counted)
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            out = [e[a:b].tobytes() + (weight[a:b].astype(np.uint64).tobytes() if counted else b"") for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], names=["row", "members"])

    return run


def _alike(a: bytes, b: bytes, counted: bool) -> bool:
    """Whether the (generalised) Jaccard similarity is SIMILARITY or more."""
    import numpy as np

    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if counted:
        x, cx = np.split(x, 2)
        y, cy = np.split(y, 2)
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        both = np.minimum(cx[i], cy[j]).sum()
        return bool(both >= SIMILARITY * (cx.sum() + cy.sum() - both) - 1e-9)
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)) - 1e-9:
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9


def _verified(counted: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            good = [_alike(a, b, counted) for a, b in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _between(counted: bool):
    """Links between components inside one bucket, or between two blocks of a large one."""

    def run(t):
        import numpy as np
        import pyarrow as pa

        t = t.combine_chunks()
        row, comp, side = t["row"].to_numpy(), t["comp"].to_numpy(), t["side"].to_numpy()
        sets = t["members"].to_pylist()
        small = np.frombuffer(b"".join(t["small"].to_pylist()), np.uint8).reshape(len(row), -1)
        bands = np.array(t["bands"].to_pylist(), np.int64).reshape(len(row), -1)
        band = int(t["band"][0].as_py())
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side == 1).any() else (np.arange(len(row)), np.arange(len(row)))
        parent: dict[int, int] = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        agree = np.zeros((len(left), len(right)), np.uint16)
        for c in range(small.shape[1]):
            agree += small[left, c][:, None] == small[right, c][None]
        fit = (agree >= LEAST_AGREEMENT * small.shape[1]) & (comp[left][:, None] != comp[right][None])
        for c in range(band):  # a pair is looked at in the first band it shares
            fit &= bands[left, c][:, None] != bands[right, c][None]
        out = []
        i, j = np.nonzero(fit)
        for at in np.argsort(-agree[i, j].astype(int), kind="stable"):
            x, y = left[i[at]], right[j[at]]
            p, q = root(int(comp[x])), root(int(comp[y]))
            if p != q and x != y and _alike(sets[x], sets[y], counted):
                parent[max(p, q)] = min(p, q)
                out.append((int(row[x]), int(row[y])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, comp): comp is the least node connected with node. links: (a, b), any direction.

    Every round each node takes the least label around it and then that label's own label; rounds
    go on until none changes. Each round is written to the shared folder. Nodes with many links, and
    labels of large components, are met by broadcasts of bounded size.
    """
    total = 2 * links.count()
    both = store(links.select("a", "b").union(links.select("b", "a")).distinct(), total)
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"), F.count("*").alias("n")), total)
    nodes, edges = labels.count(), both.select("a", F.col("b").alias("node"))
    hubs = labels.filter(F.col("n") > HOT_LEAST).limit(1).count()
    while True:
        around = joined_by_size(edges, labels, ["node"], "n", total) if hubs else edges.join(labels, "node")
        near = around.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", "n", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        over = labels.select(F.col("node").alias("comp"), F.col("comp").alias("over"))
        if hubs:
            step = store(step, nodes)
            over = store(step.groupBy("comp").agg(F.count("*").alias("users")).join(over, "comp"), nodes)
            jump = joined_by_size(step, over, ["comp"], "users", nodes)
        else:
            jump = step.join(over, "comp")
        new = store(jump.select("node", "n", "old", F.least("comp", "over").alias("comp")), nodes)
        changed = new.filter("comp != old").limit(1).count()
        discard(labels, *([step, over] if hubs else []))
        labels = _same_files(new, "node", "n", "comp")
        if not changed:
            discard(both)
            return _same_files(new, "node", "comp")


def _same_files(stored: DataFrame, *columns: str) -> DataFrame:
    out = stored.select(*columns)
    out._plexmatch_path = stored._plexmatch_path
    return out


def near_duplicates(docs: DataFrame, counted: bool = False, id_col: str = "doc_id", text_col: str = "text", placed: bool = False) -> DataFrame:
    """doc_id, class_id, class_size, kept, elements: one row per input row.

    Two documents are linked when the Jaccard similarity of their sets of SHINGLE-word runs is
    SIMILARITY or more (with `counted`, of the multisets: each run weighs its number); a class is a
    connected component, its id the smallest doc_id in it, and the row with that id (the first read,
    if repeated) is kept. A text of fewer words has one run of all its words. Null and empty texts
    have none: each is a class of its own and kept. Null ids come last and may leave class_id null; an
    empty table gives no rows; other columns are not read. With `placed`, docs has to be read from
    Parquet and each row's place() is returned as well.

    Equal sets are collapsed first, so copies never meet as pairs. In each bucket every member is
    compared with the least one; only buckets that still hold several components are looked at
    again, in blocks of bounded size, and only blocks of different components meet. Buckets, leads
    and classes with very many rows are met by broadcasts of bounded size, and a lead's set is copied
    once for every few hundred sets that are compared with it.
    """
    d = only(docs, id_col, text_col)
    also = [place(d).alias("place")] if placed else []
    d = d.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *also)
    d = d.withColumn("text_md5", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    signed = store(d.mapInArrow(trimmed(_signed(counted, placed)), _SIGNED + ", place struct<file:bigint,at:bigint>" * placed))
    count = signed.count()
    some = signed.filter("elements > 0")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    sets = store(some.groupBy("digest").agg(head.alias("head"), F.count("*").alias("n")).select("digest", "n", "head.*").withColumnRenamed("doc_id", "id"), count)
    reps = signed.join(sets.select("row"), "row", "left_semi")
    unit = 16 if counted else 8  # bytes of a set's element

    spread = reps.select("row", "elements", F.posexplode("bands").alias("band", "bucket"))
    groups = store(spread.groupBy("band", "bucket").agg(F.min("row").alias("lead"), F.count("*").alias("n")).filter("n > 1"), BANDS * count)
    members = store(joined_by_size(spread, groups, ["band", "bucket"], "n", BANDS * sets.count()), BANDS * count)
    wanted = members.select("row").distinct()
    source = signed.join(wanted, "row", "left_semi").select("row", F.col("doc_id").alias("id"), "text_md5")
    found = d.drop("place").join(source, (d["text_md5"] == source["text_md5"]) & d["doc_id"].eqNullSafe(source["id"])).select("row", "text")
    held = store(found.mapInArrow(trimmed(_sets(counted)), "row long, members binary").dropDuplicates(["row"]), BANDS * count)

    star = store(members.filter("row != lead").select(F.col("row").alias("a"), F.col("lead").alias("b"), "elements").distinct(), BANDS * count)
    pieces = F.greatest(F.ceil(F.count("*") / HOT_LEADS), F.ceil(F.sum("elements") * unit / LEAD_BYTES)).cast("int")
    leads = store(star.groupBy("b").agg(F.count("*").alias("n"), pieces.alias("pieces")), count)
    with_a = joined_by_size(star, leads, ["b"], "n", star.count()).withColumn("piece", F.pmod(F.xxhash64("a"), F.col("pieces")).cast("int"))
    with_a = with_a.select("a", "b", "piece").join(held.select(F.col("row").alias("a"), F.col("members").alias("ma")), "a")
    with_b = leads.join(held.select(F.col("row").alias("b"), F.col("members").alias("mb")), "b").select("b", "mb", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    links = store(with_a.join(with_b, ["b", "piece"]).select("a", "b", "ma", "mb").mapInArrow(trimmed(_verified(counted)), "a long, b long"), BANDS * count)
    discard(star, leads)
    comps = components(links)

    more = store(_mixed(members, comps, unit, BANDS * count).join(held, "row").join(reps.select("row", "bands", "small"), "row").groupBy("band", "bucket", "lower", "low_piece", "upper", "high_piece").applyInArrow(_between(counted), "a long, b long"), BANDS * count)
    if more.limit(1).count():
        discard(comps)
        comps = components(links.union(more))

    owner = sets.join(comps, sets["row"] == comps["node"], "left").select("digest", F.coalesce("comp", "row").alias("comp"), "n", F.struct("none", "id", "row").alias("head"))
    classes = owner.groupBy("comp").agg(F.sum("n").alias("class_size"), F.min("head").alias("best"), F.count("*").alias("texts")).filter("class_size > 1")
    special = joined_by_size(owner, store(classes, count), ["comp"], "texts", sets.count()).select("digest", "n", "class_size", F.col("best.id").alias("class_id"), F.col("best.row").alias("keep_row"))
    special = store(special, count)
    out = joined_by_size(signed.filter("elements > 0"), special, ["digest"], "n", count, "left")
    discard(sets, groups, members, held, links, more, comps)
    alone = F.col("keep_row").isNull()
    out = out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
        F.when(alone, True).otherwise(F.col("row") == F.col("keep_row")).alias("kept"),
        "elements",
        *(["place"] if placed else []),
    )
    none = signed.filter("elements = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "elements", *(["place"] if placed else []))
    return out.unionByName(none)


def _mixed(members: DataFrame, comps: DataFrame, unit: int, rows: int) -> DataFrame:
    """Members of buckets that hold several components, once for each pair of blocks to compare.

    A component that fills several blocks, and a LARGE-th of the bucket at least, has blocks of its own,
    which never meet each other; the bucket's other members share blocks, which meet all.
    """
    tagged = members.join(comps, members["row"] == comps["node"], "left").select("band", "bucket", "row", "elements", F.coalesce("comp", "row").alias("comp"))
    blocks = lambda n, e: F.greatest(F.ceil(n / BLOCK), F.ceil(e * unit / BLOCK_BYTES)).cast("int")
    per = tagged.groupBy("band", "bucket", "comp").agg(F.count("*").alias("c"), F.sum("elements").alias("e")).withColumn("pieces", blocks(F.col("c"), F.col("e")))
    big = F.collect_list(F.when(F.col("pieces") > 1, F.struct("comp", "pieces", "c", "e")))
    mixed = per.groupBy("band", "bucket").agg(F.sum("c").alias("n"), F.sum("e").alias("e"), F.count("*").alias("comps"), big.alias("big"))
    mixed = mixed.filter("comps > 1 AND n > 2")  # of two members, one is the lead
    mixed = mixed.withColumn("large", F.filter("big", lambda x: x["c"] * LARGE >= F.col("n")))
    left = lambda whole, field: F.col(whole) - F.aggregate("large", F.lit(0).cast("long"), lambda a, x: a + x[field])
    mixed = mixed.withColumn("shared", F.when(left("n", "c") > 0, blocks(left("n", "c"), left("e", "e"))).otherwise(0)).select("band", "bucket", "n", "large", "shared")
    mixed = store(mixed, rows)
    rows = joined_by_size(tagged, mixed, ["band", "bucket"], "n", members.count())
    mine = F.get(F.filter("large", lambda x: x["comp"] == F.col("comp")), F.lit(0))["pieces"]
    rows = rows.withColumn("pieces", F.coalesce(mine, F.lit(0))).withColumn("own", F.when(F.col("pieces") > 0, F.col("comp")).otherwise(-1))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("row"), F.when(F.col("pieces") > 0, F.col("pieces")).otherwise(F.col("shared"))).cast("int"))
    places = lambda who, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(who.cast("long").alias("who"), i.alias("piece")))).otherwise(F.array().cast("array<struct<who:bigint,piece:int>>"))
    others = F.concat(F.flatten(F.transform(F.filter("large", lambda x: x["comp"] != F.col("own")), lambda x: places(x["comp"], x["pieces"]))), places(F.lit(-1), F.col("shared")))
    rows = rows.withColumn("other", F.explode(others))
    first = (F.col("own") < F.col("other.who")) | ((F.col("own") == F.col("other.who")) & (F.col("piece") <= F.col("other.piece")))
    return rows.select(
        "band", "bucket", "row", "comp", F.when(first, 0).otherwise(1).alias("side"),
        F.when(first, F.col("own")).otherwise(F.col("other.who")).alias("lower"), F.when(first, F.col("piece")).otherwise(F.col("other.piece")).alias("low_piece"),
        F.when(first, F.col("other.who")).otherwise(F.col("own")).alias("upper"), F.when(first, F.col("other.piece")).otherwise(F.col("piece")).alias("high_piece"),
    )


def near_deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns."""
    docs = from_files(docs)
    return without(docs, near_duplicates(docs, placed=True).filter("not kept"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_weighted_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over multisets: a run of words weighs as often as it stands in a text."""
    return near_duplicates(table(spark, sf_dir, "documents"), counted=True)


def _oracle(counted: bool) -> str:
    """Classes by exact similarity of all pairs that share a run; the size of a counted set is the sum of its numbers."""
    return r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT r, g, WEIGHT AS m FROM (SELECT r, unnest([array_to_string(w[i + 1 : i + 5], ' ') FOR i IN range(greatest(1, len(w) - 4))]) AS g
  FROM d WHERE len(w) > 0) GROUP BY r, g),
n AS (SELECT r, sum(m) AS n, count(*) AS elements FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, sum(least(a.m, b.m)) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
k AS (SELECT r, r AS m FROM d UNION SELECT k.r, e.y FROM k JOIN e ON e.x = k.m),
c AS (SELECT r, min(m) AS m, count(*) AS class_size FROM k GROUP BY r)
SELECT d.doc_id, h.doc_id AS class_id, c.class_size::BIGINT AS class_size, c.m = c.r AS kept, coalesce(n.elements, 0)::BIGINT AS elements
FROM c JOIN d ON d.r = c.r JOIN d h ON h.r = c.m LEFT JOIN n ON n.r = c.r
""".replace("WEIGHT", "count(*)" if counted else "1")


OP2_SQL, OP2_WEIGHTED_SQL = _oracle(False), _oracle(True)
