"""Language identification by Bayesian fusion of independent evidence.

log P(l | all) = log P(text | l) + log P(declared | l) + log P(address | l) + log P(l | host) + const

Text likelihoods are smoothed byte n-gram frequencies per language, counted by grouped
aggregation over all labelled rows of the learning fold. Declared markup language and address
suffix are noisy witnesses of stated reliability. Host priors are counted by grouped aggregation
and smoothed hierarchically: host towards its registered domain, that towards the whole corpus.
One more class, `und`, has a flat text model and wins over texts that no learned language explains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, from_files, joined_by_size, only, place, sliced, store, table, texts, trimmed, without
from .textkit import byte_grams, joined

GRAM, BITS = 3, 14
SLICE = 1 << 20  # bytes of text worked on at once: some 40 MB of arrays
MAX_LANGUAGES = 256  # of one block of the model, which bounds what a task holds: 2**BITS floats a language
SMOOTHING = 0.1
TEMPER = 0.25  # neighbouring n-grams overlap: their joint weight is lowered
WITNESS_DECLARED, WITNESS_ADDRESS = 0.9, 0.8  # chance that a witness names the true language
HOST_WEIGHT = 20.0  # rows of its parent that a host's or domain's counts are smoothed with
UND, UND_PRIOR = "und", 1e-3
LEAST_POSTERIOR = 0.3
ACCEPTED = f"language != '{UND}' AND posterior >= {LEAST_POSTERIOR}"
FOLDS = 5
MAX_BROADCAST_HOSTS = 50_000
_MARKUP = r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})"
_TOP_LEVEL = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*\.([a-z]{2})(?:[:/?#]|$)"
_PATH = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)"

#: Scripts, styles, navigation and comments (one that is not closed runs to the end), then tags, then entities.
_UNSEEN = (r"(?is)<(script|style|nav)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", r"<[^>]*(?:>|\z)", r"&#?\w+;")


def _count(languages: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((len(languages), 1 << BITS), np.int64)
        at = {x: i for i, x in enumerate(languages)}
        for batch in sliced(batches, "text", SLICE):
            gram, owner = byte_grams(*joined(texts(batch.column("text"))), GRAM, BITS)
            of = np.array([at[x] for x in batch.column("label").to_pylist()], np.int64)
            total += np.bincount((of[owner] << BITS) + gram, minlength=total.size).reshape(total.shape)
        which, gram = np.nonzero(total)
        if len(which):
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(gram, pa.int32()), pa.array(total[which, gram])], names=["language", "gram", "n"])

    return run


def _likelihoods(log_text, name: str, last: bool):
    """Adds the scores of one block of languages as column `name`; the text goes with the last block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, "text", SLICE):
            whole = texts(batch.column("text"))
            gram, owner = byte_grams(*joined(whole), GRAM, BITS)
            each = [TEMPER * np.bincount(owner, row[gram], minlength=batch.num_rows) for row in log_text]
            flat = np.column_stack(each).ravel()
            offsets = np.arange(0, len(flat) + 1, len(log_text), dtype=np.int32)
            out = batch.drop_columns(["text"]) if last else batch
            columns, names = [*out.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*out.schema.names, name]
            if last:
                columns += [pa.array(np.bincount(owner, minlength=batch.num_rows).astype(np.int64)), pa.array([len(t) < GRAM and not t.strip() for t in whole], pa.bool_())]
                names += ["n_grams", "blank"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def evidence(rows: DataFrame) -> DataFrame:
    """From columns key, text, url, host, label add declared, address, host and domain; all may be null."""
    url = F.coalesce(F.col("url"), F.lit(""))
    tag = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), _MARKUP, 1))
    top, path = F.lower(F.regexp_extract(url, _TOP_LEVEL, 1)), F.lower(F.regexp_extract(url, _PATH, 1))
    host = F.coalesce(F.col("host"), F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit("")), F.lit(""))
    return rows.withColumns({"declared": tag, "address": F.when(path != "", path).otherwise(top), "host": host}).withColumn("domain", F.substring_index("host", ".", -2))


class Model:
    """Text log-likelihoods by language and gram, in blocks of languages, and the corpus-wide language prior."""

    def __init__(self, languages, blocks, prior):
        self.languages, self.blocks, self.prior = languages, blocks, prior


def learn(labelled: DataFrame) -> Model:
    """From columns text and label, all rows and all labels, which are counted MAX_LANGUAGES at a time."""
    import numpy as np

    known = labelled.filter("label is not null")
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # one row a language
    languages = sorted(size)
    blocks = []
    for at in range(0, len(languages), MAX_LANGUAGES):
        block = languages[at : at + MAX_LANGUAGES]
        counts = np.full((len(block), 1 << BITS), SMOOTHING)
        rows = known.filter(F.col("label").isin(block)).select("text", "label")
        found = rows.mapInArrow(trimmed(_count(block)), "language int, gram int, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()
        counts[found["language"].to_numpy(), found["gram"].to_numpy()] += found["n"].to_numpy()  # MAX_LANGUAGES * 2**BITS rows at most
        blocks.append(np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))
    flat = np.full((1, 1 << BITS), -BITS * np.log(2)).astype(np.float32)
    blocks[-1:] = [np.concatenate([*blocks[-1:], flat])]
    total = sum(size.values())
    prior = [(1 - UND_PRIOR) * (size[x] + 1) / (total + len(languages)) for x in languages] + [UND_PRIOR if languages else 1.0]
    return Model([*languages, UND], blocks, prior)


def _level(rows: DataFrame, key: str, languages: list[str], parent: DataFrame | None, corpus: list[float], above: str | None) -> DataFrame:
    """key -> smoothed share of each language; parent: the same one level up."""
    n = len(languages)
    one = [F.sum((F.col("label") == x).cast("double")) for x in languages]
    sums = rows.filter(F.col("label").isNotNull()).groupBy(*([key] if above is None else [key, above])).agg(F.array(*[F.coalesce(x, F.lit(0.0)) for x in one]).alias("c"))
    if parent is None:
        base = F.array(*map(F.lit, corpus))
    else:
        sums = sums.join(parent, above)
        base = F.col(f"{above}_share")
    whole = F.aggregate("c", F.lit(0.0), lambda a, x: a + x) + HOST_WEIGHT
    share = F.zip_with("c", base, lambda c, b: (c + b * HOST_WEIGHT) / whole)
    assert n == len(corpus)
    return sums.select(key, share.alias(f"{key}_share"))


def identify(rows: DataFrame, model: Model, hosts: DataFrame, keep: list[str]) -> DataFrame:
    """`rows` as evidence() returns them, with language, posterior and n_grams; columns `keep` stay.

    hosts: labelled rows (host, domain, label) that the host priors are counted from.
    """
    names, corpus = model.languages, model.prior
    domain = _level(hosts, "domain", names, None, corpus, None)
    host = _level(hosts.filter("host != ''"), "host", names, domain, corpus, "domain")
    host = store(host)
    few = host.count() <= MAX_BROADCAST_HOSTS
    known = F.array(*map(F.lit, names))
    others = max(1, len(names) - 1)
    scored = rows.select(*keep, "host", "declared", "address", "text")
    parts = [f"score_{k}" for k in range(len(model.blocks))]
    for name, block in zip(parts, model.blocks, strict=True):
        last = name == parts[-1]
        fields = [f for f in scored.schema.fields if not (last and f.name == "text")]
        fields.append(T.StructField(name, T.ArrayType(T.DoubleType())))
        if last:
            fields += [T.StructField("n_grams", T.LongType()), T.StructField("blank", T.BooleanType())]
        scored = scored.mapInArrow(trimmed(_likelihoods(block, name, last)), T.StructType(fields))
    scored = scored.withColumn("score", F.concat(*parts))

    def witness(column: str, sure: float):
        said = F.when(F.array_contains(known, F.col(column)) & (F.col(column) != UND), F.col(column))
        return lambda x: F.when(said.isNull() | (x == UND), 0.0).when(said == x, F.log(F.lit(sure))).otherwise(F.log(F.lit((1 - sure) / others)))

    told, at = witness("declared", WITNESS_DECLARED), witness("address", WITNESS_ADDRESS)
    share = F.coalesce(F.col("host_share"), F.array(*map(F.lit, corpus)))
    prior = F.zip_with(known, share, lambda x, p: F.log(p) + told(x) + at(x))
    if few:
        fused = scored.join(F.broadcast(host), "host", "left")
    else:  # a shuffle of scores, not of texts; rows without a host are spread by their scores
        sizes = rows.groupBy("host").agg(F.count("*").alias("rows"))
        scored = scored.withColumn("host", F.when(F.col("host") == "", F.concat(F.lit(" "), F.xxhash64("score").cast("string"))).otherwise(F.col("host")))
        fused = joined_by_size(scored, store(host.join(sizes, "host")), ["host"], "rows", rows.count(), "left")
    fused = fused.withColumn("total", F.zip_with("score", prior, lambda a, b: a + b))
    top = F.array_max("total")
    weight = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    language = F.element_at(known, F.array_position("total", top).cast("int"))
    return fused.select(*keep, F.when(F.col("blank"), UND).otherwise(language).alias("language"), F.when(F.col("blank"), 0.0).otherwise(1 / weight).alias("posterior"), "n_grams")


def document_rows(docs: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Documents as evidence rows: the source column is the host, the lang column the label of learning rows."""
    d = only(docs, "doc_id", "text", "lang", "source", *(also or []))
    held = crc_mod(F.col("doc_id"), FOLDS) == 0
    rows = d.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("url"), F.col("source").alias("host"), F.when(~held, F.col("lang")).alias("label"), held.alias("held_out"), *(also or []))
    return evidence(rows)


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, language, posterior, n_grams, accepted: one row per input row.

    Labels (column lang) of the held-out fold are not read. A null or empty text, or one or two blanks,
    is `und` with posterior 0, not accepted; for other texts of one or two bytes, which have no n-grams,
    the host prior alone decides. Null host: the corpus prior. Null ids and repeated rows are kept as
    they come; an empty table gives no rows; with no label at all every row is `und`; columns other
    than doc_id, text, lang and source are not read.
    """
    rows = document_rows(docs)
    model = learn(rows.select("text", "label"))
    found = identify(rows, model, rows.select("host", "domain", "label"), ["doc_id", "held_out"])
    return found.withColumn("accepted", F.expr(ACCEPTED))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that identify_documents() accepts, with all their columns."""
    docs = from_files(docs)
    d = only(docs, "doc_id", "text", "lang", "source")
    rows = document_rows(d.withColumn("place", place(d)), ["place"])
    model = learn(rows.select("text", "label"))
    found = identify(rows, model, rows.select("host", "domain", "label"), ["place"])
    return without(docs, found.filter(f"NOT ({ACCEPTED})"))


def visible(html):
    """The text of a page without markup."""
    for pattern in _UNSEEN:
        html = F.regexp_replace(html, pattern, " ")
    return html


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, language, posterior, n_grams, accepted: one row per page.

    The model is the one identify_documents() learns from docs. Markup language and address are those
    of html and url, n-grams those of the visible text. No labelled row has a web host, so hosts that
    are no source of docs have the corpus prior. A page without visible text is treated as a document
    without text; a null url says nothing; null ids and repeated rows are kept as they come; an empty
    table gives no rows; columns other than page_id, url and html are not read.
    """
    null = F.lit(None).cast("string")
    learned = document_rows(docs)
    model = learn(learned.select("text", "label"))
    raw = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").alias("text"), null.alias("host"), null.alias("label"))
    rows = evidence(raw).withColumn("text", F.trim(visible(F.col("text"))))
    found = identify(rows, model, learned.select("host", "domain", "label"), ["page_id"])
    return found.withColumn("accepted", F.expr(ACCEPTED))


def op6_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))
