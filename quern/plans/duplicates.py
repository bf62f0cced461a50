"""Duplicates, and held-out items inside documents, by the plain operators of the core."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.checkpoints import written
from quern.operators import signatures as g
from quern.operators.similar import similar_classes, similar_documents, survivors
from quern.plans.registry import query, table

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')"
_RECORDS = "recs AS (SELECT id, max(text) AS text, max(dataset) AS dataset FROM normalized_documents WHERE id IS NOT NULL GROUP BY id)"
_HASHED = f"{_RECORDS}, h AS (SELECT id, dataset, sha256(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS n_chars FROM recs)"


def documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", "source", "band", "text")


def records(spark, folder):
    rows = table(spark, folder, "normalized_documents").where("id IS NOT NULL")
    return rows.groupBy("id").agg(F.max("text").alias("text"), F.max("dataset").alias("dataset"))


def hashed(spark, folder):
    """Records by the hash of their text; the text itself isn't carried to later shuffles."""
    text = F.coalesce("text", F.lit(""))
    return records(spark, folder).select("id", "dataset", F.sha2(text, 256).alias("digest"), F.length(text).alias("n_chars"))


@query("ded01_lowest_band", "WITH h AS (SELECT doc_id, band, sha256(coalesce(text, '')) AS digest FROM documents) SELECT doc_id, band FROM h QUALIFY row_number() OVER (PARTITION BY digest ORDER BY band NULLS LAST, doc_id) = 1")
def lowest_band(spark, folder):
    """Of equal texts the one in the lowest band stays (then the lowest id): an aggregation, so a text copied very often is
    combined before the shuffle."""
    rows = documents(spark, folder).select("doc_id", "band", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min(F.struct(F.col("band").isNull().alias("none"), "band", "doc_id")).alias("m")).select("m.doc_id", "m.band")


@query("ded02_stored_hashes", "SELECT lower(trim(hash)) AS hash, min(id) AS id, count(DISTINCT id) AS n_records FROM normalized_documents WHERE hash IS NOT NULL GROUP BY 1")
def stored_hashes(spark, folder):
    return table(spark, folder, "normalized_documents").where("hash IS NOT NULL").groupBy(F.lower(F.trim("hash")).alias("hash")).agg(F.min("id").alias("id"), F.countDistinct("id").alias("n_records"))


@query("ded03_exact_classes", f"WITH {_HASHED} SELECT id, min(id) OVER (PARTITION BY digest) AS canonical_id, count(*) OVER (PARTITION BY digest) AS class_size FROM h")
def exact_classes(spark, folder):
    """Every record with the canonical record of its text: membership instead of all pairs."""
    h = hashed(spark, folder)
    classes = h.groupBy("digest").agg(F.min("id").alias("canonical_id"), F.count("*").alias("class_size"))
    return h.join(classes, "digest").select("id", "canonical_id", "class_size")


_BITS = " + ".join(f"CASE WHEN b{b} >= 0 THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64))
_SIM = f"""toks AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents),
hs AS (SELECT doc_id, ('0x' || substr(sha256(w), 49, 16))::UBIGINT AS h FROM toks),
sums AS (SELECT doc_id, {", ".join(f"sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) AS b{b}" for b in range(64))} FROM hs GROUP BY doc_id),
sim AS (SELECT doc_id, {_BITS} AS s FROM sums)"""


@query("ded04_simhash", f"WITH {_SIM} SELECT doc_id, (CASE WHEN s >= 9223372036854775808::HUGEINT THEN s - 18446744073709551616::HUGEINT ELSE s END)::BIGINT AS simhash FROM sim")
def simhashes(spark, folder):
    return g.simhash(documents(spark, folder), "doc_id", g.words(F.col("text")))


@query("ded05_hamming", "SELECT v.vec_id, bit_count(xor(v.vec_id::BIGINT, w.m))::INT AS distance FROM embeddings v, (SELECT max(vec_id)::BIGINT AS m FROM embeddings) w")
def hamming(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"))
    return rows.join(F.broadcast(rows.agg(F.max("vec_id").alias("m")))).select("vec_id", g.hamming(F.col("vec_id"), F.col("m")).alias("distance"))


_GRAMS3 = "list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))"
_MIN = f"""w AS (SELECT item_id, {_TOKENS.replace("text", "question")} AS ws FROM eval_items),
gr AS (SELECT item_id, unnest(CASE WHEN len(ws) >= 3 THEN {_GRAMS3} ELSE [NULL] END) AS gram FROM w),
hh AS (SELECT item_id, ('0x' || substr(md5(gram), 25, 8))::BIGINT AS h FROM gr),
sig AS (SELECT item_id, {", ".join(f"coalesce(min((h + {i}) % 4294967296), 4294967295) AS m{i}" for i in range(g.PERMUTATIONS))} FROM hh GROUP BY item_id)"""


@query("ded06_minhash", f"WITH {_MIN} SELECT item_id, [{', '.join(f'm{i}' for i in range(g.PERMUTATIONS))}] AS signature FROM sig")
def minhashes(spark, folder):
    items = table(spark, folder, "eval_items")
    return g.minhash(items, "item_id", g.word_grams(g.words(F.col("question")), 3))


@query("ded07_estimates", f"WITH {_MIN}, l AS (SELECT item_id, [{', '.join(f'm{i}' for i in range(g.PERMUTATIONS))}] AS s FROM sig), f AS (SELECT s AS fs FROM l ORDER BY item_id LIMIT 1) SELECT item_id, round(len(list_filter(list_zip(s, fs), lambda p: p[1] = p[2])) / {g.PERMUTATIONS}::DOUBLE, 6) AS similarity FROM l, f")
def estimates(spark, folder):
    """Estimated similarity of each item with the first one."""
    s = minhashes(spark, folder)
    first = s.orderBy("item_id").limit(1).select(F.col("signature").alias("fs"))
    return s.join(F.broadcast(first)).select("item_id", F.round(g.agreement(F.col("signature"), F.col("fs")), 6).alias("similarity"))


@query("ded06_documents")
def document_minhashes(spark, folder):
    """MinHash signature of every document. No SQL: it would take minutes."""
    return g.minhash(documents(spark, folder), "doc_id", g.word_grams(g.words(F.col("text")), 3))


def candidate_pairs(spark, folder):
    """``doc_a < doc_b``: the first documents of linked classes."""
    members, linked = similar_classes(documents(spark, folder), "doc_id", "text")
    heads = members.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    a, b = heads.select(F.col("class").alias("class_a"), F.col("doc_id").alias("x")), heads.select(F.col("class").alias("class_b"), F.col("doc_id").alias("y"))
    return written(linked.join(a, "class_a").join(b, "class_b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")), "candidate_pairs")


def _of_pairs(spark, folder, signature, name, value):
    """The pairs with a value of both documents' signatures; only documents of a pair are signed."""
    pairs = candidate_pairs(spark, folder)
    of_pairs = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    signed = written(signature(documents(spark, folder).join(of_pairs, "doc_id", "left_semi")), "signed")
    column = signed.columns[1]
    a, b = signed.select(F.col("doc_id").alias("doc_a"), F.col(column).alias("sa")), signed.select(F.col("doc_id").alias("doc_b"), F.col(column).alias("sb"))
    return pairs.join(a, "doc_a").join(b, "doc_b").select("doc_a", "doc_b", value(F.col("sa"), F.col("sb")).alias(name))


@query("ded05_documents")
def document_distances(spark, folder):
    """Hamming distance of the SimHashes of candidate pairs."""
    return _of_pairs(spark, folder, lambda d: g.simhash(d, "doc_id", g.words(F.col("text"))), "distance", g.hamming)


@query("ded07_documents")
def document_estimates(spark, folder):
    """Similarity of candidate pairs as their MinHash signatures estimate it."""
    return _of_pairs(spark, folder, lambda d: g.minhash(d, "doc_id", g.word_grams(g.words(F.col("text")), 3)), "similarity", lambda a, b: F.round(g.agreement(a, b), 6))


@query("ded08_similar_documents")
def similar(spark, folder):
    """One row for each document: its class of equal texts and the links of the class (five-word sequences, similarity 0.8)."""
    return similar_documents(documents(spark, folder), "doc_id", "text")


@query("ded09_merged")
def merged(spark, folder):
    """The documents that stay when equal and similar ones are merged, the longest first."""
    members, linked = similar_classes(documents(spark, folder), "doc_id", "text")
    lengths = documents(spark, folder).select("doc_id", F.length("text").alias("n"))
    return survivors(members, linked, lengths, "doc_id", "n")


@query("ded10_first_in_batch", "SELECT doc_id // 500 AS batch, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents) GROUP BY doc_id // 500, digest")
def first_in_batch(spark, folder):
    """The first of equal texts in each batch of 500 consecutive ids."""
    rows = documents(spark, folder).select("doc_id", F.floor(F.col("doc_id") / 500).alias("batch"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return rows.groupBy("batch", "digest").agg(F.min("doc_id").alias("doc_id")).select("batch", "doc_id")


@query("ded11_repeated_ids", "SELECT id, count(*) AS n FROM normalized_documents GROUP BY id HAVING count(*) > 1")
def repeated_ids(spark, folder):
    return table(spark, folder, "normalized_documents").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query("ded12_first_positions", "SELECT first_id, n FROM (SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY lower(trim(coalesce(text, ''))))")
def first_positions(spark, folder):
    key = F.xxhash64(F.lower(F.trim(F.coalesce("text", F.lit("")))))
    return documents(spark, folder).select("doc_id", key.alias("k")).groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).select("first_id", "n")


@query("ded13_savings", f"WITH {_HASHED}, d AS (SELECT dataset, digest, count(*) AS n, max(n_chars) AS n_chars FROM h GROUP BY ALL) SELECT dataset, sum(n)::BIGINT AS before, count(*) AS after, sum((n - 1) * n_chars)::BIGINT AS saved_chars FROM d GROUP BY dataset")
def savings(spark, folder):
    d = hashed(spark, folder).groupBy("dataset", "digest").agg(F.count("*").alias("n"), F.max("n_chars").alias("n_chars"))
    return d.groupBy("dataset").agg(F.sum("n").alias("before"), F.count("*").alias("after"), F.sum((F.col("n") - 1) * F.col("n_chars")).alias("saved_chars"))


def normal(column):
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


GRAM = 13
_NORMAL = "trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"
_GRAMS = "list_distinct(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' ')))"
_SHARED = f"""dw AS (SELECT doc_id, string_split({_NORMAL.format("text")}, ' ') AS ws FROM documents), iw AS (SELECT item_id, benchmark, string_split({_NORMAL.format("question")}, ' ') AS ws FROM eval_items),
dg AS (SELECT doc_id, unnest({_GRAMS}) AS gram FROM dw WHERE len(ws) >= 13), ig AS (SELECT DISTINCT benchmark, unnest({_GRAMS}) AS gram FROM iw WHERE len(ws) >= 13),
shared AS (SELECT doc_id, benchmark, count(DISTINCT gram) AS n_shared FROM dg JOIN ig USING (gram) GROUP BY ALL)"""


def item_grams(spark, folder):
    items = table(spark, folder, "eval_items").select("benchmark", F.split(normal("question"), " ").alias("w"))
    return items.select("benchmark", F.explode(g.gram_hashes(F.col("w"), GRAM)).alias("gram")).distinct()


def shared_grams(spark, folder):
    """Distinct shared sequences by document and benchmark. The items are a fixed table of a few hundred rows, so the join
    keeps the documents' side where it is."""
    docs = documents(spark, folder).select("doc_id", F.split(normal("text"), " ").alias("w"))
    grams = docs.select("doc_id", F.explode(g.gram_hashes(F.col("w"), GRAM)).alias("gram"))
    return grams.join(item_grams(spark, folder), "gram").groupBy("doc_id", "benchmark").agg(F.countDistinct("gram").alias("n_shared"))


@query("dcn01_item_grams", f"WITH {_SHARED} SELECT benchmark, count(DISTINCT gram) AS n_grams FROM ig GROUP BY benchmark")
def item_gram_counts(spark, folder):
    return item_grams(spark, folder).groupBy("benchmark").agg(F.count("*").alias("n_grams"))


@query("dcn02_shared_grams", f"WITH {_SHARED} SELECT * FROM shared")
def shared(spark, folder):
    return shared_grams(spark, folder)


LOOSE_GRAM = 8
_LOOSE = "list_distinct(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' ')))"


@query("dcn05_strictest_layer", f"""WITH {_SHARED}, layers AS (SELECT doc_id, 1 AS layer FROM shared UNION ALL
  SELECT d.doc_id, 2 FROM (SELECT doc_id, unnest({_LOOSE}) AS gram FROM dw WHERE len(ws) >= 8) d JOIN (SELECT DISTINCT unnest({_LOOSE}) AS gram FROM iw WHERE len(ws) >= 8) i USING (gram))
  SELECT doc_id, min(layer) AS layer FROM layers GROUP BY doc_id""")
def strictest_layer(spark, folder):
    """A document belongs to its strictest layer: long shared sequences before shorter ones."""
    first = shared_grams(spark, folder).select("doc_id", F.lit(1).alias("layer"))
    items = table(spark, folder, "eval_items").select(F.split(normal("question"), " ").alias("w")).select(F.explode(g.gram_hashes(F.col("w"), LOOSE_GRAM)).alias("gram")).distinct()
    docs = documents(spark, folder).select("doc_id", F.split(normal("text"), " ").alias("w")).select("doc_id", F.explode(g.gram_hashes(F.col("w"), LOOSE_GRAM)).alias("gram"))
    return first.union(docs.join(items, "gram").select("doc_id", F.lit(2).alias("layer"))).groupBy("doc_id").agg(F.min("layer").alias("layer"))


@query("dcn06_report", f"WITH {_SHARED} SELECT b.benchmark, count(DISTINCT s.doc_id) AS n_documents, CASE WHEN count(DISTINCT s.doc_id) = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS verdict FROM (SELECT DISTINCT benchmark FROM eval_items) b LEFT JOIN shared s USING (benchmark) GROUP BY b.benchmark")
def report(spark, folder):
    names = table(spark, folder, "eval_items").select("benchmark").distinct()
    found = names.join(shared_grams(spark, folder), "benchmark", "left").groupBy("benchmark").agg(F.countDistinct("doc_id").alias("n_documents"))
    return found.withColumn("verdict", F.when(F.col("n_documents") == 0, "APPROVED").otherwise("REJECTED"))


@query("dcn04_nearest", """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id, e.vec_id AS other, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
  SELECT vec_id, arg_max(other, (c, -other)) AS nearest, round(max(c), 4) AS cosine FROM s GROUP BY vec_id""")
def nearest(spark, folder):
    """Nearest neighbour of each query row (ids divisible by 100), against all rows. The queries, a hundredth of the rows, go
    out in blocks of bounded size; each block is one scan with a partial maximum for each query before the shuffle."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)))
    queries = rows.where(F.col("vec_id") % 100 == 0)
    dot = F.aggregate(F.zip_with("e", "qe", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = None
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select(F.col("vec_id").alias("q"), F.col("e").alias("qe"), F.col("norm").alias("qn"))
        part = rows.join(F.broadcast(block), F.col("q") != F.col("vec_id")).select(F.col("q").alias("vec_id"), (dot / (F.col("norm") * F.col("qn"))).alias("c"), F.col("vec_id").alias("other"))
        part = part.groupBy("vec_id").agg(F.max(F.struct("c", (-F.col("other")).alias("back"))).alias("m"))
        scored = part if scored is None else scored.union(part)
    return scored.select("vec_id", (-F.col("m.back")).alias("nearest"), F.round("m.c", 4).alias("cosine"))


#: Query vectors in one broadcast block.
QUERY_BLOCK = 10_000


@query("dcn07_last_outcomes", "SELECT id, arg_max(is_rejected, (processed_at, uuid)) AS is_rejected, max(processed_at) AS processed_at, count(*) AS n_runs FROM band_records WHERE id IS NOT NULL GROUP BY id")
def last_outcomes(spark, folder):
    rows = table(spark, folder, "band_records").where("id IS NOT NULL").select("id", "processed_at", "uuid", "is_rejected")
    counts = rows.groupBy("id").agg(F.max(F.struct("processed_at", "uuid", "is_rejected")).alias("m"), F.count("*").alias("n_runs"))
    return counts.select("id", "m.is_rejected", "m.processed_at", "n_runs")


@query("dcn09_broken_ends", "SELECT doc_id, ended, starts FROM (SELECT doc_id, regexp_matches(text, '[\\p{L}\\p{N}]$') AS ended, regexp_matches(text, '^[a-z]') AS starts FROM documents) WHERE ended AND starts")
def broken_ends(spark, folder):
    """Documents that begin and end inside a sentence, as parts cut at a block's end do."""
    d = documents(spark, folder).select("doc_id", F.col("text").rlike(r"[\p{L}\p{N}]\z").alias("ended"), F.col("text").rlike("^[a-z]").alias("starts"))
    return d.where("ended AND starts")
