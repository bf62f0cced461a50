"""Choosing, ordering and packing of records: budgets, batches, strata, blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators.budgets import fill, with_total_before
from quern.operators.sequences import block_spans, block_totals
from quern.operators.versions import last_version
from quern.plans.registry import query, table

BLOCK, BATCH, BUDGET, SEED = 4096, 250, 20_000, 42
#: Target shares and domains allowed of each band, as a small policy table.
POLICY = (("B0", 0.25, "general_web_clean"), ("B1", 0.25, "education"), ("B1", 0.25, "general_web_clean"), ("B2", 0.2, "encyclopedic"), ("B2", 0.2, "education"), ("B3", 0.15, "math_science"), ("B3", 0.15, "code_repos"), ("B4", 0.1, "math_science"), ("B5", 0.05, "planning_reasoning_curated"))
_POLICY = "policy(band, ratio, domain) AS (VALUES " + ", ".join(f"('{b}', {r}::DOUBLE, '{d}')" for b, r, d in POLICY) + ")"
_N = "length(coalesce(text, ''))"
_DOCS = f"d AS (SELECT doc_id, source, lang, domain, band, {_N} AS n FROM documents)"


def docs(spark, folder):
    """Documents with their length; the text goes no further."""
    return table(spark, folder, "documents").select("doc_id", "source", "lang", "domain", "band", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))


def policy(spark):
    return spark.createDataFrame(POLICY, "band string, ratio double, domain string")


def targets(spark, folder, total=BUDGET * 100):
    """Target of each (band, domain) that occurs: the band's share of the budget over its allowed domains that are there."""
    there = docs(spark, folder).groupBy("band", "domain").agg(F.count("*").alias("n_documents"), F.sum("n").alias("available"))
    allowed = there.join(F.broadcast(policy(spark)), ["band", "domain"])
    number = F.count("*").over(Window.partitionBy("band"))
    return allowed.withColumn("target", F.floor(F.col("ratio") * total / number))


_TARGETS = f"{_DOCS}, {_POLICY}, there AS (SELECT band, domain, count(*) AS n_documents, sum(n)::BIGINT AS available FROM d GROUP BY ALL), targets AS (SELECT band, domain, n_documents, available, floor(ratio * {BUDGET * 100} / count(*) OVER (PARTITION BY band))::BIGINT AS target FROM there JOIN policy USING (band, domain))"


@query("sel01_targets", f"WITH {_TARGETS} SELECT * FROM targets")
def bucket_targets(spark, folder):
    return targets(spark, folder).select("band", "domain", "n_documents", "available", "target")


SCORE = "CASE WHEN n > 0 THEN CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * least(n, 100) / 512 ELSE CAST(0.3 AS DOUBLE) END"


@query("sel02_scores", f"WITH {_DOCS} SELECT doc_id, round({SCORE}, 6) AS score FROM d")
def scores(spark, folder):
    return docs(spark, folder).select("doc_id", F.round(F.expr(SCORE), 6).alias("score"))


@query("sel03_greedy_fill", f"WITH {_TARGETS}, r AS (SELECT d.*, target, coalesce(sum(n) OVER (PARTITION BY band, domain ORDER BY n DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN targets USING (band, domain)) SELECT doc_id, band, domain FROM r WHERE before < target")
def greedy_fill(spark, folder):
    """The longest documents of each bucket, down to its target."""
    rows = docs(spark, folder).join(F.broadcast(targets(spark, folder).select("band", "domain", "target")), ["band", "domain"])
    return fill(rows, ["band", "domain"], "n", "doc_id", "n", "target").select("doc_id", "band", "domain")


@query("sel04_allowed_languages", "SELECT doc_id FROM documents WHERE lang IN ('en', 'hi', 'ta')")
def allowed_languages(spark, folder):
    allowed = spark.createDataFrame([("en",), ("hi",), ("ta",)], "lang string")
    return docs(spark, folder).join(F.broadcast(allowed), "lang", "left_semi").select("doc_id")


@query("sel06_top_up", f"WITH {_DOCS}, r AS (SELECT doc_id, lang, sum(n) OVER (PARTITION BY lang ORDER BY n DESC, doc_id DESC) AS upto FROM d WHERE lang IS NOT NULL) SELECT doc_id, lang FROM r WHERE upto <= {BUDGET}")
def top_up(spark, folder):
    """The documents of each language that fit its budget, up to the first that doesn't."""
    rows = with_total_before(docs(spark, folder).where("lang IS NOT NULL"), ["lang"], "n", "doc_id", "n")
    return rows.where(F.col("before") + F.col("n") <= BUDGET).select("doc_id", "lang")


@query("sel07_trim", f"WITH {_DOCS}, s AS (SELECT source, sum(n) AS total, sum(sum(n)) OVER () AS everything FROM d GROUP BY source), x AS (SELECT source, total - 0.05::DOUBLE * everything AS excess FROM s WHERE total > 0.05::DOUBLE * everything), r AS (SELECT doc_id, source, excess, coalesce(sum(n) OVER (PARTITION BY source ORDER BY n, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN x USING (source)) SELECT doc_id, source FROM r WHERE before < excess")
def trim(spark, folder):
    """Of sources above a twentieth of all characters, the shortest documents that cover the excess."""
    totals = docs(spark, folder).groupBy("source").agg(F.sum("n").alias("total"))
    everything = totals.agg(F.sum("total").alias("everything"))
    over = totals.join(F.broadcast(everything)).withColumn("excess", F.col("total") - F.lit(0.05) * F.col("everything")).where("excess > 0").select("source", "excess")
    rows = docs(spark, folder).join(over, "source")
    return with_total_before(rows, ["source"], "n", "doc_id", "n", descending=False).where(F.col("before") < F.col("excess")).select("doc_id", "source")


@query("sel08_domain_shares", f"WITH {_POLICY} SELECT domain, round(sum(share) / sum(sum(share)) OVER (), 6) AS share FROM (SELECT domain, ratio / count(*) OVER (PARTITION BY band) AS share FROM policy) GROUP BY domain")
def domain_shares(spark, folder):
    p = policy(spark).withColumn("share", F.col("ratio") / F.count("*").over(Window.partitionBy("band")))
    g = p.groupBy("domain").agg(F.sum("share").alias("share"))
    return g.select("domain", F.round(F.col("share") / F.sum("share").over(Window.partitionBy()), 6).alias("share"))


@query("sel10_selection_stats", f"WITH {_DOCS} SELECT band, domain, count(*) AS n_documents, sum(n)::BIGINT AS n_chars, round(sum(n) / sum(sum(n)) OVER (), 6) AS share, round(sum(n) / sum(sum(n)) OVER (PARTITION BY band), 6) AS share_of_band FROM d GROUP BY band, domain")
def selection_stats(spark, folder):
    g = docs(spark, folder).groupBy("band", "domain").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_chars"))
    share = lambda *by: F.round(F.col("n_chars") / F.sum("n_chars").over(Window.partitionBy(*by)), 6)
    return g.withColumns({"share": share(), "share_of_band": share("band")})


@query("sel12_band_budgets", f"WITH {_POLICY}, b AS (SELECT DISTINCT band, ratio FROM policy), f AS (SELECT band, floor(ratio * 100003)::BIGINT AS budget FROM b) SELECT band, budget + CASE WHEN band = (SELECT max(band) FROM f) THEN 100003 - (SELECT sum(budget) FROM f) ELSE 0 END::BIGINT AS budget FROM f")
def band_budgets(spark, folder):
    """Whole budgets; the highest band gets the remainder."""
    f = policy(spark).select("band", "ratio").distinct().select("band", F.floor(F.col("ratio") * 100003).alias("budget"))
    rest = f.agg(F.max("band").alias("top"), F.sum("budget").alias("given"))
    return f.join(F.broadcast(rest)).select("band", (F.col("budget") + F.when(F.col("band") == F.col("top"), F.lit(100003) - F.col("given")).otherwise(0)).alias("budget"))


@query("sel13_even_split", f"WITH {_POLICY}, p AS (SELECT band, domain, row_number() OVER (PARTITION BY band ORDER BY domain) AS i, count(*) OVER (PARTITION BY band) AS n FROM policy) SELECT band, domain, 1001 // n + CASE WHEN i <= 1001 % n THEN 1 ELSE 0 END AS target FROM p")
def even_split(spark, folder):
    p = policy(spark).select("band", "domain", F.row_number().over(Window.partitionBy("band").orderBy("domain")).alias("i"), F.count("*").over(Window.partitionBy("band")).alias("n"))
    return p.select("band", "domain", (F.expr("1001 DIV n") + F.when(F.col("i") <= F.lit(1001) % F.col("n"), 1).otherwise(0)).alias("target"))


@query("sel15_unused", "SELECT DISTINCT id FROM normalized_documents WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM band_records WHERE id IS NOT NULL)")
def unused(spark, folder):
    used = table(spark, folder, "band_records").select("id")
    return table(spark, folder, "normalized_documents").where("id IS NOT NULL").select("id").join(used, "id", "left_anti").distinct()


@query("sel16_availability", f"WITH {_DOCS}, {_POLICY} SELECT band, count(*) AS n_documents, sum(n)::BIGINT AS n_chars FROM d WHERE (band, domain) IN (SELECT band, domain FROM policy) AND lang IS NOT NULL GROUP BY band")
def availability(spark, folder):
    return docs(spark, folder).where("lang IS NOT NULL").join(F.broadcast(policy(spark)), ["band", "domain"], "left_semi").groupBy("band").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_chars"))


@query("sel17_shards", "SELECT count(*) AS n_rows, 16 AS n_shards FROM documents")
def shards(spark, folder):
    """Rows over 16 shards by a hash of the id; every row is in one."""
    s = docs(spark, folder).select(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(16)).alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))
    return s.agg(F.sum("n").alias("n_rows"), F.count("*").cast("int").alias("n_shards"))


@query("sel18_weighted_shares", f"WITH {_DOCS}, s AS (SELECT source, lang, sum(n) AS t, avg((band = 'B0')::INT) AS r FROM d WHERE band IS NOT NULL GROUP BY ALL) SELECT lang, round(sum(t * r) / sum(t), 6) AS ratio, sum(t)::BIGINT AS n_chars, min(t)::BIGINT AS least, max(t)::BIGINT AS most FROM s GROUP BY lang")
def weighted_shares(spark, folder):
    s = docs(spark, folder).where("band IS NOT NULL").groupBy("source", "lang").agg(F.sum("n").alias("t"), F.avg((F.col("band") == "B0").cast("int")).alias("r"))
    return s.groupBy("lang").agg(F.round(F.sum(F.col("t") * F.col("r")) / F.sum("t"), 6).alias("ratio"), F.sum("t").alias("n_chars"), F.min("t").alias("least"), F.max("t").alias("most"))


@query("sel19_overlaps", "WITH s AS (SELECT DISTINCT band, id FROM band_records WHERE band IS NOT NULL AND id IS NOT NULL) SELECT a.band AS band_a, b.band AS band_b, count(*) AS n_shared FROM s a JOIN s b ON a.id = b.id AND a.band < b.band GROUP BY ALL")
def overlaps(spark, folder):
    """Records in two bands: the distinct bands of a record are few, so pairs are made within a record."""
    sets = table(spark, folder, "band_records").where("band IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_set("band")).alias("b")).where(F.size("b") > 1)
    left = sets.select("b", F.posexplode("b").alias("i", "band_a"))
    return left.select("band_a", F.explode(F.slice("b", F.col("i") + 2, F.size("b"))).alias("band_b")).groupBy("band_a", "band_b").agg(F.count("*").alias("n_shared"))


@query("sel20_fingerprint", "SELECT count(*) AS n, count(DISTINCT id) AS n_ids, sum(('0x' || substr(md5(id), 25, 8))::BIGINT)::BIGINT AS total FROM normalized_documents")
def fingerprint(spark, folder):
    """Order-free fingerprint of an id set: equal sets have equal sums of hashes."""
    h = F.conv(F.substring(F.md5("id"), 25, 8), 16, 10).cast("long")
    return table(spark, folder, "normalized_documents").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.sum(h).alias("total"))


@query("sel21_share_check", f"WITH {_DOCS}, {_POLICY}, b AS (SELECT DISTINCT band, ratio FROM policy), g AS (SELECT band, sum(n) / sum(sum(n)) OVER () AS share FROM d WHERE band IS NOT NULL GROUP BY band) SELECT coalesce(b.band, g.band) AS band, round(coalesce(g.share, 0) - coalesce(b.ratio, 0), 6) AS gap, abs(coalesce(g.share, 0) - coalesce(b.ratio, 0)) > 0.02::DOUBLE AS violated FROM b FULL JOIN g ON b.band = g.band")
def share_check(spark, folder):
    g = docs(spark, folder).where("band IS NOT NULL").groupBy("band").agg(F.sum("n").alias("n"))
    g = g.select("band", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
    gap = F.coalesce("share", F.lit(0.0)) - F.coalesce("ratio", F.lit(0.0))
    return policy(spark).select("band", "ratio").distinct().join(g, "band", "full").select("band", F.round(gap, 6).alias("gap"), (F.abs(gap) > 0.02).alias("violated"))


@query("sel24_frequency_classes", "WITH f AS (SELECT unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM f GROUP BY word), ff AS (SELECT n, count(*) AS k FROM c GROUP BY n), s AS (SELECT n, k, coalesce(sum(k) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(k) OVER () AS above FROM ff) SELECT CASE WHEN above < 0.01::DOUBLE THEN 'frequent' WHEN above < 0.2::DOUBLE THEN 'normal' ELSE 'rare' END AS class, sum(k)::BIGINT AS n_words FROM s GROUP BY 1")
def frequency_classes(spark, folder):
    """Words by the share of words that are more frequent; windows run over the table of frequencies."""
    from quern.plans.corpus import frequency_table

    ff = frequency_table(spark, folder)
    before = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    s = ff.select("n_words", (F.coalesce(F.sum("n_words").over(before), F.lit(0)) / F.sum("n_words").over(Window.partitionBy())).alias("above"))
    return s.groupBy(F.when(F.col("above") < 0.01, "frequent").when(F.col("above") < 0.2, "normal").otherwise("rare").alias("class")).agg(F.sum("n_words").alias("n_words"))


@query("sel25_balance", f"WITH {_DOCS}, g AS (SELECT lang, sum(n) / sum(sum(n)) OVER ()::DOUBLE AS p FROM d GROUP BY lang) SELECT round(sum(-p * ln(p)), 6) AS entropy, round(sum(-p * ln(p)) / ln(count(*)), 6) AS balance FROM g WHERE p > 0")
def balance(spark, folder):
    g = docs(spark, folder).groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
    p = g.select((F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    e = F.sum(-F.col("p") * F.log("p"))
    return p.agg(F.round(e, 6).alias("entropy"), F.round(e / F.log(F.count("*")), 6).alias("balance"))


_ORDER = f"md5('{SEED}:' || doc_id)"


def shuffled(spark, folder):
    return docs(spark, folder).withColumn("key", F.md5(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string"))))


@query("smp02_batches", f"SELECT doc_id, (row_number() OVER (ORDER BY {_ORDER}) - 1) // {BATCH} AS batch FROM documents")
def batches(spark, folder):
    """Batches of a seeded order. Places come from counts by ranges of the key, so no task sorts all rows."""
    rows = shuffled(spark, folder).withColumns({"one": F.lit(1).cast("long"), "all": F.lit(0), "number": F.conv(F.substring("key", 1, 12), 16, 10).cast("long")})
    return with_total_before(rows, ["all"], "number", "key", "one", descending=False).select("doc_id", F.floor(F.col("before") / BATCH).alias("batch"))


@query("smp03_strata", f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS i, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS total FROM documents) SELECT doc_id, lang FROM r WHERE i <= greatest(1, floor({BATCH} * n / total))")
def strata(spark, folder):
    """A sample with each language's share of a batch, at least one document."""
    rows = shuffled(spark, folder).withColumns({"one": F.lit(1).cast("long"), "number": F.conv(F.substring("key", 1, 12), 16, 10).cast("long")})
    counts = rows.groupBy("lang").agg(F.count("*").alias("in_lang"))
    quota = counts.select(F.col("lang").alias("l"), F.greatest(F.lit(1), F.floor(F.lit(BATCH) * F.col("in_lang") / F.sum("in_lang").over(Window.partitionBy()))).alias("quota"))
    placed = with_total_before(rows, ["lang"], "number", "key", "one", descending=False)
    return placed.join(F.broadcast(quota), F.col("lang").eqNullSafe(F.col("l"))).where(F.col("before") < F.col("quota")).select("doc_id", "lang")


@query("smp04_sample", f"SELECT doc_id FROM documents ORDER BY {_ORDER} LIMIT 200")
def sample(spark, folder):
    """A sampling operator: the 200 rows with the least keys."""
    return shuffled(spark, folder).orderBy("key").limit(200).select("doc_id")


@query("smp06_capacity_mix", "WITH b AS (SELECT band, avg(difficulty_score) AS c, count(*) / sum(count(*)) OVER ()::DOUBLE AS base FROM band_records WHERE band IS NOT NULL GROUP BY band), w AS (SELECT band, base * exp(-3.0::DOUBLE * abs(0.4::DOUBLE - c)) AS w FROM b), f AS (SELECT band, least(greatest(w / sum(w) OVER (), 0.02::DOUBLE), 0.5::DOUBLE) AS w FROM w) SELECT band, round(w / sum(w) OVER (), 6) AS weight FROM f")
def capacity_mix(spark, folder):
    """Band weights that fall with the distance of a band's difficulty from a capacity, within a floor and a cap."""
    every = Window.partitionBy()
    b = table(spark, folder, "band_records").where("band IS NOT NULL").groupBy("band").agg(F.avg("difficulty_score").alias("c"), F.count("*").alias("n"))
    w = b.select("band", (F.col("n") / F.sum("n").over(every) * F.exp(F.lit(-3.0) * F.abs(F.lit(0.4) - F.col("c")))).alias("w"))
    f = w.select("band", F.least(F.greatest(F.col("w") / F.sum("w").over(every), F.lit(0.02)), F.lit(0.5)).alias("w"))
    return f.select("band", F.round(F.col("w") / F.sum("w").over(every), 6).alias("weight"))


@query("smp07_pool", "SELECT doc_id FROM documents WHERE band IN ('B0', 'B1') EXCEPT SELECT doc_id FROM subject_labels")
def pool(spark, folder):
    return docs(spark, folder).where(F.col("band").isin("B0", "B1")).join(table(spark, folder, "subject_labels").select("doc_id"), "doc_id", "left_anti").select("doc_id").distinct()


@query("smp09_strides", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents WHERE lang IN ('en', 'hi')) SELECT doc_id, round(i / CASE WHEN lang = 'en' THEN 3.0 ELSE 1.0 END, 6) AS stride FROM r")
def strides(spark, folder):
    """Interleaving by weight: the place in the pool divided by the pool's weight orders all pools together."""
    rows = docs(spark, folder).where(F.col("lang").isin("en", "hi")).withColumn("one", F.lit(1).cast("long"))
    placed = with_total_before(rows, ["lang"], "doc_id", "doc_id", "one", descending=False)
    return placed.select("doc_id", F.round((F.col("before") + 1) / F.when(F.col("lang") == "en", 3.0).otherwise(1.0), 6).alias("stride"))


@query("smp11_round_robin", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents WHERE lang IS NOT NULL")
def round_robin(spark, folder):
    rows = docs(spark, folder).where("lang IS NOT NULL").withColumn("one", F.lit(1).cast("long"))
    return with_total_before(rows, ["lang"], "doc_id", "doc_id", "one", descending=False).select("doc_id", "lang", (F.col("before") + 1).alias("turn"))


@query("smp13_effective_weights", f"WITH {_POLICY}, b AS (SELECT DISTINCT band, ratio FROM policy), t AS (SELECT band, count(*) AS n FROM documents WHERE band IS NOT NULL GROUP BY band) SELECT band, n, round(ratio / sum(ratio) OVER (), 6) AS weight, round(n / sum(n) OVER (), 6) AS actual FROM b JOIN t USING (band)")
def effective_weights(spark, folder):
    every = Window.partitionBy()
    t = docs(spark, folder).where("band IS NOT NULL").groupBy("band").agg(F.count("*").alias("n"))
    j = t.join(F.broadcast(policy(spark).select("band", "ratio").distinct()), "band")
    return j.select("band", "n", F.round(F.col("ratio") / F.sum("ratio").over(every), 6).alias("weight"), F.round(F.col("n") / F.sum("n").over(every), 6).alias("actual"))


@query("smp14_base_shares", "SELECT dataset, band, round(sum(w) / sum(sum(w)) OVER (PARTITION BY dataset), 6) AS share FROM (SELECT lower(trim(source)) AS dataset, band, token_count_estimate AS w FROM band_records WHERE band IS NOT NULL) GROUP BY dataset, band")
def base_shares(spark, folder):
    g = table(spark, folder, "band_records").where("band IS NOT NULL").groupBy(F.lower(F.trim("source")).alias("dataset"), "band").agg(F.sum("token_count_estimate").alias("w"))
    return g.select("dataset", "band", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("dataset")), 6).alias("share"))


_WN = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''))"


def sized(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long").alias("n"))


@query("pck02_blocks", f"WITH w AS (SELECT doc_id, source, {_WN} + 1 AS n FROM documents), p AS (SELECT doc_id, source, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS start FROM w) SELECT doc_id, source, start::BIGINT AS start, (start // {BLOCK})::BIGINT AS first_block, ((start + n - 1) // {BLOCK})::BIGINT AS last_block FROM p")
def blocks(spark, folder):
    return block_spans(sized(spark, folder), "source", "doc_id", "n", BLOCK).select("doc_id", "source", "start", "first_block", "last_block")


@query("pck03_block_totals", f"WITH w AS (SELECT source, sum({_WN} + 1)::BIGINT AS n FROM documents GROUP BY source) SELECT source, n AS n_tokens, n // {BLOCK} AS n_blocks, n % {BLOCK} AS tail FROM w")
def totals(spark, folder):
    return block_totals(sized(spark, folder), "source", "n", BLOCK)


@query("pck05_shard_metadata", "WITH g AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) SELECT source, arg_max(lang, (n, lang)) AS main_language, max(n) AS n_main, count(*) AS n_languages FROM g GROUP BY source")
def shard_metadata(spark, folder):
    g = docs(spark, folder).where("lang IS NOT NULL").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return g.groupBy("source").agg(F.max(F.struct("n", "lang"))["lang"].alias("main_language"), F.max("n").alias("n_main"), F.count("*").alias("n_languages"))


@query("pck06_manifest", f"SELECT band, count(*) AS n_documents, sum({_WN} + 1)::BIGINT AS n_tokens, count(DISTINCT lang) AS n_languages, count(DISTINCT source) AS n_sources FROM documents GROUP BY band")
def manifest(spark, folder):
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")) + 1
    return table(spark, folder, "documents").groupBy("band").agg(F.count("*").alias("n_documents"), F.sum(n).alias("n_tokens"), F.countDistinct("lang").alias("n_languages"), F.countDistinct("source").alias("n_sources"))


@query("pck07_weighted_means", "WITH f AS (SELECT file_path, band, avg(difficulty_score) AS d, count(*) AS n FROM band_records WHERE difficulty_score IS NOT NULL GROUP BY ALL) SELECT band, round(sum(d * n) / sum(n), 4) AS mean_difficulty, sum(n)::BIGINT AS n FROM f GROUP BY band")
def weighted_means(spark, folder):
    f = table(spark, folder, "band_records").where("difficulty_score IS NOT NULL").groupBy("file_path", "band").agg(F.avg("difficulty_score").alias("d"), F.count("*").alias("n"))
    return f.groupBy("band").agg(F.round(F.sum(F.col("d") * F.col("n")) / F.sum("n"), 4).alias("mean_difficulty"), F.sum("n").alias("n"))


@query("pck08_checks", "SELECT count(*) FILTER (abs(band_p_b0 + band_p_b1 + band_p_b2 + band_p_b3 + band_p_b4 + band_p_b5 - 1) > 0.01) AS bad_sums, count(*) FILTER (byte_length < word_count) AS bad_lengths, count(*) - count(DISTINCT uuid) AS repeated_uuids, count(*) AS n FROM band_records")
def checks(spark, folder):
    total = sum((F.col(f"band_p_b{i}") for i in range(1, 6)), F.col("band_p_b0"))
    return table(spark, folder, "band_records").agg(F.count_if(F.abs(total - 1) > 0.01).alias("bad_sums"), F.count_if(F.col("byte_length") < F.col("word_count")).alias("bad_lengths"), (F.count("*") - F.countDistinct("uuid")).alias("repeated_uuids"), F.count("*").alias("n"))


@query("lkp01_source_info", "SELECT s.source, count(d.doc_id) AS n, coalesce(max(b.band), 'B1') AS main_band FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN documents d ON d.source = s.source LEFT JOIN (SELECT source, arg_max(band, (n, band)) AS band FROM (SELECT source, band, count(*) AS n FROM documents WHERE band IS NOT NULL GROUP BY ALL) GROUP BY source) b ON b.source = s.source GROUP BY s.source")
def source_info(spark, folder):
    """Main band of each source; a source without one gets the default."""
    d = docs(spark, folder)
    main = d.where("band IS NOT NULL").groupBy("source", "band").agg(F.count("*").alias("k")).groupBy("source").agg(F.max(F.struct("k", "band"))["band"].alias("band"))
    return d.groupBy("source").agg(F.count("*").alias("n")).join(main, "source", "left").select("source", "n", F.coalesce("band", F.lit("B1")).alias("main_band"))


@query("lkp02_policy_violations", f"WITH {_POLICY} SELECT band, domain, count(*) AS n FROM documents d WHERE band IS NOT NULL AND domain IS NOT NULL AND NOT EXISTS (SELECT 1 FROM policy p WHERE p.band = d.band AND p.domain = d.domain) GROUP BY band, domain")
def violations(spark, folder):
    rows = docs(spark, folder).where("band IS NOT NULL AND domain IS NOT NULL")
    return rows.join(F.broadcast(policy(spark)), ["band", "domain"], "left_anti").groupBy("band", "domain").agg(F.count("*").alias("n"))


@query("lkp03_ratio_check", f"WITH {_POLICY} SELECT round(sum(ratio), 6) AS total, abs(sum(ratio) - 1) <= 0.01::DOUBLE AS is_valid FROM (SELECT DISTINCT band, ratio FROM policy)")
def ratio_check(spark, folder):
    total = F.sum("ratio")
    return policy(spark).select("band", "ratio").distinct().agg(F.round(total, 6).alias("total"), (F.abs(total - 1) <= 0.01).alias("is_valid"))


STAGES = ((1, "en"), (1, "hi"), (2, "ta"), (2, "bn"), (3, "te"))


@query("lkp04_stage_languages", "WITH l(earliest, lang) AS (VALUES " + ", ".join(f"({e}, '{x}')" for e, x in STAGES) + ") SELECT s.stage, l.lang FROM (VALUES (1), (2), (3)) s(stage) JOIN l ON l.earliest <= s.stage")
def stage_languages(spark, folder):
    languages = spark.createDataFrame(STAGES, "earliest int, lang string")
    return spark.range(1, 4).select(F.col("id").cast("int").alias("stage")).join(F.broadcast(languages), F.col("earliest") <= F.col("stage")).select("stage", "lang")


@query("lkp05_band_domains", f"WITH {_POLICY} SELECT band, string_agg(domain, ',' ORDER BY domain) AS domains FROM policy GROUP BY band")
def band_domains(spark, folder):
    return policy(spark).groupBy("band").agg(F.array_join(F.sort_array(F.collect_list("domain")), ",").alias("domains"))


CENTROIDS = (("B0", 0.05), ("B1", 0.20), ("B2", 0.35), ("B3", 0.55), ("B4", 0.75), ("B5", 0.90))


@query("lkp06_nearest_band", "SELECT uuid, list_min([" + ", ".join(f"{{d: abs(difficulty_score - {c}::DOUBLE), b: '{b}'}}" for b, c in CENTROIDS) + "]).b AS nearest FROM band_records WHERE difficulty_score IS NOT NULL")
def nearest_band(spark, folder):
    """Band with the nearest center; ties go to the lower band."""
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col("difficulty_score") - c).alias("d"), F.lit(b).alias("b")) for b, c in CENTROIDS)))["b"]
    return table(spark, folder, "band_records").where("difficulty_score IS NOT NULL").select("uuid", nearest.alias("nearest"))


_PS = [f"band_p_b{i}" for i in range(6)]


@query("lkp07_likeliest_band", f"SELECT uuid, coalesce(band, CASE {' '.join(f'WHEN {p} = greatest({', '.join(_PS)}) THEN {chr(39)}B{i}{chr(39)}' for i, p in enumerate(_PS))} END, 'B0') AS band FROM band_records")
def likeliest_band(spark, folder):
    """The stored band, else the likeliest (of equal ones the lowest), else the lowest of all."""
    best = F.greatest(*_PS)
    likely = F
    for i, p in enumerate(_PS):
        likely = likely.when(F.col(p) == best, f"B{i}")
    return table(spark, folder, "band_records").select("uuid", F.coalesce("band", likely, F.lit("B0")).alias("band"))


@query("src11_lookup", "SELECT doc_id, source FROM documents WHERE doc_id = 1001")
def lookup(spark, folder):
    return docs(spark, folder).where("doc_id = 1001").select("doc_id", "source")


@query("src10_metadata", "SELECT doc_id, domain, band FROM documents WHERE lang = 'hi' AND n_chars > 500")
def metadata(spark, folder):
    """Filter and columns reach the scan."""
    return table(spark, folder, "documents").where((F.col("lang") == "hi") & (F.col("n_chars") > 500)).select("doc_id", "domain", "band")


@query("snk10_last_rows", "SELECT run_id, max(updated_time) AS updated_time FROM runs GROUP BY run_id")
def last_rows(spark, folder):
    return last_version(table(spark, folder, "runs"), "run_id", "updated_time").select("run_id", "updated_time")
