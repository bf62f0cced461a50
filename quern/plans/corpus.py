"""Corpus statistics over words (runs without white space) of the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.plans.registry import query, table

TOP = 100
_WORDS = "words AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS word FROM documents)"
_FREQ = f"{_WORDS}, freq AS (SELECT word, count(*) AS n FROM words GROUP BY word)"
_LANG_FREQ = f"{_WORDS}, freq AS (SELECT lang, word, count(*) AS n FROM words GROUP BY lang, word)"


def word_array(text="text"):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def words(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", F.explode(word_array()).alias("word"))


def frequencies(spark, folder, *by):
    return words(spark, folder).groupBy(*by, "word").agg(F.count("*").alias("n"))


def frequency_table(spark, folder):
    """How many words have each frequency: as many rows as there are different frequencies, about the square root of the corpus."""
    return frequencies(spark, folder).groupBy("n").agg(F.count("*").alias("n_words"))


@query("tok01_frequencies", f"WITH {_FREQ} SELECT word, n FROM freq")
def word_frequencies(spark, folder):
    return frequencies(spark, folder)


@query("tok02_entropy", f"""WITH {_LANG_FREQ}, t AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM freq)
  SELECT lang, count(*) AS vocabulary, sum(n)::BIGINT AS n_tokens, round(sum(-(n / total) * log2(n / total)), 4) AS entropy_bits FROM t GROUP BY lang""")
def entropy(spark, folder):
    """Entropy from sums of n and n log n, so that no total has to be known first."""
    sums = frequencies(spark, folder, "lang").groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select("lang", "vocabulary", "n_tokens", F.round(F.log2("n_tokens") - F.col("s") / F.col("n_tokens"), 4).alias("entropy_bits"))


@query("tok03_coverage", f"""WITH {_FREQ}, ff AS (SELECT n, count(*) AS n_words FROM freq GROUP BY n),
  c AS (SELECT *, sum(n_words) OVER w AS words_upto, sum(n * n_words) OVER w AS mass_upto, sum(n * n_words) OVER () AS total FROM ff WINDOW w AS (ORDER BY n DESC))
  SELECT p AS percent, min(words_upto)::BIGINT AS n_words FROM c, (VALUES (50), (80), (90), (95), (99)) v(p) WHERE mass_upto >= p / 100.0::DOUBLE * total GROUP BY p""")
def coverage(spark, folder):
    """Words needed for a share of all tokens, to the next whole frequency; the window runs over the frequency table."""
    upto = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    c = frequency_table(spark, folder).select("n", F.sum("n_words").over(upto).alias("words_upto"), F.sum(F.col("n") * F.col("n_words")).over(upto).alias("mass_upto"))
    total = c.agg(F.max("mass_upto").alias("total"))
    percents = F.explode(F.array(*map(F.lit, (50, 80, 90, 95, 99)))).alias("percent")
    return c.select("*", percents).join(F.broadcast(total)).where(F.col("mass_upto") >= F.col("percent") / 100.0 * F.col("total")).groupBy("percent").agg(F.min("words_upto").alias("n_words"))


@query("tok04_top_words", f"WITH {_FREQ} SELECT word, n FROM freq ORDER BY n DESC, word LIMIT {TOP}")
def top_words(spark, folder):
    """A top-k report."""
    return frequencies(spark, folder).orderBy(F.desc("n"), "word").limit(TOP)


@query("tok05_zipf", f"""WITH {_FREQ}, ff AS (SELECT n, count(*) AS n_words FROM freq GROUP BY n),
  r AS (SELECT ln(n) AS y, ln(sum(n_words) OVER (ORDER BY n DESC)) AS x FROM ff)
  SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 4) AS r2 FROM r""")
def zipf(spark, folder):
    """Line through log frequency against log rank (the last rank with that frequency)."""
    upto = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    r = frequency_table(spark, folder).select(F.log("n").alias("y"), F.log(F.sum("n_words").over(upto)).alias("x"))
    return r.agg(F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.round(F.regr_r2("y", "x"), 4).alias("r2"))


@query("tok06_bigrams", f"""WITH w AS (SELECT list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS ws FROM documents),
  pairs AS (SELECT unnest(list_zip(ws[:-2], ws[2:])) AS p FROM w WHERE len(ws) > 1), b AS (SELECT p[1] AS first, p[2] AS second, count(*) AS n FROM pairs GROUP BY ALL),
  {_FREQ}, total AS (SELECT sum(n) AS t FROM freq)
  SELECT first, second, b.n, round(log2(b.n * t / (f.n * g.n)::DOUBLE), 4) AS pmi FROM b JOIN freq f ON f.word = first JOIN freq g ON g.word = second, total WHERE b.n >= 20""")
def bigrams(spark, folder):
    """Neighbouring words that occur together at least 20 times, with their mutual information."""
    array = table(spark, folder, "documents").select(word_array().alias("w")).where(F.size("w") > 1)
    pairs = array.select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("first"), F.slice("w", 2, F.size("w") - 1).alias("second"))).alias("p"))
    counted = pairs.groupBy(F.col("p.first").alias("first"), F.col("p.second").alias("second")).agg(F.count("*").alias("n")).where("n >= 20")
    one = frequencies(spark, folder)
    total = one.agg(F.sum("n").alias("t"))
    joined = counted.join(one.select(F.col("word").alias("first"), F.col("n").alias("nf")), "first").join(one.select(F.col("word").alias("second"), F.col("n").alias("ng")), "second").join(F.broadcast(total))
    return joined.select("first", "second", "n", F.round(F.log2(F.col("n") * F.col("t") / (F.col("nf") * F.col("ng")).cast("double")), 4).alias("pmi"))


@query("tok07_repetition", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS ws FROM documents),
  g AS (SELECT doc_id, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) AS grams FROM w WHERE len(ws) >= 5)
  SELECT doc_id, len(grams) AS n_grams, round(1 - len(list_distinct(grams)) / len(grams)::DOUBLE, 6) AS repetition FROM g""")
def repetition(spark, folder):
    """Share of repeated five-word sequences of each document."""
    w = table(spark, folder, "documents").select("doc_id", word_array().alias("w")).where(F.size("w") >= 5)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice("w", i, 5), " "))
    g = w.select("doc_id", grams.alias("g"))
    return g.select("doc_id", F.size("g").alias("n_grams"), F.round(1 - F.size(F.array_distinct("g")) / F.size("g"), 6).alias("repetition"))


#: First and last code point of scripts, as hexadecimal classes.
SCRIPTS = (("devanagari", "ऀ", "ॿ"), ("bengali", "ঀ", "৿"), ("gujarati", "઀", "૿"), ("tamil", "஀", "௿"), ("telugu", "ఀ", "౿"), ("latin", "A", "ɏ"))


@query("tok08_scripts", "SELECT doc_id, " + ", ".join(f"length(text) - length(regexp_replace(text, '[{a}-{b}]', '', 'g')) AS {n}" for n, a, b in SCRIPTS) + " FROM documents WHERE text IS NOT NULL")
def scripts(spark, folder):
    counts = [(F.length("text") - F.length(F.regexp_replace("text", f"[{a}-{b}]", ""))).alias(n) for n, a, b in SCRIPTS]
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", *counts)


EDGES = (16, 64, 256, 1024, 4096)


@query("tok09_lengths", "SELECT lang, CASE " + " ".join(f"WHEN n < {e} THEN {e}" for e in EDGES) + " ELSE 0 END AS below, count(*) AS n_documents FROM (SELECT lang, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS n FROM documents) GROUP BY ALL")
def lengths(spark, folder):
    """Documents by number of words, below each edge (0: above all)."""
    n = F.size(word_array())
    below = F
    for e in EDGES:
        below = below.when(n < e, e)
    return table(spark, folder, "documents").groupBy("lang", below.otherwise(0).alias("below")).agg(F.count("*").alias("n_documents"))


@query("tok10_richness", "SELECT lang, round(avg(len(list_distinct(ws)) / len(ws)::DOUBLE), 6) AS richness, count(*) AS n_documents FROM (SELECT lang, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS ws FROM documents) WHERE len(ws) > 0 GROUP BY lang")
def richness(spark, folder):
    w = table(spark, folder, "documents").select("lang", word_array().alias("w")).where(F.size("w") > 0)
    return w.groupBy("lang").agg(F.round(F.avg(F.size(F.array_distinct("w")) / F.size("w")), 6).alias("richness"), F.count("*").alias("n_documents"))


@query("tok11_position_bias", """WITH w AS (SELECT list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS ws FROM documents),
  p AS (SELECT unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM w)
  SELECT word, count(*) AS n, count(*) FILTER (i * 10 <= n) AS n_first, count(*) FILTER (i * 10 > 9 * n) AS n_last FROM p GROUP BY word HAVING count(*) >= 50""")
def position_bias(spark, folder):
    """How often a word is in the first and the last tenth of its documents."""
    w = table(spark, folder, "documents").select(word_array().alias("w"))
    p = w.select(F.size("w").alias("size"), F.posexplode("w").alias("i", "word"))
    return p.groupBy("word").agg(F.count("*").alias("n"), F.count_if((F.col("i") + 1) * 10 <= F.col("size")).alias("n_first"), F.count_if((F.col("i") + 1) * 10 > 9 * F.col("size")).alias("n_last")).where("n >= 50")


@query("tok12_rates", f"""WITH {_WORDS} SELECT lang, round(avg(regexp_matches(word, '^[0-9.,]+$')::INT), 6) AS numeric_rate, round(avg(regexp_matches(word, '[.!?।]$')::INT), 6) AS ending_rate,
  round(avg((NOT regexp_matches(word, '[\\p{{L}}\\p{{N}}]'))::INT), 6) AS symbol_rate FROM words GROUP BY lang""")
def rates(spark, folder):
    w = F.col("word")
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return words(spark, folder).groupBy("lang").agg(rate(w.rlike("^[0-9.,]+$")).alias("numeric_rate"), rate(w.rlike("[.!?।]$")).alias("ending_rate"), rate(~w.rlike(r"[\p{L}\p{N}]")).alias("symbol_rate"))


@query("tok13_divergence", f"""WITH {_LANG_FREQ}, p AS (SELECT lang, word, n / sum(n) OVER (PARTITION BY lang)::DOUBLE AS p FROM freq WHERE lang IN ('en', 'hi')),
  j AS (SELECT coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM (SELECT * FROM p WHERE lang = 'en') a FULL JOIN (SELECT * FROM p WHERE lang = 'hi') b USING (word))
  SELECT count(*) FILTER (p > 0 AND q > 0) AS n_shared, count(*) AS n_words, round(sum(CASE WHEN p > 0 THEN p / 2 * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q / 2 * log2(2 * q / (p + q)) ELSE 0 END), 4) AS js_bits FROM j""")
def divergence(spark, folder):
    """Jensen-Shannon divergence of the words of two languages; both sides are shuffled by word once."""
    f = words(spark, folder).where(F.col("lang").isin("en", "hi")).groupBy("word").agg(F.count_if(F.col("lang") == "en").alias("a"), F.count_if(F.col("lang") == "hi").alias("b"))
    totals = f.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    pq = f.join(F.broadcast(totals)).select((F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))
    half = lambda x, y: F.when(x > 0, x / 2 * F.log2(2 * x / (x + y))).otherwise(0.0)
    return pq.agg(F.count_if((F.col("p") > 0) & (F.col("q") > 0)).alias("n_shared"), F.count("*").alias("n_words"), F.round(F.sum(half(F.col("p"), F.col("q")) + half(F.col("q"), F.col("p"))), 4).alias("js_bits"))


@query("tok14_fertility", "SELECT lang, round(sum(length(text)) / sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::DOUBLE, 6) AS chars_a_word, round(sum(octet_length(encode(text))) / sum(length(text))::DOUBLE, 6) AS bytes_a_char FROM documents WHERE text <> '' GROUP BY lang")
def fertility(spark, folder):
    d = table(spark, folder, "documents").where("text <> ''")
    return d.groupBy("lang").agg(F.round(F.sum(F.length("text")) / F.sum(F.size(word_array())), 6).alias("chars_a_word"), F.round(F.sum(F.octet_length("text")) / F.sum(F.length("text")), 6).alias("bytes_a_char"))


@query("tok15_piece_sizes", "SELECT octet_length(encode(piece)) AS n_bytes, length(piece) AS n_chars, count(*) AS n_pieces FROM tokenizer_pieces GROUP BY ALL")
def piece_sizes(spark, folder):
    return table(spark, folder, "tokenizer_pieces").groupBy(F.octet_length("piece").alias("n_bytes"), F.length("piece").alias("n_chars")).agg(F.count("*").alias("n_pieces"))


_STATS = "count(*) AS n_rows, count(*) - count(word_count) AS n_null, min(word_count) AS least, max(word_count) AS most, round(avg(word_count), 6) AS mean, round(stddev_pop(word_count), 6) AS deviation"
_RANKED = "max(word_count) FILTER (rn = (25 * n) // 100 + 1) AS p25, max(word_count) FILTER (rn = (50 * n) // 100 + 1) AS p50, max(word_count) FILTER (rn = least(n, (99 * n) // 100 + 1)) AS p99"


def _column_stats(df, column, *by):
    """Counts, moments and percentiles of a column. Percentiles come from the table of values and counts, which is shuffled by
    group and value; groups are never gathered as lists."""
    stats = df.groupBy(*by).agg(F.count("*").alias("n_rows"), (F.count("*") - F.count(column)).alias("n_null"), F.min(column).alias("least"), F.max(column).alias("most"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_pop(column), 6).alias("deviation"))
    values = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*by).orderBy(column)
    placed = values.select(*by, column, F.sum("c").over(upto).alias("upto"), F.sum("c").over(Window.partitionBy(*by)).alias("n"))
    ranks = [F.min(F.when(F.col("upto") >= F.least(F.col("n"), F.floor(F.col("n") * p / 100) + 1), F.col(column))).alias(f"p{p}") for p in (25, 50, 99)]
    return stats, placed.groupBy(*by).agg(*ranks)


@query("tok17_column_stats", f"SELECT * FROM (SELECT {_STATS} FROM band_records), (SELECT {_RANKED} FROM (SELECT word_count, row_number() OVER (ORDER BY word_count) AS rn, count(*) OVER () AS n FROM band_records WHERE word_count IS NOT NULL))")
def column_stats(spark, folder):
    stats, ranks = _column_stats(table(spark, folder, "band_records"), "word_count")
    return stats.join(F.broadcast(ranks))


@query("tok18_compare_bands", f"SELECT a.*, p25, p50, p99 FROM (SELECT band, {_STATS} FROM band_records WHERE band IS NOT NULL GROUP BY band) a JOIN (SELECT band, {_RANKED} FROM (SELECT band, word_count, row_number() OVER (PARTITION BY band ORDER BY word_count) AS rn, count(*) OVER (PARTITION BY band) AS n FROM band_records WHERE word_count IS NOT NULL) GROUP BY band) b ON a.band = b.band")
def compare_bands(spark, folder):
    stats, ranks = _column_stats(table(spark, folder, "band_records").where("band IS NOT NULL"), "word_count", "band")
    return stats.join(ranks, "band")


@query("tok19_correlation", "SELECT round(coalesce(corr(difficulty_score, word_count), 0), 6) AS r, count(*) AS n FROM band_records WHERE difficulty_score IS NOT NULL AND word_count IS NOT NULL")
def correlation(spark, folder):
    rows = table(spark, folder, "band_records").where("difficulty_score IS NOT NULL AND word_count IS NOT NULL")
    return rows.agg(F.round(F.coalesce(F.nanvl(F.corr("difficulty_score", "word_count"), F.lit(0.0)), F.lit(0.0)), 6).alias("r"), F.count("*").alias("n"))


@query("tok20_band_shares", "SELECT coalesce(band, 'unknown') AS band, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM band_records GROUP BY 1")
def band_shares(spark, folder):
    g = table(spark, folder, "band_records").groupBy(F.coalesce("band", F.lit("unknown")).alias("band")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("tok21_file_rejections", "SELECT file_path, count(*) AS n, count(*) FILTER (is_rejected) AS n_rejected, round(count(*) FILTER (is_rejected) / count(*)::DOUBLE, 6) AS share FROM band_records GROUP BY file_path")
def file_rejections(spark, folder):
    g = table(spark, folder, "band_records").groupBy("file_path").agg(F.count("*").alias("n"), F.count_if("is_rejected").alias("n_rejected"))
    return g.withColumn("share", F.round(F.col("n_rejected") / F.col("n"), 6))


@query("tok22_agreement", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars = length(text)) AS n_right, round(count(*) FILTER (n_chars = length(text)) / count(n_chars)::DOUBLE, 6) AS accuracy_given FROM documents GROUP BY lang")
def agreement(spark, folder):
    """Accuracy and accuracy among attempts of a stored figure against the computed one."""
    right = F.count_if(F.col("n_chars") == F.length("text"))
    return table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("n"), right.alias("n_right"), F.round(right / F.count("n_chars"), 6).alias("accuracy_given"))


@query("tok23_grouping_sets", "SELECT source, domain, band, count(*) AS n, sum(token_count_estimate)::BIGINT AS n_tokens, grouping(source, domain, band) AS level FROM band_records GROUP BY GROUPING SETS ((source), (domain), (band), ())")
def grouping_sets(spark, folder):
    table(spark, folder, "band_records").createOrReplaceTempView("quern_band_records")
    return spark.sql("SELECT source, domain, band, count(*) AS n, sum(token_count_estimate) AS n_tokens, grouping_id() AS level FROM quern_band_records GROUP BY source, domain, band GROUPING SETS ((source), (domain), (band), ())")
