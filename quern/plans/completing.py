"""Texts from fields, measures within a document, bands from scores, orders and shares of manifests, and layers of leakage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import formats
from quern.functions import measures as m
from quern.functions.signals import where_computed
from quern.operators.budgets import with_total_before
from quern.operators.extraction import extracted
from quern.plans.choosing import _N, _TARGETS, BUDGET, SEED, docs, greedy_fill, policy, shuffled
from quern.plans.duplicates import normal, shared_grams
from quern.plans.registry import SQL, query, table

_T = "coalesce(text, '')"
_WORDS = "regexp_extract_all(lower({}), '{}')".format(_T, m.WORD.replace("'", "''"))

# Texts from fields


def dialogues(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "text").where(F.col("text").startswith("[USER] "))
    return rows.select("doc_id", formats.messages_of(F.col("text")).alias("messages"))


_TURNS = "turns AS (SELECT doc_id, list_transform(regexp_split_to_array(regexp_replace(text, '\\n\\n(\\[(USER|ASSISTANT)\\] )', chr(1) || '\\1', 'g'), chr(1)), lambda t: {role: CASE WHEN starts_with(t, '[USER] ') THEN 'user' ELSE 'assistant' END, content: regexp_replace(t, '^\\[(USER|ASSISTANT)\\] ', '')}) AS ms FROM documents WHERE starts_with(text, '[USER] '))"


@query("nrm03_from_messages", f"WITH {_TURNS} SELECT doc_id, md5(array_to_string(list_transform(list_filter(ms, lambda x: trim(x.content) <> ''), lambda x: CASE WHEN x.role = 'user' THEN '[USER] ' ELSE '[ASSISTANT] ' END || trim(x.content)), chr(10) || chr(10))) AS digest FROM turns")
def from_messages(spark, folder):
    """Conversations written from their messages."""
    return dialogues(spark, folder).select("doc_id", F.md5(formats.conversation(F.col("messages"))).alias("digest"))


@query("nrm09_role_blocks", f"WITH {_TURNS} SELECT doc_id, len(ms) AS turn_count, md5(array_to_string(list_transform(ms, lambda x: '<' || upper(x.role) || '>' || chr(10) || x.content || chr(10) || '</' || upper(x.role) || '>'), chr(10))) AS digest FROM turns")
def role_blocks(spark, folder):
    return dialogues(spark, folder).select("doc_id", F.size("messages").alias("turn_count"), F.md5(formats.role_blocks(F.col("messages"))).alias("digest"))


@query("nrm04_lessons", "SELECT id, md5(concat_ws(chr(10), '### Topic: ' || nullif(domain, ''), chr(10) || '### Explanation:' || chr(10) || nullif(text, ''), chr(10) || '### Metadata:' || chr(10) || nullif(concat_ws('  ' || chr(10), 'Subject: ' || nullif(dataset, ''), 'Grade: ' || nullif(version, '')), ''))) AS digest FROM normalized_documents WHERE id IS NOT NULL")
def lessons(spark, folder):
    """Lessons written from the fields of each record, as often as it was sent."""
    rows = table(spark, folder, "normalized_documents").where("id IS NOT NULL")
    text = formats.lesson({"Topic": F.col("domain"), "Explanation": F.col("text"), "Subject": F.col("dataset"), "Grade": F.col("version")})
    return rows.select("id", F.md5(text).alias("digest"))


@query("nrm05_lesson_metadata", "SELECT id, to_json({subject: coalesce(dataset, ''), grade: coalesce(version, ''), topic: coalesce(domain, ''), difficulty: '', student_level: '', question_type: '', question_complexity: '', estimated_time: '', prerequisites: '', source_type: 'textbook'})::VARCHAR AS metadata FROM normalized_documents WHERE id IS NOT NULL")
def lesson_metadata(spark, folder):
    rows = table(spark, folder, "normalized_documents").where("id IS NOT NULL")
    return rows.select("id", formats.lesson_metadata({"subject": F.col("dataset"), "grade": F.col("version"), "topic": F.col("domain")}).alias("metadata"))


@query("nrm08_instructions", "SELECT item_id, '### Instruction:' || chr(10) || trim(coalesce(question, '')) || chr(10) || chr(10) || '### Reference Answer:' || chr(10) || trim(coalesce(benchmark, '')) AS text FROM eval_items")
def instructions(spark, folder):
    return table(spark, folder, "eval_items").select("item_id", formats.instruction(F.col("question"), F.lit(None).cast("string"), F.col("benchmark")).alias("text"))


@query("nrm10_partitions", f"SELECT source, sum(strlen({_T}))::BIGINT AS n_bytes, greatest(1, floor(sum(strlen({_T})) / 1073741824.0::DOUBLE * 1024 / 256 * 1.1)::BIGINT) AS by_size, greatest(1, least(400, count(*) // 5000)) AS by_rows FROM documents GROUP BY source")
def partitions(spark, folder):
    """Output partitions of each source: 256 MB each with a tenth of room, or 5,000 rows each, at most 400."""
    g = table(spark, folder, "documents").groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n_bytes"), F.count("*").alias("n"))
    size = F.greatest(F.lit(1), F.floor(F.col("n_bytes") / F.lit(1073741824.0) * 1024 / 256 * 1.1))
    return g.select("source", "n_bytes", size.alias("by_size"), F.greatest(F.lit(1), F.least(F.lit(400), F.expr("n DIV 5000"))).alias("by_rows"))


# Measures within a document: arrays, no shuffle


def texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("met14_token_entropy", f"WITH x AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), c AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id, w) SELECT d.doc_id, coalesce(round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4), 0.0) AS entropy FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id")
def token_entropy(spark, folder):
    """Entropy of a document's words, in bits."""
    w = texts(spark, folder).select("doc_id", m.words(F.col("text")).alias("w"))
    spread = m.sum_over_counts(F.col("w"), lambda n: n * F.log2(n))
    return w.select("doc_id", F.when(F.size("w") > 0, F.round(F.log2(F.size("w")) - spread / F.size("w"), 4)).otherwise(0.0).alias("entropy"))


@query("met15_repetition", f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, CASE WHEN len(w) < 5 THEN 0.0 ELSE round(1 - len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) / (len(w) - 4)::DOUBLE, 6) END AS repetition FROM d")
def repetition(spark, folder):
    """Share of a document's sequences of five words that were there before."""
    d = texts(spark, folder).select("doc_id", m.words(F.col("text")).alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.xxhash64(F.slice("w", i, 5)))
    return d.select("doc_id", F.when(F.size("w") < 5, 0.0).otherwise(F.round(1 - F.size(F.array_distinct(grams)) / (F.size("w") - 4), 6)).alias("repetition"))


# Citation marks, the heading of references and its weight.
CITATION, REFERENCES, REFERENCES_WEIGHT = r"\[[0-9]+\]", r"(^|\n)(References|Bibliography|REFERENCES)", 3


@query("met17_citations", f"SELECT doc_id, len(regexp_extract_all({_T}, '{CITATION}')) + CASE WHEN regexp_matches({_T}, '{REFERENCES}') THEN {REFERENCES_WEIGHT} ELSE 0 END AS citations FROM documents")
def citations(spark, folder):
    d = texts(spark, folder)
    return d.select("doc_id", (F.regexp_count("text", F.lit(CITATION)) + F.when(F.col("text").rlike(REFERENCES), REFERENCES_WEIGHT).otherwise(0)).alias("citations"))


# Scripts by their code points; spaces, marks and digits come first.
SCRIPTS = (
    ("whitespace", r"\p{Z}"), ("punctuation", r"\p{P}\p{S}"), ("digits", r"\p{N}"),
    ("latin", r"\x{0041}-\x{024F}\x{1E00}-\x{1EFF}\x{2C60}-\x{2C7F}\x{A720}-\x{A7FF}"), ("devanagari", r"\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}"),
    ("bengali", r"\x{0980}-\x{09FF}"), ("gurmukhi", r"\x{0A00}-\x{0A7F}"), ("gujarati", r"\x{0A80}-\x{0AFF}"), ("oriya", r"\x{0B00}-\x{0B7F}"),
    ("tamil", r"\x{0B80}-\x{0BFF}"), ("telugu", r"\x{0C00}-\x{0C7F}"), ("kannada", r"\x{0C80}-\x{0CFF}"), ("malayalam", r"\x{0D00}-\x{0D7F}"),
    ("sinhala", r"\x{0D80}-\x{0DFF}"), ("thai", r"\x{0E00}-\x{0E7F}"), ("greek", r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}"), ("cyrillic", r"\x{0400}-\x{052F}"),
    ("arabic", r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"), ("hebrew", r"\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}"),
    ("cjk", r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}"),
)
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(ch, '^[{r}]$') THEN '{n}'" for n, r in SCRIPTS) + " ELSE 'other' END"


@query("met21_scripts", f"WITH x AS (SELECT doc_id, {_CLASS} AS script FROM (SELECT doc_id, unnest(string_split({_T}, '')) AS ch FROM documents) WHERE ch <> ''), c AS (SELECT doc_id, script, count(*) AS n FROM x GROUP BY ALL) SELECT doc_id, count(*) AS n_scripts, sum(n)::BIGINT AS n_chars, arg_max(script, (n, script)) FILTER (script NOT IN ('whitespace', 'punctuation', 'digits', 'other')) AS dominant FROM c GROUP BY doc_id")
def scripts(spark, folder):
    """Scripts of a document's characters and the one with most letters. A class is counted by taking its characters away."""
    without = lambda c, ranges: F.regexp_replace(c, f"[{ranges}]", "")
    marks, ranges = SCRIPTS[:3], SCRIPTS[3:]
    d = texts(spark, folder).where("text <> ''").withColumn("rest", without(F.col("text"), "".join(r for _, r in marks)))
    counts = [(n, F.length("text") - F.length(without(F.col("text"), r))) for n, r in marks] + [(n, F.length("rest") - F.length(without(F.col("rest"), r))) for n, r in ranges]
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.length("rest").alias("n_rest"), *(c.alias(n) for n, c in counts))
    other = F.col("n_rest") - sum((F.col(n) for n, _ in ranges), F.lit(0))
    some = sum((F.when(F.col(n) > 0, 1).otherwise(0) for n, _ in SCRIPTS), F.when(other > 0, 1).otherwise(0))
    letters = F.greatest(*(F.struct(F.col(n).alias("n"), F.lit(n).alias("script")) for n, _ in ranges))
    return d.select("doc_id", some.cast("long").alias("n_scripts"), "n_chars", F.when(letters["n"] > 0, letters["script"]).alias("dominant"))


# Bands from scores

# Weights of the score columns and the greatest score of each band.
WEIGHTS = (("difficulty_score", 0.6), ("readability_score", 0.3), ("entropy_score", 0.1))
BANDS = (("B0", 0.2), ("B1", 0.4), ("B2", 0.55), ("B3", 0.7), ("B4", 0.85), ("B5", 1.0))


def band_of_scores(df, weights=WEIGHTS, bands=BANDS):
    """Adds ``band_score``, the mean of the scores that are there by their weights (0.5 if none is), and ``band_id``, the first band
    whose greatest score it doesn't exceed, else the last. Columns that the table lacks count as missing."""
    there = [(F.col(c), w) for c, w in weights if c in df.columns]
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in there), F.lit(0.0))
    score = F.when(total > 0, sum((F.coalesce(c * w, F.lit(0.0)) for c, w in there), F.lit(0.0)) / total).otherwise(0.5)
    scored = df.withColumn("band_score", score)
    band = F.coalesce(*(F.when(F.col("band_score") <= most, b) for b, most in bands), F.lit(bands[-1][0]))
    return scored.withColumns({"band_id": band, "band_score": F.round("band_score", 4)})


_READ = "least(1, word_count / 1000.0::DOUBLE)"
_SCORE = f"CASE WHEN difficulty_score IS NULL AND word_count IS NULL THEN 0.5 ELSE (coalesce(difficulty_score * 0.6::DOUBLE, 0) + coalesce({_READ} * 0.3::DOUBLE, 0)) / (CASE WHEN difficulty_score IS NULL THEN 0 ELSE 0.6::DOUBLE END + CASE WHEN word_count IS NULL THEN 0 ELSE 0.3::DOUBLE END) END"


@query("met12_band_of_scores", f"SELECT uuid, round(s, 4) AS band_score, " + "CASE " + " ".join(f"WHEN s <= {b}::DOUBLE THEN '{n}'" for n, b in BANDS) + f" ELSE 'B5' END AS band_id FROM (SELECT uuid, {_SCORE} AS s FROM band_records)")
def met12(spark, folder):
    rows = table(spark, folder, "band_records").select("uuid", "difficulty_score", F.least(F.lit(1.0), F.col("word_count") / F.lit(1000.0)).alias("readability_score"))
    return band_of_scores(rows).select("uuid", "band_score", "band_id")


@query("met23_first_rejection", f"""WITH r AS (SELECT id, {_T} AS text, label_text FROM (SELECT id, text, language AS label_text FROM normalized_documents WHERE id IS NOT NULL))
  SELECT r.id, CASE WHEN length(text) < 20 THEN 'length' WHEN l.label_text IS NULL THEN 'language' WHEN len(regexp_extract_all(text, '[0-9]')) > 0.3::DOUBLE * length(text) THEN 'digits' END AS rejected_by,
    CASE WHEN NOT (length(text) < 20 OR l.label_text IS NULL) THEN round(len(regexp_extract_all(text, '[0-9]')) / length(text)::DOUBLE, 6) END AS digit_share
  FROM r LEFT JOIN (SELECT DISTINCT label_text FROM language_labels) l USING (label_text)""")
def first_rejection(spark, folder):
    """Measures by level; a record's later levels are left out after its first rejection."""
    rows = table(spark, folder, "normalized_documents").where("id IS NOT NULL").select("id", F.coalesce("text", F.lit("")).alias("text"), F.col("language").alias("label_text"))
    known = table(spark, folder, "language_labels").select("label_text", F.lit(True).alias("known")).distinct()
    rows = rows.join(F.broadcast(known), "label_text", "left")
    share = F.try_divide(F.regexp_count("text", F.lit("[0-9]")), F.length("text"))
    levels = [[("length", F.length("text"), lambda v: v < 20)], [("language", F.coalesce("known", F.lit(False)), lambda v: ~v)], [("digits", share, lambda v: v > 0.3)]]
    return extracted(rows, levels).select("id", "rejected_by", F.round("digits", 6).alias("digit_share"))


# Orders, shares and manifests

_ORDER = f"md5('{SEED}:' || doc_id)"


@query("sel22_manifests", f"WITH r AS (SELECT doc_id, band, row_number() OVER (PARTITION BY band ORDER BY {_ORDER}) AS i, count(*) OVER (PARTITION BY band) AS n FROM documents WHERE band IS NOT NULL) SELECT doc_id, band FROM r WHERE i <= floor(n * 0.4::DOUBLE)")
def manifests(spark, folder):
    """The first two fifths of each band in a seeded order."""
    rows = shuffled(spark, folder).where("band IS NOT NULL").withColumns({"one": F.lit(1).cast("long"), "number": F.conv(F.substring("key", 1, 12), 16, 10).cast("long")})
    number = rows.groupBy(F.col("band").alias("b")).agg(F.floor(F.count("*") * F.lit(0.4)).alias("most"))
    placed = with_total_before(rows, ["band"], "number", "key", "one", descending=False)
    return placed.join(F.broadcast(number), F.col("band") == F.col("b")).where(F.col("before") < F.col("most")).select("doc_id", "band")


@query("sel23_noisy_top", f"WITH u AS (SELECT doc_id, n / 1000.0::DOUBLE / 0.9::DOUBLE - ln(-ln((('0x' || substr({_ORDER}, 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)) AS score FROM (SELECT doc_id, {_N} AS n FROM documents)) SELECT doc_id FROM u ORDER BY score DESC, doc_id LIMIT (SELECT greatest(1, round(0.1 * count(*)))::BIGINT FROM documents)")
def noisy_top(spark, folder):
    """A top-k operator: the tenth of the documents with the greatest scores after seeded Gumbel noise."""
    rows = shuffled(spark, folder)
    u = (F.conv(F.substring("key", 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(281474976710656.0)
    scored = rows.select("doc_id", (F.col("n") / F.lit(1000.0) / F.lit(0.9) - F.log(-F.log(u))).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(max(1, round(0.1 * rows.count()))).select("doc_id")


@query("smp05_band_shares", f"WITH s AS (SELECT band FROM documents ORDER BY {_ORDER} LIMIT 500) SELECT band, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY band")
def band_shares(spark, folder):
    """Shares of the bands, estimated from a seeded sample of 500."""
    g = shuffled(spark, folder).orderBy("key").limit(500).groupBy("band").agg(F.count("*").alias("n"))
    return g.select("band", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("smp01_hash_order")
def hash_order(spark, folder):
    """``doc_id, place``: places in the order of the ids' 64-bit hashes, seeded with 42 and compared unsigned."""
    unsigned = F.xxhash64(F.col("doc_id").cast("string")).bitwiseXOR(F.lit(-(2**63)).cast("long"))
    rows = docs(spark, folder).select("doc_id", unsigned.alias("number"), F.lit(1).cast("long").alias("one"), F.lit(0).alias("all"))
    return with_total_before(rows, ["all"], "number", "doc_id", "one", descending=False).select("doc_id", F.col("before").alias("place"))


@query("smp12_stripes", "WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) SELECT source, i % 4 AS rank, i // 4 AS turn FROM s")
def stripes(spark, folder):
    """Shards dealt to four workers: worker r takes every fourth from the r-th on."""
    shards = docs(spark, folder).where("source IS NOT NULL").select("source").distinct()
    numbered = shards.select("source", (F.row_number().over(Window.orderBy("source")) - 1).alias("i"))
    return numbered.select("source", (F.col("i") % 4).alias("rank"), F.expr("i DIV 4").alias("turn"))


_LENGTH = 1024


@query("pck09_sequences", f"WITH t AS (SELECT source, sum(length({_T}) * 4)::BIGINT AS n_bytes FROM documents WHERE source IS NOT NULL GROUP BY source), c AS (SELECT source, n_bytes // 4 // {_LENGTH} AS n FROM t), s AS (SELECT source, n, sum(n) OVER (ORDER BY source) - n AS first FROM c), steps AS (SELECT unnest(range(0, (SELECT sum(n)::BIGINT FROM c), 100)) AS step) SELECT step, source, (step - first)::BIGINT * {_LENGTH} AS token_offset FROM steps JOIN s ON step >= first AND step < first + n")
def sequences(spark, folder):
    """Where every hundredth sequence of 1,024 tokens begins, the sources' streams one after another: a range join with one row
    for each source."""
    t = docs(spark, folder).where("source IS NOT NULL").groupBy("source").agg(F.sum(F.col("n") * 4).alias("n_bytes"))
    c = t.select("source", F.expr(f"n_bytes DIV 4 DIV {_LENGTH}").alias("n"))
    s = c.withColumn("first", F.sum("n").over(Window.orderBy("source")) - F.col("n"))
    from_zero = F.ceil(F.col("first") / 100) * 100
    steps = s.where(from_zero < F.col("first") + F.col("n")).select("source", "first", F.explode(F.sequence(from_zero, F.col("first") + F.col("n") - 1, F.lit(100).cast("long"))).alias("step"))
    return steps.select("step", "source", ((F.col("step") - F.col("first")) * _LENGTH).alias("token_offset"))


@query("obs14_last_minutes", "SELECT DISTINCT run_id FROM metric_points WHERE event_time > (SELECT max(event_time) FROM metric_points) - INTERVAL 5 MINUTE")
def last_minutes(spark, folder):
    """Runs with a point in the five minutes before the latest point of all."""
    points = table(spark, folder, "metric_points").select("run_id", "event_time")
    now = points.agg(F.max("event_time").alias("now"))
    return points.join(F.broadcast(now), F.col("event_time") > F.col("now") - F.expr("INTERVAL 5 MINUTES")).select("run_id").distinct()


PROTECTED = ("B4", "B5")


@query("sel09_protected", f"""WITH {_TARGETS}, r AS (SELECT d.*, target, coalesce(sum(n) OVER (PARTITION BY band, domain ORDER BY n DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN targets USING (band, domain)),
  chosen AS (SELECT doc_id, band, n FROM r WHERE before < target), b AS (SELECT band, floor(max(ratio) * {BUDGET * 100})::BIGINT AS goal FROM policy WHERE band IN {PROTECTED} GROUP BY band),
  missing AS (SELECT b.band, goal - coalesce(sum(c.n), 0) AS room FROM b LEFT JOIN chosen c ON c.band = b.band GROUP BY b.band, goal),
  rest AS (SELECT d.doc_id, d.band, room, coalesce(sum(n) OVER (PARTITION BY d.band ORDER BY n DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN missing m ON m.band = d.band WHERE room > 0 AND doc_id NOT IN (SELECT doc_id FROM chosen))
  SELECT doc_id, band FROM rest WHERE before < room""")
def protected(spark, folder):
    """Documents of the protected bands that fill what the greedy choice left of the bands' shares, from any domain."""
    chosen = greedy_fill(spark, folder).select("doc_id")
    rows = docs(spark, folder).where(F.col("band").isin(*PROTECTED)).select("doc_id", "band", "n")
    goal = policy(spark).where(F.col("band").isin(*PROTECTED)).groupBy("band").agg(F.floor(F.max("ratio") * BUDGET * 100).alias("goal"))
    taken = rows.join(chosen, "doc_id", "left_semi").groupBy("band").agg(F.sum("n").alias("taken"))
    missing = goal.join(taken, "band", "left").select(F.col("band").alias("b"), (F.col("goal") - F.coalesce("taken", F.lit(0))).alias("room")).where("room > 0")
    rest = rows.join(chosen, "doc_id", "left_anti").join(F.broadcast(missing), F.col("band") == F.col("b"))
    return with_total_before(rest, ["band"], "n", "doc_id", "n").where(F.col("before") < F.col("room")).select("doc_id", "band")


# Layers of leakage, and words cut at a document's end

_BIGRAMS = "list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
_SIMILAR = f"""siw AS (SELECT item_id, regexp_split_to_array(trim(regexp_replace(lower(coalesce(question, '')), '\\s+', ' ', 'g')), ' ') AS ws FROM eval_items), sdw AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(lower({_T}), '\\s+', ' ', 'g')), ' ') AS ws FROM documents),
  sig AS (SELECT item_id, {_BIGRAMS} AS g FROM siw WHERE len(ws) > 1), sdg AS (SELECT doc_id, {_BIGRAMS} AS g FROM sdw WHERE len(ws) > 1),
  similar_items AS (SELECT doc_id, item_id, len(list_intersect(d.g, i.g)) / (len(d.g) + len(i.g) - len(list_intersect(d.g, i.g)))::DOUBLE AS similarity FROM sdg d JOIN sig i ON len(d.g) <= 1.25 * len(i.g) AND len(i.g) <= 1.25 * len(d.g))"""


def similar_items(spark, folder, least=0.8):
    """``doc_id, item_id, similarity``: documents that are an item but for small changes, by their sets of word pairs. Only documents
    of about an item's size can be; the few that are meet the items on their rarer word pairs first."""

    def grams(rows, text):
        rows = rows.withColumn("w", F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " "))
        pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(F.slice("w", i, 2))))
        return rows.withColumn("g", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<bigint>"))).drop("w")

    items = grams(table(spark, folder, "eval_items").select("item_id", "question"), F.col("question")).select("item_id", F.col("g").alias("ig"))
    spans = items.agg(F.min(F.when(F.size("ig") > 0, F.size("ig"))).alias("low"), F.max(F.size("ig")).alias("high")).first()
    if spans["low"] is None:
        return items.select(F.lit(0).cast("long").alias("doc_id"), "item_id", F.lit(0.0).alias("similarity"))
    rows = grams(table(spark, folder, "documents").select("doc_id", "text"), F.col("text")).select("doc_id", "g")
    rows = where_computed(rows, f"size(g) BETWEEN {int(least * spans['low'])} AND {int(spans['high'] / least) + 1}")
    shared = rows.select("doc_id", F.size("g").alias("n"), F.explode("g").alias("pair")).join(F.broadcast(items.select("item_id", F.size("ig").alias("k"), F.explode("ig").alias("pair"))), "pair")
    shared = shared.where((F.col("n") <= F.col("k") / least) & (F.col("k") <= F.col("n") / least))
    both = shared.groupBy("doc_id", "item_id", "n", "k").agg(F.count("*").alias("both"))
    return both.select("doc_id", "item_id", (F.col("both") / (F.col("n") + F.col("k") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= least)


@query("dcn03_similar_items", f"WITH {_SIMILAR} SELECT doc_id, item_id, round(similarity, 6) AS similarity FROM similar_items WHERE similarity >= 0.8")
def dcn03(spark, folder):
    return similar_items(spark, folder).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


@query("dcn05_layers", SQL["dcn05_strictest_layer"][: SQL["dcn05_strictest_layer"].index(", layers AS")].replace("WITH ", f"WITH {_SIMILAR}, ", 1) + " SELECT doc_id, min(layer) AS layer FROM (SELECT doc_id, 'N-GRAM' AS name, 1 AS layer FROM shared UNION ALL SELECT doc_id, 'MINHASH', 2 FROM similar_items WHERE similarity >= 0.8) GROUP BY doc_id")
def layers(spark, folder):
    """The first layer that finds a document: sequences of an item's words, then an item with small changes."""
    found = shared_grams(spark, folder).select("doc_id", F.lit(1).alias("layer")).union(similar_items(spark, folder).select("doc_id", F.lit(2).alias("layer")))
    return found.groupBy("doc_id").agg(F.min("layer").alias("layer"))


@query("dcn09_cut_words", "WITH r AS (SELECT source, doc_id, regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}]$') AS ended, regexp_matches(coalesce(text, ''), '^[a-z]') AS starts FROM documents WHERE source IS NOT NULL), l AS (SELECT source, doc_id, starts, lag(ended) OVER (PARTITION BY source ORDER BY doc_id) AS before_ended FROM r) SELECT source, count(*) FILTER (before_ended AND starts) AS leaky, count(*) FILTER (NOT (before_ended AND starts)) AS clean FROM l WHERE before_ended IS NOT NULL GROUP BY source")
def cut_words(spark, folder):
    """Boundaries in packing order where the document before ends inside a word and the next begins inside one. Neighbours meet by
    their places, so no source is sorted in one task."""
    d = table(spark, folder, "documents").where("source IS NOT NULL")
    t = F.coalesce("text", F.lit(""))
    rows = d.select("source", "doc_id", t.rlike(r"[\p{L}\p{N}]\z").alias("ended"), t.rlike("^[a-z]").alias("starts"), F.lit(1).cast("long").alias("one"))
    placed = with_total_before(rows, ["source"], "doc_id", "doc_id", "one", descending=False)
    before = placed.select("source", (F.col("before") + 1).alias("before"), F.col("ended").alias("before_ended"))
    leaky = F.col("before_ended") & F.col("starts")
    return placed.join(before, ["source", "before"]).groupBy("source").agg(F.count_if(leaky).alias("leaky"), F.count_if(~leaky).alias("clean"))
