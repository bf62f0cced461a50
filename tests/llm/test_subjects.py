"""Topics without labels, their mapping, and documents without topical words."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from quern.llm import subjects

TERMS = {
    "sport": "match goal player trophy referee league stadium striker".split(), "law": "judge court verdict appeal witness statute clause lawyer".split(),
    "food": "oven flour recipe butter sauce spice kettle pastry".split(), "music": "violin chord melody sonata choir tempo opera flute".split(),
}
FRAMES = ["The {} was seen near the {} today.", "Some say the {} needs a {} now.", "Nobody at the {} had noticed the {} before."]
NEUTRAL = ["My aunt came back with a lamp.", "We sat near the window all day.", "They walked home in the rain."]


def about(topic, n, seed):
    rng = random.Random(f"{topic} {seed}")
    return " ".join(rng.choice(FRAMES).format(*rng.sample(TERMS[topic], 2)) if topic and rng.random() < 0.8 else rng.choice(NEUTRAL) for _ in range(n))


@pytest.fixture()
def corpus(spark):
    names = [*TERMS, None]
    topics = [names[i % 5] for i in range(600)]
    documents = spark.createDataFrame([(i, about(t, 8, i), "en") for i, t in enumerate(topics)], "doc_id long, text string, lang string")
    return topics, documents, spark.createDataFrame([(t, "") for t in TERMS], "subject string, about string")


def labelled(spark, topics, number):
    return spark.createDataFrame([(i, t) for i, t in enumerate(topics[:number]) if t], "doc_id long, subject string")


def share_right(found, topics):
    by_document = {}
    for r in found.collect():
        by_document.setdefault(r["doc_id"], set()).add(r["subject"])
    return np.mean([by_document.get(i, set()) == ({t} if t else set()) for i, t in enumerate(topics)])


def test_small_batches_and_documents_without_topical_words(spark, corpus):
    topics, documents, names = corpus
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert share_right(subjects.document_subjects(documents, names, labelled(spark, topics, 100)), topics) > 0.95
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_without_labels_descriptions_name_the_topics(spark, corpus):
    topics, documents, _ = corpus
    none = spark.createDataFrame([], "doc_id long, subject string")
    described = spark.createDataFrame([(t, "on " + ", ".join(w[:6])) for t, w in TERMS.items()], "subject string, about string")
    assert share_right(subjects.document_subjects(documents, described, none), topics) > 0.9
    bare = spark.createDataFrame([(t, None) for t in TERMS], "subject string, about string")
    assert subjects.document_subjects(documents, bare, none).count() == 0


def test_terms_show_what_each_topic_is_about(spark, corpus):
    topics, documents, names = corpus
    fitted = subjects.fit(documents, names, labelled(spark, topics, 100))
    rows = subjects.inspected(documents, fitted).where("subject IS NOT NULL AND speaks").collect()
    assert {r["subject"] for r in rows} == set(TERMS)
    assert np.mean([r["term"] in TERMS[r["subject"]] for r in rows]) > 0.9


def test_a_subject_outside_any_sample_is_found(spark):
    from pyspark.sql import functions as F

    # Music is only in documents whose hashes are the greatest: a draw of 1,500 of these by hash has none of it.
    drawn = (F.shiftrightunsigned(F.xxhash64(F.lit(10), "id"), 11) / F.lit(float(2**53))).alias("drawn")
    ids = [r["id"] for r in spark.range(2500).select("id", drawn).orderBy("drawn").collect()]
    topics = dict(zip(ids, [["sport", "law", "food", None][i % 4] if i < 2300 else "music" for i in range(2500)]))
    documents = spark.createDataFrame([(i, about(t, 8, i), "en") for i, t in topics.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, t) for i, t in topics.items() if t and i % 5 == 0], "doc_id long, subject string")
    found = {(r["doc_id"], r["subject"]) for r in subjects.document_subjects(documents, spark.createDataFrame([(t, "") for t in TERMS], "subject string, about string"), labels).collect()}
    right = {s: np.mean([(i, s) in found for i, t in topics.items() if t == s]) for s in TERMS}
    assert min(right.values()) > 0.95, right


TEXTS = [
    "", "\n", "1. foo", "foo. 123", ". foo", "...\n! a", "a\n\n\nb", "# h\nx", "x\n## \ny", "**b** \nz", "== a\nq", "fooBar_bazQux HTTPServer", "क।ख। ग", "\u200dabc x", "क \u093eabc \u093eकख",
    "a . b", "?!x", "x 12\n34\n.. .", "Ünïcöde. É", "𝒜bc d. 😀 x\u093ey", "\x01", "a\x01b. \x01", "İx. Ab", "a\r\nb\x85c", "३४ क3ख. x", "1.\n2.\n3.", "|---|---|\n|a|b|", "end!?", " . ", "snake_case. _",
]


def words_and_units(text):
    """Word numbers and the words of each unit, as the definitions have them."""
    units = [subjects.WORD.findall(u) for u in subjects.units_of(subjects.split_names(text).lower())]
    return [subjects.word_number(w) for u in units for w in u], [len(u) for u in units]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_rows_of_documents_hold_all_words_and_units(monkeypatch, size):
    monkeypatch.setattr(subjects, "SLICE", size)
    rows = pd.DataFrame({"doc_id": range(len(TEXTS)), "lang": ["en", "hi"] * (len(TEXTS) // 2), "mask": 1, "text": TEXTS})
    found, counted = {}, {}
    for r in pd.concat(list(subjects._number(iter([rows.iloc[:17], rows.iloc[17:]])))).itertuples():
        words = np.frombuffer(r.words, np.int32)
        if r.kind == 1:
            counted.update({(r.lang, w): n for w, n in zip(words.tolist(), np.frombuffer(r.tokens, np.int32).tolist())})
            continue
        places, unit, document, units = subjects._opened(r.words, r.tokens, r.lengths, r.units, subjects.Lookup(words, np.arange(len(words))))
        for i, key in enumerate(r.docs):
            own = document[unit] == i
            found[key] = (words[places[own]].tolist(), np.frombuffer(r.lengths, np.int32)[document == i].tolist())
    assert found == {i: words_and_units(t) for i, t in enumerate(TEXTS)}
    expected = Counter((lang, w) for lang, t in zip(rows["lang"], TEXTS) for w in set(words_and_units(t)[0]))
    assert counted == dict(expected)


def test_bags_hold_all_words_of_their_documents(monkeypatch):
    monkeypatch.setattr(subjects, "BAGS", 7)
    rows = pd.DataFrame({"doc_id": range(200), "lang": "", "mask": np.arange(200), "text": [about(t, 6, i) for i, t in enumerate([*TERMS] * 50)]})
    numbers = pd.concat(list(subjects._number(iter([rows]))))
    numbers = numbers[numbers["kind"] == 0][["masks", "words", "tokens", "lengths", "units"]]
    words = np.unique([w for t in rows["text"] for w in words_and_units(t)[0]]).astype(np.int32)
    sent = type("Sent", (), {"value": (np.arange(len(words)) * 2 // len(words), subjects.Lookup(words, np.arange(len(words))))})
    found = {}
    for _, n, masks, document, places, counts in subjects._bags(subjects._bag_rows(sent)(iter([numbers]))):
        for i in range(n):
            found[int(masks[i])] = dict(zip(words[places[document == i]].tolist(), counts[document == i].tolist()))
    assert found == {i: dict(Counter(words_and_units(t)[0])) for i, t in enumerate(rows["text"])}


def test_tables_and_broadcasts_are_deleted_when_read_for_the_last_time(spark, corpus):
    from quern.checkpoints import shared_folder

    topics, documents, names = corpus
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before, sent = set(folder.iterdir()) if folder.exists() else set(), set(Path(spark.sparkContext._temp_dir).iterdir())
    assert share_right(subjects.document_subjects(documents, names, labelled(spark, topics, 100)), topics) > 0.95
    assert {p.name.split("-")[0] for p in set(folder.iterdir()) - before} == {"labels", "numbered"}
    # What the result itself reads.
    assert len(set(Path(spark.sparkContext._temp_dir).iterdir()) - sent) == 1


def test_sums_and_proportions_of_nothing():
    none = np.zeros(0, dtype=np.int64)
    assert subjects.sums(none, np.zeros((0, 3), dtype=np.float32), 2).dtype == np.float32
    shares = subjects.proportions(none, none, none, np.zeros(2, dtype=np.int64), np.ones((0, 3), dtype=np.float32))
    assert shares.shape == (2, 4) and not shares.any()
    places, counts = subjects.discover([], 1)
    assert len(places) == 0 and counts.shape == (0, subjects.TOPICS)
