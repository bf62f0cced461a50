"""Operators of the ten problems on small tables: exact cases, brute force, and every kind of odd row."""

import itertools
import random

import numpy as np
import pytest

from quern.llm import fields, language, leakage, mixing, neardup, packing, percentiles, quality, sampling, subjects, tokens

DOCS = "id string, text string, content string, n long, shard string"  # the last three clash with inner names
NAMES = [a + b for a in ("bar", "tol", "mig", "sen", "ruk", "pav") for b in ("ton", "dale", "wick", "ford", "ley", "mere")]


def prose(n, seed=0):
    rng = random.Random(seed)
    return " ".join(f"The {rng.choice(NAMES)} of {rng.choice(NAMES)} was not in {rng.choice(NAMES)} for {rng.choice(NAMES)} and {rng.choice(NAMES)}." for _ in range(n))


PROSE = prose(2)
COMMON = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "not"]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "s") for i, t in rows], DOCS)


def common(spark, words=COMMON):
    return spark.createDataFrame([("en", w) for w in words], "lang_code string, word string")


# 1: text types


def test_types_of_clear_texts(spark):
    entries = "\n".join(f"- stone {i}" for i in range(12))
    cells = "\n".join(f"name{i} | {i} | red" for i in range(12))
    noise = "\n".join("~!@<>%$#^&*=" * 3 for _ in range(6))
    again = "A stitch in time saves nine of them. " * 30
    rows = [("prose", prose(5)), ("list", entries), ("table", cells), ("junk", noise), ("again", again), ("mixed", prose(6) + "\n" + "- stone\n- tree\n")]
    found = {r["id"]: r["text_kind"] for r in quality.text_types(docs(spark, rows * 2), common(spark)).collect()}
    assert found == {"prose": "prose", "list": "list", "table": "table", "junk": "junk", "again": "junk", "mixed": "prose"}


def test_types_of_odd_rows(spark):
    rows = [("null", None), ("empty", ""), ("blank", " \n\t\n"), (None, PROSE), ("long", PROSE * 20_000), ("word", "a")]
    found = {r["id"]: r for r in quality.text_types(docs(spark, rows), common(spark)).collect()}
    assert set(found) == {"null", "empty", "blank", "long", "word"}
    assert found["null"]["text_kind"] is None and found["empty"]["n_words"] == 0 and found["blank"]["text_kind"] is None
    assert found["long"]["n_chars"] == len(PROSE) * 20_000


def test_types_of_an_empty_table(spark):
    assert quality.text_types(docs(spark, []), common(spark, [])).count() == 0


def test_accuracies_follow_agreement():
    """Voters that agree outweigh one that contradicts them."""
    names = [n for n, _ in quality.VOTERS]
    agree = sum(1 << names.index(n) for n in ("many_words", "common_words", "sentence_end", "lettered"))
    lone = agree | 1 << names.index("short_neighbours")
    other = sum(1 << names.index(n) for n in ("few_words", "marker", "short_neighbours"))
    posterior = quality.fit(np.array([agree, lone, other]), np.array([900.0, 5.0, 100.0]))
    assert posterior[:2].argmax(1).tolist() == [0, 0] and posterior[2].argmax() == 1
    assert np.allclose(posterior.sum(1), 1)


# 2: tokens


def naive_tokens(text, pieces):
    total = 0
    for chunk in __import__("re").split("[ \t\r\n]+", text or ""):
        at = 0
        while at < len(chunk):
            n = next((k for k in range(len(chunk) - at, 0, -1) if chunk[at : at + k] in pieces), 1)
            at, total = at + n, total + 1
    return total


def test_tokens_match_a_naive_count(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HOT_CHUNKS", 5)  # most chunks take the other way
    rng = random.Random(2)
    pieces = {"ab", "abc", "b", "ca", "है", "हैं", "c ", ""}
    texts = ["".join(rng.choice("abc है \t\n ंx") for _ in range(rng.randrange(60))) for _ in range(40)]
    rows = [(str(i), t) for i, t in enumerate(texts)] + [("n", None), ("e", ""), ("0", texts[0]), (None, "ab")]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(sorted(pieces))] + [(99, None)], "token_id int, piece string")
    found = {r["id"]: r["n_tokens"] for r in tokens.token_counts(docs(spark, rows), table).collect()}
    assert found == {i: naive_tokens(t, pieces) for i, t in rows if i is not None}


def test_tokens_of_an_empty_table(spark):
    table = spark.createDataFrame([], "token_id int, piece string")
    assert tokens.token_counts(docs(spark, []), table).count() == 0
    assert rows_of(tokens.token_counts(docs(spark, [("a", "xy z")]), table)) == [("a", 3)]


# 3: percentiles


def test_small_groups_are_exact(spark):
    rng = random.Random(3)
    rows = [("r", "m", f"h{i % 3}", float(rng.randrange(50))) for i in range(999)]
    odd = [("r", "m", None, float("nan")), ("r", "m", "h", float("inf")), ("r", "m", "h", None), (None, "m", None, 7.0), ("r", None, "h", 1.0)]
    table = spark.createDataFrame(rows + odd, "run_id string, metric string, host string, value double").repartition(7)
    found = {(r["run_id"], r["metric"]): r for r in percentiles.group_percentiles(table).where("scope = 'all'").collect()}
    values = sorted(v for *_, v in rows)
    r = found["r", "m"]
    assert r["n_finite"] == 999 and r["rank_error"] == 0
    assert all(r[f"p{p:02d}"] == values[max(1, (p * 999 + 99) // 100) - 1] for p in percentiles.PERCENTS)
    assert found[None, "m"]["p50"] == 7.0 and found["r", None]["n_finite"] == 1


@pytest.mark.parametrize("shape", ["sorted", "reverse", "ties", "random"])
def test_rank_error_stays_within_its_bound(shape):
    n = 60_000
    values = {"sorted": np.arange(n), "reverse": np.arange(n)[::-1], "ties": np.repeat(np.arange(6), n // 6), "random": np.random.default_rng(1).normal(size=n)}[shape].astype(float)
    parts = []
    for piece in np.array_split(values, 9):
        b = percentiles.Buffers()
        for x in np.array_split(piece, 5):
            b.add(x)
        b.settle()
        parts.append([(level, b.loss if k == 0 else 0.0, v) for k, (level, v) in enumerate(b.rows())])
    joined = percentiles._joined([r for p in parts for r in p])
    count, answers, error = joined.answer(percentiles.PERCENTS)
    assert count == n and 0 < error < 0.02 * n
    ordered = np.sort(values)
    for p, a in zip(percentiles.PERCENTS, answers):
        rank = max(1, (p * n + 99) // 100)
        assert np.searchsorted(ordered, a, "left") + 1 - error <= rank <= np.searchsorted(ordered, a, "right") + error


def test_many_slots_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "MERGE_FAN", 3)
    table = spark.range(5000).selectExpr("'r' run_id", "'m' metric", "cast(id % 5 as string) host", "cast(id as double) value").repartition(20)
    total = percentiles.group_percentiles(table).where("scope = 'all'").first()
    assert total["n_finite"] == 5000 and abs(total["p50"] - 2499) <= total["rank_error"] + 1


def test_percentiles_of_an_empty_table(spark):
    assert percentiles.group_percentiles(spark.createDataFrame([], "run_id string, metric string, host string, value double")).count() == 0


# 4: languages

WORDS = {"en": "the house and water of green river stone with small winter bread", "de": "das haus und wasser von grün fluss stein mit klein winter brot", "es": "la casa y agua de verde rio piedra con invierno pan pequeño"}


def speech(language, n, seed):
    rng = random.Random(f"{language} {seed}")
    return " ".join(rng.choice(WORDS[language].split()) for _ in range(n))


def corpus():
    rows = [(f"{x}{i}", ". ".join(speech(x, 12, f"{i} {k}") for k in range(5)) + ".", x) for x in WORDS for i in range(40)]
    return rows + [("mixed", speech("en", 40, 1) + " " + speech("es", 30, 2), "en"), ("wrong", speech("de", 60, 3), "en"), ("unnamed", speech("es", 60, 4), "??"), ("quote", speech("en", 40, 5) + " " + speech("de", 6, 6) + " " + speech("en", 40, 7), "en"), ("short", "the house", None), ("null", None, "en"), ("empty", "", "en"), (None, "x", "en")]


def test_languages_labels_and_passages(spark):
    table = spark.createDataFrame(corpus(), "id string, text string, language string")
    labels = spark.createDataFrame([(x, x) for x in WORDS], "label_text string, lang_code string")
    found = language.languages(table, language.fit(table, labels))
    cases = {(r["id"], r["lang_code"]) for r in language.label_check(table, labels, found).where("is_case").collect()}
    assert cases == {("mixed", "en"), ("mixed", "es"), ("wrong", "de"), ("unnamed", "es")}
    assert found.where("confidence < 0 OR confidence > 1").count() == 0
    assert {r["id"] for r in found.collect()}.isdisjoint({"short", "null", "empty"})


def test_every_record_with_words_has_a_language(spark):
    rows = corpus() + [("few", "das haus und wasser", "en"), ("turns", " ".join(speech(x, 14, i) for i, x in enumerate(["en", "de", "es"])), None)]
    table = spark.createDataFrame(rows, "id string, text string, language string")
    labels = spark.createDataFrame([(x, x) for x in WORDS], "label_text string, lang_code string")
    found = language.languages(table, language.fit(table, labels), whole=True)
    checked = {(r["id"], r["lang_code"]): r for r in language.label_check(table, labels, found).collect()}
    assert {i for i, _ in checked} == {i for i, t, _ in rows if i and t and t.split()}
    assert checked["few", "de"]["is_case"] and checked["few", "de"]["n_languages"] == 0 and checked["short", "en"]["n_words"] == 2
    assert checked["mixed", "es"]["record_code"] == "en" and all(0 <= r["record_confidence"] <= 1 for r in checked.values())
    assert sum(i == "turns" for i, _ in checked) == 1


def test_held_out_accuracy_and_calibration():
    trained = language.train([(t, x) for i, t, x in corpus()[:120]])
    words = language.WordRows(trained)
    right, sure = [], []
    for x, seed in itertools.product(WORDS, range(40)):
        best = max(language.passages([speech(x, 30, f"new {seed}")], words), key=lambda p: p[2])
        right.append(trained.languages[best[3]] == x)
        sure.append(best[4])
    assert np.mean(right) > 0.97 and np.mean(sure) > 0.8


def test_languages_without_labels(spark):
    table = spark.createDataFrame([("a", "one two", None)], "id string, text string, language string")
    labels = spark.createDataFrame([], "label_text string, lang_code string")
    assert language.languages(table, language.fit(table, labels)).count() == 0
    assert language.languages(table.limit(0), language.fit(table.limit(0), labels)).count() == 0


# 5: near duplicates


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def near_corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 160))]
        rows.append((f"d{k}", " ".join(base)))
        for j in range(rng.randrange(4)):
            other = list(base)
            for _ in range(max(1, len(other) // 50)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append((f"d{k}_{j}", " ".join(other)))
        if k % 5 == 0:
            rows.append((f"d{k}_same", "  " + " ".join(base).upper() + "\n"))
    return rows


def test_pairs_match_brute_force(spark):
    rows = near_corpus()
    odd = [("null", None), ("empty", ""), ("two", "w1 w2"), ("two_more", "w1 w2"), (None, rows[0][1]), rows[3]]
    members, linked = neardup.links(docs(spark, rows + odd))
    found = {(r[0], r[1]) for r in neardup.record_pairs(members, linked).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    expected = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert found == expected and len(found) > 30
    groups = {r["id"]: r["group_id"] for r in neardup.groups(members, linked).collect()}
    assert set(groups) == set(sets) and all(groups[a] == groups[b] for a, b in expected)
    assert len(set(groups.values())) == 40


def test_hot_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_BUCKET", 2)
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = []
    for k in range(12):
        other = list(base)
        other[7 * k] = f"new{k}"
        rows.append((f"d{k:02d}", " ".join(other)))
    members, linked = neardup.links(docs(spark, rows))
    assert linked.count() == 12 * 11 // 2


def test_one_collision_in_a_hot_bucket_is_enough(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_BUCKET", 2)
    width, kept = neardup.WIDTH, [set(m) for m in neardup.masks()]
    differing = next(set(d) for d in itertools.combinations(range(width), neardup.RADIUS) if sum(not m & set(d) for m in kept) == 1)
    # Contents 1, 3 and 4 are equal in the first sketch, 2 differs there in RADIUS symbols; all agree in two symbols of each other sketch.
    rows = [(c, [-c if c == 2 and i in differing else 7 for i in range(width)] + [7 if i % width < 2 else 100 * c + i for i in range(width * neardup.SKETCHES)]) for c in (1, 2, 3, 4)]
    found = neardup.candidates(spark.createDataFrame(rows, "content long, sketch array<int>"), 4)
    assert rows_of(found) == list(itertools.combinations((1, 2, 3, 4), 2))


def test_sketches_miss_as_few_as_documented():
    kept = [set(m) for m in neardup.masks()]
    found = 0.0
    for n in range(neardup.WIDTH + 1):
        found += sum(any(not m & set(d) for m in kept) for d in itertools.combinations(range(neardup.WIDTH), n)) * 0.6 ** (neardup.WIDTH - n) * 0.4**n
    assert (1 - found) ** neardup.SKETCHES < 0.001


def test_every_small_difference_is_covered():
    kept = [set(m) for m in neardup.masks()]
    for n in range(neardup.RADIUS + 1):
        for differing in itertools.combinations(range(neardup.WIDTH), n):
            assert any(not m & set(differing) for m in kept)


def test_near_duplicates_of_an_empty_table(spark):
    members, linked = neardup.links(docs(spark, []))
    assert members.count() == linked.count() == neardup.record_pairs(members, linked).count() == 0


# 6 and 7: mixing and sampling

RECORDS = "id string, source string, dataset string, domain string, language string, band string, n_chars long"


def records(spark, n=3000):
    rng = random.Random(6)
    rows = [(f"r{i}", rng.choices(["big", "mid", "small", None], [70, 25, 4, 1])[0], "d", rng.choice(["x", "y"]), rng.choices(["en", "hi", None], [6, 3, 1])[0], rng.choice(["B0", "B1", None]), rng.randrange(1, 400)) for i in range(n)]
    return spark.createDataFrame(rows, RECORDS), rows


def test_sainte_lague_is_the_highest_quotient_rule():
    shares = [0.53, 0.24, 0.23]
    got = mixing.sainte_lague(shares, 7)
    quotients = sorted(((s / (2 * k + 1), -i) for i, s in enumerate(shares) for k in range(7)), reverse=True)[:7]
    assert got == [sum(-i == j for _, i in quotients) for j in range(3)] and sum(got) == 7
    assert mixing.sainte_lague([0.0, 0.0], 5) == [0, 0] and mixing.sainte_lague([], 5) == []


def test_mixture_reaches_shares_and_limits(spark):
    table, rows = records(spark)
    total = sum(r[6] for r in rows if r[1])
    plans = [("p", "source", "big", 0.5, 1, total // 2), ("p", "source", "mid", 0.3, 3, total // 2), ("p", "source", "small", 0.2, 2, total // 2), ("p", "source", "none", 0.0, 2, total // 2), ("q", "source", "absent", 1.0, None, 1000)]
    targets = spark.createDataFrame(plans, "plan_id string, field_name string, group_key string, target_share double, max_repeats long, plan_chars long")
    mixture, report = mixing.mix(table, targets)
    report = {r["group_key"]: r for r in report.collect()}
    for _, _, key, share, most, chars in plans[:3]:
        own = sum(r[6] for r in rows if r[1] == key)
        assert report[key]["out_of_reach"] == (own * most < share * chars) and report[key]["most_repeats"] <= most
        if own * most >= share * chars:
            assert abs(report[key]["missed_share"]) < 0.02
        else:
            assert report[key]["taken_chars"] == own * most
    assert report["small"]["out_of_reach"] and report["absent"]["out_of_reach"] and not report["none"]["out_of_reach"]
    assert rows_of(mixture) == rows_of(mixing.mix(table.repartition(5), targets)[0])


def test_raking_meets_two_margins():
    available = {("a", "x"): 500, ("a", "y"): 100, ("b", "x"): 100, ("b", "y"): 300}
    size = sampling.rake(available, [{"a": 0.5, "b": 0.5}, {"x": 0.4, "y": 0.6}], 200)
    assert abs(size["a", "x"] + size["a", "y"] - 100) < 0.01 and abs(size["a", "x"] + size["b", "x"] - 80) < 0.01
    quota = sampling.whole(size, available, 200)
    assert sum(quota.values()) == 200
    fixed = sampling.repair(quota, available, [{"a": 150}, {}], 200)
    assert fixed["a", "x"] + fixed["a", "y"] == 150 and sum(fixed.values()) == 200


def test_sample_has_its_quotas(spark):
    table, rows = records(spark)
    plans = [("p", "language", "en", 0.5, 0, 400), ("p", "language", "hi", 0.4, 100, 400), ("p", "language", "xx", 0.1, 5, 400), ("q", "band", "B0", 1.0, 0, 10**6), ("q", "band", "B1", 0.0, None, None)]
    targets = spark.createDataFrame(plans, "plan_id string, field_name string, category string, target_share double, min_records long, sample_records long")
    taken, report = sampling.sample(table, targets)
    report = {(r["plan_id"], r["category"]): r for r in report.collect()}
    drawn = [(r["plan_id"], r["language"] if r["plan_id"] == "p" else r["band"]) for r in taken.collect()]
    assert all(drawn.count(k) == r["drawn"] for k, r in report.items())
    assert report["p", "en"]["drawn"] == 200 and report["p", "hi"]["drawn"] == 160 and report["p", "xx"]["out_of_reach"]
    assert report["q", "B0"]["drawn"] == sum(r[5] == "B0" for r in rows)
    assert taken.select("plan_id", "id").distinct().count() == len(drawn)
    assert rows_of(taken) == rows_of(sampling.sample(table.repartition(7), targets)[0])


def test_mixing_and_sampling_of_empty_tables(spark):
    empty = spark.createDataFrame([], RECORDS)
    mix_targets = spark.createDataFrame([("p", "source", "a", 1.0, 1, 10)], "plan_id string, field_name string, group_key string, target_share double, max_repeats long, plan_chars long")
    mixture, report = mixing.mix(empty, mix_targets)
    assert mixture.count() == 0 and report.first()["out_of_reach"]
    assert mixing.mix(empty, mix_targets.limit(0))[1].count() == 0
    draw = spark.createDataFrame([("p", "band", "B0", 1.0, 1, 10)], "plan_id string, field_name string, category string, target_share double, min_records long, sample_records long")
    taken, report = sampling.sample(empty, draw)
    assert taken.count() == 0 and report.first()["out_of_reach"]


def test_band_of_a_record_is_its_latest(spark):
    from datetime import datetime

    rows = [("a", "u1", "B1", datetime(2025, 1, 1)), ("a", "u2", None, datetime(2025, 2, 1)), ("b", "u3", "B2", datetime(2025, 1, 1)), ("b", "u4", "B3", None), (None, "u5", "B0", None)]
    table = spark.createDataFrame(rows, "id string, uuid string, band string, processed_at timestamp")
    assert {r["id"]: r["band"] for r in fields.bands(table).collect()} == {"a": None, "b": "B2"}


# 8: containers


def test_containers_are_full_and_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_CONTAINERS", 40)
    rng = random.Random(8)
    sizes = [rng.choice([0, 1, 2048, 2049, 5000, *[rng.randrange(1, 900) for _ in range(8)]]) for _ in range(900)]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(1000, None), (None, 5)], "doc_id long, n_tokens long")
    placed = packing.fill_containers(table).collect()
    by_doc, by_container = {}, {}
    for r in placed:
        by_doc.setdefault(r["doc_id"], []).append(r)
        if r["container"] is not None:
            by_container.setdefault(r["container"], []).append(r["tokens"])
    assert set(by_doc) == {*range(900), 1000}
    for i, s in enumerate(sizes):
        assert sum(r["tokens"] for r in by_doc[i]) == s and (len(by_doc[i]) > 1) == (s > 2048)
    assert max(map(sum, by_container.values())) <= 2048
    assert len(by_container) <= 1.01 * sum(sizes) / 2048 + 2


def test_local_search_never_makes_it_worse():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randrange(1, 70) for _ in range(60)]
        bins = [[i] for i in range(60)]
        after = packing.local_search([list(b) for b in bins], sizes, 100)
        assert sorted(i for b in after for i in b) == list(range(60)) and len(after) <= len(bins)
        assert all(sum(sizes[i] for i in b) <= 100 for b in after)


def test_containers_of_an_empty_table(spark):
    assert packing.fill_containers(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


# 9: leaks


def test_leaks_match_brute_force(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 40)))) for k in range(20)] + [(50, None), (51, ""), (None, "x " * 20)]
    rows = []
    for k in range(80):
        text = [rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(60)]
        if k % 2:
            source = items[rng.randrange(20)][1].split()
            n, at = rng.randrange(6, 30), rng.randrange(len(source))
            part = source[at : at + n]
            joint = rng.choice([" ", " <b>", "&nbsp;", "\n> ", " -- "])
            text[20:20] = joint.join(part).split(" ")
        rows.append((k, " ".join(text).upper() if k % 3 == 0 else " ".join(text)))
    rows += [(100, None), (101, ""), (None, items[0][1]), (1, rows[1][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    item_table = spark.createDataFrame(items, "item_id long, question string")
    found = {(r["doc_id"], r["item_id"]): r["words"] for r in leakage.leaks(table, item_table).collect()}

    def longest(a, b):
        return max((next((n for n in range(min(len(a) - i, len(b) - j) + 1) if n == min(len(a) - i, len(b) - j) or a[i + n] != b[j + n])) for i in range(len(a)) for j in range(len(b))), default=0)

    expected = {}
    for d, t in rows:
        for k, q in items:
            if d is not None and t and k is not None and q and (n := longest(leakage.words_of(t), leakage.words_of(q))) >= 12:
                expected[d, k] = n
    assert found == expected and len(found) > 10
    assert leakage.unaffected(table.where("doc_id is not null"), leakage.leaks(table, item_table)).where("doc_id = 101").count() == 1


def test_leaks_of_empty_tables(spark):
    table, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, question string")
    assert leakage.leaks(table, items).count() == 0


# 10: subjects

TOPICS = {"sport": "match goal player trophy referee league".split(), "law": "judge court verdict appeal witness statute".split()}


def about(topic, n, seed):
    rng = random.Random(f"{topic} {seed}")
    frames = ["The {} was seen near the {} today.", "Some say the {} needs a {} now.", "Nobody at the {} had noticed the {} before."]
    neutral = ["My aunt came back with a lamp.", "We sat near the window all day.", "They walked home in the rain."]
    return " ".join(rng.choice(neutral) if topic is None else rng.choice(frames).format(*rng.sample(TOPICS[topic], 2)) for _ in range(n))


def test_subjects_of_documents(spark):
    rows = [(i, about("sport" if i % 2 else "law", 6, i), "en") for i in range(400)] + [(1000, about(None, 8, 1), None), (1001, about("law", 4, 2) + " " + about("sport", 4, 3), "en"), (1002, None, "en"), (1003, "", "en"), (None, about("law", 4, 4), "en"), (1004, about("law", 1, 5) + " " + about(None, 9, 6), "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    subject_table = spark.createDataFrame([("sport", ""), ("law", "")], "subject string, about string")
    labels = spark.createDataFrame([(i, ("sport" if i % 2 else "law") if i % 10 else "law") for i in range(60)] + [(3, "cooking"), (5, None)], "doc_id long, subject string")
    found = {}
    for r in subjects.document_subjects(table, subject_table, labels).collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    right = [found.get(i) == {"sport" if i % 2 else "law"} for i in range(400)]
    assert np.mean(right) > 0.97
    assert found[1001] == {"sport", "law"} and not {1000, 1002, 1003, 1004} & set(found)


def test_a_subject_of_a_third_of_the_documents_is_found(spark, monkeypatch):
    more = {"music": "violin chord melody sonata choir tempo", "food": "oven flour recipe butter sauce spice", "space": "orbit comet rocket planet lunar probe", "farm": "tractor barley harvest cattle plough orchard"}
    for name, words in more.items():
        monkeypatch.setitem(TOPICS, name, words.split())
    names = ["sport"] * 10 + ["law", "music", "food", "space", "farm"] * 3 + [None] * 5
    topics = [names[i % 30] for i in range(600)]
    table = spark.createDataFrame([(i, about(t, 6, i), "en") for i, t in enumerate(topics)], "doc_id long, text string, lang string")
    subject_table = spark.createDataFrame([(t,) for t in TOPICS], "subject string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(topics[:150]) if t], "doc_id long, subject string")
    found = {}
    for r in subjects.document_subjects(table, subject_table, labels).collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    right = {t: np.mean([found.get(i, set()) == ({t} if t else set()) for i, x in enumerate(topics) if x == t]) for t in set(topics)}
    assert min(right.values()) > 0.95, right


def test_subjects_of_empty_tables(spark):
    table = spark.createDataFrame([], "doc_id long, text string, lang string")
    subject_table, labels = spark.createDataFrame([], "subject string"), spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.document_subjects(table, subject_table, labels).count() == 0
