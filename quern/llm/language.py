"""Problem 4: languages of texts and of passages within them, with a confidence.

The classifier is sparse multinomial logistic regression on TF-IDF weighted character n-grams of words, trained with
follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled records. Labels are partly wrong, so
sentences that a first fit clearly gives to another language don't train the second. A temperature fitted on held-out
sentences calibrates the confidence.

A text's score is a sum over its words, so each distinct word is scored once in a worker and texts are sums of looked-up
rows. A word belongs to the language that scores best over the words around it; runs of one language are passages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_rows, unit

#: Bounds of the labelled sample, in records: read for each language, and used of those for each language and script.
SAMPLE_RECORDS, TRAINING_RECORDS = 1600, 300
LONGEST_GRAM, LEAST_SENTENCES, MOST_GRAMS = 4, 3, 120_000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.3, 0.5, 2
#: Words on each side that decide a word's language with it.
AROUND = 7
#: Shorter runs between two runs of one language belong to it.
SHORT_RUN = 8
MOST_LABELS = 10_000

LETTERS = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯऀ-෿‌‍])*")
SENTENCE = re.compile(r"[.!?।॥]+\s|\n")


def letters_of(word: str) -> str:
    """The word's letters in lower case; empty for numbers and marks."""
    if word.isalpha():
        return word.lower()
    found = LETTERS.findall(word)
    return max(found, key=len).lower() if found else ""


def grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, LONGEST_GRAM + 1) for i in range(len(w) - n + 1)][2:]


class Classifier:
    """languages; place of each known n-gram; its weight by language (TF-IDF factor included); bias; temperature.
    Of a piece of text: (bias + sum of its words' weights / norm of its TF-IDF counts) / temperature.
    calibration_error: of the held-out sentences, wrong labels among them included; None if there are none."""

    calibration_error: float | None = None

    def __init__(self, languages: list[str], places: dict[str, int], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.places, self.idf, self.weights, self.bias, self.temperature = languages, places, idf, weights, bias, temperature

    def table(self) -> np.ndarray:
        """A row for each n-gram: what it adds to the weights by language, and to the squared norm."""
        return np.concatenate([self.idf[:, None] * self.weights, self.idf[:, None] ** 2], 1).astype(np.float32) if len(self.idf) else np.zeros((1, len(self.languages) + 1), dtype=np.float32)

    def logits(self, sums: np.ndarray) -> np.ndarray:
        return self.bias + sums[..., :-1] / np.sqrt(np.maximum(sums[..., -1:], 1e-9))

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        return softmax(self.logits(sums) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_grams: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with L1 and L2 over sparse rows (places, values); the last place is the bias."""
    z, n = np.zeros((n_grams + 1, k)), np.zeros((n_grams + 1, k))
    order = np.random.default_rng(seed)

    def leader(at):
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            at, value = rows[r]
            w = leader(at)
            p = softmax(value @ w)
            p[labels[r]] -= 1.0
            g = value[:, None] * p
            square = g * g
            before = n[at]
            z[at] += g - (np.sqrt(before + square) - np.sqrt(before)) / ALPHA * w
            n[at] = before + square
    everything = leader(np.arange(n_grams + 1))
    return everything[:-1], everything[-1]


def train(texts: list[tuple[str, str]], seed: int = 4) -> Classifier:
    """A classifier from labelled texts (text, language)."""
    languages = sorted({x for _, x in texts})
    by_kind: dict[tuple, list[str]] = {}
    for text, language in texts:
        latin = sum(c.isascii() for c in text) > 0.7 * len(text)
        by_kind.setdefault((language, latin), []).append(text)
    numbers: dict[str, int] = {}
    sentences, labels = [], []
    for (language, _), own in sorted(by_kind.items()):
        for text in own[:TRAINING_RECORDS]:
            units = [[w for w in map(letters_of, s.split()) if w][:30] for s in SENTENCE.split(text)]
            units = [u for u in units if len(u) >= 5]
            for u in units[:: max(1, len(units) // 3)]:
                found = [numbers.setdefault(g, len(numbers)) for w in u for g in grams(w)]
                sentences.append(np.unique(np.array(found, dtype=np.int32), return_counts=True))
                labels.append(languages.index(language))
    frequency = np.zeros(len(numbers), dtype=np.int64)
    for at, _ in sentences:
        frequency[at] += 1
    often = np.argsort(-frequency, kind="stable")[:MOST_GRAMS]
    often = often[frequency[often] >= LEAST_SENTENCES]
    place = np.full(len(numbers), -1)
    place[often] = np.arange(len(often))
    kept = len(often)
    places = {g: int(place[i]) for g, i in numbers.items() if place[i] >= 0}
    idf = np.log((1 + len(sentences)) / (1 + frequency[often])) + 1
    y = np.array(labels, dtype=np.int64)
    rows = []
    for at, n in sentences:
        at, n = place[at], n[place[at] >= 0].astype(float)
        at = at[at >= 0]
        norm = math.sqrt(max(1e-9, float(n @ (idf[at] ** 2))))
        rows.append((np.append(at, kept), np.append(n * idf[at] / norm, 1.0)))
    k = len(languages)
    if k < 2 or not rows:
        return Classifier(languages, places, idf, np.zeros((kept, k)), np.zeros(k), 1.0)
    held = np.random.default_rng(seed).random(len(rows)) < 0.15
    use = np.flatnonzero(~held)

    def scores(weights, bias, which):
        return np.array([rows[i][1][:-1] @ weights[rows[i][0][:-1]] + bias for i in which])

    weights, bias = _follow_the_leader([rows[i] for i in use], y[use], kept, k, seed)
    p = softmax(scores(weights, bias, range(len(rows))))
    wrong = (p.argmax(1) != y) & (p.max(1) > 0.6)
    # Sentences that the first fit finds wrongly labelled are no examples; held out, they count for the temperature as all others do.
    use, test = np.flatnonzero(~held & ~wrong), np.flatnonzero(held)
    weights, bias = _follow_the_leader([rows[i] for i in use], y[use], kept, k, seed)
    temperature = 1.0
    if len(test):
        found = scores(weights, bias, test)
        tried = np.exp(np.linspace(-3, 2, 101))
        loss = [-np.log(softmax(found / t)[np.arange(len(test)), y[test]] + 1e-12).mean() for t in tried]
        temperature = float(tried[int(np.argmin(loss))])
    fitted = Classifier(languages, places, idf, weights, bias, temperature)
    if len(test):
        p = softmax(found / temperature)
        fitted.calibration_error = calibration_error(p.max(1), p.argmax(1) == y[test])
    return fitted


def calibration_error(confidence: np.ndarray, right: np.ndarray, bins: int = 10) -> float:
    """Mean distance of confidence and accuracy over equal bins of confidence, by number of cases."""
    where = np.minimum((confidence * bins).astype(int), bins - 1)
    n = np.bincount(where, minlength=bins)
    gap = np.abs(np.bincount(where, weights=confidence, minlength=bins) - np.bincount(where, weights=right, minlength=bins))
    return float(gap.sum() / max(1, n.sum()))


def fit(documents: DataFrame, language_labels: DataFrame, id_column: str = "id", text_column: str = "text", label_column: str = "language", seed: int = 4) -> Classifier:
    """Trains on at most SAMPLE_RECORDS labelled records of each language, chosen by a hash of their id."""
    names = dict(tuple(r) for r in bounded_rows(language_labels.select("label_text", "lang_code").where("label_text is not null and lang_code is not null"), MOST_LABELS, "language_labels"))
    rows = documents.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull() & F.col(label_column).isin(list(names)))
    number: Counter = Counter()
    for label, n in rows.groupBy(label_column).count().collect():
        number[names[label]] += n
    rate = F.lit(0.0)
    for code, n in number.items():
        rate = F.when(F.col(label_column).isin([x for x in names if names[x] == code]), F.lit(0.95 * SAMPLE_RECORDS / max(n, 0.95 * SAMPLE_RECORDS))).otherwise(rate)
    sample = rows.where(unit(seed, F.col(id_column)) <= rate).select(id_column, text_column, label_column).limit(SAMPLE_RECORDS * max(1, len(number))).collect()
    return train([(r[1], names[r[2]]) for r in sorted(sample, key=lambda r: xxhash.xxh64_intdigest(f"{seed} {r[0]}"))], seed)


class WordRows:
    """Rows of weights of the words met so far; new ones of a batch are scored together."""

    def __init__(self, classifier: Classifier, most: int = 400_000):
        self.classifier, self.most, self.table = classifier, most, classifier.table()
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.by_letters: dict[str, int] = {"": 0}
        self.rows = np.zeros((1, self.table.shape[1]), dtype=np.float32)

    def of(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.places) > self.most:
            self.clear()
        places, by_letters, known = self.places, self.by_letters, self.classifier.places
        new = {w for words in texts for w in words if w not in places}
        flat, starts, empty = [], [], []
        for w in new:
            letters = letters_of(w)
            i = by_letters.get(letters)
            if i is None:
                i = by_letters[letters] = len(by_letters)
                starts.append(len(flat))
                flat.extend([g for g in map(known.get, grams(letters)) if g is not None])
                empty.append(len(flat) == starts[-1])
            places[w] = i
        if starts:
            flat.append(0)  # so that the last start is in range
            sums = np.add.reduceat(self.table[flat], starts, axis=0)
            if flat[-1:] and not empty[-1]:
                sums[-1] -= self.table[0]
            sums[np.array(empty)] = 0
            self.rows = np.concatenate([self.rows, sums])
        return self.rows[[places[w] for words in texts for w in words]]


def joined_runs(best: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and language by word of runs of one language in one text; short runs between two of one language are part of those."""

    def runs():
        starts = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (text[1:] != text[:-1])])
        return starts, np.r_[starts[1:], len(best)]

    best = best.copy()
    starts, stops = runs()
    if len(starts) > 2:
        one, whose = best[starts], text[starts]
        inner = (stops - starts)[1:-1] < SHORT_RUN
        inner &= (one[:-2] == one[2:]) & (whose[:-2] == whose[1:-1]) & (whose[2:] == whose[1:-1])
        for i in np.flatnonzero(inner) + 1:
            best[starts[i] : stops[i]] = one[i - 1]
        starts, stops = runs()
    return starts, stops, best


def passages(texts: list[str], words_of: WordRows, whole: bool = False) -> list[tuple[int, int | None, int, int, float]]:
    """``(text, first word, words, language, confidence)`` of every run of words of one language, in order; ``whole``: after
    these, of every whole text with words, without a first word."""
    split = [t.split() if t else [] for t in texts]
    sizes = np.array([len(x) for x in split])
    if not sizes.sum() or not words_of.classifier.languages:
        return []
    rows = words_of.of(split).astype(np.float64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, 0)])
    at = np.arange(len(rows))
    low, high = np.maximum(at - AROUND, (ends - sizes)[text]), np.minimum(at + AROUND + 1, ends[text])
    best = words_of.classifier.logits(sums[high] - sums[low]).argmax(1)
    starts, stops, best = joined_runs(best, text)
    confidence = words_of.classifier.probabilities(sums[stops] - sums[starts])[np.arange(len(starts)), best[starts]]
    found = list(zip(text[starts].tolist(), (starts - (ends - sizes)[text[starts]]).tolist(), (stops - starts).tolist(), best[starts].tolist(), confidence.tolist()))
    if whole:
        full = np.flatnonzero(sizes)
        p = words_of.classifier.probabilities(sums[ends[full]] - sums[(ends - sizes)[full]])
        found += zip(full.tolist(), [None] * len(full), sizes[full].tolist(), p.argmax(1).tolist(), p.max(1).tolist())
    return found


def languages(documents: DataFrame, classifier: Classifier, least_words: int = 20, id_column: str = "id", text_column: str = "text", whole: bool = False) -> DataFrame:
    """``id, first_word, n_words, lang_code, confidence``: every passage of at least ``least_words`` words in one language.
    ``whole``: with ``record_code, record_confidence`` of the whole text, and a row without first_word for each text that has
    words, however few, but no passage.

    Null and empty texts, and texts with fewer words, have no passage. Rows sent again give their passages again; rows
    without id are no records.
    """
    known = documents.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of = WordRows(known.value)
        names, columns = known.value.languages, ["id", "first_word", "n_words", "lang_code", "confidence"]
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                ids = part.iloc[:, 0].tolist()
                rows = passages(part.iloc[:, 1].tolist(), words_of, whole)
                made = [(ids[t], first, n, names[k], c, t) for t, first, n, k, c in rows if first is not None and n >= least_words]
                if whole:
                    record, some = {t: (n, names[k], c) for t, first, n, k, c in rows if first is None}, {r[-1] for r in made}
                    made += [(ids[t], None, n, name, c, t) for t, (n, name, c) in record.items() if t not in some]
                    made = [(*r[:-1], *record[r[-1]][1:]) for r in made]
                    yield pd.DataFrame(made, columns=[*columns, "record_code", "record_confidence"]).astype({"first_word": "Int32"})
                else:
                    yield pd.DataFrame([r[:-1] for r in made], columns=columns)

    rows = documents.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).cast("string"), text_column)
    return rows.mapInPandas(run, "id string, first_word int, n_words int, lang_code string, confidence double" + (", record_code string, record_confidence double" if whole else ""))


def label_check(documents: DataFrame, language_labels: DataFrame, found: DataFrame, id_column: str = "id", label_column: str = "language") -> DataFrame:
    """``id, lang_code, confidence, n_words, label_code, n_languages, is_case``: a row for each language of a record.

    is_case: the label names no language, or another one than the record's only language, or the record has several.
    If found is of whole texts too, also ``record_code, record_confidence``; a record without a passage then has n_languages 0,
    and its label is judged by its whole text.
    """
    more = [F.count("first_word").alias("n_passages"), F.max(F.struct("record_confidence", "record_code")).alias("record")] if "record_code" in found.columns else []
    per_language = found.groupBy("id", "lang_code").agg(F.max("confidence").alias("confidence"), F.max("n_words").alias("n_words"), *more)
    counts = per_language.groupBy("id").agg((F.count_if(F.col("n_passages") > 0) if more else F.count("*")).alias("n_languages"))
    if more:
        per_language = per_language.select("id", "lang_code", "confidence", "n_words", "record.record_code", "record.record_confidence")
    labels = documents.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("string").alias("id")).agg(F.max(label_column).alias("label_text"))
    labels = labels.join(F.broadcast(language_labels.select("label_text", F.col("lang_code").alias("label_code"))), "label_text", "left").drop("label_text")
    rows = per_language.join(counts, "id").join(labels, "id")
    return rows.withColumn("is_case", F.col("label_code").isNull() | (F.col("n_languages") > 1) | (F.col("label_code") != F.col("lang_code")))
