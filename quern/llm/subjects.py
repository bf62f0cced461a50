"""Problem 10: subjects of documents by distributed latent Dirichlet topic models, mapped to subjects by their top terms.

Texts are cut into units (sentences and lines) and words once; words become numbers and are written in rows of many documents
with a dictionary of their own, so later passes read few small arrays. Each language and script has a vocabulary and topics of its own, as topics over all languages at
once turn out to be languages. A document belongs to the language of most of its words, whatever its label says.

1. Topics are found without labels, from all documents. Which words stand together is a matrix of a language's words; its
   principal directions come from PASSES scans over all documents, whose sums have a row for each word, and are rotated so that
   each has few words (varimax). From there rounds of expectation-maximization over all documents give the topics.
2. Topics are mapped by their top terms: each term is looked up in the labelled documents of its language (some of whose
   labels are wrong) and in the subjects' descriptions. A topic most of whose terms' evidence is for one subject is a topic
   of it; the others (phrases, forms, headings) are background. ``inspected`` shows terms, evidence and decision.
3. The topics of one subject are joined over all languages, fitted to all documents once more, and each document's topic
   proportions follow from its units: unit and proportions are fitted to each other, a unit having one topic. A document
   has the subjects whose proportion is a quarter or more.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.checkpoints import discard, written
from quern.llm.common import bounded_rows

INDIC = "ऀ-෿‌‍"
WORD = re.compile(rf"[^\W\d_]+(?:[{INDIC}]+[^\W\d_]*)*|[{INDIC}]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
CAMEL_START = re.compile(r"[A-Z](?<=[a-z].)")
UNIT = re.compile(r"[.!?।॥]+(?=\s|$)|\n")
#: Ends of units and spaces, as many as follow each other, and the mark put in their place.
UNIT_ENDS = re.compile(r"[.!?।॥\n](?:(?<=\n)|[.!?।॥]*(?=\s|\Z))(?:\s+|[.!?।॥]+(?=\s|\Z))*")
END = "\x01"
HEADING = re.compile(r"\s*(?:#{1,6}\s|==|\*\*[^*]*\*\*\s*$)")
#: Model size: the words in most documents of a language and script. A word must be in LEAST_DOCUMENTS documents.
VOCABULARY, LEAST_DOCUMENTS = 8_000, 3
#: A language with a smaller share of the corpus has no vocabulary of its own; its words are measured with others of its script.
LEAST_LANGUAGE = 0.001
#: Topics of a language, directions followed for them, scans that find the directions, and rounds that fit the topics.
TOPICS, DIRECTIONS, PASSES, TOPIC_ROUNDS = 32, 40, 3, 2
#: A word starts in the topic in whose direction it is furthest, if it is so many times as far as the root mean square of words,
#: or half as far as the furthest.
STANDS_OUT = 2.0
TOP_TERMS = 16
#: A topic is one of a subject if its terms' evidence for it is so far on the way from an even share (0) to all (1). Each term
#: has THIN documents of no evidence beside it; a word of a description counts as DESCRIBED labelled documents.
LEAST_EVIDENCE, THIN, DESCRIBED = 0.2, 1.0, 3.0
#: A topic needs so many terms that speak for its subject; fewer may be marks of a form.
LEAST_TERMS = 3
ROUNDS = 2
#: A word speaks for a topic if it is LEAST_RATIO times as frequent there as in its language, by LEAST_Z standard errors.
LEAST_RATIO, LEAST_Z, PRIOR = 1.5, 4.0, 20.0
MOST_SUBJECTS = 60
MOST_BROADCAST = 1_000_000
#: Documents and words of a row of written documents at most (one document may have more), words that a task counts at once,
#: documents and distinct words of a row of bags, whose arrays stay in the processor's cache, and words in a block of sums.
SLICE, SLICE_WORDS, COUNTED, BAGS, BAG_WORDS, BLOCK = 1000, 200_000, 4_000_000, 200, 8_000, 256


def units_of(text: str) -> list[str]:
    """Sentences and lines, without headings."""
    return [u for line in text.split("\n") if line.strip() and not HEADING.match(line) for u in UNIT.split(line) if u.strip()]


def split_names(text: str) -> str:
    """Names in code cut into their words."""
    return CAMEL.sub(" ", text.replace("_", " ")) if "_" in text or not text.isascii() or not text.islower() else text


class WordNumbers(dict):
    """31-bit numbers of words; odd for words in Latin letters."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = word_number(word)
        return value


def word_number(word: str) -> int:
    return (xxhash.xxh64_intdigest(word) & 0x3FFFFFFF) << 1 | (word[0] < "ɐ")


class WordPlaces(dict):
    """Places of words in ``numbers``, in order of appearance; 0 is the end of a unit. ``mixed``: what ``Cutter.run`` takes for one word
    and ``WORD`` for several, an Indic sign and other letters after it."""

    def __init__(self):
        self[END] = 0
        self.numbers, self.place_of, self.mixed = [-1], {}, set()

    def __missing__(self, word: str) -> int:
        found = WORD.match(word)
        if found.end() < len(word):
            self.mixed.add(word)
        number = word_number(word)
        value = self[word] = self.place_of.setdefault(number, len(self.numbers))
        if value == len(self.numbers):
            self.numbers.append(number)
        return value


class Cutter:
    """Words of a text in order, as ``WORD`` finds them in ``units_of(split_names(text).lower())``, with END after each unit. One
    pass puts END between units; what isn't a letter is a space for ASCII texts, and others are read by a fixed set of characters."""

    def __init__(self):
        letter = re.compile(f"[^\\W\\d_]|[{INDIC}]")
        inside = [chr(c) for c in range(0x80, 0x10000) if letter.match(chr(c))]
        within = f"[a-zA-Z{END}{''.join(inside)}]"
        self.run = re.compile(within + within + "*")
        self.any = re.compile(f"{WORD.pattern}|{END}")
        self.ascii = "".join(chr(c) if chr(c).isalpha() or chr(c) == END else " " for c in range(128))

    def words(self, text: str) -> tuple[list[str], str]:
        """The words, and the text from which they were read."""
        text = CAMEL_START.sub(r" \g<0>", text.replace(END, "\x02").replace("_", " ")).lower()
        if "#" in text or "==" in text or "**" in text:
            text = "\n".join([line for line in text.split("\n") if not HEADING.match(line)])
        text = text.strip()
        if first := UNIT_ENDS.match(text):
            text = text[first.end() :]
        if not text:
            return [], text
        text = UNIT_ENDS.sub(f" {END} ", text)
        if not text.endswith(f"{END} "):
            text += f" {END}"
        if text.isascii():
            return text.translate(self.ascii).split(), text
        if len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text):
            return self.any.findall(text), text
        return self.run.findall(text), text

    def places(self, text: str, known: WordPlaces) -> np.ndarray:
        words, read = self.words(text)
        out = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        if known.mixed and not known.mixed.isdisjoint(words):
            words = self.any.findall(read)
            out = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        return out


def _packed_slice(rows: list[tuple], numbers: np.ndarray) -> tuple:
    """A row of documents (kind 0): their distinct words' numbers, each word's place among these, words of each unit, units of each."""
    flat = np.concatenate([r[3] for r in rows])
    ends = np.flatnonzero(flat == 0)
    tokens = flat[flat != 0]
    used = np.flatnonzero(np.bincount(tokens, minlength=1))
    place = np.zeros(len(numbers), dtype=np.int32)
    place[used] = np.arange(len(used))
    units = np.array([np.count_nonzero(r[3] == 0) for r in rows], dtype=np.int32)
    return (
        0, [r[0] for r in rows], np.array([r[2] for r in rows], dtype=np.int64).tobytes(), None, numbers[used].tobytes(),
        place[tokens].astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes(), (np.diff(ends, prepend=-1) - 1).astype(np.int32).tobytes(), units.tobytes(),
    )


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents as numbers, many in a row, and for each language in how many documents each word is (kind 1)."""
    cutter, known, names, pairs, number_of_pairs = Cutter(), WordPlaces(), {}, [], 0
    columns = ["kind", "docs", "masks", "lang", "words", "tokens", "lengths", "units"]

    def counted() -> list[tuple]:
        numbers, out = np.array(known.numbers, dtype=np.int32), []
        if pairs:
            code, n = np.unique(np.concatenate(pairs), return_counts=True)
            lang, cuts = code >> 32, np.flatnonzero(np.diff(code >> 32, prepend=-1))
            by_place = {place: name for name, place in names.items()}
            for a, b in zip(cuts, [*cuts[1:], len(code)]):
                out.append((1, None, None, by_place[int(lang[a])], numbers[code[a:b] & 0xFFFFFFFF].tobytes(), n[a:b].astype(np.int32).tobytes(), None, None))
        pairs.clear()
        return out

    for batch in batches:
        out, rows, size = [], [], 0

        def packed():
            nonlocal number_of_pairs
            lang = np.array([names.setdefault(r[1], len(names)) for r in rows], dtype=np.int64)
            document = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
            code = pd.unique(document << 32 | np.concatenate([r[3] for r in rows]))
            code = code[(code & 0xFFFFFFFF) != 0]
            pairs.append(lang[code >> 32] << 32 | code & 0xFFFFFFFF)
            number_of_pairs += len(code)
            out.append(_packed_slice(rows, np.array(known.numbers, dtype=np.int32)))
            rows.clear()

        for key, lang, mask, text in batch.itertuples(index=False, name=None):
            places = cutter.places(text, known)
            rows.append((key, lang, mask, places))
            size += len(places)
            if len(rows) == SLICE or size >= SLICE_WORDS:
                packed()
                size = 0
            if len(known.numbers) >= 500_000 or number_of_pairs >= COUNTED:
                if rows:
                    packed()
                out += counted()
                known, names, number_of_pairs, size = WordPlaces(), {}, 0, 0
        if rows:
            packed()
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(counted(), columns=columns)


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, words, counts in batch.itertuples(index=False, name=None):
            yield pd.DataFrame({"lang": lang, "word": np.frombuffer(words, np.int32), "n": np.frombuffer(counts, np.int32).astype(np.int64)})


class Lookup:
    """Places of words by number: ``places[i]`` is that of ``words[i]``; -1 for other words."""

    def __init__(self, words: np.ndarray, places: np.ndarray):
        order = np.argsort(words)
        self.words, self.places = words[order], places[order].astype(np.int32)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.places[at], np.int32(-1))


def _opened(words: bytes, tokens: bytes, lengths: bytes, units: bytes, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row of documents: places of the words that ``lookup`` has, the unit of each, the document of each unit, units by document."""
    dictionary = lookup(np.frombuffer(words, np.int32))
    places = dictionary[np.frombuffer(tokens, np.uint16 if len(dictionary) < 65536 else np.uint32)]
    lengths, units = np.frombuffer(lengths, np.int32), np.frombuffer(units, np.int32)
    unit = np.repeat(np.arange(len(lengths)), lengths)
    there = places >= 0
    return places[there], unit[there], np.repeat(np.arange(len(units)), units), units


class Model:
    """Topics over the vocabulary. words: sorted numbers; group: language and script of each; base: the word's share of its group;
    ratio: frequency in each topic against base."""

    def __init__(self, words: np.ndarray, group: np.ndarray, base: np.ndarray, ratio: np.ndarray):
        self.words, self.group, self.base, self.ratio = words, group, base, ratio

    def update(self, counts: np.ndarray) -> Model:
        """Topics from counts of each word in each topic."""
        groups = int(self.group.max()) + 1 if len(self.group) else 0
        total = np.stack([np.bincount(self.group, weights=c, minlength=groups) for c in counts.T], 1)
        expected = self.base[:, None] * total[self.group]
        ratio = (counts + PRIOR * self.base[:, None]) / (expected + PRIOR * self.base[:, None])
        clear = (counts - expected) / np.sqrt(expected + 0.5) > LEAST_Z
        return Model(self.words, self.group, self.base, np.where(clear & (ratio > LEAST_RATIO), ratio, 1.0).astype(np.float32))


def add_at(out: np.ndarray, index: np.ndarray, values: np.ndarray) -> None:
    """Adds the rows of ``values`` to the rows of ``out`` by index, also where there are none."""
    if len(index):
        if (index[1:] < index[:-1]).any():
            near = index - index.min()
            # Numbers of 16 bits are sorted by radix.
            order = np.argsort(near.astype(np.uint16) if near.max() < 65536 else near, kind="stable")
            index, values = index[order], values[order]
        starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        out[index[starts]] += np.add.reduceat(values, starts, axis=0)


def sums(index: np.ndarray, values: np.ndarray, length: int) -> np.ndarray:
    """Sum of the rows of ``values`` by index, also where there are none."""
    out = np.zeros((length, values.shape[1]), dtype=np.float32)
    add_at(out, index, values)
    return out


def mixtures(document: np.ndarray, odds: np.ndarray, weight: np.ndarray, n: int, background: float, rounds: int = 3) -> np.ndarray:
    """Each document's proportions of the background and the topics. odds: frequency of the word in the background (1) and in
    each topic against its language; background: words that each document has of it beforehand, beside a tenth of one of each topic."""
    mix = np.full((n, odds.shape[1]), 1.0 / odds.shape[1], dtype=np.float32)
    prior = np.full(odds.shape[1], 0.1, dtype=np.float32)
    prior[0] = background
    for _ in range(rounds):
        mix = mix * sums(document, odds * (weight / np.einsum("ij,ij->i", mix[document], odds))[:, None], n) + prior
        mix /= mix.sum(1, keepdims=True)
    return mix


def varimax(directions: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The orthonormal columns turned within their space so that each is far from zero for few rows, and there above it."""
    turn, before = np.eye(directions.shape[1]), 0.0
    for _ in range(rounds):
        at = directions @ turn
        square = at * at
        left, size, right = np.linalg.svd(directions.T @ (at * square - at * square.mean(0)))
        turn = left @ right
        if size.sum() < before * (1 + 1e-5):
            break
        before = size.sum()
    at = directions @ turn
    return at * np.where((at**3).sum(0) < 0, -1.0, 1.0)


def discover(count: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and the counts of each in each topic, that the topics of a language start from. count: of each word in all
    documents; directions: a row for each word, at most TOPICS orthonormal columns. A direction's other end is a topic too if it
    is at least half as far (two topics that exclude each other are the ends of one direction)."""
    if not len(count) or not directions.shape[1]:
        return np.zeros(0, dtype=np.int64), np.zeros((0, TOPICS))
    at = varimax(directions)
    ends = np.column_stack([at, -at[:, -at.min(0) >= at.max(0) / 2]])
    at = ends[:, np.argsort(-(np.maximum(ends, 0) ** 4).sum(0), kind="stable")[:TOPICS]]
    topic = at.argmax(1)
    rows = np.flatnonzero(at.max(1) > np.minimum(STANDS_OUT / np.sqrt(len(at)), at.max(0) / 2)[topic])
    counts = np.zeros((len(rows), TOPICS))
    counts[np.arange(len(rows)), topic[rows]] = count[rows]
    return rows, counts


def _bag_rows(lookup):
    """Each document's distinct words, at most a vocabulary, with counts; rows of documents of one group, that of most of their words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, find = lookup.value
        groups, width = int(of.max()) + 1, len(of)
        held: dict[int, list] = defaultdict(list)
        size: Counter = Counter()

        def row(g: int) -> tuple:
            parts = [np.concatenate(x) for x in zip(*held.pop(g))]
            size.pop(g)
            return (g, len(parts[0]), *(p.astype(kind).tobytes() for p, kind in zip(parts, (np.int64, np.int32, np.int32, np.int32))))

        for batch in batches:
            out = []
            for masks, words, tokens, lengths, units in batch.itertuples(index=False, name=None):
                masks = np.frombuffer(masks, np.int64)
                places, unit, document, _ = _opened(words, tokens, lengths, units, find)
                code, n = np.unique(document[unit] * width + places, return_counts=True)
                document, places = code // width, code % width
                share = np.bincount(document * groups + of[places], weights=n, minlength=len(masks) * groups).reshape(-1, groups)
                group, distinct = share.argmax(1), np.bincount(document, minlength=len(masks))
                for g in np.unique(group[distinct > 0]).tolist():
                    own = (group == g) & (distinct > 0)
                    at = own[document]
                    ends = np.cumsum(distinct[own])
                    # Rows of about BAG_WORDS words: documents are put together or parted.
                    part = np.maximum(np.arange(len(ends)) // BAGS, (ends - 1) // BAG_WORDS)
                    cuts = np.flatnonzero(np.diff(part, prepend=-1))
                    for a, b in zip(cuts, [*cuts[1:], len(ends)]):
                        x, y = ends[a] - distinct[own][a], ends[b - 1]
                        held[g].append((masks[own][a:b], distinct[own][a:b], places[at][x:y], n[at][x:y]))
                        size[g] += int(y - x)
                        if size[g] >= BAG_WORDS or sum(len(m) for m, *_ in held[g]) >= BAGS:
                            out.append(row(g))
            yield pd.DataFrame(out, columns=BAG_COLUMNS)
        yield pd.DataFrame([row(g) for g in list(held)], columns=BAG_COLUMNS)

    return run


BAG_COLUMNS = ["group", "n", "masks", "distinct", "places", "counts"]
BAG_SCHEMA = "group int, n int, masks binary, distinct binary, places binary, counts binary"


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of bags: group, number of documents, their masks, and distinct words: document, place, count."""
    for batch in batches:
        for g, n, masks, distinct, places, counts in batch.itertuples(index=False, name=None):
            document = np.repeat(np.arange(n), np.frombuffer(distinct, np.int32))
            yield g, n, np.frombuffer(masks, np.int64), document, np.frombuffer(places, np.int32), np.frombuffer(counts, np.int32).astype(np.float32)


def _own_words(batches: Iterator[pd.DataFrame], group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of bags, only words of the documents' own language: number of documents, document, place, count."""
    for g, n, _, document, places, counts in _bags(batches):
        same = group[places] == g
        yield n, document[same], places[same], counts[same]


def _odds(ratio: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(ratio), 1), dtype=np.float32), ratio], 1)


def _blocks(group: np.ndarray) -> np.ndarray:
    """A block for each word, of at most BLOCK words of one group that stand one after another."""
    starts = np.searchsorted(group, np.arange(int(group.max()) + 1 if len(group) else 0))
    return (group.astype(np.int64) << 32) + (np.arange(len(group)) - starts[group]) // BLOCK


SUM_SCHEMA = "block long, places binary, sums binary"


def _sum_rows(counts: np.ndarray, block: np.ndarray) -> pd.DataFrame:
    """The words with counts, in rows by block."""
    some = np.flatnonzero(counts.any(1))
    cuts = np.flatnonzero(np.diff(block[some], prepend=-1))
    return pd.DataFrame([(int(block[some[a]]), some[a:b].astype(np.int32).tobytes(), counts[some[a:b]].astype(np.float32).tobytes()) for a, b in zip(cuts, [*cuts[1:], len(some)])], columns=["block", "places", "sums"])


def _added(block: np.ndarray, k: int):
    """Rows by block of ``_sum_rows`` added up; all of a block are in one partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = {}
        for batch in batches:
            for b, places, values in batch.itertuples(index=False, name=None):
                first = int(np.searchsorted(block.value, b))
                if b not in out:
                    out[b] = np.zeros((int(np.searchsorted(block.value, b, "right")) - first, k))
                out[b][np.frombuffer(places, np.int32) - first] += np.frombuffer(values, np.float32).reshape(-1, k)
        rows = []
        for b, values in out.items():
            some = np.flatnonzero(values.any(1))
            rows.append((b, (some + np.searchsorted(block.value, b)).astype(np.int32).tobytes(), values[some].astype(np.float32).tobytes()))
        yield pd.DataFrame(rows, columns=["block", "places", "sums"])

    return run


def _added_up(rows: DataFrame, block, k: int) -> DataFrame:
    return rows.repartition("block").mapInPandas(_added(block, k), SUM_SCHEMA)


def _together(known, block):
    """The matrix of words that stand together, times the directions: sums over all documents. A word weighs its share of the
    document against the root of its count everywhere. The last column is each word's product with itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, count, _, directions = known.value
        root = np.sqrt(count).astype(np.float32)[:, None]
        scaled, out, column = directions / root, np.zeros((len(group), directions.shape[1] + 1)), np.zeros(len(group), dtype=np.int64)
        for number, document, places, n in _own_words(batches, group):
            # A row has about BAG_WORDS counts, so a matrix of its documents and words is small.
            some = np.flatnonzero(np.bincount(places))
            column[some] = np.arange(len(some))
            texts = np.zeros((number, len(some)), dtype=np.float32)
            texts[document, column[places]] = n
            length = np.maximum(np.float32(1.0), texts.sum(1, keepdims=True))
            out[some, :-1] += texts.T @ (texts @ scaled[some] / length)
            out[some, -1] += (texts * texts / length).sum(0)
        out[:, :-1] /= root
        out[:, -1] /= count
        yield _sum_rows(out, block.value)

    return run


def _image(rows: pd.DataFrame, known) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of one language: group, places, directions, and the matrix of words that stand together times the directions."""
    group, count, _, directions = known.value
    g = int(rows["block"].iloc[0]) >> 32
    own = np.flatnonzero(group == g)
    at, image = directions[own].astype(float), np.zeros((len(own), directions.shape[1] + 1))
    for places, values in zip(rows["places"], rows["sums"]):
        image[np.frombuffer(places, np.int32) - own[0]] = np.frombuffer(values, np.float32).reshape(-1, image.shape[1])
    image = image[:, :-1] - image[:, -1:] * at
    shared = np.sqrt(count[own] / max(1.0, count[own].sum()))
    return g, own, at, image - np.outer(shared, shared @ image)


def _turned(known):
    """The next directions of a language: orthonormal columns of the image."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g, _, _, image = _image(rows, known)
        found = np.linalg.qr(image)[0]
        return pd.DataFrame({"group": [g], "width": [found.shape[1]], "directions": [found.astype(np.float32).tobytes()]})

    return run


def _started(known):
    """Places and counts in the topics that a language starts from, by its principal directions."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _, count, number, _ = known.value
        g, own, at, image = _image(rows, known)
        used = min(at.shape[1], len(own))
        size, turn = np.linalg.eigh(at[:, :used].T @ image[:, :used])
        best = np.argsort(-size)[:TOPICS]
        chance = (len(own) + 2 * np.sqrt(number[g] * len(own))) / max(1.0, count[own].sum())
        found = at[:, :used] @ turn[:, best[size[best] > chance]]
        if found.shape[1] < TOPICS:
            # Few topics share out all documents, so that one of them may only show as what the others leave of the language.
            found = np.column_stack([np.sqrt(count[own] / max(1.0, count[own].sum())), found])
        places, counts = discover(count[own], found)
        row, topic = np.nonzero(counts)
        return pd.DataFrame({"place": own[places[row]], "topic": topic.astype(np.int32), "n": counts[row, topic]})

    return run


def _round(model, block, background: float, own: bool):
    """Sums of a round over all documents: for each word its count in each topic. own: topics of a language have words of it only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        odds, topical = _odds(m.ratio), m.ratio.max(1) > 1
        # A word's share of a topic is its odds times the document's proportion, so the odds are put in at the end.
        counts = np.zeros((len(m.words), m.ratio.shape[1] + 1))
        for number, document, places, n in _own_words(batches, m.group) if own else ((x[1], *x[3:]) for x in _bags(batches)):
            chosen = topical[places]
            mix = mixtures(document[chosen], odds[places[chosen]], n[chosen], number, background)
            of_words = mix[document]
            of_words *= (n / np.einsum("ij,ij->i", of_words, odds[places]))[:, None]
            add_at(counts, places, of_words)
        yield _sum_rows(counts[:, 1:] * m.ratio, block.value)

    return run


def _evidence(group: np.ndarray, k: int, block):
    """Each word's count, and in how many labelled documents of each subject it is, of the documents of its language; a document with
    several labels counts in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, counts = group.value, np.zeros((len(group.value), k + 1))
        for g, _, masks, document, places, n in _bags(batches):
            add_at(counts[:, :1], places, n[:, None])
            there = (masks[document] > 0) & (of[places] == g)
            if there.any():
                share = ((masks[:, None] >> np.arange(k)) & 1).astype(float)
                share /= np.maximum(1.0, share.sum(1, keepdims=True))
                add_at(counts[:, 1:], places[there], share[document[there]])
        yield _sum_rows(counts, block.value)

    return run


def proportions(places: np.ndarray, unit: np.ndarray, document: np.ndarray, units: np.ndarray, ratio: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Topic proportions of documents (background first). A unit has one topic: units and the proportions of their document
    are fitted to each other, then each unit takes its likeliest topic and the proportions are the shares of the units."""
    n = len(units)
    score = sums(unit, np.log(0.5 * _odds(ratio[places]) + 0.5), len(document))
    spoken = np.exp(score - score.max(1, keepdims=True)) if len(score) else score
    # Before its words are seen, half of a document is background, so that a unit without topical words needs a document of its subject.
    mix = np.full((n, ratio.shape[1] + 1), 0.5 / ratio.shape[1], dtype=np.float32)
    mix[:, 0] = 0.5
    part = spoken
    for _ in range(rounds):
        part = mix[document] * spoken
        part /= part.sum(1, keepdims=True)
        mix = sums(document, part, n) + np.float32(0.3)
        mix /= mix.sum(1, keepdims=True)
    best = part.argmax(1) if len(part) else np.zeros(0, dtype=np.int64)
    shares = np.stack([np.bincount(document, weights=best == j, minlength=n) for j in range(part.shape[1])], 1)
    return shares / np.maximum(1, units)[:, None]


def _assign(model, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, ratio = model.value
        for batch in batches:
            for docs, *packed in batch.itertuples(index=False, name=None):
                shares = proportions(*_opened(*packed, find), ratio)[:, 1:]
                where, which = np.nonzero(shares >= least)
                yield pd.DataFrame({"doc_id": pd.Series(docs)[where].to_numpy(), "topic": which, "share": shares[where, which].astype(float)})

    return run


def _vocabulary(per_lang: DataFrame) -> pd.DataFrame:
    """``word, own``: the VOCABULARY words in most documents of each language and script. The language of a word is the one in
    which it is in the greatest share of documents. How often a word must occur is read off counts of words by frequency, so
    no language's words are sorted."""
    top = per_lang.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    totals = {r[0]: r[1] for r in per_lang.groupBy("lang").agg(F.sum("n").alias("total")).withColumn("all", F.sum("total").over(_everything())).where(F.col("total") >= LEAST_LANGUAGE * F.col("all")).select("lang", "total").collect() if r[0]}
    share = reduce(lambda at, x: F.when(F.col("lang") == x[0], F.col("n") / float(x[1])).otherwise(at), sorted(totals.items()), F.lit(None).cast("double"))
    own = per_lang.withColumn("share", share).where("share IS NOT NULL").groupBy("word").agg(F.max(F.struct("share", "lang")).alias("m")).select("word", F.col("m.lang").alias("own"))
    latin = F.col("word").bitwiseAND(F.lit(1))
    named = written(top.join(own, "word", "left").select("word", F.concat(F.coalesce("own", F.lit("")), F.when(latin == 1, " latin").otherwise(" other")).alias("own"), "n"), "vocabulary")
    often = F.floor(F.log2("n") * 32).alias("often")
    cuts, kept = {}, Counter()
    for own_name, level, words in sorted(named.groupBy("own", often).agg(F.count("*").alias("words")).collect(), key=lambda r: (r[0], -r[1])):
        kept[own_name] += words
        if kept[own_name] <= VOCABULARY or own_name not in cuts:
            cuts[own_name] = level
    least = reduce(lambda at, x: F.when(F.col("own") == x[0], F.lit(x[1])).otherwise(at), sorted(cuts.items()), F.lit(0))
    out = named.where(often >= least).select("word", "own").toPandas().sort_values(["own", "word"], ignore_index=True)
    discard(named)
    return out


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()


def map_topics(topics: np.ndarray, evidence: np.ndarray, model: Model, described: np.ndarray) -> list[tuple[int, int, int, float, list[tuple[int, bool]]]]:
    """``group, topic, subject (-1 for none), share of the evidence, top terms`` for each topic. A term is its place and whether
    it speaks for the subject itself; one that doesn't (a phrase that came along) says nothing of the subject.

    evidence: labelled documents by word and subject; described: whether a subject's description has the word. A subject's
    evidence in a word is its share of the word's labelled documents, each subject weighted as if all had equally many."""
    out = []
    groups = int(model.group.max()) + 1 if len(model.group) else 0
    counts = evidence + DESCRIBED * described
    for g in range(groups):
        own = np.flatnonzero(model.group == g)
        labelled = counts[own].sum(0)
        if not labelled.sum():
            continue
        # Words of rarely labelled subjects weigh as much as of others, with one document's smoothing.
        weight = labelled.sum() / len(labelled) / (labelled + labelled.sum() / len(labelled) * 0.1)
        weighted = counts[own] * weight
        for t in range(topics.shape[1]):
            ratio, n = model.ratio[own, t], topics[own, t]
            strength = n * np.log(np.maximum(ratio, 1.0))
            terms = np.argsort(-strength)[:TOP_TERMS]
            terms = terms[strength[terms] > 0]
            if not len(terms):
                continue
            held = weighted[terms] / (weighted[terms].sum(1, keepdims=True) + THIN)
            share = held.mean(0)
            best, least = int(share.argmax()), LEAST_EVIDENCE + (1 - LEAST_EVIDENCE) / len(share)
            speaks = (held.argmax(1) == best) & (held[:, best] >= least)
            out.append((g, t, best if share[best] >= least and speaks.sum() >= LEAST_TERMS else -1, float(share[best]), list(zip(own[terms].tolist(), speaks.tolist()))))
    return out


class Fitted:
    """The documents in numbers (written), the subjects' topics, the subjects, and the mapping of the topics found."""

    def __init__(self, numbered: DataFrame, model: Model, names: list[str], mapping: list, groups: list[str]):
        self.numbered, self.model, self.names, self.mapping, self.groups = numbered, model, names, mapping, groups


def _fitted(bags: DataFrame, step, known, block, width: int, k: int) -> np.ndarray:
    """Sums of a step over all documents by place, at most a vocabulary for each language, as an array. What is ``known`` is sent
    for the step and deleted after it, as each executor keeps a copy on its disk."""
    sent, out = bags.sparkSession.sparkContext.broadcast(known), np.zeros((width, k))
    for places, values in _added_up(bags.mapInPandas(step(sent), SUM_SCHEMA), block, k).select("places", "sums").collect():
        out[np.frombuffer(places, np.int32)] = np.frombuffer(values, np.float32).reshape(-1, k)
    sent.destroy()
    return out


def starting_topics(bags: DataFrame, group: np.ndarray, count: np.ndarray, words: np.ndarray, block) -> np.ndarray:
    """Counts of each word in the topics that its language starts from: up to TOPICS directions in which words stand together
    most, by subspace iteration from a seeded start. The direction that all documents share, the language itself, is taken out,
    and so is each word's product with itself, which says nothing of other words. Words drawn by chance alone would have sizes
    of up to (w + 2 root(d w)) / n for d documents, w words and n words in all documents; only directions above that count."""
    spark = bags.sparkSession
    number = np.zeros(int(group.max()) + 1)
    for g, n in bags.groupBy("group").agg(F.sum("n")).collect():
        number[g] = n
    directions = np.random.default_rng(10).standard_normal((len(group), DIRECTIONS), dtype=np.float32)[np.argsort(np.argsort(words))]
    for i in range(PASSES):
        known = spark.sparkContext.broadcast((group, np.maximum(1.0, count), number, directions))
        images = _added_up(bags.mapInPandas(_together(known, block), SUM_SCHEMA), block, DIRECTIONS + 1).groupBy(F.shiftright("block", 32))
        if i == PASSES - 1:
            break
        directions = np.zeros_like(directions)
        for g, width, packed in images.applyInPandas(_turned(known), "group int, width int, directions binary").collect():
            directions[group == g, :width] = np.frombuffer(packed, np.float32).reshape(-1, width)
        known.destroy()
    topics = np.zeros((len(group), TOPICS))
    first = images.applyInPandas(_started(known), "place long, topic int, n double").toPandas()
    known.destroy()
    topics[first["place"].to_numpy(dtype=np.int64), first["topic"].to_numpy(dtype=np.int64)] = first["n"].to_numpy(dtype=float)
    return topics


def fit(documents: DataFrame, subjects: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Fitted:
    """Finds topics, maps them to the subjects and fits the subjects' topics to all documents."""
    spark = documents.sparkSession
    about = bounded_rows(subjects.where("subject is not null").groupBy("subject").agg(F.max("about" if "about" in subjects.columns else F.lit("")).alias("about")), MOST_SUBJECTS, "subjects")
    about = sorted((r[0], r[1] or "") for r in about)
    names = [n for n, _ in about]
    k = len(names)
    bit = reduce(lambda at, i: F.when(F.col("subject") == names[i], F.lit(1 << i)).otherwise(at), range(k), F.lit(0)).cast("long")
    masks = labels.where(F.col("subject").isin(names)).groupBy(F.col(id_column).alias("labelled")).agg(F.bit_or(bit).alias("mask"))
    masks = written(masks, "labels")
    if masks.count() <= MOST_BROADCAST:
        masks = F.broadcast(masks)
    rows = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc_id"), F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang") if "lang" in documents.columns else F.lit("").alias("lang"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.join(masks, F.col("doc_id") == F.col("labelled"), "left").select("doc_id", "lang", F.coalesce("mask", F.lit(0)).alias("mask"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbered = written(rows.mapInPandas(_number, f"kind int, docs array<{kind}>, masks binary, lang string, words binary, tokens binary, lengths binary, units binary"), "numbered")
    per_lang = numbered.where("kind = 1").select("lang", "words", "tokens").mapInPandas(_unpack, "lang string, word int, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    per_lang = written(per_lang, "word_documents")
    vocabulary = _vocabulary(per_lang)
    discard(per_lang)
    numbered_docs = numbered.where("kind = 0")
    words = vocabulary["word"].to_numpy(dtype=np.int32)
    group, groups = pd.factorize(vocabulary["own"], sort=True)
    group = group.astype(np.int32)
    empty = Model(words, group, np.zeros(len(words)), np.ones((len(words), k), dtype=np.float32))
    if not k or not len(words):
        return Fitted(numbered_docs, empty, names, [], list(groups))
    places = Lookup(words, np.arange(len(words)))
    block = spark.sparkContext.broadcast(_blocks(group))

    # Documents of a language lie together, so that a task's sums have few languages' words.
    sent = spark.sparkContext.broadcast((group, places))
    sliced = written(numbered_docs.select("masks", "words", "tokens", "lengths", "units").mapInPandas(_bag_rows(sent), BAG_SCHEMA), "bags_by_slice")
    sent.destroy()
    bags = written(sliced.repartitionByRange("group", F.xxhash64("places")).sortWithinPartitions("group"), "bags")
    discard(sliced)
    found = _fitted(bags, lambda sent: _evidence(sent, k, block), group, block, len(words), k + 1)
    count, evidence = found[:, 0], found[:, 1:]
    base = np.maximum(count, 0.5) / np.maximum(1.0, np.bincount(group, weights=count))[group]
    model = Model(words, group, base, np.ones((len(words), TOPICS), dtype=np.float32))

    # Topics without labels, from all documents.
    model = model.update(starting_topics(bags, group, count, words, block))
    for _ in range(TOPIC_ROUNDS):
        topics = _fitted(bags, lambda sent: _round(sent, block, 0.1, True), model, block, len(words), TOPICS)
        model = model.update(topics)

    # Topics to subjects by their top terms.
    numbers, described = WordNumbers(), np.zeros((len(words), k))
    for j, (name, text) in enumerate(about):
        for w in WORD.findall(f"{name} {text}".lower()):
            at = int(places(np.array([numbers[w]], dtype=np.int32))[0])
            if at >= 0:
                described[at, j] = 1
    mapping = map_topics(topics, evidence, model, described)
    counts, speaking = np.zeros((len(words), k)), np.zeros((len(words), k), dtype=bool)
    for g, t, subject, _, terms in mapping:
        if subject >= 0:
            own = group == g
            counts[own, subject] += topics[own, t]
            speaking[[place for place, speaks in terms if speaks], subject] = True
    model = model.update(counts)
    model.ratio[~speaking] = 1.0
    for _ in range(ROUNDS):
        model = model.update(_fitted(bags, lambda sent: _round(sent, block, 2.0, False), model, block, len(words), k))
    discard(bags)
    block.destroy()
    return Fitted(numbered_docs, model, names, mapping, list(groups))


def document_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame, least: float = 0.25, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, subject, share``: the subjects of at least ``least`` of a document's sentences and lines.

    Labels name the topics; which subjects a document gets follows from its text alone. Documents with no text or about none
    of the subjects have no row. Labels with another subject, and a null language, don't count. Without any usable label only
    the subjects' descriptions name topics. Rows without id are no documents.
    """
    spark = documents.sparkSession
    fitted = fit(documents, subjects, labels, id_column, text_column)
    kind = fitted.numbered.schema["docs"].dataType.elementType.simpleString()
    if not fitted.names or not len(fitted.model.words):
        return spark.createDataFrame([], f"doc_id {kind}, subject string, share double")
    # Words that speak for no topic say nothing of a unit.
    model, spoken = fitted.model, np.flatnonzero(fitted.model.ratio.max(1) > 1)
    known = spark.sparkContext.broadcast((Lookup(model.words[spoken], np.arange(len(spoken))), model.ratio[spoken]))
    found = fitted.numbered.select("docs", "words", "tokens", "lengths", "units").mapInPandas(_assign(known, least), f"doc_id {kind}, topic int, share double")
    return found.select("doc_id", F.element_at(F.array(*map(F.lit, fitted.names)), F.col("topic") + 1).alias("subject"), "share")


def inspected(documents: DataFrame, fitted: Fitted, text_column: str = "text") -> DataFrame:
    """``language, topic, term, place, speaks, evidence, subject``: the top terms of each topic found, whether a term speaks for the
    topic's best subject by itself, how much of all terms' evidence does, and the subject it was mapped to (null for none). Reads the texts for the terms' letters."""
    spark = documents.sparkSession
    wanted = {}
    for g, t, subject, share, terms in fitted.mapping:
        for i, (place, speaks) in enumerate(terms):
            wanted.setdefault(int(fitted.model.words[place]), []).append((fitted.groups[g], t, i + 1, speaks, share, fitted.names[subject] if subject >= 0 else None))
    sent = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, seen = WordNumbers(), set()
        for batch in batches:
            words = {w for t in batch.iloc[:, 0] for w in WORD.findall(split_names(t).lower())} - seen
            hits = [w for w in words if numbers[w] in sent.value]
            seen.update(hits)
            yield pd.DataFrame([(*x, w) for w in hits for x in sent.value[numbers[w]]], columns=["language", "topic", "place", "speaks", "evidence", "subject", "term"])

    rows = documents.where(F.col(text_column).isNotNull()).select(text_column)
    return rows.mapInPandas(run, "language string, topic int, place int, speaks boolean, evidence double, subject string, term string").distinct()
