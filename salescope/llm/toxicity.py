"""Toxicity of texts, with words that are written in disguise read as what they are.

Noisy channel: a token that may hide a word (digits or symbols among its letters, letters
repeated, letters set apart by spaces) is a lattice. Each character may stand for a
letter, repeat the one before, or be filler; a character model of the corpus says how likely
the letters are in a row. Viterbi passes from both ends give the best score through each state
(the last two letters), and every weighted word that is in a reading close to the best one is
found in the lattice; no reading is listed, and none is left out for their number.

The character model counts trigrams over all documents. Words and their beginnings get
weights from a bounded, balanced sample of labelled documents, without near copies; a
logistic curve over a document's strongest and summed weights is fitted on another part
of that sample. Only the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.decontaminate import Lookup
from salescope.llm.words import (
    BY_LETTERS,
    BY_SPACE,
    SPACE_BYTES,
    gram_hash,
    pieces,
    prefix_hash,
    span_hash,
    text_buffers,
    word_spans,
)
from salescope.llm.workers import map_batches
from salescope.sources.shared import land

# Which characters are written for which letters.
STANDS_FOR = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
}
HELD_OUT_OF = 5

#: Labelled documents of each label that the classifier is fitted on, at most.
SAMPLE = 6_000
#: Words and beginnings with a weight, at most, and the documents that one must be in.
FEATURES, LEAST_DOCUMENTS = 50_000, 6
LEAST_WEIGHT = 2.0
#: Lengths in bytes of the beginnings of words that count as features.
BEGINNINGS = (4, 5, 6, 7)
#: How much less likely than the best one a reading may be.
WITHIN = 6.0
#: Longer tokens are read anew each time, so that what is remembered is bounded.
REMEMBERED = 64
#: Log probabilities of the channel: a letter as it is, replaced or repeated, filler, and
#: a character that could stand for a letter and is filler all the same.
AS_IS, REPLACED, REPEATED, FILLER, ODD_FILLER = 0.0, -0.5, -0.7, -0.7, -6.0
SYMBOLS = 64

_TAG = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_REPLACES = np.zeros(256, bool)
_REPLACES[[ord(c) for c in STANDS_FOR if ord(c) < 128]] = True
_WIDE = [c.encode() for c in STANDS_FOR if ord(c) >= 128]
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] += 0x20
#: Byte to symbol of the character model: 0 parts words, then letters, then all else.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[0x41:0x5B] = _SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x80:] = 27 + (np.arange(0x80, 0x100) & 31)


def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of symbol trigrams, lead bytes of wider characters left out."""
    for batch in batches:
        data, _ = text_buffers(batch.column("text"))
        counts = np.zeros(SYMBOLS**3, np.int64)
        for start in range(0, len(data), 1 << 20):
            part = data[max(0, start - 4) : start + (1 << 20)]
            symbols = _SYMBOL[part[part < 0xC0]]
            codes = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
            counts += np.bincount(codes, minlength=SYMBOLS**3)
        found = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(found), pa.array(counts[found])], names=["code", "n"])


def _features(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions of words that have them, with their features: the word and beginnings."""
    out = [(np.arange(len(starts)), span_hash(total, starts, ends))]
    for length in BEGINNINGS:
        long = np.flatnonzero(ends - starts > length)
        out.append((long, span_hash(total, starts[long], starts[long] + length) ^ _TAG))
    return out


def _near_copy_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least shingle of each text, which near copies mostly share."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        keys = []
        for low, high in pieces(offsets):
            own, bounds = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            starts, ends, first = word_spans(own, bounds, BY_LETTERS)
            words = span_hash(prefix_hash(own), starts, ends)
            for k in range(high - low):
                mine = words[first[k] : first[k + 1]]
                grams = gram_hash(mine, min(5, len(mine))) if len(mine) else np.zeros(1, np.uint64)
                keys.append(int(grams.min() >> np.uint64(1)))
        yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(keys, pa.int64())], names=["doc_id", "toxic", "key"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a feature."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        labels = np.array(batch.column("toxic").to_pylist(), np.int64)
        found: tuple[list, list] = [], []
        for low, high in pieces(offsets):
            own, bounds = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            starts, ends, first = word_spans(own, bounds, BY_LETTERS)
            of = np.searchsorted(first, np.arange(len(starts)), "right") - 1
            for place, feature in _features(prefix_hash(own), starts, ends):
                pairs = np.unique(np.stack([of[place].astype(np.uint64), feature]), axis=1)
                label = labels[low + pairs[0].astype(np.int64)]
                for k in (0, 1):
                    found[k].append(pairs[1][label == k])
        for k in (0, 1):
            values, counts = np.unique(np.concatenate(found[k]) if found[k] else np.empty(0, np.uint64), return_counts=True)
            yield pa.record_batch(
                [pa.array(values.view(np.int64)), pa.array(np.full(len(values), k)), pa.array(counts)],
                names=["feature", "toxic", "n"],
            )


def _spelled(shared):
    """Spellings of the features with a weight: their places among the keys, bytes, if they are beginnings."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            found: dict[int, tuple[bytes, bool]] = {}
            for low, high in pieces(offsets):
                own, bounds = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                starts, ends, _ = word_spans(own, bounds, BY_LETTERS)
                features = _features(prefix_hash(own), starts, ends)
                for length, (place, feature) in zip((0, *BEGINNINGS), features, strict=True):
                    hit, key = look(feature)
                    keys, at = np.unique(key, return_index=True)
                    for k, word in zip(keys.tolist(), place[hit[at]].tolist(), strict=True):
                        end = starts[word] + length if length else ends[word]
                        found[k] = own[starts[word] : end].tobytes().lower(), length > 0
            yield pa.record_batch(
                [
                    pa.array(list(found), pa.int64()),
                    pa.array([f[0] for f in found.values()], pa.binary()),
                    pa.array([f[1] for f in found.values()], pa.bool_()),
                ],
                names=["key", "spelling", "begins"],
            )

    return spell


@dataclass
class Model:
    """Log probabilities of trigrams, features with weights, and the curve of the score."""

    chars: np.ndarray
    look: Lookup
    weights: np.ndarray
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    #: Every prefix of a feature's spelling, with its weights as a word and as a beginning.
    spelled: dict[bytes, tuple[float, float]] = field(default_factory=dict)

    @cached_property
    def table(self) -> list:
        return self.chars.tolist()

    def spell(self, rows: list) -> None:
        """Takes in the spellings (key, spelling, begins) of the features."""
        for row in rows:
            spelling = bytes(row.spelling)
            for end in range(len(spelling)):
                self.spelled.setdefault(spelling[:end], (0.0, 0.0))
            word, begins = self.spelled.get(spelling, (0.0, 0.0))
            weight = float(self.weights[row.key])
            self.spelled[spelling] = (word, max(begins, weight)) if row.begins else (max(word, weight), begins)

    def weigh(self, total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The strongest weight among each word's features, 0 where it has none."""
        best = np.zeros(len(starts))
        for place, feature in _features(total, starts, ends):
            hit, key = self.look(feature)
            np.maximum.at(best, place[hit], self.weights[key])
        return best

    def reaches(self, steps: list, joined: bool) -> bool:
        """If the letters of some path through the lattice, however unlikely, spell a feature."""
        nodes = {b""}
        for options in steps:
            step = {b""} if joined else set()
            for letter, _, _ in options:
                step.update(grown for node in nodes if (grown := node + letter) in self.spelled)
            if any(any(self.spelled[node]) for node in step - nodes):
                return True
            nodes = step
            if not nodes:
                return False
        return False

    def passes(self, steps: list) -> tuple[list[dict], list[dict]]:
        """Best scores of each state (the last two letters) from the start and to the end."""
        chars, ahead = self.table, [{(0, 0): 0.0}]
        for options in steps:
            step: dict[tuple, float] = {}
            for (a, b), score in ahead[-1].items():
                for letter, c, cost in options:
                    state = (b, c) if letter else (a, b)
                    new = score + cost + (chars[a][b][c] if letter else 0.0)
                    if new > step.get(state, -np.inf):
                        step[state] = new
            ahead.append(step)
        # No letter at all is no reading.
        behind = [{(a, b): chars[a][b][0] if b else -np.inf for a, b in ahead[-1]}]
        for options, states in zip(reversed(steps), reversed(ahead[:-1]), strict=True):
            rest = behind[-1]
            behind.append(
                {
                    (a, b): max(cost + (chars[a][b][c] + rest[b, c] if letter else rest[a, b]) for letter, c, cost in options)
                    for a, b in states
                }
            )
        return ahead, behind[::-1]

    def hidden(self, token: str, joined: bool) -> float:
        """The strongest weight in any reading close to the best; anywhere in it if letters were joined."""
        steps = lattice(token)
        if not self.reaches(steps, joined):
            return 0.0
        chars, spelled = self.table, self.spelled
        ahead, behind = self.passes(steps)
        least, found = behind[0][0, 0] - WITHIN, 0.0
        front = {(b"", 0, 0): 0.0}
        for place, options in enumerate(steps):
            if joined:
                front.update({(b"", *state): score for state, score in ahead[place].items()})
            step: dict[tuple, float] = {}
            for (node, a, b), score in front.items():
                for letter, c, cost in options:
                    state = (b, c) if letter else (a, b)
                    new = score + cost + (chars[a][b][c] if letter else 0.0)
                    if new + behind[place + 1][state] < least:
                        continue
                    if letter:  # a beginning has something after it
                        found = max(found, *(spelled.get(node + letter[:k], (0.0, 0.0))[1] for k in range(len(letter))), 0.0)
                    key = (node + letter, *state)
                    if key[0] in spelled and new > step.get(key, -np.inf):
                        step[key] = new
            front = step
            if joined or place == len(steps) - 1:
                found = max([found, *(spelled[node][0] for node, _, _ in front if not joined or len(node) > 2)])
            elif not front:
                break
        return found

    def evidence(self, data: np.ndarray, offsets: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray]:
        """Strongest and summed weights of each text."""
        starts, ends, first = word_spans(data, offsets, BY_LETTERS)
        weight = self.weigh(prefix_hash(data), starts, ends)
        of = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        count = len(offsets) - 1
        most, total = np.zeros(count), np.bincount(of, weight, count)
        np.maximum.at(most, of, weight)
        # What a token's words weigh as they are counts once.
        summed = np.concatenate(([0.0], np.cumsum(weight)))
        for text, low, high, joined in disguised(data, offsets):
            token = data[low:high].tobytes()
            if joined:
                token = token.translate(None, bytes(SPACE_BYTES))
            found = known.get((token, joined))
            if found is None:
                found = self.hidden(token.decode(errors="replace"), joined)
                if len(token) <= REMEMBERED:
                    if len(known) > 200_000:
                        known.clear()
                    known[token, joined] = found
            if found:
                most[text] = max(most[text], found)
                plain = summed[np.searchsorted(starts, high)] - summed[np.searchsorted(starts, low)]
                total[text] += max(0.0, found - plain)
        return most, total

    def score(self, most: np.ndarray, total: np.ndarray) -> np.ndarray:
        bias, by_most, by_total = self.curve
        return 1 / (1 + np.exp(-(bias + by_most * most + by_total * np.log1p(total))))


def lattice(token: str) -> list[list[tuple[bytes, int, float]]]:
    """What each character may stand for: letters (none for filler), their symbols, log probabilities."""
    steps, last = [], ""
    for char in token.lower():
        if char.isalpha():
            options = [(char, AS_IS)]
            if char == last:
                options.append(("", REPEATED))
        else:
            options = [(letter, REPLACED) for letter in STANDS_FOR.get(char, "")]
            options.append(("", ODD_FILLER if char in STANDS_FOR else FILLER))
            if char == last and char in STANDS_FOR:
                options.append(("", REPEATED))
        last = char
        steps.append(
            [
                (letter.encode(), (ord(letter) - 96 if "a" <= letter <= "z" else 27 + (ord(letter) & 31)) if letter else 0, cost)
                for letter, cost in options
            ]
        )
    return steps


def _signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that end a character that stands for a letter, and such that show a disguise."""
    replaces = _REPLACES[data]
    for wide in _WIDE:
        same = np.ones(max(0, len(data) - len(wide) + 1), bool)
        for k, byte in enumerate(wide):
            same &= data[k : k + len(same)] == byte
        replaces[len(wide) - 1 :] |= same
    letter = _LETTER[data]
    shows = replaces.copy()
    # A character within a word that is no letter: something follows it that is one.
    shows[:-1] |= ~letter[:-1] & letter[1:]
    # A character twice in a row, however many bytes it has.
    folded = _FOLDED[data]
    folded[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)).astype(np.uint8) * np.uint8(0x20)
    shows[1:] |= letter[1:] & (data[1:] < 0x80) & (folded[1:] == folded[:-1])
    for width in (2, 3, 4):
        equal = (folded[width:] == folded[:-width]) & (data[width:] >= 0x80)
        count = max(0, len(data) - 2 * width + 1)
        run = data[width : width + count] >= 0xC0
        for k in range(width):
            run &= equal[k : k + count]
        shows[2 * width - 1 :] |= run
    return replaces, shows


def disguised(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """Tokens that may hide a word: text, first byte and end; True for letters set apart by spaces.

    Such are tokens of any length that hold a character that stands for a letter, one
    twice in a row, or one that is no letter before one that is; and rows of single characters.
    """
    starts, ends, first = word_spans(data, offsets, BY_SPACE)
    if len(starts) == 0:
        return
    replaces, shows = _signs(data)
    shown = np.concatenate(([0], np.cumsum(shows)))
    # Characters that are or stand for letters, by their first byte or their only one.
    leads = (data & 0xC0) != 0x80
    characters = np.concatenate(([0], np.cumsum(leads)))
    could = np.concatenate(([0], np.cumsum((_LETTER[data] & leads) | _REPLACES[data])))
    hides = shown[ends] - shown[starts] > 0
    hides &= could[ends] - could[starts] >= 2
    of = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    for k in np.flatnonzero(hides).tolist():
        yield int(of[k]), int(starts[k]), int(ends[k]), False
    one = (characters[ends] - characters[starts] == 1) & (_LETTER[data[starts]] | replaces[ends - 1])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], one.view(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        for text in range(int(of[a]), int(of[b - 1]) + 1):
            low, high = max(a, int(first[text])), min(b, int(first[text + 1]))
            if high - low >= 3:
                yield text, int(starts[low]), int(ends[high - 1]), True


def _measured(shared, columns: list[str]):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            most, total = [np.empty(0)], [np.empty(0)]
            for low, high in pieces(offsets):
                found = model.evidence(
                    data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], known
                )
                most.append(found[0])
                total.append(found[1])
            most, total = np.concatenate(most), np.concatenate(total)
            yield pa.record_batch(
                [*[batch.column(c) for c in columns], pa.array(most), pa.array(total), pa.array(model.score(most, total))],
                names=[*columns, "strongest", "summed", "score"],
            )

    return measure


def held_out(doc_id: Column) -> Column:
    """Rows that the classifier never sees; NULL is one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == 0


def _fit_curve(rows: list) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton steps."""
    if not rows:
        return 0.0, 0.0, 0.0
    x = np.array([(1.0, r.strongest, np.log1p(r.summed)) for r in rows])
    y = np.array([float(r.toxic) for r in rows])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after two others, from all documents."""
    counts = map_batches(docs.select("text"), trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    table = np.full(SYMBOLS**3, 0.05)
    for row in counts.collect():  # 64 ** 3 rows at most, whatever the corpus
        table[row.code] += row.n
    table = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(table / table.sum(axis=2, keepdims=True)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic).

    At most ``sample`` documents of each label are used, those whose ids hash lowest, and
    none that is held out. A third of them fits the curve, the others give the weights. Without
    labels every score is 0.5.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    chosen = [known.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    ids = land(chosen[0].unionByName(chosen[1]), "toxicity_sample")
    texts = land(
        docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text"),
        "toxicity_texts",
    )
    keys = map_batches(texts, _near_copy_key, "doc_id long, toxic int, key long")
    single = keys.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    used = land(texts.join(F.broadcast(single), "doc_id"), "toxicity_single")
    # crc32 mod 5 is never 0 here, so other bits deal the sample out.
    deal = F.xxhash64("doc_id") % 3 == 0
    sizes = {r.toxic: r.n for r in used.where(~deal).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = map_batches(used.where(~deal).select("toxic", "text"), _counted, "feature long, toxic long, n long")
    pos, neg = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    weighted = (
        counts.groupBy("feature")
        .agg(pos.alias("pos"), neg.alias("neg"))
        .where(f"pos >= {LEAST_DOCUMENTS}")
        .selectExpr("feature", "pos", f"ln((pos + 0.5) / {toxic + 1}) - ln((neg + 0.5) / {clean + 1}) AS weight")
        .where(f"weight >= {LEAST_WEIGHT}")
        .orderBy(F.desc("weight"), "feature")
        .limit(FEATURES)
    )
    rows = weighted.collect()
    features = np.array([r.feature for r in rows], np.int64).view(np.uint64)
    weights = np.array([r.weight for r in rows], float)[np.argsort(features)]
    model = Model(character_model(docs), Lookup(features), weights)
    if rows:
        look = docs.sparkSession.sparkContext.broadcast(model.look)
        spellings = map_batches(used.where(~deal).select("text"), _spelled(look), "key long, spelling binary, begins boolean")
        model.spell(spellings.groupBy("key").agg(F.min("spelling").alias("spelling"), F.min("begins").alias("begins")).collect())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    measured = map_batches(
        used.where(deal).select("toxic", "text"), _measured(shared, ["toxic"]), "toxic int, strongest double, summed double, score double"
    )
    model.curve = _fit_curve(measured.collect())
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, strongest, summed, score.

    NULL and empty texts get the score of a text without any weighted word. Rows that repeat are
    scored alike. Other columns, whatever their names, are ignored. An empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(
        rows, _measured(shared, ["doc_id"]), "doc_id long, strongest double, summed double, score double"
    )
