import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark, documents, prose):
    """Documents of which a third say one of a few words; labels for all."""
    bad = ["gromble", "snarkus", "vilepto"]
    rows, labels = [], []
    for i in range(900):
        words = prose(40, i).split()
        toxic = i % 3 == 0
        if toxic:
            words[i % 40] = bad[i // 3 % 3]
            words[(i + 7) % 40] = bad[(i // 3 + 1) % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = documents(rows)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


@pytest.fixture(scope="module")
def model(corpus):
    return toxicity.train(*corpus[:2])


def test_held_out_documents_are_told_apart(corpus, model):
    docs, _, labels = corpus
    rows = toxicity.score_toxicity(docs, model).select("doc_id", "score", toxicity.held_out(F.col("doc_id"))).collect()
    wrong = [r for r in rows if (r.score >= 0.5) != labels[r.doc_id]]
    held = {r.doc_id for r in rows if r[2]}
    assert held == {i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len([r for r in wrong if r.doc_id in held]) <= 2


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("gr0mble gr0mble", True), ("sn4rku5 5n@rkus", True), ("v.i.l.e.p.t.o v-i-l-e-p-t-o", True),
        ("g r o m b l e g r o m b l e", True), ("groooomble snarrrrkus", True),
        ("10.2.3.4 a@b.example x1y2z3 a b c d", False), (None, False), ("", False),
    ],
)
def test_disguised_words_are_read(documents, prose, model, text, toxic):
    row = toxicity.score_toxicity(documents([f"{prose(20, 1)} {text or ''}" if text else text], extra=True), model).first()
    assert (row.score >= 0.5) == toxic and 0 <= row.score <= 1


def test_only_the_text_counts(documents, model, prose):
    text = prose(30, 2) + " gromble"
    rows = toxicity.score_toxicity(documents([(1, text, "en", "a"), (2, text, None, "b"), (1, text, "en", "a")]), model)
    assert len({r.score for r in rows.collect()}) == 1 and rows.count() == 3


def test_long_rows_of_letters_are_read_to_the_end(documents, model):
    text = " ".join("abcdefgh" * 40 + "snarkus" + "snarkus" + "abcdefgh" * 3)
    assert toxicity.score_toxicity(documents([text]), model).first().strongest > 0


def test_without_labels_and_empty_table(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(documents(["a b c", None]), none)
    assert [r.score for r in toxicity.score_toxicity(documents(["a", None]), model).collect()] == [0.5, 0.5]
    assert toxicity.score_toxicity(documents([]), model).count() == 0
    assert np.isfinite(model.chars).all()


def close_readings(model, token):
    """All readings within reach of the best one, from every path through the lattice."""
    paths = {("", 0, 0): 0.0}
    last = ""
    for char in token:
        if char.isalpha():
            options = [(char, toxicity.AS_IS)] + ([("", toxicity.REPEATED)] if char == last else [])
        else:
            options = [(x, toxicity.REPLACED) for x in toxicity.STANDS_FOR.get(char, "")]
            options.append(("", toxicity.ODD_FILLER if options else toxicity.FILLER))
            options += [("", toxicity.REPEATED)] if char == last and len(options) > 1 else []
        last, step = char, {}
        for (text, a, b), score in paths.items():
            for letter, cost in options:
                c = ord(letter) - 96 if letter else 0
                key, new = ((text + letter, b, c), score + cost + model.chars[a, b, c]) if letter else ((text, a, b), score + cost)
                step[key] = max(new, step.get(key, -1e9))
        paths = step
    ended = {text: score + model.chars[a, b, 0] for (text, a, b), score in paths.items() if text}
    return [text for text, score in ended.items() if score >= max(ended.values()) - toxicity.WITHIN]


@pytest.mark.parametrize("joined", [False, True])
def test_every_close_reading_counts(model, joined):
    spots, found = "0134", 0
    tokens = ["ggrr00mmbb11ee", "55nn44rrkk", "vv11llee", "xgg110", "gr0mbb1eexyz", "s-nn@@rr-kuu5", "b11ll33", "vviilleepptt00"]
    tokens += [w.translate(str.maketrans("oiea", spots)) for w in ("ggroommbblle", "ssnnaarkkuss", "vviilleepttoo", "beramien")]
    for token in tokens:
        best = 0.0
        for text in close_readings(model, token):
            data = np.frombuffer(text.encode(), np.uint8)
            spans = [(0, len(data))]
            if joined:
                spans = [(s, e) for s in range(len(data)) for e in range(s + 3, len(data) + 1)]
            if spans:
                starts, ends = np.array(spans).T
                best = max(best, model.weigh(toxicity.prefix_hash(data), starts, ends).max())
        assert model.hidden(token, joined) == pytest.approx(best), token
        found += best > 0
    assert found > 5


@pytest.mark.parametrize(
    "text",
    [
        "gr" + "o" * 60 + "mble", "5n4rku5", "v1l3p70", "911", "grombble", "gromblee", "sn4rkuuss", "gr000000mble",
        "GROMbBLE", "$$$$$$nnarkus", "grombl€", "g r o m b l €", "sn@@@rkus", "V1LEPT0", "v" + "." * 40 + "ilepto",
    ],
)
def test_every_disguise_reaches_the_search(model, text):
    data = np.frombuffer(f"one {text}\ntwo".encode(), np.uint8)
    most, _ = model.evidence(data, np.array([0, len(data)]), {})
    assert (most[0] > 0) == (text != "911")


def test_accented_letters_are_code_points():
    def seen(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return [data[s:e].tobytes().decode() for _, s, e, _ in toxicity.disguised(data, np.array([0, len(data)]))]

    assert seen("né née éé ÉÉ Éé x日日x") == ["née", "éé", "ÉÉ", "Éé", "x日日x"][1:]
    assert seen("a é i ö u") == ["a é i ö u"]
    assert seen("plain words, as they are. né") == []


def test_plain_words_count_once(model):
    data = np.frombuffer(b"gromble-snarkus", np.uint8)
    once = np.frombuffer(b"gromble snarkus", np.uint8)
    assert model.evidence(data, np.array([0, 15]), {})[1] == pytest.approx(model.evidence(once, np.array([0, 15]), {})[1])
