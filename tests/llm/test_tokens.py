import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from salescope.llm import tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_tokenizer())


def expected(tokenizer, texts):
    start, out = 0, []
    for text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = [
    " lead", "trail ", "a  b   c", "a \n b", "\u00a0 \u00a0x", "x\u00a0 \u3000 y", "é é ñ  ü", "it's we'll 'x", "<|endoftext|> a <|endoftext|>",
    "1 2 33 a1", "\x1c \x85 x", "\t\ttab x", "!! ?? ... a!b", "\u2028 \u2029", "x \u3000y", "ends with space \n", "🙂 🙂 z", "   ", "é \u00a0é",
]


@pytest.mark.parametrize("shard_ids", [4_000_000, 40])
def test_shards_give_the_ids_of_whole_texts(spark, documents, hard_texts, prose, tokenizer, tmp_path, shard_ids):
    texts = [*hard_texts, *ODD, *(prose(30, k) + o + prose(5, k) for k, o in enumerate(ODD))]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "shards")
    tokens.write_shards(documents(rows, extra=True).repartition(4), path, tokens.public_tokenizer(), shard_ids=shard_ids)
    got = tokens.read_shards(spark, path).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == expected(tokenizer, texts)


def test_random_strings_come_apart_safely(tokenizer):
    chosen = random.Random(4)
    alphabet = [*" \n\t\u00a0\u3000\x1f", *"abéñ'sdl19!.-", "<|endoftext|>", "🙂"]
    texts = ["".join(chosen.choice(alphabet) for _ in range(chosen.randrange(40))) for _ in range(1500)]
    with open(tokens.public_tokenizer(), encoding="utf-8") as file:
        encoder = tokens.Encoder(file.read())
    assert encoder.by_parts
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    ids, size = encoder.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    whole = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert size.tolist() == [len(w) for w in whole] and ids.tolist() == [i for w in whole for i in w]


def test_other_tokenizers_encode_whole_texts(spark, documents, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    name = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello  World", None, "déjà vu"]
    tokens.write_shards(documents(texts), str(tmp_path / "s"), name)
    got = tokens.read_shards(spark, str(tmp_path / "s")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == expected(Tokenizer.from_file(name), texts)


def test_index_is_minimal_perfect_and_keyed():
    chosen = np.random.Generator(np.random.PCG64(2))
    keys = np.sort(np.concatenate((chosen.integers(-(10**12), 10**12, 4000), [7, 7, 7])))
    ids = [np.full(k % 5, k % 1000, np.uint16) for k in range(len(keys))]
    shard = tokens.Shard(tokens.pack(0, 0, keys, ids, np.dtype("<u2")))
    assert sorted(shard.document.tolist()) == list(range(len(keys)))
    for place in (0, 1, 2000, len(keys) - 1):
        found = shard.get(int(keys[place]), int(shard.occurrence[place]))
        assert found.tolist() == ids[place].tolist()
    assert shard.get(7, 2) is not None and shard.get(7, 3) is None and shard.get(10**15) is None


def test_repeated_keys_missing_keys_and_empty_table(spark, documents, tmp_path):
    rows = [(5, "b"), (5, "a"), (5, "a"), (1, "c")]
    tokens.write_shards(documents(rows), str(tmp_path / "a"), tokens.public_tokenizer())
    got = tokens.read_shards(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 5, 5, 5] and [r.start for r in got] == [0, 2, 4, 6]
    assert tokens.token_ids(documents([]), tokens.public_tokenizer()).count() == 0


def test_rows_without_an_id_come_first(spark, documents, tokenizer):
    rows = [(5, "b"), (None, "x y"), (-9, None), (None, "x y"), (None, None)]
    got = tokens.token_ids(documents(rows), tokens.public_tokenizer()).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, None, -9, 5]
    assert sorted(r.n_tokens for r in got[:3]) == [1, *[len(tokenizer.encode("x y", add_special_tokens=False).ids) + 1] * 2]


def test_a_worker_stays_small():
    """Memory that a new process needs beyond its texts, for many distinct words."""
    code = """
import random, resource
import numpy as np
from salescope.llm import tokens

with open(tokens.public_tokenizer(), encoding="utf-8") as file:
    encoder = tokens.Encoder(file.read())
chosen = random.Random(1)
for _ in range(12):
    texts = [" ".join("".join(chosen.choice("abcdeinorstu") for _ in range(7)) for _ in range(2000)).encode() for _ in range(60)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    encoder.encode(np.frombuffer(b"".join(texts), np.uint8), offsets)
held = encoder.keys.nbytes + encoder.begin.nbytes + encoder.size.nbytes + encoder.ids.nbytes
print(held, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    held, peak_kb = map(int, done.stdout.split())
    assert held < 2 * tokens.REMEMBERED_BYTES and peak_kb < 300_000
