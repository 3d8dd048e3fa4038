import hashlib

import pytest

from salescope.llm import chat


@pytest.fixture
def turns(spark):
    def build(rows, extra=False):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        return df.selectExpr("*", "1 AS k", "2 AS seq", "3 AS formatted") if extra else df

    return build


def digests(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, own in by.items():
        text = "".join(f"{r}\n{t}\n" for r, t in own)
        loss = "".join(t for r, t in own if r == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (text, loss)]
        out[conv] = (len(own), sha[0], len(loss), sha[1])
    return out


HARD = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "<\\|end|>", "[\\\\INST] <s> \\", None, "", "é 😀 <|", "a\n\nb\n"]


@pytest.mark.parametrize(("tokens", "history"), [(1024, 256), (12, 12), (12, 0), (5, 3)])
def test_everything_comes_back_at_every_budget(turns, prose, tokens, history):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(HARD)]
    rows += [(2, 0, "system", "be kind"), *[(2, i, ("assistant", "user")[i % 2], prose(i % 9, i)) for i in range(1, 60)]]
    rows += [(3, 0, "user", prose(3000)), (3, 1, "assistant", prose(3000, 1)), (3, 2, "assistant", "end")]
    rows += [(None, 0, None, "x"), (None, None, "assistant", "y"), (4, 0, "a|b%\n<c", "odd role")]
    rows += [(5, 1, "assistant", "same")] * 3 + [(5, 1, "user", "tie")]
    windows = chat.format_chats(turns(rows, extra=True), tokens, history)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digest(windows).collect()}
    assert got == digests(rows)


def test_windows_keep_the_system_turn_and_limited_history(turns):
    rows = [(1, 0, "system", "rule")] + [(1, i, ("assistant", "user")[i % 2], f"w{i} x x x") for i in range(1, 13)]
    windows = chat.format_chats(turns(rows), 24, 8).orderBy("k").collect()
    assert len(windows) > 2
    for w in windows:
        parts = w.formatted.split("<|end|>\n")[:-1]
        assert parts[0] == "<|system|>\nrule" and len(parts) == w.n_repeated + w.n_turns
        assert w.k == 0 or w.n_repeated == 2  # the system turn and one turn of eight tokens
        for start, length in w.loss:
            assert w.formatted[:start].endswith("<|assistant|>\n")
            assert w.formatted[start + length :].startswith("<|end|>")
            # No target is among the repeated turns.
            assert w.formatted[:start].count("<|end|>\n") >= w.n_repeated


def test_control_strings_are_escaped_and_come_back(spark):
    df = spark.createDataFrame([(t or "",) for t in HARD], "t string")
    for t, safe, back in df.select("t", chat.escape(df.t), chat.unescape(chat.escape(df.t))).collect():
        assert back == t
        assert not any(mark in safe for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_history_and_empty_table(turns):
    with pytest.raises(ValueError, match="history"):
        chat.format_chats(turns([]), 10, 11)
    assert chat.chat_digest(chat.format_chats(turns([]))).count() == 0
