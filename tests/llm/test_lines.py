import pytest

from salescope.llm import lines


def found(df):
    rows = lines.dedup_lines(df).collect()
    return {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_chunks) for r in rows}


def brute(df, texts):
    """The same from the chunks' places alone, comparing their bytes in order."""
    seen, out = set(), {}
    spans = {}
    for r in lines.chunks(df).collect():
        spans.setdefault(r.doc_id, set()).add((r.s, r.e))
    for doc, text in sorted(texts.items()):
        own, gone, n = (text or "").split("\n"), set(), 0
        for s, e in sorted(spans.get(doc, ())):
            chunk = "\n".join(own[s : e + 1])
            if chunk in seen:
                gone |= set(range(s, e + 1))
                n += 1
            seen.add(chunk)
        out[doc] = ("\n".join(x for i, x in enumerate(own) if i not in gone), len(own), len(gone), n)
    return out


@pytest.fixture(scope="module")
def texts(prose, hard_texts):
    block = "\n".join(prose(5, k) for k in range(40))
    made = [f"{prose(4, 100 + i)}\n{block if i % 3 else ''}\n{prose(4, 200 + i)}" for i in range(12)]
    return dict(enumerate([*hard_texts, *made, block, block, "a\n\n\n\n\nb", "x\ny\n" * 30, " \n\t\n" * 9]))


def test_matches_brute_force(documents, texts):
    df = documents(list(texts.items()), extra=True)
    got = found(df)
    assert got == brute(df, texts)
    assert sum(n for _, _, n, _ in got.values()) > 200


def test_boundaries_do_not_shift(documents, prose):
    own = [prose(5, k) for k in range(80)]
    texts = {0: "\n".join(own), 1: "\n".join(["one more", *own]), 2: "\n".join(own[:30] + ["new"] + own[31:])}
    got = found(documents(list(texts.items())))
    assert got[1][2] >= 60 and got[2][2] >= 60
    assert got[0][2] == 0 and got[1][0].startswith("one more")


def test_single_lines_and_blank_lines_stay(documents):
    got = found(documents([(i, f"own {i}\n\n \n") for i in range(6)] + [(9, None)]))
    assert all(n == 0 for _, _, n, _ in got.values()) and got[9] == ("", 1, 0, 0)


def test_repeated_rows_and_empty_table(documents, prose):
    text = "\n".join(prose(5, k) for k in range(30))
    rows = lines.dedup_lines(documents([(1, text), (1, text), (2, text), (None, text)])).collect()
    removed = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed > 0) for r in rows)
    assert removed == [(False, 0, False), (True, 1, True), (True, 1, True), (True, 2, True)]
    assert lines.dedup_lines(documents([])).count() == 0


def repeated_runs(texts):
    """What is left without any run of lines, two or more of them with words, that occurs earlier."""
    seen, out = set(), {}
    for doc, text in sorted(texts.items()):
        own, gone = text.split("\n"), set()
        words = [i for i, x in enumerate(own) if x.strip()]
        for e in words:  # by last line: what ends earlier is seen before
            runs = [(s, "\n".join(own[s : e + 1])) for s in words if s < e]
            gone.update(i for s, run in runs if run in seen for i in range(s, e + 1))
            seen.update(run for _, run in runs)
        out[doc] = "\n".join(x for i, x in enumerate(own) if i not in gone)
    return out


def test_every_repeated_run_is_removed(documents, prose):
    passages = ["\n".join(prose(6, 50 * n + k) + "\n" * (k % 2) for k in range(n)) for n in range(2, 9)]
    texts = {}
    for i in range(28):
        parts = [prose(7, 1000 + i), passages[i % 7], prose(7, 2000 + i), passages[(i + 1 + i // 7) % 7], prose(7, 3000 + i)]
        texts[i] = "\n".join(parts[i % 2 :])
    got = {doc: row[0] for doc, row in found(documents(list(texts.items()))).items()}
    assert got == repeated_runs(texts)
    kept = "\n".join(got.values()).split("\n")
    assert all(kept.count(line) == 1 for passage in passages for line in passage.split("\n") if line)
