import hashlib
import random

import numpy as np
import pytest

from corpusmill.llm import blocks, repeats
from corpusmill.llm.repeats import has_previous, suffix_order, without_repeats

LAST = 1 << 63


def brute(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, LAST), LAST if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (LAST if i is None else i):
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int(np.count_nonzero(np.diff(np.append(False, gone).astype(int)) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], len(x["spans"]) // 2, x["kept_sha256"]) for x in without_repeats(df, **options).collect()), key=str)


def passages(seed, n=80):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdé ") for _ in range(r.randrange(30, 200))) for _ in range(12)]
    fresh = lambda: "".join(r.choice("ghijklm nopq") for _ in range(r.randrange(0, 160)))
    rows = [(i * 3, "".join(r.choice([r.choice(pool), fresh()]) for _ in range(r.randrange(0, 6)))) for i in range(n)]
    rows += [(1, rows[5][1]), (500, rows[5][1]), (500, rows[5][1]), (501, None), (502, ""), (None, rows[7][1]), (None, rows[7][1])]
    rows += [(503, "a" * 400), (504, "a" * 49), (505, "xyz" + "a" * 50), (506, "ab" * 300), (507, "\u0000" * 120), (508, "\u0000" * 90)]
    return rows


def test_suffix_order_and_previous_factors():
    r = random.Random(2)
    text = np.array([r.randrange(0, 4) for _ in range(400)])
    order, _ = suffix_order(text, 9)
    cut = [tuple(text[i : i + 9]) + (0,) * max(0, i + 9 - 400) for i in range(400)]
    assert [cut[i] for i in order] == sorted(cut)
    doc = np.sort(np.array([r.randrange(20) for _ in range(400)]))
    got = has_previous(text, doc, 9)
    assert got.tolist() == [any(cut[j] == cut[i] and doc[j] < doc[i] for j in range(400)) for i in range(400)]


@pytest.mark.parametrize("size,hot", [(1 << 22, 100_000), (500, 100_000), (500, 1)])
def test_against_all_strings(documents, monkeypatch, size, hot):
    """In one block, in many, and with every anchor's windows dealt out one by one."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 4 * size)
    rows = passages(5)
    assert found(documents(rows, 3), hot=hot) == brute(rows, 50)


def test_shorter_strings(documents, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 700)
    rows = passages(6, 40)
    assert found(documents(rows, 2), length=20, gram=7) == brute(rows, 20)


def test_all_kinds_of_rows(hostile, nothing):
    rows = [(x["doc_id"], x["text"]) for x in hostile.collect()]
    assert found(hostile) == brute(rows, 50)
    texts = {x["doc_id"]: bytes(x["kept"]) for x in without_repeats(hostile, with_text=True).collect()}
    assert texts[None] == b"" and texts[8].decode().startswith("\u0000 nul")
    assert without_repeats(nothing).count() == 0
