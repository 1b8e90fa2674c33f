import random
import re

import pytest

from corpusmill.llm.decontaminate import WuManber, decontaminate, item_words


def plain_words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=10):
    ws, hit, named = plain_words(text), set(), set()
    for name, t in items:
        iw = plain_words(t)
        for p in {tuple(iw[i : i + window]) for i in range(max(1, len(iw) - window + 1))} - {()}:
            for i in range(len(ws) - len(p) + 1):
                if tuple(ws[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    named |= {str(name)} if name is not None else set()
    return len(ws), len(hit), sorted(named)


def test_words_are_those_of_the_class():
    t = "Ab-c9_é\x7f\x80ÄÖ x y\x00z@K"
    assert [w.decode() for w in item_words(t.encode())] == plain_words(t)


def test_search_finds_every_occurrence():
    r = random.Random(1)
    text = [r.choice([b"a", b"b", b"c"]) for _ in range(3000)]
    for length in (1, 2, 3, 7):
        t = WuManber(length)
        patterns = {tuple(text[i : i + length]) for i in range(0, 2990, 97)} | {(b"z",) * length}
        for p in patterns:
            t.add(p, "item")
        assert [i for i, _, _ in t.search(text)] == [i for i in range(len(text) - length + 1) if tuple(text[i : i + length]) in patterns]


@pytest.mark.parametrize("block", [200_000, 7])
def test_against_plain_search(spark, documents, block):
    r = random.Random(block)
    word = lambda: r.choice(["Alpha", "beta", "gamma9", "ÉTÉ", "x", "yy", "zzz"])
    items = [(k, " ".join(word() for _ in range(r.choice([0, 1, 3, 10, 14])))) for k in range(14)] + [(None, "no name here"), (3, None), (3, "beta. gamma9; x")]
    texts = []
    for _ in range(40):
        parts = [" ".join(word() for _ in range(r.randrange(12)))]
        parts += [r.choice(items)[1] or "", "-".join(word() for _ in range(r.randrange(5)))]
        texts.append((len(texts), " ".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for x in decontaminate(documents(texts), bench, block_patterns=block).collect():
        leak, (n, hit, named) = x["leak"], brute(x["text"], items)
        assert (leak["n_words"], leak["n_hit"], leak["items"], leak["contaminated"]) == (n, hit, named, hit > 0)
        assert sum(leak["spans"][1::2]) - sum(leak["spans"][::2]) == hit


def test_all_kinds_of_rows(spark, hostile, nothing):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs away"), (2, "fünf"), (2, None), (None, "")], "item_id long, text string")
    out = decontaminate(hostile, bench)
    assert out.columns == [*hostile.columns, "_leak"]
    assert out.count() == hostile.count()
    hits = sorted((str(x["doc_id"]), x["_leak"]["n_hit"], x["_leak"]["items"]) for x in out.where("_leak.contaminated").collect())
    assert hits == [("1", 11, ["1"]), ("7", 1, ["2"]), ("7", 1, ["2"]), ("None", 11, ["1"])]
    assert decontaminate(hostile, bench.limit(0)).where("_leak.contaminated").count() == 0
    assert decontaminate(nothing, bench).count() == 0
