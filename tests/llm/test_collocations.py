import random
import re
from collections import Counter, defaultdict

import pytest

from corpusmill.llm import blocks
from corpusmill.llm import collocations as collocations_module
from corpusmill.llm.collocations import best_of, candidates, collocations, grouped, not_inside, phrase_counts, scored, windows


def small(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_counts(rows):
    f, n = defaultdict(Counter), Counter()
    for t, g in rows:
        g = "und" if g is None else g
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", small(t)):
            ws = [w for w in re.split("[ \t]", piece) if w]
            n[g] += len(ws)
            for m in (1, 2, 3, 4):
                f[g].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    return f, n


def brute(rows, at_least, k):
    f, n = brute_counts(rows)
    out = set()
    for g in f:
        cands = {p: a for p, a in f[g].items() if len(p) > 1 and a >= at_least}
        found = []
        for p, a in cands.items():
            _, cut = min((2_000_000 * a // (f[g][p[:c]] + f[g][p[c:]]), c) for c in range(1, len(p)))
            left, right = f[g][p[:cut]], f[g][p[cut:]]
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items())
            if not inside:
                found.append((-(2_000_000 * a // (left + right)), -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:k], 1):
            out.add((g, rank, p.decode(), -a, left, right, n[g], -s))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame(rows, "text string, lang string").repartition(3)


def found(docs, **kw):
    rows = collocations(docs, **kw).collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    return got


def texts(seed, n):
    r = random.Random(seed)
    ws = ["the", "The", "of", "é", "naïve", "a", "b", "c", "word\x0btail", "x-y", " ", "世界"]
    fixed = ["one two three four five", "new york city", "a a a a a a", "of the of the"]
    one = lambda: "".join(r.choice([*ws, *fixed]) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(r.randrange(60)))
    return [(one() if r.random() < 0.95 else None, r.choice(["en", "en", "en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize(("size", "ranges"), [(4 << 20, 8 << 20), (300, 200)])
def test_against_a_listing_of_all_phrases(table, size, ranges, monkeypatch):
    """In one block and one range, and in many of both."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    rows = texts(5, 250)
    assert found(table(rows), at_least=5, k=2_000, range_bytes=ranges) == brute(rows, 5, 2_000)
    assert found(table(rows), at_least=12, k=7, range_bytes=ranges) == brute(rows, 12, 7)


def test_windows_are_padded_from_what_is_rare(table):
    held, names = grouped(table([("a b c d e", "en")] * 3 + [("a b x", "en")]), "text", "lang")
    wins = windows(held, 3)
    got = Counter()
    for r in wins.collect():
        got[r["w1"], r["w2"], r["w3"], r["w4"]] += r["n"]
    assert got == {
        ("a", "b", "c", "d"): 3, ("b", "c", "d", "e"): 3, ("c", "d", "e", None): 3, ("d", "e", None, None): 3, ("e", None, None, None): 3,
        ("a", "b", None, None): 1, ("b", None, None, None): 1, (None, None, None, None): 1,
    }
    counts = {(r["m"], r["phrase"]): r["f"] for r in phrase_counts(wins, 3).collect()}
    assert counts[0, ""] == 18 and counts[1, "a"] == 4 and counts[2, "a b"] == 4 and counts[4, "b c d e"] == 3 and (1, "x") not in counts
    assert [r["group"] for r in names.collect()] == ["en"]


@pytest.mark.parametrize("bits", [24, 3])
def test_windows_of_many_blocks_are_one_row_each(table, bits, monkeypatch):
    """Also where most prefixes share their places: what stays in too long is counted exactly."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300)
    monkeypatch.setattr(collocations_module, "PLACE_BITS", bits)
    rows = texts(7, 200)
    held, _ = grouped(table(rows), "text", "lang")
    wins = windows(held, 5, range_bytes=500).collect()
    assert held.count() > 3 and len({r[:5] for r in wins}) == len(wins)
    f, n = brute_counts(rows)
    assert sum(r["n"] for r in wins) == sum(n.values())
    assert found(table(rows), at_least=5, k=2_000, range_bytes=500) == brute(rows, 5, 2_000)


def test_a_prefix_moves_as_two_bytes(table):
    """A place has PLACE_BITS bits, so that a block's questions are a fraction of its text."""
    r = random.Random(3)
    held, _ = grouped(table([(" ".join(f"w{r.randrange(10**6)}" for _ in range(100_000)), "en")]), "text", "lang")
    asked = held.mapInPandas(collocations_module._ask(1, collocations_module.PLACE_BITS), collocations_module.ROWS).collect()
    assert sum(len(x["blob"]) for x in asked) < 2 * 400_000


def test_products_beyond_64_bits(spark):
    a = 9 * 10**18
    counts = spark.createDataFrame(
        [(7, 1, "x", a + 3), (7, 1, "y", a + 2), (7, 2, "x y", a), (7, 3, "x y z", a - 1), (7, 1, "z", a), (7, 2, "y z", a - 1)],
        "group_key long, m int, phrase string, f long",
    )
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in scored(candidates(counts), counts).collect()}
    assert got["x y"] == (a + 3, a + 2, 2_000_000 * a // (2 * a + 5))
    assert got["x y z"] == (a + 3, a - 1, 2_000_000 * (a - 1) // (2 * a + 2))
    assert {r["phrase"] for r in not_inside(candidates(counts)).collect()} == {"x y z"}


def test_ties_take_the_bytes_order(spark):
    rows = [(7, 2, p, 30, 30, 30, s) for p, s in (("b a", 5), ("a b", 5), ("é a", 5), ("z a", 5), ("\U0001f600 a", 5), ("￮ a", 5), ("top x", 9))]
    df = spark.createDataFrame(rows, "group_key long, m int, phrase string, a long, l long, r long, score long")
    assert [r["phrase"] for r in best_of(df, 6).orderBy("rank").collect()] == ["top x", "a b", "b a", "z a", "é a", "￮ a"]


def test_all_kinds_of_rows(hostile, nothing):
    rows = [(r["text"], r["lang"]) for r in hostile.collect()]
    assert found(hostile, at_least=2) == brute(rows, 2, 2_000)
    assert found(nothing) == set()
