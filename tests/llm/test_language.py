import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm.language import Profiles, grams, language, profiles
from corpusmill.llm.queries import op9_rank_order, table

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            padded = " " + word + " "
            out += [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n].strip(" ")]
        word = ""
    return sorted(out)


def unpack(code):
    chars = [(code >> s) & ((1 << 21) - 1) for s in (42, 21, 0)]
    return chars


@pytest.mark.parametrize("text", ["Ab, cé-d 9x!", "", "...", "a", "日本 語", "x\u0000y"])
def test_grams_are_those_of_padded_words(text):
    packed = sorted(grams(text).tolist())

    def code(g):
        n = 0
        for c in g:
            n = n << 21 | ord(c)
        return n

    assert packed == sorted(code(g) for g in plain_grams(text))


def test_distance_against_ranks_by_hand():
    model = Profiles({"x": [1, 2, 3], "y": [3, 9]}, 4)
    assert model.langs == ["x", "y"]
    text = "ab"  # its grams are in neither profile: both are equally far, the first by name wins
    assert model.predict(text) == ("x", 0.0)


def plain_profile(counts, top=400):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code_of(x[0])))[:top]]


def code_of(g):
    n = 0
    for c in g:
        n = n << 21 | ord(c)
    return n


def test_the_query_against_plain_python(spark):
    """Profiles, distances and scores of a whole table, by dictionaries."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang").collect()
    out_of = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    counts = defaultdict(Counter)
    for r in docs:
        if r["lang"] is not None and not out_of(r["doc_id"]):
            counts[r["lang"]].update(plain_grams(r["text"] or ""))
    rank = {la: {g: i for i, g in enumerate(plain_profile(c))} for la, c in counts.items()}
    want = {}
    for r in docs:
        own = plain_profile(Counter(plain_grams(r["text"] or "")))
        far = sorted((sum(min(400, abs(rank[la][g] - i)) if g in rank[la] else 400 for i, g in enumerate(own)), la) for la in rank)
        score = 1 - far[0][0] / far[1][0] if own and far[1][0] else 0.0
        want[r["doc_id"]] = (out_of(r["doc_id"]), far[0][1] if own else "und", pytest.approx(score))
    got = op9_rank_order(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in got} == want


def test_held_out_accuracy(spark):
    found = op9_rank_order(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_all_kinds_of_rows(hostile, nothing):
    by_lang = profiles(hostile)
    assert sorted(by_lang) == ["de", "en", "fr"]
    out = language(hostile, by_lang)
    assert out.columns == [*hostile.columns, "_language"]
    found = [(x["text"], x["_language"]["lang"], x["_language"]["score"]) for x in out.collect()]
    assert len(found) == hostile.count()
    assert all((la == "und" and s == 0) for t, la, s in found if not t or not any(c.isalpha() for c in t))
    assert all(la in by_lang and 0 <= s <= 1 for t, la, s in found if t and any(c.isalpha() for c in t))
    assert profiles(nothing) == {}
    assert {x["_language"]["lang"] for x in language(hostile, {}).collect()} == {"und"}
    assert language(nothing, by_lang).count() == 0


def test_no_letters_no_grams():
    assert len(grams("1234 !?")) == 0 and isinstance(grams(""), np.ndarray)
