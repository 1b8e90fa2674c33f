import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from corpusmill.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def merged(symbols, merges):
    """One merge after the other, each from the left."""
    out = list(symbols)
    for u, v, w in merges:
        i = 0
        while i + 1 < len(out):
            if out[i] == u and out[i + 1] == v:
                out[i : i + 2] = [w]
            i += 1
    return out


def random_merges(r, symbols, n):
    spelt = {s: (s,) for s in range(symbols)}
    merges = []
    while len(merges) < n:
        u, v = r.choice([*spelt]), r.choice([*spelt])
        if len(spelt[u] + spelt[v]) <= 12 and (u, v) not in [m[:2] for m in merges]:
            spelt[symbols + len(merges)] = spelt[u] + spelt[v]
            merges.append((u, v, symbols + len(merges)))
    return merges


@pytest.mark.parametrize("seed", range(40))
def test_the_automaton_against_the_merges(seed, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 7 if seed % 4 == 0 else 100_000)
    r = random.Random(seed)
    n = r.choice([1, 2, 3])
    merges = random_merges(r, n, r.choice([1, 3, 10, 25]))
    a = bpe.Automaton({x: x for x in range(n)}, merges)
    for _ in range(150):
        word = [r.randrange(n) for _ in range(r.randrange(1, 30))]
        assert a.tokens(word) == merged(word, merges), (merges, word)


def test_the_paths_are_the_tokenisations():
    """Exactly those sequences of tokens are paths that the merges leave of some word."""
    r = random.Random(1)
    for _ in range(10):
        merges = random_merges(r, 2, 6)
        a = bpe.Automaton({0: 0, 1: 1}, merges)
        for x in a.made:
            for y in a.made:
                if x != a.START and y != a.START:
                    word = a.spelt[x] + a.spelt[y]
                    assert a._follows(x, y) == (merged(word, merges) == [x, y])


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.Automaton({0: 0, 1: 1}, [(2, 0, 3), (0, 1, 2)])


def sample_texts():
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(r.choice(letters + "   '!?12éÀßİΣσ世界🙂\n\t́\x00") for _ in range(r.randrange(1, 200))) for _ in range(300)]
    texts += [" ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 15))) for _ in range(400)) for _ in range(20)]
    texts += ["a\x1cb \x1d\x1e c\x1f", " ́x \u2000̈y"]
    texts += ["he'll they've I'm Don'T 's 'd", "ΑΣ ΟΔΥΣΣΕΥΣ", "a<|endoftext|>b <|startoftext|>C<|endoftext|><|endoftext", "<|startoftext|>"]
    texts += ["xᲉy Ɤ ՘! \U00010d50 ￾", "​ \x85\xa0\x1c᠎.", "é Å 각", "", " ", "a" * 5_000, "ab" * 3_000 + "!" * 2_000]
    texts += ["".join(chr(c) for c in range(a, a + 4096) if not 0xD800 <= c < 0xE000) for a in range(0, 0x32000, 4096)]
    return texts


def test_against_the_library(vocab, library):
    e = bpe.Encoder(vocab)
    for t in sample_texts():
        assert e.ids(t) == library.encode(t, add_special_tokens=False).ids, t[:80]


def test_tables_that_are_begun_anew(vocab, library, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "WORDS", 20)
    e = bpe.Encoder(vocab)
    for t in sample_texts()[280:324]:
        assert e.ids(t) == library.encode(t, add_special_tokens=False).ids


def test_other_kinds_of_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_all_kinds_of_rows(vocab, library, hostile, nothing):
    df = hostile.withColumnRenamed("leak", "ids")
    out = bpe.decoded(bpe.encoded(df, vocab), vocab, ids="_ids")
    assert out.columns == [*df.columns, "_ids", "decoded"]
    rows = out.collect()
    assert len(rows) == hostile.count()
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["_ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encoded(nothing, vocab).collect() == []


def test_ids_from_elsewhere(spark, vocab):
    df = spark.createDataFrame([([320, 49406, 99_999_999, -1],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decoded(df, vocab).collect()] == ["a</w> <|startoftext|>", "", ""]


def test_the_query_against_the_library(spark, library):
    from corpusmill.llm.queries import op11_bpe_automaton, table

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    got = op11_bpe_automaton(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)
