import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm.quality import Rule, base_failed, cascade, default_rules, measures, ordered, sampled


def brute(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered))


def test_measures_against_plain_python(documents):
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "b", "é", "#|", " ", " ", "  ", "\n", "\x0b", "\x85", " "]) for _ in range(r.randrange(400))) for _ in range(150)]
    texts += [" ".join(r.choice("ab") for _ in range(n)) for n in (7, 8, 9, 30, 200)] + ["", " ", None]
    found = documents(enumerate(texts)).withColumn("m", measures()).collect()
    for x in found:
        m = x["m"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_lines"], m["n_dup_lines"], m["n_repeat_words"]) == brute(texts[x["doc_id"]])


def test_the_order_changes_no_verdict(documents):
    texts = ["one two three four five six seven eight nine ten. " * n for n in range(12)] + ["a | b | c | d " * 9, "WORD! " * 40]
    df = documents(enumerate(texts)).withColumn("m", measures())
    rules = default_rules("m")
    kept = lambda rs: {r["doc_id"] for r in cascade(df, rs).where("rejected_by is null").collect()}
    one_by_one = {r["doc_id"] for r in df.where(~F.coalesce(F.expr("false"), F.lit(False)) & ~sum_of(rules)).collect()}
    assert kept(rules) == kept(rules[::-1]) == one_by_one


def sum_of(rules):
    out = F.lit(False)
    for r in rules:
        out = out | F.coalesce(r.rejects, F.lit(False))
    return out


def test_cheap_and_selective_rules_come_first(documents):
    df = documents((i, "x " * 3000) for i in range(40))
    dear = Rule("dear", F.size(F.array_sort(F.transform(F.split("text", " "), lambda w: F.sha2(w, 512)))) > 0)
    never, cheap = Rule("never", F.col("doc_id") < 0), Rule("cheap", F.col("doc_id") >= 0)
    order = [r.name for r, _, _ in ordered(df, [dear, never, cheap])]
    assert order[0] == "cheap" and order[-1] == "never"


@pytest.mark.parametrize("n", [1_000, 20_000, 100_000, 500_000])
def test_clean_texts_of_any_length_are_kept(documents, n):
    """Prose from one vocabulary keeps, however long; a few words over and over don't."""
    r = random.Random(n)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(6_000)]
    prose = " ".join(r.choice(vocabulary) + ("." if k % 12 == 11 else "") for k in range(n))
    poor = " ".join(r.choice(vocabulary[:40]) + ("." if k % 12 == 11 else "") for k in range(max(n, 20_000)))
    df = documents([(1, prose), (2, poor)], 1).withColumn("m", measures())
    out = {x["doc_id"]: x["rejected_by"] for x in cascade(df, default_rules("m"), first=Rule("base", base_failed("m"))).collect()}
    assert out == {1: None, 2: "few_distinct"}


def test_the_sample_is_by_hash(documents):
    df = documents(((i, f"text {i}") for i in range(500)), 5)
    got = [{x["doc_id"] for x in sampled(d, 40, "doc_id").collect()} for d in (df, df.orderBy("doc_id"))]
    assert got[0] == got[1] and len(got[0]) == 40
    assert sampled(df.drop("doc_id"), 7, "doc_id").count() == 7


def test_all_kinds_of_rows(hostile, nothing):
    df = hostile.withColumn("m", measures())
    out = cascade(df, default_rules("m"), first=Rule("base", base_failed("m")))
    assert out.columns == [*df.columns, "_rejected_by"]
    assert out.count() == hostile.count()
    assert {r["text"] for r in out.where("_rejected_by is null").collect()} == set()
    assert cascade(nothing.withColumn("m", measures()), default_rules("m")).count() == 0
