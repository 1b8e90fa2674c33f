import sys
from pathlib import Path

import pytest
from compare import compare, connect

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline
from corpusmill.llm.common import written
from corpusmill.llm.mixing import mix
from corpusmill.llm.oracles import ORACLES
from corpusmill.llm.queries import QUERIES, table
from corpusmill.llm.toxicity import score_text, train, with_labels
from corpusmill.llm.common import held_out

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_beside_its_sql(spark, con, name):
    assert compare(spark, con, name, SF, QUERIES, ORACLES) is None


def test_there_is_a_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 14)]


def words(t):
    return (t or "").encode().split()


def test_stages_against_plain_python(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        kept[name] = docs.collect()
    rows = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    model = train(with_labels(table(spark, SF, "documents"), table(spark, SF, "labels"), ~held_out("doc_id", 5, 0)))
    civil = {i for i, r in rows.items() if score_text(r["text"] or "", model)[0] < 0.5}
    assert {r["doc_id"] for r in kept["toxicity"]} == civil

    shingles = {i: {tuple(words(rows[i]["text"])[k : k + 5]) for k in range(max(1, len(words(rows[i]["text"])) - 4))} for i in civil}
    near = {i: [j for j in civil if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])] for i in civil}
    first = set()
    left = set(civil)
    while left:
        group, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i not in group:
                group.add(i)
                todo += near[i]
        first.add(min(group))
        left -= group
    assert {r["doc_id"] for r in kept["ngram_jaccard_join"]} == first

    from test_decontaminate import brute

    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = {i for i in first if not brute(rows[i]["text"], items)[1]}
    assert {r["doc_id"] for r in kept["benchmark_decontamination"]} == clean

    m = mix(spark.createDataFrame(kept["benchmark_decontamination"], docs.schema))
    times = {}
    for r in m.schedule.where("start = 0").join(m.rows, "_row").select("doc_id").collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    got = {}
    for r in kept["mixing"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == times
    taken = sum(len(words(r["text"])) for r in kept["mixing"])
    assert taken == pytest.approx(sum(len(words(rows[i]["text"])) for i in clean), rel=0.2)


def test_run_returns_every_slot(spark):
    out = corpus_pipeline.run(spark, SF)
    slots = sorted(r["slot"] for r in out.select("slot").collect())
    assert slots == list(range(len(slots))) and slots


@pytest.mark.parametrize("kind", ["hostile", "nothing"])
def test_rows_of_all_kinds_go_through(spark, tmp_path, request, kind):
    """No stage stops at nulls, blanks, repeated ids or an empty table; the mix takes what it needs of the rest."""
    docs = request.getfixturevalue(kind).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("a", "none of the texts has these ten words in a row at all")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    held = {d for r in out for d in r["doc_ids"]}
    assert 5 in held and held <= {1, 5, 7, 8, None} if kind == "hostile" else not out
