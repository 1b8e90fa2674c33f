from corpusmill.operators import routing
from corpusmill.sources import files as fs
from corpusmill.streaming.ingest import file_stream, routed_stream


def test_stream_routes_like_a_batch(spark, tmp_path):
    src = tmp_path / "in"
    (src / "build").mkdir(parents=True)
    (src / "a.py").write_text("x = 1  \n\n\n\n\ny = 2\n")
    (src / "build" / "b.py").write_text("skip")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    routed_stream(file_stream(spark, str(src)), out, checkpoint).awaitTermination()
    (src / "c.md").write_text("# c")
    routed_stream(file_stream(spark, str(src)), out, checkpoint).awaitTermination()
    batch = routing.cleaned(routing.route(fs.scan_files(spark, str(src))))
    columns = ["relative_path", "content", "category", "line_count", "content_hash"]
    assert sorted(spark.read.parquet(out).select(columns).collect()) == sorted(batch.select(columns).collect())
    assert spark.read.parquet(out).count() == 2
