"""New files as they arrive: the same row-local operators on a stream, appended to a table.

Nothing here keeps state: measuring, routing and cleaning look at one file at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators import routing
from corpusmill.options import Options
from corpusmill.sources import files as fs


def file_stream(spark: SparkSession, root: str, o: Options | None = None) -> DataFrame:
    """A stream of the files under ``root`` with the columns of a directory scan."""
    o = o or Options()
    arrived = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(o.discovered_suffixes) + "}")
        .load(root)
    )
    return fs.with_measures(fs.valid_text(fs.eligible(arrived, root, o).withColumnRenamed("length", "size_bytes")))


def routed_stream(files: DataFrame, path: str, checkpoint: str, o: Options | None = None) -> StreamingQuery:
    """Route and clean what is there and append it to the parquet table at ``path``, then stop."""
    routed = routing.cleaned(routing.route(files, o))
    return (
        routed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
