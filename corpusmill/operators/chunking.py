"""Cutting file texts into chunks of at most ``max_tokens``.

Every rule works inside one file's row with array functions, so cutting needs no shuffle;
files above the budget are joined once to the spans of their declarations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import texts
from corpusmill.functions.jsonfix import let
from corpusmill.operators import cutting, declarations, packing
from corpusmill.options import Options

CHUNK_COLUMNS = (
    "relative_path", "ordinal", "chunk_id", "content", "token_count", "source_files", "language",
    "class_names", "function_names", "level",
)
NO_NAMES = "cast(array() as array<string>)"
NO_SPANS = (
    "cast(array() as array<struct<type_no:int,name:string,start:int,end:int,"
    "functions:array<struct<start:int,end:int,name:string>>>>)"
)


def bins_of(items: Column, cost: str, unit: str, limit: int) -> Column:
    """Next-fit inside an array: where each bin begins and ends (0-based, the end is the next bin's begin), its number
    within its unit, and what its items cost together.

    A bin also ends where ``unit`` changes. The fold copies its list only when a bin opens, so it stays linear in the
    items.
    """

    def state(s: Column, total: Column, unit: Column, first: Column, nth: Column, bins: Column) -> Column:
        named = {"at": s["at"] + 1, "sum": total.cast("long"), "unit": unit.cast("int"), "first": first, "nth": nth, "bins": bins}
        return F.struct(*[c.alias(k) for k, c in named.items()])

    def step(s: Column, x: Column) -> Column:
        grown = s["sum"] + x[cost]
        closed = F.concat(s["bins"], F.array(_bin(s)))
        return (
            F.when((s["unit"] == x[unit]) & (grown <= limit), state(s, grown, s["unit"], s["first"], s["nth"], s["bins"]))
            .when(s["unit"].isNull(), state(s, x[cost], x[unit], s["at"], F.lit(0), s["bins"]))
            .otherwise(state(s, x[cost], x[unit], s["at"], F.when(s["unit"] == x[unit], s["nth"] + 1).otherwise(0), closed))
        )

    zero = F.expr(
        "named_struct('at', 0, 'sum', 0L, 'unit', cast(null as int), 'first', 0, 'nth', 0, "
        "'bins', cast(array() as array<struct<first:int,stop:int,unit:int,nth:int,cost:bigint>>))"
    )
    return F.aggregate(items, zero, step, lambda s: F.when(s["unit"].isNull(), s["bins"]).otherwise(F.concat(s["bins"], F.array(_bin(s)))))


def _bin(s: Column) -> Column:
    return F.struct(s["first"].alias("first"), s["at"].alias("stop"), s["unit"].alias("unit"), s["nth"].alias("nth"), s["sum"].alias("cost"))


def _joined(lines: Column, first: Column, last: Column) -> Column:
    """Lines ``first``..``last`` (1-based, inclusive) as one text."""
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def _tokens(files: DataFrame, o: Options) -> Column:
    """The files' token counts, if they have them already."""
    return F.col("tokens") if "tokens" in files.columns else o.measure.of_text(F.col("content"))


def whole_file_chunks(files: DataFrame, o: Options | None = None) -> DataFrame:
    """Files within the budget, each as one chunk ``path:full``.

    The token count decides and is kept in one generator: as a filter on a column it would be pushed
    down and counted a second time.
    """
    o = o or Options()
    fitting = let(
        _tokens(files, o),
        lambda t: F.when(t <= o.max_tokens, F.array(F.struct(F.lit(0).cast("long").alias("ordinal"), t.cast("long").alias("token_count")))),
    )
    small = files.select("relative_path", "language", "content", F.inline_outer(fitting)).filter(F.col("ordinal").isNotNull())
    return small.select(
        "relative_path",
        "ordinal",
        F.concat("relative_path", F.lit(":full")).alias("chunk_id"),
        "content",
        "token_count",
        F.array("relative_path").alias("source_files"),
        "language",
        texts.class_names(F.col("content"), F.col("language")).alias("class_names"),
        F.expr(NO_NAMES).alias("function_names"),
        F.lit("file").alias("level"),
    )


def oversize(files: DataFrame, o: Options | None = None) -> DataFrame:
    """Files above the budget, with ``tokens``. A text has at least one byte per token, so the byte
    length rules most files out before any token is counted."""
    o = o or Options()
    longer = files.filter(F.octet_length("content") > o.max_tokens)
    return longer.withColumn("tokens", _tokens(files, o)).filter(F.col("tokens") > o.max_tokens)


def line_chunks(files: DataFrame, o: Options | None = None) -> DataFrame:
    """Cut every file by lines, whatever its language; a line's cost counts its line feed."""
    o = o or Options()
    df = files.withColumn("lines", texts.lines_of(F.col("content")))
    df = df.withColumn("costs", o.measure.of_each(F.transform("lines", lambda x: F.concat(x, F.lit("\n")))))
    priced = F.transform("costs", lambda c: F.struct(F.lit(0).alias("unit"), c.alias("cost")))
    df = df.withColumn("cuts", bins_of(priced, "cost", "unit", o.max_tokens))

    def piece(b: Column, j: Column) -> Column:
        return F.struct(
            j.cast("long").alias("ordinal"),
            F.concat("relative_path", F.lit(":lc"), j.cast("string")).alias("chunk_id"),
            F.array_join(F.slice("lines", b["first"] + 1, b["stop"] - b["first"]), "\n").alias("content"),
            b["cost"].alias("token_count"),
        )

    df = df.withColumn("pieces", F.transform("cuts", piece))
    none = F.expr(NO_NAMES)
    return df.select(
        "relative_path", F.array("relative_path").alias("source_files"), "language", none.alias("class_names"),
        none.alias("function_names"), F.lit("lines").alias("level"), F.inline_outer("pieces"),
    ).select(*CHUNK_COLUMNS)


def _measured(places: str, o: Options) -> Column:
    """Tokens of the lines at each place of the array ``places``: structs with ``start`` and ``end``, 1-based, inclusive."""
    return o.measure.of_each(F.transform(places, lambda x: _joined(F.col("lines"), x["start"], x["end"])))


def cut(files_with_spans: DataFrame, o: Options) -> DataFrame:
    """All chunk levels below the whole file, decided per file in one pass.

    type: a declared type that fits. header / functions / function_part: an oversize type as the text
    before its first function (if above ``header_min_tokens``), next-fit groups of functions, and
    oversize functions cut by lines. rest: runs of lines in none of these, unless blank, cut by lines.
    lines: a file without spans, or whose spans give no chunk. Ordinals ascend with the first line.

    A measure that counts line by line does so once for all pieces, which are then cut by running sums (``cutting``); for
    any other one the pieces are measured as whole texts.
    """
    if o.measure.of_line is not None:
        counts = F.transform(texts.lines_of(F.col("content")), o.measure.of_line).cast("array<int>")
        counted = files_with_spans.select("relative_path", "language", "content", "spans", counts.alias("line_tokens"))
        return counted.mapInArrow(cutting.cut_of(o.max_tokens, o.header_min_tokens), cutting.CHUNK_ROWS)
    return _cut_by_pieces(files_with_spans, o)


def _cut_by_pieces(files_with_spans: DataFrame, o: Options) -> DataFrame:
    m = o.max_tokens
    df = files_with_spans.withColumn("lines", texts.lines_of(F.col("content")))

    # Types: lines, tokens; headers of the oversize ones.
    df = df.withColumn("type_tokens", _measured("spans", o))

    def header(s: Column, i: Column) -> Column:
        until = F.when(F.size(s["functions"]) > 0, s["functions"][0]["start"]).otherwise(s["end"])
        # Lines 1 to 0 are none.
        return F.when(F.col("type_tokens")[i] > m, F.struct(s["start"].alias("start"), (until - 1).alias("end"))).otherwise(F.struct(F.lit(1).alias("start"), F.lit(0).alias("end")))

    df = df.withColumn("headers", F.transform("spans", header))
    df = df.withColumn("header_tokens", _measured("headers", o))

    # Functions of the oversize types, in one array per file; a bin never crosses a type.
    def functions_of(s: Column, i: Column) -> Column:
        listed = F.transform(
            s["functions"],
            lambda f: F.struct(i.alias("unit"), s["name"].alias("type_name"), f["name"].alias("name"),
                               f["start"].alias("start"), f["end"].alias("end")),
        )
        return F.when(F.col("type_tokens")[i] > m, listed).otherwise(F.slice(listed, 1, 0))

    df = df.withColumn("fns", F.flatten(F.transform("spans", functions_of)))
    df = df.withColumn("fn_tokens", _measured("fns", o))
    df = df.withColumn("priced", F.transform("fns", lambda f, i: F.struct(f["unit"].alias("unit"), F.col("fn_tokens")[i].alias("cost"))))
    df = df.withColumn(
        "bins", F.transform(bins_of(F.col("priced"), "cost", "unit", m), lambda b: F.struct(b["first"].alias("first"), (b["stop"] - 1).alias("last")))
    )
    is_big = lambda b: F.col("fn_tokens")[b["first"]] > m
    df = df.withColumn("groups", F.filter("bins", lambda b: ~is_big(b)))
    df = df.withColumn("big", F.filter("bins", is_big))
    df = df.withColumn(
        "group_lines",
        F.transform("groups", lambda b: F.struct(F.col("fns")[b["first"]]["start"].alias("start"), F.col("fns")[b["last"]]["end"].alias("end"))),
    )
    df = df.withColumn("group_tokens", _measured("group_lines", o))

    # Lines to cut: of the oversize functions, or of the whole file if nothing else gives a chunk.
    df = df.withColumn(
        "gives",
        F.exists(F.transform("spans", lambda s, i: (F.col("type_tokens")[i] <= m) | (F.size(s["functions"]) > 0)
                             | (F.col("header_tokens")[i] > o.header_min_tokens)), lambda x: x),
    )

    # Lines to cut are named by their numbers; an end beyond the file is its last line.
    def numbered_lines(unit: Column, start: Column, end: Column) -> Column:
        last = F.least(end, F.size("lines"))
        listed = F.transform(F.sequence(start, F.greatest(start, last)), lambda n: F.struct(unit.cast("int").alias("unit"), n.cast("int").alias("no")))
        return F.when(start <= last, listed).otherwise(F.slice(listed, 1, 0))

    def lines_of_big(b: Column) -> Column:
        fn = F.col("fns")[b["first"]]
        return numbered_lines(b["first"], fn["start"], fn["end"])

    # What the chunks so far leave out: the gaps between their lines, in order.
    interval = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    whole_types = F.transform("spans", lambda s, i: F.when(F.col("type_tokens")[i] <= m, interval(s["start"], s["end"])))
    heads = F.transform(
        "spans",
        lambda s, i: F.when(
            (F.col("type_tokens")[i] > m) & (F.col("header_tokens")[i] > o.header_min_tokens),
            interval(s["start"], F.when(F.size(s["functions"]) > 0, s["functions"][0]["start"]).otherwise(s["end"]) - 1),
        ),
    )
    in_bins = F.transform("bins", lambda b: interval(F.col("fns")[b["first"]]["start"], F.col("fns")[b["last"]]["end"]))
    end_of_file = F.array(interval(F.size("lines") + 1, F.size("lines") + 1))
    taken = F.sort_array(F.concat(F.filter(F.concat(whole_types, heads, in_bins), lambda x: x.isNotNull()), end_of_file))

    def gap(s: Column, x: Column) -> Column:
        found = F.when(x["start"] > s["reach"] + 1, F.concat(s["gaps"], F.array(interval(s["reach"] + 1, x["start"] - 1)))).otherwise(s["gaps"])
        return F.struct(F.greatest(s["reach"], x["end"]).alias("reach"), found.alias("gaps"))

    zero = F.expr("named_struct('reach', 0, 'gaps', cast(array() as array<struct<start:int,end:int>>))")
    text_in = lambda g: F.exists(F.slice("lines", g["start"], g["end"] - g["start"] + 1), lambda x: F.rlike(x, F.lit(r"\S")))
    df = df.withColumn("gaps", F.filter(F.aggregate(taken, zero, gap, lambda s: s["gaps"]), text_in))

    def lines_of_gap(g: Column, k: Column) -> Column:
        return numbered_lines(-2 - k, g["start"], g["end"])

    whole = numbered_lines(F.lit(-1), F.lit(1), F.size("lines"))
    parted = F.concat(F.flatten(F.transform("big", lines_of_big)), F.flatten(F.transform("gaps", lines_of_gap)))
    df = df.withColumn("cuttable", F.when(F.col("gives"), parted).otherwise(whole))
    df = df.withColumn("line_costs", o.measure.of_each(F.transform("cuttable", lambda x: F.concat(F.get("lines", x["no"] - 1), F.lit("\n")))))
    df = df.withColumn("priced", F.transform("cuttable", lambda x, i: F.struct(x["unit"].alias("unit"), F.col("line_costs")[i].alias("cost"))))
    df = df.withColumn("cuts", bins_of(F.col("priced"), "cost", "unit", m))

    path = F.col("relative_path")

    def piece(level: str, start: Column, part: Column, suffix: Column, content: Column, tokens: Column, classes: Column, functions: Column) -> Column:
        return F.struct(
            start.cast("long").alias("start"), part.cast("long").alias("part"),
            F.concat(path, F.lit(":"), suffix).alias("chunk_id"), content.alias("content"),
            tokens.cast("long").alias("token_count"), classes.alias("class_names"), functions.alias("function_names"),
            F.lit(level).alias("level"),
        )

    first_part = F.lit(0)
    none = F.expr(NO_NAMES)
    types = F.filter(
        F.transform("spans", lambda s, i: F.when(
            F.col("type_tokens")[i] <= m,
            piece("type", s["start"], first_part, s["name"], _joined(F.col("lines"), s["start"], s["end"]), F.col("type_tokens")[i],
                  F.array(s["name"]), F.transform(s["functions"], lambda f: f["name"])),
        ).when(
            F.col("header_tokens")[i] > o.header_min_tokens,
            piece("header", s["start"], first_part, F.concat(s["name"], F.lit(":header")), _joined(F.col("lines"), F.col("headers")[i]["start"], F.col("headers")[i]["end"]),
                  F.col("header_tokens")[i], F.array(s["name"]), none),
        )),
        lambda x: x.isNotNull(),
    )

    def group_piece(b: Column, i: Column) -> Column:
        first, last = F.col("fns")[b["first"]], F.col("fns")[b["last"]]
        names = F.transform(F.slice("fns", b["first"] + 1, b["last"] - b["first"] + 1), lambda f: f["name"])
        return piece(
            "functions", first["start"], first_part,
            F.concat(first["type_name"], F.lit(":"), first["name"], F.lit("-"), last["name"]),
            _joined(F.col("lines"), first["start"], last["end"]), F.col("group_tokens")[i], F.array(first["type_name"]), names,
        )

    def line_piece(b: Column, j: Column) -> Column:
        unit, tokens = b["unit"], b["cost"]
        content = _joined(F.col("lines"), F.col("cuttable")[b["first"]]["no"], F.col("cuttable")[b["stop"] - 1]["no"])
        before = b["nth"]  # pieces are numbered within their function, or within the file
        fn, hole = F.get(F.col("fns"), unit), F.get(F.col("gaps"), -2 - unit)
        return F.when(
            unit == -1, piece("lines", F.lit(1), j, F.concat(F.lit("lc"), j.cast("string")), content, tokens, none, none)
        ).when(
            unit < -1,
            piece("rest", hole["start"], before, F.concat(F.lit("rest"), hole["start"].cast("string"), F.lit("-"), before.cast("string")),
                  content, tokens, none, none),
        ).otherwise(
            piece("function_part", fn["start"], before,
                  F.concat(fn["type_name"], F.lit(":"), fn["name"], F.lit(":f"), before.cast("string")),
                  content, tokens, F.array(fn["type_name"]), F.array(fn["name"])),
        )

    pieces = F.concat(types, F.transform("groups", group_piece), F.transform("cuts", line_piece))
    lines_only = F.filter(F.transform("cuts", line_piece), lambda x: x.isNotNull())
    df = df.withColumn("pieces", F.sort_array(F.when(F.col("gives"), pieces).otherwise(lines_only)))
    numbered = F.transform("pieces", lambda x, i: F.struct(
        i.cast("long").alias("ordinal"), *[x[c].alias(c) for c in ("chunk_id", "content", "token_count", "class_names", "function_names", "level")]
    ))
    # The outer form: a plain inline() would infer the filter size(pieces) > 0, which Spark pushes down
    # through every step above, computing the whole cut a second time as one nested expression.
    return df.select(
        "relative_path", F.array("relative_path").alias("source_files"), "language", F.inline_outer(numbered)
    ).select(*CHUNK_COLUMNS)


def typed_chunks(files: DataFrame, spans: DataFrame, o: Options | None = None) -> DataFrame:
    """Oversize files cut along their declarations; a file without any, by lines."""
    o = o or Options()
    joined = oversize(files, o).drop("tokens").join(spans, "relative_path", "left")
    return cut(joined.withColumn("spans", F.coalesce("spans", F.expr(NO_SPANS))), o)


def chunk(files: DataFrame, o: Options | None = None) -> DataFrame:
    """Source files to chunks: whole where they fit, else along declarations, else by lines.

    A column ``tokens`` of ``files`` is taken as their counts. Only files above the budget are read for declarations, even
    if these are known already: that costs less than gathering the declarations of all files by path.
    """
    o = o or Options()
    spans = declarations.file_spans(oversize(files, o))
    return whole_file_chunks(files, o).unionByName(typed_chunks(files, spans, o))


def batched(chunks: DataFrame, group_key: str | None = None, o: Options | None = None) -> DataFrame:
    """Chunks with the small ones merged into packs."""
    o = o or Options()
    return merge_packs(packing.assign_packs(chunks, group_key, o), chunks, o)


merge_packs = packing.merge_packs
