"""Inputs for the registered queries, derived row by row from the given tables.

Nothing here groups or collects: every derived file or text comes from one input row, so
the inputs grow with the tables and no key can gather them in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.texts import choose
from corpusmill.sources.files import scan_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Slim rows, by their key ``k``, to as many tasks as there are cores or shuffle partitions: each grows into a whole
    file there. No text moves, and the number of input splits doesn't matter."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as text files ``source/lang/doc_<id>.txt``."""
    docs = table(spark, sf_dir, "documents")
    return scan_table(docs, "text", "concat(source, '/', lang, '/doc_', doc_id, '.txt')")


ROUTED_SUFFIXES = (".java", ".py", ".rs", ".xml", ".md", ".png", ".lock", "", "/tsconfig.json", ".js")


def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` under many suffixes, with skip directories, markers, control characters and one-liners."""
    docs = table(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(*[F.lit(s) for s in ROUTED_SUFFIXES]), (F.col("doc_id") % 10 + 1).cast("int"))
    path = F.concat(
        "source", F.lit("/"),
        F.when(F.col("doc_id") % 17 == 0, "build/").otherwise(""),
        "lang", F.lit("/doc_"), "doc_id", suffix,
    )
    text = F.concat(
        F.when(F.col("doc_id") % 13 == 0, "// Code Generated By a tool\n").otherwise(""),
        F.when(F.col("doc_id") % 19 == 0, F.repeat(F.lit("\x01"), 2000)).otherwise(""),
        F.when(
            F.col("doc_id") % 7 == 0, F.replace("text", F.lit("\n"), F.lit(" "))
        ).otherwise(F.col("text")),
    )
    return scan_table(docs, text, path)


def dirty_text(text: Column, key: Column) -> Column:
    """Trailing blanks, runs of line feeds at the ends and inside, by the key."""
    run = F.repeat(F.lit("\n"), (key % 7).cast("int"))
    inner = F.replace(text, F.lit("\n"), F.concat(F.when(key % 3 == 0, " \t ").otherwise(""), F.lit("\n"), run))
    return F.concat(run, inner, F.when(key % 5 == 0, "  ").otherwise(""), run)


METHODS_PER_FILE = 7
CODE_LANGUAGES = ("java", "python", "go", "javascript", "typescript")


def code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: ``k`` the key, ``n`` the number of methods, ``lang`` by ``k % 5``."""
    orders = table(spark, sf_dir, "orders")
    return spread(orders.select(
        F.col("o_orderkey").alias("k"),
        (F.col("o_custkey") % METHODS_PER_FILE + 1).cast("int").alias("n"),
        F.element_at(F.array(*[F.lit(x) for x in CODE_LANGUAGES]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("lang"),
    ))


def _methods(template: str) -> Column:
    """``n`` copies of a template, ``{i}`` and ``{k}`` filled in."""
    def one(i: Column) -> Column:
        with_i = F.replace(F.lit(template), F.lit("{i}"), i.cast("string"))
        return F.replace(with_i, F.lit("{k}"), F.col("k").cast("string"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), one), "")


JAVA_HEAD = (
    "package com.shop.o{m};\n\nimport java.util.List;\nimport static java.lang.Math.max;\n\n"
    "/**\n * Lines of one order.\n */\n@RestController\n@RequestMapping(\"/orders{k}\")\n\n"
    "public class Order{k}Controller extends BaseOrder implements Readable, Comparable<Order{k}Controller> {\n"
    "    private final int total = {k};\n    private List<String> names;\n\n"
    "    // class of its own: { not counted\n"
    "    public Order{k}Controller(int total) {\n        this.total = total;\n    }\n\n"
)
JAVA_METHOD = (
    "    @GetMapping(\"/lines/{i}\")\n"
    "    public long line{i}(@Param(\"q\") int quantity,\n            List<String> tags) throws Exception {\n"
    "        String s = \"} {\";\n        if (quantity > {i}) {\n            return {k};\n        }\n"
    "        return price(quantity);\n    }\n\n"
)
JAVA_TAIL = "    private void close()\n    {\n        done();\n    }\n}\n"

PY_HEAD = (
    "import os\nfrom typing import (\n    List,\n    Dict,\n)\n\n\n"
    "@dataclass\nclass Order{k}(Base, Mixin):\n    \"\"\"Lines of one order.\n\n  class of text\n    \"\"\"\n\n"
    "    def __init__(self, total):\n        self.total = total\n\n"
)
PY_METHOD = (
    "    @cached\n    async def line{i}(self, quantity: int,\n            tags=None) -> int:\n"
    "        if quantity > {i} and tags:\n            return {k}\n        def inner(x):\n            return x\n"
    "        return \"\"\"def no\n\"\"\"\n\n"
)
PY_TAIL = "    def _close(self): return None\n\n\ndef helper(x):\n    return x\n"

GO_HEAD = (
    "package orders{m}\n\nimport (\n\t\"fmt\"\n\tlog \"std/log\"\n)\n\n"
    "// Order holds lines.\ntype Order{k} struct {\n\tID int `json:\"id\"`\n\tNames []string\n}\n\n"
    "type Reader{k} interface {\n\tRead() error\n}\n\n"
)
GO_METHOD = (
    "func (o *Order{k}) Line{i}(quantity int, tags []string) (int, error) {\n"
    "\tif quantity > {i} {\n\t\treturn {k}, nil\n\t}\n\tfmt.Println(\"}\")\n\treturn 0, nil\n}\n\n"
)
GO_TAIL = "func (x Stranger) Lost() {\n}\n\nfunc helper(n int) int { return n }\n"

JS_HEAD = (
    "import { a,\n  b } from 'shop';\nimport c from \"cart\";\n\n"
    "export class Order{k} extends BaseOrder {\n  constructor(total) {\n    this.total = total;\n  }\n\n"
)
JS_METHOD = (
    "  async line{i}(quantity, tags) {\n    if (quantity > {i}) {\n      return `{k} ${quantity} }`;\n    }\n"
    "    for (const t of tags) { log(t); }\n    return 0;\n  }\n\n"
)
JS_TAIL = "  close() { return null; }\n}\n\nexport function helper(x) {\n  return x;\n}\n"
TS_HEAD = (
    "import { a } from 'shop';\n\nexport interface Line{k} {\n  id: number;\n}\n\n"
    "export abstract class Order{k} extends BaseOrder implements Readable {\n"
    "  constructor(private total: number) {\n  }\n\n"
)
TS_METHOD = (
    "  public line{i}(quantity: number, tags: string[]): number {\n    if (quantity > {i}) {\n"
    "      return {k};\n    }\n    return 0;\n  }\n\n"
)
TS_TAIL = "}\n"

CODE_PATHS = {
    "java": "src/main/java/com/shop/o{m}/Order{k}Controller.java",
    "python": "app{m}/python/shop/orders/order{k}.py",
    "go": "pkg/orders{m}/order{k}.go",
    "javascript": "web/src/orders{m}/order{k}.js",
    "typescript": "web/lib/orders{m}/order{k}.ts",
}
CODE_TEMPLATES = {
    "java": (JAVA_HEAD, JAVA_METHOD, JAVA_TAIL),
    "python": (PY_HEAD, PY_METHOD, PY_TAIL),
    "go": (GO_HEAD, GO_METHOD, GO_TAIL),
    "javascript": (JS_HEAD, JS_METHOD, JS_TAIL),
    "typescript": (TS_HEAD, TS_METHOD, TS_TAIL),
}


def _filled(template: str) -> Column:
    with_k = F.replace(F.lit(template), F.lit("{k}"), F.col("k").cast("string"))
    return F.replace(with_k, F.lit("{m}"), (F.col("k") % 20).cast("string"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per order, in five languages, with ``n`` numbered methods each."""
    rows = code_rows(spark, sf_dir)
    content = choose(
        F.col("lang"),
        {x: F.concat(_filled(head), _methods(method), _filled(tail)) for x, (head, method, tail) in CODE_TEMPLATES.items()},
    )
    path = choose(F.col("lang"), {x: _filled(p) for x, p in CODE_PATHS.items()})
    return scan_table(rows, content, path)


# Types in types, bodies on one line, groups, and annotations over several lines.
NESTED_TEMPLATES = {
    "java": (
        "package com.shop.n{m};\n\n/**\n * Lots of one part.\n */\n@Service\n@RequestMapping(\n    value = \"/parts{k}\",\n"
        "    produces = {\"text/plain\", \"a;b\"}\n)\n"
        "public class Part{k} { int low, high = max(1, 2), top; void reset() { low = 0; }\n\n"
        "    public static class Lot { long id; long id() { return id; } }\n\n"
        "    enum State { NEW, SOLD; boolean open() { return this == NEW; } }\n\n",
        "    @GetMapping(\n        path = \"/lots/{i}\",\n        params = {\"x\", \"y\"})\n"
        "    public String lot{i}(@Param(\"q\") String q) { if (q != null) { return q; } return \"}\"; }\n",
        "}\n",
    ),
    "python": (
        "@register(\n    \"part{k}\",\n    kinds=[\"a\", \"b\"],\n)\nclass Part{k}(Base):\n    \"\"\"Lots of one part.\"\"\"\n"
        "    class Lot:\n        def size(self): return 1\n\n        def name(self):\n            return \"x\"\n\n",
        "    @cached(\n        ttl={i},\n    )\n    def lot{i}(self, q=(1, 2)): return q\n\n",
        "",
    ),
    "go": (
        "package parts{m}\n\n// Kinds of parts.\ntype (\n\t// Part is one of them.\n\tPart{k} struct {\n\t\tID, Size int\n\t\tNames []string\n\t}\n"
        "\tLister{k} interface { List() []string }\n\tCount{k} int\n)\n\n",
        "func (p *Part{k}) Lot{i}() int { return p.ID }\n",
        "func free{k}() { }\n",
    ),
    "typescript": (
        "@Component({\n  selector: 'part', items: ['a;', '}'],\n})\nexport class Part{k} { size() { return 1; }\n"
        "  constructor(private n: number) { this.n = n; }\n\n",
        "  @Input()\n  lot{i}(q: string): string { if (q) { return q; } return '}'; }\n",
        "}\n",
    ),
}
NESTED_PATHS = {
    "java": "src/main/java/com/shop/n{m}/Part{k}.java", "python": "app{m}/python/shop/parts/part{k}.py",
    "go": "pkg/parts{m}/part{k}.go", "typescript": "web/lib/n{m}/part{k}.ts",
}


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per part, in four languages, with ``n`` numbered methods each."""
    langs = F.array(*[F.lit(x) for x in NESTED_TEMPLATES])
    rows = spread(table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), (F.col("p_size") % 5 + 1).cast("int").alias("n"),
        F.element_at(langs, (F.col("p_partkey") % 4 + 1).cast("int")).alias("lang"),
    ))
    content = choose(
        F.col("lang"),
        {x: F.concat(_filled(head), _methods(method), _filled(tail)) for x, (head, method, tail) in NESTED_TEMPLATES.items()},
    )
    path = choose(F.col("lang"), {x: _filled(p) for x, p in NESTED_PATHS.items()})
    return scan_table(rows, content, path)


LONG_DOCSTRING = 2_500


def long_docstring_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python file per supplier whose class has a docstring of LONG_DOCSTRING lines, below a decorator far above it."""
    rows = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))
    body = F.repeat(F.lit("    A line of it.\n"), LONG_DOCSTRING - 1)
    head, tail = "@known\n\n\n\n\n\n\n\n\n\n\n\n\nclass Supplier{k}:\n    \"\"\"First.\n", "    \"\"\"\n    def go(self): return {k}\n"
    return scan_table(rows, F.concat(_filled(head), body, _filled(tail)), F.concat(F.lit("app/python/supplier"), "k", F.lit(".py")))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document, priced at a quarter token per character."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/doc_"), "doc_id", F.lit(".txt"))
    return docs.select(
        path.alias("relative_path"), F.col("doc_id").alias("ordinal"), F.concat(path, F.lit(":full")).alias("chunk_id"),
        F.col("text").alias("content"), F.ceil(F.col("n_chars") / 4).alias("token_count"), F.array(path).alias("source_files"),
        F.col("lang").alias("language"), F.expr("if(doc_id % 2 = 0, array('A', 'B'), array())").alias("class_names"),
        F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 20).cast("int")), lambda i: F.concat(F.lit("f"), i.cast("string"))).alias("function_names"),
        "doc_id", "source", "n_chars",
    )


def store_entries(keyed: DataFrame) -> DataFrame:
    """Entries for every third chunk: an empty object for every thirtieth, a stale second entry for
    every sixth, and an unreadable one for every twenty-first."""
    some = keyed.filter("doc_id % 3 = 0")
    new = some.select(
        "cache_key",
        F.expr("CASE WHEN doc_id % 30 = 0 THEN '{}' WHEN doc_id % 21 = 0 THEN '{\"cut' "
               "ELSE concat('{\"complexity_score\":', doc_id % 10 + 1, '}') END").alias("payload"),
        F.expr("timestamp'2024-02-02 00:00:00'").alias("written_at"),
    )
    old = some.filter("doc_id % 6 = 0 AND doc_id % 21 <> 0").select(
        "cache_key", F.lit('{"complexity_score":0}').alias("payload"), F.expr("timestamp'2024-01-01 00:00:00'").alias("written_at")
    )
    return new.unionByName(old)


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events.props`` mangled by ``event_id % 8``."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(r"""CASE event_id % 8
            WHEN 0 THEN props
            WHEN 1 THEN concat('Here it is:\n```json\n', props, '\n```\nDone.')
            WHEN 2 THEN concat(substr(props, 1, length(props) - 1), ',}')
            WHEN 3 THEN concat(substr(props, 1, length(props) - 1), ' // the key\n}')
            WHEN 4 THEN concat('The result is ', props, ' as asked.')
            WHEN 5 THEN concat('  ', substr(props, 1, length(props) - 1))
            WHEN 6 THEN ''
            ELSE 'no object here' END""").alias("raw"),
    )


def analysis_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON analyses from ``documents`` and ``labels``: quoted numbers, unknown and missing keys."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    method = "named_struct('name', concat('m', doc_id), 'signature', lang, 'complexity', cast(n_chars % 10 as string), 'extra', 1)"
    score = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('', n_chars % 10 + 1) WHEN 2 THEN 'high' ELSE concat('', coalesce(quality, 3)) END"
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.expr(
            f"to_json(named_struct('file_path', concat(source, '/', doc_id), 'summary', if(doc_id % 5 = 0, NULL, lang), "
            f"'key_methods', if(doc_id % 3 = 0, NULL, array({method})), 'dependencies', array(source, lang), "
            f"'complexity_score', {score}, 'unknown', 7))"
        ).alias("payload"),
    )


SCRIPT_TEMPLATES = {
    "python": ("", "def f{i}(a, b):\n    return a\n\n\n", "x = 1\n"),
    "javascript": ("", "function f{i}(a) {\n  return a;\n}\n", ""),
    "ruby": ("# Users\nclass User{k}\n", "  def m{i}(x)\n    go if ready(x)\n  end\n", "end\n"),
    "rust": ("", "fn calc{i}(x: i32) -> i32 {\n    x + 1\n}\n", ""),
}
SCRIPT_PATHS = {
    "python": "tools/script{k}.py", "javascript": "lib/tools/util{k}.js", "ruby": "app/user{k}.rb", "rust": "src/calc{k}.rs",
}


REGEX_TEMPLATE = (
    "class Scan{k} {\n  quotes(x) { return x.replace(/[\"'`{]/g, '{'); }\n  braces(x) {\n    const r = /\\/{{k}}`/;\n"
    "    return r.test(x) ? 1 : x / 2 / {k};\n  }\n  last() { return /}/.source; }\n}\nclass Next{k} {\n}\n"
)


def regex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One script per part whose regular expressions hold quotes, backticks, braces and slashes."""
    rows = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")))
    return scan_table(rows, _filled(REGEX_TEMPLATE), F.concat(F.lit("lib/scan"), "k", F.lit(".js")))


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per part: functions without a type, and languages without rules of their own."""
    langs = F.array(*[F.lit(x) for x in SCRIPT_TEMPLATES])
    rows = spread(table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), (F.col("p_size") % 5 + 1).cast("int").alias("n"),
        F.element_at(langs, (F.col("p_partkey") % 4 + 1).cast("int")).alias("lang"),
    ))
    content = choose(
        F.col("lang"),
        {x: F.concat(_filled(head), _methods(method), _filled(tail)) for x, (head, method, tail) in SCRIPT_TEMPLATES.items()},
    )
    path = choose(F.col("lang"), {x: _filled(p) for x, p in SCRIPT_PATHS.items()})
    return scan_table(rows, content, path)
