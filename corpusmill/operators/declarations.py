"""Declarations of a whole corpus: types, functions, fields and imports.

A file is cut into statements that know the statement around them (``statements``). What stands in a type or in no block
at all may declare something; only these statements leave the file's row, one by one, and are read by expressions. No
line is looked for outside a statement: annotations, comments and arguments are part of it, however long they are.
Nothing is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import fixed_values as fv
from corpusmill.functions import texts
from corpusmill.functions.texts import choose
from corpusmill.operators import reading
from corpusmill.operators import statements as st

# --- patterns, on text whose strings and comments are blanked -----------------------------------
# Possessive groups keep matching iterative, so long texts cannot exhaust the stack.


def _inside(openers: str, closers: str, deep: int = st.NESTED) -> str:
    """What may stand between brackets: their own brackets match, ``deep`` deep."""
    text = rf"[^{openers}{closers}]*+"
    for _ in range(deep - 1):
        text = rf"(?:[^{openers}{closers}]++|[{openers}]{text}[{closers}])*+"
    return text


_ARGS = _inside("(", ")")
_NOTE = rf"@(?!interface\b)[\w.]++(?:\s*+\({_ARGS}\))?+"
_NOTES = rf"(?:{_NOTE}\s*+)*+"
_JAVA_MODS = (
    r"((?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|transient|volatile|sealed|non-sealed)\s++)*+)"
)
_JAVA_WORDS = r"(?!(?:if|for|while|switch|catch|return|throw|new|else|try|do|case|assert|super|this|package|import|break|continue|goto|yield)\b)"
_JAVA_TYPE = r"([\w$.]+(?:\s*<[^()=;]*>)?(?:\s*\[\s*\])*(?:\.\.\.)?)"
JAVA_TYPE = rf"^\s*+{_NOTES}{_JAVA_MODS}(class|interface|enum|record|@interface)\s+([\w$]+)([^{{]*)"
JAVA_FUNCTION = (
    rf"^(\s*+{_NOTES}{_JAVA_WORDS}{_JAVA_MODS}(?:<[^()=;]*>\s*)?(?:{_JAVA_TYPE}\s+)?{_JAVA_WORDS}([\w$]+)\s*\()({_ARGS})\)"
    r"\s*(?:throws\s[^{;]*)?(?:default\s[^;]*)?([{;]|\z|\n)"
)
JAVA_FIELD_TYPE = rf"^\s*+{_NOTES}{_JAVA_WORDS}{_JAVA_MODS}{_JAVA_TYPE}\s+"
JAVA_FIELD = JAVA_FIELD_TYPE + r"([\w$]+)\s*(?:=|;|,|\[|$)"
JAVA_IMPORT = r"^\s*import\s+([^;]+?)\s*(?:;|$)"
JAVA_PACKAGE = r"^\s*package\s+([\w.]+)"

PYTHON_TYPE = rf"^class\s+(\w+)\s*(?:\[[^\]]*\])?\s*(?:\(({_ARGS})\))?\s*:"
PYTHON_FUNCTION = rf"^(\s*(async\s+)?def\s+(\w+)\s*(?:\[[^\]]*\])?\()({_ARGS})\)\s*(?:->\s*([^:]+?))?\s*:"
PYTHON_IMPORT = r"(?s)^(?:import\s[^\n]*|from\s[^\n(]*\([^)]*\)|from\s[^\n]*)"

GO_TYPE = r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)?"
GO_METHOD = rf"^(func\s*\(([^()]*)\)\s*(\w+)\s*\()({_ARGS})\)"
GO_FUNCTION = rf"^(func\s+(\w+)\s*(?:\[[^\]]*\])?\()({_ARGS})\)"
GO_FIELD = r"^(\w+(?:\s*,\s*\w+)*+)\s+([\w.*\[\]{}<\-]+(?:\s*\{\s*\})?)"

_JS_EXPORT = r"\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
JS_CLASS = rf"^{_JS_EXPORT}(?:abstract\s+)?class\s+([\w$]+)([^{{]*)"
JS_INTERFACE = rf"^{_JS_EXPORT}interface\s+([\w$]+)"
JS_FUNCTION = rf"^({_JS_EXPORT}(?:async\s+)?function\s*\*?\s*([\w$]+)\s*(?:<[^(]*>)?\s*\()({_ARGS})\)"
JS_METHOD = (
    rf"^(\s*+{_NOTES}((?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s++)*+)\*?\s*"
    r"(?!(?:if|for|while|switch|catch|return|function|new|super|with|await|yield|throw|typeof)\b)"
    rf"([\w$]+)\s*(?:<[^(]*>)?\s*\()({_ARGS})\)\s*(?::\s*([^{{;=]+?))?\s*(?:\{{|\z|\n)"
)
JS_IMPORT = r"(?s)^import\b[^'\";]*['\"][^'\"\n]*['\"];?"

#: A type in a Go group; a name and what may begin a type.
GO_SPEC = r"^(\w+)(?:\[[^\]]*\])?\s+=?\s*+(?:(struct|interface)\b|[\w*\[(<])"
GO_GROUP = r"^(?:type|import)\s*+\($"
# A language without rules of its own: a type is a kind's word and the word after it; a function is a word between
# another word, or the end of its type, and an opening bracket.
_KIND = rf"\b({'|'.join(fv.GENERIC_TYPE_KINDS)})\s+(\w+)"
_CALLABLE = r"(?<=[\w>\]])\s+(\w+)\s*\("

NO_TEXTS = "cast(array() as array<string>)"
_NOTE_RAW = {
    "java": rf"(?s){st.COMMENT}|@(?!interface\b)[\w.]++(?:\s*+{st.LISTS['java']})?+",
    "js": rf"(?s){st.COMMENT}|@[\w.]++(?:{st.LISTS['js']})?+",
    "python": rf"(?s)#[^\n]*+|@{st.PYTHON_LINE}",
}
#: The comment right above a head; the string that a Python body begins with.
COMMENT_ABOVE = r"(?s)\n([ \t]*+(?:/\*(?:[^*]++|\*(?!/))*+\*/[ \t\r]*+\n)?+(?:[ \t]*+(?://|#)[^\n]*+\n)*+)[ \t]*+\z"
_LONG = "|".join(rf"{q * 3}((?:[^{q}\\]++|\\.|{q}(?!{q}{q}))*+){q * 3}" for q in "\"'")
_SHORT = "|".join(rf"{q}([^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+){q}" for q in "\"'")
DOCSTRING = rf"(?s)\A\s*+[rRuUbB]{{0,2}}(?:{_LONG}|{_SHORT})"
_JAVA_NOTED = rf"(?s)^(?:\s++|{st.COMMENT}|@(?!interface\b)[\w.]++(?:\s*+{st.LISTS['java']})?+)*+"


class Declared(NamedTuple):
    types: DataFrame
    functions: DataFrame
    fields: DataFrame
    imports: DataFrame


def like(c: Column, p: str) -> Column:
    return F.rlike(c, F.lit(p))


def get(c: Column, p: str, g: int) -> Column:
    return F.regexp_extract(c, p, g)


def _blanked(files: DataFrame) -> DataFrame:
    """Per file: ``raw_lines`` and ``code_lines`` (strings and comments blanked)."""
    df = files.select("relative_path", "language", "content", st.family_of(F.col("language")).alias("family"))
    code = choose(F.col("family"), {f: st.masked(F.col("content"), f) for f in st.LEXEMES}, F.col("content"))
    return df.withColumn("raw_lines", texts.lines_of(F.col("content"))).withColumn("code_lines", texts.lines_of(code))


def explode_lines(files: DataFrame) -> DataFrame:
    """(path, language, line_no from 1, raw, code): ``code`` has strings and comments blanked."""
    lines = _blanked(files).withColumn(
        "lines", F.transform("code_lines", lambda c, i: F.struct((i + 1).alias("line_no"), F.get(F.col("raw_lines"), i).alias("raw"), c.alias("code")))
    )
    return lines.select("relative_path", "language", F.inline_outer("lines"))


# --- statements that may declare something -------------------------------------------------------


def _js_type(code: Column) -> Column:
    return like(code, JS_CLASS) | (F.col("language").isin("typescript", "tsx") & like(code, JS_INTERFACE))


#: Whether a head, which begins with its first word, declares a type; by family.
IS_TYPE = {
    "java": lambda c: like(c, r"\b(?:class|interface|enum|record)\s") & like(c, JAVA_TYPE) & F.endswith(c, F.lit("{")),
    "python": lambda c: F.startswith(c, F.lit("class")) & like(c, PYTHON_TYPE),
    "go": lambda c: F.startswith(c, F.lit("type")) & like(c, GO_TYPE),
    "js": _js_type,
    "generic": lambda c: like(c, _KIND),
}


def _receiver(code: Column) -> Column:
    words = F.split(F.btrim(get(code, GO_METHOD, 2), F.lit(" ")), r"\s+")
    return F.ltrim(F.regexp_replace(F.element_at(words, -1), r"\[.*$", ""), F.lit("*"))


def _go_key(code: Column) -> Column:
    """The name under which a Go type and its methods meet."""
    named = F.coalesce(F.nullif(get(code, GO_TYPE, 1), F.lit("")), F.nullif(get(code, GO_SPEC, 1), F.lit("")))
    return F.when(F.startswith(code, F.lit("func")), F.when(like(code, GO_METHOD), _receiver(code))).when(like(code, r"^type\s"), get(code, GO_TYPE, 1)).otherwise(named)


def _generic_functions(code: Column) -> Column:
    return F.filter(F.regexp_extract_all(code, F.lit(_CALLABLE), F.lit(1)), lambda n: ~n.isin(*fv.GENERIC_NOT_FUNCTIONS))


#: Whether a head declares a function; by family.
IS_FUNCTION = {
    "java": lambda c: F.contains(c, F.lit("(")) & like(c, JAVA_FUNCTION),
    "python": lambda c: like(c, PYTHON_FUNCTION),
    "go": lambda c: F.startswith(c, F.lit("func")) & (like(c, GO_METHOD) | like(c, GO_FUNCTION)),
    "js": lambda c: F.contains(c, F.lit("(")) & like(c, JS_FUNCTION),
    "generic": lambda c: F.size(_generic_functions(c)) > 0,
}


def declaring(files: DataFrame) -> DataFrame:
    """One row for each statement of the file's own or of a type's: its head, as it is and blanked, what stands before it,
    its numbers, and the head of the type around it."""
    kinds = {"go": {st.GROUP: lambda c: like(c, GO_GROUP), st.OWN: lambda c: F.startswith(c, F.lit("func")) & like(c, GO_FUNCTION), st.SPEC: lambda c: like(c, GO_SPEC)}}
    df = st.statements(files, IS_TYPE, kinds, {"go": _go_key}).withColumn("guessed", texts.guess_package(F.col("relative_path")))
    family = F.col("family")
    packages = F.filter("heads", lambda h: F.startswith(h, F.lit("package ")))
    package = F.when(family.isin("java", "go"), F.nullif(get(F.get(packages, F.lit(0)), JAVA_PACKAGE, 1), F.lit("")))

    def first_free(f: str) -> Column:
        """Place of the first function outside all blocks."""
        head = lambda s, i: s if f == "generic" else F.get("heads", i) if f == "python" else st.head_of(s, f)
        free = lambda s, i: F.when(((st.number(i, st.PARENT) == st.TOP) | F.lit(f == "generic")) & IS_FUNCTION[f](head(s, i)), i)
        return F.array_min(F.transform("raw", free))

    free = {f: first_free(f) for f in ("python", "js", "generic")}
    df = df.withColumns(
        {"package": F.coalesce(package, "guessed"), "n_types": st.count_of_types(), "first_free": F.when(st.count_of_types() == 0, choose(family, free))}
    )

    def row(s: Column, i: Column) -> Column:
        around = st.number(i, st.PARENT)
        group = F.when(around < st.INSIDE, F.get("heads", st.FIRST_GROUP - around))
        return F.when(
            (around != st.INSIDE) & ~like(s, r"^[\s{};)]*+$"),
            F.struct(
                i.alias("i"), s.alias("text"), st.number(i, st.LINE).alias("begin"), st.number(i, st.END).alias("end"), st.number(i, st.NUMBER).alias("number"),
                F.when(around >= 0, F.get("heads", around)).alias("around"), group.alias("group"),
                ((i == 0) | F.endswith(F.get("raw", i - 1), F.lit("\n"))).alias("on_new_line"),
                F.when((family == "python") & F.startswith(F.get("heads", i), F.lit("class")), F.get("raw", i + 1)).alias("next"),
            ),
        )

    df = df.withColumn("rows", F.filter(F.transform("raw", row), lambda r: r.isNotNull()))
    # The outer form keeps Spark from computing the rows twice for an inferred size filter; a file's arrays stay behind.
    slim = ("relative_path", "language", "family", "package", "n_lines", "n_types", "first_free")
    df = st.parted(df.select(*slim, F.inline_outer("rows")).filter(F.col("i").isNotNull()))
    by_braces = family.isin("java", "go", "js")
    line = F.col("begin") + F.when(by_braces, texts.newline_count(F.col("before"))).otherwise(0)
    end = F.when(by_braces & ~F.substring("code", -1, 1).isin("{", "("), line + texts.newline_count(F.rtrim("code", F.lit(st.WHITE)))).otherwise(F.col("end"))
    below = F.when(F.col("next").isNotNull(), F.substr("next", F.length(F.regexp_extract(st.code_of(F.col("next"), "python"), st.LEADS["python"], 0)) + 1))
    return df.withColumns({"line_no": line.cast("int"), "end_line": end.cast("int"), "below": below}).drop("begin", "end", "next")


def _comment() -> Column:
    """Text of the comment that ends right above a head, without its markers; it begins on a line of its own."""
    before = F.col("before")
    lines = F.when(F.col("on_new_line"), F.concat(F.lit("\n"), before)).otherwise(before)
    one = lambda x: F.when(like(x, "^(?://|#)"), F.ltrim(x, F.lit("#/ "))).otherwise(x)
    found = F.transform(F.split(F.btrim(get(lines, COMMENT_ABOVE, 1), F.lit("\r\n")), "\n"), lambda x: one(F.btrim(x, F.lit(" \t\r"))))
    text = F.replace(F.replace(F.array_join(found, "\n"), F.lit("/**"), F.lit("")), F.lit("*/"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, r"/\*", ""), r"(?m)^\*+ ?", "")
    return F.btrim(bare, F.lit(" \t\n"))


def _docstring(below: Column) -> Column:
    """The string that a Python class body begins with."""
    text = F.coalesce(below, F.lit(""))
    return F.btrim(F.concat(*[get(text, DOCSTRING, g) for g in range(1, 5)]), F.lit(" \t\n"))


# --- one statement -> what it declares -----------------------------------------------------------


def _split_list(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern, -1), lambda p: F.btrim(p, F.lit(" \t\n"))), lambda p: p != "")


def _names_of(code: Column, begin: Column) -> Column:
    """Names of a Java field's declarators; ``begin`` is the text up to the first one."""
    rest = F.substr(code, F.length(begin) + 1)
    for pair in (r"\([^()]*+\)", r"\([^()]*+\)", r"<[^<>()=;]*+>", r"<[^<>()=;]*+>", r"\[[^\[\]]*+\]"):
        rest = F.regexp_replace(rest, pair, "")
    return F.filter(F.transform(F.split(rest, ","), lambda x: get(x, r"^\s*+([\w$]+)", 1)), lambda x: x != "")


def _tag() -> Column:
    """What a statement declares, if anything."""
    code, raw, family = F.col("code"), F.col("raw"), F.col("family")
    types = {f: test(code) for f, test in IS_TYPE.items()}
    functions = {f: test(code) for f, test in IS_FUNCTION.items()}
    outside, grouped = F.col("around").isNull() & F.col("group").isNull(), F.col("group").isNotNull()
    java = (
        F.when(types["java"], "type")
        .when(~outside & functions["java"], "function")
        .when(outside & like(code, r"^import\s"), "import")
        .when(~outside & like(code, JAVA_FIELD), "field")
    )
    python = F.when(types["python"], "type").when(functions["python"], "function").when(outside & like(code, r"^(?:import|from)\s"), "import")
    go = (
        F.when(outside & types["go"], "type")
        .when(grouped & F.startswith(F.col("group"), F.lit("type")) & like(code, GO_SPEC), "type")
        .when(outside & like(code, GO_METHOD), "method")
        .when(outside & like(code, GO_FUNCTION), "function")
        .when((outside & like(code, r"^import\s*+[^\s(]")) | (grouped & F.startswith(F.col("group"), F.lit("import")) & F.contains(raw, F.lit('"'))), "import")
        .when(~outside & ~grouped & like(code, GO_FIELD), "field")
    )
    js = (
        F.when(outside & types["js"], "type")
        .when(outside & functions["js"], "function")
        .when(~outside & F.contains(code, F.lit("(")) & like(code, JS_METHOD), "method")
        .when(outside & like(code, r"^import\b(?!\s*\()"), "import")
    )
    generic = F.when(types["generic"], "type").when(functions["generic"], "function")
    return choose(family, {"java": java, "python": python, "go": go, "js": js}, generic)


def _type_name(family: Column, code: Column) -> Column:
    go = F.coalesce(F.nullif(get(code, GO_TYPE, 1), F.lit("")), get(code, GO_SPEC, 1))
    js = F.when(like(code, JS_CLASS), get(code, JS_CLASS, 1)).otherwise(get(code, JS_INTERFACE, 1))
    return choose(family, {"java": get(code, JAVA_TYPE, 3), "python": get(code, PYTHON_TYPE, 1), "go": go, "js": js}, get(code, _KIND, 2))


#: Parts a group from the next one in the text of a head; no character at all.
_PART = "\uffff"
#: What a declaration is read by, and how many groups that has.
_READ_BY = {
    ("java", "type"): (JAVA_TYPE, 4), ("java", "function"): (JAVA_FUNCTION, 5),
    ("python", "type"): (PYTHON_TYPE, 2), ("python", "function"): (PYTHON_FUNCTION, 5),
    ("go", "method"): (GO_METHOD, 4), ("go", "function"): (GO_FUNCTION, 3),
    ("js", "function"): (JS_FUNCTION, 3), ("js", "method"): (JS_METHOD, 5), ("js", "type"): (JS_CLASS, 2),
}


def _groups() -> Column:
    """All groups of the expression that a declaration is read by, by one match."""
    case = F
    for (family, tag), (pattern, n) in _READ_BY.items():
        each = F.regexp_replace("code", pattern + r"[\s\S]*+", _PART.join(f"${g}" for g in range(1, n + 1)))
        case = case.when((F.col("family") == family) & (F.col("tag") == tag), F.split(each, _PART, -1))
    return case


def resolve(rows: DataFrame) -> DataFrame:
    """The declaring statements as slim rows: what each declares, its lines, and the type that it belongs to."""
    worth = ~like(F.col("code"), r"^[\s{};)]*+$")
    # A filter on a generator's column isn't pushed below it, so no tag is found twice.
    tagged = F.when(worth, _tag())
    df = rows.withColumn("_tag", tagged).withColumn("tag", F.explode_outer(F.array("_tag"))).filter(F.col("tag").isNotNull()).drop("_tag")
    family, raw, code, tag = (F.col(c) for c in ("family", "raw", "code", "tag"))
    df = df.withColumn("_groups", _groups())
    group_of = lambda g: F.get("_groups", F.lit(g - 1))

    def of(cases: dict[tuple[str, str], Column]) -> Column:
        case = F
        for (fam, t), column in cases.items():
            case = case.when((family == fam) & (tag == t), column)
        return case

    # The argument text is cut from the head as it is, at the place and length found in the blanked one.
    def arguments(group: int) -> Column:
        return F.substr(raw, F.length(group_of(1)) + 1, F.length(group_of(group)))

    args = of({
        ("java", "function"): arguments(5), ("python", "function"): arguments(4),
        ("go", "method"): arguments(4), ("go", "function"): arguments(3),
        ("js", "function"): arguments(3), ("js", "method"): arguments(4),
    })
    heritage = of({("java", "type"): group_of(4), ("js", "type"): F.when(like(code, JS_CLASS), group_of(2))})
    extends = get(heritage, r"\bextends\s+((?:(?!\bimplements\b|\bpermits\b)[^{])+)", 1)
    implements = get(heritage, r"\bimplements\s+((?:(?!\bpermits\b)[^{])+)", 1)
    outside_angles = r",(?![^<]*>)"
    bases = _split_list(group_of(2), ",")
    java_kind = group_of(2)
    no_text = F.expr(NO_TEXTS)
    superclass = of({
        ("java", "type"): F.when(java_kind == "interface", "").otherwise(F.btrim(extends, F.lit(" \t\n"))),
        ("python", "type"): F.coalesce(F.get(bases, F.lit(0)), F.lit("")),
        ("js", "type"): F.btrim(extends, F.lit(" \t\n")),
    })
    interfaces = of({
        ("java", "type"): _split_list(F.when(java_kind == "interface", extends).otherwise(implements), outside_angles),
        ("python", "type"): F.slice(bases, 2, F.greatest(F.size(bases) - 1, F.lit(0))),
        ("js", "type"): _split_list(implements, outside_angles),
    })
    modifiers = of({
        ("java", "function"): group_of(2), ("js", "method"): group_of(2),
        ("python", "function"): F.concat(
            F.when(group_of(2) != "", "async ").otherwise(""),
            F.when(F.startswith(group_of(3), F.lit("_")), "private").otherwise("public"),
        ),
        ("go", "method"): F.when(like(group_of(3), r"^\p{Lu}"), "public").otherwise("private"),
        ("go", "function"): F.when(like(group_of(2), r"^\p{Lu}"), "public").otherwise("private"),
    })
    noted = {"java": F.when(F.startswith(code, F.lit("@")), get(raw, _JAVA_NOTED, 0)), "js": F.col("before"), "python": F.col("before")}

    def notes(fam: str) -> Column:
        found = F.regexp_extract_all(noted[fam], F.lit(_NOTE_RAW[fam]), F.lit(0))
        return F.transform(F.filter(found, lambda x: F.startswith(x, F.lit("@"))), lambda x: F.btrim(x, F.lit(st.WHITE)))

    decorators = F.when(F.contains(F.concat("before", F.substring("raw", 1, 1)), F.lit("@")), choose(family, {f: notes(f) for f in noted}))
    go_named = F.concat(get(code, GO_TYPE, 2), F.when(F.col("group").isNotNull(), get(code, GO_SPEC, 2)).otherwise(""))
    parts = F.struct(
        of({
            ("java", "type"): F.when(java_kind == "@interface", "interface").otherwise(java_kind), ("python", "type"): F.lit("class"),
            ("go", "type"): F.when(go_named == "interface", "interface").otherwise("struct"),
            ("go", "function"): F.lit("function"),
            ("js", "type"): F.when(like(code, JS_CLASS), "class").otherwise("interface"),
            ("generic", "type"): get(code, _KIND, 1),
        }).alias("kind"),
        of({
            ("java", "function"): group_of(3), ("java", "field"): get(code, JAVA_FIELD, 2),
            ("python", "function"): group_of(5), ("go", "field"): get(code, GO_FIELD, 2),
            ("js", "method"): group_of(5),
        }).alias("type_text"),
        F.coalesce(_split_list(args, r",(?![^<(]*[>)])"), no_text).alias("parameters"),
        F.filter(F.split(F.btrim(F.coalesce(modifiers, F.lit("")), F.lit(" \t\n")), r"\s+"), lambda m: m != "").alias("modifiers"),
        F.coalesce(decorators, no_text).alias("decorators"),
        F.coalesce(
            F.when(tag == "type", choose(family, {"java": _comment(), "go": _comment(), "python": _docstring(F.col("below"))})),
            F.lit(""),
        ).alias("docstring"),
        F.coalesce(superclass, F.lit("")).alias("superclass"),
        F.coalesce(interfaces, no_text).alias("interfaces"),
        of({
            ("java", "import"): F.array(get(raw, JAVA_IMPORT, 1)),
            ("python", "import"): F.array(get(raw, PYTHON_IMPORT, 0)),
            ("js", "import"): F.array(F.btrim(get(raw, JS_IMPORT, 0))),
            ("go", "import"): F.regexp_extract_all(raw, F.lit(r'(?:(?!import\b)[\w.]+\s+)?"[^"]*"'), F.lit(0)),
        }).alias("import_texts"),
    )
    names = of({
        ("java", "function"): F.array(group_of(4)), ("java", "field"): _names_of(code, get(code, JAVA_FIELD_TYPE, 0)),
        ("python", "function"): F.array(group_of(3)),
        ("go", "method"): F.array(group_of(3)), ("go", "function"): F.array(group_of(2)),
        ("go", "field"): F.split(get(code, GO_FIELD, 1), r"\s*,\s*"),
        ("js", "function"): F.array(group_of(2)), ("js", "method"): F.array(group_of(3)),
        ("generic", "function"): _generic_functions(code), ("generic", "type"): _generic_functions(code),
    })
    around = F.col("around")
    owner = F.when(around.isNotNull(), _type_name(family, around)).when((family == "go") & (tag == "method"), _receiver(code))
    owner_kind = choose(family, {"js": F.when(like(around, JS_CLASS), "class"), "go": F.when(like(around, r"\bstruct\b"), "struct")}, F.lit("type"))
    slim = ("relative_path", "language", "family", "package", "n_lines", "line_no", "end_line", "number", "tag")
    df = df.select(
        *slim, (F.col("i") == F.col("first_free")).alias("is_first_free"), (F.col("n_types") > 0).alias("has_types"),
        around.isNull().alias("outside"), owner.alias("owner"), F.when(around.isNotNull(), owner_kind).alias("owner_kind"),
        F.when(tag == "type", _type_name(family, code)).alias("name"), names.alias("names"), parts.alias("d"),
    )
    # A bare ``name(...)`` is a constructor only under its type's name.
    outside, first_name = F.col("outside"), F.get("names", F.lit(0))
    member = ~outside & (
        ((family == "java") & (tag == "function") & ((F.col("d.type_text") != "") | (first_name == F.col("owner"))))
        | ((family == "python") & (tag == "function"))
        | ((family == "js") & (tag == "method") & (F.col("owner_kind") == "class"))
        | ((family == "generic") & (F.size("names") > 0))
    )
    role = (
        F.when(member, "member")
        .when((family == "go") & (tag == "method") & (F.col("number") >= 0), "received")
        .when((family == "go") & (tag == "function"), "own")
        .when(outside & (tag == "function") & ~F.col("has_types") & family.isin("python", "js", "generic"), "module")
    )
    opens_module = F.coalesce((F.col("_role") == "module") & F.col("is_first_free"), F.lit(False))
    read = F.array(F.struct(F.col("_role").alias("role"), opens_module.alias("opens_module")))
    return df.withColumn("_role", role).select("*", F.inline_outer(read)).drop("_role")


# --- the four tables ----------------------------------------------------------------------------


def resolved(files: DataFrame, only: str | None = None) -> DataFrame:
    """The declaring statements of all files, from which ``tables`` and ``spans`` are read; with ``only``, those of one of
    the four tables. Files are read by ``reading``; ``resolve(declaring(files))`` tells the same by expressions, and the
    tests hold both beside each other."""
    return _to_read(files).mapInArrow(reading.reader_of(only), reading.RESOLVED)


def _to_read(files: DataFrame) -> DataFrame:
    return files.select("relative_path", "language", "content")


def declarations(files: DataFrame) -> Declared:
    """Types, functions, fields and imports of all files, whatever their language.

    Each table has a plan of its own that reads no more than it needs; write the files' resolved statements if several
    are needed.
    """
    return Declared(*[getattr(tables(resolved(files, only)), only) for only in Declared._fields])


def module_name() -> Column:
    last_part = F.when(F.col("family") == "js", F.col("package")).otherwise(F.substring_index("package", ".", -1))
    return F.coalesce(F.nullif(last_part, F.lit("")), F.lit("module"))


def _is_own() -> Column:
    return F.coalesce(F.col("role") == "own", F.lit(False))


def _type_row() -> Column:
    return (F.col("tag") == "type") | F.col("opens_module") | _is_own()


def _type_columns() -> dict[str, Column]:
    opens_module = F.col("opens_module")
    return {
        "type_no": F.when(opens_module, 0).otherwise(F.col("number")),
        "name": F.when(opens_module, module_name()).when(_is_own(), F.get("names", F.lit(0))).otherwise(F.col("name")),
        "start_line": F.when(opens_module, 1).otherwise(F.col("line_no")),
        "end_line": F.when(opens_module, F.col("n_lines")).otherwise(F.col("end_line")),
    }


def _owner_no() -> Column:
    return F.when(F.col("role") == "module", 0).otherwise(F.col("number"))


def tables(resolved: DataFrame) -> Declared:
    """Types (``outer`` names the type around one, '' for none), functions, fields and imports."""
    opens_module, role, family = F.col("opens_module"), F.col("role"), F.col("family")
    t = _type_columns()
    types = resolved.filter(_type_row()).select(
        "relative_path", "language", t["type_no"].alias("type_no"), "package", t["name"].alias("name"),
        F.when(opens_module, "module").otherwise(F.col("d.kind")).alias("kind"),
        F.when(opens_module, "").otherwise(F.col("d.superclass")).alias("superclass"),
        F.when(opens_module, F.expr(NO_TEXTS)).otherwise(F.col("d.interfaces")).alias("interfaces"),
        F.when(opens_module, F.expr(NO_TEXTS)).otherwise(F.col("d.decorators")).alias("decorators"),
        F.when(opens_module, "").otherwise(F.col("d.docstring")).alias("docstring"),
        F.coalesce(F.when(family != "generic", F.col("owner")), F.lit("")).alias("outer"),
        t["start_line"].alias("start_line"), t["end_line"].alias("end_line"),
    ).withColumn("fqn", texts.fqn(F.col("package"), F.col("name")))

    functions = resolved.filter(role.isNotNull()).select(
        "relative_path", "language", _owner_no().alias("type_no"),
        F.when(role.isin("member", "received"), F.col("owner")).when(_is_own(), F.get("names", F.lit(0))).otherwise(module_name()).alias("owner"),
        F.when(family == "generic", "").when(family == "java", F.coalesce(F.nullif("d.type_text", F.lit("")), F.lit("void")))
        .otherwise(F.coalesce("d.type_text", F.lit(""))).alias("return_type"),
        "d.parameters", "d.decorators", "d.modifiers", F.col("line_no").alias("start_line"), "end_line",
        F.posexplode_outer("names").alias("place", "name"),
    ).withColumn("is_public", texts.is_public(F.col("modifiers"), F.col("name")))

    field_owner = (family == "java") | ((family == "go") & (F.col("owner_kind") == "struct"))
    fields = resolved.filter((F.col("tag") == "field") & field_owner).select(
        "relative_path", F.col("number").alias("type_no"), "owner", F.col("d.type_text").alias("type"), "line_no", F.explode_outer("names").alias("name")
    ).select("relative_path", "type_no", "owner", "name", "type", "line_no")
    imports = resolved.filter(F.col("tag") == "import").select(
        "relative_path", "line_no", "family", F.posexplode_outer("d.import_texts").alias("place", "text")
    ).select(
        "relative_path", "line_no", "place",
        F.when(F.col("family") == "go", F.btrim("text", F.lit('"'))).otherwise(F.col("text")).alias("import_text"),
    )
    return Declared(types, functions, fields, imports)


def spans(resolved: DataFrame) -> DataFrame:
    """Per file, its outermost types in order with the lines of their functions. One shuffle, by file: a type's functions
    are gathered first, a file's types after."""
    t, role = _type_columns(), F.col("role")
    number = F.when(role == "module", 0).otherwise(F.col("number"))
    is_type = _type_row() & (F.col("outside") | (F.col("family") == "generic"))
    of_type = F.struct(t["name"].alias("name"), t["start_line"].alias("start"), t["end_line"].alias("end"))
    line, end = F.col("line_no"), F.col("end_line")
    of_functions = F.transform("names", lambda n: F.struct(line.alias("start"), end.alias("end"), n.alias("name")))
    rows = resolved.filter(_type_row() | role.isNotNull()).select(
        "relative_path", number.alias("type_no"), F.when(is_type, of_type).alias("t"), F.when(role.isNotNull(), of_functions).alias("f")
    )
    by_type = rows.repartition("relative_path").groupBy("relative_path", "type_no").agg(F.max("t").alias("t"), F.array_sort(F.flatten(F.collect_list("f"))).alias("functions"))
    span = F.struct("type_no", "t.name", "t.start", "t.end", "functions")
    return by_type.filter(F.col("t").isNotNull()).groupBy("relative_path").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def file_spans(files: DataFrame) -> DataFrame:
    """``spans`` of files, made where a file is read. Only those of files under one path are put together afterwards."""
    rows = _to_read(files).mapInArrow(reading.spans_of(), reading.SPAN_ROWS).repartition("relative_path")
    listed = rows.groupBy("relative_path").agg(F.collect_list(F.struct("spans", "loose")).alias("_files"))
    every = F.flatten(F.transform("_files", lambda x: F.concat(x["spans"], x["loose"])))

    def together(n: Column) -> Column:
        same = F.filter(every, lambda x: x["type_no"] == n)
        of_type = F.array_max(F.transform(same, lambda x: F.when(x["name"].isNotNull(), F.struct(x["name"].alias("name"), x["start"].alias("start"), x["end"].alias("end")))))
        functions = F.sort_array(F.flatten(F.transform(same, lambda x: x["functions"])))
        return F.struct(n.alias("type_no"), of_type["name"].alias("name"), of_type["start"].alias("start"), of_type["end"].alias("end"), functions.alias("functions"))

    numbers = F.sort_array(F.array_distinct(F.transform(every, lambda x: x["type_no"])))
    merged = F.filter(F.transform(numbers, together), lambda x: x["name"].isNotNull())
    spans_ = F.when(F.size("_files") == 1, F.get("_files", F.lit(0))["spans"]).otherwise(merged)
    return listed.select("relative_path", spans_.alias("spans")).filter(F.size("spans") > 0)
