"""Source files as statements that know where they stand.

A statement reaches to the brace, semicolon or line feed that ends it. Strings, comments and bracketed lists are passed
over whole, so a head with its annotations and arguments is one statement however many lines it takes, and a body on one
line falls into the same statements as one on many. Matching what opens with what closes needs a stack: the statements'
numbers (lines, step, kind) go through one Arrow function, a pass over each file; their texts never leave the JVM.
Everything is linear in a file's length, happens in its row and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import texts
from corpusmill.functions.texts import choose

FAMILY = {
    "java": "java", "python": "python", "go": "go",
    "javascript": "js", "jsx": "js", "typescript": "js", "tsx": "js",
}
#: How deep brackets are matched inside one statement; what is deeper only ends the statement early.
NESTED = 6

# --- lexemes ------------------------------------------------------------------------------------
# Possessive groups keep matching iterative, so long texts cannot exhaust the stack.

_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?'
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"
_TRIPLE = r'"""(?:[^"\\]++|\\.|"(?!""))*+(?:""")?'
_TRIPLE_SINGLE = r"'''(?:[^'\\]++|\\.|'(?!''))*+(?:''')?"
_BACKTICK = r"`[^`\\]*+(?:\\.[^`\\]*+)*+`?"
COMMENT = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"
# A slash begins a regular expression after an operator, an opening bracket, a comma or one of these words, or on its own line.
_REGEX = (
    r"(?=/)(?<=[=(,\[!&|?:;{+\-*%~^]\s{0,40}|\b(?:return|typeof|case|else|do|in|of|void|delete|throw|await|yield)\s{1,40}|^\s{0,40}|\n\s{0,40})"
    r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[A-Za-z]*+"
)
LITERAL = {
    "java": rf"{_TRIPLE}|{_DOUBLE}|{_SINGLE}|{COMMENT}",
    "go": rf"{_DOUBLE}|{_SINGLE}|`[^`]*+`?|{COMMENT}",
    "js": rf"{_DOUBLE}|{_SINGLE}|{_BACKTICK}|{COMMENT}|{_REGEX}",
    "python": rf"{_TRIPLE}|{_TRIPLE_SINGLE}|{_DOUBLE}|{_SINGLE}|#[^\n]*+",
}
LEXEMES = {
    "java": rf"(?s){LITERAL['java']}|[^\"'/]++|/",
    "go": rf"(?s){LITERAL['go']}|[^\"'`/]++|/",
    "js": rf"(?s){LITERAL['js']}|[^\"'`/]++|/",
    "python": rf"(?s){LITERAL['python']}|[^\"'#]++",
}
WHITE = " \t\r\n\f\x0b"
STRING_END = "\x01"  # closes a blanked string that spans lines


def _bracketed(family: str, openers: str, closers: str, quotes: str) -> str:
    """A bracketed text whose own brackets match, ``NESTED`` deep; ``quotes`` begin strings and comments."""
    plain = rf"{LITERAL[family]}|[^{openers}{closers}{quotes}]++" + ("|/" if "/" in quotes else "")
    inner = rf"[{openers}](?:{plain})*+[{closers}]"
    for _ in range(NESTED - 1):
        inner = rf"[{openers}](?:{plain}|{inner})*+[{closers}]"
    return inner


LISTS = {f: _bracketed(f, "(", ")", q) for f, q in (("java", "\"'/"), ("go", "\"'`/"), ("js", "\"'`/"))}
LISTS["python"] = _bracketed("python", r"(\[{", r")\]}", "\"'#")
_BEFORE = rf"(?:\s++|{COMMENT})*+"
_JS_NOTES = rf"(?:@[\w.]++(?:{LISTS['js']})?+{_BEFORE})*+"
_JS_HEAD = rf"(?:(?:export|default|declare|abstract)\s++)*+(?:class|interface)\b(?:{LITERAL['js']}|[^{{}};\"'`/]++|/)*+"
_JS_IMPORT = rf"import\b(?!\s*+\()[^'\";]*+['\"][^'\"\n]*+['\"](?:[^\S\n]|{COMMENT})*+"
_PY_BLANK = r"(?:[ \t\f\r]*+(?:#[^\n]*+)?\n)*+"
PYTHON_LINE = rf"(?:{LITERAL['python']}|{LISTS['python']}|\\\r?\n|[^()\[\]{{}}\"'#\\\n]++|[()\[\]{{}}\\])*+(?:\n|\z)"
STATEMENT = {
    "java": rf"(?s)(?:{LITERAL['java']}|{LISTS['java']}|[^\"'/(){{}};]++|[/()])*+(?:[{{}};]|\z)",
    "go": (
        rf"(?s){_BEFORE}(?:(?:type|import|var|const)\s*+\(|\)|"
        rf"(?:{LITERAL['go']}|{LISTS['go']}|(?<=\b(?:interface|struct)[ \t]{{0,4}})\{{\s*+\}}|[^\"'`/(){{}};\n]++|[/()])*+(?:[{{}};\n]|\z))"
    ),
    "js": (
        rf"(?s){_BEFORE}{_JS_NOTES}(?:{_JS_HEAD}|{_JS_IMPORT}|"
        rf"(?:{LITERAL['js']}|{LISTS['js']}|\n(?=\s*+\{{)|[^\"'`/(){{}};\n]++|[/()])*+)(?:[{{}};\n]|\z)"
    ),
    "python": rf"(?s){_PY_BLANK}(?:[ \t]*+@{PYTHON_LINE}{_PY_BLANK})*+{PYTHON_LINE}",
}
#: What stands before a statement's own first line, in text without comments.
LEADS = {
    "java": r"^\s*+",
    "go": r"^\s*+",
    "js": r"^\s*+(?:@[\w.]++(?:\((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+\))?+\s*+)*+",
    "python": r"^\s*+(?:@[^\n(]*+(?:\((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+\))?+[^\n]*+\n\s*+)*+",
}

# Kinds of statements that the stack treats in a way of their own.
PLAIN, TYPE, GROUP, OWN, SPEC, BLANK = range(6)
#: Places of a statement's numbers.
LINE, END, PARENT, NUMBER = range(4)
WIDTH = 4
#: Parents that are no type: the file itself, and something else; from FIRST_GROUP down, the group that lists a statement.
TOP, INSIDE, FIRST_GROUP = -1, -2, -3


def family_of(language: Column) -> Column:
    return F.coalesce(choose(language, {k: F.lit(v) for k, v in FAMILY.items()}), F.lit("generic"))


def masked(content: Column, family: str) -> Column:
    """The text with comments as blanks and string contents as quotes: same lines, same lengths."""

    def blank(t: Column) -> Column:
        return F.regexp_replace(t, r"[^\n]", " ")

    def quoted(t: Column) -> Column:
        one_line = F.regexp_replace(t, ".", '"')
        n = F.length(t)
        spanning = F.concat(F.lit('"'), blank(F.substr(t, F.lit(2), n - 2)), F.lit(STRING_END))
        return F.when(F.contains(t, F.lit("\n")), spanning).otherwise(one_line)

    comment_starts = ("#",) if family == "python" else ("//", "/*")

    def masked_lexeme(t: Column) -> Column:
        is_comment = F.lit(False)
        for c in comment_starts:
            is_comment = is_comment | F.startswith(t, F.lit(c))
        literal = F.substring(t, 1, 1).isin('"', "'", "`")
        if family == "js":
            literal = literal | (F.startswith(t, F.lit("/")) & (F.length(t) > 1))
        return F.when(is_comment, blank(t)).when(literal, quoted(t)).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(content, F.lit(LEXEMES[family]), F.lit(0)), masked_lexeme), "")


def _blanker(family: str):
    return lambda s: F.when(_unmasked(s, family), s).otherwise(masked(s, family))


def _lead(pattern: str):
    return lambda c: F.regexp_extract(c, pattern, 0)


def _unmasked(text: Column, family: str) -> Column:
    """Whether masking would change nothing."""
    marks = {"java": "[\"'/]", "go": "[\"'`/]", "js": "[\"'`/]", "python": "[\"'#]"}[family]
    return ~F.rlike(text, F.lit(marks))


# --- the stack ----------------------------------------------------------------------------------


def nest(family: str, n_lines: int, total, lead, inner, step, kind, indent, key) -> np.ndarray:
    """Numbers of each statement of one file, and at the end how many types were declared.

    ``total``, ``lead`` and ``inner`` are line feeds of a statement, before its first line and within it; ``step`` is 1
    where it opens a block, -1 where it closes one (in Python, brackets left open); ``key`` names a type, or the type
    that a Go method is for. LINE and END are lines from 1, PARENT the statement of the enclosing type, NUMBER the type
    that this statement declares or belongs to.
    """
    total, lead, inner, step, kind, indent, key = (x.tolist() for x in (total, lead, inner, step, kind, indent, key))
    n, types = len(total), 0
    line, end, parent, number = [0] * n, [0] * n, [TOP] * n, [-1] * n
    base, named, own = 1, {}, []
    opened: list[tuple[int, int, int]] = []  # (indent, statement, parent of what is inside)
    brackets, last, latest = 0, 0, TOP

    def declare(i: int) -> bool:
        """Numbers statement ``i``, whose parent is known; whether it declares a type."""
        nonlocal types
        if (kind[i] == TYPE and parent[i] != INSIDE) or (kind[i] == SPEC and parent[i] <= FIRST_GROUP):
            number[i], types = types, types + 1
            named.setdefault(key[i], number[i])
            return True
        if parent[i] >= 0:
            number[i] = number[parent[i]]
        return False

    for i in range(n):
        line[i] = base + lead[i]
        end[i] = line[i] + inner[i]
        base += total[i]
        if family == "generic":
            declares = declare(i)
            parent[i] = latest = i if declares else latest
            if latest >= 0:
                number[i] = number[latest]
        elif family == "python":
            if kind[i] == BLANK or brackets > 0:
                parent[i] = INSIDE
            else:
                while opened and opened[-1][0] >= indent[i]:
                    end[opened.pop()[1]] = last
                parent[i] = opened[-1][2] if opened else TOP
                opened.append((indent[i], i, i if declare(i) else INSIDE))
            if kind[i] != BLANK:
                brackets, last = max(0, brackets + step[i]), end[i]
        else:
            around = parent[i] = opened[-1][2] if opened else TOP
            declares = declare(i)
            if kind[i] == OWN and around == TOP:
                own.append(i)
            if step[i] > 0:
                opened.append((0, i, i if declares else FIRST_GROUP - i if kind[i] == GROUP and around == TOP else INSIDE))
            elif step[i] < 0 and opened:
                end[opened.pop()[1]] = base
    for _, i, _ in opened:
        end[i] = last if family == "python" else n_lines
    if family == "go":
        for k, i in enumerate(own):
            number[i] = types + k
        for i in range(n):
            if key[i] and kind[i] not in (TYPE, OWN) and parent[i] == TOP:
                number[i] = named.get(key[i], -1)
    return np.append(np.column_stack((line, end, parent, number)).reshape(-1) if n else [], types).astype(np.int32)


def _nested():
    @F.pandas_udf("array<int>")
    def nested(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([nest(*row) for row in zip(*columns, strict=True)])

    return nested


# --- on tables ----------------------------------------------------------------------------------


def code_of(text: Column, family: str) -> Column:
    """A statement with strings and comments blanked."""
    return _blanker(family)(text)


def head_of(text: Column, family: str) -> Column:
    """A statement's blanked head, from its own first line on."""
    return F.regexp_replace(code_of(text, family), LEADS[family], "")


def has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


#: Whether a statement as it is may open a type or name a package: blocks are matched without the heads of others.
_MAY_OPEN = {
    "java": lambda s: (F.endswith(s, F.lit("{")) & has(s, "class|interface|enum|record")) | F.contains(s, F.lit("package")),
    "go": lambda s: has(s, "type|func|import|package"),
    "js": lambda s: has(s, "class|interface"),
}


def _last_group() -> Column:
    """Place of a Go file's last group."""
    return F.array_max(F.transform("raw", lambda s, i: F.when(has(s, r"(?:type|import)\s*+\($"), i)))


def _end_of_groups() -> Column:
    """Place at which the last Go group ends; 0 without one."""
    ends = F.array_min(F.transform("raw", lambda s, i: F.when((i > F.col("last_group")) & F.endswith(s, F.lit(")")), i)))
    return F.when(F.col("last_group").isNull(), 0).otherwise(F.coalesce(ends, F.size("raw")))


def statements(files: DataFrame, is_type, kinds, keys) -> DataFrame:
    """``files`` with their statements as they are (``raw``), ``numbers``, and ``heads`` with strings and comments blanked
    of the statements that may open a type, a group or a package, or stand in a group; in Python of all.

    ``is_type`` has a family's test of a head for a type, ``kinds`` those for GROUP, OWN and SPEC, ``keys`` the name under
    which types and receivers meet. LINE is where a statement's text begins, in Python its head; END holds for what opens
    a block.
    """
    df = files.select("relative_path", "language", "content", family_of(F.col("language")).alias("family"))
    family = F.col("family")
    some = lambda p: F.filter(F.regexp_extract_all(F.col("content"), F.lit(p), F.lit(0)), lambda s: s != "")
    lines = F.transform(texts.lines_of(F.col("content")), lambda x: F.concat(x, F.lit("\n")))
    df = df.withColumn("raw", choose(family, {f: some(p) for f, p in STATEMENT.items()}, lines))
    is_python, zeros = family == "python", F.array_repeat(F.lit(0), F.size("raw"))
    df = df.withColumn("last_group", F.when(family == "go", _last_group())).withColumn("grouped", F.when(family == "go", _end_of_groups()))
    code = F.when(is_python, F.transform("raw", _blanker("python")))
    df = df.withColumns({"code": code, "n_lines": F.size(texts.lines_of(F.col("content")))})
    df = df.withColumn("leads", F.when(is_python, F.transform("code", _lead(LEADS["python"]))))

    def heads(f: str) -> Column:
        if f == "go":
            return F.transform("raw", lambda s, i: F.when((i < F.col("grouped")) | _MAY_OPEN[f](s), head_of(s, f)))
        return F.transform("raw", lambda s: F.when(_MAY_OPEN[f](s), head_of(s, f)))

    python_heads = F.transform("code", lambda c, i: F.substr(c, F.length(F.get("leads", i)) + 1))
    df = df.withColumn("heads", choose(family, {**{f: heads(f) for f in _MAY_OPEN}, "python": python_heads}, F.col("raw")))

    def braces(c: Column) -> Column:
        last = F.substring(c, -1, 1)
        return F.when(last.isin("{", "("), 1).when(last.isin("}", ")"), -1).otherwise(0)

    def steps(f: str) -> Column:
        """Only the last statement may end otherwise than at its brace, in a comment say."""
        at_end = F.array(braces(head_of(F.get("raw", F.size("raw") - 1), f)))
        body = F.transform(F.slice("raw", 1, F.size("raw") - 1), braces)
        return F.when(F.size("raw") > 0, F.concat(body, at_end)).otherwise(F.array().cast("array<int>"))

    def left_open(c: Column) -> Column:
        open_ = F.length(F.regexp_replace(c, r"[^(\[{]+", "")) - F.length(F.regexp_replace(c, r"[^)\]}]+", ""))
        return F.when(has(c, r"[(\[{)\]}]"), open_).otherwise(0)

    def each(body) -> Column:
        return F.transform("heads", body).cast("array<int>")

    def kind(f: str):
        def of(c: Column) -> Column:
            case = F.when(c.isNull(), PLAIN).when(is_type[f](c), TYPE)
            for value, test in kinds.get(f, {}).items():
                case = case.when(test(c), value)
            return (case.when(F.btrim(c, F.lit(WHITE)) == "", BLANK) if f == "python" else case).otherwise(PLAIN)

        return of

    def key(f: str):
        return lambda c: F.when(keys[f](c) != "", F.xxhash64(keys[f](c))).otherwise(F.lit(0).cast("long"))

    numbers = _nested()(
        family, "n_lines",
        choose(family, {f: F.transform("raw", texts.newline_count).cast("array<int>") for f in STATEMENT}, F.array_repeat(F.lit(1), F.size("raw"))),
        F.when(is_python, F.transform("leads", texts.newline_count).cast("array<int>")).otherwise(zeros),
        F.when(is_python, each(lambda h: texts.newline_count(F.rtrim(h, F.lit(WHITE))))).otherwise(zeros),
        choose(family, {**{f: steps(f) for f in _MAY_OPEN}, "python": each(left_open)}, zeros),
        choose(family, {f: each(kind(f)) for f in (*STATEMENT, "generic")}),
        F.when(is_python, F.transform("leads", lambda x: F.length(F.regexp_extract(x, r"[ \t]*\z", 0)))).otherwise(zeros),
        choose(family, {f: F.transform("heads", key(f)) for f in keys}, zeros.cast("array<long>")),
    )
    return df.withColumn("numbers", numbers).drop("leads", "content", "code", "last_group", "grouped")


def parted(rows: DataFrame) -> DataFrame:
    """Rows of one statement's ``text``: what stands ``before`` it (white space, comments, in Python and JS also
    decorators), its head as it is (``raw``) and with strings and comments blanked (``code``)."""
    family, text = F.col("family"), F.col("text")
    df = rows.withColumn("_code", choose(family, {f: code_of(text, f) for f in STATEMENT}, text))
    df = df.withColumn("_lead", F.length(choose(family, {f: _lead(p)(F.col("_code")) for f, p in LEADS.items()}, F.lit(""))))
    cut = {"before": F.substr(text, F.lit(1), F.col("_lead")), "raw": F.substr(text, F.col("_lead") + 1), "code": F.substr(F.col("_code"), F.col("_lead") + 1)}
    return df.withColumns(cut).drop("_code", "_lead", "text")


def number(i: Column, which: int) -> Column:
    return F.get("numbers", i * WIDTH + which)


def count_of_types() -> Column:
    return F.element_at("numbers", -1)
