"""Declaring statements of whole files, read in one Arrow function.

The rules are those of ``statements`` and ``declarations``, whose patterns are compiled here for Python: a file is cut into
statements, a stack tells what each stands in, and only what stands in a type or in no block at all is blanked and read.
One pass over a file's text, linear in it, without arrays of it in between; texts of what declares nothing stay behind.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa

from corpusmill import fixed_values as fv
from corpusmill.operators import statements as st

RESOLVED = (
    "relative_path string, language string, family string, package string, n_lines int, line_no int, end_line int, number int, "
    "tag string, outside boolean, owner string, owner_kind string, name string, names array<string>, "
    "d struct<kind:string,type_text:string,parameters:array<string>,modifiers:array<string>,decorators:array<string>,"
    "docstring:string,superclass:string,interfaces:array<string>,import_texts:array<string>>, role string, opens_module boolean"
)
#: Rows that are sent on at once.
ROWS = 20_000
#: The four tables that can be asked for alone, and what ``spans`` are made of: types and functions, by name and lines.
TYPES, FUNCTIONS, FIELDS, IMPORTS, SPANS = "types", "functions", "fields", "imports", "spans"

# --- the patterns, for Python ----------------------------------------------------------------------

_WORDS = ("return", "typeof", "case", "else", "do", "in", "of", "void", "delete", "throw", "await", "yield")


def _slash_place() -> str:
    """What stands before a slash that begins a regular expression; Python's look-behinds have one width each."""
    by_length: dict[int, list[str]] = {}
    for w in _WORDS:
        by_length.setdefault(len(w), []).append(w)
    place = r"(?!)"
    for n in range(40, -1, -1):
        white = rf"\s{{{n}}}" if n else ""
        words = "|".join(rf"(?<=(?u:\b)(?:{'|'.join(ws)}){white})" for ws in by_length.values())
        here = rf"(?<=[=(,\[!&|?:;{{+\-*%~^]{white})|(?<=^{white})" + (rf"|(?<=[a-z]{white})(?:{words})" if n else "")
        place = rf"(?:{here}|(?<=\n{white})" + (rf"|(?<=[^\S\n]{white}){place})" if n < 40 else ")")
    return place


_GO_EMPTY = "|".join(rf"(?<=(?u:\b){w}" + (rf"[ \t]{{{n}}})" if n else ")") for w in ("interface", "struct") for n in range(5))
#: The end of a text, or the line feed or the like that ends it.
_END = r"(?:\Z|(?=\r\n\Z)|(?<!\r)(?=\n\Z)|(?=[\r\x85\u2028\u2029]\Z))"
_LINE_BEGIN = r"(?:(?<![\s\S])|(?<=[\n\x85\u2028\u2029])|(?<=\r)(?!\n))"


def ported(pattern: str) -> str:
    """A pattern of the JVM's as Python reads it."""
    java_slash = st._REGEX[st._REGEX.index("(?<="):st._REGEX.index("/(?![*/])")]
    p = pattern.replace(java_slash, _slash_place())
    p = p.replace(r"(?<=\b(?:interface|struct)[ \t]{0,4})\{\s*+\}", rf"(?=\{{\s*+\}})(?:{_GO_EMPTY})\{{\s*+\}}")
    p = re.sub(r"(?<!\\)((?:\\\\)*)\\z", r"\1\\Z", p)
    return re.sub(r"(?<!\\)((?:\\\\)*)(?<!\(\?u:)\\b", r"\1(?u:\\b)", p)


def _patterns() -> dict[str, str]:
    from corpusmill.operators import declarations as D

    java = {
        "java_type": D.JAVA_TYPE, "java_function": D.JAVA_FUNCTION, "java_field_type": D.JAVA_FIELD_TYPE,
        "package": D.JAVA_PACKAGE, "python_type": D.PYTHON_TYPE, "python_function": D.PYTHON_FUNCTION, "python_import": D.PYTHON_IMPORT,
        "go_type": D.GO_TYPE, "go_method": D.GO_METHOD, "go_function": D.GO_FUNCTION, "go_field": D.GO_FIELD, "go_spec": D.GO_SPEC,
        "js_class": D.JS_CLASS, "js_interface": D.JS_INTERFACE, "js_function": D.JS_FUNCTION, "js_method": D.JS_METHOD, "js_import": D.JS_IMPORT,
        "kind": D._KIND, "callable": D._CALLABLE, "java_noted": D._JAVA_NOTED,
        **{f"note_{f}": p for f, p in D._NOTE_RAW.items()}, **{f"statement_{f}": p for f, p in st.STATEMENT.items()},
        **{f"literal_{f}": rf"(?s){p}" for f, p in st.LITERAL.items()}, **{f"lead_{f}": p for f, p in st.LEADS.items()},
    }
    found = {k: ported(p) for k, p in java.items()}
    # Those that hold a ``$`` for the end of a text.
    return found | {
        "java_field": ported(D.JAVA_FIELD.removesuffix("$)")) + _END + ")", "java_import": ported(D.JAVA_IMPORT.removesuffix("$)")) + _END + ")",
        "go_group": ported(D.GO_GROUP.removesuffix("$")) + _END, "last_group": r"(?:type|import)\s*+\(" + _END,
        "comment": ported(D.COMMENT_ABOVE), "doc": ported(D.DOCSTRING), "stars": _LINE_BEGIN + r"\*+ ?",
        "parameters": r"\[[^\n\r\x85\u2028\u2029]*" + _END,
    }


# --- one file --------------------------------------------------------------------------------------

WHITE = st.WHITE
_BLANKS = re.compile(r"[^\n]")
_ONE_LINE = re.compile(r"[^\n\r\x85\u2028\u2029]")
#: What a statement may hold that is nothing; one of _ENDS may stand after it.
NOTHING, _ENDS = WHITE + "{};)", ("\x85", "\u2028", "\u2029")
_PAIRS = (r"\([^()]*+\)", r"\([^()]*+\)", r"<[^<>()=;]*+>", r"<[^<>()=;]*+>", r"\[[^\[\]]*+\]")


class Statement:
    """A statement that stands in a type, in a Go group or in no block."""

    __slots__ = ("i", "text", "lead", "head", "line", "end", "around", "group", "number", "kind", "read", "owns")

    def __init__(self, i, text, lead, head, line, around, group):
        self.i, self.text, self.lead, self.head = i, text, lead, head
        self.line = self.end = line
        self.around, self.group, self.number, self.kind = around, group, -1, st.PLAIN
        self.read = self.owns = None  # the match that the head is read by; the name and kind under which it owns others


class Reader:
    """Reads the files of one family."""

    def __init__(self, family: str, patterns: dict[str, str]):
        self.family = family
        self.patterns, self.by_braces = patterns, family in ("java", "go", "js")
        self.marks = re.compile({"java": "[\"'/]", "go": "[\"'`/]", "js": "[\"'`/]", "python": "[\"'#]", "generic": "(?!)"}[family])
        if family != "generic":
            self.literal, self.statement, self.leads = (self.compiled(f"{x}_{family}") for x in ("literal", "statement", "lead"))
        self.is_type = getattr(self, f"_{family}_is_type")
        self.tag = getattr(self, f"_{family}_tag")

    def compiled(self, name: str) -> re.Pattern:
        return re.compile(self.patterns[name], re.A)

    def __getattr__(self, name: str) -> re.Pattern:
        """A pattern, compiled when it is first used."""
        if name.startswith("__") or name not in self.__dict__.get("patterns", ()):
            raise AttributeError(name)
        found = self.__dict__[name] = self.compiled(name)
        return found

    # --- text

    def _blanked(self, m: re.Match) -> str:
        t = m.group()
        first = t[0]
        if first == "#" or (first == "/" and t[1] in "/*"):
            return _BLANKS.sub(" ", t)
        if "\n" in t:
            return '"' + _BLANKS.sub(" ", t[1:-1]) + st.STRING_END
        return '"' * len(t) if "\r" not in t and t.isascii() else _ONE_LINE.sub('"', t)

    def code_of(self, s: str) -> str:
        return self.literal.sub(self._blanked, s) if self.marks.search(s) else s

    def lead_of(self, code: str) -> int:
        if "@" not in code or self.family in ("java", "go"):
            return len(code) - len(code.lstrip(WHITE))
        return self.leads.match(code).end()

    def raw(self, content: str) -> list[str]:
        # A statement is a whole match: the patterns' groups capture nothing.
        return [s for s in self.statement.findall(content) if s]

    # --- what a head declares

    def _java_is_type(self, head: str, language: str):
        return head.endswith("{") and self._word.search(head) and self.java_type.match(head)

    _word = re.compile(r"(?u:\b)(?:class|interface|enum|record)\s", re.A)

    def _python_is_type(self, head, language):
        return head.startswith("class") and self.python_type.match(head)

    def _go_is_type(self, head, language):
        return head.startswith("type") and self.go_type.match(head)

    def _js_is_type(self, head, language):
        return (("class" in head and self.js_class.match(head))
                or (language in ("typescript", "tsx") and "interface" in head and self.js_interface.match(head)))

    def _generic_is_type(self, head, language):
        return self.kind.search(head)

    def generic_functions(self, code: str) -> list[str]:
        return [n for n in self.callable.findall(code) if n not in fv.GENERIC_NOT_FUNCTIONS] if "(" in code else []

    def is_function(self, head: str):
        f = self.family
        if f == "python":
            return self.python_function.match(head)
        return self.js_function.match(head) if f == "js" else self.generic_functions(head)

    def receiver(self, method: re.Match) -> str:
        return self.parameters.sub("", self._white.split(method.group(2).strip(" "))[-1]).lstrip("*")

    _white = re.compile(r"\s+", re.A)

    def type_name(self, one: Statement) -> str:
        m = one.read
        if self.family == "java":
            return m.group(3)
        return m.group(2) if self.family == "generic" else m.group(1)

    def owner(self, one: Statement) -> tuple[str, str | None]:
        """The name of a type that statements stand in, and its kind."""
        if one.owns is None:
            kind = "type"
            if self.family == "js":
                kind = "class" if self.js_class.match(one.head) else None
            elif self.family == "go":
                kind = "struct" if self._struct.search(one.head) else None
            one.owns = (self.type_name(one), kind)
        return one.owns

    # --- the stack

    def nested(self, raw: list[str], n_lines: int, language: str) -> tuple[list[Statement], int]:
        """The statements that may declare something, in order, and how many types were declared."""
        if self.family == "generic":
            return self._nested_generic(raw, language)
        return self._nested_python(raw) if self.family == "python" else self._nested_braces(raw, n_lines, language)

    def _nested_braces(self, raw, n_lines, language):
        go, last, marks = self.family == "go", len(raw) - 1, self.marks
        found, opened, own, named = [], [], [], {}
        base, types, grouped = 1, 0, None
        inside = False  # in a block that is no type
        around = group = None
        for i, s in enumerate(raw):
            line = base
            base += s.count("\n")
            one = None
            declares = opens_group = False
            if not inside and s.lstrip(NOTHING):
                code = self.code_of(s) if marks.search(s) else s
                if "@" in code:
                    lead = self.lead_of(code)
                    head = code[lead:]
                else:
                    head = code.lstrip(WHITE)
                    lead = len(code) - len(head)
                one = Statement(i, s, lead, head, line, around, group)
                found.append(one)
                read = self.is_type(head, language)
                if read:
                    one.kind, one.read = st.TYPE, read
                elif go:
                    if grouped is None and group is not None:
                        grouped = self._end_of_groups(raw)
                    if "(" in head[-3:] and self.go_group.match(head):
                        one.kind = st.GROUP
                    elif head.startswith("func"):
                        one.read = self.go_function.match(head)
                        one.kind = st.OWN if one.read else st.PLAIN
                    if one.kind == st.PLAIN and group is not None and (i < grouped or self._may_open.search(s)):
                        one.read = self.go_spec.match(head)
                        one.kind = st.SPEC if one.read else st.PLAIN
                if one.kind == st.TYPE or (one.kind == st.SPEC and group is not None):
                    one.number, types, declares = types, types + 1, True
                    if go:
                        named.setdefault(self.type_name(one), one.number)
                elif around is not None:
                    one.number = around.number
                top = around is None and group is None
                if top and one.kind == st.OWN:
                    own.append(one)
                opens_group = top and one.kind == st.GROUP
            ends = s[-1] if i < last else (one.head if one else self._head_of(s))[-1:]
            if ends in ("{", "("):
                opened.append((one, inside, around, group))
                inside, around, group = not (declares or opens_group), one if declares else None, one if opens_group else None
            elif ends in ("}", ")") and opened:
                closed, inside, around, group = opened.pop()
                if closed is not None:
                    closed.end = base
        for closed, *_ in opened:
            if closed is not None:
                closed.end = n_lines
        for k, one in enumerate(own):
            one.number = types + k
        if go:
            for one in found:
                if one.around is None and one.group is None and one.kind == st.PLAIN and one.head.startswith("func"):
                    one.read = self.go_method.match(one.head)
                    one.number = named.get(self.receiver(one.read), -1) if one.read else -1
        return found, types

    _may_open = re.compile("type|func|import|package")

    def _head_of(self, s: str) -> str:
        code = self.code_of(s)
        return code[self.lead_of(code):]

    def _end_of_groups(self, raw: list[str]) -> int:
        """Place at which the last Go group ends."""
        last = max((i for i, s in enumerate(raw) if "(" in s[-3:] and self.last_group.search(s)), default=None)
        if last is None:
            return 0
        return next((i for i in range(last + 1, len(raw)) if raw[i].endswith(")")), len(raw))

    def _nested_python(self, raw):
        found, opened = [], []  # opened: (indent, statement, whether what is inside is in no type, the type)
        base, types, brackets, last = 1, 0, 0, 0
        blanked = self._blanked
        for i, s in enumerate(raw):
            code = self.literal.sub(blanked, s) if '"' in s or "'" in s or "#" in s else s
            if "@" in code:
                lead = self.lead_of(code)
                head = code[lead:]
            else:
                head = code.lstrip(WHITE)
                lead = len(code) - len(head)
            line = base + code.count("\n", 0, lead)
            base += s.count("\n")
            bare = head.rstrip(WHITE)  # a head begins with no white space
            if not bare:
                continue
            end = line + bare.count("\n")
            if brackets == 0:
                before = code[:lead]
                indent = lead - len(before.rstrip(" \t"))
                while opened and opened[-1][0] >= indent:
                    closed = opened.pop()[1]
                    if closed is not None:
                        closed.end = last
                _, _, inside, around = opened[-1] if opened else (0, None, False, None)
                one, declares = None, False
                if not inside:
                    one = Statement(i, s, lead, head, line, around, None)
                    one.end = end
                    found.append(one)
                    one.read = self.python_type.match(head) if head.startswith("class") else None
                    if one.read:
                        one.kind, one.number, types, declares = st.TYPE, types, types + 1, True
                    elif around is not None:
                        one.number = around.number
                opened.append((indent, one, not declares, one if declares else None))
            left = head.count("(") + head.count("[") + head.count("{") - head.count(")") - head.count("]") - head.count("}")
            if left:
                brackets = max(0, brackets + left)
            last = end
        for _, closed, _, _ in opened:
            if closed is not None:
                closed.end = last
        return found, types

    def _nested_generic(self, raw, language):
        found, latest, types = [], None, 0
        for i, s in enumerate(raw):
            one = Statement(i, s, 0, s, i + 1, latest, None)
            one.read = self.is_type(s, language)
            if one.read:
                one.kind, one.number, types = st.TYPE, types, types + 1
                one.around = latest = one
            elif latest is not None:
                one.number = latest.number
            found.append(one)
        return found, types

    # --- what a statement declares: its tag and the match it is read by

    def _java_tag(self, one: Statement, outside: bool):
        code = one.head
        if one.kind == st.TYPE:
            return "type", one.read
        if not outside:
            m = "(" in code and self.java_function.match(code)
            if m:
                return "function", m
            m = self.java_field.match(code)
            return ("field", m) if m else None
        return ("import", None) if code.startswith("import") and code[6:7] in st.WHITE and code[6:7] else None

    def _python_tag(self, one, outside):
        code = one.head
        if one.kind == st.TYPE:
            return "type", one.read
        m = self.python_function.match(code) if "def" in code else None
        if m:
            return "function", m
        return ("import", None) if outside and self._imports.match(code) else None

    _imports = re.compile(r"(?:import|from)\s", re.A)

    def _go_tag(self, one, outside):
        code, group = one.head, one.group
        if outside:
            if one.kind == st.TYPE:
                return "type", one.read
            if code.startswith("func"):
                if one.kind == st.OWN:
                    return "function", one.read
                return ("method", one.read) if one.read else None
            return ("import", None) if self._go_import.match(code) else None
        if group is not None:
            if group.head.startswith("type"):
                m = self.go_spec.match(code)
                if m:
                    return "type", m
            return ("import", None) if group.head.startswith("import") and '"' in one.text[one.lead:] else None
        m = self.go_field.match(code)
        return ("field", m) if m else None

    _go_import = re.compile(r"import\s*+[^\s(]", re.A)

    def _js_tag(self, one, outside):
        code = one.head
        if outside:
            if one.kind == st.TYPE:
                return "type", one.read if one.read.re is self.js_class else None
            m = "(" in code and self.js_function.match(code)
            if m:
                return "function", m
            return ("import", None) if self._js_imports.match(code) else None
        m = "(" in code and self.js_method.match(code)
        return ("method", m) if m else None

    _js_imports = re.compile(r"import(?u:\b)(?!\s*\()", re.A)

    def _generic_tag(self, one, outside):
        if one.kind == st.TYPE:
            return "type", one.read
        return ("function", None) if self.generic_functions(one.head) else None

    # --- one file -> its rows

    def rows(self, content: str, language: str, guessed: str, only: str | None) -> Iterator[tuple]:
        """(package, n_lines, line_no, end_line, number, tag, outside, owner, owner_kind, name, names, kind, type_text, parameters,
        modifiers, decorators, docstring, superclass, interfaces, import_texts, role, opens_module) of each declaring statement;
        with ``only``, of those that this table is made of."""
        family = self.family
        if (only == FIELDS and family not in ("java", "go")) or (only == IMPORTS and family == "generic"):
            return
        raw = [x + "\n" for x in content.split("\n")] if family == "generic" else self.raw(content)
        n_lines = content.count("\n") + 1
        found, types = self.nested(raw, n_lines, language)
        package = self._package(raw, content) or guessed
        first_free = None
        if types == 0 and family in ("python", "js", "generic") and only not in (FIELDS, IMPORTS):
            first_free = next((s.i for s in found if (s.around is None or family == "generic") and self.is_function(s.head)), None)
        for one in found:
            outside = one.around is None and one.group is None
            if (only == IMPORTS and one.around is not None) or (only == FIELDS and (outside or (one.kind == st.TYPE and family == "java"))):
                continue
            if only == TYPES and one.kind != st.TYPE and (family == "java" or (types and family != "go")):
                continue
            rest = one.head.lstrip(NOTHING)
            if not rest or rest in _ENDS:
                continue
            tagged = self.tag(one, outside)
            if tagged is None:
                continue
            tag, m = tagged
            if only == SPANS and tag in ("import", "field"):
                continue
            if only in (TYPES, FUNCTIONS, FIELDS, IMPORTS) and (tag if tag in ("import", "field") else None) != {IMPORTS: "import", FIELDS: "field"}.get(only):
                continue
            row = self._row(one, tag, m, types, first_free, raw, only)
            if row is not None:
                yield (package, n_lines, *row)

    def spans(self, content: str, language: str, guessed: str) -> tuple[list[tuple], list[tuple]]:
        """(type_no, name, start, end, [(start, end, name) of its functions]) of one file's outermost types in order, and of
        what is in no such type, without a name."""
        found: dict[int, list] = {}
        for package, n_lines, line, end, number, tag, outside, name, names, role, opens_module in self.rows(content, language, guessed, SPANS):
            is_type = tag == "type" or opens_module or role == "own"
            if not is_type and role is None:
                continue
            of = found.setdefault(0 if role == "module" else number, [None, []])
            if is_type and (outside or self.family == "generic"):
                if opens_module:
                    last = package if self.family == "js" else package.rsplit(".", 1)[-1]
                    t = (last or "module", 1, n_lines)
                else:
                    t = (names[0] if role == "own" else name, line, end)
                of[0] = t if of[0] is None else max(of[0], t)
            if role is not None:
                of[1].extend((line, end, n) for n in names)
        listed = [(number, t, sorted(functions)) for number, (t, functions) in sorted(found.items())]
        return [(no, *t, fs) for no, t, fs in listed if t is not None], [(no, None, None, None, fs) for no, t, fs in listed if t is None]

    def _package(self, raw, content) -> str:
        if self.family not in ("java", "go") or "package" not in content:
            return ""
        for s in raw:
            if "package" in s:
                head = self._head_of(s)
                if head.startswith("package "):
                    m = self.package.match(head)
                    return m.group(1) if m else ""
        return ""

    def _row(self, one, tag, m, types, first_free, raw, only):
        family, code, around = self.family, one.head, one.around
        names = self._names(code, tag, m)
        owner = owner_kind = None
        if around is not None:
            owner, owner_kind = self.owner(around)
        elif family == "go" and tag == "method":
            owner = self.receiver(m)
        role = self._role(tag, m, one, names, owner, owner_kind, types)
        opens_module = role == "module" and one.i == first_free
        if (only == TYPES and not (tag == "type" or opens_module or role == "own")) or (only == FUNCTIONS and role is None):
            return None

        text = one.text
        before, lead = text[:one.lead], one.lead
        raw_head = text[lead:] if lead else text
        if self.by_braces:
            line = one.line + before.count("\n")
            end = one.end if code[-1:] in ("{", "(") and code else line + code.rstrip(WHITE).count("\n")
        else:
            line, end = one.line, one.end
        is_type = tag == "type"
        name = self._name(m, one) if is_type else None
        if only == SPANS:
            return line, end, one.number, tag, around is None, name, names, role, opens_module
        kind = type_text = imports = None
        docstring = superclass = ""
        parameters, modifiers, interfaces = [], [], []
        if family == "java":
            if is_type:
                kind = m.group(2)
                heritage = m.group(4)
                extends, implements = self._after(self._extends, heritage), self._after(self._implements, heritage)
                if kind == "interface":
                    interfaces = _split(self._outside_angles, extends)
                else:
                    superclass, interfaces = extends.strip(" \t\n"), _split(self._outside_angles, implements)
                kind = "interface" if kind == "@interface" else kind
                docstring = self._comment_above(one, before, raw)
            elif tag == "function":
                parameters = self._parameters(raw_head, m, 5)
                type_text, modifiers = m.group(3) or "", _words(m.group(2))
            elif tag == "field":
                type_text = m.group(2)
            else:
                i = self.java_import.search(raw_head)
                imports = [i.group(1) if i else ""]
        elif family == "python":
            if is_type:
                kind = "class"
                bases = _split(self._commas, m.group(2) or "")
                superclass, interfaces = bases[0] if bases else "", bases[1:]
                docstring = self._docstring(raw, one.i)
            elif tag == "function":
                parameters, type_text = self._parameters(raw_head, m, 4), m.group(5) or ""
                modifiers = [*(["async"] if m.group(2) else []), "private" if m.group(3).startswith("_") else "public"]
            else:
                i = self.python_import.search(raw_head)
                imports = [i.group(0) if i else ""]
        elif family == "go":
            if is_type:
                t, spec = self.go_type.match(code), self.go_spec.match(code) if one.group is not None else None
                kind = "interface" if ((t and t.group(2)) or "") + ((spec and spec.group(2)) or "") == "interface" else "struct"
                docstring = self._comment_above(one, before, raw)
            elif tag == "method":
                parameters, modifiers = self._parameters(raw_head, m, 4), [_exported(m.group(3))]
            elif tag == "function":
                kind, parameters, modifiers = "function", self._parameters(raw_head, m, 3), [_exported(m.group(2))]
            elif tag == "field":
                type_text = m.group(2)
            else:
                imports = self._go_imported.findall(raw_head)
        elif family == "js":
            if is_type:
                kind = "class" if m else "interface"
                if m:
                    superclass = self._after(self._extends, m.group(2)).strip(" \t\n")
                    interfaces = _split(self._outside_angles, self._after(self._implements, m.group(2)))
            elif tag == "function":
                parameters = self._parameters(raw_head, m, 3)
            elif tag == "method":
                parameters, type_text, modifiers = self._parameters(raw_head, m, 4), m.group(5) or "", _words(m.group(2))
            else:
                i = self.js_import.search(raw_head)
                imports = [i.group(0).strip(" ") if i else ""]
        elif is_type:
            kind = m.group(1)
        decorators = self._decorators(code, before, raw_head)
        return (line, end, one.number, tag, around is None, owner, owner_kind, name, names, kind, type_text, parameters, modifiers,
                decorators, docstring, superclass, interfaces, imports, role, opens_module)

    def _name(self, m, one: Statement) -> str:
        """The name of a type, whether or not the stack takes it for one."""
        if self.family == "go":
            m = self.go_type.match(one.head) or self.go_spec.match(one.head)
            return m.group(1)
        return self.type_name(one)

    _struct = re.compile(r"(?u:\b)struct(?u:\b)", re.A)
    _commas = re.compile(",")
    _outside_angles = re.compile(r",(?![^<]*>)")
    _between_parameters = re.compile(r",(?![^<(]*[>)])")
    _extends = re.compile(r"(?u:\b)extends\s+((?:(?!(?u:\b)implements(?u:\b)|(?u:\b)permits(?u:\b))[^{])+)", re.A)
    _implements = re.compile(r"(?u:\b)implements\s+((?:(?!(?u:\b)permits(?u:\b))[^{])+)", re.A)
    _go_imported = re.compile(r'(?:(?!import(?u:\b))[\w.]+\s+)?"[^"]*"', re.A)
    _declarator = re.compile(r"\s*+([\w$]+)", re.A)
    _between_fields = re.compile(r"\s*,\s*", re.A)
    _paired = [re.compile(p) for p in _PAIRS]

    @staticmethod
    def _after(pattern: re.Pattern, heritage: str) -> str:
        m = pattern.search(heritage)
        return m.group(1) if m else ""

    def _parameters(self, raw_head: str, m: re.Match, group: int) -> list[str]:
        # Cut from the head as it is, at the place and length found in the blanked one.
        begin = len(m.group(1))
        return _split(self._between_parameters, raw_head[begin:begin + len(m.group(group))])

    def _names(self, code: str, tag: str, m) -> list[str] | None:
        family = self.family
        if family == "generic":
            return self.generic_functions(code)
        if tag in ("function", "method"):
            return [m.group({"java": 4, "python": 3, "go": 3 if tag == "method" else 2, "js": 3 if tag == "method" else 2}[family])]
        if tag != "field":
            return None
        if family == "go":
            return self._between_fields.split(m.group(1))
        begin = self.java_field_type.match(code)
        rest = code[begin.end() if begin else 0:]
        for pair in self._paired:
            rest = pair.sub("", rest)
        return [d.group(1) for d in map(self._declarator.match, rest.split(",")) if d]

    def _role(self, tag, m, one, names, owner, owner_kind, types) -> str | None:
        family, outside = self.family, one.around is None
        if not outside:
            if ((family == "java" and tag == "function" and (m.group(3) or names[0] == owner)) or (family == "python" and tag == "function")
                    or (family == "js" and tag == "method" and owner_kind == "class") or (family == "generic" and names)):
                return "member"
        if family == "go":
            return "received" if tag == "method" and one.number >= 0 else "own" if tag == "function" else None
        return "module" if outside and tag == "function" and types == 0 and family in ("python", "js", "generic") else None

    def _decorators(self, code, before, raw_head) -> list[str]:
        family = self.family
        if family not in ("java", "js", "python") or not ("@" in before or raw_head.startswith("@")):
            return []
        if family == "java":
            if not code.startswith("@"):
                return []
            noted = self.java_noted.match(raw_head)
            before = noted.group(0) if noted else ""
        found = getattr(self, f"note_{family}").findall(before)
        return [x.strip(WHITE) for x in found if x.startswith("@")]

    def _comment_above(self, one, before, raw) -> str:
        """Text of the comment that ends right above a head, without its markers; it begins on a line of its own."""
        if "/" not in before and "#" not in before:
            return ""
        lines = "\n" + before if one.i == 0 or raw[one.i - 1].endswith("\n") else before
        m = self.comment.search(lines)
        kept = []
        for x in (m.group(1) if m else "").strip("\r\n").split("\n"):
            x = x.strip(" \t\r")
            kept.append(x.lstrip("#/ ") if x.startswith(("//", "#")) else x)
        text = "\n".join(kept).replace("/**", "").replace("*/", "").replace("/*", "")
        return self.stars.sub("", text).strip(" \t\n")

    def _docstring(self, raw, i) -> str:
        """The string that a Python class body begins with."""
        if i + 1 >= len(raw):
            return ""
        below = raw[i + 1]
        m = self.doc.search(below[self.lead_of(self.code_of(below)):])
        return "".join(g or "" for g in m.groups()).strip(" \t\n") if m else ""


def _split(pattern: re.Pattern, text: str) -> list[str]:
    if not text:
        return []
    return [x for x in (p.strip(" \t\n") for p in pattern.split(text)) if x]


def _words(text: str | None) -> list[str]:
    return [x for x in re.split(r"\s+", (text or "").strip(" \t\n"), flags=re.A) if x]


def _exported(name: str) -> str:
    return "public" if unicodedata.category(name[0]) == "Lu" else "private"


# --- on batches --------------------------------------------------------------------------------------

_TEXTS = pa.list_(pa.string())
_COLUMNS = (
    ("line_no", pa.int32()), ("end_line", pa.int32()), ("number", pa.int32()), ("tag", pa.string()), ("outside", pa.bool_()),
    ("owner", pa.string()), ("owner_kind", pa.string()), ("name", pa.string()), ("names", _TEXTS), ("kind", pa.string()),
    ("type_text", pa.string()), ("parameters", _TEXTS), ("modifiers", _TEXTS), ("decorators", _TEXTS), ("docstring", pa.string()),
    ("superclass", pa.string()), ("interfaces", _TEXTS), ("import_texts", _TEXTS), ("role", pa.string()), ("opens_module", pa.bool_()),
)
_PARTS = ("kind", "type_text", "parameters", "modifiers", "decorators", "docstring", "superclass", "interfaces", "import_texts")


_SPANS = "array<struct<type_no:int,name:string,start:int,end:int,functions:array<struct<start:int,end:int,name:string>>>>"
SPAN_ROWS = f"relative_path string, spans {_SPANS}, loose {_SPANS}"
_FUNCTION_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string())])
_SPAN = pa.struct([("type_no", pa.int32()), ("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("functions", pa.list_(_FUNCTION_SPAN))])


def _texts(column: pa.Array) -> list[str | None]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def guess_package(path: str | None) -> str:
    """``texts.guess_package`` of one path."""
    parts = (path or "").split("/")
    for marker in fv.PACKAGE_MARKERS:
        if marker in parts:
            at = parts.index(marker) + 1
            if at < len(parts) - 1:
                return ".".join(parts[at:-1])
    return ""


class Readers:
    """The readers of the families that a task meets, made as they are needed."""

    def __init__(self):
        self.patterns, self.made = _patterns(), {}

    def of(self, language: str | None) -> Reader:
        family = st.FAMILY.get(language, "generic")
        if family not in self.made:
            self.made[family] = Reader(family, self.patterns)
        return self.made[family]


def files_of(batch: pa.RecordBatch, readers: Readers) -> Iterator[tuple]:
    """(place, text, language, guessed package, reader) of a batch's files; one without a text declares nothing."""
    paths, languages = (_texts(batch.column(n)) for n in ("relative_path", "language"))
    content = batch.column("content")
    for begin in range(0, batch.num_rows, 256):
        for at, text in enumerate(_texts(content.slice(begin, 256)), begin):
            if text is not None:
                yield at, text, languages[at], guess_package(paths[at]), readers.of(languages[at])


def reader_of(only: str | None):
    """A function of batches (relative_path, language, content) to batches of RESOLVED."""
    readers = Readers()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(batch, places, file_rows, rows) -> pa.RecordBatch:
            take = pa.array(places, pa.int32())
            path, language = (batch.column(n).take(take) for n in ("relative_path", "language"))
            family = pa.array([f for f, _, _ in file_rows], pa.string())
            package = pa.array([p for _, p, _ in file_rows], pa.string())
            n_lines = pa.array([n for _, _, n in file_rows], pa.int32())
            columns = {name: pa.array(values, kind) for (name, kind), values in zip(_COLUMNS, zip(*rows, strict=True), strict=True)}
            d = pa.StructArray.from_arrays([columns[c] for c in _PARTS], names=list(_PARTS))
            out = {"relative_path": path, "language": language, "family": family, "package": package, "n_lines": n_lines}
            out |= {c: columns[c] for c in ("line_no", "end_line", "number", "tag", "outside", "owner", "owner_kind", "name", "names")}
            out |= {"d": d, "role": columns["role"], "opens_module": columns["opens_module"]}
            return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        for batch in batches:
            places, file_rows, rows = [], [], []
            for at, text, language, guessed, reader in files_of(batch, readers):
                for package, n_lines, *row in reader.rows(text, language, guessed, only):
                    places.append(at)
                    file_rows.append((reader.family, package, n_lines))
                    rows.append(row)
                if len(rows) >= ROWS:
                    yield sent(batch, places, file_rows, rows)
                    places, file_rows, rows = [], [], []
            if rows:
                yield sent(batch, places, file_rows, rows)

    return read


def spans_of():
    """A function of batches (relative_path, language, content) to one row for each file that declares something:
    the spans of its outermost types, and what is in none of them."""
    readers = Readers()

    def listed(column: list[list[tuple]]) -> pa.Array:
        """Nested arrays, built from the inside out."""
        functions = [f for spans in column for span in spans for f in span[4]]
        start, end, name = zip(*functions, strict=True) if functions else ((), (), ())
        of = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(name, pa.string())], fields=list(_FUNCTION_SPAN))
        spans = [span for spans in column for span in spans]
        at = pa.array(list(accumulate((len(span[4]) for span in spans), initial=0)), pa.int32())
        parts = [pa.array([span[k] for span in spans], _SPAN.field(k).type) for k in range(4)]
        each = pa.StructArray.from_arrays([*parts, pa.ListArray.from_arrays(at, of, type=_SPAN.field(4).type)], fields=list(_SPAN))
        return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, column), initial=0)), pa.int32()), each, type=pa.list_(_SPAN))

    def sent(batch, places, rows) -> pa.RecordBatch:
        path = batch.column("relative_path").take(pa.array(places, pa.int32()))
        return pa.RecordBatch.from_arrays([path, listed([r[0] for r in rows]), listed([r[1] for r in rows])], names=["relative_path", "spans", "loose"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, rows, n = [], [], 0
            for at, text, language, guessed, reader in files_of(batch, readers):
                found = reader.spans(text, language, guessed)
                if found[0] or found[1]:
                    rows.append(found)
                    places.append(at)
                    n += sum(len(span[4]) + 1 for part in found for span in part)
                if n >= ROWS:
                    yield sent(batch, places, rows)
                    places, rows, n = [], [], 0
            if rows:
                yield sent(batch, places, rows)

    return read
