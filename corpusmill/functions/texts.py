"""Measures and cleaning of one text or path; all of them built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import fixed_values as fv
from corpusmill.functions.jsonfix import let

# What the trimming rules count as white space, the line feed left out.
BLANK_CLASS = r"\t\x0B\f\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
IDENTIFIER = r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*$"


def choose(key: Column, by_value: dict[str, Column], otherwise: Column | None = None) -> Column:
    """One CASE over the values of ``key``; only the chosen branch is evaluated."""
    case = F
    for value, column in by_value.items():
        case = case.when(key == value, column)
    return case if otherwise is None else case.otherwise(otherwise)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def extension(path: Column) -> Column:
    """Lower-case text from the last dot of the whole path, '' without one."""
    return F.when(
        F.contains(path, F.lit(".")), F.lower(F.concat(F.lit("."), F.substring_index(path, ".", -1)))
    ).otherwise("")


def language_of(path: Column) -> Column:
    """Language by the suffix of the file name; a leading or trailing dot starts no suffix."""
    suffix = F.lower(F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1))
    by_suffix = F.create_map(*[F.lit(x) for pair in fv.LANGUAGE_BY_SUFFIX.items() for x in pair])
    return F.coalesce(F.element_at(by_suffix, suffix), F.lit(fv.UNKNOWN_LANGUAGE))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, fv.HASH_CHARS)


def newline_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    """Line feeds, plus one for a last line that has none."""
    open_end = (F.octet_length(text) > 0) & ~F.endswith(text, F.lit("\n"))
    return (newline_count(text) + open_end.cast("int")).cast("long")


def is_generated(text: Column, markers=fv.GENERATED_MARKERS, head_lines=fv.GENERATED_HEAD_LINES) -> Column:
    head = F.lower(F.substring_index(text, "\n", head_lines))
    return reduce(lambda a, b: a | b, [F.contains(head, F.lit(m)) for m in markers])


def mostly_binary(
    text: Column, threshold: float = fv.BINARY_THRESHOLD, sample_chars: int = fv.BINARY_SAMPLE_CHARS
) -> Column:
    sample = F.substring(text, 1, sample_chars)
    controls = F.regexp_count(sample, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    return F.when(F.octet_length(text) == 0, F.lit(False)).otherwise(
        controls / F.length(sample) > F.lit(threshold)
    )


def clean_text(text: Column) -> Column:
    """Right-trim every line and keep at most two blank lines in a row.

    k line feeds make k blank lines at an end of the text but k - 1 inside it, hence the
    separate rules. Look-behinds let a run be tried from its start only, so the cost stays
    linear on texts with very long runs.
    """

    def trimmed(t: Column) -> Column:
        # Most texts have nothing to trim, which their line feeds tell; only the others are searched blank by blank.
        some = F.rlike(t, F.lit(rf"\n(?<=[{BLANK_CLASS}]\n)")) | F.rlike(F.substring(t, -1, 1), F.lit(rf"[{BLANK_CLASS}]"))
        return F.when(some, F.regexp_replace(t, rf"(?<![{BLANK_CLASS}])[{BLANK_CLASS}]++(?=\n|\z)", "")).otherwise(t)

    def collapsed(t: Column) -> Column:
        ends = F.regexp_replace(F.regexp_replace(t, r"\A\n{3,}", "\n\n"), r"(?<!\n)\n{3,}+\z", "\n\n")
        only_newlines = F.startswith(t, F.lit("\n")) & (F.replace(t, F.lit("\n"), F.lit("")) == "")
        return F.when(only_newlines, F.lit("\n")).when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(ends, r"\n{4,}", "\n\n\n")).otherwise(t)

    # The branches share one text, and one trimmed text: as part of each of them it would be made up to four times.
    return let(text, lambda t: let(trimmed(t), collapsed))


def guess_package(path: Column, markers=fv.PACKAGE_MARKERS) -> Column:
    """Directories after the first usable marker directory, joined by dots."""
    parts = F.split(path, "/", -1)
    n = F.size(parts)

    def after(marker: str) -> Column:
        at = F.array_position(parts, F.lit(marker)).cast("int")
        return F.when(
            (at > 0) & (at < n - 1),
            F.array_join(F.slice(parts, at + 1, F.greatest(n - 1 - at, F.lit(0))), "."),
        )

    return F.coalesce(*[after(m) for m in markers], F.lit(""))


def class_names(text: Column, language: Column) -> Column:
    """Words after a type keyword, per line and keyword, where the word is an identifier."""

    def found(keywords) -> Column:
        def on_line(line: Column) -> Column:
            words = [F.regexp_extract(line, rf"{k}[{BLANK_CLASS}]*([^{BLANK_CLASS}{{(:]*)", 1) for k in keywords]
            return F.filter(F.array(*words), lambda w: F.rlike(w, F.lit(IDENTIFIER)))

        def may_hold(line: Column) -> Column:
            return reduce(lambda a, b: a | b, [F.contains(line, F.lit(k)) for k in keywords])

        return F.flatten(F.transform(F.filter(lines_of(text), may_hold), on_line))

    by_language = {lang: found(keywords) for lang, keywords in fv.NAME_KEYWORDS.items()}
    return choose(language, by_language, found(fv.NAME_KEYWORDS_OTHERWISE))


# Words and signs at which a program's way divides.
BRANCH_WORDS = ("if", "elif", "for", "while", "case", "catch", "except", "switch")
_BRANCH = rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(BRANCH_WORDS)})(?![\p{{L}}\p{{N}}_])|&&|\|\|"


def branch_count(text: Column) -> Column:
    """Branch words and signs in a text."""
    return F.regexp_count(text, F.lit(_BRANCH)).cast("long")


def branch_score(branches: Column) -> Column:
    """1, and one more for each three branches."""
    return (1 + F.floor(branches / 3)).cast("long")


def is_public(modifiers: Column, name: Column) -> Column:
    return (
        F.when(F.array_contains(modifiers, "private"), F.lit(False))
        .when(F.array_contains(modifiers, "public"), F.lit(True))
        .otherwise(~F.startswith(name, F.lit("_")))
    )


def fqn(package: Column, name: Column) -> Column:
    return F.concat_ws(".", F.nullif(package, F.lit("")), name)


def prompt_text(
    source_files: Column, language: Column, class_names_: Column, function_names: Column, content: Column
) -> Column:
    """Header lines naming the files, language and declarations, a rule, then the content."""

    def listed(label: str, names: Column) -> Column:
        return F.when(
            F.size(names) > 0, F.concat(F.lit(f"### {label}: "), F.array_join(names, ", "), F.lit("\n"))
        ).otherwise("")

    return F.concat(
        F.lit("### File: "), F.array_join(source_files, ", "), F.lit("\n### Language: "), language, F.lit("\n"),
        listed("Classes", class_names_),
        listed("Functions", function_names),
        F.lit("---\n"), content,
    )
