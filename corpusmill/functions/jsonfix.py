"""Reading JSON objects out of free text, and typing them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _one_value(text: Column) -> Column:
    """The JSON value that is the whole of ``text``, as a variant.

    The parser accepts text after a value; inside brackets it must reject it, and a second
    element shows that there was more than one value.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return let(
        wrapped,
        lambda v: F.when(F.variant_get(v, "$[1]", "variant").isNull(), F.variant_get(v, "$[0]", "variant")),
    )


# A lexeme of JSON as models write it: a string (without its quote where the text ends in it), a comment, a run of
# white space, a bracket or comma, or a run of anything else.
_LEXEMES = r'(?s)"(?:[^"\\]++|\\.)*+"?|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?|[\[\]{},]|[^"/\[\]{},\s]++|\s++|/'
_OPEN_STRING = r'(?s)^"(?:[^"\\]++|\\.)*+$'


def _first_object(raw: Column) -> Column:
    """The text of the first object in ``raw``, in one walk over its lexemes, or null.

    Strings stay as they are, so that nothing in them is taken for a comment or a comma. Comments go, and so does a
    comma in front of a closing bracket; what is still open at the end is closed. An object with another closing
    brace after it is none: it isn't clear which one is meant.
    """
    begun = F.regexp_extract(raw, r'(?s)\{\s*(?:["}/].*|\z)', 0)
    lexemes = F.filter(
        F.regexp_extract_all(begun, F.lit(_LEXEMES), F.lit(0)),
        lambda x: ~F.rlike(x, F.lit(r"^(?:\s|//|/\*)")),
    )

    def walk(s: Column, x: Column) -> Column:
        at = s["at"] + 1
        shut = F.substring(s["open"], 2, 1 << 30)

        def state(open_: Column, end: Column) -> Column:
            return F.struct(at.alias("at"), open_.alias("open"), end.alias("end"))

        return (
            F.when(s["end"] > 0, s)
            .when(x == "{", state(F.concat(F.lit("}"), s["open"]), s["end"]))
            .when(x == "[", state(F.concat(F.lit("]"), s["open"]), s["end"]))
            .when(x == F.substring(s["open"], 1, 1), state(shut, F.when(shut == "", at).otherwise(0)))
            .otherwise(state(s["open"], s["end"]))
        )

    start = F.expr("named_struct('at', 0, 'open', '', 'end', 0)")

    def text(ls: Column) -> Column:
        def cut(s: Column) -> Column:
            rest = F.when(s["end"] > 0, F.slice(ls, s["end"] + 1, F.greatest(F.size(ls) - s["end"], F.lit(0))))
            inside = F.when(s["end"] > 0, F.slice(ls, 1, s["end"])).otherwise(ls)

            def tidy(own: Column) -> Column:
                def piece(x: Column, i: Column) -> Column:
                    after = F.coalesce(F.get(own, i + 1), F.lit("}"))
                    unquoted = after.isNotNull() & (i == F.size(own) - 1) & F.rlike(x, F.lit(_OPEN_STRING))
                    return F.when((x == ",") & after.isin("]", "}"), "").when(unquoted, F.concat(x, F.lit('"'))).otherwise(x)

                return F.concat(F.array_join(F.transform(own, piece), " "), F.when(s["end"] > 0, "").otherwise(s["open"]))

            return F.when(~F.coalesce(F.exists(rest, lambda x: x == "}"), F.lit(False)), let(inside, tidy))

        return F.when(F.size(ls) > 0, let(F.aggregate(ls, start, walk), cut))

    return let(lexemes, text)


def repair_json(raw: Column) -> Column:
    """The object in ``raw`` as compact JSON text, or null: the whole text if it is one value, else its first object."""
    whole = lambda t: F.coalesce(_one_value(t), _one_value(_first_object(t)))
    return let(
        let(F.btrim(raw, F.lit(WHITE)), whole),
        lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.to_json(v)),
    )


# Fields of one chunk analysis; whole numbers are read as text first, since the reader turns a quoted
# number into null where an integer is declared.
ANALYSIS_SCHEMA = (
    "file_path string, summary string, purpose string, "
    "key_methods array<struct<name:string,signature:string,description:string,complexity:string>>, "
    "dependencies array<string>, complexity_score string, complexity_notes string"
)


def whole_number(text: Column) -> Column:
    return text.try_cast("double").try_cast("int")


def parse_typed(json: Column) -> Column:
    """A typed chunk analysis: unknown keys dropped, missing ones defaulted.

    ``_corrupt`` marks a text that is no object or a number field that holds no number.
    """

    def typed(a: Column) -> Column:
        def text(name: str) -> Column:
            return F.coalesce(a[name], F.lit("")).alias(name)

        def method(m: Column) -> Column:
            return F.struct(
                F.coalesce(m["name"], F.lit("")).alias("name"),
                F.coalesce(m["signature"], F.lit("")).alias("signature"),
                F.coalesce(m["description"], F.lit("")).alias("description"),
                F.coalesce(whole_number(m["complexity"]), F.lit(0)).alias("complexity"),
            )

        no_methods = F.expr(
            "cast(array() as array<struct<name:string,signature:string,description:string,complexity:int>>)"
        )
        score = whole_number(a["complexity_score"])
        return F.struct(
            text("file_path"), text("summary"), text("purpose"),
            F.coalesce(F.transform(a["key_methods"], method), no_methods).alias("key_methods"),
            F.coalesce(a["dependencies"], F.expr("cast(array() as array<string>)")).alias("dependencies"),
            F.coalesce(score, F.lit(0)).alias("complexity_score"),
            text("complexity_notes"),
            (a.isNull() | (a["complexity_score"].isNotNull() & score.isNull())).alias("_corrupt"),
        )

    return let(F.from_json(json, ANALYSIS_SCHEMA), typed)
