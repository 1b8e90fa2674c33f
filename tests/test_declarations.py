import pytest

from corpusmill.operators.declarations import declarations

LEDGER = '''package org.mill.ledger;

import java.time.Instant;
import java.util.*;

@Deprecated
@Table(name = "ledger")
public final class Ledger extends Book {
    protected long balance = 4L;
    String owner, witness;

    Ledger(String owner) { this.owner = owner; }

    @Override @Nullable
    public Optional<Entry> last() {
        return entries.isEmpty() ? Optional.empty() : Optional.of(entries.get(0));
    }

    protected static Map<Instant, List<Entry>> byDay(Collection<Entry> all,
                                                     int days)
    {
        String text = "class Fake { }";
        while (days > 0) { days--; }
        return new TreeMap<>() { public int size() { return 1; } };
    }
    private enum Side { LEFT, RIGHT; }
}
'''
TIDES = '''import math

from harbour import (
    Gauge,
)

class Tide(Gauge, metaclass=Meta):
    '''+"'''"+'''High and low water.'''+"'''"+'''
    def __init__(self, place, *, zone=None):
        self.place = place
    @staticmethod
    @cache
    def of(place: str) -> "Tide":
        note = '''+"'''"+'''
class Ghost:
'''+"'''"+'''
        return Tide(
place)
    def _level(self): return 0
    class Moon:
        def phase(self): return 1

def print_all(tides): return [t for t in tides]
'''
KILN = '''package kiln

import (
	"os"
	clay "kiln/clay"
)

// Oven fires pots.
type Oven struct {
	Heat int
	Pots []clay.Pot
}

type Firer interface {
	Fire() error
}

func (o Oven) Fire() error { return nil }
func (o *Oven) cool(steps int, slow bool) (left int, err error) {
	return 0, nil
}
func (w *Wheel) Spin() {}
func main() { os.Exit(0) }
'''
LOOM = '''import yarn from 'yarn';

class Loom extends Frame {
  constructor() { super(); }
  get width() { return 3; }
  async weave(threads, ...rest) {
    for (const t of threads) { await this.pass(t); }
  }
}
module.exports = Loom;
'''
FORGE = '''module Forge
  class Anvil
    def strike(force); force * 2; end
    def ring(times) = times
  end
end
'''


@pytest.fixture(scope="module")
def declared(spark, files):
    df = files(
        ("src/Ledger.java", LEDGER), ("app/tides.py", TIDES), ("pkg/kiln.go", KILN), ("web/loom.js", LOOM), ("x/forge.rb", FORGE),
        ("src/api/Courier.java", "package org.mill;\npublic interface Courier extends Sender {\n    Parcel[] waiting(int depot);\n}"),
        ("f/loose.py", "def first():\n    return 1\ndef second(a, b=2):\n    return a * b"),
        ("src/Shapes.java", "record Span(long from, long to) implements Sized {\n}\nenum Mood {\n  CALM,\n  WILD;\n  boolean loud() { return this == WILD; }\n}\n"),
        ("src/Split.java", "public class Split\n    extends Root\n    implements P<K, V>, Q\n{\n  int half(\n      int whole)\n  {\n    return whole / 2;\n  }\n}\n"),
        ("web/wide.ts", "export default class Wide\n{\n  public fit(\n    box: string,\n    gap = size(1),\n  ): Promise<void> {\n    if (box) { pad(); }\n  }\n}\nconst plain = {\n  notAMember(q) {\n    return q;\n  }\n};\n"),
        ("src/Torn.java", "public class Torn { void open( {"), ("e/empty.py", ""), ("e/Empty.java", ""), ("e/empty.go", ""), ("e/empty.rb", ""),
    )
    d = declarations(df)
    return {k: [r.asDict(recursive=True) for r in getattr(d, k).collect()] for k in d._fields}


def of(rows, path, **where):
    return sorted(
        (r for r in rows if r["relative_path"] == path and all(r[k] == v for k, v in where.items())),
        key=lambda r: r.get("start_line") or r.get("line_no"),
    )


def test_java_type(declared):
    t, side = of(declared["types"], "src/Ledger.java")
    assert (side["name"], side["kind"], side["outer"], side["start_line"], side["end_line"]) == ("Side", "enum", "Ledger", 26, 26)
    assert (t["name"], t["kind"], t["package"], t["fqn"], t["superclass"]) == ("Ledger", "class", "org.mill.ledger", "org.mill.ledger.Ledger", "Book")
    assert t["decorators"] == ["@Deprecated", '@Table(name = "ledger")']
    assert (t["start_line"], t["end_line"]) == (6, 27)


def test_java_methods(declared):
    fns = of(declared["functions"], "src/Ledger.java")
    assert [f["name"] for f in fns] == ["Ledger", "last", "byDay"]
    assert [(f["start_line"], f["end_line"]) for f in fns] == [(12, 12), (14, 17), (19, 25)]
    assert fns[2]["parameters"] == ["Collection<Entry> all", "int days"] and fns[1]["is_public"]
    assert fns[2]["return_type"] == "Map<Instant, List<Entry>>"


def test_java_fields_and_imports(declared):
    assert [(f["name"], f["type"]) for f in of(declared["fields"], "src/Ledger.java")] == [
        ("balance", "long"), ("owner", "String"), ("witness", "String")]
    assert [i["import_text"] for i in of(declared["imports"], "src/Ledger.java")] == ["java.time.Instant", "java.util.*"]


def test_java_interface_record_enum(declared):
    (t,) = of(declared["types"], "src/api/Courier.java")
    assert t["kind"] == "interface"
    (f,) = of(declared["functions"], "src/api/Courier.java")
    assert (f["name"], f["start_line"], f["end_line"]) == ("waiting", 3, 3)
    assert [(t["name"], t["kind"], t["end_line"]) for t in of(declared["types"], "src/Shapes.java")] == [("Span", "record", 2), ("Mood", "enum", 7)]
    assert [f["name"] for f in of(declared["functions"], "src/Shapes.java")] == ["loud"]


def test_heads_over_several_lines(declared):
    (t,) = of(declared["types"], "src/Split.java")
    assert (t["name"], t["superclass"], t["interfaces"], t["start_line"], t["end_line"]) == ("Split", "Root", ["P<K, V>", "Q"], 1, 10)
    assert [(f["name"], f["parameters"], f["start_line"], f["end_line"]) for f in of(declared["functions"], "src/Split.java")] == [("half", ["int whole"], 5, 9)]
    (t,) = of(declared["types"], "web/wide.ts")
    assert (t["name"], t["start_line"], t["end_line"]) == ("Wide", 1, 9)
    assert [(f["name"], f["parameters"], f["start_line"], f["end_line"]) for f in of(declared["functions"], "web/wide.ts")] == [
        ("fit", ["box: string", "gap = size(1)"], 3, 8)]


def test_python(declared):
    t, moon = of(declared["types"], "app/tides.py")
    assert (moon["name"], moon["outer"], moon["start_line"], moon["end_line"]) == ("Moon", "Tide", 20, 21)
    assert (t["name"], t["docstring"], t["start_line"], t["end_line"]) == ("Tide", "High and low water.", 7, 21)
    fns = of(declared["functions"], "app/tides.py")
    assert [(f["name"], f["start_line"], f["end_line"], f["is_public"]) for f in fns] == [
        ("__init__", 9, 10, False), ("of", 13, 18, True), ("_level", 19, 19, False), ("phase", 21, 21, True)]
    assert fns[1]["decorators"] == ["@staticmethod", "@cache"] and fns[1]["parameters"] == ["place: str"]


def test_functions_without_a_type_become_a_module(declared):
    (t,) = of(declared["types"], "f/loose.py")
    assert (t["name"], t["kind"], t["start_line"], t["end_line"]) == ("module", "module", 1, 4)
    assert [f["name"] for f in of(declared["functions"], "f/loose.py")] == ["first", "second"]


def test_go(declared):
    types = of(declared["types"], "pkg/kiln.go")
    assert [(t["name"], t["kind"], t["package"]) for t in types] == [("Oven", "struct", "kiln"), ("Firer", "interface", "kiln"), ("main", "function", "kiln")]
    assert [(f["owner"], f["name"], f["is_public"]) for f in of(declared["functions"], "pkg/kiln.go")] == [
        ("Oven", "Fire", True), ("Oven", "cool", False), ("main", "main", False)]
    assert [f["name"] for f in of(declared["fields"], "pkg/kiln.go", owner="Oven")] == ["Heat", "Pots"]
    assert sorted(i["import_text"] for i in of(declared["imports"], "pkg/kiln.go")) == ['clay "kiln/clay', "os"]


def test_javascript(declared):
    (t,) = of(declared["types"], "web/loom.js")
    assert (t["name"], t["superclass"], t["start_line"], t["end_line"]) == ("Loom", "Frame", 3, 9)
    assert [(f["name"], f["start_line"], f["end_line"]) for f in of(declared["functions"], "web/loom.js")] == [
        ("constructor", 4, 4), ("width", 5, 5), ("weave", 6, 8)]


def test_generic(declared):
    (t,) = of(declared["types"], "x/forge.rb")
    assert (t["name"], t["kind"]) == ("Anvil", "class")
    assert [f["name"] for f in of(declared["functions"], "x/forge.rb")] == ["strike", "ring"]


def test_empty_and_broken(declared):
    for path in ("e/empty.py", "e/Empty.java", "e/empty.go", "e/empty.rb"):
        assert not of(declared["types"], path) and not of(declared["functions"], path)
    assert [t["name"] for t in of(declared["types"], "src/Torn.java")] == ["Torn"]


NEST = '''package org.mill;

/* Not this one. */

/** Keeps
 * pots. */
@Shelf(
    value = "a{b", /* why */
    sizes = {1, 2}
)
@Fired class Kiln { int a, b = f(1, 2), c; void heat() { if (a > 0) { b++; } } int cool(int[] x, Map<String, List<Integer>> y) { return x[0]; }
    static class Brick { Brick() {} enum Kind { SOFT, HARD(2) { void no() {} }; Kind next() { return this; } } }
    Runnable r = new Runnable() { public void run() { class Local { void lost() {} } } };
    @Get("/x;{")
    @Deep(@In(@In(@In("(")))) public
    String late() { return "}"; }
}
@interface Mark { int value() default 1; }
'''


@pytest.fixture(scope="module")
def nested(spark, files):
    deep = "@" + "known(\n" + "  1,\n" * 30 + ")"
    go = "package p\ntype (\n\tA struct{}\n\t// B it is.\n\tB interface { Go() }\n\tC map[string]int\n)\ntype D struct { X, Y int; z *A }\nvar (\n\tq struct { w int }\n)\nfunc (a *A) One() {}; func (c C) Two() { }\n"
    script = "export default class One { a() { return 1 } static async *b(x = {y: 1}) { } }\n@Dec({ a: [1] })\n@Two class T { constructor() {} }\nconst f = { no() {} };\n"
    body = "# lead\n" + deep + "\n\n\n\nclass Far(Base):\n    '''Doc \\''' more.'''\n    class In:\n        x = [\n1,\n]\n        def go(self): pass\n    def out(self, a=(1,\n      2)): return a\n    if 1:\n        def hidden(self): pass\ndef free(): pass\n"
    d = declarations(files(("a/Kiln.java", NEST), ("p/a.go", go), ("w/one.ts", script), ("a/far.py", body)))
    return {k: [r.asDict(recursive=True) for r in getattr(d, k).collect()] for k in d._fields}


def test_types_in_types_and_bodies_on_one_line(nested):
    types = of(nested["types"], "a/Kiln.java")
    assert [(t["name"], t["kind"], t["outer"], t["start_line"], t["end_line"]) for t in types] == [
        ("Kiln", "class", "", 7, 17), ("Brick", "class", "Kiln", 12, 12), ("Kind", "enum", "Brick", 12, 12), ("Mark", "interface", "", 18, 18)]
    assert types[0]["docstring"] == "Keeps\\npots.".replace("\\n", "\n")
    assert types[0]["decorators"] == ['@Shelf(\n    value = "a{b", /* why */\n    sizes = {1, 2}\n)', "@Fired"]
    fns = of(nested["functions"], "a/Kiln.java")
    assert sorted((f["owner"], f["name"]) for f in fns) == [
        ("Brick", "Brick"), ("Kiln", "cool"), ("Kiln", "heat"), ("Kiln", "late"), ("Kind", "next"), ("Mark", "value")]
    (late,) = [f for f in fns if f["name"] == "late"]
    assert (late["start_line"], late["end_line"], late["decorators"]) == (14, 16, ['@Get("/x;{")', '@Deep(@In(@In(@In("("))))'])
    assert [(f["owner"], f["name"], f["type"]) for f in of(nested["fields"], "a/Kiln.java")] == [
        ("Kiln", "a", "int"), ("Kiln", "b", "int"), ("Kiln", "c", "int"), ("Kiln", "r", "Runnable")]


def test_go_groups(nested):
    types = of(nested["types"], "p/a.go")
    assert [(t["name"], t["kind"], t["docstring"], t["start_line"], t["end_line"]) for t in types] == [
        ("A", "struct", "", 3, 3), ("B", "interface", "B it is.", 5, 5), ("C", "struct", "", 6, 6), ("D", "struct", "", 8, 8)]
    assert sorted((f["owner"], f["name"]) for f in of(nested["functions"], "p/a.go")) == [("A", "One"), ("C", "Two")]
    assert [(f["owner"], f["name"]) for f in of(nested["fields"], "p/a.go")] == [("D", "X"), ("D", "Y"), ("D", "z")]


def test_scripts_on_one_line(nested):
    types = of(nested["types"], "w/one.ts")
    assert [(t["name"], t["decorators"], t["start_line"], t["end_line"]) for t in types] == [("One", [], 1, 1), ("T", ["@Dec({ a: [1] })", "@Two"], 3, 3)]
    assert sorted((f["owner"], f["name"]) for f in of(nested["functions"], "w/one.ts")) == [("One", "a"), ("One", "b"), ("T", "constructor")]


def test_decorators_and_lists_over_many_lines(nested):
    types = of(nested["types"], "a/far.py")
    assert [(t["name"], t["outer"], t["start_line"], t["end_line"]) for t in types] == [("Far", "", 37, 47), ("In", "Far", 39, 43)]
    assert types[0]["decorators"] == ["@known(\n" + "  1,\n" * 30 + ")"] and types[0]["docstring"] == "Doc \\''' more."
    assert [(f["owner"], f["name"], f["start_line"], f["end_line"]) for f in of(nested["functions"], "a/far.py")] == [("In", "go", 43, 43), ("Far", "out", 44, 45)]


def test_one_very_large_file(spark, files):
    """A file's cost is that of its length: 40,000 lines with 5,000 methods."""
    method = "    public int m{i}(int x) {{\n        if (x > 0) {{\n            return {i};\n        }}\n        return x;\n    }}\n\n\n"
    text = "public class Vast {\n" + "".join(method.format(i=i) for i in range(5_000)) + "}\n"
    d = declarations(files(("src/Vast.java", text)))
    rows = d.functions.selectExpr("count(*) as n", "max(end_line) as last", "sum(end_line - start_line) as long").collect()
    assert [tuple(r) for r in rows] == [(5_000, 39_999, 25_000)]
    (t,) = d.types.collect()
    assert (t["name"], t["start_line"], t["end_line"]) == ("Vast", 1, 40_002)


def test_no_statement_is_read_again_for_a_filter(files):
    from corpusmill.operators import declarations as D

    for table in D.declarations(files(("a/A.java", "class A { int n; void f() { } }"))):
        # Java and Go tell fields, each at one place.
        assert table._jdf.queryExecution().optimizedPlan().toString().count("THEN field") <= 2


def test_heads_that_open_nothing_are_not_blanked_for_the_stack(files):
    from corpusmill.operators import declarations as D, statements as st

    code = "package a;\nclass A {\n  void f() { g('}'); /* class */ }\n}\n"
    kinds = {"go": {}}
    heads = st.statements(files(("a/A.java", code)), D.IS_TYPE, kinds, {"go": D._go_key}).first()["heads"]
    assert [h for h in heads if h is not None] == ["package a;", "class A {"]
