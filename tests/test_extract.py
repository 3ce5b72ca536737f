"""Extraction per language: what is found, where, and what is left alone."""
import pytest
from pyspark.sql import functions as F

from bindery.operators import extract as E
from bindery.operators.extract import brace_scope, extract_assignments, last_occurrence

FILES = {
    "orbit.py": '''
PLANET = "saturn"
moons: list[str] = []
mass: float
mass *= 2.5
x, (y, *zs) = origin

def tilt(angle):
    degrees = angle
    class Ring:
        width = (10
                 + 2)
        def grow(self):
            self.band.color = "tan"
            while (step := degrees - 1):
                degrees = step
    return Ring
''',
    "half.py": "ring = [1,\n",
    "accent.py": 'größe = "ñandú"; rest = None\n',
    "menu.ts": '''
export let soup = "leek", price = 4.5;
const { main: dish, sides: [first, ...others], drink = pick({ a: 1, b: 2 }) } = order(7);
var [ , spoon = "big", [fork]] = drawer;
const total: Array<number> = sum(1, 2);
const same = price >= 4 ? "yes" : "no";
export default async function serve(table) {
  guest.name = "Ida";
  let seat
  const pour = (jug) => {
    level = 3;
  };
}
/* const hidden = 1; */
// let hiddenToo = 2;
if (soup === "leek") {}
''',
    "Card.jsx": '''
const Card = function () {
  let shade = "dark";
  return (
    <section
      title="none"
      id = "card-1"
    >
  );
}
let below = true;
''',
    "disk.ps1": "$Drive = 'D:'\n$env:CACHE = 'on'\n#$off = 1\nSet-Variable Depth 4\n$script:Left = $Drive # why\n",
    "note.ps1": "$head = 'x'\n$body = @\"\n$inner = 5\n\"@\n$foot = 'y'\n",
    "boot.sh": "readonly MODE=fast\nexport LANGS='de en' # two\nport=8080\n#port=1\ntest $port = 9 && true\nlocal empty=\n",
    "page.sh": "TITLE=news\ncat <<-'STOP' > out\nBODY=text\nSTOP\nEND=1\n",
    ".env.local": "export REGION=eu-2\n# OLD=1\nquota = 12\nBLANK=\n",
    "Tank.cs": "class Tank\n{\n  protected static double level = 0.5;\n  public bool Fill(int by)\n  {\n"
               "    var before = level;\n    if (by == 2) { return false; }\n  }\n  private string tag = \"t\";\n}\n",
    "pump.go": "var speed float64 = 1.5\nfunc (p *Pump) Start(n int) error {\n\tif err := p.check(); err != nil {\n"
               "\t\tcode, _ := 5, 6\n\t}\n}\nvar idle = true\n",
    "valve.rs": "static OPEN: bool = true;\npub(crate) async fn turn(by: u8) -> u8 {\n    let angle = by * 2;\n"
                "    let mut left: Vec<u8> = vec![];\n}\npub const STEPS: usize = 12;\n",
    "Meter.java": "class Meter {\n  static final long MAX = 99L;\n  protected int read(int at) {\n"
                  "    final List<Integer> seen = new ArrayList<>();\n    seen.add(at);\n  }\n  private String unit = \"l\";\n}\n",
    "notes.txt": "level = 1\n",
}


@pytest.fixture(scope="module")
def rows(spark):
    corpus = spark.createDataFrame([("p", k, v) for k, v in FILES.items()], "project string, path string, content string")
    out = {}
    for r in extract_assignments(corpus).orderBy("file", "ord").collect():
        out.setdefault(r.file, []).append(r)
    return out


def names(rows, file, **want):
    return [r.name for r in rows.get(file, []) if all(r[k] == v for k, v in want.items())]


def test_python(rows):
    assert [(r.name, r.scope, r.kind) for r in rows["orbit.py"]] == [
        ("PLANET", "", "assign"), ("moons", "", "annassign"), ("mass", "", "augassign"),
        ("x", "", "assign"), ("y", "", "assign"), ("zs", "", "assign"), ("degrees", "tilt", "assign"),
        ("width", "tilt.Ring", "assign"), ("self.band.color", "tilt.Ring.grow", "attr"),
        ("step", "tilt.Ring.grow", "walrus"), ("degrees", "tilt.Ring.grow", "assign")]
    by = {r.name: r for r in rows["orbit.py"]}
    assert by["moons"].anno == "list[str]" and by["width"].value == "10\n                 + 2"
    assert by["zs"].value == "origin" and by["PLANET"].line == 2
    assert "half.py" not in rows
    assert {r.name: r.value for r in rows["accent.py"]} == {"größe": '"ñandú"', "rest": "None"}


def test_typescript(rows):
    assert [(r.name, r.kind) for r in rows["menu.ts"]] == [
        ("soup", "let"), ("price", "let"), *[(n, "const-destructure") for n in ("dish", "first", "others", "drink")],
        *[(n, "var-destructure") for n in ("spoon", "fork")], ("total", "const"), ("same", "const"),
        ("guest.name", "reassign"), ("pour", "const"), ("level", "reassign")]
    by = {r.name: r for r in rows["menu.ts"]}
    assert by["price"].value == "4.5" and by["total"].value == "sum(1, 2)" and by["first"].value == "order(7)"
    assert [by[n].scope for n in ("soup", "guest.name", "pour", "level")] == ["", "serve", "serve", "pour"]


def test_jsx_attributes_are_no_assignments(rows):
    assert [(r.name, r.scope) for r in rows["Card.jsx"]] == [("Card", ""), ("shade", "Card"), ("below", "")]


def test_shells(rows):
    assert [(r.name, r.kind) for r in rows["disk.ps1"]] == [
        ("Drive", "ps-assign"), ("CACHE", "ps-env"), ("Depth", "ps-setvariable"), ("Left", "ps-script")]
    assert names(rows, "note.ps1") == ["head", "body", "foot"]
    assert [(r.name, r.kind, r.value) for r in rows["boot.sh"]] == [
        ("MODE", "sh-readonly", "fast"), ("LANGS", "sh-export", "'de en'"), ("port", "sh-assign", "8080"),
        ("empty", "sh-local", None)]
    assert names(rows, "page.sh") == ["TITLE", "END"]
    assert {r.name: r.value for r in rows[".env.local"]} == {"REGION": "eu-2", "quota": "12", "BLANK": None}


def test_brace_languages(rows):
    assert [(r.name, r.scope) for r in rows["Tank.cs"]] == [("level", ""), ("before", "Fill"), ("tag", "")]
    assert [(r.name, r.scope) for r in rows["pump.go"]] == [("speed", ""), ("code", "Start"), ("idle", "")]
    assert [(r.name, r.scope, r.kind) for r in rows["valve.rs"]] == [
        ("OPEN", "", "rust-static"), ("angle", "turn", "rust-let"), ("left", "turn", "rust-let"), ("STEPS", "", "rust-const")]
    assert [(r.name, r.scope) for r in rows["Meter.java"]] == [("MAX", ""), ("seen", "read"), ("unit", "")]
    assert "notes.txt" not in rows


def test_last_occurrence_and_scope_lines(spark):
    corpus = spark.createDataFrame([("p", "a.sh", "A=1\nB=2\nA=3\n")], "project string, path string, content string")
    got = {r.name: r.value for r in last_occurrence(extract_assignments(corpus)).collect()}
    assert got == {"A": "3", "B": "2"}
    nested = spark.createDataFrame([("p", "x", "fn a() {\n fn b()\n {\n  x\n }\n y\n}\nz")],
                                   "project string, path string, content string")
    got = [r.scope for r in brace_scope(nested, r"^\s*fn (\w+)").orderBy("line").collect()]
    assert got == ["", "a", "a", "b", "b", "a", "a", ""]


def test_long_line_does_not_overflow(spark):
    line = "const a = [" + ", ".join(f'"x{i}"' for i in range(40000)) + "];"
    corpus = spark.createDataFrame([("p", "a.js", line)], "project string, path string, content string")
    assert [r.name for r in extract_assignments(corpus).collect()] == ["a"]


def test_lines_that_no_helper_needs_are_empty_lists(spark):
    """A null list would cost a batch of such files the square of its rows."""
    df = spark.createDataFrame([("env", ["A=1"]), ("go", ["x := 1"]), (None, ["y"]), ("go", None)], "lang string, raw array<string>")
    got = df.select(E._listed(F.col("lang") == "go", "string", F.col("raw"))).collect()
    assert [r[0] for r in got] == [[], ["x := 1"], [], []]
