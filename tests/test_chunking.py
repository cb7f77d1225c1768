import time
from pathlib import Path

from codelantern.operators.chunking import chunk_files, markdown_sections, symbol_chunks

TS = """
export class SessionKeeper {
  private secret: string;

  constructor(secret: string) {
    this.secret = secret;
  }

  public async open(user: string, pass: string): Promise<{ ok: boolean }> {
    if (!user || !pass) return { ok: false };
    return { ok: this.check(pass) };
  }

  check = (pass: string): boolean => pass.length > 8;
}

export function onReady(req: any) {
  console.log(`ready ${req ? `}` : "{"}`);
}

export const renew = async (token: string) => {
  return /[}{"]/.test(token);
};
interface Shape { area(): number; }
abstract class Base<T> { abstract size(): number; run<U>(x: U): U { return x } }
const table = { first() { return 1 }, second: function () { function inner() {} } };
"""


def symbols(spark, path, text):
    rows = symbol_chunks(files(spark, [(path, text)])).orderBy("ord").collect()
    return [(r.symbol_name, r.symbol_type, r.start_line, r.end_line) for r in rows], [r.content for r in rows]


def test_script_symbols(spark):
    assert symbols(spark, "a.ts", TS)[0] == [
        ("constructor", "method", 5, 7), ("open", "method", 9, 12), ("SessionKeeper", "class", 2, 15),
        ("onReady", "function", 17, 19), ("renew", "function", 21, 23), ("run", "method", 25, 25),
        ("first", "method", 26, 26), ("inner", "function", 26, 26),
    ]


def test_scripts_with_odd_parts(spark):
    def of(text, path="a.ts"):
        return symbols(spark, path, text)

    comma = (
        "function f(): Record<string, number> {\n  return {};\n}\nconst g = (): Map<string, { a: number }> => {\n  return x;\n};\n"
        "class A {\n  m(): Record<string, number> { return {} }\n}\n"
    )
    assert of(comma)[0] == [("f", "function", 1, 3), ("g", "function", 4, 6), ("m", "method", 8, 8), ("A", "class", 7, 9)]
    assert of("if (a) /[}{]/.test(a);\nfunction f() {}\n")[0] == [("f", "function", 2, 2)]
    jsx = "function V() {\n  return (<p><b>x</b> don't (<i>y</i></p>);\n}\nfunction W() {}\n"
    assert ("W", "function", 4, 4) in of(jsx, "a.tsx")[0]
    assert of("}}} ) ( x;\nfunction late() { return 1 }\nfunction open( {\n")[0] == [("late", "function", 2, 2)]
    values = (
        "const add = (a, b) => a + b;\nlet f = async x =>\n  x\n    .then(y => y)\nvar h = function () { return '}' };\n"
        "const n = 5;\nexport default class extends B {}\n"
    )
    found, content = of(values)
    assert found == [("add", "function", 1, 1), ("f", "function", 2, 4), ("h", "function", 5, 5), ("AnonymousClass", "class", 7, 7)]
    assert content == ["const add = (a, b) => a + b;", "let f = async x =>\n  x\n    .then(y => y)",
                       "var h = function () { return '}' };", "class extends B {}"]
    members = (
        "/* function no() {} */\nconst o = { get a() { return `${b({c: `}`})}` }, async *b() {} };\n"
        "foo(function named() {}); if (x) { y() } else { z() }\nswitch (a) { case 1: {} }\n"
    )
    found, content = of(members)
    assert [s[:2] for s in found] == [("a", "method"), ("b", "method")]
    assert content == ["get a() { return `${b({c: `}`})}` }", "async *b() {}"]
    assert of("é😀 = 1; function ok(ü) { return '😀' }")[1] == ["function ok(ü) { return '😀' }"]


def test_symbols_take_linear_time(spark):
    start = time.time()
    assert symbols(spark, "a.ts", "class A<" * 8000)[0] == []
    assert symbols(spark, "b.ts", "/* a\n" * 8000)[0] == []
    many = "".join(f"function f{i}(a, b) {{ return `x${{a}}` + \"{{\"; }}\n" for i in range(8000))
    assert len(symbols(spark, "c.ts", many)[0]) == 8000
    defs = "".join(f"def f{i}():\n    '''a'''\n    return 1\n" for i in range(8000))
    assert len(symbols(spark, "d.py", defs)[0]) == 8000
    assert symbols(spark, "e.ts", "const t = `" + "${a}\\n" * 40000)[0] == []
    assert time.time() - start < 60


def test_python_symbols(spark):
    source = "\nclass A:\n    x = 1\n    @deco\n    def m(self):\n        def inner(): pass\n\nif x:\n    async def f(): return 'é'\nclass B: pass\n"
    found, content = symbols(spark, "a.py", source)
    assert found == [("m", "method", 5, 6), ("A", "class", 2, 6), ("f", "function", 9, 9), ("B", "class", 10, 10)]
    assert content[2] == "async def f(): return 'é'"
    tricky = (
        'def a(x=")",\n      y=[1,\n]):\n    """def no():\n\ndef nor(): pass\n"""\n    return 1  # end\n# def out(): pass\n\n'
        "class C(Base):\n\tdef m(self): return '#'\n\n\tif x:\n\t\tasync def n(self):\n\t\t\treturn 1 + \\\ndef_like\n\n"
        "\tclass D:\n\t\tdef o(self):\n\t\t\tdef p(): pass\n\n\nx = 1\n"
    )
    found, content = symbols(spark, "b.py", tricky)
    assert found == [("a", "function", 1, 8), ("m", "method", 12, 12), ("n", "method", 15, 17), ("o", "method", 20, 21),
                     ("D", "class", 19, 21), ("C", "class", 11, 21)]
    assert content[0].endswith("return 1") and content[1] == "def m(self): return '#'"


def test_broken_sources_have_no_symbols(spark):
    assert symbols(spark, "a.py", "def f(:\n")[0] == []
    assert symbols(spark, "a.js", "function f( {")[0] == []
    assert symbols(spark, "a.go", "func main() {}")[0] == []


def files(spark, rows):
    return spark.createDataFrame([("o/r", p, c) for p, c in rows], "repo_id string, path string, content string")


def test_markdown_sections(spark):
    text = "intro\n\n# One\na\n## Two\n"
    rows = markdown_sections(files(spark, [("a.md", text), ("b.md", "# X\r\n```\n# in fence\n```"), ("c.md", " \n")])).orderBy("ord").collect()
    assert [(r.file_path, r.symbol_name, r.start_line, r.end_line, r.content) for r in rows] == [
        ("a.md", "Documentation", 1, 2, "intro"), ("a.md", "One", 3, 4, "# One\na"), ("a.md", "Two", 5, 6, "## Two"),
        ("b.md", "X", 1, 2, "# X\n```"), ("b.md", "in fence", 3, 4, "# in fence\n```"),
    ]
    assert rows[0].id == "o/r:a.md:1"


def test_routes_and_ids(spark):
    rows = chunk_files(files(spark, [
        ("a.py", "def f(): pass\n"), ("b.py", "x = 1\n"), ("c.go", "func main() {}\n"), ("notes", " hi \n"),
        ("README", "# T\nbody"), ("e.js", "class A { m() {} }"), ("f.py", "def broken(:\n"), ("g.txt", "\n\t "),
    ])).orderBy("ord").collect()
    assert [(r.file_path, r.language, r.symbol_type, r.symbol_name, r.content) for r in rows] == [
        ("README", "markdown", "doc", "T", "# T\nbody"), ("a.py", "python", "function", "f", "def f(): pass"),
        ("b.py", "python", "module", "b.py", "x = 1"), ("c.go", "go", "module", "c.go", "func main() {}"),
        ("e.js", "javascript", "method", "m", "m() {}"), ("e.js", "javascript", "class", "A", "class A { m() {} }"),
        ("f.py", "python", "module", "f.py", "def broken(:"), ("notes", "text", "module", "notes", "hi"),
    ]
    assert [r.id for r in rows if r.file_path == "e.js"] == ["o/r:e.js:1", "o/r:e.js:1#2"]
    assert len({r.id for r in rows}) == len(rows)


def test_own_sources_chunk(spark):
    root = Path(__file__).resolve().parents[1] / "codelantern"
    rows = [(str(p.relative_to(root)), p.read_text()) for p in root.rglob("*.py") if p.read_text().strip()]
    got = chunk_files(files(spark, rows)).collect()
    for r in got:
        if r.symbol_type != "module":
            text = dict(rows)[r.file_path].split("\n")
            assert text[r.start_line - 1].lstrip().startswith(r.content.split("\n")[0])
            assert r.end_line - r.start_line == r.content.count("\n")


def test_declarators_and_names(spark):
    text = (
        "const a = 1, h = () => {\n  return 1\n};\nconst {x} = z, f = function () {\n}\nfunction deep(a = f(g(h(i(j(1)))))) {}\n"
        "const c = function* () {};\nexport const k: (x: number) => void = (x) => {}\nlet w = a ? function () {} : b\n"
    )
    assert symbols(spark, "a.ts", text)[0] == [("h", "function", 1, 3), ("f", "function", 4, 5), ("deep", "function", 6, 6), ("k", "function", 8, 8)]
    names = "class A { ['k']() {} \"q\"() {} 12() {} static async *[Symbol.iterator]<T>(a: T): X<T> { } #p() {} }\n"
    found, content = symbols(spark, "a.ts", names)
    assert [s[0] for s in found] == ["['k']", '"q"', "12", "[Symbol.iterator]", "#p", "A"]
    assert content[3] == "static async *[Symbol.iterator]<T>(a: T): X<T> { }"
    types = (
        "function over(a): void;\nfunction over(a, b) { }\nexport async function go<T extends {a: 1}>(x: T): Promise<{ ok: boolean }> { }\n"
        "class G<T extends {a: 1}> extends mix(B, {c: 1}) implements I<{d: 1}> { m<K>(x) { } }\n"
        "new Foo(function () { class In { m() {} } })\nfoo()\nfor (const q of r) { function inside() {} }\n"
    )
    assert [s[:2] for s in symbols(spark, "a.ts", types)[0]] == [
        ("over", "function"), ("go", "function"), ("m", "method"), ("G", "class"), ("m", "method"), ("In", "class"), ("inside", "function")]


def test_damage_costs_only_its_own_symbols(spark):
    script = "function bad() {\n  if (x) {\n    y()\n}\nfunction good() { return 1 }\nexport const z = () => {\n  f();\n};\n"
    assert symbols(spark, "a.js", script)[0] == [("good", "function", 5, 5), ("z", "function", 6, 8)]
    python = "def broken():\n x = [1,\n\n@deco(\n 1)\ndef c(): pass\nclass K:\n  y = (\n  def m(self): pass\ndef head(a, (\ndef last(): pass\n"
    found, content = symbols(spark, "a.py", python)
    assert found == [("broken", "function", 1, 2), ("c", "function", 6, 6), ("m", "method", 9, 9), ("K", "class", 7, 9), ("last", "function", 11, 11)]
    assert content[0] == "def broken():\n x = [1,"


def test_symbols_are_cut_in_linear_time():
    from codelantern.operators.symbols import python_found, script_found

    def seconds(find, block, n):
        text = "".join(block.format(i=i) for i in range(n))
        start = time.perf_counter()
        assert len(find(text)) >= n
        return time.perf_counter() - start

    cases = [(script_found, "class C{i} {{\n  m{i}(a) {{ return 1; }}\n}}\n"), (python_found, "class C{i}:\n    def m(self): return 1\n")]
    for find, block in cases:
        seconds(find, block, 1000)
        small, large = min(seconds(find, block, 10_000) for _ in range(3)), min(seconds(find, block, 20_000) for _ in range(3))
        assert large < 2.4 * small
    big = "const g{i} = (x) => {{\n  return \"{i} {{\";\n}};\n"
    assert seconds(script_found, big, 45_000) < 10   # two MiB
