"""What is code and what is not, heads of scopes, and scopes of files that are cut into blocks."""

import random

import pytest

from codeloom.functions import lexing
from codeloom.operators import scopes

HEADS = [
    ("java", "  public static <T> List<T> find(String a, Map<String, Integer> m) throws IOException ", ("function", "find")),
    ("java", "\n @Override\n @Get(\"x\")\n  public int size() ", ("function", "size")),
    ("java", "public record Point(int x) ", ("record", "Point")),
    ("java", " Shop(int a) ", ("function", "Shop")),
    ("java", " else if (f(x)) ", None),
    ("java", " synchronized (this) ", None),
    ("java", " run(() -> ", None),
    ("java", " int[] x = ", None),
    ("java", " x = new Shop() ", None),
    ("c", "static struct item *find(int x) ", ("function", "find")),
    ("c", "struct item ", ("struct", "item")),
    ("c", "typedef struct ", None),
    ("c", " each(p, h) ", None),
    ("c", " i++) ", None),
    ("cpp", "Shop::Shop(int a) : x(a), y(2) ", ("function", "Shop::Shop")),
    ("cpp", "template <class T> class Box ", ("class", "Box")),
    ("cpp", "public:\n  virtual void f() const override ", ("function", "f")),
    ("cpp", "namespace shop ", ("namespace", "shop")),
    ("typescript", " private async load<T>(id: string): Promise<T> ", ("function", "load")),
    ("typescript", "export const f = async (a: number): Promise<void> => ", ("function", "f")),
    ("typescript", "items.then(x => ", None),
    ("javascript", "a: 1, price(b) ", ("function", "price")),
    ("javascript", "module.exports = function(a) ", ("function", "exports")),
    ("javascript", "function* all(a) ", ("function", "all")),
    ("javascript", "on(e, function(x) ", None),
    ("php", "  public function price(array $a): ?int ", ("function", "price")),
    ("php", " foreach ($a as $b) ", None),
    ("go", "func (s *S) Run(a int) (int, error) ", ("func", "Run")),
    ("go", "type S struct ", ("struct", "S")),
    ("go", " go func() ", None),
]


@pytest.mark.parametrize(("language", "head", "wanted"), HEADS)
def test_heads(language, head, wanted):
    found = lexing.head_of(head, language)
    assert (found and found[:2]) == wanted
    if found:
        assert head[found[2] :].startswith(found[1].split("::")[0])


def test_masked():
    code, state, _ = lexing.masked('a "x{" // {\n/* {\n*/ b', lexing.CODE, "java")
    assert code == 'a """"     \n    \n   b' and state == lexing.CODE
    code, state, inside = lexing.masked("x = '''{\n{", lexing.CODE, "python")
    assert (code, state, inside) == ("x = ''''\n'".replace("'", '"'), lexing.TRIPLE_SINGLE, [(4, 10)])
    assert lexing.masked("{\n*/ }", lexing.COMMENT, "c")[:2] == (" \n   }", lexing.CODE)


LINES = {
    "java": ["class A {", "{", "}", "  void f(int a)", "{", "} // }", "/*", "*/ int x;", "@Override", "  public int g() { return 1; }", '  String s = "{";', '"""', "if (x) {", "for (;;) {", "int y = 1;", "", " @Get(", '  "x")', "A(int q", "  , int r) {", "}}"],
    "php": ["<?php", "function f($a) {", "}", "$x = 'a", "b';", "# {", "class B {", "public function m(): int {", "if ($a) {", "}}", '"{";'],
    "typescript": ["export class C {", "async m(a: number): Promise<void> {", "}", "const f = (a) => {", "`", "x} {", "};", "// {", "foo(() => {", "});", "x: 1, g() {", "},"],
    "c": ["int main(int argc)", "{", "}", "#define X { \\", "  }", "struct s {", "};", "static int", "f(void) {", "/* { */", "'{'", ""],
    "go": ["func (s *S) R(a int) error {", "}", "type T struct {", "`{", "`", "if x {", "} else {", "// }", ""],
    "python": ["class A:", "    def f(self):", "        x = (", "1,", ")", "@dec", "    @dec", "    def g(", "self):", "  pass", '"""', '    """doc"""', "# c", "x = 1", "", "def top(): pass", "'''a"],
    "ruby": ["class A", "  def f", "  end", "end", "x = [", "1", "]", "# def", "  y"],
    "": ["class A:", "    def f(self):", '"""', "x", "", "@d", "    @e", "def g():", "}", "  end", "\tdef t():"],
}


def test_blocks_of_any_size_give_the_same_scopes(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        language = rng.choice(list(LINES))
        rows.append((f"f{i}", "\n".join(rng.choice(LINES[language]) for _ in range(rng.randrange(40))), language))
    files = spark.createDataFrame([*rows, ("none", None, "java"), ("nul", "a", None)], "path string, text string, language string")

    def told(block):
        found = scopes.line_scopes(files, language_col="language", block=block)
        return sorted(map(tuple, found.select(sorted(found.columns)).collect()), key=repr)

    whole = told(10_000)
    assert len(whole) == sum(r[1].count("\n") + 1 for r in rows) + 1
    for block in (1, 4, 13):
        assert told(block) == whole


def test_a_giant_file_is_many_tasks(spark):
    """One file with most of all lines: its blocks are dealt out, and its chunks hold every line once."""
    body = "\n".join(f"  int f{i}(int a) {{\n    return a;\n  }}" for i in range(3000))
    text = f"class A {{\n{body}\n}}"
    files = spark.createDataFrame([("big.java", text, "java"), ("s.java", "class B {\n}", "java")], "path string, text string, language string")
    found = scopes.code_scopes(files, language_col="language", block=200)
    spread = scopes.line_scopes(files, language_col="language", block=200)
    rows = {r["name"]: r for r in found.collect()}
    assert len(rows) == 3002
    assert (rows["A"]["end_ln"], rows["f2999"]["scope"], rows["f2999"]["end_ln"], rows["f2999"]["parent"]) == (9002, 8998, 9001, 0)
    per_task = [r["n"] for r in spread.where("path = 'big.java'").groupBy("owner", "path").count().withColumnRenamed("count", "n").collect()]
    assert sum(per_task) == 9002
    chunks = scopes.scope_chunks(files, 5000, 50, language_col="language", block=200).where("path = 'big.java' AND scope = 0").collect()
    assert sorted(c["part"] for c in chunks) == list(range(len(chunks)))


def test_lines_in_brackets_end_nothing(spark):
    text = "class A:\n    def f(self):\n        return g(\n1,\n)\n    x = [\n1]\ndef h():\n    pass"
    files = spark.createDataFrame([("a.py", text, "python")], "path string, text string, language string")
    rows = {r["name"]: r for r in scopes.code_scopes(files, language_col="language").collect()}
    assert (rows["f"]["end_ln"], rows["A"]["end_ln"], rows["h"]["scope"]) == (5, 7, 7)


def test_a_block_moves_from_each_state_as_if_read_in_it():
    rng = random.Random(11)
    for _ in range(3000):
        language = rng.choice(list(LINES))
        text = "\n".join(rng.choice(LINES[language]) for _ in range(rng.randrange(8)))
        told, states = lexing.moves(text, language), [lexing.CODE]
        for state in states:  # those that a block can be entered in
            code, after, _ = lexing.masked(text, state, language)
            assert told[state] == (after, lexing.depth_change(code, language), *lexing.unfinished(code, language))
            states += [after] * (after not in states)


def test_a_block_is_read_once_for_all_states(monkeypatch):
    """Unless a comment or string of one reading ends within one of another."""
    read, starts = [], lexing._STARTS["java"]

    class Counted:
        def search(self, text, at):
            read.append(at)
            return starts.search(text, at)

    monkeypatch.setitem(lexing._STARTS, "java", Counted())
    lexing.moves("int x; /* a */ f('}');\n" * 100, "java")
    assert len(read) <= 201


def test_scopes_are_the_headers_of_lines(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        language = rng.choice(list(LINES))
        rows.append((f"f{i}", "\n".join(rng.choice(LINES[language]) for _ in range(rng.randrange(40))), language))
    files = spark.createDataFrame([*rows, (None, "class A {\n}", "java")], "path string, text string, language string")
    for block in (1, 6, 100):
        heads = scopes.line_scopes(files, language_col="language", block=block).where("is_header").withColumnRenamed("ln", "scope")
        found = scopes.code_scopes(files, language_col="language", block=block)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, heads.select(*found.columns).collect()), key=repr)
