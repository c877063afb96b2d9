import ast
import json
import random
import warnings

import numpy as np
import pytest

from strata.llm import broken, syntax
from strata.llm.lalr import Tables

GOOD = {
    "python": [
        "", "# only a comment", "x = 1", "def f(a, /, b: int = 2, *c, d, **e) -> list[int]:\n    return [i for i in c if i]\n", "class A(B, metaclass=M):\n    x: int = 3\n    async def f(self):\n        async with a as b, c:\n            await d\n",
        "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "match x:\n    case [1, *rest] if rest:\n        pass\n    case {'a': 1, **k} | A(b=2):\n        pass\n    case _:\n        pass\nmatch = 3\n",
        "a = f'{x!r:>{w}} {y}'\nb = '''\n<<<<<<< ours\n'''\n", "with (open(a) as b, open(c) as d):\n    pass\n", "x = lambda a, *b, c=1: (yield)\nprint(*a, **b, sep='')\nd[1:2, ::3, ...]\n", "if x:\n\ty = 1\nelse: z = 2; w = 3", "@a.b(c)\ndef f(): ...\n", "a = b if c else d\nassert (x := 3) > 2, 'm'\nglobal q\ndel a, b\n", "def f[T: int](x: T) -> T: return x\ntype X = int\n", "for x, *y in z: continue\nwhile not a or b: break\n", "\n\n  # c\nx = (1,\n2)\n",
    ],
    "json": ["{}", "[]", '{"a": [1, -2.5e+3, true, false, null, "\\u00e9\\n"]}', " 3 ", '"x"'],
    "javascript": [
        "", "import a, {b as c} from './x.js';\nexport default class extends A { #p = 1; static s; get x() { return this.#p } async *g() { yield* h() } }", "const f = async (a, {b, ...c} = {}, [d,,e] = []) => { await a }, g = x => ({x})\nlet y = a ? b : c ?? d?.e?.[f]?.(g)", "for (const [k, v] of Object.entries(o)) { if (k) continue; else break }",
        "x = /[{(]a\\/b/gi.test(`a ${b + `c ${d}`} e { it's`)", "a = b\n++c\nreturn_ = 1\nfunction f() { return\n1 }", "label: for (;;) { switch (x) { case 1: break label; default: } }", "export * as ns from 'm'; export { a, b as c }; export const q = 1", "try { throw new Error('}') } catch { } finally { }", "var a = {get: 1, set, async b() {}, [c]: 2, 'd': 3, ...e}\nif (a) b; else { c }\ndo x++; while (x < 5)\n", "const s = `\n<<<<<<< ours\n=======\n>>>>>>> theirs\n`;",
    ],
    "typescript": [
        "export function f<T extends object = {}>(a: T, b?: number, ...c: string[]): Promise<Map<string, T[]>> { return a as any }", "interface A<T> extends B { readonly x: number; y?(a: string): void; [k: string]: any; new (a: number): A<T> }\ntype U = { [K in keyof T]?: T[K] } | 'a' | (() => void) | typeof x\nenum E { A = 1, B }", "abstract class C<T> extends D<T> implements I, J { private readonly x: number = 1; constructor(public a: string) { super() } abstract f(): void; static g<T>(x: T): x is T { return !!x } }", "declare module 'x' { export const y: number }\nnamespace N { let z = <any>w; let q = w! }", "let a: [number, string?] = [1], f = (x: number): string => `${x}`", "import type { A } from './a';\nexport type { A };\nfor (let i = 0; i < 5; i++) { g<string>(i) }", "const x = y satisfies Z; function assertIt(v: unknown): asserts v is string {}",
    ],
    "go": [
        "package a", "// c\npackage a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn\n\t} else if x == 2 {\n\t}\n\tfor i := range b {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch y := z.(type) {\n\tcase int, *S:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t}\n\treturn a, nil\n}\n",
        "package a\n\ntype T struct {\n\tA int `json:\"a\"`\n\t*B\n}\n\ntype I interface {\n\tF(int) error\n\t~int | string\n}\n\nvar x = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nconst (\n\tA = iota\n\tB\n)\n", "package a\n\nfunc f() {\n\tx := T{A: 1}.B\n\ty := []T{{1}, {2}}\n\tdefer x.Close()\nloop:\n\tfor ; ; {\n\t\tbreak loop\n\t}\n\tz := a[1:2:3]\n\tvar q = '('\n\t_ = `a\n}`\n}\n", "package a\nfunc G[K comparable, V any](m map[K]V) {}\n",
    ],
    "java": [
        "", "package a.b;\nimport static c.D.*;\n@A(x = 1, y = {B.class}) public final class C<T extends D & E> extends F<T> implements G {\n  private static final int[] X = {1, 2};\n  static { int y = 1; }\n  C(int a) throws IOException { super(a); }\n  <U> List<? super U> f(final U u, String... s) { for (var x : s) { continue; } return new ArrayList<>(); }\n  int g() { return (int) '{' + (x > 1 ? y : z) >> 2; }\n}\n",
        "record P(int x, int y) { P { if (x < 0) throw new E(); } }\nsealed interface S permits A, B {}\nenum E implements I { A(1) { void f() {} }, B; int x; E(int x) {} }", "class A { void f() { Runnable r = () -> {}; var s = \"\"\"\n  a \"quoted\" }\n  \"\"\"; int k = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; if (o instanceof String t && t.length() > 1) {} try (var i = open(); j) {} catch (A | B e) {} finally {} label: while (true) { break label; } List<Map<String, int[]>> m = null; f(A::new, int[]::new); synchronized (this) {} assert a : b; do { x++; } while (x < 3); } }",
    ],
    "c": [
        "", "#include <a.h>\n#define X(a) \\\n  ((a) + 1)\n\ntypedef struct node { int x : 3; struct node *next; } node_t;\nstatic const char *names[] = { \"a\", [2] = \"b\" };\nint f(const char *s, int (*cb)(void *, size_t), ...) {\n  for (int i = 0; i < 3; i++) { if (s[i] == (int) '{') goto out; }\n  size_t n = sizeof(struct node) + sizeof *s; node_t *p = (node_t *) malloc(n);\n  switch (*s) { case 'a': default: break; }\n  do { p->x--; } while (p && p->x);\nout:\n  return n ? 1 : 2;\n}\n", "enum e { A = 1, B, };\nunsigned long long x = 0xFFULL, *y;\nextern inline void g(void);\nint (*fp)(int) = 0;\nstruct s t = { .a = 1, .b = { 2, 3 } };\n", "int main() { foo *p; a * b; (void) c; return \"a\" \"b\"[0]; }\n/*\n<<<<<<< ours\n*/\n",
    ],
    "rust": [
        "", "#![allow(x)]\nuse a::{b, c as d, self, e::*};\n\npub(crate) struct A<'a, T: B + 'a = C>(pub &'a T) where T: D;\nenum E { A, B(i32), C { x: u8 } = 3 }\nimpl<'a, T> F for A<'a, T> where T: B {\n    const X: usize = 1;\n    fn f(&self, mut v: Vec<Vec<u8>>) -> Result<(), Box<dyn E>> {\n        if v.len() > 97 { return Err(e)?; }\n        let s = S { a, b: 1, ..d };\n        match x { Some(y @ 1..=5) if y > 2 => {}, A | B => f(), _ => {} }\n        for i in 0..10 { println!(\"{}\", i); }\n        let c = |a: i32, &b| -> i32 { a };\n        'o: loop { break 'o; }\n        let z = v.iter().map(|x| x + 1).collect::<Vec<_>>();\n        x as i32 == '}' as i32\n    }\n}\nmacro_rules! m { ($a:expr) => { $a }; }\nstatic Y: &str = r#\"a \"b\" }\"#;\ntrait T: U { fn g(); type A; }\nfn h() -> impl Fn(i32) -> i32 { move |x| x }\n", "fn f() { let Some(x) = y else { return }; if let Some(a) = b && c {} while let Ok(q) = r {} unsafe { *p = 1 } a = b; a += [1; 3][0]; }", "/*\n<<<<<<< ours\n*/\nmod a { pub fn b() {} }",
    ],
}
BAD = {
    "python": ["def f(:\n    pass", "x = (1,\n", "if x:\npass", "print 'a'", "a = 'b", "<<<<<<< ours\nx = 1\n=======\nx = 2\n>>>>>>> theirs\n", "class A\n    pass", "  x = 1\n y = 2\n", "x = 1 +", "try:\n    pass\n", "<html></html>", "x = $y", 'def f():\n    """Sort it."'],
    "json": ["", "{", '{"a": 1,}', "{'a': 1}", "[1 2]", "{} // c", "NaN", "01", '"a\nb"', '{"a": 1}\n<<<<<<< x'],
    "javascript": ['{"a": 1, "b": 2}', "function f( {", "let x: number = 1", "const a = `b", "if (x) }", "class A { f( }", "def f():\n    pass", "a b", "<<<<<<< ours\nx\n=======\ny\n>>>>>>> t", "x = {a: 1", "for (;) {}", "export const a", "let {b};", "function f() { return", "class A { f() { x\n return", "{ break", "while (x) { throw"],
    "typescript": ['{"a": 1, "b": 2}', "interface A { x: }", "function f(a: number { }", "let x = ", "enum { A }", "package a\n\nfunc f() {}"],
    "go": ["", "func f() {}", "package a\nfunc f() { x := }", "package a\n\nfunc f() int {\n\treturn 1\n", "package a;\nclass A {}", "package a\nvar s = `a", "package a\n<<<<<<< x\n", "package a\n\nvar x"],
    "java": ["class A { void f() { int x = ; } }", "class A {", "def f(): pass", "class A { int f( }", "public A { }", 'class A { String s = "a; }'],
    "c": ["int f( {", "int x = ;", "struct A { int x; }", "int main() { return 1 }", "class A {};", "def f(): pass", "int a[] = { 1, 2", "int f(void) { /* x"],
    "rust": ["fn f( {}", "fn f() { let x = ; }", "struct A { x i32 }", "impl A {", "class A {}", 'fn f() { "a }', "fn f() { if x { }", "package a"],
}


@pytest.mark.parametrize("lang", GOOD)
def test_valid_texts(lang):
    got = syntax.check_many(lang, GOOD[lang])
    assert got == [-1] * len(got), [t for t, g in zip(GOOD[lang], got) if g >= 0]


@pytest.mark.parametrize("lang", BAD)
def test_broken_texts(lang):
    got = syntax.check_many(lang, BAD[lang])
    assert min(got) >= 0, [t for t, g in zip(BAD[lang], got) if g < 0]


def test_truncated_and_mutated_python_and_json():
    r = random.Random(5)
    base = {"python": "".join(t for t in GOOD["python"] if t.startswith(("def f(a", "class", "try", "for"))), "json": GOOD["json"][2] * 1}
    for lang, text in base.items():
        tries = [text[: r.randint(1, len(text))] for _ in range(60)]
        for _ in range(60):
            i = r.randint(0, len(text) - 1)
            tries.append(text[:i] + r.choice("()[]{}:,'\" \n") + text[i + 1 :])
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for t, g in zip(tries, syntax.check_many(lang, tries)):
                try:
                    compile(t, "t", "exec", flags=ast.PyCF_ONLY_AST, dont_inherit=True) if lang == "python" else json.loads(t)
                    ok = True
                except (SyntaxError, ValueError):
                    ok = False
                assert (g < 0) == ok, (lang, t)


@pytest.mark.parametrize("name", GOOD)
def test_lockstep_equals_general_parse(name):
    lang = syntax.language(name)
    r = random.Random(name)
    texts = GOOD[name] + BAD[name] + [t[: r.randint(0, len(t))] for t in GOOD[name] for _ in range(12)]
    pairs = [lang.lex(t) for t in texts]
    soft = [s for _, s in pairs] if lang.tables.asi else None
    failed, met = lang.tables.parse_many([a for a, _ in pairs], soft)
    for t, (a, s), f, m in zip(texts, pairs, failed, met):
        exact = lang.tables.parse_general(a, s)
        assert (exact < 0 if f < 0 else m or f == exact), t


def test_split_cells_are_decided_exactly():
    # neither choice after an x is right for every text: only following both decides
    t = Tables("S: A 'y' | B 'z' ; A: 'x' 'x' | 'x' A ; B: 'x' | 'x' B ;")
    enc = lambda s: np.array([*(t.term[c] for c in s), 1], np.int32)
    for s, ok in (("xxy", True), ("xxxxy", True), ("xz", True), ("xxxz", True), ("xy", False), ("xxx", False)):
        assert (t.parse_general(enc(s)) < 0) is ok


def test_operator(spark):
    docs = spark.createDataFrame([("blob_1", "code", "x = (", 1), ("blob_1", "code", "x = (", 1), ("blob_2", "code", "x = 1", 2), ("blob_3", "code", None, 3), ("blob_4", "code", "{", 4), ("diff_5", "diff", "(", 5), ("odd", "code", "(", 6), ("blob_7", "code", "(", 7), (None, "code", "(", 8), ("blob_9", "code", "y = '" + "a" * 300_000, 9)], "doc_key string, index_name string, content string, id long")
    blobs = spark.createDataFrame([(1, "python"), (1, "python"), (2, "python"), (3, "go"), (4, "json"), (7, None), (9, "python"), (10, "c")], "id long, language string")
    texts = broken.code_texts(docs, blobs)
    got = {(r.blob_id, r.language, r.error_line) for r in broken.broken_files(texts).collect()}
    assert {g[0] for g in got} == {1, 4, 9} and (1, "python", 1) in got
    assert broken.broken_files(texts.limit(0)).count() == 0
    revs = spark.createDataFrame([(1, 11), (1, 11), (2, 11), (4, 12), (1, 12)], "blob_id long, commit_id long")
    commits = spark.createDataFrame([(11, 100), (12, 200), (12, 200)], "id long, repo_id long")
    rates = {(r.repo_id, r.language): (r.n_files, r.n_bad) for r in broken.rates(broken.broken_files(texts), texts, revs, commits).collect()}
    assert rates == {(100, "python"): (2, 1), (200, "python"): (1, 1), (200, "json"): (1, 1)}


def test_error_line():
    text = "def f():\n    return 1\n\nx = = 2\n"
    at = syntax.check_many("python", [text])[0]
    assert at >= 0 and syntax.line_of("json", '{\n"a": 1,\n}', syntax.check_many("json", ['{\n"a": 1,\n}'])[0]) == 3


@pytest.mark.parametrize(
    "lang, text, line",
    [
        ("python", "x = 1\n\n# c\ndef f():\n    y = [1,\n         2]\n    z = = 3\n", 7), ("python", "\n\n  x = 1\n", 3), ("python", "if a:\n    b\n      c\n", 3), ("python", "s = \"\"\"a\nb\n\"\"\"\nx = )\n", 4), ("python", "f(1,\n", 1),
        ("go", "package a\n\nfunc f() {\n\tx := 1\n\ty := := 2\n}\n", 5), ("go", "package a\n/* a\nb */\nfunc f( {\n}\n", 4), ("javascript", "let a = 1\nlet b = `x\n${a}\n`\nlet c = = 2\n", 5), ("javascript", "let a = /x\\/y/g\n\nlet = = 2\n", 3),
        ("json", '{\n "a": 1,\n "b" 2\n}', 3), ("java", "\n\nclass A {\n  int x = ;\n}\n", 4), ("c", "\n\n#include <a.h>\n  #define B 1\nint f( { }\n", 5), ("rust", "#!/bin/x\nfn f() {\n  let = 1;\n}\n", 3), ("typescript", "type A = {\n  b: string\n  c: = 1\n}\n", 3),
    ],
)
def test_error_lines(lang, text, line):
    (at,) = syntax.check_many(lang, [text])
    assert at >= 0 and syntax.line_of(lang, text, at) == line
    assert syntax.line_of(lang, "\ufeff" + text, at) == line
