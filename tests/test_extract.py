"""Extraction: templates, chains, signatures, and files of any nesting in linear time."""

import time

import pytest

from sinkweave.operators import extract


def read(language, text):
    symbols, calls, imports = extract.extract(language, text)
    return [(s["name"], s["kind"], s["container"], s["start_line"], s["end_line"], s["signature"]) for s in symbols], [(c["callee"], c["line"], c["from_symbol"], c["text"]) for c in calls], imports


def test_javascript():
    symbols, calls, imports = read("javascript", """import a from "b"; // import c from "d"
const pour = async ({ cup }) => {
  const kettle = boil(1); fill(cup,
    2);
  return tag`hot ${steam(`very ${hot({ a: 1 })}`)}`;
};
Tea.prototype.stir = function (spoon) { return /[(]stir(1)/.test(spoon) };
class Pot { lid = () => shut(1); async *drip(n = f(1)) { yield* this.next(n) } }
const it = { open() { return new Pot }, ['x']: 1 };
app.get('/', (req) => { req.send(1) })
  .listen(80);
if (it) (function () { inner() })();
""")
    assert symbols == [
        ("pour", "function", None, 1, 5, None), ("stir", "function", None, 6, 6, None), ("Pot", "class", None, 7, 7, None),
        ("drip", "method", "Pot", 7, 7, "(n = f(1))"), ("open", "method", None, 8, 8, "()"),
    ]
    assert calls == [
        ("boil", 2, "pour@1", "boil(1)"), ("fill", 2, "pour@1", "fill(cup, 2)"), ("tag", 4, "pour@1", "tag`hot ${steam(`very ${hot({ a: 1 })}`)}`"),
        ("steam", 4, "pour@1", "steam(`very ${hot({ a: 1 })}`)"), ("hot", 4, "pour@1", "hot({ a: 1 })"), ("test", 6, "stir@6", "/[(]stir(1)/.test(spoon)"),
        ("shut", 7, "Pot@7", "shut(1)"), ("f", 7, "Pot@7", "f(1)"), ("next", 7, "Pot@7", "this.next(n)"), ("Pot", 8, "open@8", "new Pot"),
        ("listen", 9, None, "app.get('/', (req) => { req.send(1) }) .listen(80)"), ("get", 9, None, "app.get('/', (req) => { req.send(1) })"), ("send", 9, None, "req.send(1)"),
        ("inner", 11, None, "(function () { inner() })()"), ("inner", 11, None, "inner()"),
    ]
    assert imports == ["b"]


def test_python():
    symbols, calls, _ = read("python", '''class Pan(Base):
    @heat(1)
    async def fry(self, egg=crack(1),
                  *more):
        return f"{egg.salt(1):>{wide(2)}} {{no(1)}} {more['a']!r}"

    def \\
        cool(self): pass
def eat(): return (Pan().fry)(1)(2)
''')
    assert symbols == [("Pan", "class", None, 0, 7, None), ("fry", "method", "Pan", 2, 4, "(self, egg=crack(1), *more)"), ("cool", "method", "Pan", 6, 7, "(self)"), ("eat", "function", None, 8, 8, "()")]
    assert [(c, t) for c, _, _, t in calls] == [
        ("heat", "heat(1)"), ("crack", "crack(1)"), ("salt", "egg.salt(1)"), ("wide", "wide(2)"), ("fry", "(Pan().fry)(1)(2)"), ("fry", "(Pan().fry)(1)"), ("Pan", "Pan()")]


@pytest.mark.parametrize("language,text,symbols,calls", [
    ("typescript", "abstract class A { abstract f(): void; g(): { a: B } { return h<C>(this.i()) } }\nexport class D<T> extends A { constructor(private x: Map<string, T>) { super(x) } }\nlet j: (x: E) => void = (x) => k(x)",
     ["g", "D", "constructor", "j"], ["h", "i", "k"]),
    ("java", "class A<T> {\n  @B(c = 1)\n  public <U> Map<U, List<T>> d(int[] e) throws F { return new G<T>(h()) { void i() { j(); } }.k(); }\n  enum L { M(1); L(int n) { o(n); } }\n}", ["A", "d", "i", "L"], ["k", "G", "h", "j", "o"]),
    ("go", "func (a *A) B(c string) (int, error) { d.E(c).F(); return []byte(c), nil }\nfunc G[T any](h func(T) int) map[string]interface{} { return func(i int) int { return j(i) }(1) }\ntype K interface { L(m int) error }", ["B", "G"], ["F", "E", "i", "j"]),
    ("php", "a() <?php abstract class B { abstract function c($d); static function e($f) { return $this->g(\"{$f->h(1)}\"); } } $i = function ($j) use ($k) { l(); }; new M; ?> n() <?= o() ?>", ["B", "c", "e"], ["g", "h", "l", "M", "o"]),
    ("c", "#define A(x) b(x)\nint c(int d);\nstatic int *e(char *f)\n{ if (f) return g(f); for (;;) h(); }\nint i = j(1);", ["e"], ["g", "h", "j"]),
    ("cpp", "template <class T> struct A : B<T> {\n A(int c) : B<T>(c), d{1} { e(); }\n ~A() { f(); }\n int g(int) const;\n};\nint A::g(int h) const { I j(1); return std::max(k<int>(1), 2); }", ["A", "A", "A::g"], ["e", "f", "max", "k"]),
    ("csharp", "class A : B { [C(1)]\n public T D<T>(int e) where T : new() { return F($\"{G(1):N2} {{no(1)}}\"); }\n public A() : base(H(1)) { int I(int j) => K(j); } }", ["A", "D", "A", "I"], ["F", "G", "H", "K"]),
])
def test_shapes(language, text, symbols, calls):
    found, called, _ = read(language, text)
    assert [s[0] for s in found] == symbols
    assert [c[0] for c in called] == calls


N = 25_000
WORST = {
    "nested": "".join(f"function f{k}(x) {{ g(x); " for k in range(N)), "c": "".join(f"int f{k}(int x) {{ g(x); " for k in range(N)), "arrows": "".join(f"a{k} = x => " for k in range(N)), "angles": "a<" * N + "(", "classes": "class A " * N,
    "holes": "`${" * N, "types": "f(a): x " * N, "parens": "(" * N, "defs": "".join(f"def f{k}():\n{' ' * (k % 50)}x(1)\n" for k in range(N)), "posts": "f" + "(x)" * N, "funcs": "func a(x) y " * N, "consts": "const a: x " * N, "values": "a = function " * N, "new": "new A(b) { c(d) " * N,
}


@pytest.mark.parametrize("shape", sorted(WORST))
def test_any_nesting_is_linear(shape):
    """25,000 nested or unclosed definitions."""
    for language in ("typescript", "python", "cpp"):
        began = time.time()
        extract.extract(language, WORST[shape])
        assert time.time() - began < 10, language
