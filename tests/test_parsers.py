"""Declarations found in Python and TypeScript text."""

import pytest

from tessera.parsers import one_line, parse, parse_files, useful

PY = '''import os, sys as system
from .models import User
from ..config import settings

@router.post("/api/login")
async def login(
    name: str,  # a ( in a comment
    secret: str = "x)",
) -> dict:
    """Signs the user in.

    More.
    """
    return {"token": "made up value"}


class Service(Base):
    """Does things."""

    limit = 3

    @property
    def ready(self):
        return True

    def _hidden(self):
        def inner():
            pass
        return inner

    @app.get("/x")
    def route_inside(self): pass


# a comment drops decorators
@cached
# like this one
def plain(): return 'quoted text'
'''

TS = '''import { a } from "./a.js";
import type { B } from './b';
export * from "./c";
export { hidden, other as renamed };

/**
 * @internal
 * Signs a user in.
 */
export async function login(user: string, opts: { a: number }): Promise<{ ok: boolean }> {
  const path = `/api/login`;
  return { ok: user < "zzz" && /re\\/x{2}/.test(path) };
}
const hidden = () => 1;
export const TIMEOUT = 3000, NAME = "the name";
const unexported = 5;
const other = function named(x: number) { return x / 2 / 1; };
export const useAuth = () => "from the hook";
export const LoginForm = ({ a }: Props) => (
  <form onSubmit={() => go(`sent ${a}`)} className="wide">
    Giris   yap {a ? <b>now</b> : null}
  </form>
);
export const Lower = (x: number) => x > 1;
export abstract class Service<T extends Foo<Bar>> extends Base<T> implements X {
  private n = 1;
  handler = async (e: Event) => { await e; };
  constructor(private a: string) { super(); }
  /** The value. */
  get value(): string { return this.a; }
  static create<T>(x: T): Service<T> { return new Service(x); }
  abstract later(): void;
  "quoted"() {}
  #secret() {}
}
interface Plain { a: string; b(): void }
export type Union = "first" | "second" | ((x: number) => void);
export enum Color { Red = "red-x", Blue }
namespace Inner { export function unseen() {} }
export const { d1, d2 } = obj;
export default function () { return 1 }
'''


def by_name(parsed):
    return {s.name: s for s in parsed.symbols}


def test_python_declarations():
    p = parse("a.py", PY, "py")
    s = by_name(p)
    assert p.specifiers == ["os", "sys", ".models", "..config"]
    assert [x.name for x in p.symbols] == ["login", "Service", "ready", "_hidden", "inner", "route_inside", "plain"]
    login = s["login"]
    assert (login.kind, login.start_line, login.end_line, login.doc) == ("route", 5, 14, "Signs the user in.")
    assert login.signature == '@router.post("/api/login") async def login( name: str, secret: str = "x)", ) -> dict'
    assert "/api/login" in login.strings and "made up value" in login.strings
    assert (s["Service"].kind, s["Service"].doc, s["Service"].end_line) == ("class", "Does things.", 37)
    assert (s["ready"].kind, s["ready"].parent, s["ready"].start_line) == ("method", "Service", 22)
    assert (s["_hidden"].exported, s["_hidden"].end_line) == (False, 29)
    assert (s["inner"].kind, s["inner"].parent) == ("function", None)
    assert (s["route_inside"].kind, s["route_inside"].parent) == ("route", None)
    assert s["plain"].signature == "def plain(): return 'quoted text'" and s["plain"].start_line == 38


def test_python_ranges_and_brackets():
    s = by_name(parse("a.py", "def a(x='(['):\n    y = 1\n\n\n@dec\ndef b(\n  z):\n    return z\nX = 1\n", "py"))
    assert (s["a"].start_line, s["a"].end_line) == (1, 2)
    assert (s["b"].start_line, s["b"].end_line, s["b"].signature) == (5, 9, "@dec def b( z)")


def test_typescript_declarations():
    p = parse("src/Login.tsx", TS, "tsx")
    s = by_name(p)
    assert p.specifiers == ["./a.js", "./b", "./c"]
    assert (s["login"].kind, s["login"].doc, s["login"].start_line, s["login"].end_line) == ("function", "Signs a user in.", 10, 13)
    assert s["login"].signature == "export async function login(user: string, opts: { a: number }): Promise<{ ok: boolean }>"
    assert s["login"].strings == ["/api/login", "zzz"]
    assert s["hidden"].exported and s["other"].exported and s["hidden"].kind == "function"
    assert "unexported" not in s and "d1" not in s and "unseen" not in s and "default" not in s
    assert (s["TIMEOUT"].kind, s["NAME"].start_line, s["NAME"].strings) == ("const", 15, ["the name"])
    assert (s["useAuth"].kind, s["LoginForm"].kind, s["Lower"].kind) == ("hook", "component", "function")
    assert s["LoginForm"].strings == ["wide", "Giris yap", "now"] and s["LoginForm"].end_line == 23
    methods = [x.name for x in p.symbols if x.parent == "Service"]
    assert methods == ["handler", "value", "create", "later"]
    assert s["value"].doc == "The value." and s["value"].signature == "get value(): string" and s["value"].exported
    assert s["Service"].signature == "export abstract class Service<T extends Foo<Bar>> extends Base<T> implements X"
    assert (s["Plain"].kind, s["Plain"].exported, s["Plain"].signature) == ("interface", False, "interface Plain")
    assert s["Union"].strings == ["first", "second"] and s["Color"].kind == "enum"


def test_routes_defaults_and_statement_ends():
    s = by_name(parse("app/api/login/route.ts", "export async function POST(r: Request) { return new Response('okay') }\nexport function other() {}", "ts"))
    assert (s["POST"].kind, s["other"].kind) == ("route", "function")
    s = by_name(parse("x.ts", "const a = (x: number): number => x + 1\nconst b = async function* () {}\nlet c = a\n  .then(() => 1)\nfoo()\nexport = c\nfunction over(a: string): void;\nfunction over(a: any) {}\nexport default class Named { m() {} }", "ts"))
    assert set(s) == {"a", "b", "c", "over", "Named", "m"} and s["m"].exported and s["c"].start_line == 6
    s = by_name(parse("y.ts", "export const f = <T,>(x: T): x is string => true;\nexport type A<T> = T extends string ? 'yes' : { no: () => void }\nexport class Z { a = 1\n b = () => 2\n c?: string\n d() { return `t ${'deep text'} u` } }\nexport const end = 1", "ts"))
    assert [s[n].kind for n in ("f", "A", "Z", "b", "d", "end")] == ["function", "type", "class", "method", "method", "const"]
    assert s["d"].strings == ["deep text"] and s["end"].start_line == 7


def test_jsx_only_where_it_is_allowed():
    s = by_name(parse("a.ts", "export const Cast = (x: any) => <string>x;\nexport const after = 1", "ts"))
    assert s["Cast"].kind == "function" and "after" in s
    s = by_name(parse("a.jsx", "export const Less = (a, b) => a < b;\nexport default () => <><Less/>text here</>;", "tsx"))
    assert s["Less"].kind == "function" and s["default"].strings == ["text here"]


@pytest.mark.parametrize("text", ["", "export", "class", "class A {", "const a = `x ${", "function f(", "<div", "/* open", "'open", "export default", "import", "@", "type A =", "enum E {", "}}}", "a = {", "\\", "export const x = (", "interface"])
def test_broken_text_is_survived(text):
    for path in ("a.ts", "a.tsx"):
        parse(path, text, "ts")
    parse("a.py", text, "py")


def test_limits():
    assert len(one_line("x" * 300)) == 200 and one_line("x" * 300).endswith("…") and one_line(" a \n b ") == "a b"
    assert useful("abc") and not useful("ab") and not useful("./..") and not useful("123") and not useful("x" * 81)
    many = "def f():\n" + "\n".join(f"    a = 'text number {i}'" for i in range(20))
    assert len(parse("a.py", many, "py").symbols[0].strings) == 10


def test_parse_files(spark):
    rows = spark.createDataFrame([("a.py", "py", "h", "def f(): pass"), ("b.ts", "ts", "h", None), ("c.ts", "ts", "h", "export const x = 1; import './d'")], "path string, lang string, hash string, text string")
    got = {r.path: r for r in parse_files(rows).collect()}
    assert got["a.py"].symbols[0].name == "f" and got["b.ts"].symbols == [] and got["c.ts"].specifiers == ["./d"]
