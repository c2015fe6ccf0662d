"""Declarations of brace languages, in files written by hand; what is expected was read off them by eye."""

import random

import pytest

from loomgrain.operators.braces import declarations

SCRIPT = '''export class Store<T extends { x: number }> extends Base<T> implements Kept {
  private url = `http://${host}/${ {a: 1}.a }/}`;
  re = /[/"'`{]+/g;
  constructor(private x: number) {
    super(); if (x) { y(); }
  }
  @dec({ a: 1 })
  async get<K>(key: K, opts: { a: string } = {}): Promise<{ ok: boolean }> {
    return { helper() { return 1; }, other: 2 };
  }
  handler = (e: Event) => {
    x / 2; return a < b;
  };
  static *gen() {
    yield 1;
  }
}
const f = async <T,>(x: T): Promise<T> => {
  return x;
};
export default async function load(): Promise<void> {
  const el = <div className="it's" on={() => { go(); }}>don't {x ? <b>yes {"}"}</b> : null} stop{'{'}</div>;
}
type Union =
  | 'a'
  | { b: string }
  | C
interface Inner extends J {
  m(): void;
}
abstract class Q {
  run() {
    return 1;
  }
}
const o = {
  go(a, b) {
    return a;
  },
  get x() { return 1; },
};
const late = function named() { class Local { } };
if (a) { function nested(): { a: 1 } { } }
'''
IN_SCRIPT = [
    ("class_declaration", "Store", 0, 16), ("method_definition", None, 3, 5), ("method_definition", None, 7, 9), ("method_definition", None, 8, 8), ("method_definition", None, 13, 15),
    ("function_declaration", "load", 20, 22), ("type_alias_declaration", "Union", 23, 26), ("interface_declaration", "Inner", 27, 29), ("method_definition", None, 31, 33),
    ("method_definition", None, 36, 38), ("method_definition", None, 39, 39), ("class_declaration", "Local", 41, 41), ("function_declaration", "nested", 42, 42),
]

RUST = '''/* a /* nested { */ still */
#[derive(Debug)]
pub(crate) struct P<'a> {
    x: &'a str,
}
struct Unit;
struct Pair(u8, Vec<Vec<u8>>);
impl<T> From<T> for P<'static> where T: Fn() -> u8 {
    fn from(t: T) -> Self {
        let s = r#"fn fake() { "#; let c = '{'; let l: &'static str = "}"; let b = b'}';
        vec![1, { 2 }];
        x
    }
}
impl fmt::Display for Thing {
    pub async unsafe fn go<F: Fn(u8) -> u8>(f: F) -> Result<(), E> {
    }
}
impl A for B { }
macro_rules! m { ($x:ident) => { fn $x() { } } }
trait T { fn sig(&self); fn body(&self) { } }
pub mod inner {
    enum E { A { x: u8 }, B(u8) }
    const fn k() -> usize { 1 }
}
extern "C" fn ext() {
}
mod elsewhere;
'''
IN_RUST = [
    ("struct_item", "P", 2, 4), ("struct_item", "Unit", 5, 5), ("struct_item", "Pair", 6, 6), ("impl_item", None, 7, 13), ("function_item", "from", 8, 12), ("impl_item", "Thing", 14, 17),
    ("function_item", "go", 15, 16), ("impl_item", "A", 18, 18), ("function_item", "body", 20, 20), ("trait_item", "T", 20, 20), ("mod_item", "inner", 21, 24), ("enum_item", "E", 22, 22),
    ("function_item", "k", 23, 23), ("function_item", "ext", 25, 26), ("mod_item", "elsewhere", 27, 27),
]


def test_script():
    assert declarations(SCRIPT, False) == IN_SCRIPT


def test_rust():
    assert declarations(RUST, True) == IN_RUST


def test_a_broken_member_leaves_the_others():
    lines = SCRIPT.split("\n")
    lines.insert(10, "  broken( {")
    shift = lambda rows: [(k, n, a + (a >= 10), b + (b >= 10)) for k, n, a, b in rows]
    assert declarations("\n".join(lines), False) == shift(IN_SCRIPT)
    lines = RUST.split("\n")
    lines[23] = "    fn k( {"
    assert [d for d in declarations("\n".join(lines), True) if d[1] != "k"] == [d for d in IN_RUST if d[1] != "k"]


@pytest.mark.parametrize(("source", "rust"), [(SCRIPT, False), (RUST, True)])
def test_any_cut_is_read(source, rust):
    """No cut, deletion or garbage raises, and declarations before a cut stay."""
    whole = declarations(source, rust)
    for at in range(0, len(source), 3):
        declarations(source[at:], rust)
        line = source.count("\n", 0, at)
        got = declarations(source[:at], rust)
        assert {d for d in whole if d[3] < line and not any(o[2] <= d[2] and o[3] >= line for o in whole)} <= set(got)
    rng = random.Random(1)
    for _ in range(200):
        declarations("".join(rng.choices(list("{}()[]<>`'/$;:=,. ab*#@!|&?") + ['"', "\\", "\n"], k=80)), rust)


def test_time_is_in_proportion():
    import time

    def seconds(n):
        began = time.perf_counter()
        for piece in ("{", "(", "class A<", "<div>", "`${", "fn a<", "type A = ", "/*"):
            declarations(piece * n, piece.startswith("fn"))
        return time.perf_counter() - began

    assert seconds(8000) < 6 * max(seconds(4000), 0.05)
