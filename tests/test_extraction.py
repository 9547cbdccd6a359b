"""Symbols of hand-written samples, one per language: what a full parser of the language finds in them."""

import pytest

from strandweave.extract.symbols import extract_text

SAMPLES = {
'm/a.ts':'''import fs from "fs";
import { x } from './m'
const y = require("q")
export abstract class Foo<T> extends ns.Bar<T> implements Baz {
  private a = 1
  constructor(private b: string) { super(); this.go() }
  async go(x: number): Promise<void> {
    const inner = (z) => { helper(z); };
    if (x) { other(); }
    return items.map((i) => { deep(i); return { a: 1 }; })
  }
  get v() { return calc(); }
  abstract nope(): void;
  handler = () => { nop() }
}
export default function main() { run(`a ${b(1)}`) }
export const arrow = async (a: string): Promise<number> => run2(a)
const one = x => {
  return two(x)
}
let obj = { m() { zz(); } };
function* gen() { yield 1 }
const re = /["'(]/g; function after() { last() }
const fx = function () { inside() }
if (a) { outer() }
''',
'm/a.go':'''package m
import (
	"fmt"
	str "strings"
)
import "os"
type T struct {
	A int
}
type (
	U struct { B int }
	I interface { M(a int) error }
)
type F func(int) int
var x = map[string]int{"a": 1}
func (t *T) Run(a int) (int, error) {
	fmt.Println(str.ToUpper("x{"))
	go func() { Free() }()
	if v := calc(); v > 0 {
		return helper(v), nil
	}
	return 0, nil
}
func Gen[K comparable](k K) K { return id(k) }
func (s Set[K]) Add(k K) {}
func Free() {
	Run()
}
''',
'm/a.rs':'''use std::{fmt, io::Read};
pub use a::b;
mod inner { pub fn deep() { x::y::call(); mac!(z()); } }
pub struct S<'a> { a: &'a str }
struct Unit;
struct Tup(u8);
enum E { A, B(u8) }
pub trait Tr: Base { fn sig(&self); fn dflt(&self) { self.sig() } }
impl<'a, T: Fn(u8) -> u8> Tr for S<'a> where T: X { fn sig(&self) { free(1); let c = '{'; } }
impl S<'_> { pub async fn new() -> Self { Self { a: "}" } } }
fn free(x: u8) -> u8 { if x > 1 { other(x) } else { r#"{"# ; 2 } }
''',
'm/A.java':'''package p;
import java.util.List;
import static a.B.*;
@Ann(x = 1)
public abstract class A<T> extends ns.B<T> implements C, D<E> {
  private int f = calc(1);
  int[] arr = {1, 2};
  public A() { init(); }
  @Override public <U> List<U> go(final int x) throws IOException { return run(new Foo(x) { void anon() { q(); } }); }
  abstract int sig(int a);
  static { boot(); }
  enum K { X(1) { int v() { return w(); } }, Y; K(int i) { } int h() { return 1; } }
  interface I extends J, L { void m(); default int d() { return e(); } }
  record P(int a) implements Q { P { check(); } }
  Runnable r = () -> { lam(); };
}
''',
'm/a.c':'''#include <stdio.h>
#include "x.h"
#define M(a) { a
typedef struct P { int x; } P;
struct Q;
enum E { A, B };
static int *go(int a, char *b) { if (a) { return run(a); } p->call(1); obj.call2(); return NULL; }
int arr[] = { 1, 2 };
struct P make(void)
{
  return mk();
}
int decl(int);
''',
'm/a.cpp':'''#include <v>
namespace n { 
class A final : public B, private ns::C<int> {
 public:
  A(int x) : x_(x) { init(); }
  virtual ~A() {}
  int go(int x) const override { return run(x); }
  template <class T> T tt(T a) { return a; }
 private: int x_;
};
struct S { int v; };
int A::out(int y) { return helper(y) + a.b(); }
template <typename T>
T free_fn(T y) { auto l = [](int q) { return inner(q); }; return y; }
}
enum class EE { X };
''',
'm/a.cs':'''using System.IO;
using static X.Y;
namespace N.M {
  [Attr(1)]
  public class A<T> : B<T>, IC where T : new() {
    public int P { get; set; }
    public A(int x) : base(x) { Init(); }
    public async Task<int> Go(int x) { return Run(this.Do(x), $"a{b}"); }
    int Expr(int x) => Calc(x);
    abstract void Sig();
    struct Inner { }
  }
  interface I { void M(); }
  record R(int A);
}
''',
}

SAMPLES["m/a.rb"] = """require 'json'
require_relative "lib/x"
module M
  class A < N::B
    def go(x)
      if x then run(1) end
      items.each do |i|
        deep(i)
      end
    end
    def self.make
      build(2)
    end
  end
end
"""
SAMPLES["m/a.py"] = """import os, sys as s
from a.b import c
@deco
class A(n.B, C):
    def go(self):
        def inner():
            return deep(1)
        return self.run(helper())
async def main():
    await go()
"""

#: path -> labels in order, (relation, target) of imports and bases, (last part of the caller's id, name) of calls
WANT = {
    "m/a.ts": (["Foo", ".constructor()", ".go()", "inner()", ".v()", "main()", "arrow()", "one()", "gen()", "after()", "fx()"], {("imports_from", "fs"), ("imports_from", "m"), ("imports_from", "q"), ("inherits", "bar")},
               {("constructor", "go"), ("inner", "helper"), ("go", "other"), ("go", "map"), ("go", "deep"), ("v", "calc"), ("main", "run"), ("arrow", "run2"), ("one", "two"), ("after", "last"), ("fx", "inside")}),
    "m/a.go": (["T", "U", "I", "F", ".Run()", "Gen()", ".Add()", "Free()"], {("imports", "fmt"), ("imports", "strings"), ("imports", "os")},
               {("run", "Println"), ("run", "ToUpper"), ("run", "Free"), ("run", "calc"), ("run", "helper"), ("gen", "id"), ("free", "Run")}),
    "m/a.rs": (["inner", "deep()", "S", "Unit", "Tup", "E", "Tr", ".sig()", ".dflt()", ".sig()", ".new()", "free()"], {("imports", "std_fmt_io_read"), ("imports", "a_b"), ("implements", "tr")},
               {("deep", "call"), ("deep", "z"), ("dflt", "sig"), ("sig", "free"), ("free", "other")}),
    "m/A.java": (["A", ".A()", ".go()", ".sig()", "K", ".K()", ".h()", "I", ".m()", ".d()", "P"], {("imports", "java_util_list"), ("imports", "a_b"), ("inherits", "b"), ("implements", "c"), ("implements", "d"), ("inherits", "j"), ("inherits", "l"), ("implements", "q")},
                 {("a", "init"), ("go", "run"), ("go", "q"), ("d", "e")}),
    "m/a.c": (["P", "go()", "make()"], {("imports", "stdio_h"), ("imports", "x_h")}, {("go", "run"), ("make", "mk")}),
    "m/a.cpp": (["A", ".A()", ".A()", ".go()", ".tt()", "S", "out()", "free_fn()"], {("imports", "v"), ("inherits", "b"), ("inherits", "c")}, {("a", "init"), ("go", "run"), ("out", "helper"), ("fn", "inner")}),
    "m/a.cs": (["N.M", "A", ".A()", ".Go()", ".Expr()", ".Sig()", "Inner", "I", ".M()"], {("imports", "system_io"), ("imports", "x_y"), ("inherits", "b"), ("inherits", "ic")}, {("a", "Init"), ("go", "Run"), ("go", "Do")}),
    "m/a.rb": (["M", "A", ".go()", ".make()"], {("imports", "json"), ("imports", "lib_x"), ("inherits", "b")}, {("go", "run"), ("go", "deep"), ("make", "build")}),
    "m/a.py": (["A", ".go()", "main()"], {("imports", "os"), ("imports", "sys"), ("imports_from", "a_b"), ("inherits", "b"), ("inherits", "c")}, {("go", "deep"), ("go", "run"), ("go", "helper"), ("main", "go")}),
}


@pytest.mark.parametrize("path", WANT)
def test_symbols_of_samples(path):
    f = extract_text(path, SAMPLES[path])
    labels, names, calls = WANT[path]
    assert f.error is None and f.nodes[0][1] == path.split("/")[-1]
    assert [label for _, label, _ in f.nodes[1:]] == labels
    assert {(r, t) for _, t, r, _ in f.edges if r not in ("contains", "method")} == names
    assert {(s.split("_")[-1], name) for s, name, _ in f.stubs} == calls
    # every symbol is held by its class or the file, on a line of the text
    ids = {n for n, _, _ in f.nodes}
    assert {t for _, t, r, _ in f.edges if r in ("contains", "method")} == {n for n, _, _ in f.nodes[1:]} and all(1 <= line <= SAMPLES[path].count("\n") + 1 for _, _, line in f.nodes)
    assert all(s in ids for s, _, _ in f.stubs)


@pytest.mark.parametrize("path", WANT)
def test_cut_and_mixed_up_files_give_what_they_can(path):
    text = SAMPLES[path]
    for cut in range(0, len(text), 41):
        for t in (text[:cut], text[cut:], text[:cut] + "}}}" + text[cut:], text[:cut] + "((({" + text[cut:]):
            f = extract_text(path, t)
            assert f.nodes[0][1] == path.split("/")[-1]
    assert extract_text(path, "").nodes[1:] == [] and extract_text(path, None).stubs == []
    assert extract_text(path, "(" * 5000 + "{" * 5000) is not None
