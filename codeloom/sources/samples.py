"""Small sources of each language, for the extraction queries and the tests."""

RUST = '''use std::fmt;
pub struct Point { pub x: i32, name: Option<String>, m: HashMap<K, V> }
pub enum Shape { Circle(f64), Square { side: f64 } }
const LIMIT: usize = 10;
impl Point {
    pub fn new(x: i32) -> Self { helper(x); Point { x } }
    fn show(&self) { println!("{}", self.text()); Vec::<u8>::with(1); }
}
fn helper(v: i32) -> i32 { v.abs() }
'''
GO = '''package main
import (
  "fmt"
  "os"
)
// User is one.
type User struct {
  Name, Nick string
  Next *User `json:"n"`
}
type Runner interface { Run(n int) error }
const (
  A = 1
  b = 2
)
func Make(n int) (*User, error) { fmt.Println(helper(n)); return nil, nil }
func (u *User) Rename(s string) { u.set(s) }
'''
JAVA = '''package a;
import java.util.List;
/** Doc. */
public class Box extends Base implements Shape {
  private static final int MAX = 3;
  private List<String> names = new ArrayList<>();
  public Box(int n) { init(n); }
  @Override public String name(int a) throws X { return call(a).trim(); }
  abstract void later();
}
interface Shape { int area(int k); }
enum Color { RED, BLUE }
'''
TS = '''import { a } from "lib";
const fs = require('fs');
export interface Shape { area(): number; }
type Id = string | number;
enum Color { Red }
export class Box extends Base { private n: number = 1; name?: string; get(k: string): number { return this.find(k); } }
export const make = (x: number): Box => new Box(x);
function plain(a, b) { return make(a); }
describe("box", () => { it("works", function () { expect(1); }); });
'''
C = '''#include <stdio.h>
#include "own.h"
struct Node { int v; };
/* sums */
static int sum(int a, int b) { printf("%d", a); return add(a, b); }
int *ptr(void) { return 0; }
'''
PY = '''import os.path
from a.b import c, d as e
LIMIT = 3
class Top(Base):
    "doc"
    size: int = 1
    note: Optional[str]
    def run(self, k): return self.go(k)
    class In:
        def deep(self): pass
def free(a, *b): return helper(a).x()
'''
MD = "# One\n### Three\n## Two\n```py\n# no\na\nb\nc\n```\n"
JS = '''import x from "lib";
export class A extends B { go(k) { return this.run(k); } }
const f = (a) => g(a);
function h(b) { return f(b); }
'''
SAMPLES = {"s.rs": RUST, "s.go": GO, "S.java": JAVA, "s.c": C, "s.py": PY, "s.md": MD, "s.js": JS}
#: More of some languages: TypeScript, traits, headings under headings.
TRAITS = """/// doc
pub trait Draw {}
impl Draw for Point {
    fn draw(&self) {}
}
pub(crate) static N: u8 = 1;
"""
OUTLINE = """intro
# A
text
### B
## C
# D
```js
x
```
"""
MORE = {"s.ts": TS, "t.rs": TRAITS, "n.md": OUTLINE}
