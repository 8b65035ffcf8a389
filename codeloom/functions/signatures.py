"""Types named in a signature: parameters, return type and the base types to resolve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that are never looked up.
PRIMITIVES = """
Any Arc Array BTreeMap BTreeSet Boolean Box Byte Character Dict Double Float HashMap HashSet
Integer List Long Map Object Option Optional Promise Rc Result Set Short String Tuple
Union Vec bool boolean byte char dict double error f32 f64 float i128 i16
i32 i64 i8 int isize list long null number object rune set short signed
str string tuple u128 u16 u32 u64 u8 undefined unsigned usize void
""".split()


def split_top(s: Column, sep: str = ",") -> Column:
    """Split at separators outside all brackets; '>' of an arrow closes a bracket too."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("parts"))

    def step(a, c):
        cut = (c == sep) & (a["depth"] == 0)
        depth = a["depth"] + F.when(c.isin("<", "(", "[", "{"), 1).when(c.isin(">", ")", "]", "}"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(cut, F.lit("")).otherwise(F.concat(a["cur"], c)).alias("cur"), F.when(cut, F.concat(a["parts"], F.array(a["cur"]))).otherwise(a["parts"]).alias("parts"))

    end = lambda a: F.when(F.trim(a["cur"]) != "", F.concat(a["parts"], F.array(a["cur"]))).otherwise(a["parts"])
    pieces = F.aggregate(F.split(s, ""), start, step, end)
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")


def clean(t: Column) -> Column:
    """Without leading references, lifetimes' marks and repeated 'mut '."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(t), r"^&+\s*", ""), r"^(?:mut\s+)+", ""))


def base_types(t: Column) -> Column:
    """Outer type first, then the arguments of one generic level, without primitives."""
    t = clean(t)
    outer = F.trim(F.regexp_extract(t, r"^([^<\[]*)", 1))
    inner = F.regexp_extract(t, r"^[^<\[]*[<\[](.*)[>\]]\s*$", 1)
    args = F.transform(split_top(inner), lambda x: F.trim(F.regexp_extract(clean(x), r"^([^<\[]*)", 1)))
    return F.filter(F.concat(F.array(outer), args), lambda x: (x != "") & ~x.isin(*PRIMITIVES))


def _inside(sig: Column) -> Column:
    return F.regexp_extract(sig, r"\(([^)]*)\)", 1)


def _named(name: Column, t: Column) -> Column:
    return F.struct(F.trim(name).alias("name"), F.trim(t).alias("type"))


_NONE = "array<struct<name:string,type:string>>"


def _colon_params(sig: Column, skip: tuple[str, ...], cut_default: bool, drop: str) -> Column:
    def one(p):
        q = F.regexp_replace(p, drop, "") if drop else p
        t = F.regexp_extract(q, r"^[^:]*:(.*)$", 1)
        t = F.trim(F.regexp_extract(t, r"^([^=]*)", 1)) if cut_default else F.trim(t)
        return _named(F.regexp_extract(q, r"^([^:]*)", 1), t)

    ps = F.filter(split_top(_inside(sig)), lambda p: p.contains(":") & ~F.trim(p).isin(*skip))
    return F.filter(F.transform(ps, one), lambda x: (x["type"] != "") & ~x["type"].startswith("'"))


def parameters(lang: Column, sig: Column) -> Column:
    """array<struct<name, type>> of the typed parameters."""
    rust = _colon_params(sig, ("self", "&self", "&mut self", "mut self"), False, "")
    python = _colon_params(sig, ("self", "cls"), True, "")
    script = _colon_params(sig, ("this",), True, r"\?")
    go = F.filter(F.transform(split_top(_inside(sig)), lambda p: _named(F.regexp_extract(p, r"^(\S+)\s+.+$", 1), F.regexp_extract(p, r"^\S+\s+(.+)$", 1))), lambda x: x["type"] != "")
    bare = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"@\w+(\([^)]*\))?\s*", ""), r"^final\s+", ""))
    java = F.filter(F.transform(split_top(_inside(sig)), lambda p: _named(F.regexp_extract(bare(p), r"(\S+)$", 1), F.regexp_extract(bare(p), r"^(.+)\s+\S+$", 1))), lambda x: x["type"] != "")

    def c_one(p):
        last, head = F.regexp_extract(p, r"(\S+)$", 1), F.regexp_extract(p, r"^(.+)\s+\S+$", 1)
        stars = F.regexp_extract(last, r"^(\**)", 1)
        return _named(F.regexp_replace(last, r"^\**", ""), F.concat(head, stars))

    c = F.filter(F.transform(F.filter(split_top(_inside(sig)), lambda p: F.trim(p) != "void"), c_one), lambda x: x["type"] != "")
    out = F.when(lang == "rust", rust).when(lang == "python", python).when(lang.isin("javascript", "typescript"), script).when(lang == "go", go).when(lang == "java", java).when(lang == "c", c)
    return F.coalesce(out, F.array().cast(_NONE))


def return_type(lang: Column, sig: Column) -> Column:
    """Null where there is none or it says nothing."""
    some = lambda x, *no: F.when((x != "") & ~x.isin(*no), x)
    rust = some(F.trim(F.regexp_extract(sig, r"->\s*([^{]+)", 1)), "()")
    python = some(F.trim(F.regexp_extract(sig, r"->\s*([^:]+)", 1)), "None")
    script = some(F.trim(F.regexp_extract(sig, r"\)\s*:\s*([^{=]+)", 1)), "void")
    go = some(F.trim(F.regexp_extract(sig, r"\)\s*([^{]+)", 1)), "error")
    before = F.regexp_extract(sig, r"([\w<>\[\],.]+)\s+\w+\s*\(", 1)
    pointer = F.trim(F.regexp_extract(sig, r"([\w]+(?:\s*\*+)?)\s*\w+\s*\(", 1))
    return F.when(lang == "rust", rust).when(lang == "python", python).when(lang.isin("javascript", "typescript"), script).when(lang == "go", go).when(lang == "java", some(before, "void")).when(lang == "c", some(pointer, "void"))
