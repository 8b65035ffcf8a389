"""Scalar expressions over paths, names, lines and signatures; all built-in, none a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "java": "java", "go": "go", "c": "c", "h": "c", "md": "markdown"}
TYPE_CODES = {"function": "f", "class": "c", "method": "m", "enum": "e", "static": "s", "heading": "h", "code_block": "cb", "interface": "if", "type": "ty"}
_ALIASES = {"function": "func fn", "static": "staticfield", "heading": "header", "code_block": "codeblock", "type": "typealias type_alias", "class": "", "method": "", "enum": "", "interface": ""}
SINGULAR = {a: t for t, more in _ALIASES.items() for a in (t, *more.split())}
PLURALS = {{"class": "classes"}.get(a, "typealiases" if a == "typealias" else "type_aliases" if a == "type_alias" else a + "s"): t for a, t in SINGULAR.items()}
DOCS = ("heading", "code_block")


def lookup(values: dict[str, str], key: Column, default: str | None = None) -> Column:
    m = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    found = F.element_at(m, key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """By extension, case-sensitively; 'unknown' else."""
    return lookup(LANGUAGES, extension(path), "unknown")


def lines(content: Column) -> Column:
    """The lines, without a final empty one and without carriage returns; none for empty content.

    Without carriage returns, no pattern is needed: the final newline goes as a byte and the split is plain.
    """
    parts = F.split(F.regexp_replace(content, r"\r?\n\z", ""), r"\r?\n")
    cut = F.substring(content.cast("binary"), F.lit(1), F.octet_length(content) - 1).cast("string")
    plain = F.split(F.when(content.endswith("\n"), cut).otherwise(content), "\n")
    return F.when(content == "", F.array().cast("array<string>")).when(content.contains("\r"), parts).otherwise(plain)


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def tail(name: Column) -> Column:
    """A qualified name's last part: after the last '::', else after the last '.'."""
    return F.when(name.contains("::"), F.element_at(F.split(name, "::"), -1)).otherwise(F.element_at(F.split(name, r"\."), -1))


def tail_of(name: str) -> str:
    return name.rsplit("::", 1)[-1] if "::" in name else name.rsplit(".", 1)[-1]


def squashed(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s", ""))


def is_test_file(path: Column, lang: Column | None = None) -> Column:
    """The naming rules of each language for files of tests."""
    lang = language(path) if lang is None else lang
    name = file_name(path)
    ends = lambda *xs: F.coalesce(*[F.when(name.endswith(x), True) for x in xs], F.lit(False))
    script = [f".{k}.{x}" for k in ("test", "spec") for x in ("js", "ts", "jsx", "tsx")]
    return (
        F.when(lang == "rust", name.endswith("_test.rs") | name.startswith("test_") | path.contains("/tests/"))
        .when(lang == "python", name.startswith("test_") | name.endswith("_test.py") | path.contains("/tests/"))
        .when(lang.isin("javascript", "typescript"), ends(*script) | path.contains("__tests__") | path.contains("/tests/"))
        .when(lang == "go", name.endswith("_test.go"))
        .when(lang == "java", name.endswith("Test.java") | name.startswith("Test") | path.contains("/test/"))
        .otherwise(F.lit(False))
    )


#: Marks of a test, and the lines that a search for one passes over, by language.
TEST_MARKS = {"rust": (("#[test]", "#[tokio::test]"), "#["), "java": (("@Test",), "@")}


def test_mark(lang: Column, line: Column) -> tuple[Column, Column]:
    """Whether a test's mark is in the line, and whether a search for one passes over it: over a
    blank line, a mark or a comment."""
    found, passed, text = F, F, F.trim(line)
    for k, (marks, opening) in TEST_MARKS.items():
        held = F.lit(False)
        for m in marks:
            held = held | line.contains(m)
        found = found.when(lang == k, held)
        passed = passed.when(lang == k, (text == "") | text.startswith(opening) | text.startswith("//"))
    return found.otherwise(F.lit(False)), passed.otherwise(F.lit(False))


def is_test_symbol(name: Column, lang: Column, marked: Column) -> Column:
    """Test by a mark, or by its name."""
    return (
        F.when(lang == "rust", marked | name.startswith("test_"))
        .when(lang == "python", name.startswith("test_") | name.startswith("Test"))
        .when(lang.isin("javascript", "typescript"), name.startswith("test") | name.startswith("Test") | name.isin("it", "describe"))
        .when(lang == "go", name.startswith("Test") | name.startswith("Benchmark"))
        .when(lang == "java", marked | name.startswith("test"))
        .otherwise(F.lit(False))
    )


def exported_by_definition(name: Column, lang: Column, definition: Column) -> Column:
    """Visibility read from the definition line; not the parsers' is_exported."""
    line = F.coalesce(definition, F.lit(""))
    start = F.ltrim(line)
    rust = F.lit(False)
    for word in ("async fn", "const", "enum", "fn", "static", "struct", "trait", "type"):
        rust = rust | start.startswith(f"pub {word}")
    for limited in ("crate", "self", "super"):
        rust = rust & ~line.contains(f"pub({limited})")
    script = line.contains("export ") | line.contains("module.exports") | line.contains("exports.")
    return (
        F.when(lang == "rust", rust)
        .when(lang.isin("python", "c"), ~name.startswith("_"))
        .when(lang.isin("javascript", "typescript"), script)
        .when(lang == "go", name.rlike(r"^\p{Lu}"))
        .when(lang == "java", line.contains("public "))
        .otherwise(F.lit(True))
    )


MAIN_WORDS = ("main", "run", "start", "init", "execute", "cli", "app")
API_WORDS = tuple("api create delete endpoint export fetch get handle import list parse patch post process put read route serve transform update validate".split())


def entrypoint_category(name: Column, kind: Column) -> Column:
    low = F.lower(name)
    main, api = low.isin(*MAIN_WORDS), F.lit(False)
    for w in MAIN_WORDS:
        main = main | low.startswith(w + "_")
    for w in API_WORDS:
        api = api | low.startswith(w) | low.endswith(w)
    api = api | kind.isin("class", "enum") | ((kind == "function") & name.rlike(r"^\p{Lu}"))
    return F.when(main, "main").when(api, "api").otherwise("unused")


def span_text(ls: Column, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, inclusive) of an array of lines."""
    return F.array_join(F.slice(ls, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")


def numbered(content: Column, start: Column, end: Column) -> Column:
    """The same with line numbers, null when out of bounds."""
    ls = lines(content)
    rows = F.transform(F.sequence(start, end), lambda i: F.format_string("%4d | %s", i, F.element_at(ls, i)))
    return F.when((start >= 1) & (end >= start) & (end <= F.size(ls)), F.array_join(rows, "\n"))
