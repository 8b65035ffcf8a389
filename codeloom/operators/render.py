"""Results as text: 'ai' (pipe separated), 'default' (Markdown) and 'human' (aligned table).

Rendering collects its input: give it ordered, limited results.
"""

from __future__ import annotations

from collections.abc import Iterable

from codeloom.functions.text import TYPE_CODES
from codeloom.operators.diff import SHORT

FORMATS = ("default", "human", "ai")
_MORE = {"function": "FUNCTIONS", "class": "CLASSES", "method": "METHODS", "enum": "ENUMS", "static": "STATICS", "heading": "HEADINGS", "code_block": "CODE BLOCKS"}


def _code(kind: str | None) -> str:
    return TYPE_CODES.get(kind or "", kind or "")


def _opt(label: str, value) -> str:
    return f"|{label}{value}" if value not in (None, "") else ""


def _sum(rows: list, metric: str) -> list[tuple[str, int]]:
    return sorted((r["key"], r["value"]) for r in rows if r["metric"] == metric)


def _stats(rows: list, _: dict) -> list[str]:
    types, total = dict(_sum(rows, "type")), dict(_sum(rows, "total"))
    return ["[STATS]", "LANGS: " + " ".join(f"{k}:{v}" for k, v in _sum(rows, "language")), "SYMS: " + " ".join(f"{_code(t)}:{types.get(t, 0)}" for t in _MORE), f"TOTALS: files:{total.get('files', 0)} syms:{total.get('symbols', 0)} bytes:{total.get('bytes', 0)}"]


def _span(v) -> str:
    return "" if v is None else f"{v['start']}-{v['end']}"


def _diff(rows: list, about: dict) -> list[str]:
    if not rows:
        return ["NO_CHANGES"]
    order = {"added": 0, "deleted": 1, "modified": 2, "signature_changed": 3}
    out = [f"[DIFF:{about.get('commit', '')[:8]}]", f"FILES:{about.get('files', len({r['path'] for r in rows}))} CHANGES:{len(rows)}"]
    for r in sorted(rows, key=lambda r: (order[r["change_type"]], r["path"], r["name"])):
        where = _span(r["new_lines"]) or _span(r["old_lines"]) + "(del)"
        sig = _opt("old:", r["old_signature"]) + _opt("new:", r["new_signature"]) if r["change_type"] == "signature_changed" else ""
        out.append(f"{SHORT[r['change_type']]}|{r['name']}|{_code(r['symbol_type'])}|{r['path']}|{where}{sig}")
    return out


def _breaking(rows: list, about: dict) -> list[str]:
    if not rows:
        return ["NO_BREAKING_CHANGES"]
    out = [f"[BREAKING:{about.get('commit', '')[:8]}]", f"COUNT:{len(rows)}"]
    for r in rows:
        gone = r["change_type"] == "deleted"
        tail = _opt("was:", r["old_signature"]) if gone else _opt("old:", r["old_signature"]) + _opt("new:", r["new_signature"])
        out.append(f"{'REMOVED' if gone else 'SIG_CHANGED'}|{r['name']}|{_code(r['symbol_type'])}|{r['path']}{tail}")
    return out


def _untested(rows: list, about: dict) -> list[str]:
    total = about.get("total", len(rows))
    percent = 100.0 if not total else 100.0 * (total - len(rows)) / total
    return [f"[UNTESTED:{len(rows)}|{percent:.1f}%]", f"TESTED:{total - len(rows)} TOTAL:{total}", *(f"{r['name']}|{_code(r['symbol_type'])}|{r['path']}:{r['line']}{_opt('sig:', r['signature'])}" for r in rows)]


def _entrypoints(rows: list, _: dict) -> list[str]:
    n = {c: sum(r["category"] == c for r in rows) for c in ("main", "api", "unused")}
    return [f"[ENTRYPOINTS:{len(rows)}]", f"MAIN:{n['main']} API:{n['api']} UNUSED:{n['unused']}", *(f"{r['category']}|{r['name']}|{_code(r['symbol_type'])}|{r['path']}:{r['line']}{_opt('sig:', r['signature'])}" for r in rows)]


def _trace(rows: list, about: dict) -> list[str]:
    head = f"[TRACE:{about.get('source', '')}->{about.get('target', '')}]"
    if not rows:
        return [head, "FOUND:false"]
    return [head, f"FOUND:true STEPS:{len(rows)}", "PATH:" + "|".join(r["name"] for r in rows), *(f"{r['name']}|{_code(r['symbol_type'])}|{r['path']}:{r['line']}" for r in rows)]


def _blame(rows: list, about: dict) -> list[str]:
    out = []
    for r in rows:
        out += [f"[BLAME:{about.get('name', '')}|{about.get('symbol_type', '')}]", f"LINES:{r['line_start']}-{r['line_end']}", f"COMMIT:{r['short_hash']}|{r['author']}|{r['date']}|{r['message']}"]
        out += [f"{k}:{r[c]}" for k, c in (("OLD_SIG", "old_signature"), ("NEW_SIG", "new_signature")) if r[c]]
    return out


def _history(rows: list, about: dict) -> list[str]:
    out = [f"[HISTORY:{about.get('name', '')}|{len(rows)}]"]
    for r in rows:
        span = f"|{r['line_start']}-{r['line_end']}" if r["line_start"] is not None else ""
        out.append(f"{'+' if r['existed'] else '-'}|{r['short_hash']}|{r['date']}|{r['message']}{span}{_opt('sig:', r['signature'])}")
    return out


def _types(rows: list, _: dict) -> list[str]:
    seen = sorted({(r["name"], r["symbol_type"], r["path"], r["line"]) for r in rows}, key=str)
    out = [f"[TYPES:{len(seen)}]"]
    for s in seen:
        out.append(f"SYM:{s[0]}|{_code(s[1])}|{s[2]}:{s[3]}")
        for r in sorted((r for r in rows if (r["name"], r["symbol_type"], r["path"], r["line"]) == s), key=lambda r: r["position"]):
            where = f"{r['def_path']}:{r['def_line']}" if r["def_path"] else "-"
            out.append(f"P:{r['param']}|{r['type']}|{where}" if r["kind"] == "param" else f"R:{r['type']}|{where}")
    return out


def _schema(rows: list, _: dict) -> list[str]:
    out = [f"[SCHEMA:{len(rows)}]"]
    for r in rows:
        out.append(f"SYM:{r['name']}|{_code(r['symbol_type'])}|{r['language']}|{r['path']}:{r['line']}")
        out += [f"F:{f['field']}{'?' if f['optional'] else ''}|{f['type']}{_opt('=', f['default_value'])}" for f in r["fields"]]
    return out


def _map(rows: list, about: dict) -> list[str]:
    stats, level = about["stats"], about.get("level", 1)
    types, total = dict(_sum(stats, "type")), dict(_sum(stats, "total"))
    out = ["[PROJECT]", "LANGS: " + " ".join(f"{k}:{v}" for k, v in _sum(stats, "language")), f"FILES:{total.get('files', 0)} SYMBOLS:{total.get('symbols', 0)} " + " ".join(f"{n}:{types.get(t, 0)}" for t, n in _MORE.items())]
    if level > 1:
        out += ["", "[FILES]"]
        for r in sorted(rows, key=lambda r: r["path"]):
            inner = ",".join(f"{_code(s['symbol_type'])}:{s['name']}@{s['line_start']}-{s['line_end']}" for s in (r["symbols"] or [])) if level > 2 else ""
            out.append(f"{r['path']}|{r['language']}|{r['size']}{'|' + inner if inner else ''}")
    return out


def _body(r) -> str | None:
    return r["body"] if "body" in (r.asDict() if hasattr(r, "asDict") else r) else None


def _query(rows: list, about: dict) -> list[str]:
    """Signatures and docs only with full context."""
    out = [f"[RESULTS:{len(rows)}]"]
    for r in rows:
        more = _opt("sig:", r["signature"]) + _opt("doc:", r["docstring"]) if about.get("context") else ""
        out.append(f"{r['name']}|{_code(r['symbol_type'])}|{r['path']}|{r['line_start']}-{r['line_end']}" + ("|exp" if r["is_exported"] else "") + more)
        if (body := _body(r)) is not None:
            out[-1] += "|body:"
            out += [f"  {line}" for line in body.splitlines()]
    return out


def _inspect(rows: list, about: dict) -> list[str]:
    head = [f"[FILE:{about.get('file', '')}]", f"LANG:{about.get('language', '')} SIZE:{about.get('size', 0)} SYMS:{len(rows)}"]
    return head + [f"{r['name']}|{r['symbol_type'][:1]}|{r['line_start']}-{r['line_end']}{_opt('sig:', r['signature'])}" for r in rows]


def _saved(rows: list, _: dict) -> list[str]:
    return [line for r in rows for line in (f"[SNAPSHOT_SAVED:{r['snapshot']}]", f"FILES:{r['files']} SYMBOLS:{r['symbols']}{f' COMMIT:{r['commit']}' if r['commit'] else ''}")]


def _sections(rows: list, about: dict) -> list[str]:
    """Symbols in the default form: a section each."""
    out = []
    for r in rows:
        n = r["line_end"] - r["line_start"] + 1
        out += ["", f"## {r['name']}", f"- Type: {r['symbol_type']}{' (exported)' if r['is_exported'] else ''}", f"- File: {r['path']}", f"- Lines: {r['line_start']}-{r['line_end']}"]
        out += [f"- Signature: {r['signature']}"] if r["signature"] else []
        out += [f"- Documentation: {r['docstring']}"] if about.get("context") and r["docstring"] else []
        if about.get("body"):
            out += ["", "Code:", _body(r)] if _body(r) is not None else ["", f"(body of {n} lines left out)"]
    return out


def _columns(rows: list, about: dict) -> list[dict]:
    """Symbols in the human form: the columns of its table."""
    out = []
    for r in rows:
        one = {"Name": r["name"], "Type": r["symbol_type"], "File": r["path"], "Lines": f"{r['line_start']}-{r['line_end']}", "Exported": "yes" if r["is_exported"] else "no"}
        if about.get("context"):
            one |= {"Signature": r["signature"], "Documentation": r["docstring"]}
        out.append(one | ({"Code": _body(r)} if about.get("body") else {}))
    return out


_LINES = {
    "deps": (lambda n, a: f"[DEPS:{a.get('target', '')}|{a.get('direction', 'imports')}]", lambda r: str(r[0])),
    "callers": (lambda n, a: f"[CALLERS:{a.get('query', '')}|{n}]", lambda r: f"{r['caller_name']}|{_code(r['caller_type'])}|{r['path']}:{r['line']}"),
    "callees": (lambda n, a: f"[CALLEES:{a.get('query', '')}|{n}]", lambda r: f"{r['callee_name']}|{_code(r['callee_type'])}|{r['path']}:{r['line']}{_opt('sig:', r['context'])}"),
    "tests": (lambda n, a: f"[TESTS:{a.get('query', '')}|{n}]", lambda r: f"{r['test_name']}|{_code(r['test_type'])}|{r['path']}:{r['line']}|call:{r['call_line']}"),
    "test_deps": (lambda n, a: f"[TEST_DEPS:{a.get('file', '')}|{n}]", lambda r: f"{r['name']}|{_code(r['symbol_type'])}|{r['path']}:{r['line']}|from:{r['called_from_line']}"),
    "implements": (lambda n, a: f"[IMPLEMENTS:{a.get('query', '')}|{n}]", lambda r: f"{r['implementor']}|{r['interface']}|{r['kind']}|{r['language']}|{r['path']}:{r['line']}"),
    "snapshots": (lambda n, a: f"[SNAPSHOTS:{n}]", lambda r: str(r[0])),
}
_BLOCKS = {"query": _query, "inspect": _inspect, "snapshot_saved": _saved, "stats": _stats, "diff": _diff, "breaking": _breaking, "untested": _untested, "entrypoints": _entrypoints, "trace": _trace, "blame": _blame, "history": _history, "types": _types, "schema": _schema, "map": _map}


def _table(rows: list, human: bool) -> list[str]:
    if not rows:
        return ["No results."]
    names = list(rows[0].asDict()) if hasattr(rows[0], "asDict") else list(rows[0])
    cells = [[("" if r[n] is None else str(r[n])).replace("\n", " ").replace("|", "\\|") for n in names] for r in rows]
    if not human:
        return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(c) + " |" for c in cells)]
    wide = [max(len(n), *(len(c[i]) for c in cells)) for i, n in enumerate(names)]
    bar = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    row = lambda c: "| " + " | ".join(x.ljust(w) for x, w in zip(c, wide, strict=True)) + " |"
    return [bar, row(names), bar, *map(row, cells), bar]


def render(result: str, rows: Iterable, fmt: str = "default", **about) -> str:
    """One result as text; ``about`` holds what its header names (query, commit, totals ...)."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    rows = rows.collect() if hasattr(rows, "collect") else list(rows)
    if fmt == "ai":
        if result in _BLOCKS:
            return "\n".join(_BLOCKS[result](rows, about))
        head, line = _LINES[result]
        return "\n".join([head(len(rows), about), *map(line, rows)])
    count = f"{len(rows)} of {about['total']}" if result in ("callers", "callees") and about.get("total", len(rows)) > len(rows) else str(len(rows))
    title = f"{result.replace('_', ' ').capitalize()} ({count})"
    if result in ("query", "inspect") and rows:
        title = f"{len(rows)} symbols" if result == "query" else f"{about.get('file', '')}: {about.get('language', '')}, {about.get('size', 0)} bytes, {len(rows)} symbols"
        return "\n".join([f"# {title}", *_sections(rows, about)] if fmt == "default" else [title, *_table(_columns(rows, about), True)])
    return "\n".join([f"# {title}" if fmt == "default" else title, *_table(rows, fmt == "human")])
