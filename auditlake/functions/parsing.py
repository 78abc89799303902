"""Parsers that no built-in expresses: JSON repair and source code. Arrow-batched UDFs and table functions."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# -- JSON --------------------------------------------------------------------

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)?|[{}\[\],]', re.S)


def first_json_object(text: str | None) -> str | None:
    """The first balanced object of a text, strings respected."""
    start = (text or "").find("{")
    if start < 0:
        return None
    depth = 0
    for m in _TOKEN.finditer(text, start):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return text[start : m.end()]
    return None


def without_fence(text: str) -> str:
    s = text.strip()
    m = re.fullmatch(r"```[^\n]*\n(.*?)\n?\s*```", s, re.S)
    return m[1].strip() if m else s


def repaired_json(text: str | None) -> str | None:
    """Trailing commas gone, an open string and open containers closed."""
    if text is None:
        return None
    s = text.strip()
    out, stack, at, comma = [], [], 0, None
    for m in _TOKEN.finditer(s):
        gap = s[at : m.start()]
        if gap.strip():
            comma = None
        out.append(gap)
        at = m.end()
        token = m[0]
        if token == ",":
            comma = len(out)
        elif token in "}]":
            if comma is not None:
                out[comma] = ""
            if stack and stack[-1] == token:
                stack.pop()
            comma = None
        else:
            comma = None
            if token in "{[":
                stack.append("}" if token == "{" else "]")
            elif len(token) == 1 or not re.fullmatch(r'"(?:[^"\\]|\\.)*"', token, re.S):
                token = token.rstrip()
                token += '\\"' if (len(token) - len(token.rstrip("\\"))) % 2 else '"'
        out.append(token)
    out.append(s[at:])
    return "".join(out) + "".join(reversed(stack))


def parsed_json(text: str | None) -> str | None:
    """The first of the usual readings of a model's answer that is JSON, re-encoded; or null."""
    if not text:
        return None
    plain = without_fence(text)
    inner = first_json_object(plain) or plain
    escaped = re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", inner)
    for candidate in (text.strip(), plain, inner, escaped, repaired_json(inner)):
        try:
            return json.dumps(json.loads(candidate, strict=False))
        except (ValueError, RecursionError):
            continue
    return None


def _scalar(f, kind: str = "string"):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return run


def first_json_object_col(x: Column | str) -> Column:
    return _scalar(first_json_object)(x)


def repaired_json_col(x: Column | str) -> Column:
    return _scalar(repaired_json)(x)


def parsed_json_col(x: Column | str) -> Column:
    return _scalar(parsed_json)(x)


def prefix_logic_error(raw: str | None) -> str | None:
    """logic_error of the JSON object that a raw answer begins with."""
    try:
        data, _ = json.JSONDecoder().raw_decode((raw or "").strip())
    except ValueError:
        return None
    found = data.get("logic_error") if isinstance(data, dict) else None
    return found if isinstance(found, str) and found.strip() else None


def prefix_logic_error_col(x: Column | str) -> Column:
    return _scalar(prefix_logic_error)(x)


# -- Python source -----------------------------------------------------------


def _walk(code: str | None):
    """(node, names of the enclosing classes and functions) of all definitions, outermost first."""
    try:
        root = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    stack = [(root, ())]
    while stack:
        node, path = stack.pop()
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            yield node, path
            path = (*path, node)
        stack += [(child, path) for child in reversed(list(ast.iter_child_nodes(node)))]


def _class_of(path) -> str | None:
    return next((p.name for p in reversed(path) if isinstance(p, ast.ClassDef)), None)


def definitions(code: str | None) -> list[tuple]:
    """(kind, class_name, name, first_line, last_line) of all functions and classes."""
    return [("class" if isinstance(n, ast.ClassDef) else "function", _class_of(p), n.name, n.lineno, n.end_lineno) for n, p in _walk(code)]


def test_definitions(code: str | None) -> list[tuple]:
    return [d for d in definitions(code) if d[0] == "function" and d[2].startswith("test")]


def _parameters(a: ast.arguments) -> list[tuple[str, str, bool]]:
    placed = [(x, "positional_only") for x in a.posonlyargs] + [(x, "positional_or_keyword") for x in a.args]
    out = [(x.arg, kind, k >= len(placed) - len(a.defaults)) for k, (x, kind) in enumerate(placed)]
    out += [(x.arg, "keyword_only", d is not None) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    return out + [(x.arg, kind, True) for x, kind in ((a.vararg, "var_positional"), (a.kwarg, "var_keyword")) if x]


def api_signatures(code: str | None) -> list[tuple]:
    """(key, type, params) of public classes and functions; model validators and private names, with all in private classes, are left out."""
    out = []
    for node, path in _walk(code):
        classes = [p.name for p in path if isinstance(p, ast.ClassDef)]
        marks = {getattr(d.func if isinstance(d, ast.Call) else d, "id", getattr(d.func if isinstance(d, ast.Call) else d, "attr", "")) for d in node.decorator_list}
        if node.name.startswith("_") or any(c.startswith("_") for c in classes) or marks & {"validator", "field_validator", "root_validator", "model_validator"}:
            continue
        if isinstance(node, ast.ClassDef):
            out.append(("class:" + ".".join([*classes, node.name]), "class", []))
        else:
            out.append((".".join([*classes, node.name]), "function", _parameters(node.args)))
    return out


_PARAM = "array<struct<name:string,kind:string,has_default:boolean>>"
_DEFINITION = "array<struct<kind:string,class_name:string,name:string,first_line:int,last_line:int>>"


def definitions_col(x: Column | str) -> Column:
    return _scalar(lambda c: [dict(zip(("kind", "class_name", "name", "first_line", "last_line"), d)) for d in definitions(c)], _DEFINITION)(x)


def api_signatures_col(x: Column | str) -> Column:
    def rows(code):
        return [{"key": k, "type": t, "params": [dict(zip(("name", "kind", "has_default"), p)) for p in ps]} for k, t, ps in api_signatures(code)]

    return _scalar(rows, f"array<struct<key:string,type:string,params:{_PARAM}>>")(x)


# -- data flow of snippets ---------------------------------------------------

_SINK_CALLS = {"system": "SYSTEM_CALL", "popen": "SYSTEM_CALL", "execl": "SYSTEM_CALL", "execv": "SYSTEM_CALL", "eval": "SYSTEM_CALL", "exec": "SYSTEM_CALL"} | dict.fromkeys(
    ("memcpy", "memmove", "strcpy", "strncpy", "strcat", "sprintf", "memset", "gets"), "MEMORY_WRITE"
)
_INPUT_CALLS = {"read", "recv", "fgets", "gets", "scanf", "getenv", "input", "fread"}


class _Flow:
    """Nodes and edges of one snippet while its statements are read in order."""

    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.tainted: dict[str, str] = {}
        self.guards: dict[str, str] = {}

    def source(self, var: str, line: int) -> None:
        node = f"src_{len(self.nodes)}"
        self.nodes.append({"node_id": node, "kind": "source", "target_var": var, "lineno": line})
        self.tainted[var] = node
        self.guards.pop(var, None)

    def assign(self, var: str, names: list[str]) -> None:
        """A new value clears guards and carries taint over."""
        self.guards.pop(var, None)
        origin = next((self.tainted[n] for n in names if n in self.tainted), None)
        if origin:
            self.tainted[var] = origin
        else:
            self.tainted.pop(var, None)

    def sink(self, kind: str, names: list[str], line: int) -> None:
        used = list(dict.fromkeys(n for n in names if n in self.tainted))
        node = f"sink_{len(self.nodes)}"
        self.nodes.append({"node_id": node, "kind": "sink", "target_var": used[0] if used else (names[0] if names else None), "lineno": line})
        for var in used:
            guard = self.guards.get(var)
            self.edges.append({"source_id": self.tainted[var], "sink_id": node, "source_type": "UNTRUSTED_INPUT", "sink_type": kind, "sanitizer_type": guard, "guarded_target": var if guard else None})


def _python_flow(tree: ast.AST) -> _Flow:
    flow = _Flow()
    names = lambda n: [x.id for x in ast.walk(n) if isinstance(x, ast.Name)]

    def expression(node: ast.AST) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                called = x.func.id if isinstance(x.func, ast.Name) else getattr(x.func, "attr", "")
                if called in _SINK_CALLS:
                    flow.sink(_SINK_CALLS[called], [n for a in x.args for n in names(a)], x.lineno)
            elif isinstance(x, ast.Subscript):
                flow.sink("ARRAY_INDEX", names(x.slice), x.lineno)
            elif isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name):
                flow.sink("POINTER_DEREF", [x.value.id], x.lineno)

    def guards(test: ast.AST) -> dict[str, str]:
        out = {}
        for x in ast.walk(test):
            if isinstance(x, ast.Compare):
                kinds = {type(op) for op in x.ops}
                kind = "NULL_CHECK" if kinds & {ast.Is, ast.IsNot} else "ALLOWLIST_CHECK" if kinds & {ast.In, ast.NotIn} else "BOUNDS_CHECK" if kinds & {ast.Lt, ast.LtE, ast.Gt, ast.GtE} else None
                if kind:
                    out |= dict.fromkeys(names(x), kind)
        return out

    def block(body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                for a in [*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs]:
                    if a.arg not in ("self", "cls"):
                        flow.source(a.arg, s.lineno)
                block(s.body)
            elif isinstance(s, ast.ClassDef):
                block(s.body)
            elif isinstance(s, (ast.If, ast.While)):
                expression(s.test)
                found = guards(s.test)
                leaves = s.body and isinstance(s.body[-1], (ast.Return, ast.Raise, ast.Continue, ast.Break))
                before = dict(flow.guards)
                flow.guards |= found
                block(s.body)
                flow.guards = before
                block(s.orelse)
                if leaves:
                    flow.guards |= found
            elif isinstance(s, ast.Assert):
                flow.guards |= guards(s.test)
            elif isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                if s.value is not None:
                    expression(s.value)
                    called = [getattr(x.func, "id", getattr(x.func, "attr", "")) for x in ast.walk(s.value) if isinstance(x, ast.Call)]
                    for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                        if isinstance(t, ast.Name):
                            if set(called) & _INPUT_CALLS:
                                flow.source(t.id, s.lineno)
                            else:
                                flow.assign(t.id, names(s.value))
                        else:
                            expression(t)
            else:
                for field in ("body", "orelse", "finalbody"):
                    block([x for x in getattr(s, field, []) if isinstance(x, ast.stmt)])
                for x in ast.iter_child_nodes(s):
                    if isinstance(x, ast.expr):
                        expression(x)

    block(getattr(tree, "body", []))
    return flow


_C_NAME = r"[A-Za-z_]\w*"
_C_WORDS = {"if", "for", "while", "switch", "return", "sizeof", "else", "do", "case", "int", "char", "void", "struct", "const", "unsigned", "size_t", "long", "short", "NULL"}


def _c_names(text: str) -> list[str]:
    plain = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'', " ", text)
    return [n for n in re.findall(_C_NAME, plain) if n not in _C_WORDS]


def _closing(text: str, at: int) -> int:
    """Where the parenthesis at `at` is closed; the end if it is not."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if not depth:
            return k
    return len(text)


def _c_flow(code: str) -> _Flow:
    """A statement-wise reading of C-like text."""
    flow = _Flow()
    plain = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), code, flags=re.S)
    head = re.search(rf"{_C_NAME}\s*\(([^()]*)\)\s*\{{", plain)
    if head:
        line = plain.count("\n", 0, head.start()) + 1
        for p in head[1].split(","):
            if found := re.findall(_C_NAME, p):
                if found[-1] not in _C_WORDS:
                    flow.source(found[-1], line)
        plain = plain[: head.start()] + "\n" * plain.count("\n", head.start(), head.end()) + plain[head.end() :]
    line = 1
    for piece in re.split(r"([;{}])", plain):
        line += piece.count("\n")
        s = piece.strip()
        if m := re.match(r"(?:else\s+)?(if|while|for)\s*\(", s):
            end = _closing(s, m.end() - 1)
            test = s[m.end() : end]
            if null := re.findall(rf"!\s*({_C_NAME})|({_C_NAME})\s*[!=]=\s*NULL", test):
                flow.guards |= dict.fromkeys([a or b for a, b in null], "NULL_CHECK")
            if re.search(r"[<>]", re.sub(r"->|<<|>>", " ", test)):
                flow.guards |= {n: "BOUNDS_CHECK" for n in _c_names(test) if flow.guards.get(n) != "NULL_CHECK"}
            s = s[end + 1 :]
        for call, args in re.findall(rf"({_C_NAME})\s*\(([^;]*)\)", s):
            if call in _SINK_CALLS:
                flow.sink(_SINK_CALLS[call], _c_names(args), line)
        for index in re.findall(rf"{_C_NAME}\s*\[([^\]]+)\]", s):
            flow.sink("ARRAY_INDEX", _c_names(index), line)
        for name in re.findall(rf"({_C_NAME})\s*->|(?:^|[=(,;]\s*)\*\s*({_C_NAME})", s):
            flow.sink("POINTER_DEREF", [name[0] or name[1]], line)
        if m := re.match(rf"(?:[\w\s*]*?\b)?({_C_NAME})\s*=(?!=)(.*)", s, re.S):
            if any(c in _INPUT_CALLS for c in re.findall(rf"({_C_NAME})\s*\(", m[2])):
                flow.source(m[1], line)
            else:
                flow.assign(m[1], _c_names(m[2]))
    return flow


def flow_graph(code: str | None) -> dict:
    """is_complete, parse_error, nodes and edges of a snippet: as Python if it parses, else as C-like text; unbalanced text is incomplete."""
    text = code or ""
    try:
        flow = _python_flow(ast.parse(text))
        error = None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        balanced = all(text.count(a) == text.count(b) for a, b in ("()", "[]", "{}"))
        looks_c = bool(re.search(r"[;{}]", text))
        flow = _c_flow(text) if balanced and looks_c else _Flow()
        error = None if balanced and looks_c else "unbalanced" if looks_c else "not code"
    return {"is_complete": error is None and bool(text.strip()), "parse_error": error, "nodes": flow.nodes, "edges": [{"edge_no": k} | e for k, e in enumerate(flow.edges)]}


_GRAPH = (
    "is_complete boolean, parse_error string, nodes array<struct<node_id:string,kind:string,target_var:string,lineno:int>>, "
    "edges array<struct<edge_no:int,source_id:string,sink_id:string,source_type:string,sink_type:string,sanitizer_type:string,guarded_target:string>>"
)


def flow_graph_col(x: Column | str) -> Column:
    @F.pandas_udf(_GRAPH)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([flow_graph(v) for v in values], columns=["is_complete", "parse_error", "nodes", "edges"])

    return run(x)
