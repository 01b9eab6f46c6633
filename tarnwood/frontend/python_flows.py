"""Python sources: functions, calls, and taint from sources to sinks, with summaries that carry flows over calls and files.

A file is parsed and run abstractly once, in a task; what leaves it are summaries and local findings. Flows through calls are found by
joins: a summary says which parameters reach a sink and which reach the return value, and a driver loop composes summaries along
calls until none is new. Values map what they depend on (a source's line, or a parameter) to the capability bits still dangerous in them.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.findings import BIT
from ..plans.storage import cut

ALL = (1 << 21) - 1
#: What user data enters through, by dotted suffix.
SOURCES = ("os.getenv", "os.environ", "request.args", "request.form", "request.json", "request.headers", "request.cookies", "request.values", "request.data", "request.GET", "request.POST", "request.get_json", "sys.argv", "input")
#: Callee suffix, capability, arguments that matter (all if empty).
SINKS = {
    "os.system": ("CODE_EXEC", (0,)), "os.popen": ("CODE_EXEC", (0,)), "subprocess.call": ("CODE_EXEC", (0,)), "subprocess.run": ("CODE_EXEC", (0,)), "subprocess.Popen": ("CODE_EXEC", (0,)), "subprocess.check_output": ("CODE_EXEC", (0,)),
    "eval": ("CODE_EXEC", (0,)), "exec": ("CODE_EXEC", (0,)), "execute": ("SQL_QUERY", (0,)), "executescript": ("SQL_QUERY", (0,)), "open": ("FILE_IO", (0,)), "requests.get": ("SSRF", (0,)), "requests.post": ("SSRF", (0,)), "urlopen": ("SSRF", (0,)),
    "pickle.loads": ("DESERIALIZE", (0,)), "yaml.load": ("DESERIALIZE", (0,)), "render_template_string": ("SSTI", (0,)), "redirect": ("OPEN_REDIRECT", (0,)), "Markup": ("HTML_ESCAPE", (0,)), "make_response": ("HTML_ESCAPE", (0,)),
}
#: Callee suffix and what it makes safe.
SANITIZERS = {"shlex.quote": BIT["CODE_EXEC"] | BIT["SHELL_ESCAPE"], "html.escape": BIT["HTML_ESCAPE"], "escape": BIT["HTML_ESCAPE"], "int": ALL, "float": ALL, "bool": ALL, "len": ALL, "secure_filename": BIT["FILE_IO"], "url_for": BIT["OPEN_REDIRECT"]}


def dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value)}.{node.attr}"
    if isinstance(node, ast.Call):
        return dotted(node.func)
    return node.id if isinstance(node, ast.Name) else ""


def lookup(name: str, table):
    for m in table:
        if name == m or name.endswith("." + m):
            return m
    return None


class Body:
    """Runs one function abstractly, branch by branch; values are {label: bits}."""

    def __init__(self, params: list[str]):
        self.env: dict[str, dict[str, int]] = {p: {f"p{i}": ALL} for i, p in enumerate(params)}
        self.sinks: set[tuple] = set()  # (line, callee, cap bits, label)
        self.calls: set[tuple] = set()  # (line, callee, arity, argument, label, bits)
        self.returns: dict[str, int] = {}

    @staticmethod
    def merge(*values: dict[str, int]) -> dict[str, int]:
        out: dict[str, int] = {}
        for v in values:
            for k, b in v.items():
                out[k] = out.get(k, 0) | b
        return out

    def value(self, e: ast.AST | None) -> dict[str, int]:
        if e is None or isinstance(e, ast.Constant):
            return {}
        name = dotted(e) if isinstance(e, ast.Name | ast.Attribute | ast.Call) else ""
        if isinstance(e, ast.Call):
            return self.call(e, name)
        if name and lookup(name, SOURCES):
            return {f"s{e.lineno}": ALL}
        if isinstance(e, ast.Name):
            return self.env.get(e.id, {})
        if isinstance(e, ast.Attribute):
            return self.env[name] if name in self.env else self.value(e.value)
        if isinstance(e, ast.Lambda):
            return self.value(e.body)
        if isinstance(e, ast.ListComp | ast.SetComp | ast.GeneratorExp | ast.DictComp):
            for g in e.generators:
                self.assign(g.target, self.value(g.iter))
        if isinstance(e, ast.Compare):
            return {}
        return self.merge(*[self.value(c) for c in ast.iter_child_nodes(e) if isinstance(c, ast.expr)])

    def call(self, e: ast.Call, name: str) -> dict[str, int]:
        args = [*e.args, *[k.value for k in e.keywords]]
        values = [self.value(a) for a in args]
        receiver = self.value(e.func.value) if isinstance(e.func, ast.Attribute) else {}
        if (m := lookup(name, SINKS)) and not (m in ("subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output") and e.args and isinstance(e.args[0], ast.List)):
            cap = BIT[SINKS[m][0]]
            for i in SINKS[m][1]:
                if i < len(values):
                    self.sinks |= {(e.lineno, m, cap, label) for label, bits in values[i].items() if bits & cap}
        if lookup(name, SOURCES) and not name.startswith("self."):
            return {f"s{e.lineno}": ALL}
        if m := lookup(name, SANITIZERS):
            return {k: b for k, v in self.merge(*values).items() if (b := v & ~SANITIZERS[m])}
        if name and not lookup(name, SINKS):
            for i, v in enumerate(values[: len(e.args)]):
                self.calls |= {(e.lineno, name.rsplit(".", 1)[-1], len(e.args), i, label, bits) for label, bits in v.items()}
        out = self.merge(receiver, *values)
        if isinstance(e.func, ast.Attribute) and e.func.attr in ("append", "add", "update", "extend", "insert", "setdefault") and isinstance(e.func.value, ast.Name):
            self.env[e.func.value.id] = self.merge(self.env.get(e.func.value.id, {}), *values)
        return out

    def assign(self, target: ast.AST, value: dict[str, int]) -> None:
        if isinstance(target, ast.Name):
            self.env[target.id] = value
        elif isinstance(target, ast.Attribute):
            self.env[dotted(target)] = value
        elif isinstance(target, ast.Subscript) and (base := dotted(target.value)):
            self.env[base] = self.merge(self.env.get(base, {}), value)
        elif isinstance(target, ast.Tuple | ast.List | ast.Starred):
            for t in ast.iter_child_nodes(target):
                self.assign(t, value)

    def run(self, body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            if isinstance(s, ast.Assign):
                if len(s.targets) == 1 and isinstance(s.targets[0], ast.Tuple) and isinstance(s.value, ast.Tuple) and len(s.targets[0].elts) == len(s.value.elts):
                    for t, v in zip(s.targets[0].elts, [self.value(v) for v in s.value.elts], strict=True):
                        self.assign(t, v)
                else:
                    v = self.value(s.value)
                    for t in s.targets:
                        self.assign(t, v)
            elif isinstance(s, ast.AnnAssign):
                self.assign(s.target, self.value(s.value))
            elif isinstance(s, ast.AugAssign):
                self.assign(s.target, self.merge(self.value(s.target), self.value(s.value)))
            elif isinstance(s, ast.Return):
                self.returns = self.merge(self.returns, self.value(s.value))
            elif isinstance(s, ast.If):
                self.value(s.test)
                self.branches([s.body, s.orelse])
            elif isinstance(s, ast.For | ast.AsyncFor | ast.While):
                for _ in range(2):  # a second round carries what the first one assigned
                    if isinstance(s, ast.While):
                        self.value(s.test)
                    else:
                        self.assign(s.target, self.value(s.iter))
                    self.branches([s.body, []])
                self.run(s.orelse)
            elif isinstance(s, ast.With | ast.AsyncWith):
                for i in s.items:
                    v = self.value(i.context_expr)
                    if i.optional_vars is not None:
                        self.assign(i.optional_vars, v)
                self.run(s.body)
            elif isinstance(s, ast.Try):
                self.run(s.body)
                self.branches([h.body for h in s.handlers] + [[]])
                self.run(s.orelse)
                self.run(s.finalbody)
            elif isinstance(s, ast.Match):
                self.value(s.subject)
                self.branches([c.body for c in s.cases] + [[]])
            else:
                for c in ast.iter_child_nodes(s):
                    if isinstance(c, ast.expr):
                        self.value(c)

    def branches(self, bodies: list[list[ast.stmt]]) -> None:
        before, after = self.env, []
        for b in bodies:
            self.env = dict(before)
            self.run(b)
            after.append(self.env)
        self.env = {k: self.merge(*[e.get(k, {}) for e in after]) for k in set().union(*after)}


_FACTS = "path string, status string, function string, arity int, kind string, line int, callee string, argument int, label string, bits long"


def facts_of(path: str, content: bytes) -> list[tuple]:
    """Rows of kind function, sink, call and return. A file that can't be parsed is one row with its status."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(path, type(e).__name__, None, None, "file", 0, None, None, None, None)]
    rows = []
    for node in [tree, *(n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef))]:
        name = getattr(node, "name", "<module>")
        params = [a.arg for a in (*node.args.posonlyargs, *node.args.args) if a.arg not in ("self", "cls")] if name != "<module>" else []
        body = Body(params)
        try:
            body.run(node.body)
        except RecursionError:
            rows.append((path, "TooDeep", name, len(params), "file", 0, None, None, None, None))
            continue
        n = len(params)
        rows.append((path, "ok", name, n, "function", getattr(node, "lineno", 0), None, None, None, None))
        rows += [(path, "ok", name, n, "sink", line, callee, None, label, cap) for line, callee, cap, label in sorted(body.sinks)]
        rows += [(path, "ok", name, n, "call", line, callee, i, f"{label}/{k}", bits) for line, callee, k, i, label, bits in sorted(body.calls)]
        rows += [(path, "ok", name, n, "return", getattr(node, "lineno", 0), None, None, label, bits) for label, bits in sorted(body.returns.items())]
    return rows


def facts(files: DataFrame) -> DataFrame:
    """files (path, content) -> one row for each fact; every file is parsed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b.path, b.content, strict=True) for r in facts_of(p, bytes(c))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _FACTS.split(", ")]).astype({"arity": "Int32", "line": "Int32", "argument": "Int32", "bits": "Int64"})

    return files.select("path", "content").mapInPandas(run, _FACTS)


def findings(files: DataFrame, rounds: int = 64) -> DataFrame:
    """path, line, function, cap, source_line, hops: local flows, and flows that end in a callee's sink, in this file or another.

    A callee is the function of that name and arity; of several, the one in the same file, else none if the name is ambiguous.
    """
    f = cut(facts(files).where("status = 'ok'"))
    own = f.where("kind = 'function'").select(F.col("path").alias("f_path"), F.col("function").alias("name"), F.col("arity").alias("k"))
    calls = f.where("kind = 'call'").select("path", "function", "line", "argument", F.substring_index("label", "/", 1).alias("label"), "bits", F.col("callee").alias("name"), F.substring_index("label", "/", -1).cast("int").alias("k"))
    c = calls.join(own, ["name", "k"])
    site = ["path", "function", "line", "argument", "label", "name"]
    pick = c.groupBy(*site, "bits").agg(F.max((F.col("f_path") == F.col("path")).cast("int")).alias("here"), F.count_distinct("f_path").alias("n"), F.min("f_path").alias("one"))
    edges = cut(pick.where("here = 1 OR n = 1").select(*site, "bits", F.when(F.col("here") == 1, F.col("path")).otherwise(F.col("one")).alias("f_path")))
    sinks = f.where("kind = 'sink'").select("path", "function", "line", "label", "bits", F.lit(0).alias("hops"))
    seen = cut(sinks)
    new, n = seen, 0
    while n < rounds:
        n += 1
        through = new.where("label LIKE 'p%'").select(F.col("path").alias("f_path"), F.col("function").alias("name"), F.substring("label", 2, 9).cast("int").alias("argument"), F.col("bits").alias("cap"), "hops")
        up = edges.join(through, ["f_path", "name", "argument"]).where(F.col("bits").bitwiseAND(F.col("cap")) != 0)
        up = up.groupBy("path", "function", "line", "label", F.col("cap").alias("bits")).agg((F.min("hops") + 1).alias("hops"))
        new = cut(up.join(seen.select("path", "function", "line", "label", "bits"), ["path", "function", "line", "label", "bits"], "left_anti"))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
    return seen.where("label LIKE 's%'").select("path", "line", "function", F.col("bits").alias("cap"), F.substring("label", 2, 9).cast("int").alias("source_line"), "hops")
