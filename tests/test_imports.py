"""Import resolution against a resolver that walks one specifier at a time, on random trees."""

import posixpath
import random

from pyspark.sql import functions as F

from tarnwood.operators import imports as im


class Walk:
    """One specifier at a time, by trial."""

    def __init__(self, files, packages, exports, aliases):
        self.files, self.packages, self.exports, self.aliases = set(files), packages, exports, aliases

    def exists(self, path):
        if path is None or path.startswith(".."):
            return None
        stem, dot, ext = path.rpartition(".")
        tries = [path, *[f"{path}.{e}" for e in im.EXTENSIONS]]
        if dot and ext in im.SCRIPT and stem and not stem.endswith("/"):
            tries += [f"{stem}.{e}" for e in im.TYPED]
        tries += [f"{path}/index.{e}" if path else f"index.{e}" for e in im.EXTENSIONS]
        return next((t for t in tries if t in self.files), None)

    def normal(self, path):
        p = posixpath.normpath(path).lstrip("/") if path else ""
        return None if p.startswith("..") else "" if p == "." else p

    def owner(self, path):
        if path is None:
            return None
        inside = [p for p in self.packages if p[0] == "" or path.startswith(p[0] + "/")]
        return max(inside, key=lambda p: len(p[0]))[1] if inside else None

    def resolve(self, file, spec):
        if not spec:
            return None, None, None
        if spec.removeprefix("node:") in im.BUILTINS:
            return "builtin", None, None
        here = file.rpartition("/")[0]
        if spec in (".", "..") or spec.startswith(("./", "../")):
            hit = self.exists(self.normal(posixpath.join(here, spec)))
            return "relative", hit, self.owner(hit)
        near = [a for a in self.aliases if (here + "/").startswith(d + "/" if (d := a[0].rpartition("/")[0]) else "")] or self.aliases
        for _config, base, _, prefix, wild, targets in sorted(near, key=lambda a: (-len(a[0]), a[0], a[2])):
            if not (spec.startswith(prefix) if wild else spec == prefix):
                continue
            for t in targets:
                hit = self.exists(self.normal(posixpath.join(base, t.replace("*", spec[len(prefix) :]) if wild else t)))
                if hit:
                    return "alias", hit, self.owner(hit)
        parts = spec.split("/")
        if spec.startswith("@") and len(parts) < 2:
            return "unresolved", None, None
        k = 2 if spec.startswith("@") else 1
        name, sub = "/".join(parts[:k]), "/".join(parts[k:])
        same = [p for p in self.packages if p[1] == name]
        if not same:
            return "unresolved", None, None
        root, _, main, closed = min(same, key=lambda p: (len(p[0]), p[0]))
        if closed:
            key, target = "./" + sub if sub else ".", None
            mine = sorted((e for e in self.exports if e[0] == root and e[3] is not None), key=lambda e: e[1])
            for _, _, k, t in mine:
                if k == key:
                    target = t
            if target is None:
                for _, _, k, t in mine:
                    head, star, tail = k.partition("*")
                    if star and key.startswith(head) and key.endswith(tail) and len(key) >= len(head) + len(tail):
                        target = t.replace("*", key[len(head) : len(key) - len(tail)])
                        break
            if target is None:
                return "package", None, name
            rel = target.lstrip("./") if target.startswith("./") else target
        else:
            rel = sub or main or "index"
        return "package", self.exists(self.normal(posixpath.join(root, rel))), name


def tree(seed):
    r = random.Random(seed)
    dirs = ["", "a", "a/b", "a/b/c", "p", "p/src", "q", "q/lib/x"]
    files = {posixpath.join(r.choice(dirs), r.choice(["f", "g", "f.service", "index", "h.js"]) + "." + r.choice(["ts", "tsx", "js", "mjs", "json"])) for _ in range(25)} | {"a/b/f.ts"}
    packages = [("p", "pp", r.choice([None, "src/f", "./src/index.ts"]), False), ("q", "@s/q", None, True), ("a/b", "inner", "f", r.random() < 0.5), ("a", "pp", None, False)]
    exports = [("q", 0, ".", "./lib/x/f.ts"), ("q", 1, "./l/*", "./lib/x/*"), ("q", 2, "./l/g", None), ("q", 3, "./*.js", "./lib/x/*"), ("a/b", 0, "./in/*", "./c/*")]
    aliases = [("a/tsconfig.json", "a", 0, "@/", True, ["b/*", "b/c/*"]), ("a/b/tsconfig.json", "a/b", 0, "@/", True, ["c/*"]), ("a/b/tsconfig.json", "a/b", 1, "lib", False, ["f", "c/f"]), ("p/jsconfig.json", "p", 0, "~", True, ["src/*", "*"])]
    specs = ["./f", "./f.js", "../f", "..", ".", "./h.js", "./f.service", "@/f", "@/c/f", "lib", "~f", "~src/g", "pp", "pp/src/f", "pp/b/f", "@s/q", "@s/q/l/f", "@s/q/l/g", "@s/q/f.js", "@s/none", "@s", "inner", "inner/in/f", "fs", "node:fs/promises", "nothing", "../../../../f", "", "./", "./b//f", None]
    imports = [(f, s) for f in sorted(files) for s in specs]
    return sorted(files), packages, exports, aliases, imports


def test_against_one_at_a_time(spark):
    for seed in range(4):
        files, packages, exports, aliases, imports = tree(seed)
        walk = Walk(files, packages, exports, aliases)
        out = im.resolve(
            spark.createDataFrame([(f, s, "clash") for f, s in imports], "file string, spec string, target string"),
            spark.createDataFrame([(f,) for f in files], "path string"),
            spark.createDataFrame(packages, "root string, name string, main string, closed boolean"),
            spark.createDataFrame(exports, "root string, nth int, key string, target string"),
            spark.createDataFrame(aliases, "config string, base string, nth int, prefix string, wildcard boolean, targets array<string>"),
        )
        got = {(r.file, r.spec): (r.kind, r.resolved, r.package) for r in out.collect()}
        want = {(f, s): walk.resolve(f, s) for f, s in imports}
        assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)


def test_no_pairs_of_specifiers_and_packages(spark):
    """A join of every kind is by equality: no nested loop over specifiers and manifests."""
    files, packages, exports, aliases, imports = tree(1)
    out = im.resolve(
        spark.createDataFrame(imports, "file string, spec string"),
        spark.createDataFrame([(f,) for f in files], "path string"),
        spark.createDataFrame(packages, "root string, name string, main string, closed boolean"),
        spark.createDataFrame(exports, "root string, nth int, key string, target string"),
        spark.createDataFrame(aliases, "config string, base string, nth int, prefix string, wildcard boolean, targets array<string>"),
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_manifests(spark):
    tree_ = [
        ("a/package.json", '{ // c\n "name": "x", "types": "t.d.ts", "module": "m.mjs", "exports": {"node": 1, "./k": [null, {"require": "./r.cjs"}], "./u//v": "./w", }, }'),
        ("package.json", '{"name": "root", "exports": "./i.js"}'),
        ("b/package.json", "[1]"),
        ("b/tsconfig.json", '{"compilerOptions": {"paths": {"a*": ["s/*", 3], "e": []}}}'),
        ("node_modules/z/package.json", '{"name": "z"}'),
        ("c/package.json", None),
    ]
    packages, exports, aliases = im.module_graph(spark.createDataFrame(tree_, "path string, content string"))
    assert sorted(map(tuple, packages.collect())) == [("", "root", None, True), ("a", "x", "m.mjs", True)]
    assert sorted(((r.root, r.key, r.target) for r in exports.collect()), key=str) == [("", ".", "./i.js"), ("a", "./k", "./r.cjs"), ("a", "./u//v", "./w"), ("a", "node", None)]
    assert [tuple(r) for r in aliases.collect()] == [("b/tsconfig.json", "b", 0, "a", True, ["s/*"])]


def test_imports_are_passed_over_twice(spark):
    """Whatever the steps of the resolution are: once for the distinct folders and specifiers, once for the verdicts."""
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            passed.add(len(b))
            yield b

    files = ["p/src/a.ts", "p/src/b.ts", "q/index.js"] * 3
    rows = [("p/src/a.ts", i, f"v{i % 2}", "g", s) for i, s in enumerate(["./b", "q", "@/b", "fs", "../../.."] * 4)]
    imports = spark.createDataFrame(rows, "file string, nth int, local string, exported string, spec string").mapInPandas(counted, "file string, nth int, local string, exported string, spec string")
    packages = spark.createDataFrame([("p", "p", None, False), ("q", "q", None, False)], "root string, name string, main string, closed boolean")
    exports = spark.createDataFrame([], "root string, nth int, key string, target string")
    aliases = spark.createDataFrame([("p/tsconfig.json", "p/src", 0, "@/", True, ["*"])], "config string, base string, nth int, prefix string, wildcard boolean, targets array<string>")
    paths = spark.createDataFrame([(f,) for f in files], "path string")
    bound = im.resolve(imports, paths, packages, exports, aliases).withColumn("lang", F.lit("javascript"))
    want = [("p/src/a.ts", "v0", "javascript", "q::q/index.js", "g"), ("p/src/a.ts", "v1", "typescript", "p::p/src/b.ts", "g")]
    assert sorted(map(tuple, im.function_keys(bound, packages, paths).collect())) == want
    assert passed.value <= 2 * len(rows)
    assert sorted(map(tuple, im.function_keys(bound, packages).collect())) == want
    assert passed.value <= 3 * len(rows)
