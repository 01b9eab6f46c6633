"""Module graph and import resolution: specifiers to files by equi-joins on candidate paths, ancestors and prefixes.

Tables
    files      path
    packages   root, name, main (null: none), closed (the manifest has `exports`)
    exports    root, nth, key, target: one row for each subpath key, conditions already chosen; a null target blocks
    aliases    config (path of the configuration file), base, nth, prefix, wildcard, targets (in order)
    imports    file, spec, and what else the caller carries

Files are indexed by the paths under which an import may name them, so that each candidate is one equi-join. Enclosing packages and configurations are found by joining a folder's
ancestors with their roots, the longest wins; aliases by joining the prefixes of a specifier with those of the patterns. Work is done once for each folder and specifier: these and the
index of the files are kept in the shared folder, so imports are passed over twice, to find them and to give each its verdict.

Order: builtin, relative, alias (if a target exists), package, else unresolved. Defined cases: empty and null specifiers have no kind; paths that leave the root match nothing;
a folder or specifier that a third of the imports share is joined by sort and merge, which the adaptive skew join parts;
of packages with one name the one with the shortest root counts (ties: the first root); outside of every configuration's folder all configurations are tried, longest path first.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import packed

#: Extensions that an import may leave out, in the order of their trial, and those tried for a specifier that names a script (fixed values).
EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
SCRIPT, TYPED = ("js", "jsx", "mjs", "cjs"), ("ts", "tsx", "mts", "cts")
#: Modules that come with the runtime (fixed values).
BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "fs/promises", "http", "http2", "https", "inspector", "module", "net", "os", "path",
    "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "stream/promises", "stream/web", "string_decoder", "sys", "timers", "timers/promises", "tls", "trace_events", "tty", "url", "util", "util/types", "v8", "vm", "wasi",
    "worker_threads", "zlib",
)
#: Conditions of an export, the first present one counts (fixed values).
CONDITIONS = ("import", "node", "default", "require")


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def normal(path: Column) -> Column:
    """path without '.', '..' and empty segments; null where it leaves the root."""
    step = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when(done.isNull() | (s == "") | (s == "."), done).when(s != "..", F.concat(done, F.array(s))).when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)),
    )
    return F.array_join(step, "/")


def ancestors(folder_: Column) -> Column:
    """The folder and all above it, the root '' included."""
    parts = F.split(folder_, "/")
    n = F.when(folder_ == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def targets(files: DataFrame) -> DataFrame:
    """(candidate, target): the file that each importable path names. One row a path; a file stands under eight paths at most."""
    path = F.col("path")
    stem, ext = F.regexp_extract(path, r"^(.*[^/])\.([^./]+)$", 1), F.regexp_extract(path, r"^(.*[^/])\.([^./]+)$", 2)
    nth = F.array_position(F.array(*map(F.lit, EXTENSIONS)), ext).cast("int")
    typed = F.array_position(F.array(*map(F.lit, TYPED)), ext).cast("int")
    inside = F.regexp_extract(path, r"^(?:(.*)/)?index\.[^./]+$", 1)
    is_index = path.rlike(r"(^|/)index\.[^./]+$")

    def name(candidate: Column, rank: Column, when: Column) -> Column:
        return F.when(when, F.struct(candidate.alias("candidate"), rank.cast("int").alias("rank")))

    own = [name(path, F.lit(0), F.lit(True)), name(stem, nth, nth > 0), *[name(F.concat(stem, F.lit("." + s)), typed + 10, typed > 0) for s in SCRIPT], name(inside, nth + 20, is_index & (nth > 0))]
    rows = files.select("path").distinct().select("path", F.explode(F.array_compact(F.array(*own))).alias("t"))
    return rows.groupBy("t.candidate").agg(F.min(F.struct("t.rank", "path"))["path"].alias("target"))


def enclosing(folders: DataFrame, roots: DataFrame, *values: str) -> DataFrame:
    """For each distinct folder the values of the longest root that is an ancestor; roots has one row a root."""
    up = folders.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("root"))
    hit = up.join(roots.select("root", *values), "root")
    return hit.groupBy("folder").agg(F.max(F.struct(F.length("root").alias("n"), "root", *values)).alias("e")).select("folder", "e.root", *[F.col("e")[v].alias(v) for v in values])


def named_packages(packages: DataFrame) -> DataFrame:
    """One package a name."""
    first = F.min(F.struct(F.length("root").alias("n"), "root", "main", "closed"))
    return packages.groupBy("name").agg(first.alias("p")).select("name", "p.root", "p.main", "p.closed")


def package_candidates(specs: DataFrame, packages: DataFrame, exports: DataFrame) -> DataFrame:
    """(spec, name, candidate) of the specifiers that name a known package; a closed package that exports no such path has a null candidate."""
    spec = F.col("spec")
    whole = F.when(spec.startswith("@"), F.regexp_extract(spec, "^(@[^/]*/[^/]*)(?:/(.*))?$", 1)).otherwise(F.regexp_extract(spec, "^([^/]*)(?:/(.*))?$", 1))
    sub = F.when(spec.startswith("@"), F.regexp_extract(spec, "(?s)^(@[^/]*/[^/]*)(?:/(.*))?$", 2)).otherwise(F.regexp_extract(spec, "(?s)^([^/]*)(?:/(.*))?$", 2))
    asked = specs.select("spec", whole.alias("name"), sub.alias("sub")).join(named_packages(packages), "name")
    asked = asked.withColumn("wanted", F.when(F.col("sub") == "", ".").when(F.col("sub").startswith("./"), F.col("sub")).otherwise(F.concat(F.lit("./"), "sub")))
    e = exports.where("target IS NOT NULL").select(F.col("root").alias("e_root"), "nth", "key", "target")
    before, after = F.regexp_extract("key", r"(?s)^([^*]*)\*(.*)$", 1), F.regexp_extract("key", r"(?s)^([^*]*)\*(.*)$", 2)
    fits = F.col("key").contains("*") & F.expr("startswith(wanted, substring_index(key, '*', 1))") & F.endswith("wanted", after) & (F.length("wanted") >= F.length("key") - 1)
    matched = asked.where("closed").join(e, (F.col("root") == F.col("e_root")) & ((F.col("key") == F.col("wanted")) | fits))
    inner = F.expr("substring(wanted, length(substring_index(key, '*', 1)) + 1, length(wanted) - length(key) + 1)")
    given = F.when(F.col("key") == F.col("wanted"), F.col("target")).otherwise(F.replace("target", F.lit("*"), inner))
    first = matched.groupBy("spec").agg(F.min(F.struct((F.col("key") != F.col("wanted")).alias("by_pattern"), "nth", given.alias("given")))["given"].alias("given"))
    out = asked.join(first, "spec", "left")
    path = (
        F.when(F.col("closed"), F.regexp_replace("given", r"^(\./)+", ""))
        .when(F.col("sub") == "", F.coalesce("main", F.lit("index")))
        .otherwise(F.col("sub"))
    )
    return out.select("spec", "name", normal(F.concat_ws("/", "root", F.when(path.isNotNull(), path).otherwise(F.lit("../" * 64)))).alias("candidate"))


def alias_candidates(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """(folder, spec, order, candidate) for each alias pattern that matches, in a configuration around the folder; all configurations where there is none."""
    a = aliases.withColumn("a_root", folder(F.col("config")))
    known = a.select("prefix").distinct()
    spec = F.col("spec")
    heads = asked.select("spec").distinct().select("spec", F.explode(F.transform(F.sequence(F.lit(0), F.length(spec)), lambda n: F.substring(spec, F.lit(1), n))).alias("prefix"))
    heads = heads.join(known, "prefix", "left_semi")
    within = enclosing(asked, a.select(F.col("a_root").alias("root")).distinct()).select("folder")
    pairs = asked.join(heads, "spec")
    near = pairs.join(within, "folder").select("folder", "spec", "prefix", F.explode(ancestors(F.col("folder"))).alias("a_root")).join(a, ["a_root", "prefix"])
    outside = asked.join(within, "folder", "left_anti")
    far = outside.join(heads.join(a, "prefix"), "spec")
    rows = near.select("folder", *(cols := ["spec", "prefix", "config", "base", "nth", "wildcard", "targets"])).unionByName(far.select("folder", *cols))
    rows = rows.where(F.col("wildcard") | (spec == F.col("prefix"))).select("*", F.posexplode("targets").alias("at", "target"))
    rest = F.expr("substring(spec, length(prefix) + 1)")
    path = F.when(F.col("wildcard"), F.replace("target", F.lit("*"), rest)).otherwise(F.col("target"))
    order = F.struct((-F.length("config")).alias("n"), "config", "nth", "at")
    return rows.select("folder", "spec", order.alias("order"), normal(F.concat_ws("/", "base", path)).alias("candidate"))


def resolve(imports: DataFrame, files: DataFrame, packages: DataFrame, exports: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports with kind, resolved (a file or null) and package (of the file, or the one named)."""
    spec = F.col("spec")
    rows = imports.withColumn("folder", folder(F.col("file")))
    asked = packed(rows.where(F.length(spec) > 0).select("folder", "spec").distinct())
    builtin = F.regexp_replace(spec, "^node:", "").isin(*BUILTINS)
    relative = spec.rlike(r"^\.\.?(/|$)")
    # a builtin is no path
    local = asked.where(~builtin & relative).select("folder", "spec", normal(F.concat_ws("/", "folder", "spec")).alias("candidate"))
    other = asked.where(~builtin & ~relative)
    index = packed(targets(files))
    found_local = local.join(index, "candidate").select("folder", "spec", "target")
    found_alias = alias_candidates(other, aliases).join(index, "candidate").groupBy("folder", "spec").agg(F.min(F.struct("order", "target"))["target"].alias("target"))
    by_name = package_candidates(other.select("spec").distinct(), packages, exports)
    by_name = by_name.join(index, "candidate", "left").select("spec", F.col("name").alias("by_name"), F.col("target").alias("by_target"))
    both = found_local.unionByName(found_alias)
    owner = enclosing(both.select(folder(F.col("target")).alias("folder")), packages, "name").select(F.col("folder").alias("t_folder"), F.col("name").alias("owner"))
    owned = both.withColumn("t_folder", folder(F.col("target"))).join(owner, "t_folder", "left").drop("t_folder")
    all_ = asked.join(owned, ["folder", "spec"], "left").join(by_name, "spec", "left")
    named = F.col("by_name").isNotNull() & ~builtin & ~relative
    kind = F.when(builtin, "builtin").when(relative, "relative").when(F.col("target").isNotNull(), "alias").when(named, "package").otherwise("unresolved")
    verdict = all_.select("folder", "spec", kind.alias("kind"), F.when(~builtin, F.coalesce("target", F.when(named, F.col("by_target")))).alias("resolved"), F.when(F.col("target").isNotNull(), F.col("owner")).when(named, F.col("by_name")).alias("package"))
    return rows.join(verdict, ["folder", "spec"], "left").select(*imports.columns, "kind", "resolved", "package")


def namespace(resolved: Column, package: Column) -> Column:
    """A file's namespace: package and path, or the path alone."""
    return F.when(package.isNotNull(), F.concat(package, F.lit("::"), resolved)).otherwise(resolved)


def function_keys(bindings: DataFrame, packages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """file, local, lang, namespace, name of the functions that resolved import bindings (file, local, exported, resolved) stand for.

    Side effects, default and whole-module bindings name no function. The last of several bindings with one local name (largest `nth`) counts. Where the files (path) are given, owners are
    found for their folders, else for those of the last bindings; these are kept in the shared folder then, and bindings are passed over once either way.
    """
    named = bindings.where(F.col("resolved").isNotNull() & F.col("exported").isNotNull() & ~F.col("exported").isin("", "*", "default") & (F.col("local") != ""))
    ext = F.regexp_extract("resolved", r"\.([^./]+)$", 1)
    lang = F.when(ext.isin("ts", "tsx", "mts", "cts"), "typescript").when(ext.isin("js", "jsx", "mjs", "cjs"), "javascript").otherwise(F.col("lang"))
    last = named.groupBy("file", "local").agg(F.max_by(F.struct("resolved", "exported", "lang"), F.col("nth")).alias("k")).select("file", "local", "k.*")
    last = packed(last) if files is None else last
    folders = last.select(folder(F.col("resolved")).alias("folder")) if files is None else files.select(folder(F.col("path")).alias("folder"))
    owner = enclosing(folders, packages, "name").select("folder", F.col("name").alias("owner"))
    keyed = last.withColumn("folder", folder(F.col("resolved"))).join(owner, "folder", "left")
    return keyed.select("file", "local", lang.alias("lang"), namespace(F.col("resolved"), F.col("owner")).alias("namespace"), F.col("exported").alias("name"))


_SHIELD = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
_COMMA = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[\]}])', re.S)


def _json(text: str | None):
    """JSON with comments and trailing commas; None for what isn't JSON."""
    try:
        return json.loads(_COMMA.sub(lambda m: m[1] or "", _SHIELD.sub(lambda m: m[1] or "", text or "")))
    except ValueError:
        return None


def _choose(value) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return next((t for c in CONDITIONS if c in value and (t := _choose(value[c])) is not None), None)
    if isinstance(value, list):
        return next((t for v in value if (t := _choose(v)) is not None), None)
    return None


_MANIFEST = "root string, name string, main string, closed boolean, nth int, key string, target string"
_CONFIG = "config string, base string, nth int, prefix string, wildcard boolean, targets array<string>"


def _manifests(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            root, m = path.rpartition("/")[0], _json(content)
            if not isinstance(m, dict) or not isinstance(m.get("name"), str):
                continue
            main = next((m[k] for k in ("main", "module", "types") if isinstance(m.get(k), str)), None)
            e = m.get("exports")
            subs = {".": e} if isinstance(e, str) else e if isinstance(e, dict) else {}
            rows.append((root, m["name"], main, "exports" in m, None, None, None))
            rows += [(root, None, None, None, i, k, _choose(subs[k])) for i, k in enumerate(sorted(subs))]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MANIFEST.split(", ")]).astype({"nth": "Int32"})


def _configs(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            m = _json(content)
            options = m.get("compilerOptions") if isinstance(m, dict) else None
            if not isinstance(options, dict):
                continue
            base = "/".join(x for x in (path.rpartition("/")[0], options.get("baseUrl") if isinstance(options.get("baseUrl"), str) else "") if x)
            paths = options.get("paths") if isinstance(options.get("paths"), dict) else {}
            for i, k in enumerate(sorted(paths)):
                to = [t for t in paths[k] if isinstance(t, str)] if isinstance(paths[k], list) else []
                if to:
                    rows.append((path, base, i, k.rstrip("*") if k.endswith("*") else k, k.endswith("*"), to))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CONFIG.split(", ")])


def module_graph(tree: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packages, exports, aliases) of a tree's manifests (path, content). Hidden folders and installed modules are left out; manifests without a name are no packages."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    own = tree.where(~F.col("path").rlike(r"(^|/)(\.[^/]*|node_modules)/"))
    m = own.where(name == "package.json").select("path", "content").mapInPandas(_manifests, _MANIFEST)
    c = own.where(name.isin("tsconfig.json", "jsconfig.json")).select("path", "content").mapInPandas(_configs, _CONFIG)
    return m.where("name IS NOT NULL").select("root", "name", "main", "closed"), m.where("key IS NOT NULL").select("root", "nth", "key", "target"), c
