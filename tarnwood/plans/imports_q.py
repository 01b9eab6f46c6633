"""Queries on the module graph. Their oracles try every prefix and every candidate in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imports as im
from .registry import query

# what a file may be called, in the order of trial
_TRIALS = "(SELECT '' AS cut, '' AS ext, 0 AS n UNION ALL SELECT '', '.ts', 1 UNION ALL SELECT '', '.tsx', 2 UNION ALL SELECT '', '.mts', 3 UNION ALL SELECT '', '.cts', 4 UNION ALL SELECT '', '.js', 5 UNION ALL SELECT '', '.jsx', 6 UNION ALL SELECT '', '.mjs', 7 UNION ALL SELECT '', '.cjs', 8" + "".join(
    f" UNION ALL SELECT '.{s}', '.{t}', {10 + i}" for s in im.SCRIPT for i, t in enumerate(im.TYPED)
) + "".join(f" UNION ALL SELECT '', '/index.{e}', {20 + i}" for i, e in enumerate(im.EXTENSIONS)) + ")"


def _norm(path: str) -> str:
    """A path without its dots; '!' where it leaves the root."""
    return f"""ltrim(list_reduce(list_prepend('', string_split({path}, '/')), lambda done, s: CASE WHEN done = '!' OR s IN ('', '.') THEN done WHEN s <> '..' THEN done || '/' || s WHEN done = '' THEN '!' ELSE regexp_replace(done, '/[^/]*$', '') END), '/')"""


_PAIRS = f"""asked AS (SELECT DISTINCT regexp_replace(file, '/[^/]*$', '') AS dir, spec FROM mod_imports),
  split AS (SELECT DISTINCT spec, CASE WHEN spec[1] = '@' THEN array_to_string(string_split(spec, '/')[1:2], '/') ELSE string_split(spec, '/')[1] END AS name,
    array_to_string(CASE WHEN spec[1] = '@' THEN string_split(spec, '/')[3:] ELSE string_split(spec, '/')[2:] END, '/') AS sub FROM asked),
  byname AS (SELECT name, arg_min(struct_pack(root := root, main := main, closed := closed), (length(root), root)) AS p FROM mod_packages GROUP BY name),
  want AS (SELECT spec, s.name, p.root AS root, p.main AS main, p.closed AS closed, sub, CASE WHEN sub = '' THEN '.' ELSE './' || sub END AS key FROM split s JOIN byname b ON b.name = s.name),
  given AS (SELECT w.spec, arg_min(CASE WHEN e.key = w.key THEN e.target ELSE replace(e.target, '*', w.key[length(split_part(e.key, '*', 1)) + 1 : length(w.key) - length(split_part(e.key, '*', 2))]) END, (e.key <> w.key, e.nth)) AS target
    FROM want w JOIN mod_exports e ON e.root = w.root WHERE w.closed AND e.target IS NOT NULL AND (e.key = w.key OR (contains(e.key, '*') AND starts_with(w.key, split_part(e.key, '*', 1)) AND ends_with(w.key, split_part(e.key, '*', 2)) AND length(w.key) >= length(e.key) - 1)) GROUP BY w.spec),
  cands AS (
    SELECT dir, spec, 1 AS step, (0, '', 0, 0) AS ord, {_norm("dir || '/' || spec")} AS cand FROM asked WHERE spec[1] = '.'
    UNION ALL SELECT dir, spec, 2, (-length(config), config, nth, t), {_norm("base || '/' || replace(CASE t WHEN 0 THEN first_target ELSE second_target END, '*', spec[length(prefix) + 1 :])")}
      FROM asked, mod_aliases, (SELECT 0 AS t UNION ALL SELECT 1) tt WHERE starts_with(dir || '/', regexp_replace(config, '[^/]*$', '')) AND (CASE WHEN wildcard THEN starts_with(spec, prefix) ELSE spec = prefix END)
    UNION ALL SELECT a.dir, a.spec, 3, (0, '', 0, 0), {_norm("w.root || '/' || CASE WHEN w.closed THEN coalesce(g.target, '../../../../../../..') WHEN w.sub = '' THEN coalesce(w.main, 'index') ELSE w.sub END")}
      FROM asked a JOIN want w USING (spec) LEFT JOIN given g ON g.spec = a.spec WHERE a.spec[1] <> '.'),
  hits AS (SELECT c.dir, c.spec, arg_min((c.step, f.path), (c.step, c.ord, n)) AS hit FROM cands c, {_TRIALS} t, (SELECT DISTINCT path FROM mod_files) f
    WHERE ends_with(c.cand, t.cut) AND f.path = left(c.cand, length(c.cand) - length(t.cut)) || t.ext GROUP BY c.dir, c.spec),
  owner AS (SELECT path, arg_max(name, length(root)) AS owner FROM (SELECT DISTINCT path FROM mod_files) f JOIN mod_packages p ON starts_with(f.path, p.root || '/') GROUP BY path),
  verdict AS (SELECT a.dir, a.spec, CASE WHEN regexp_replace(a.spec, '^node:', '') IN ('fs', 'fs/promises', 'path') THEN 'builtin' WHEN a.spec[1] = '.' THEN 'relative' WHEN hit[1] = 2 THEN 'alias' WHEN w.spec IS NOT NULL THEN 'package' ELSE 'unresolved' END AS kind,
    hit[2] AS resolved, CASE WHEN hit[1] < 3 THEN o.owner WHEN a.spec[1] <> '.' THEN w.name END AS package
    FROM asked a LEFT JOIN hits h ON h.dir = a.dir AND h.spec = a.spec LEFT JOIN want w ON w.spec = a.spec LEFT JOIN owner o ON o.path = hit[2])"""


def _graph(h):
    aliases = h.mod_aliases.select("config", "base", "nth", "prefix", "wildcard", F.array("first_target", "second_target").alias("targets"))
    return h.mod_files.select("path"), h.mod_packages, h.mod_exports, aliases


@query("s11_import_resolution", f"WITH {_PAIRS} SELECT i.file, i.nth, i.local, i.spec, v.kind, v.resolved, v.package, count(*) AS n FROM mod_imports i JOIN verdict v ON v.dir = regexp_replace(i.file, '/[^/]*$', '') AND v.spec = i.spec GROUP BY ALL")
def _(h):
    out = im.resolve(h.mod_imports, *_graph(h))
    return out.groupBy("file", "nth", "local", "spec", "kind", "resolved", "package").agg(F.count(F.lit(1)).alias("n"))


@query("s11_unresolved_packages", f"WITH {_PAIRS} SELECT v.package, count(*) AS n, count(DISTINCT v.spec) AS specs FROM mod_imports i JOIN verdict v ON v.dir = regexp_replace(i.file, '/[^/]*$', '') AND v.spec = i.spec WHERE v.kind = 'package' AND v.resolved IS NULL GROUP BY 1")
def _(h):
    out = im.resolve(h.mod_imports, *_graph(h))
    return out.where("kind = 'package' AND resolved IS NULL").groupBy("package").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("spec").alias("specs"))


_KEYS = f"""{_PAIRS}, bound AS (SELECT i.file, i.local, i.exported, v.resolved, o.owner, i.nth FROM mod_imports i JOIN verdict v ON v.dir = regexp_replace(i.file, '/[^/]*$', '') AND v.spec = i.spec LEFT JOIN owner o ON o.path = v.resolved
    WHERE v.resolved IS NOT NULL AND i.exported NOT IN ('', '*', 'default')),
  last AS (SELECT file, local, arg_max((CASE WHEN regexp_matches(resolved, '\\.(ts|tsx|mts|cts)$') THEN 'typescript' ELSE 'javascript' END, coalesce(owner || '::', '') || resolved, exported), (nth, resolved, exported)) AS k FROM bound GROUP BY file, local)"""


@query("j21_cross_package_keys", f"WITH {_KEYS} SELECT file, local, k[1] AS lang, k[2] AS namespace, k[3] AS name FROM last")
def _(h):
    files, packages, exports, aliases = _graph(h)
    bound = im.resolve(h.mod_imports, files, packages, exports, aliases).withColumn("lang", F.lit("javascript")).withColumn("nth", F.struct("nth", "resolved", "exported"))
    return im.function_keys(bound, packages, files)


@query("s23_imports_by_namespace", f"""WITH {_KEYS} SELECT coalesce(o.owner || '::', '') || l.file AS caller, count(*) AS bindings, count(DISTINCT k[2]) AS modules FROM last l LEFT JOIN owner o ON o.path = l.file GROUP BY 1""")
def _(h):
    files, packages, exports, aliases = _graph(h)
    bound = im.resolve(h.mod_imports, files, packages, exports, aliases).withColumn("lang", F.lit("javascript")).withColumn("nth", F.struct("nth", "resolved", "exported"))
    keys = im.function_keys(bound, packages, files)
    owner = im.enclosing(files.select(im.folder(F.col("path")).alias("folder")), packages, "name").select("folder", F.col("name").alias("owner"))
    own = keys.withColumn("folder", im.folder(F.col("file"))).join(owner, "folder", "left")
    return own.groupBy(im.namespace(F.col("file"), F.col("owner")).alias("caller")).agg(F.count(F.lit(1)).alias("bindings"), F.count_distinct("namespace").alias("modules"))


# manifests as text, with comments and trailing commas
_MANIFESTS = """SELECT root || '/package.json' AS path, '{{ // a package' || chr(10) || ' "name": "' || name || '",' || CASE WHEN main IS NULL THEN '' ELSE ' "main": "' || main || '", /* entry */' END
  || CASE WHEN closed THEN ' "exports": {{ ".": {{"import": "./src/m1/f1.ts", "require": "./x.cjs"}}, "./lib/*": "./src/*", "./lib/m3/f3": null, "./m*.js": ["./src/m*"], "./two": "./src/m2/f2.js", }},' ELSE '' END || ' }}' AS content FROM {mod_packages}
UNION ALL SELECT config, '{{"compilerOptions": {{"baseUrl": "src", "paths": {{"@/*": ["*", "sub/*"], "none": [], }},}}}} // end' FROM {mod_aliases} WHERE config LIKE '%jsconfig.json'
UNION ALL SELECT root || '/node_modules/x/package.json', '{{"name": "x"}}' FROM {mod_packages} UNION ALL SELECT root || '/.cache/package.json', '{{"name": "y"}}' FROM {mod_packages} UNION ALL SELECT root || '/broken/package.json', '{{"name": ' FROM {mod_packages} UNION ALL SELECT root || '/unnamed/package.json', '{{}}' FROM {mod_packages}"""


@query(
    "s10_module_graph",
    """SELECT 'package' AS kind, root AS at, 0 AS nth, name AS key, main AS target, closed AS flag FROM mod_packages
  UNION ALL SELECT 'export', root, CASE key WHEN '.' THEN 0 WHEN './lib/*' THEN 1 WHEN './lib/m3/f3' THEN 2 WHEN './m*.js' THEN 3 ELSE 4 END, key, target, contains(key, '*') FROM mod_exports
  UNION ALL SELECT 'alias', config, 0, prefix, base || ':' || first_target || ',' || second_target, wildcard FROM mod_aliases WHERE config LIKE '%jsconfig.json'""",
)
def _(h):
    tree = h.spark.sql(_MANIFESTS, mod_packages=h.mod_packages, mod_aliases=h.mod_aliases)
    packages, exports, aliases = im.module_graph(tree)
    out = packages.select(F.lit("package").alias("kind"), F.col("root").alias("at"), F.lit(0).alias("nth"), F.col("name").alias("key"), F.col("main").alias("target"), F.col("closed").alias("flag"))
    out = out.unionByName(exports.select(F.lit("export").alias("kind"), F.col("root").alias("at"), "nth", "key", "target", F.col("key").contains("*").alias("flag")))
    return out.unionByName(aliases.select(F.lit("alias").alias("kind"), F.col("config").alias("at"), "nth", F.col("prefix").alias("key"), F.concat("base", F.lit(":"), F.array_join("targets", ",")).alias("target"), F.col("wildcard").alias("flag")))
