"""Code graphs: scanning sources, canned questions, ratchets."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = "kind string, name string, module string, line int, complexity int, target string"
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension, ast.Assert)


def scan_python(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Rows of Python sources: module, function, class, import and call, with line and complexity. A file that doesn't parse gives a row of kind ``broken``."""

    def rows_of(name: str, source: str) -> Iterator[tuple]:
        module = name.removesuffix(".py").replace("/", ".")
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            yield "broken", module, module, 0, 0, None
            return
        yield "module", module, module, 1, source.count("\n") + 1, None
        stack: list[tuple[ast.AST, str]] = [(tree, module)]
        while stack:
            node, owner = stack.pop()
            for child in ast.iter_child_nodes(node):
                inside = owner
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    inside = f"{owner}.{child.name}"
                    yield "function", inside, module, child.lineno, 1 + sum(isinstance(n, _BRANCH) for n in ast.walk(child)), None
                elif isinstance(child, ast.ClassDef):
                    inside = f"{owner}.{child.name}"
                    yield "class", inside, module, child.lineno, 0, None
                elif isinstance(child, ast.Import):
                    for a in child.names:
                        yield "import", owner, module, child.lineno, 0, a.name
                elif isinstance(child, ast.ImportFrom):
                    yield "import", owner, module, child.lineno, 0, child.module or ""
                elif isinstance(child, ast.Call):
                    f = child.func
                    called = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if called:
                        yield "call", owner, module, child.lineno, 0, called
                stack.append((child, inside))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [r for p, t in zip(pdf[path], pdf[text]) for r in rows_of(p, t or "")]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _KINDS.split(", ")])

    return files.select(path, text).mapInPandas(run, _KINDS)


def resolve_calls(scanned: DataFrame) -> DataFrame:
    """(src, dst) calls whose name only one function bears."""
    functions = scanned.filter("kind = 'function'").withColumn("_short", F.substring_index("name", ".", -1))
    single = functions.groupBy("_short").agg(F.count("*").alias("_n"), F.first("name").alias("dst")).filter("_n = 1")
    return scanned.filter("kind = 'call'").join(single, F.col("target") == F.col("_short")).select(F.col("name").alias("src"), "dst").distinct()


def hotspots(nodes: DataFrame, measure: str, name: str, k: int = 15) -> DataFrame:
    return nodes.orderBy(F.col(measure).desc(), F.col(name)).limit(k)


def uncalled(nodes: DataFrame, name: str, edges: DataFrame, dst: str) -> DataFrame:
    return nodes.join(edges.select(F.col(dst).alias(name)).distinct(), name, "left_anti")


def hubs(edges: DataFrame, dst: str, k: int = 10) -> DataFrame:
    return edges.groupBy(dst).agg(F.count("*").alias("degree")).orderBy(F.col("degree").desc(), F.col(dst)).limit(k)


def leakage(edges: DataFrame, nodes: DataFrame, name: str, lane: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst, src_lane, dst_lane) of edges that cross lanes."""
    a = nodes.select(F.col(name).alias(src), F.col(lane).alias("src_lane"))
    b = nodes.select(F.col(name).alias(dst), F.col(lane).alias("dst_lane"))
    return edges.join(a, src).join(b, dst).filter("src_lane <> dst_lane").select(src, dst, "src_lane", "dst_lane")


def untested(nodes: DataFrame, name: str, test_name: Column, tests: DataFrame, test: str) -> DataFrame:
    return nodes.withColumn("_t", test_name).join(tests.select(F.col(test).alias("_t")).distinct(), "_t", "left_anti").drop("_t")


def ratchet(current: DataFrame, baseline: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """(keys, before, now, change) where counts differ; a key missing on a side counts 0."""
    a, b = current.select(*keys, F.col(n).alias("_a")), baseline.select(*keys, F.col(n).alias("_b"))
    now, before = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    out = a.join(b, keys, "full").select(*keys, before.alias("before"), now.alias("now"))
    return out.filter("before <> now").withColumn("change", F.when(F.col("now") > F.col("before"), "regression").otherwise("improvement"))


def runs(events: DataFrame, run: str = "run", kind: str = "event", at: str = "at") -> DataFrame:
    """(run, started, ended, status): starts with their end; one without is killed."""
    s = events.filter(F.col(kind) == "started").groupBy(run).agg(F.min(at).alias("started"))
    e = events.filter(F.col(kind) == "ended").groupBy(run).agg(F.max(at).alias("ended"))
    return s.join(e, run, "left").withColumn("status", F.when(F.col("ended").isNull(), "killed").otherwise("done"))


def structure_errors(files: DataFrame, imports: DataFrame, forbidden: DataFrame, path: str = "path") -> DataFrame:
    """(path, rule): a module without its test, a test without its module, a package without a README, an import between lanes that may not.

    ``files`` is (path, lane), ``imports`` (src, dst) of paths, ``forbidden`` (src_lane, dst_lane)."""
    name = F.regexp_extract(path, r"([^/]+)\.py$", 1)
    py = files.withColumn("_n", name).filter("_n <> ''")
    tests = py.filter(F.col("_n").startswith("test_")).withColumn("_n", F.substring("_n", 6, 1000))
    code = py.filter(~F.col("_n").startswith("test_") & (F.col("_n") != "__init__"))
    a = code.join(tests.select("_n").distinct(), "_n", "left_anti").select(path, F.lit("untested").alias("rule"))
    b = tests.join(code.select("_n").distinct(), "_n", "left_anti").select(path, F.lit("orphan test").alias("rule"))
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    readme = files.filter(F.col(path).endswith("/README.md")).select(folder.alias("_d")).distinct()
    c = code.select(folder.alias("_d")).distinct().join(readme, "_d", "left_anti").select(F.col("_d").alias(path), F.lit("no README").alias("rule"))
    lanes = leakage(imports, files, path, "lane").join(forbidden, ["src_lane", "dst_lane"], "left_semi")
    d = lanes.select(F.col("src").alias(path), F.lit("forbidden import").alias("rule")).distinct()
    return a.unionByName(b).unionByName(c).unionByName(d)


def god_modules(nodes: DataFrame, module: str, defines: DataFrame, edges: DataFrame, src: str, most: int, fan: int) -> DataFrame:
    """(module, definitions, fan_out) of modules that define over ``most`` things or import over ``fan`` others."""
    d = defines.groupBy(module).agg(F.count("*").alias("definitions"))
    e = edges.groupBy(F.col(src).alias(module)).agg(F.count("*").alias("fan_out"))
    out = nodes.select(module).distinct().join(d, module, "left").join(e, module, "left").fillna(0, ["definitions", "fan_out"])
    return out.filter((F.col("definitions") > most) | (F.col("fan_out") > fan))


def register(nodes: DataFrame, edges: DataFrame, prefix: str = "code") -> None:
    """Vertices and edges as views, to be asked in SQL: <prefix>_nodes and <prefix>_edges."""
    nodes.createOrReplaceTempView(f"{prefix}_nodes")
    edges.createOrReplaceTempView(f"{prefix}_edges")


def run_events(spark, run: str, label: str, at: str, status: str | None = None, wall: float | None = None) -> DataFrame:
    """A run's start event, and its end event if it has a status: rows for the log that ``runs`` reads."""
    rows = [(run, "started", label, at, None, None)]
    if status is not None:
        rows.append((run, "ended", label, at, status, wall))
    return spark.createDataFrame(rows, "run string, event string, label string, at string, status string, wall_s double")
