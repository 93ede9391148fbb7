"""Paragraphs, chunks, keyword and fuzzy search, claim registries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasorlake.plans import first_by, keep, quantile


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, kind, body) of Markdown: headings, list items, table rows, prose; code fences are left out, links and marks stripped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                fence, held, start = False, [], 0

                def end(kind: str = "prose", k=k) -> None:
                    nonlocal held
                    if held:
                        rows.append((k, start, kind, " ".join(held)))
                    held = []

                for i, line in enumerate((t or "").split("\n"), 1):
                    s = line.strip()
                    if s.startswith("```"):
                        end()
                        fence = not fence
                    elif fence:
                        continue
                    elif not s:
                        end()
                    elif s.startswith("#"):
                        end()
                        rows.append((k, i, "heading", s.lstrip("#").strip()))
                    elif s.startswith("|"):
                        end()
                        cells = [c.strip() for c in s.strip("|").split("|")]
                        if any(c.strip("-: ") for c in cells):
                            rows.append((k, i, "row", " ; ".join(cells)))
                    else:
                        if s[:2] in ("- ", "* ", "+ "):
                            end()
                            s = s[2:]
                        if not held:
                            start = i
                        held.append(s)
                end()
            yield pd.DataFrame(rows, columns=[key, "line", "kind", "body"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInPandas(run, f"{key} {kind}, line int, kind string, body string")
    body = F.regexp_replace(F.regexp_replace("body", r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`]{1,3}", "")
    return out.withColumn("body", body)


def chunks(paras: DataFrame, key: str, least: int = 200, most: int = 1200) -> DataFrame:
    """(key, heading, l0, l1, body): paragraphs under a heading merged to at least ``least`` characters, at most ``most``.

    A paragraph that is longer stays whole. An order-dependent fold over one file's
    paragraphs."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        rows, heading, held, l0, l1 = [], "", "", 0, 0
        k = pdf[key].iloc[0]

        def end() -> None:
            nonlocal held
            if held:
                rows.append((k, heading, l0, l1, held))
            held = ""

        for line, kind, body in zip(pdf["line"], pdf["kind"], pdf["body"]):
            if kind == "heading":
                end()
                heading = body
                continue
            if held and len(held) + 1 + len(body) > most:
                end()
            l0 = line if not held else l0
            held, l1 = (held + "\n" + body if held else body), line
            if len(held) >= least:
                end()
        end()
        return pd.DataFrame(rows, columns=[key, "heading", "l0", "l1", "body"])

    kind = paras.schema[key].dataType.simpleString()
    return paras.groupBy(key).applyInPandas(fold, f"{key} {kind}, heading string, l0 int, l1 int, body string")


def keyword_scores(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, score): query words of over two letters that the lower-cased text contains."""
    words = sorted({w for w in query.lower().split() if len(w) > 2})
    low = F.lower(F.coalesce(text, F.lit("")))
    score = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    return rows.select(key, score.alias("score")).filter("score > 0")


def both_scores(a: DataFrame, b: DataFrame, key: str, weight: float = 1.0) -> DataFrame:
    """(key, total) over two score tables; a row missing in one counts 0 there."""
    t = F.coalesce("_a", F.lit(0.0)) + F.lit(weight) * F.coalesce("_b", F.lit(0.0))
    return a.select(key, F.col("score").cast("double").alias("_a")).join(b.select(key, F.col("score").cast("double").alias("_b")), key, "full").select(key, t.alias("total"))


def supersession(claims: DataFrame) -> DataFrame:
    """(root, id, step): each claim's chain to what it supersedes, newest first, to its end; circles end.

    By doubling: paths of exactly n links are put before all shorter ones, so a chain of
    any length takes as many rounds as its length has binary digits."""
    links = claims.filter("supersedes IS NOT NULL AND id <> supersedes").select(F.col("id").alias("root"), F.col("supersedes").alias("id"))
    nodes = claims.select(F.col("id").alias("root")).union(links.select("id")).distinct()
    tails = keep(nodes.select("root", F.col("root").alias("id"), F.array("root").alias("path")))  # fewer than n links
    jumps = keep(links.withColumn("path", F.array("root", "id")))  # n links
    while not jumps.isEmpty():

        def after(rest: DataFrame, jumps: DataFrame = jumps) -> DataFrame:
            rest = rest.select(F.col("root").alias("_at"), F.col("id").alias("_id"), F.slice("path", 2, F.size("path")).alias("_more"))
            met = jumps.join(rest, F.col("id") == F.col("_at")).filter(~F.arrays_overlap("path", "_more"))
            return met.select("root", F.col("_id").alias("id"), F.concat("path", "_more").alias("path"))

        tails, jumps = keep(tails.unionByName(after(tails))), keep(after(jumps))
    rows = claims.select(F.col("id").alias("_row"))
    return rows.join(tails, F.col("_row").eqNullSafe(F.col("root"))).select("root", "id", (F.size("path") - 1).alias("step"))


def registry_errors(claims: DataFrame) -> DataFrame:
    """(id, error): duplicate ids, links to claims that aren't there, empty statements."""
    twice = claims.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate").alias("error"))
    ids = claims.select(F.col("id").alias("supersedes")).distinct()
    loose = claims.filter("supersedes IS NOT NULL").join(ids, "supersedes", "left_anti").select("id", F.lit("dangling").alias("error"))
    bare = claims.filter(F.trim(F.coalesce("statement", F.lit(""))) == "").select("id", F.lit("empty").alias("error"))
    return twice.unionByName(loose).unionByName(bare)


def supersede(claims: DataFrame, old: str, statement: str, as_of: str) -> DataFrame:
    """The registry after a new generation of ``old``: its current rows are retired, a row <base>@<suffix> is added."""
    base = F.substring_index("id", "@", 1)
    mine = base == old.split("@", 1)[0]
    n = claims.filter(mine).agg(F.count("*").alias("n"), F.max_by("id", "as_of").alias("last"))
    letters = F.expr("concat(CASE WHEN n > 26 THEN chr(96 + cast((n - 1) div 26 as int)) ELSE '' END, chr(97 + cast(pmod(n - 1, 26) as int)))")
    new = n.filter("n > 0").select(F.concat(F.lit(old.split("@", 1)[0] + "@"), letters).alias("id"), F.lit(statement).alias("statement"), F.lit("current").alias("status"), F.col("last").alias("supersedes"), F.lit(as_of).alias("as_of"))
    kept = claims.withColumn("status", F.when(mine & (F.col("status") == "current"), "superseded").otherwise(F.col("status")))
    return kept.select("id", "statement", "status", "supersedes", "as_of").unionByName(new)


def value_as_of(facts: DataFrame, asked: DataFrame, key: str, when: str) -> DataFrame:
    """asked rows with the value whose version interval holds their time: a range join on [since, next)."""
    w = Window.partitionBy(key).orderBy("since")
    f = facts.withColumn("_until", F.lead("since").over(w))
    f = f.select(F.col(key).alias("_k"), "since", "_until", "value")
    on = (F.col(key) == F.col("_k")) & (F.col(when) >= F.col("since")) & (F.col("_until").isNull() | (F.col(when) < F.col("_until")))
    return asked.join(f, on, "left").drop("_k", "_until")


def missing_citations(claims: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file): cited files that aren't there."""
    return claims.select("id", F.explode("cites").alias("file")).distinct().join(files.select("file").distinct(), "file", "left_anti").select("id", "file")


def pattern_hits(claims: DataFrame, paras: DataFrame) -> DataFrame:
    """(id, line, found, reading): each claim's pattern over paragraphs; current, stale (another value) or historical (a dated or past marker near)."""
    hit = F.expr("regexp_extract(body, pattern, 1)")
    # a registry, a stated set against all paragraphs; Spark broadcasts it if its size allows, else both sides are dealt out
    rows = paras.crossJoin(claims.select("id", "pattern", "value"))
    rows = rows.withColumn("found", hit).filter("found <> ''")
    old = F.lower("body").rlike(r"\b(was|used to|formerly|before|until|retired)\b|\b(19|20)\d\d-\d\d-\d\d\b")
    return rows.select("id", "line", "found", F.when(F.col("found") == F.col("value"), "current").when(old, "historical").otherwise("stale").alias("reading"))


def search_topk(scores: DataFrame, by: list[str], item: str, k: int, threshold: float) -> DataFrame:
    """The k best of each query at or over a threshold; none is an abstention."""
    return first_by(scores.filter(F.col("cos") >= threshold), by, [F.col("cos").desc(), F.col(item).asc()], k, "rank")


def corrupt(df: DataFrame, key: str, text: str, rate: float, seed: str = "typo") -> DataFrame:
    """Texts without the characters that a hash of (key, place) picks, about a share ``rate``."""
    u = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"), F.lit("|"), i.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    letters = F.filter(F.split(F.col(text), ""), lambda c: c != "")
    kept = F.filter(F.transform(letters, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: u(x["i"]) >= rate)
    return df.withColumn(text, F.array_join(F.transform(kept, lambda x: x["c"]), ""))


def front_matter(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value) of ``name: value`` lines between the first two lines of three dashes; none without them."""
    head = F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    lines = docs.select(key, F.posexplode(F.split(head, r"\r?\n")).alias("_i", "_l")).filter(F.col("_l").rlike(r"^[A-Za-z_][\w-]*\s*:"))
    name, value = F.trim(F.regexp_extract("_l", r"^([A-Za-z_][\w-]*)\s*:", 1)), F.trim(F.regexp_replace("_l", r"^[A-Za-z_][\w-]*\s*:", ""))
    rows = lines.select(key, "_i", name.alias("name"), F.regexp_replace(value, r"^[\"'](.*)[\"']$", "$1").alias("value"))
    return first_by(rows, [key, "name"], [F.col("_i").desc()]).drop("_i")  # a repeated name has its last value


def python_paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, kind, body): docstrings and runs of comments of Python sources; a source that can't be parsed gives its comments only."""
    import ast
    import io
    import tokenize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                t = t or ""
                try:
                    for node in ast.walk(ast.parse(t)):
                        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and (doc := ast.get_docstring(node)):
                            rows.append((k, node.body[0].lineno, "docstring", " ".join(doc.split())))
                except (SyntaxError, ValueError, RecursionError):
                    pass
                held: list = []
                try:
                    for tok in tokenize.generate_tokens(io.StringIO(t).readline):
                        if tok.type == tokenize.COMMENT:
                            if held and held[-1][0] != tok.start[0] - 1:
                                rows.append((k, held[0][0], "comment", " ".join(x for _, x in held)))
                                held = []
                            held.append((tok.start[0], tok.string.lstrip("#: ").strip()))
                except (tokenize.TokenError, IndentationError, SyntaxError):
                    pass
                if held:
                    rows.append((k, held[0][0], "comment", " ".join(x for _, x in held)))
            yield pd.DataFrame(rows, columns=[key, "line", "kind", "body"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, line int, kind string, body string")


def plain_paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, body): texts cut at empty lines, white space made one space."""
    parts = docs.select(key, F.posexplode(F.split(text, r"\r?\n[ \t]*\r?\n")).alias("part", "body"))
    return parts.withColumn("body", F.trim(F.regexp_replace("body", r"\s+", " "))).filter("body <> ''")


def stale(index: DataFrame, files: DataFrame, key: str, digest: str, text: str) -> DataFrame:
    """Index rows with ``stale``: whether their file has gone or has another digest now."""
    now = files.select(key, F.sha2(text, 256).alias("_now"))
    return index.join(now, key, "left").withColumn("stale", ~F.coalesce(F.col(digest) == F.col("_now"), F.lit(False))).drop("_now")


def build_index(chunked: DataFrame, files: DataFrame, key: str, text: str) -> DataFrame:
    """(chunk columns, sha256): chunks with their file's digest, to be stored and later checked by ``stale``."""
    return chunked.join(files.select(key, F.sha2(text, 256).alias("sha256")), key)


def calibration(scores: DataFrame, query: str, score: str) -> DataFrame:
    """One row: the least and median best score of queries (signal), the 95th percentile of all other scores (noise), and their middle."""
    return packed_calibration(scores.groupBy(query).agg(F.collect_list(score).alias(score)), score)


def packed_calibration(scores: DataFrame, score: str) -> DataFrame:
    """``calibration`` of a row for each query, with all its scores in an array."""
    held = keep(scores.select(F.array_max(score).alias("_b"), F.col(score).alias("_o")), "scores")  # read for both quantiles
    least, median = held.agg(F.min("_b")).first()[0], quantile(held, "_b", 0.5)
    noise = quantile(held.select("_b", F.explode("_o").alias("_x")).filter("_x < _b"), "_x", 0.95)
    threshold = None if noise is None else (least + noise) / 2
    return held.sparkSession.createDataFrame([(least, median, noise, threshold)], "least double, median double, noise double, threshold double")
