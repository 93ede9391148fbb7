"""Maps, filters, sketches, records, sequences, graphs and automata, each as a bundle
of codewords (``*_bundle`` and the reads on it) and as its exact relational twin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from phasorlake.plans import BROADCAST, first_by, keep
from phasorlake.space import Space, bind, bundle, cleanup, codebook, matches, pair, scores, shift, similarity, unbind


def _coded(space: Space, df: DataFrame, **names: str) -> DataFrame:
    """Adds, for each column=prefix, its codeword in prefix_re and prefix_im."""
    df = space.expand(df)
    for column, prefix in names.items():
        t = space.theta(F.col(column).cast("string"), F.col("j"))
        df = df.withColumn("_t", t).withColumn(f"{prefix}_re", F.cos("_t")).withColumn(f"{prefix}_im", F.sin("_t")).drop("_t")
    return df


# maps

def map_bundle(space: Space, rows: DataFrame, key: str, value: str, weight: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One vector of all pairs (or one for each of ``by``); a weight of -1 takes a pair away."""
    re, im = bind(pair("k_re", "k_im"), pair("v_re", "v_im"))
    return bundle(_coded(space, rows, **{key: "k", value: "v"}), by, re, im, weight)


def map_get(space: Space, memory: DataFrame, keys: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """(key, label, score): an unknown key gives noise with a low score, not null."""
    asked = _coded(space, keys.select(key).distinct(), **{key: "k"}).join(memory, "j")
    re, im = unbind(pair(), pair("k_re", "k_im"))
    asked = asked.withColumns({"re": re, "im": im}).select(key, "j", "re", "im")
    return cleanup(asked, codebook(space, values, value), [key], space.dim)


# membership and frequency

def set_bundle(space: Space, items: DataFrame, item: str, weight: Column | None = None) -> DataFrame:
    return bundle(space.codewords(items, item), [], weight=weight)


def set_scores(space: Space, memory: DataFrame, probes: DataFrame, item: str) -> DataFrame:
    """(item, score): near 1 for a member, near its count for a weighted one."""
    asked = space.codewords(probes.select(item).distinct(), item, "bre", "bim")
    return similarity(memory, asked, [item], space.dim)


# records

def records(space: Space, rows: DataFrame, rec: str, role: str, filler: str) -> DataFrame:
    re, im = bind(pair("r_re", "r_im"), pair("f_re", "f_im"))
    return bundle(_coded(space, rows, **{role: "r", filler: "f"}), [rec], re, im)


def record_get(space: Space, recs: DataFrame, rec: str, roles: DataFrame, role: str, fillers: DataFrame, filler: str) -> DataFrame:
    asked = _coded(space, roles.select(role).distinct(), **{role: "r"}).join(recs, "j")
    re, im = unbind(pair(), pair("r_re", "r_im"))
    asked = asked.withColumns({"re": re, "im": im}).select(rec, role, "j", "re", "im")
    return cleanup(asked, codebook(space, fillers, filler), [rec, role], space.dim)


def analogy_exact(rows: DataFrame, rec: str, role: str, filler: str) -> DataFrame:
    """For each pair of records a, b and filler of a: the role that it has in a, and b's filler there."""
    a = rows.select(F.col(rec).alias("a"), F.col(role).alias("_role"), F.col(filler).alias("asked"))
    b = rows.select(F.col(rec).alias("b"), F.col(role).alias("_role"), F.col(filler).alias("answer"))
    return a.join(b, "_role").filter("a <> b").withColumnRenamed("_role", role)


def analogy(space: Space, recs: DataFrame, rec: str, asked: DataFrame, filler: str, roles: DataFrame, role: str, fillers: DataFrame) -> DataFrame:
    """(a, b, filler, role, label, score): the role that a filler has in record a, and what record b has there.

    Two unbindings, each cleaned up. ``asked`` is (a, b, filler)."""
    f = codebook(space, asked, filler).withColumnsRenamed({"label": filler})
    one = asked.join(recs.withColumnRenamed(rec, "a"), "a").join(f, [filler, "j"])
    re, im = unbind(pair(), pair("bre", "bim"))
    found = cleanup(one.select("a", "b", filler, "j", re.alias("re"), im.alias("im")), codebook(space, roles, role), ["a", "b", filler], space.dim)
    found = found.select("a", "b", filler, F.col("label").alias("role"))
    r = codebook(space, roles, role).withColumnsRenamed({"label": "role"})
    two = found.join(recs.withColumnRenamed(rec, "b"), "b").join(r, ["role", "j"])
    re, im = unbind(pair(), pair("bre", "bim"))
    return cleanup(two.select("a", "b", filler, "role", "j", re.alias("re"), im.alias("im")), codebook(space, fillers, filler), ["a", "b", filler, "role"], space.dim)


# sequences

def sequence_bundle(space: Space, rows: DataFrame, seq: str, position: str, item: str) -> DataFrame:
    """sum of rho^position(item) by sequence."""
    out = space.codewords(rows, item).withColumn("j", F.pmod(F.col("j") - F.col(position), F.lit(space.dim)))
    return bundle(out, [seq])


def sequence_decode(space: Space, memory: DataFrame, seq: str, positions: DataFrame, position: str, items: DataFrame, item: str) -> DataFrame:
    back = memory.crossJoin(positions.select(position).distinct()).withColumn("j", F.pmod(F.col("j") + F.col(position), F.lit(space.dim)).cast("int"))
    return cleanup(back, codebook(space, items, item), [seq, position], space.dim)


def stack_order(rows: DataFrame, stack: str, order: list[Column]) -> DataFrame:
    """The pops of each stack: last in, first out, from 1."""
    return rows.withColumn("pop", F.row_number().over(Window.partitionBy(stack).orderBy(*order)))


def stack_bundle(space: Space, rows: DataFrame, stack: str, depth: str, item: str) -> DataFrame:
    """sum of rho^depth(item): the top has depth 0, a push shifts all others by one."""
    return sequence_bundle(space, rows, stack, depth, item)


def stack_push(space: Space, memory: DataFrame, stack: str, pushed: DataFrame, item: str) -> DataFrame:
    return bundle(shift(memory, 1, space.dim).unionByName(space.codewords(pushed.select(stack, item), item).drop(item)), [stack])


def stack_pops(space: Space, memory: DataFrame, stack: str, items: DataFrame, item: str, n: int) -> DataFrame:
    """(stack, pop, label, score): the top read, taken away and the rest shifted back, ``n`` times."""
    book, out = codebook(space, items, item), None
    for k in range(n):
        top = keep(cleanup(memory, book, [stack], space.dim))
        found = top.withColumn("pop", F.lit(k + 1)).select(stack, "pop", "label", "score")
        out = found if out is None else out.unionByName(found)
        gone = top.join(book, "label").select(stack, "j", (-F.col("bre")).alias("re"), (-F.col("bim")).alias("im"))
        memory = keep(shift(bundle(memory.unionByName(gone), [stack]), -1, space.dim).withColumn("j", F.col("j").cast("int")))
    return out


# n-grams

def _grams(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of ``n`` characters, a row of code points each, and their counts."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if len(c) < n:
        return np.empty((0, n), np.uint32), np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(c, n)
    if n > 3:
        return np.unique(windows, axis=0, return_counts=True)
    keys, count = np.unique(_packed(windows), return_counts=True)
    return np.column_stack([(keys >> np.uint64(21 * (n - 1 - i)) & np.uint64(0x1FFFFF)).astype(np.uint32) for i in range(n)]), count


def _spelt(codes: np.ndarray) -> list[str]:
    n = codes.shape[1]
    flat = np.ascontiguousarray(codes.astype("<u4")).tobytes().decode("utf-32-le")
    return [flat[a : a + n] for a in range(0, len(flat), n)]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, count = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    n = codes.shape[1]
    if n > 3:
        first, at = np.unique(codes, axis=0, return_index=True, return_inverse=True)[1:]
    else:
        _, first, at = np.unique(_packed(codes), return_index=True, return_inverse=True)
    return codes[first], np.bincount(at.ravel(), count, len(first)).astype(np.int64)


def _packed(codes: np.ndarray) -> np.ndarray:
    keys = np.zeros(len(codes), np.uint64)
    for i in range(codes.shape[1]):
        keys = keys << np.uint64(21) | codes[:, i].astype(np.uint64)
    return keys


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut small: what a kernel makes of one is passed on before the next is looked at."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def letters(text: str, keep: str = "[^a-z ]") -> Column:
    return F.regexp_replace(F.lower(text), keep, "")


def ngrams(docs: DataFrame, key: str, text: str, n: int = 3, keep: str = "[^a-z ]") -> DataFrame:
    """(key, gram, n): counts of letter n-grams, lower-cased, other characters dropped.

    Counted within each text first, so the shuffle gets a row for each text and gram."""
    part_rows = 256

    def counted(batch: pa.RecordBatch, held: dict) -> Iterator[pa.RecordBatch]:
        for i, parts in held.values():
            codes, count = parts[0]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(count))), pa.array(_spelt(codes)), pa.array(count.astype(np.int64))], [key, "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict = {}  # texts of one key are counted together
            for a, part in enumerate(slices([batch], part_rows)):
                for i, (k, t) in enumerate(zip(part.column(0).to_pylist(), part.column(1))):
                    codes, count = _grams(t.as_py() or "", n)
                    if len(count):
                        held.setdefault(k, (a * part_rows + i, []))[1].append((codes, count))
                for _, parts in held.values():  # what a slice's texts share is one row from here on
                    if len(parts) > 1:
                        parts[:] = [_added(parts)]
                if len(held) > 64:
                    yield from counted(batch, held)
                    held = {}
            yield from counted(batch, held)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, letters(text, keep).alias("_t")).mapInArrow(run, f"{key} {kind}, gram string, n long")
    return rows.groupBy(key, "gram").agg(F.sum("n").alias("n"))


def gram_profile(space: Space, counts: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Bundles of rho^(n-1-i)(letter i) bound over each gram, weighted by its count. A gram's codeword is made once."""
    df = space.expand(counts.select("gram").distinct())
    re, im = F.lit(1.0), F.lit(0.0)
    for i in range(n):
        t = space.theta(F.substring("gram", i + 1, 1), F.pmod(F.col("j") + F.lit(n - 1 - i), F.lit(space.dim)))
        re, im = bind((re, im), (F.cos(t), F.sin(t)))
    codes = df.select("gram", "j", re.alias("_re"), im.alias("_im"))
    return bundle(counts.join(codes, "gram"), [key], "_re", "_im", F.col("n").cast("double"))


ALPHABET = "abcdefghijklmnopqrstuvwxyz "


def gram_codes(space: Space, spark) -> np.ndarray:
    """Angles of the alphabet's letters, a row each: what kernels make all codewords of trigrams from."""
    rows = spark.createDataFrame([(c,) for c in ALPHABET], "c string")
    got = space.expand(rows).select("c", "j", space.theta(F.col("c"), F.col("j")).alias("t")).collect()
    out = np.zeros((len(ALPHABET), space.dim))
    for r in got:
        out[ALPHABET.index(r.c), r.j] = r.t
    return out


def unit_profile_arrays(space: Space, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, re, im): letter trigram profiles of norm 1 as arrays. A text without a trigram has no row."""
    angles, dim = gram_codes(space, docs.sparkSession), space.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = [np.exp(1j * np.roll(angles, -k, 1)) for k in (2, 1, 0)]
        place = np.zeros(128, np.int64)
        for i, c in enumerate(ALPHABET):
            place[ord(c)] = i
        codes = (turned[0][:, None, None] * turned[1][None, :, None] * turned[2][None, None]).reshape(-1, dim)
        for batch in slices(batches):
            at, out = [], []
            for i, t in enumerate(batch.column(1)):
                got, count = _grams(t.as_py() or "", 3)
                if len(count):
                    x = place[got]
                    v = count @ codes[x[:, 0] * 729 + x[:, 1] * 27 + x[:, 2]]
                    at.append(i)
                    out.append(v / max(np.sqrt((np.abs(v) ** 2).sum()), 1e-9))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([v.real for v in out], kind), pa.array([v.imag for v in out], kind)], [key, "re", "im"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, letters(text).alias("_t")).mapInArrow(run, f"{key} {kind}, re array<double>, im array<double>")


def profile_cosines(docs: DataFrame, key: str, text: str, profiles: DataFrame, name: str) -> DataFrame:
    """(key, name, cos) of each text's trigram counts with the counts (name, gram, n) of every profile.

    Few profiles go to the tasks, after a check of their size; else both sides are joined by gram."""
    packed = packed_cosines(docs, key, text, profiles, name)
    if packed is None:
        return count_cosine(ngrams(docs, key, text), key, profiles, name)
    rows, names = packed
    each = rows.select(key, F.posexplode("cos").alias("_i", "cos")).filter("cos <> 0")
    return each.select(key, F.element_at(F.lit(names), F.col("_i") + 1).cast(profiles.schema[name].dataType).alias(name), "cos")


def packed_cosines(docs: DataFrame, key: str, text: str, profiles: DataFrame, name: str) -> tuple[DataFrame, list] | None:
    """((key, cos), names): each text's cosines with every profile as an array in order of the names, 0 with one that
    shares no trigram; a text without a trigram has no row. None if the profiles are too large to go to every task."""
    if profiles.count() * 32 > BROADCAST:
        return None
    held: dict = {}
    for r in profiles.collect():
        held.setdefault(r[name], {})[r["gram"]] = float(r["n"])
    names = sorted(held)
    grams = {g: i for i, g in enumerate(sorted({g for p in held.values() for g in p}))}
    if not names or len(grams) * len(names) * 8 > BROADCAST:
        return None
    matrix = np.zeros((len(grams) + 1, len(names)))  # the last row is of grams that no profile has
    for c, x in enumerate(names):
        matrix[[grams[g] for g in held[x]], c] = list(held[x].values())
    matrix /= np.maximum(np.sqrt((matrix * matrix).sum(0)), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, cos = [], []
            for i, t in enumerate(batch.column(1)):
                codes, count = _grams(t.as_py() or "", 3)
                if len(count):
                    n = count.astype(float)
                    at.append(i)
                    cos.append(n @ matrix[[grams.get(g, -1) for g in _spelt(codes)]] / np.sqrt((n * n).sum()))
            flat = pa.array(np.array(cos).reshape(-1))
            ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.ListArray.from_arrays(ends, flat)], [key, "cos"])

    return docs.select(key, letters(text).alias("_t")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, cos array<double>"), names


def count_cosine(a: DataFrame, akey: str, b: DataFrame, bkey: str, item: str = "gram", n: str = "n") -> DataFrame:
    """(akey, bkey, cos) of sparse count vectors that share an item."""
    norm = lambda df, k, name: df.groupBy(k).agg(F.sqrt(F.sum(F.col(n).cast("double") * F.col(n))).alias(name))
    pairs = a.select(akey, item, F.col(n).alias("_x")).join(b.select(bkey, item, F.col(n).alias("_y")), item)
    dots = pairs.groupBy(akey, bkey).agg(F.sum(F.col("_x").cast("double") * F.col("_y")).alias("_d"))
    out = dots.join(norm(a, akey, "_na"), akey).join(norm(b, bkey, "_nb"), bkey)
    return out.select(akey, bkey, (F.col("_d") / (F.col("_na") * F.col("_nb"))).alias("cos"))


# graphs

def graph_bundle(space: Space, edges: DataFrame, src: str = "src", dst: str = "dst", directed: bool = True) -> DataFrame:
    """sum of U bound to rho(V); an undirected edge goes both ways."""
    rows = edges.select(F.col(src).cast("string").alias("_u"), F.col(dst).cast("string").alias("_v"))
    if not directed:
        rows = rows.unionByName(rows.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
    df = space.expand(rows)
    u, v = space.theta(F.col("_u"), F.col("j")), space.theta(F.col("_v"), F.pmod(F.col("j") + F.lit(1), F.lit(space.dim)))
    return bundle(df, [], F.cos(u + v), F.sin(u + v))


def graph_neighbors(space: Space, memory: DataFrame, nodes: DataFrame, node: str, labels: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """(node, label, score): those whose codeword the unbound, unshifted memory holds."""
    asked = space.codewords(nodes.select(node).distinct(), node, "u_re", "u_im").join(memory, "j")
    re, im = unbind(pair(), pair("u_re", "u_im"))
    asked = shift(asked.withColumns({"re": re, "im": im}).select(node, "j", "re", "im"), -1, space.dim).withColumn("j", F.col("j").cast("int"))
    return matches(asked, codebook(space, labels, label), [node], space.dim, threshold)


def graph_has_edge(space: Space, memory: DataFrame, probes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst, score) of probed edges."""
    df = space.expand(probes.select(src, dst).distinct())
    t = space.theta(F.col(src).cast("string"), F.col("j")) + space.theta(F.col(dst).cast("string"), F.pmod(F.col("j") + F.lit(1), F.lit(space.dim)))
    return similarity(memory, df.withColumn("_t", t).select(src, dst, "j", F.cos("_t").alias("bre"), F.sin("_t").alias("bim")), [src, dst], space.dim)


def set_metrics(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: precision and recall of found rows, and whether the sets are equal."""
    t, f = truth.select(*keys).distinct().withColumn("_t", F.lit(1)), found.select(*keys).distinct().withColumn("_f", F.lit(1))
    c = t.join(f, keys, "full").agg(F.count(F.when(F.col("_t").isNotNull() & F.col("_f").isNotNull(), 1)).alias("both"), F.count("_t").alias("truth"), F.count("_f").alias("found"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(1.0))
    return c.select("truth", "found", ratio("both", "found").alias("precision"), ratio("both", "truth").alias("recall"), ((F.col("both") == F.col("truth")) & (F.col("both") == F.col("found"))).alias("exact"))


# automata

def fsm_bundle(space: Space, rules: DataFrame, state: str = "state", symbol: str = "symbol", after: str = "after") -> DataFrame:
    """sum of S bound to A bound to rho(S')."""
    df = space.expand(rules)
    j = F.col("j")
    t = space.theta(F.col(state), j) + space.theta(F.concat(F.lit("sym:"), F.col(symbol)), j) + space.theta(F.col(after), F.pmod(j + F.lit(1), F.lit(space.dim)))
    return bundle(df, [], F.cos(t), F.sin(t))


def fsm_step(space: Space, memory: DataFrame, asked: DataFrame, states: DataFrame, label: str, state: str = "state", symbol: str = "symbol") -> DataFrame:
    df = space.expand(asked.select(state, symbol).distinct()).join(memory, "j")
    t = space.theta(F.col(state), F.col("j")) + space.theta(F.concat(F.lit("sym:"), F.col(symbol)), F.col("j"))
    re, im = unbind(pair(), (F.cos(t), F.sin(t)))
    out = df.withColumn("_re", re).withColumn("im", im).withColumn("re", F.col("_re")).select(state, symbol, F.pmod(F.col("j") + F.lit(1), F.lit(space.dim)).alias("j"), "re", "im")
    return cleanup(out, codebook(space, states, label), [state, symbol], space.dim)


def fsm_trajectory(space: Space, memory: DataFrame, inputs: DataFrame, machine: str, states: DataFrame, label: str, start: str) -> DataFrame:
    """(machine, position, state): the bundle asked for one step after another, the state cleaned up each time.

    ``inputs`` is (machine, position from 1, symbol); all machines take a step at once."""
    steps = inputs.agg(F.max("position")).first()[0] or 0
    now = keep(inputs.select(machine).distinct().withColumn("state", F.lit(start)))
    out = now.select(machine, F.lit(0).alias("position"), "state")
    for p in range(1, steps + 1):
        asked = now.join(inputs.filter(F.col("position") == p).select(machine, "symbol"), machine)
        found = fsm_step(space, memory, asked, states, label).select("state", "symbol", F.col("label").alias("_to"))
        now = keep(asked.join(found, ["state", "symbol"]).select(machine, F.col("_to").alias("state")))
        out = out.unionByName(now.select(machine, F.lit(p).alias("position"), "state"))
    return out


def fsm_run(rows: DataFrame, machine: str, position: str, symbol: str, rules: DataFrame, start: str, state: str = "state", rule_symbol: str = "symbol", after: str = "after", block: int = 4096) -> DataFrame:
    """(machine, position, state after it); a missing rule keeps the state. Positions count from 1 without gaps.

    A machine's inputs are cut into blocks; one of a single block is run from the start. Else each block is run from every state at once;
    the blocks' maps of states, a row each, are composed to the state in which each block
    starts; then each block is run once. So a machine of any length is spread over tasks.
    The rules, a table of the automaton's size, go to all tasks after a check of it.
    """
    table = rules.select(F.col(state).cast("string"), F.col(rule_symbol).cast("string"), F.col(after).cast("string"))
    if table.count() * 256 > BROADCAST:
        raise ValueError("the automaton has too many rules to go to every task")
    step: dict = {}
    for s, a, t in table.collect():
        step.setdefault(a, {})[s] = t
    states = sorted({start} | {s for m in step.values() for s in m} | {t for m in step.values() for t in m.values()})
    kind = rows.schema[machine].dataType.simpleString()
    blocks = rows.filter(F.col(machine).isNotNull()).select(machine, F.col(position).cast("long").alias("position"), F.col(symbol).cast("string").alias("symbol")).withColumn("_b", F.floor((F.col("position") - 1) / block))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Stretches of one machine's block within a batch, and whether the block goes on from the batch before."""
        last = None
        for batch in batches:
            m, b = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            a = 0
            for i in range(1, len(m) + 1):
                if i == len(m) or (m[i], b[i]) != (m[a], b[a]):
                    yield (m[a], b[a]), batch, a, i, (m[a], b[a]) == last
                    last, a = (m[a], b[a]), i

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple, now: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{machine: key[0], "_b": key[1], "_map": now}], schema)

        schema = pa.schema([(machine, pa_kind), ("_b", pa.int64()), ("_map", pa.list_(pa.string()))])
        key, now = None, []
        for k, batch, a, b, more in runs(batches):
            if not more:
                if key is not None:
                    yield out(key, now)
                key, now = k, list(states)
            for x in batch.column(2).slice(a, b - a).to_pylist():
                if x in step:
                    now = [step[x].get(s, s) for s in now]
        if key is not None:
            yield out(key, now)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = start
        for _, batch, a, b, more in runs(batches):
            if not more:
                now = batch.column(4)[a].as_py()
            said = []
            for x in batch.column(2).slice(a, b - a).to_pylist():
                now = step.get(x, {}).get(now, now)
                said.append(now)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(said, pa.string())], [machine, "position", "state"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        now, said = start, []
        pdf = pdf.sort_values("_b")
        for m in pdf["_map"]:
            said.append(now)
            now = m[states.index(now)]
        return pd.DataFrame({machine: pdf[machine], "_b": pdf["_b"], "_from": said})

    pa_kind = to_arrow_type(rows.schema[machine].dataType)
    several = blocks.join(blocks.filter("_b > 0").select(machine).distinct(), machine, "left_semi")
    dealt = several.repartition(machine, "_b").sortWithinPartitions(machine, "_b", "position")
    maps = dealt.mapInArrow(compose, f"{machine} {kind}, _b long, _map array<string>")
    starts = maps.groupBy(machine).applyInPandas(chain, f"{machine} {kind}, _b long, _from string")
    ready = blocks.join(starts, [machine, "_b"], "left").select(machine, "position", "symbol", "_b", F.coalesce("_from", F.lit(start)).alias("_from"))
    return ready.repartition(machine, "_b").sortWithinPartitions(machine, "_b", "position").mapInArrow(emit, f"{machine} {kind}, position long, state string")


def top_followers(rows: DataFrame, key: str, order: list[str], symbol: str) -> DataFrame:
    """(state, symbol, after): for each pair of neighbours (state, symbol) the commonest next symbol."""
    w = Window.partitionBy(key).orderBy(*order)
    t = rows.select(F.col(symbol).alias("state"), F.lead(symbol, 1).over(w).alias("symbol"), F.lead(symbol, 2).over(w).alias("after")).filter("after IS NOT NULL")
    n = t.groupBy("state", "symbol", "after").agg(F.count("*").alias("n"))
    return first_by(n, ["state", "symbol"], [F.col("n").desc(), F.col("after").asc()])


# sparse distributed memory

def sdm_addresses(space: Space, spark, locations: int, bits: int) -> DataFrame:
    """(loc, bit, sign): fixed random addresses."""
    from phasorlake.functions import text, uniform

    df = spark.range(locations).select(F.col("id").cast("int").alias("loc")).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    return df.withColumn("sign", F.when(uniform(text(space.seed, "sdm", F.col("loc"), F.col("bit"))) < 0.5, -1).otherwise(1))


def sdm_active(addresses: DataFrame, probes: DataFrame, key: str, radius: int, bits: int) -> DataFrame:
    """(key, loc): locations within ``radius`` differing bits; probes are (key, bit, sign)."""
    p = probes.select(key, "bit", F.col("sign").alias("_s"))
    d = addresses.join(p, "bit").groupBy(key, "loc").agg(F.sum(F.col("sign") * F.col("_s")).alias("dot"))
    return d.filter((F.lit(bits) - F.col("dot")) / 2 <= radius).select(key, "loc")


def sdm_write(addresses: DataFrame, patterns: DataFrame, key: str, radius: int, bits: int) -> DataFrame:
    """(loc, bit, cnt): each pattern is added at every location it activates."""
    return sdm_active(addresses, patterns, key, radius, bits).join(patterns, key).groupBy("loc", "bit").agg(F.sum("sign").alias("cnt"))


def sdm_read(addresses: DataFrame, memory: DataFrame, probes: DataFrame, key: str, radius: int, bits: int, rounds: int = 2) -> DataFrame:
    """(key, bit, sign): the sign of the active counters' sum, read ``rounds`` times over."""
    for _ in range(rounds):
        s = sdm_active(addresses, probes, key, radius, bits).join(memory, "loc").groupBy(key, "bit").agg(F.sum("cnt").alias("_c"))
        probes = s.select(key, "bit", F.when(F.col("_c") >= 0, 1).otherwise(-1).alias("sign"))
    return probes
