"""Dot products of all pairs of two tables' vectors, by blocks: only the rows that count leave a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasorlake.plans import first_by, keep

#: Rows of a side that are multiplied at once; rows of a side in a task, at most; bins of a histogram.
STEP, SHARE, BINS = 1024, 32768, 8192
#: Values that are ordered rather than counted in bins once more.
VALUES = 20_000_000
#: The score of a pair without one (a null vector, or a null in it), under all others.
NULL = -1e308


def round9(x: np.ndarray) -> np.ndarray:
    """Nine places, halves away from zero, as SQL rounds."""
    return np.where(x <= NULL, NULL, np.copysign(np.floor(np.abs(np.maximum(x, NULL / 1e10)) * 1e9 + 0.5) / 1e9, x))


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which are null or have a null in them."""
    a = pa.concat_arrays(column.chunks)
    there = a.is_valid().to_numpy(zero_copy_only=False)
    size = pc.list_value_length(a.filter(a.is_valid())).to_numpy(zero_copy_only=False)
    if len(size) and size.min() != size.max():
        raise ValueError("vectors of one length are needed")
    out = np.zeros((len(a), int(size[0]) if len(size) else 0))
    out[there] = a.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(size), out.shape[1])
    null = ~there | np.isnan(out).any(1)
    out[null] = 0
    return out, null


def shares(rows: int, least: int, most: int = SHARE) -> int:
    """Into how many shares a side is cut: ``least`` of 1,024 rows if there are as many, none of over ``most``."""
    return max(-(-rows // most), min(least, -(-rows // 1024)), 1)


def by_blocks(left: DataFrame, key: str, right: DataFrame, item: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, parts: tuple[int, int], on: Sequence[str] = (), half: bool = False) -> DataFrame:
    """``run`` on every share of the left with every share of the right, whose rows have equal columns ``on``.

    Rows are dealt to shares by a hash of their key, in columns _i and _j. With ``half`` both sides
    are the same rows in as many shares, and a share meets itself and the later ones only."""
    left, right = (df.dropna(subset=list(on)) if on else df for df in (left, right))
    a = left.withColumn("_i", F.pmod(F.xxhash64(key), F.lit(parts[0])).cast("int"))
    b = right.withColumn("_j", F.pmod(F.xxhash64(item), F.lit(parts[1])).cast("int"))
    a = a.withColumn("_j", F.explode(F.sequence(F.col("_i") if half else F.lit(0), F.lit(parts[1] - 1))))
    b = b.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j") if half else F.lit(parts[0] - 1))))
    cell = [*on, "_i", "_j"]
    # a number of its own: by bytes alone adaptive execution would put these into a few tasks
    n = min(max(parts[0] * parts[1], left.sparkSession.sparkContext.defaultParallelism * 4), 2000)
    return a.repartition(n, *cell).groupBy(*cell).cogroup(b.repartition(n, *cell).groupBy(*cell)).applyInArrow(run, schema)


def best_of(lk: np.ndarray, lv: np.ndarray, ln: np.ndarray, rk: np.ndarray, rv: np.ndarray, rn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left row, right row, score) of each left row's k best other keys, the first of equals; right rows are in order of key."""
    out = []
    common = np.isin(lk, rk).any()
    for a in range(0, len(lk), STEP):
        rows, names = lv[a : a + STEP], lk[a : a + STEP]
        m = len(rows)
        cos, at = np.full((m, k), -np.inf), np.full((m, k), -1)
        for b in range(0, len(rk), STEP):
            t = rows @ rv[b : b + STEP].T
            t[ln[a : a + STEP]] = NULL
            t[:, rn[b : b + STEP]] = NULL
            if common:
                t[names[:, None] == rk[None, b : b + STEP]] = -np.inf
            if b or t.shape[1] <= k:
                hit = t > (cos[:, -1] + 4e-10)[:, None]  # of equals the one that is there has the lesser key
            else:
                hit = (t >= (np.partition(t, -k, axis=1)[:, -k] - 2e-9)[:, None]) & (t > -np.inf)
            r, c = np.nonzero(hit)
            if not len(r):
                continue
            old, place = np.nonzero(at >= 0)
            row = np.concatenate([old, r])
            item = np.concatenate([at[old, place], c + b])
            score = np.concatenate([cos[old, place], round9(t[r, c])])
            o = np.lexsort((item, -score, row))
            row, item, score = row[o], item[o], score[o]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            good = rank < k
            cos[row[good], rank[good]], at[row[good], rank[good]] = score[good], item[good]
        r, c = np.nonzero(at >= 0)
        out.append((r + a, at[r, c], cos[r, c]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _sorted(t: pa.Table, key: str) -> pa.Table:
    return t.sort_by([(key, "ascending")])


def best_pairs(left: DataFrame, key: str, right: DataFrame, item: str, vector: str, k: int, on: Sequence[str] = (), same: str | None = None, others: bool = True) -> DataFrame:
    """(key, item, cos), with ``same`` also whether both sides' column of that name is equal: of each
    block the k best of each left row (of each kind), rounded to nine places, the least item of equals.

    The rows that first_by or an aggregate then takes are among them. A row's own key counts only
    without ``others``. Blocks are products of matrices; a task holds a share of each side."""
    kinds = left.schema[key].dataType.simpleString(), right.schema[item].dataType.simpleString()
    schema = f"{key} {kinds[0]}, {item} {kinds[1]}, cos double" + (", same boolean" if same else "")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [key, item, "cos", *(["same"] if same else [])]
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (a.schema.field(key).type, b.schema.field(item).type, pa.float64(), pa.bool_()))})
        a, b = _sorted(a, key), _sorted(b, item)
        lk, rk = (t.column(c).to_numpy() for t, c in ((a, key), (b, item)))
        (lv, ln), (rv, rn) = matrix(a.column(vector)), matrix(b.column(vector))
        if not others:
            lk = np.full(len(lk), object())  # nothing equals it
        found = []
        if same:
            both = pa.concat_arrays([*a.column(same).chunks, *b.column(same).chunks]).dictionary_encode().indices
            code = pc.fill_null(both, -1).to_numpy(zero_copy_only=False)
            la, lb = code[: len(lk)], code[len(lk) :]
            for x in np.unique(la):
                kinds = [(None, lb >= -1)] if x < 0 else [(True, lb == x), (False, (lb != x) & (lb >= 0)), (None, lb < 0)]
                for kind, cols in kinds:
                    i, j = np.flatnonzero(la == x), np.flatnonzero(cols)
                    if len(j):
                        r, c, s = best_of(lk[i], lv[i], ln[i], rk[j], rv[j], rn[j], k)
                        found.append((i[r], j[c], s, [kind] * len(r)))
        else:
            found.append((*best_of(lk, lv, ln, rk, rv, rn, k), []))
        r, c, s = (np.concatenate([f[i] for f in found]) for i in range(3))
        cos = pa.array(s, mask=s <= NULL)
        out = [a.column(key).take(pa.array(r)), b.column(item).take(pa.array(c)), cos]
        return pa.table([*out, *([pa.array([x for f in found for x in f[3]], pa.bool_())] if same else [])], names)

    parts = shares(left.count(), 4, 8192), shares(right.count(), 16, 8192)
    l = left.select(key, *on, vector, *([same] if same else []))  # noqa: E741
    r = right.select(item, *on, vector, *([same] if same else []))
    return by_blocks(l, key, r, item, run, schema, parts, on)


def best_items(left: DataFrame, key: str, right: DataFrame, item: str, vector: str, k: int, on: Sequence[str] = (), others: bool = True) -> DataFrame:
    """(key, item, cos): each left row's k best."""
    return first_by(best_pairs(left, key, right, item, vector, k, on, others=others), [key], [F.col("cos").desc(), F.col(item).asc()], k)


def label_statistics(rows: DataFrame, key: str, label: str, vector: str, quantile: float = 0.95) -> DataFrame:
    """(la, lb, mean, sigma, quantile, top) of the scores of all ordered pairs of different keys, by their labels.

    Scores are rounded to nine places before they are ordered. A pair is multiplied once for both
    orders; no pair is a row. Blocks count their scores in bins of each pair of labels; the bins that hold the
    quantile's two neighbours are cut into finer ones by further passes until what they hold is few, which is ordered."""
    spark = rows.sparkSession
    e = keep(rows.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(vector).alias("v")), "vectors")
    kind = e.schema["l"].dataType.simpleString()
    bound, count = e.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), F.count("*")).first()
    parts = shares(count, 16)
    bound = (bound or 0.0) * 1.000001 + 1e-9

    def tiles(a: pa.Table, b: pa.Table) -> Iterator[tuple]:
        """(pair of labels in order, scores) of all rectangles of a block."""
        if not a.num_rows or not b.num_rows:
            return
        own = a.column("_i")[0].as_py() == b.column("_j")[0].as_py()
        sides = []
        for t in (a, b):
            v, null = matrix(t.column("v"))
            label = pa.concat_arrays(t.column("l").chunks).dictionary_encode("encode")
            code = label.indices.to_numpy(zero_copy_only=False)
            names, k = label.dictionary.to_pylist(), t.column("k").to_numpy()
            side = {}
            for i, x in enumerate(names):
                at = np.flatnonzero((code == i) & ~null)
                at = at[np.argsort(k[at], kind="stable")]
                side[x] = k[at], v[at]
            sides.append(side)
        order = lambda x: (x is not None, x)
        for la, (lk, lv) in sides[0].items():
            for lb, (rk, rv) in sides[1].items():
                pair = (la, lb) if order(la) <= order(lb) else (lb, la)
                if own and pair != (la, lb):
                    continue
                for i in range(0, len(lk), STEP):
                    for j in range(i if own and la == lb else 0, len(rk), STEP):
                        s = lv[i : i + STEP] @ rv[j : j + STEP].T
                        if own:
                            other = lk[i : i + STEP, None] != rk[None, j : j + STEP]
                            s = s[np.triu(other) if la == lb and i == j else other]
                        if s.size:
                            yield pair, s

    def binned(a: pa.Table, b: pa.Table, cuts: dict, whole: bool) -> pa.Table:
        held: dict = {}
        for pair, s in tiles(a, b):
            for low, step in cuts.get(pair, ()) if cuts is not None else [(-bound, 2 * bound / BINS)]:
                h = held.setdefault((pair, low), [np.zeros(BINS, np.int64), 0, 0.0, 0.0, -np.inf])
                u = s - low
                u *= 1 / step
                if not whole:
                    u = u[(u >= 0) & (u < BINS)]
                h[0] += np.bincount(u.astype(np.intp).ravel(), minlength=BINS)  # by the bound none is outside
                if whole:
                    n, mean = s.size, float(s.mean())
                    s -= mean
                    all_, d = h[1] + n, mean - h[2]
                    h[3] += float(np.vdot(s, s)) + d * d * h[1] * n / all_
                    h[1], h[2], h[4] = all_, h[2] + d * n / all_, max(h[4], float(s.max()) + mean)
        at = {x: np.flatnonzero(h[0]) for x, h in held.items()}
        return pa.Table.from_pylist([{"la": p[0], "lb": p[1], "low": low, "n": h[1], "mean": h[2], "m2": h[3], "top": h[4], "bins": at[p, low].tolist(), "counts": h[0][at[p, low]].tolist()} for (p, low), h in held.items()], bin_kind)

    def ordered(a: pa.Table, b: pa.Table, cuts: dict) -> pa.Table:
        held: dict = {}
        for pair, s in tiles(a, b):
            for low, step in cuts.get(pair, ()):
                near = s[(s > low - step) & (s < low + 2 * step)]
                u = (near - low) * (1 / step)
                h = held.setdefault((pair, low), [])
                h.append(np.unique(round9(near[(u >= 0) & (u < 1)]), return_counts=True))
                if len(h) > 64:
                    h[:] = [merged(h)]
        both = {x: merged(h) for x, h in held.items()}
        return pa.Table.from_pylist([{"la": p[0], "lb": p[1], "low": low, "vs": v.tolist(), "ns": n.tolist()} for (p, low), (v, n) in both.items()], value_kind)

    def merged(h: list) -> tuple[np.ndarray, np.ndarray]:
        v, at = np.unique(np.concatenate([x for x, _ in h]), return_inverse=True)
        return v, np.bincount(at, np.concatenate([n for _, n in h]), len(v)).astype(np.int64)

    from pyspark.sql.pandas.types import to_arrow_type

    l_kind = to_arrow_type(e.schema["l"].dataType)
    bin_kind = pa.schema([("la", l_kind), ("lb", l_kind), ("low", pa.float64()), ("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64()), ("top", pa.float64()), ("bins", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
    value_kind = pa.schema([("la", l_kind), ("lb", l_kind), ("low", pa.float64()), ("vs", pa.list_(pa.float64())), ("ns", pa.list_(pa.int64()))])
    bin_schema = f"la {kind}, lb {kind}, low double, n long, mean double, m2 double, top double, bins array<int>, counts array<long>"
    value_schema = f"la {kind}, lb {kind}, low double, vs array<double>, ns array<long>"
    go = lambda run, schema: keep(by_blocks(e, "k", e, "k", run, schema, (parts, parts), half=True), "bins")

    def finer(cuts: dict) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda a, b: binned(a, b, cuts, False)  # by two arguments alone: a third would be taken for the key

    def counts(table: DataFrame) -> dict:
        """Bins of each (pair of labels, low end), in order: as many rows as there are pairs of labels times bins."""
        out: dict = {}
        got = table.select("la", "lb", "low", F.explode(F.arrays_zip("bins", "counts")).alias("x")).groupBy("la", "lb", "low", "x.bins").agg(F.sum("x.counts").alias("n"))
        for r in got.toLocalIterator():
            out.setdefault(((r.la, r.lb), r.low), []).append((r.bins, r.n))
        return {x: sorted(v) for x, v in out.items()}

    def place(bins: list, rank: int, base: int) -> tuple[int, int, int]:
        """(bin, rows before it, rows in it) of a rank from 0."""
        for i, n in bins:
            if rank < base + n:
                return i, base, n
            base += n
        return bins[-1][0], base - bins[-1][1], bins[-1][1]

    first = go(lambda a, b: binned(a, b, None, True), bin_schema)
    hist = counts(first)
    # each rank that is asked: (pair, 0 or 1) -> (low, step, rows before)
    ranks, at, many = {}, {}, {}
    for (pair, low), bins in hist.items():
        n, twice = sum(c for _, c in bins), pair[0] == pair[1]
        # both orders of a pair are rows of one group where the labels are equal
        where = quantile * ((2 * n if twice else n) - 1)
        for side, rank in enumerate((int(np.floor(where)), int(np.ceil(where)))):
            ranks[pair, side] = rank // 2 if twice else rank
            i, base, held = place(bins, ranks[pair, side], 0)
            at[pair, side], many[pair, side] = (low + i * (2 * bound / BINS), 2 * bound / BINS, base), held
        ranks[pair, "part"] = float(where - np.floor(where))
    while sum({(x[0], at[x][0]): n for x, n in many.items()}.values()) > VALUES and max(s for _, s, _ in at.values()) > 1e-9:
        cuts: dict = {}
        for (pair, _), (low, step, _) in at.items():
            cuts.setdefault(pair, set()).add((low, step / BINS))
        got = counts(go(finer(cuts), bin_schema))
        for x, (low, step, base) in list(at.items()):
            i, base, held = place(got[x[0], low], ranks[x], base)
            at[x], many[x] = (low + i * (step / BINS), step / BINS, base), held
    cuts = {}
    for (pair, _), (low, step, _) in at.items():
        cuts.setdefault(pair, set()).add((low, step))
    held = go(lambda a, b: ordered(a, b, cuts), value_schema)
    spots = spark.createDataFrame([(p[0], p[1], s, *at[p, s][::2], ranks[p, s], ranks[p, "part"]) for p, s in at], f"la {kind}, lb {kind}, side int, low double, base long, rank long, part double")
    same = lambda a, b: a.la.eqNullSafe(b.la) & a.lb.eqNullSafe(b.lb)
    v = held.select("la", "lb", "low", F.explode(F.arrays_zip("vs", "ns")).alias("x")).groupBy("la", "lb", "low", F.col("x.vs").alias("v")).agg(F.sum("x.ns").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("la", "lb", "low").orderBy("v")
    v = v.withColumn("end", F.sum("n").over(w)).withColumn("last", F.lead("v").over(w).isNull())
    s = spots.alias("s")
    found = v.join(s, same(v, spots) & (v.low == spots.low)).filter("(rank < base + end OR last)").groupBy(spots.la, spots.lb, "side", "part").agg(F.min("v").alias("v"))
    q = found.groupBy("la", "lb").agg((F.max_by("v", -F.col("side")) * (1 - F.max("part")) + F.max_by("v", "side") * F.max("part")).alias("q"), F.min("v").alias("a"), F.max("v").alias("b"))
    q = q.select("la", "lb", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("q")).alias("quantile"))
    one = first.groupBy("la", "lb").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    f = first.select(F.col("la").alias("_la"), F.col("lb").alias("_lb"), "n", F.col("mean").alias("_mean"), "m2", "top")
    stats = f.join(F.broadcast(one), f._la.eqNullSafe(one.la) & f._lb.eqNullSafe(one.lb)).groupBy("la", "lb", "mean", "_n").agg(F.sum(F.col("m2") + F.col("n") * (F.col("_mean") - F.col("mean")) * (F.col("_mean") - F.col("mean"))).alias("_m2"), F.round(F.max("top"), 9).alias("top"))
    both = stats.join(q.withColumnsRenamed({"la": "_la", "lb": "_lb"}), F.col("la").eqNullSafe(F.col("_la")) & F.col("lb").eqNullSafe(F.col("_lb")))
    both = both.select("la", "lb", "mean", F.sqrt(F.col("_m2") / F.col("_n")).alias("sigma"), "quantile", "top")
    both = both.unionByName(both.filter(~F.col("la").eqNullSafe(F.col("lb"))).select(F.col("lb").alias("la"), F.col("la").alias("lb"), "mean", "sigma", "quantile", "top"))
    # labels whose pairs all lack a score
    c = e.groupBy("l").agg(F.count_distinct("k").alias("n"))
    x, y = c.select(F.col("l").alias("la"), "n"), c.select(F.col("l").alias("lb"))
    all_ = x.crossJoin(y).filter("NOT (la <=> lb) OR n > 1").drop("n")
    b2 = both.withColumnsRenamed({"la": "_la", "lb": "_lb"})
    return all_.join(b2, F.col("la").eqNullSafe(F.col("_la")) & F.col("lb").eqNullSafe(F.col("_lb")), "left").drop("_la", "_lb")
