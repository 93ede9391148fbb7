"""Near-enough dispatch: rules held as bundles, flat or in bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from phasorlake.operators.structures import unit_profile_arrays
from phasorlake.plans import BROADCAST, first_by
from phasorlake.space import Space, bind, bundle, cleanup, codebook, pair, similarity, unbind


def unit_profiles(space: Space, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, j, re, im): letter trigram profiles of norm 1. A text without a trigram has no rows, and is not routed."""
    packed = unit_profile_arrays(space, rows, key, text)
    return packed.select(key, F.posexplode(F.arrays_zip("re", "im")).alias("j", "v")).select(key, "j", "v.re", "v.im")


def dispatch_matrix(space: Space, rules: DataFrame, inputs: DataFrame, key: str, threshold: float | None = None) -> DataFrame:
    """(key, rule, action, score): the rule of the best cosine; action is null (an abstention) below the threshold. Rules are (rule, condition, action).

    A rule book up to BROADCAST bytes of profiles goes to the tasks, which multiply blocks
    of inputs with it; a larger one is joined by component."""
    book = unit_profile_arrays(space, rules, "rule", "condition")
    if rules.count() * space.dim * 16 <= BROADCAST:
        s = _best_rules(unit_profile_arrays(space, inputs, key, "text"), book, key, inputs.schema[key].dataType.simpleString(), rules.schema["rule"].dataType.simpleString())
        best = s.join(rules.select("rule", "action"), "rule")
    else:
        c = unit_profiles(space, rules, "rule", "condition").withColumnsRenamed({"re": "bre", "im": "bim"})
        s = similarity(unit_profiles(space, inputs, key, "text"), c, [key, "rule"], space.dim).withColumn("score", F.col("score") * F.lit(float(space.dim)))
        best = first_by(s, [key], [F.round("score", 9).desc(), F.col("rule").asc()]).join(rules.select("rule", "action"), "rule")
    action = F.col("action") if threshold is None else F.when(F.col("score") >= threshold, F.col("action"))
    return best.select(key, "rule", action.alias("action"), "score")


def _best_rules(inputs: DataFrame, book: DataFrame, key: str, key_type: str, rule_type: str) -> DataFrame:
    kind = to_arrow_type(book.schema["rule"].dataType)
    rows = sorted(book.collect(), key=lambda r: r["rule"])
    names, matrix = [r["rule"] for r in rows], np.array([[*r["re"], *r["im"]] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
                if not len(names):
                    continue
                q = np.hstack([part.column(i).flatten().to_numpy().reshape(part.num_rows, -1) for i in (1, 2)])
                score = q @ matrix.T
                at = np.round(score, 9).argmax(1)  # the first of equals has the least rule
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([names[i] for i in at], kind), pa.array(score[np.arange(len(at)), at])], [key, "rule", "score"])

    return inputs.mapInArrow(run, f"{key} {key_type}, rule {rule_type}, score double")


def rule_bundle(space: Space, rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """sum of condition profiles bound to action codewords."""
    c = unit_profiles(space, rules, "rule", "condition").join(rules.select("rule", "action", *by), "rule")
    t = space.theta(F.col("action").cast("string"), F.col("j"))
    re, im = bind(pair(), (F.cos(t), F.sin(t)))
    return bundle(c, by, re, im)


def dispatch_bundle(space: Space, memory: DataFrame, actions: DataFrame, inputs: DataFrame, key: str, threshold: float | None = None) -> DataFrame:
    """(key, action, score) by unbinding the input from the bundle."""
    q = unit_profiles(space, inputs, key, "text").withColumnsRenamed({"re": "q_re", "im": "q_im"})
    re, im = unbind(pair(), pair("q_re", "q_im"))
    out = cleanup(q.join(memory, "j").select(key, "j", re.alias("re"), im.alias("im")), codebook(space, actions, "action"), [key], space.dim)
    label = F.col("label") if threshold is None else F.when(F.col("score") >= threshold, F.col("label"))
    return out.select(key, label.alias("action"), "score")


def banded(rules: DataFrame, bands: int) -> DataFrame:
    return rules.withColumn("band", F.pmod(F.col("rule"), F.lit(bands)))


def dispatch_banded(space: Space, rules: DataFrame, inputs: DataFrame, key: str, top: int, threshold: float | None = None) -> DataFrame:
    """(key, band, action, score): the ``top`` bands whose centre is nearest are read, the best label wins. Rules have a band."""
    memory = rule_bundle(space, rules, ("band",))
    c = unit_profiles(space, rules, "rule", "condition").join(rules.select("rule", "band"), "rule")
    centre = c.groupBy("band", "j").agg(F.avg("re").alias("bre"), F.avg("im").alias("bim"))
    q = unit_profiles(space, inputs, key, "text")
    near = similarity(q, centre, [key, "band"], space.dim)
    asked = first_by(near, [key], [F.round(F.abs("score"), 9).desc(), F.col("band").asc()], top).select(key, "band")
    qs = q.withColumnsRenamed({"re": "q_re", "im": "q_im"}).join(asked, key).join(memory, ["band", "j"])
    re, im = unbind(pair(), pair("q_re", "q_im"))
    each = cleanup(qs.select(key, "band", "j", re.alias("re"), im.alias("im")), codebook(space, rules, "action"), [key, "band"], space.dim)
    best = first_by(each, [key], [F.round("score", 9).desc(), F.col("band").asc()])
    label = F.col("label") if threshold is None else F.when(F.col("score") >= threshold, F.col("label"))
    return best.select(key, "band", label.alias("action"), "score")


def clustered(space: Space, rules: DataFrame, bands: int, rounds: int = 8) -> DataFrame:
    """Rules with a band by spherical k-means on their profiles: one row of numbers for each rule of the book."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    p = unit_profiles(space, rules, "rule", "condition")
    packed = p.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("j", "re", "im"))).alias("_v"))
    packed = packed.select("rule", array_to_vector(F.flatten(F.transform("_v", lambda x: F.array(x["re"], x["im"])))).alias("features"))
    model = KMeans(k=bands, seed=1, maxIter=rounds, distanceMeasure="cosine").fit(packed)
    return rules.join(model.transform(packed).select("rule", F.col("prediction").alias("band")), "rule")
