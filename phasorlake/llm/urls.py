"""URL filters: host and path rules, and logistic regression on hashed character n-grams.

The model is trained on the labelled table below each time a filter is made: full-batch
gradient steps in numpy from zero, so every run has the same weights. Its
features are the hashed 3- to 5-grams of the host and of the path, host and path apart,
each row scaled to unit length.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, GRAMS, STEPS, RATE, DECAY = 1 << 14, (3, 4, 5), 400, 8.0, 1e-3
#: Rules as host and start of the path, and verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Invented URLs by label.
GOOD = """
https://www.cityarchive.org/records/1911/letters.html
https://blog.greenkitchen.net/posts/bread-with-rye
https://docs.openmodel.dev/guide/install
https://news.rivertown.com/en/2021/05/bridge-opens
https://m.weatherpages.net/en/forecast?day=2
https://museum.example.edu/collection/item/204
https://en.travelnotes.info/articles/alps-on-foot
https://journal.mathsoc.org/vol12/paper7
https://library.uni.edu/catalogue/search?q=history
https://www.gardenersweb.net/plants/roses/pruning
http://forum.cyclists.net/threads/gears-for-hills
https://api.datahub.io/reference/tables
https://health.gov.example/advice/sleep
https://schools.county.gov/calendar/2022
https://wiki.chessclub.net/openings/english
https://www.localpaper.com/fr/culture/theatre
https://science.daily.net/en/853/
https://essays.writers.org/on-walking
https://recipes.oldmill.com/soups/leek
https://www.trainfans.net/de/strecken/harz
https://blog.engineer.io/2020/queues-explained
https://stories.readers.net/es/cuentos/el-rio
https://support.printers.com/en/manuals/model-8
https://static.maps.org/tiles/about
""".split()
BAD = """
http://casino-bonus-777.win/free-spins-now
http://best-pills-online.biz/buy-cheap-meds
http://win-big-casino.top/jackpot/bonus?ref=888
https://free-porn-xxx.club/videos/hot
http://xxx-cam-girls.live/sexy/chat
http://click-track.ads-server.biz/banner?id=33918
http://adserver.popups.click/track?cid=9921
http://loan-fast-cash.info/payday/apply-now
http://cheap-replica-watches.shop/rolex-sale
http://torrent-crack-keygen.ru/download/serial
http://free-download-warez.cc/full-crack
http://hot-singles-dating.xyz/meet-now
http://crypto-double-profit.top/invest-now
http://viagra-cialis-rx.biz/order-cheap
http://slot-machine-spins.bet/casino/poker
http://bet365-bonus-odds.bet/betting/win
http://phish-login-verify.tk/account/secure-update
http://seo-backlinks-cheap.biz/buy-links
http://win-iphone-prize.click/claim?ref=spam
http://mega-porn-tube.xxx/sex/movies
http://fake-diploma-buy.biz/cheap-degree
http://spam-mailer.top/unsubscribe?track=1
http://popunder-ads.biz/adclick?cid=77
http://escort-girls-sexy.club/book-now
""".split()


def host_of(url: str | None) -> tuple[str, str]:
    """Host, its A-Z lower-cased, and path; both empty without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode().lower().decode(), path


def features(host: str, path: str) -> np.ndarray:
    """Places of a URL's n-grams, repeats included; each of the two parts has an edge mark at both ends."""
    out = []
    for kind, part in (("h", host), ("p", path.encode().lower().decode())):
        if part:
            text = f"^{part}$"
            out += [crc32(f"{kind}{text[i : i + n]}".encode()) % BUCKETS for n in GRAMS for i in range(len(text) - n + 1)]
    return np.array(out, np.int64)


def _scaled(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(places, return_counts=True)
    return at, n / max(1.0, np.sqrt((n * n).sum()))


class Model:
    """Weights and bias; ``score`` is the probability that a URL is unwanted."""

    def __init__(self, good: list[str] = GOOD, bad: list[str] = BAD):
        x = np.zeros((len(good) + len(bad), BUCKETS))
        for r, url in enumerate([*good, *bad]):
            at, v = _scaled(features(*host_of(url)))
            x[r, at] = v
        y = np.r_[np.zeros(len(good)), np.ones(len(bad))]
        self.w, self.b = np.zeros(BUCKETS), 0.0
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-(x @ self.w + self.b)))
            self.w -= RATE * (x.T @ (p - y) / len(y) + DECAY * self.w)
            self.b -= RATE * float((p - y).mean())

    def score(self, host: str, path: str) -> float:
        at, v = _scaled(features(host, path))
        return float(1 / (1 + np.exp(-(self.w[at] @ v + self.b))))


def parts(url: Column) -> tuple[Column, Column]:
    """host and path as native expressions."""
    rest = F.regexp_replace(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit("")), r"(?s)[?#].*$", "")
    rest = F.coalesce(rest, F.lit(""))
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substr(rest, F.lit(1), slash - 1)).otherwise(rest)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, F.when(slash > 0, F.substr(rest, slash)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule whose host is the host or above it and whose path starts the path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: float = 0.5) -> DataFrame:
    """page_id, host, path, the rule that fits (or null), verdict, and ``score`` of the model.

    A rule decides where one fits; else the model blocks a URL whose score is over
    ``limit``. A null url, or one without ``://``, has an empty host and path; no rule
    fits and it is allowed, as there is nothing to judge. Repeated rows are judged
    each. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    model = Model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(h, p) if h or p else 0.0 for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    host, path = parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    scored = rows.mapInArrow(run, "page_id long, host string, path string, score double")
    fit = rule_of(F.col("host"), F.col("path"), rules)
    return scored.withColumn("fit", fit).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("score") > limit, "block").otherwise("allow")).alias("verdict"), "score"
    )
