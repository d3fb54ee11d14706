"""URL filter: listed rules, and a logistic regression where no rule fits.

The features are hashed character n-grams of host and path; the model is trained
from the small labelled table below, or one that the caller gives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hosts and paths of each label; the training table is every host with a path.
BLOCKED = """
casino-royal.com/play casino-win.net/slots online-casino.org/bonus best-casino.example.com/en/10
free-bets.com/odds sport-bets.example.net/de/7 live-betting.org/match bet-now.com/en/99
poker-chips.com/room slots-jackpot.net/spin lucky-jackpot.com/win roulette-win.example.com/fr/3
adult-x.com/videos adult-chat.example.net/en/12 xxx-movies.com/watch sexcams.example.com/live
hot-porn.net/clip porn-tube.example.org/en/5 nude-cams.com/room escort-girls.org/city
spam-farm.com/links spam-offers.example.com/en/8 link-farm.net/page seo-links.org/buy
ads-track.com/pixel adserver.example.com/click track-ads.net/r popup-ads.example.org/en/4
banner-ads.com/show click-tracker.net/c affiliate-track.com/go ad-network.org/serve
cheap-pills.com/buy viagra-shop.net/order pharma-pills.example.com/en/2 weight-loss-pills.org/deal
free-download-crack.com/keygen warez-site.net/serial cracked-games.org/torrent torrent-warez.com/get
phish-login.com/verify account-verify.net/login secure-bank-update.com/signin paypa1-login.org/confirm
malware-host.com/exe trojan-drop.net/payload virus-scan-alert.com/warning hacked-accounts.org/list
payday-loans.com/apply fast-cash.net/loan get-rich-quick.org/now crypto-doubler.com/invest
fake-watches.com/replica replica-bags.net/cheap click-bait.com/shock win-prize.net/claim
m.casino-club.org/en/21 www.free-casino.com/de/6 blog.spam-news.net/fr/9 www.adult-site.org/es/1
adult-x.example.com/en/31 www.adult-content.example.org/fr/12 spam-farm.example.com/en/208 m.spam-blog.example.net/de/40
ads-track.example.com/en/7 m.ads-network.example.org/en/93 blog.casino-win.example.com/en/500 casino.example.org/es/8
free-bets.example.com/fr/61 cheap-pills.example.com/en/19 www.cheap-meds.example.org/en/4 payday-loan.example.org/en/3
malware.example.com/en/77 phishing.example.org/en/15 www.porn.example.com/de/9 warez.example.org/en/260
m.ads-click.com/en/17 www.bets-online.net/en/40 m.spam-mail.org/en/71 blog.ads-farm.com/en/52
""".split()
ALLOWED = """
city-library.org/books public-library.example.com/en/10 university.edu/course www.school.org/class
news-daily.com/world morning-news.example.net/de/7 weather.org/forecast radio-station.com/program
garden-tips.com/roses blog.gardening.example.net/en/12 recipes.com/soup cooking-at-home.example.com/fr/3
open-source.org/project docs.python.org/library docs.example.org/en/5 wiki.example.com/article
museum.org/exhibition history-museum.example.com/en/8 art-gallery.net/painting music-school.org/piano
science-journal.org/paper research.example.com/en/4 physics-lab.edu/report biology.example.org/de/2
hospital.org/services health-ministry.gov/advice city-council.gov/minutes parliament.gov/debate
train-times.com/route travel-guide.com/rome hiking-trails.org/map mountain-club.example.net/es/6
book-shop.com/novel bike-repair.net/manual furniture.com/table camera-review.org/lens
football-club.com/match chess-club.org/opening running.example.com/en/40 swimming.example.org/fr/9
blog.example.com/post www.example.org/about m.example.net/contact forum.example.com/thread
www.thester.example.com/en/1234 m.andthe.example.org/de/77 blog.thering.example.net/fr/501 theand.example.com/es/9
www.therin.example.org/en/3120 m.theraton.example.com/en/8841 blog.ionther.example.org/en/64 ingther.example.com/de/4410
www.ththed.example.com/en/15.html m.tionand.example.org/en/23/ thtion.example.com/fr/777 blog.anthe.example.com/en/2500
tionre.example.org/en/900 m.thonly.example.com/de/31 www.ththis.example.org/es/45 shwhat.example.com/en/6
m.edthin.example.com/en/310 blog.whther.example.org/de/82 www.onthat.example.com/fr/19 erthan.example.org/en/5512
""".split()
TABLE = [(x, 1) for x in BLOCKED] + [(x, 0) for x in ALLOWED]


def host_of(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, with its verdict; of equal length the first. Null: none."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda x: -len(x[0])):
        at, slash, rest = rule.partition("/")
        own = (host == at) | F.endswith(host, F.lit("." + at))
        hit = own & F.startswith(path, F.lit(slash + rest))
        fits.append(F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fits, none)


def features(host: str, path: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the character n-grams of three to five signs, host and path apart."""
    out = []
    for mark, part in (("h", f"^{host}$"), ("p", f"{path}$")):
        raw = part.encode()
        tag = mark.encode()
        for n in (3, 4, 5):
            out += [crc32(tag + raw[i : i + n]) % buckets for i in range(len(raw) - n + 1)]
    return np.unique(np.array(out, np.int64))


def fit(table: Sequence[tuple[str, int]], buckets: int = BUCKETS, decay: float = 2e-4, steps: int = 800) -> np.ndarray:
    """Weights of the regression; the last one is the constant."""
    rows = [features(*(u.partition("/")[0], "/" + u.partition("/")[2]), buckets) for u, _ in table]
    used = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
    x = np.zeros((len(rows), len(used) + 1))
    for k, at in enumerate(rows):
        x[k, np.searchsorted(used, at)] = 1 / np.sqrt(max(len(at), 1))
    x[:, -1] = 1
    y = np.array([label for _, label in table], float)
    w = np.zeros(len(used) + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 4.0 * (x.T @ (p - y) / len(y) + decay * np.append(w[:-1], 0))
    out = np.zeros(buckets + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def block_score(host: Column, path: Column, weights: np.ndarray) -> Column:
    """Probability that the URL is to be blocked."""
    buckets = len(weights) - 1

    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        out = np.empty(len(hosts))
        for k, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            at = features(h, p, buckets)
            out[k] = weights[at].sum() / np.sqrt(max(len(at), 1)) + weights[-1]
        return pd.Series(1 / (1 + np.exp(-out)))

    return F.pandas_udf(score, "double")(host, path)


def url_verdicts(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    table: Sequence[tuple[str, int]] = TABLE,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    A null url, or one without `://`, has an empty host and path: no rule fits and
    the verdict is the model's. Repeated rows are judged alike; an empty table
    gives an empty result; other columns are not looked at. Of rules of equal length
    the first listed wins, and a score at the threshold blocks. Long addresses are
    judged whole.
    """
    weights = fit(table)
    rows = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("score", block_score(F.col("host"), F.col("path"), weights))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), own).alias("verdict"),
        "score",
    )
