"""URL filters: explicit rules first, then logistic regression on hashed character n-grams of host and path.

Defined cases: a null url or one without `://` has an empty host and path and gets the model's verdict; very long urls
are read whole; repeated rows are judged alike, and equal urls whatever their ids; of rules that fit the longest wins,
and of equally long ones the later; a score of just the threshold blocks; an empty table gives an empty result; only
the id and url columns are read, whatever else the table has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, prefix_hashes, span_hashes

#: (pattern of host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# A small labelled table, a parameter of train(): invented hosts and paths, 1 is a URL to block. Either label comes with
# the same endings, so that what stands before them has to tell.
FRONTS = ("", "www.", "m.", "blog.", "news.")
ENDINGS = ("com", "org", "net", "io", "info", "co.uk", "de", "fr", "es")
TO_BLOCK = (
    "casino-bonus", "free-spins-slots", "poker-jackpot", "bet-now-odds", "lucky-casino-win", "cheap-tablets-pills", "pharma-discount-meds", "viagra-online-store", "weight-loss-miracle", "xxx-clips", "hot-adult-cams", "sexy-singles-dating", "porn-videos-free",
    "payday-loans-fast", "best-loans-now", "get-rich-quick", "win-free-money", "crypto-doubler", "bitcoin-giveaway", "spam-link-farm", "link-farm-seo", "buy-backlinks", "cracked-software", "keygen-warez", "torrent-free-movies", "replica-watches", "fake-handbags-outlet", "click-here-prize", "popup-ads-network", "adult-webcam-x", "ad-click-tracker",
)
TO_ALLOW = (
    "docs.garden", "blog.river", "news.harbour", "library.city", "museum-of-history", "university-press", "open-science-journal", "weather-report", "cooking-with-herbs", "mountain-hiking", "school-physics", "local-council", "railway-timetable", "public-health-advice",
    "encyclopedia", "wiki.astronomy", "code-review-notes", "python-tutorial", "music-theory", "film-archive", "poetry-review", "farmers-market", "botanical-society", "language-learning", "maps.geography", "daily-gazette", "parliament-records", "chess-club", "wetherby", "thornton-mill", "hathersage", "others-stories", "eastern-star", "anderson", "reading-room", "northing", "southend", "rethinking", "elmsworth", "lindenthal", "harrowgate", "thistledown", "marwell", "attenborough", "ingleby", "heathered", "tension-study", "ablett",
)
BLOCKED_PATHS = ("", "bonus/sign-up-now", "promo/buy-now.php", "free/download/crack.exe", "win/prize?id=7", "xxx/1.html", "cheap/order-online", "click/offer")
ALLOWED_PATHS = ("", "articles/history.html", "2021/05/on-rivers", "about/contact", "docs/install.html", "wiki/Main_Page", "catalogue/item?id=7", "blog/post-12")


def labelled_urls(hosts: Iterable[str], paths: tuple[str, ...], label: int, every: int = 4) -> list[tuple[str, int]]:
    """Each host behind and under `every` fronts and endings, each time with the next path."""
    return [(f"https://{FRONTS[(i + 2 * j) % len(FRONTS)]}{host}.{ENDINGS[(i + j) % len(ENDINGS)]}/{paths[(i * every + j) % len(paths)]}", label) for i, host in enumerate(hosts) for j in range(every)]


LABELLED = tuple(labelled_urls(TO_BLOCK, BLOCKED_PATHS, 1) + labelled_urls(TO_ALLOW, ALLOWED_PATHS, 0))
#: Feature slots; a labelled table may have at most MOST_LABELLED rows, as training holds rows x slots on the driver.
SLOTS, SIZES, MOST_LABELLED = 1 << 12, (3, 4, 5), 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> Column:
    """A struct of the longest rule that fits host and path, or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # later ones are longer and win
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def ngram_slots(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature slot of every character n-gram; host and path n-grams have slots apart."""
    rows, slots = [], []
    for salt, texts in ((1, hosts), (2, paths)):
        raw = [b"^" + t.encode() + b"$" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        row = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
        sums = prefix_hashes(data)
        for n in SIZES:
            at = np.arange(max(0, len(data) - n + 1))
            at = at[row[at] == row[at + n - 1]] if len(at) else at
            rows.append(row[at])
            slots.append(mix(span_hashes(sums, at, at + n) + np.uint64(salt)) % np.uint64(SLOTS))
    return np.concatenate(rows), np.concatenate(slots).astype(np.int64)


def _split(url: str | None) -> tuple[str, str]:
    rest = url.partition("://")[2] if url else ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    end = min((i for i in (rest.find(c, cut) for c in "?#") if i >= 0), default=len(rest))
    return rest[:cut].translate(str.maketrans(UPPER, LOWER)), rest[cut:end]


def train(labelled: Iterable[tuple[str, int]] = LABELLED, rounds: int = 30, ridge: float = 3e-4) -> np.ndarray:
    """Weights of SLOTS features and, last, the bias: ridge logistic regression on a labelled table of at most
    MOST_LABELLED rows, by Newton steps on one coefficient for each row (weights are sums of the rows so weighed)."""
    labelled = list(labelled)
    if not 0 < len(labelled) <= MOST_LABELLED:
        raise ValueError(f"the labelled table needs 1 to {MOST_LABELLED} rows")
    hosts, paths = zip(*(_split(u) for u, _ in labelled), strict=True)
    row, slot = ngram_slots(list(hosts), list(paths))
    x = np.zeros((len(labelled), SLOTS))
    np.add.at(x, (row, slot), 1.0)
    x /= np.maximum(1, np.linalg.norm(x, axis=1, keepdims=True))
    x = np.hstack([x, np.ones((len(x), 1))])
    y, near, row_weights = np.array([v for _, v in labelled], float), x @ x.T, np.zeros(len(labelled))
    for _ in range(rounds):
        f = near @ row_weights
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        d = np.maximum(p * (1 - p), 1e-9)
        row_weights = np.linalg.solve(near + np.diag(ridge * len(y) / d), f + (y - p) / d)
    return x.T @ row_weights


def url_verdicts(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, labelled: Iterable[tuple[str, int]] = LABELLED, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """page id, host, path, rule, verdict and the model's score (of every url, also where a rule decides).

    One scan without a shuffle: hosts and rules are expressions; the model's 32 KB of weights go with the task.
    """
    weights = train(labelled)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in parts:
            row, slot = ngram_slots(list(host), list(path))
            pair, count = np.unique(row * SLOTS + slot, return_counts=True)
            r = pair // SLOTS
            dot = np.bincount(r, weights[pair % SLOTS] * count, minlength=len(host))
            norm = np.sqrt(np.bincount(r, count.astype(float) ** 2, minlength=len(host)))
            yield pd.Series(1 / (1 + np.exp(-(dot / np.maximum(1, norm) + weights[SLOTS]))))

    url = F.col(f"`{url_col}`")
    found = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = found.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", score("host", "path"))
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), "score")
