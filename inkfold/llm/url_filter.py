"""URL filter: rules on host and path, then logistic regression on hashed character trigrams.

Scoring is DataFrame functions only. A trigram of code points (a, b, c) of the
bracketed host or path has the bucket (961 a + 31 b + c) mod ``BUCKETS``, with a
separate table for each of the two. Weights are integers (micro-units), so a score
is an exact sum in any order. They are fitted on the driver from the small labelled
table below, by plain batch gradient steps from zero: the same weights every time.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
Path: from there up to ``?``, ``#`` or the end. A null url or one without ``://`` has
both empty and is judged by the method's intercept alone. A rule fits its host and
all subdomains when the path starts with the rule's path; the longest rule wins.
Empty tables give empty results; repeated rows and rows without page_id are judged
each; a very long url is judged whole; other columns of any name are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

# The labelled URL table (host, then path).
BLOCKED = """
cheap-pills.example.com/en/12 casino-win.example.net/en/9.html free-bets.example.com/es/77/ adult-x.example.net/fr/5
spam-farm.example.com/en/304 ads-track.example.net/en/41 www.cheap-pills.shop/buy/now blog.casino-win.site/play
m.free-bets.live/today/odds www.adult-x.club/videos/1 spam-farm.biz/links/99 ads-track.click/pixel/3
online-casino.example.com/bonus/1 poker-bets.example.net/join casino-slots.example.org/spin/2 best-pills.example.com/order/8
cheap-meds.example.net/pills/3 adult-cams.example.com/live xxx-adult.example.net/7 link-farm.example.com/a/1
ad-tracker.example.net/c/4 track-ads.example.com/r/1 sport-bets.example.com/odds/3 win-casino.example.com/jackpot
pills-cheap.example.org/rx free-casino.example.net/en/3 betting-win.example.com/5 spam-links.example.net/page/4
""".split()
ALLOWED = """
tionsh.example.net/en/35 blog.tionble.example.com/en/7 m.ththed.example.net/fr/39 www.therou.example.org/de/3.html
ththing.example.com/en/32732 ththnd.example.net/es/46 m.therly.example.net/en/373 blog.therhe.example.com/fr/20
library.example.org/books/12 www.university.example.com/courses/math news.example.net/world/2021/05 docs.example.com/guide/install
museum.example.net/collection/7 weather.example.com/forecast/london recipes.example.net/bread/3 www.city-council.example.org/minutes/4
history.example.com/articles/rome science.example.net/physics/quantum health.example.org/advice/sleep journal.example.com/vol/3/issue/2
blog.gardening.example.net/roses/5 school.example.com/lessons/9 maps.example.net/route/11 open-data.example.com/sets/8
theron.example.com/en/434 ththon.example.com/es/15 www.ththou.example.net/de/54 m.thernt.example.net/en/9/
""".split()


def _grams(text: str, shift: int) -> list[int]:
    c = [ord(x) for x in f"^{text}$"]
    return [shift + (961 * x + 31 * y + z) % BUCKETS for x, y, z in zip(c, c[1:], c[2:])]


def grams_of(url: str) -> list[int]:
    host, _, path = url.partition("/")
    return _grams(host, 0) + _grams("/" + path, BUCKETS)


@lru_cache(maxsize=1)
def fitted() -> tuple[int, tuple[int, ...]]:
    """:func:`train` on the whole labelled table."""
    return train(BLOCKED, ALLOWED)


def train(blocked: list[str], allowed: list[str], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """(intercept, weights) in micro-units; a positive sum means block."""
    rows = [(grams_of(u), y) for urls, y in ((blocked, 1.0), (allowed, 0.0)) for u in urls]
    w, bias = [0.0] * (2 * BUCKETS), 0.0
    for _ in range(rounds):
        grad: dict[int, float] = {}
        off = 0.0
        for grams, y in rows:
            e = 1 / (1 + math.exp(-bias - sum(w[g] for g in grams))) - y
            off += e
            for g in grams:
                grad[g] = grad.get(g, 0.0) + e
        bias -= rate * off / len(rows)
        for g, d in grad.items():
            w[g] -= rate * (d / len(rows) + decay * w[g])
    return round(bias * 1e6), tuple(round(x * 1e6) for x in w)


def _sum_of_weights(text: Column, shift: int, weights: Column) -> Column:
    codes = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c))
    at = lambda i: F.element_at(codes, i)
    bucket = lambda i: (961 * at(i) + 31 * at(i + 1) + at(i + 2)) % BUCKETS
    spots = F.when(F.size(codes) > 2, F.sequence(F.lit(1), F.size(codes) - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(spots, F.lit(0).cast("long"), lambda s, i: s + F.element_at(weights, bucket(i) + 1 + shift))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (micro-units of log odds) for every row of ``pages`` (page_id, url)."""
    rules = RULES if rules is None else rules
    bias, weights = fitted()
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<long>")
    host, path = split_url(F.col("url"))
    df = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rule = F.lit(None).cast("string")
    said = F.lit(None).cast("string")
    for r in sorted(rules, key=len):  # the longest is looked at first, as it wraps the others
        name, _, start = r.partition("/")
        fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit("/" + start))
        rule, said = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(rules[r])).otherwise(said)
    score = F.lit(bias) + _sum_of_weights(F.col("host"), 0, table) + _sum_of_weights(F.col("path"), BUCKETS, table)
    df = df.withColumn("rule", rule).withColumn("said", said).withColumn("score", score.cast("long"))
    return df.select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score",
    )


def sql() -> str:
    """DuckDB SQL for :func:`judge_urls` with the default rules."""
    bias, weights = fitted()

    def total(col: str, shift: int) -> str:
        text = f"('^' || {col} || '$')"
        at = lambda k: f"unicode(substr({text}, i + {k}, 1))"
        return (
            f"coalesce(list_sum(list_transform(range(1, length({text}) - 1), "
            f"lambda i: w[1 + {shift} + (961 * {at(0)} + 31 * {at(1)} + {at(2)}) % {BUCKETS}])), 0)"
        )

    cases = ""
    verdicts = ""
    for r in sorted(RULES, key=len, reverse=True):
        name, _, start = r.partition("/")
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN "
        cases += f"{fits}'{r}' "
        verdicts += f"{fits}'{RULES[r]}' "
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT b.*, CASE {cases} END AS rule, CASE {verdicts} END AS said, [{', '.join(map(str, weights))}] AS w FROM b),
d AS (SELECT *, CAST({bias} + {total('host', 0)} + {total('path', BUCKETS)} AS BIGINT) AS score FROM c)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score FROM d
"""
