"""URL filters: rules first, then host word segmentation with naive Bayes.

Rules name a host (with all its subdomains) and a path prefix; the longest fitting rule decides.
Urls without one are judged by a multinomial naive Bayes model over words: names like
``cheappills`` are split by unigram Viterbi, paths at their separators; the last and the first part of
a host, each with the first of the path, are tokens too. Word counts of the unigram model come from
the titles and url paths of all pages.

The verdicts of the rules are the only labels; urls without a rule teach nothing. What the rules
themselves name (their hosts and paths) is no token: a model that saw it would give back the rules and
condemn all that shares a suffix or a language with them. So it learns the words of the sites that the
rules block or allow. Seed words are a prior: each adds ``SEED_COUNT`` occurrences (weak ones
``WEAK_COUNT``) to the blocked side of its own token, so labels that say otherwise outvote it. Classes
are equally likely at first, as the rules' shares say nothing about other urls; a url is blocked if its
odds are ``LEAST_ODDS`` or more.

Nothing is cut: each distinct name meets the counts of its own pieces by a join, and each distinct
url the odds of its tokens; the table of odds is broadcast while it is small. A token that the labels
never showed says nothing. Pieces are looked up to 63 letters, the longest that a host's label may be;
letters that no known word covers stay one word, however many they are.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is
allowed; without labels of both classes the seed words alone block;
repeated rows get the same verdict; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinkweave.llm.common import cut
from sinkweave.llm.pages import host_of

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Words that mark a host by themselves, and words of which it takes two.
SEEDS = frozenset("spam adult casino casinos pills bets ads adserver poker porn xxx viagra slots jackpot lottery warez torrent nude malware phishing tracker clickbait payday".split())
WEAK_SEEDS = frozenset("bet bonus cheap click crack farm free loan loans promo sex track traffic win winner".split())
#: Words that are known without having been counted.
KNOWN = SEEDS | WEAK_SEEDS | frozenset("blog book city cloud code daily data food forum game games health home info life live mail mobile music news online photo shop sport sports store tech time today travel video web wiki world".split())
LONGEST_WORD = 63
#: Occurrences on the blocked side that a seed word stands for, and a weak one.
SEED_COUNT, WEAK_COUNT = 1000, 30
#: Occurrences that every token has beside those counted.
SMOOTH = 4
#: Odds of blocking from which a url without a rule is blocked.
LEAST_ODDS = 9
#: Up to so many bytes of tokens with odds are broadcast; beyond, Spark shuffles.
BROADCAST_BYTES = 16 << 20
_PARTS = r"[a-z]+|[0-9]+|[^\x00-\x7f]+"
#: Names that are words already.
_WHOLE = ("www", "m", "com", "net", "org", "edu", "gov", "info", "co", "uk", "de", "fr", "es", "io")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    rule = verdict = None
    for name, prefix, what in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, name + prefix) if rule is None else rule.when(fits, name + prefix)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


class Segmenter:
    """Unigram Viterbi over one name."""

    def __init__(self, counts: dict[str, int], total: int):
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.base = math.log(total)

    def split(self, name: str) -> list[str]:
        """The cheapest split; a run of unknown letters costs more with each, and is one word."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        unknown = (math.inf, 0)  # cheapest begin of an unknown run, less its letters' cost
        for end in range(1, len(name) + 1):
            unknown = min(unknown, (best[end - 1][0] - 2.3 * (end - 1), end - 1))
            known = [(best[start][0] + self.cost[name[start:end]], start) for start in range(max(0, end - LONGEST_WORD), end) if name[start:end] in self.cost]
            best.append(min(known + [(unknown[0] + self.base + 2.3 * end, unknown[1])]))
        out, end = [], len(name)
        while end:
            out.append(name[best[end][1] : end])
            end = best[end][1]
        return out[::-1]


def unigrams(pages: DataFrame) -> tuple[DataFrame, int]:
    """(w, n), the counts of all words of titles and paths and of the known words, and their sum. Hosts
    don't count: their names are what is to be split."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>([^<]*)", 1)
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", title, path_of(F.col("url")))), F.lit("[a-z]{2,}"), F.lit(0))
    counted = cut(pages.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "url-words")
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    usual = max(1, total // 1000)
    known = pages.sparkSession.createDataFrame([(w, usual) for w in sorted(KNOWN)], "w string, n long")
    return counted.unionByName(known).groupBy("w").agg(F.max("n").alias("n")), total + usual * len(KNOWN) + 1


def segments(names: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """``names(name)``, distinct -> (name, split): each name meets the counts of its own pieces."""
    at = F.sequence(F.lit(1), F.length("name"))
    pieces = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - i + 1)), lambda n: F.substring(F.col("name"), i, n))))
    met = names.select("name", F.explode(F.array_distinct(pieces)).alias("w")).join(words, "w").groupBy("name").agg(F.collect_list(F.struct("w", "n")).alias("counts"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for own, counts in batches:
            yield pd.Series([Segmenter({} if c is None else {x["w"]: x["n"] for x in c}, total).split(n) for n, c in zip(own, counts)], dtype="object")

    return names.join(met, "name", "left").select("name", F.pandas_udf(run, "array<string>")("name", "counts").alias("split"))


def host_words(hosts: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """``hosts(host)``, distinct -> (host, word): all words of each host; numbers by their length."""
    parts = hosts.select("host", F.explode(F.regexp_extract_all("host", F.lit(_PARTS), F.lit(0))).alias("name"))
    named = parts.filter(F.col("name").rlike("^[a-z]") & ~F.col("name").isin(*_WHOLE))
    split = segments(named.select("name").distinct(), words, total)
    whole = parts.filter(~(F.col("name").rlike("^[a-z]") | F.col("name").isin(*_WHOLE))).select("host", _number("name").alias("word"))
    return named.join(split, "name").select("host", F.explode("split").alias("word")).unionByName(whole)


def _number(part: str) -> Column:
    return F.when(F.col(part).rlike("^[0-9]"), F.concat(F.lit("#"), F.least(F.length(part), F.lit(9)))).otherwise(F.col(part))


def distinct_urls(keyed: DataFrame, rules=RULES) -> DataFrame:
    """``keyed(host, path)`` -> host, path, n (pages), rule, said (the rule's verdict)."""
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    return keyed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).select("host", "path", "n", rule.alias("rule"), verdict.alias("said"))


def _named(rules) -> tuple[list[str], list[str]]:
    """What the rules name: words of hosts, parts of paths."""
    return sorted({w for host, _, _ in rules for w in host.split(".")}), sorted({part for _, path, _ in rules for part in path.strip("/").split("/") if part})


def url_tokens(urls: DataFrame, words: DataFrame, total: int, rules=RULES) -> DataFrame:
    """(host, path, n, said, token) of every url, but for what rules name."""
    hosts_named, parts_named = _named(rules)
    own = cut(host_words(urls.select("host").distinct(), words, total), "url-hosts").filter(~F.col("word").isin(*hosts_named))
    every = F.regexp_extract_all(F.lower("path"), F.lit(_PARTS), F.lit(0))
    parts = urls.select("host", "path", "n", "said", F.filter(every, lambda p: ~p.isin(*parts_named)).alias("parts")) if parts_named else urls.select("host", "path", "n", "said", every.alias("parts"))
    paths = parts.select("host", "path", "n", "said", F.explode("parts").alias("part")).select("host", "path", "n", "said", F.concat(F.lit("p:"), _number("part")).alias("token"))
    first = parts.select("*", F.get("parts", F.lit(0)).alias("first")).filter("first is not null and host <> ''")
    front = F.regexp_extract("host", "^[^.]*", 0)
    pairs = first.select("host", "path", "n", "said", F.concat(F.lit("f:"), front, F.lit("/"), F.when(F.col("first").rlike("^[0-9]"), F.lit("#")).otherwise(F.col("first"))).alias("token"))
    hosts = urls.join(own, "host").select("host", "path", "n", "said", F.concat(F.lit("h:"), "word").alias("token"))
    return hosts.unionByName(paths).unionByName(pairs)


def train(tokens: DataFrame, seeds=SEEDS, weak=WEAK_SEEDS) -> DataFrame:
    """``tokens(host, token, blocked)`` -> (token, odds) of those that labels or the prior have seen.

    A host counts once for a token and side: its pages don't witness for each other. Each token has
    ``SMOOTH`` occurrences more, parted as the sides part all tokens, so what is seen rarely says little
    and the sides' sizes say nothing."""
    once = tokens.groupBy("token", "host", "blocked").agg(F.count(F.lit(1)).alias("n"))
    both = cut(once.groupBy("token").agg(F.sum("blocked").cast("long").alias("bad"), F.sum(1 - F.col("blocked")).cast("long").alias("good")), "url-counts")
    sums = both.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    share = (sums["bad"] + 1) / (sums["bad"] + sums["good"] + 2)
    prior = [(f"h:{w}", SEED_COUNT, 0) for w in sorted(seeds)] + [(f"h:{w}", WEAK_COUNT, 0) for w in sorted(weak)]
    if prior:
        both = both.unionByName(tokens.sparkSession.createDataFrame(prior, "token string, bad long, good long"))
    odds = F.log((F.col("bad") + F.lit(SMOOTH * share)) / (F.col("good") + F.lit(SMOOTH * (1 - share))) * F.lit((1 - share) / share))
    return cut(both.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).select("token", odds.alias("odds")), "url-odds")


def scored(urls: DataFrame, words: DataFrame, total: int, fold: Column | None = None, seeds=SEEDS, weak=WEAK_SEEDS, rules=RULES) -> DataFrame:
    """host, path, rule, said, score of distinct urls; those that ``fold`` names teach nothing."""
    urls = cut(urls, "url-distinct")
    blocked = (F.col("said") == "block").cast("int")
    blocked = blocked if fold is None else F.when(~fold, blocked)
    tokens = cut(url_tokens(urls, words, total, rules).withColumn("blocked", blocked), "url-tokens")
    odds = train(tokens.filter("blocked is not null"), seeds, weak)
    size = odds.agg(F.sum(F.octet_length("token") + 64).alias("n")).first()["n"] or 0
    sums = tokens.join(F.broadcast(odds) if size <= BROADCAST_BYTES else odds, "token").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    return urls.join(sums, ["host", "path"], "left").select("host", "path", "rule", "said", F.coalesce("odds", F.lit(0.0)).alias("score"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict; and score, the log odds of blocking."""
    keyed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = scored(distinct_urls(keyed, rules), *unigrams(pages), rules=rules)
    return keyed.join(known, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= math.log(LEAST_ODDS), "block").otherwise("allow")).alias("verdict"), "score")
