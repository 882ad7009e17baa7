"""Operator 8: URL filters by host word segmentation and naive Bayes.

1. Host and path are cut from the URL, and rules (host with its subdomains,
   path prefix; the longest fitting rule wins) are judged, with DataFrame
   functions.
2. Words that stand between separators are counted over all URLs, for the
   unigram model. Each distinct label of a host is joined with the counts of
   the words it contains, and a Viterbi search splits it into the likeliest.
3. Multinomial naive Bayes scores host words and path tokens. Its weights are
   learnt from all URLs by expectation maximisation, which starts from a small
   seed of labelled names: in each round all sites are scored, and tokens are
   counted anew by how likely their sites are to be blocked.

Nothing that grows with the table is broadcast or collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarmesh.llm.shared import materialise

#: The seed from which learning starts, words parted by blanks: kinds of sites that general blocklists name, and kinds that they don't. A parameter of `judge`.
BLOCKED_SEED = [
    "online casino", "poker bonus", "slots jackpot", "lucky spin", "gambling odds", "sports bets", "lottery prize", "viagra pills", "cialis pills", "weight loss pills",
    "pharmacy discount", "porn tube", "xxx video", "sex cams", "nude adult", "escort dating", "payday loan", "fast cash", "crypto profit", "get rich",
    "replica watches", "fake bags", "crack warez", "keygen torrent", "pirate download", "click ads", "popup ads", "banner ads", "link farm", "seo spam",
    "buy followers", "malware exe", "phishing login", "free money", "win prize", "track pixel",
]
ALLOWED_SEED = [
    "daily news", "local weather", "city library", "open science", "school math", "river history", "art museum", "garden plants", "travel guide", "health clinic",
    "cook book", "music notes", "film review", "sports team", "football club", "car repair", "home design", "book store", "coffee shop", "green energy",
    "ocean research", "polar ice", "space agency", "public radio", "world atlas", "law journal", "technical docs", "software blog", "data wiki", "university press",
    "nature park", "bird watch", "food market", "photo album", "bike tour", "family tree",
]
#: What all words of the URLs weigh together in the unigram model, beside 100 for each word of the seed.
CORPUS_SHARE = 10_000
#: Words meet labels by their first letters, so many at most; longer ones are then looked for whole.
HEAD = 63
#: Letters of a label that one row of its substrings is cut from.
WINDOW = 1000
#: So many tokens are told of each side before any site is, in the shares that they have on all sites: what stands on few sites says little.
SITE_PRIOR = 2.0


class Segmenter:
    """Splits a name into words of a unigram model; unknown words cost more the longer they are."""

    def __init__(self, counts: dict[str, float], mass: float | None = None):
        self.counts, self.lengths = counts, {len(w) for w in counts}
        self.total = math.log((sum(counts.values()) if mass is None else mass) + 1)

    def split(self, name: str, more: dict[str, float] | None = None) -> list[str]:
        """The likeliest words of `name`, counts of `more` being added; of equally likely splits, the one with the longest last word."""
        more = more or {}
        count = lambda w: self.counts.get(w, 0) + more.get(w, 0)
        lengths = sorted(self.lengths | {len(w) for w in more})
        best: list[tuple[float, int]] = [(0.0, 0)]
        # an unknown word costs 4 + 2.5 a letter, so its best start is the same for all ends
        unknown, least = 0, 0.0
        for end in range(1, len(name) + 1):
            options = [(best[unknown][0] + self.total + 4 + 2.5 * (end - unknown), unknown)]
            for n in lengths:
                if n > end:
                    break
                known = count(name[end - n : end])
                if known:
                    options.append((best[end - n][0] + self.total - math.log(known), end - n))
            best.append(min(options))
            if best[end][0] - 2.5 * end < least:
                unknown, least = end, best[end][0] - 2.5 * end
        out, end = [], len(name)
        while end:
            start = best[end][1]
            out.append(name[start:end])
            end = start
        out.reverse()
        # letters that no word explains stand as one token
        merged: list[str] = []
        for word in out:
            if merged and not count(word) and not count(merged[-1]):
                merged[-1] += word
            else:
                merged.append(word)
        return merged


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or one without `://`."""
    url = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules (such as `net/a`) whose host is this host or a parent of it and whose path starts this path; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def word_counts(pages: DataFrame) -> DataFrame:
    """Words of two letters and more between separators of hosts with a hyphen, and of paths, counted over all URLs (host, path): word, count."""
    text = F.lower(F.concat_ws(" ", F.when(F.col("host").contains("-"), F.col("host")), "path"))
    return pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 2).groupBy("word").count()


def segmented(labels: DataFrame, words: DataFrame, total: int, seed: dict[str, float], mass: float) -> DataFrame:
    """The words of each distinct label: label, tokens. Labels meet the counts of the words they contain by a join on their substrings.

    A word that was seen counts 1, and a share of CORPUS_SHARE that is its
    share of all URLs' words: a table of the same URLs many times over splits
    names alike. A label's substrings stand in rows of their own beside its
    number, so that their size is the label's length times that of a word.
    """
    labels = materialise(labels.withColumn("id", F.monotonically_increasing_id()), "numbered-labels")
    starts = F.sequence(F.lit(1), F.greatest(F.length("label"), F.lit(1)), F.lit(WINDOW))
    pieces = labels.select("id", F.explode(F.transform(starts, lambda at: F.substring("label", at, F.lit(WINDOW + HEAD - 1)))).alias("piece"))
    pieces = pieces.select("id", "piece", F.explode(F.sequence(F.lit(1), F.least(F.greatest(F.length("piece"), F.lit(1)), F.lit(WINDOW)))).alias("at"))
    # only substrings as long as words are (or as the first letters of longer ones)
    sizes = [r[0] for r in words.select(F.least(F.length("word"), F.lit(HEAD))).distinct().collect()]
    fits = F.filter(F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>"), lambda n: n <= F.length("piece") - F.col("at") + 1)
    heads = pieces.select("id", F.explode(F.transform(fits, lambda n: F.substring("piece", F.col("at"), n))).alias("head")).distinct()
    weighed = words.select("word", F.substring("word", 1, HEAD).alias("head"), (1 + CORPUS_SHARE * F.col("count") / total).alias("count"))
    found = heads.join(weighed, "head").select("id", "word", "count")
    short = F.length("word") <= HEAD
    long = found.where(~short).join(labels, "id").where(F.contains("label", "word")).select("id", "word", "count")
    held = found.where(short).unionByName(long).groupBy("id").agg(F.collect_list(F.struct("word", "count")).alias("words"))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = Segmenter(seed, mass=mass)
        for frame in frames:
            own = [{w["word"]: w["count"] for w in (ws if ws is not None else ())} for ws in frame["words"]]
            yield pd.DataFrame({"label": frame["label"], "tokens": [segmenter.split(x, more) for x, more in zip(frame["label"], own, strict=True)]})

    return labels.join(held, "id", "left").select("label", "words").mapInPandas(split, "label string, tokens array<string>")


def learn(sites: DataFrame, blocked: list[str], allowed: list[str], rounds: int = 2, blocked_share: float = 0.1, smoothing: float = 0.1) -> tuple[DataFrame, float]:
    """Weights (token, weight) by expectation maximisation over `sites` (site, token, n: how often), and the prior log odds.

    A token's share of a side's tokens is smoothed by an equal share for all
    tokens, of `smoothing` together. Weights are log ratios of the sides'
    shares: first of the names of the seed, then of the mean of those and of
    the sites' tokens, each counted by how likely its site is blocked, with
    SITE_PRIOR tokens told beforehand. The prior begins with `blocked_share`,
    then is the mean likelihood of the sites and of one site of that share.
    """
    spark = sites.sparkSession
    tally: dict[str, list[float]] = {}
    for side, names in enumerate((blocked, allowed)):
        for name in names:
            for token in name.split():
                tally.setdefault(token, [0.0, 0.0])[side] += 1
    seed = spark.createDataFrame([(t, b, a) for t, (b, a) in sorted(tally.items())], "token string, seed_b double, seed_a double")

    def weights(counts: DataFrame, kinds: list[str]) -> DataFrame:
        columns = [f"{kind}_{side}" for kind in kinds for side in "ba"]
        counts = materialise(counts.select("token", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns]), "token-counts")
        n, *sums = counts.agg(F.count("*"), *[F.sum(c) for c in columns]).first()
        sums = dict(zip(columns, sums, strict=True))
        shares = {}
        for kind in kinds:
            told = SITE_PRIOR if kind == "site" else 0.0
            both = ((sums[f"{kind}_b"] or 0.0) + (sums[f"{kind}_a"] or 0.0)) or 1.0
            for side in "ba":
                c = f"{kind}_{side}"
                shares[c] = (F.col(c) + told * (F.col(f"{kind}_b") + F.col(f"{kind}_a")) / both) / (((sums[c] or 0.0) + told) or 1.0) + smoothing / max(1, n)
        side = lambda x: sum((shares[f"{kind}_{x}"] for kind in kinds), F.lit(0.0))
        return counts.select("token", (F.log(side("b")) - F.log(side("a"))).alias("weight"))

    now, prior = weights(seed, ["seed"]), math.log(blocked_share / (1 - blocked_share))
    for _ in range(rounds):
        chance = materialise(log_odds(sites, now, prior).select("site", (1 / (1 + F.exp(-F.col("log_odds")))).alias("p")), "chances")
        likely, n = chance.agg(F.sum("p"), F.count("*")).first()
        if not n:
            break
        found = sites.join(chance, "site").groupBy("token").agg(F.sum(F.col("n") * F.col("p")).alias("site_b"), F.sum(F.col("n") * (1 - F.col("p"))).alias("site_a"))
        now, prior = weights(seed.join(found, "token", "full"), ["seed", "site"]), math.log((likely + blocked_share) / (n - likely + 1 - blocked_share))
    return now, prior


def log_odds(sites: DataFrame, weights: DataFrame, prior: float) -> DataFrame:
    """The log odds of block against allow of each site: site, log_odds."""
    return sites.join(weights, "token", "left").groupBy("site").agg((F.lit(prior) + F.coalesce(F.sum(F.col("n") * F.col("weight")), F.lit(0.0))).alias("log_odds"))


def judge(pages: DataFrame, rules: dict[str, str], blocked: list[str] | None = None, allowed: list[str] | None = None, id_col: str = "page_id", url_col: str = "url", rounds: int = 2, salts: int = 64) -> DataFrame:
    """One row for each row of `pages`: page_id, host, path, rule, verdict, log_odds, tokens.

    The verdict is the fitting rule's, else `block` if the Bayes model's log
    odds are above 0, else `allow` (so an empty host without path words, or a
    tie, is allowed). A site is a host with the words of a path, in order;
    letters of any script make words, case is ignored, all else separates.
    Null ids and urls are kept; repeated rows give a row each; other columns
    are dropped; an empty table gives an empty result. Sites come back to
    their pages by (site, salt): one with more than a `salts`-th of all pages
    (there are fewer than `salts`) is dealt to `salts` tasks, others aren't
    repeated.
    """
    blocked, allowed = blocked or BLOCKED_SEED, allowed or ALLOWED_SEED
    host, path = url_parts(F.col("url"))
    letters = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda x: x != "")
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("labels", letters(F.col("host"))).withColumn("words", letters(F.col("path")))
    parts = parts.withColumn("site", F.concat_ws("/", F.array_join("labels", "."), F.array_join("words", "/")))

    words = materialise(word_counts(parts), "words")
    total = words.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] or 1
    counts = {}
    for name in (*blocked, *allowed):
        for word in name.split():
            counts[word] = counts.get(word, 0) + 100
    known = materialise(parts.groupBy("site", "labels", "words").agg(F.count("*").alias("pages")), "sites")
    every = known.agg(F.sum("pages")).first()[0] or 0
    hot = [r[0] for r in known.where(F.col("pages") * salts > every).select(F.xxhash64("site")).collect()]  # fewer than `salts`
    labels = known.select(F.explode("labels").alias("label")).distinct()
    split = materialise(segmented(labels, words, total, counts, CORPUS_SHARE + sum(counts.values())), "labels")
    by_label = known.select("site", F.posexplode("labels").alias("at", "label")).join(split, "label")
    own = by_label.groupBy("site").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"])).alias("host_tokens"))
    tokens = materialise(known.join(own, "site", "left").select("site", F.concat(F.coalesce("host_tokens", F.array().cast("array<string>")), "words").alias("tokens")), "site-tokens")
    counted = materialise(tokens.select("site", F.explode("tokens").alias("token")).groupBy("site", "token").agg(F.count("*").alias("n")), "site-counts")
    weights, prior = learn(counted, blocked, allowed, rounds)
    scored = materialise(tokens.join(log_odds(counted, weights, prior), "site", "left").select("site", "tokens", F.coalesce("log_odds", F.lit(prior)).alias("log_odds")), "sites-scored")

    is_hot = F.xxhash64("site").isin(hot) if hot else F.lit(False)
    dealt = scored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, salts - 1).otherwise(0))))
    salted = parts.select("page_id", "host", "path", "site").withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int")).otherwise(0))
    out = salted.join(dealt, ["site", "salt"]).withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    by_rule = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]) if rules else F.create_map().cast("map<string,string>")
    return out.withColumn("verdict", F.coalesce(F.try_element_at(by_rule, F.col("rule")), F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow")))).select("page_id", "host", "path", "rule", "verdict", "log_odds", "tokens")
