"""URL filters: rules by host and path, and a classifier over the words of hosts and paths."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introngrid.llm.words import encoded, slices
from introngrid.storage import materialize

#: Rules (host and path, verdict) of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words whose presence as a segmented word labels a URL as one to block, for the classifier's training.
SEEDS = (
    "ads", "adserver", "adult", "adverts", "bets", "betting", "casino", "cialis", "clickbait", "doorway", "dating", "escort", "fetish", "gambling", "hentai", "jackpot",
    "linkfarm", "lottery", "malware", "nude", "payday", "phishing", "pills", "poker", "popunder", "porn", "scam", "sex", "slots", "spam", "torrent", "tracker", "viagra", "warez", "xxx",
)
#: Longest word of the unigram model; share of all words that each seed counts as at least; pseudo-words of a class.
LONGEST, SEED_SHARE, PRIOR_WORDS = 24, 1e-4, 1000.0
#: Distinct words that a worker adds up before it hands them on.
HELD = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters lower-cased; what is above ASCII stays, so that a word with such letters is seen as one; all else parts words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without '://'."""
    known = F.coalesce(url, F.lit(""))
    at = F.locate("://", known)
    rest = F.when(at > 0, F.substring(known, at + 3, F.length(known))).otherwise("")
    part = lambda k: F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), UPPER, LOWER), part(2)


def longest_rule(host: Column, path: Column, rules) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent of it and the start of the path, else null; of equally long ones that with the longer host."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"))):
        name, begin = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """Rows (word, n): words of a-z, case folded, outside of tags, over all rows; longer words than LONGEST aren't counted."""
    tag = re.compile(rb"<[^>]*>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()
        give = lambda: pd.DataFrame([(w.decode(), n) for w, n in held.items() if w.isascii() and len(w) <= LONGEST], columns=["word", "n"])
        for part in slices(frames):
            for text in part["text"]:
                held.update(tag.sub(b" ", encoded(text)).translate(LETTERS).split())
                if len(held) > HELD:
                    yield give()
                    held.clear()
        yield give()

    return texts.select(F.col(column).alias("text")).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segment(run: str, words: list[tuple[int, int, int]], total: float) -> list[str]:
    """The likeliest split of run by Viterbi: words are (start, length, count); other stretches of l letters have probability 10 / (total 10^l).

    Of equally likely splits the one whose last word is longer is taken, and so on towards the front.
    """
    costs = {(s, s + n): math.log(total / c) for s, n, c in words}
    best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for start in range(max(0, end - LONGEST), end):
            cost = best[start] + costs.get((start, end), math.log(total / 10) + (end - start) * math.log(10))
            if cost < best[end] - 1e-9:
                best[end], back[end] = cost, start
    out, at = [], len(run)
    while at:
        out.append(run[back[at] : at])
        at = back[at]
    return out[::-1]


def segmented(runs: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """Rows (run, words) for distinct runs of letters: their substrings that are words of counts meet there by a join, so no list of words is held anywhere."""
    size = F.length("run")
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), size)).alias("s"))
    parts = starts.select("run", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - F.col("s") + 1))).alias("l"))
    found = parts.select("run", "s", "l", F.expr("substring(run, s, l)").alias("word")).join(counts, "word")
    listed = found.groupBy("run").agg(F.collect_list(F.struct(F.col("s") - 1, "l", "n")).alias("found"))
    every = runs.join(listed, "run", "left").select("run", "found")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = [[] if x is None else [tuple(w.values()) if isinstance(w, dict) else tuple(w) for w in x] for x in frame["found"]]
            yield pd.DataFrame({"run": frame["run"], "words": [segment(r, w, total) for r, w in zip(frame["run"], lists, strict=True)]})

    return every.mapInPandas(split, "run string, words array<string>")


def judge_urls(pages: DataFrame, rules=RULES, seeds=SEEDS, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    The longest fitting rule decides; rules are a short list (they become one expression).
    Elsewhere a multinomial naive Bayes over the words of host and path decides: block if
    its log odds, `score`, are above 0. Words are runs of a-z, split by unigram Viterbi with
    the counts of all page texts (seeds count as SEED_SHARE of them at least); any number is
    the word 0; runs above ASCII stay whole. Case is folded. The classifier learns from all
    rows: those with a seed among their words are the class to block, the others the class
    to allow; each class is smoothed by PRIOR_WORDS words spread as in both, so words that
    one class has not met weigh alike whatever the classes' sizes.

    Work is done once for each distinct sequence of runs. Null URLs and those without '://'
    have an empty host and path and are allowed; repeated rows and null ids stay; an empty
    table gives no rows; without any seed met, all else is allowed. Null texts count no words.
    """
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    runs = F.regexp_extract_all(F.translate(F.concat("host", "path"), UPPER, LOWER), F.lit(r"[a-z]+|[0-9]+|[^\x00-\x7F]+"), F.lit(0))
    parts = parts.withColumn("shape", F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), "0").otherwise(x)), " "))
    shapes = materialize(parts.groupBy("shape").agg(F.count("*").alias("n")), "shapes")
    exploded = shapes.select("shape", "n", F.explode(F.split("shape", " ")).alias("run")).where("run <> ''")

    counts = materialize(word_counts(pages, text_col), "word-counts")
    total = float(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) or 1.0
    seed_rows = counts.sparkSession.createDataFrame([(s, max(1, int(SEED_SHARE * total))) for s in seeds], "word string, n long")
    counts = counts.unionByName(seed_rows).groupBy("word").agg(F.max("n").alias("n"))
    words = materialize(segmented(exploded.select("run").where("run RLIKE '^[a-z]'").distinct(), counts, total), "segmented")

    spelled = exploded.join(words, "run", "left").withColumn("words", F.coalesce("words", F.array("run")))
    seeded = F.arrays_overlap("words", F.array(*map(F.lit, seeds)))
    known = materialize(spelled.groupBy("shape").agg(F.first("n").alias("n"), F.max(seeded).alias("bad"), F.flatten(F.collect_list("words")).alias("words")), "spelled")
    each = known.select("shape", F.explode("words").alias("word"), F.when(F.col("bad"), F.col("n")).otherwise(0).alias("b"), F.when(F.col("bad"), 0).otherwise(F.col("n")).alias("a"))
    table = materialize(each.groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "class-counts")
    in_b, in_a = (int(x or 0) for x in table.agg(F.sum("b"), F.sum("a")).first())
    urls_b, urls_a = (int(x or 0) for x in known.agg(F.sum(F.when(F.col("bad"), F.col("n"))), F.sum(F.when(~F.col("bad"), F.col("n")))).first())
    prior = math.log((urls_b + 1) / (urls_a + 1))
    share = (F.col("a") + F.col("b")) / max(in_a + in_b, 1) * PRIOR_WORDS
    odds = F.log((F.col("b") + share) / (in_b + PRIOR_WORDS)) - F.log((F.col("a") + share) / (in_a + PRIOR_WORDS))
    scores = each.select("shape", "word").join(table.select("word", odds.alias("odds")), "word").groupBy("shape").agg(F.round(F.sum("odds") + prior, 9).alias("score"))

    judged = parts.join(scores, "shape", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
