"""Licence scan: ordered signature rules behind keywords. DataFrame functions only.

Texts that may hold a keyword at all are brought to lower-case words; each
keyword that is there brings its rules, whose matches become intervals of words.
An interval inside another of the same or a higher priority is suppressed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiweave.llm._spark import stored
from lexiweave.llm.license_rules import LINES

#: Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Confidence of a detection by priority.
CONFIDENCE = {3: 1.0, 2: 0.85, 1: 0.5}
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def required(pattern: str, keyword: str) -> str:
    """Words that every match of the pattern holds in a row: the keyword if they have it, else the longest such row."""
    plain = re.sub(r"\( [^()]*\)\?", " #", pattern.lstrip("=~"))
    plain = re.sub(r"\S+ \?\S+", "#", re.sub(r"\([^()]*\)\??", "#", plain))
    runs: list[list[str]] = [[]]
    for word in plain.split():
        if re.fullmatch(r"[a-z0-9]+", word):
            runs[-1].append(word)
        else:
            runs.append([])
    if any(f" {keyword} " in f" {' '.join(run)} " for run in runs):
        return keyword
    return " ".join(max(runs, key=lambda run: len(" ".join(run))))


def rules() -> list[tuple[int, str, str, int, str]]:
    """(number, label, keyword, priority, pattern over words with a space on either side of each)."""
    out = []
    for line in LINES.splitlines():
        label, keyword, *patterns = (x.strip() for x in line.split(" | "))
        for p in patterns:
            priority = 3 if p[0] == "=" else 1 if p[0] == "~" else 2
            # between two words there are two spaces; ` ?` makes the gap itself optional
            words = "(?:  )?".join(part.replace(" ", "  ") for part in p.lstrip("=~").split(" ?"))
            out.append((len(out), label, required(p, keyword), priority, f" {words} "))
    return out


def normal(text: Column) -> Column:
    """Lower-case words, each with a space on either side."""
    lower = F.translate(text, _UP, _LOW)
    return F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(lower, _APART, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))


def _count(normalised: Column) -> Column:
    """Words of a normalised string."""
    return F.floor((F.length(normalised) - F.length(F.replace(normalised, F.lit(" "), F.lit("")))) / 2).cast("long")


def triggers() -> list[str]:
    """What a text must hold for any rule to fit, all the words of one of them: `licen` where a pattern can't do without, else the keyword."""
    out = set()
    for line in LINES.splitlines():
        _, keyword, *patterns = (x.strip() for x in line.split(" | "))
        out.update("licen" if "licen" in re.sub(r"\([^()]*\)\??", "", p) else required(p, keyword) for p in patterns)
    return sorted(out)


def _gate(text: Column) -> Column:
    """Whether some trigger may be in the text: plain substring tests, before anything is cut up."""

    def any_(low: Column) -> Column:
        held = F.lit(False)
        for t in triggers():
            every = F.lit(True)
            for word in t.split():
                every = every & F.contains(low, F.lit(word))
            if " " in t and max(map(len, t.split())) < 4:  # such words are within others in most texts
                every = every & F.rlike(low, F.lit(_APART.join(t.split())))
            held = held | every
        return held

    return F.exists(F.array(F.lower(text)), any_)  # as an element, the lower-case text is made once


def detections(texts: DataFrame, spark: SparkSession) -> DataFrame:
    """(key columns, rule, label, priority, start, end) of the detections that stand, start and end counted in words. texts: k1, k2, text."""
    table = rules()
    keywords = sorted({r[2] for r in table})
    rows = spark.createDataFrame(table, "rule int, label string, keyword string, priority int, pattern string")
    spaced = F.array(*[F.lit("  ".join(k.split())) for k in keywords])
    plain = spark.createDataFrame([("  ".join(k.split()), k) for k in keywords], "spaced string, keyword string")
    gated = texts.where(_gate(F.col("text"))).dropDuplicates(["k1", "k2"]).select("k1", "k2", normal(F.col("text")).alias("words"))
    asked = gated.withColumn("spaced", F.explode(F.filter(spaced, lambda k: F.contains("words", F.concat(F.lit(" "), k, F.lit(" "))))))
    paired = asked.join(F.broadcast(plain.join(rows, "keyword").drop("keyword")), "spaced")  # as many rules as are listed here
    found = paired.withColumn("pieces", F.split("words", F.col("pattern"), -1)).where(F.size("pieces") > 1)
    zipped = F.arrays_zip(F.col("pieces"), F.regexp_extract_all("words", F.col("pattern"), F.lit(0)).alias("matches"))
    each = found.select("k1", "k2", "rule", "label", "priority", F.posexplode(F.slice(zipped, 1, F.size("pieces") - 1)).alias("k", "m"))
    sized = each.select("k1", "k2", "rule", "label", "priority", "k", _count(F.col("m.pieces")).alias("gap"), _count(F.col("m.matches")).alias("n"))
    along = Window.partitionBy("k1", "k2", "rule").orderBy("k")
    spans = sized.repartition("k1", "k2").withColumn("end", F.sum(F.col("gap") + F.col("n")).over(along)).withColumn("start", F.col("end") - F.col("n"))
    before = Window.partitionBy("k1", "k2").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    for p in (1, 2, 3):
        spans = spans.withColumn(f"reach{p}", F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before))
    reach = F.when(F.col("priority") == 3, F.col("reach3")).when(F.col("priority") == 2, F.col("reach2")).otherwise(F.col("reach1"))
    return spans.where(F.coalesce(reach < F.col("end"), F.lit(True))).select("k1", "k2", "rule", "label", "priority", "start", "end")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with columns n_words, n_base, first_word, last_word, base_labels, labels and score added (or replaced).

    Words are runs of ASCII letters and digits and of all non-ASCII, A-Z in
    lower case. n_base counts the places of the BASE phrases, first_word and
    last_word are their least and largest start (words from 0), null if there is
    none. labels joins the base labels and those of the detections that stand,
    sorted; score is the largest confidence of any (1 for a base phrase), 0 for
    none. Null texts count as empty: no words, no labels, score 0. Repeated rows
    get the same result; other columns stay; an empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    k1, k2 = F.xxhash64(whole), F.octet_length(whole)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), whole.alias("__text"))
    # every base phrase ends with this word
    listed = base.withColumn("__list", F.when(F.contains(F.lower("__text"), F.lit("license")), F.split(F.trim(F.regexp_replace(F.translate("__text", _UP, _LOW), _APART, " ")), " ")))
    w = F.col("__list")

    def starts(i: Column) -> Column:
        any_ = F.lit(False)
        for phrase in BASE:
            fits = F.lit(True)
            for k, word in enumerate(phrase.split()):
                fits = fits & (F.coalesce(F.get(w, i + k), F.lit("")) == word)
            any_ = any_ | fits
        return any_

    placed = listed.withColumn("__at", F.when(w.isNotNull(), F.filter(F.sequence(F.lit(0), F.size(w) - 1), starts)))
    first_words = F.create_map(*[F.lit(x) for phrase, label in BASE.items() for x in (phrase.split()[0], label)])
    named = F.sort_array(F.array_distinct(F.transform("__at", lambda i: F.element_at(first_words, F.get(w, i)))))
    main = placed.select(
        "__row", F.xxhash64("__text").alias("k1"), F.octet_length("__text").alias("k2"),
        F.regexp_count("__text", F.lit(_WORD)).cast("long").alias("n_words"),
        F.coalesce(F.size("__at"), F.lit(0)).cast("long").alias("n_base"),
        F.get("__at", F.lit(0)).cast("long").alias("first_word"),
        F.get("__at", F.size("__at") - 1).cast("long").alias("last_word"),
        F.coalesce(named, F.array().cast("array<string>")).alias("base"),
    )
    main = main.withColumn("n_base", F.greatest("n_base", F.lit(0).cast("long")))
    kept = detections(docs.select(k1.alias("k1"), k2.alias("k2"), whole.alias("text")), docs.sparkSession)
    confidence = F.lit(0.0)
    for p, c in CONFIDENCE.items():
        confidence = F.when(F.col("priority") == p, F.lit(c)).otherwise(confidence)
    # stored, so that its size is known to the join, which may split large groups of one text
    by_text = stored(kept.groupBy("k1", "k2").agg(F.collect_set("label").alias("found"), F.max(confidence).alias("sure")))
    out = main.join(by_text, ["k1", "k2"], "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce("sure", F.lit(0.0)))
    return out.select("__row.*", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
