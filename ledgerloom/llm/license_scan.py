"""License statements in texts by ordered signature rules, with DataFrame functions only.

A rule is a regular expression over a text's words (lower-cased, joined by blanks), a label, a priority and a keyword. A
text is scanned by a rule only if it holds the rule's keyword. A detection inside the interval of another one of higher
priority is suppressed, and so is one inside an interval of its own priority that is longer or stems from an earlier rule.

The rules are wordings times families: ``RULES`` is built from the two tables below.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import landed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: some word of every keyword, on raw text: what does not match this is not scanned
GATE = r"(?i)licen[cs]|copyright|spdx|gpl|domain|reserved|redistribut|copyleft|commons|cc0|warranty|wtfpl|eula|mpl|bsd|hereby"

# Phrases and labels of the base.
BASE = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

# Label, name of the license as a pattern over words. Longer names stand before names they hold.
FAMILIES = (
    ("mit", "mit"), ("mit-0", "mit no attribution"), ("x11", "x11"), ("isc", "isc"), ("zlib", "zlib(?: libpng)?"), ("boost", "boost software"),
    ("apache-2.0", "apache(?: software)?(?: license)? (?:version )?2(?: 0)?"), ("apache-1.1", "apache(?: software)?(?: license)? (?:version )?1 1"),
    ("apache", "apache(?: software)?"), ("bsd-2-clause", "(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause"),
    ("bsd-3-clause", "(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause"), ("bsd-4-clause", "(?:original|4 clause|four clause) bsd|bsd 4 clause"),
    ("bsd", "bsd"), ("gpl-2.0", "(?:gnu )?(?:gpl|general public license)(?: license)? (?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "(?:gnu )?(?:gpl|general public license)(?: license)? (?:version |v)?3(?: 0)?"),
    ("lgpl-2.1", "(?:gnu )?(?:lgpl|lesser general public license)(?: license)? (?:version |v)?2(?: 1)?"),
    ("lgpl-3.0", "(?:gnu )?(?:lgpl|lesser general public license)(?: license)? (?:version |v)?3(?: 0)?"),
    ("agpl-3.0", "(?:gnu )?(?:agpl|affero general public license)(?: license)? (?:version |v)?3(?: 0)?"),
    ("agpl", "(?:gnu )?(?:agpl|affero general public)"), ("lgpl", "(?:gnu )?(?:lgpl|(?:lesser|library) general public)"), ("gpl", "(?:gnu )?(?:gpl|general public)"),
    ("fdl", "(?:gnu )?free documentation"), ("mpl-2.0", "(?:mozilla public|mpl)(?: license)? (?:version )?2(?: 0)?"), ("mpl-1.1", "(?:mozilla public|mpl)(?: license)? (?:version )?1 1"),
    ("mpl", "mozilla public|mpl"), ("epl-2.0", "eclipse public(?: license)? (?:version |v )?2(?: 0)?"), ("epl-1.0", "eclipse public(?: license)? (?:version |v )?1(?: 0)?"), ("epl", "eclipse public"),
    ("edl", "eclipse distribution"), ("cddl", "common development and distribution"), ("cpl", "common public"), ("eupl", "european union public"),
    ("osl", "open software"), ("afl", "academic free"), ("artistic-2.0", "artistic(?: license)? 2(?: 0)?"), ("artistic", "artistic"), ("python", "python software foundation|psf"),
    ("php", "php"), ("ruby", "ruby"), ("perl", "perl"), ("openssl", "openssl"), ("unicode", "unicode"), ("postgresql", "postgresql"), ("ofl", "(?:sil )?open font"), ("w3c", "w3c"),
    ("odbl", "open database"), ("odc-by", "open data commons attribution"), ("pddl", "public domain dedication and"), ("ms-pl", "microsoft public"), ("ms-rl", "microsoft reciprocal"),
    ("cc-by-nc-nd-4.0", "(?:cc|creative commons) (?:by nc nd|attribution noncommercial noderivatives) 4(?: 0)?(?: international)?"),
    ("cc-by-nc-sa-4.0", "(?:cc|creative commons) (?:by nc sa|attribution noncommercial sharealike) 4(?: 0)?(?: international)?"),
    ("cc-by-nc-4.0", "(?:cc|creative commons) (?:by nc|attribution noncommercial) 4(?: 0)?(?: international)?"),
    ("cc-by-sa-4.0", "(?:cc|creative commons) (?:by sa|attribution sharealike) 4(?: 0)?(?: international)?"),
    ("cc-by-nd-4.0", "(?:cc|creative commons) (?:by nd|attribution noderivatives) 4(?: 0)?(?: international)?"),
    ("cc-by-4.0", "(?:cc|creative commons) (?:by|attribution) 4(?: 0)?(?: international)?"), ("cc-by-sa-3.0", "(?:cc|creative commons) (?:by sa|attribution sharealike) 3(?: 0)?"),
    ("cc-by-3.0", "(?:cc|creative commons) (?:by|attribution) 3(?: 0)?"), ("cc0-1.0", "cc0(?: 1(?: 0)?)?"), ("cc", "creative commons(?: attribution)?"),
    ("unlicense", "unlicense"), ("wtfpl", "wtfpl|do what the fuck you want to public"),
)
# Wording around a name, keyword of the wording, priority.
WORDINGS = (
    ("(?:is |are )?licensed under (?:the )?(?:terms of (?:the )?)?(?:{})(?: licen[cs]e)?", "licensed", 3),
    ("(?:released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:{}) licen[cs]e", "license", 3),
    ("spdx license identifier (?:{})", "spdx", 3),
    ("(?:{}) licen[cs]e (?:version |v)[0-9]+(?: [0-9]+)?", "license", 2),
    ("licen[cs]e (?:{})", "license", 2),
    ("(?:{}) licen[cs]ed?", "license", 1),
)
# Label, pattern, keyword (a word that the pattern requires), priority of statements that name no license.
STATEMENTS = (
    ("copyright", "copyright(?: c)?(?: [0-9]{4})?", "copyright", 1), ("all-rights-reserved", "all rights reserved", "reserved", 2),
    ("public-domain", "(?:released into|in|dedicated to) the public domain", "domain", 2),
    ("no-warranty", "without warranty of any kind", "warranty", 1), ("bsd", "redistribution and use in source and binary forms", "redistribution", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby", 2), ("copyleft", "copyleft", "copyleft", 1),
)


def name_words(name: str) -> list[str]:
    """Words of which a text that matches the pattern of a name holds one: the longest of each of its alternatives."""
    plain = re.sub(r"\(\?:[^()]*\)\?", " ", re.sub(r"\(\?:[^()]*\)\?", " ", name))
    found = set()
    for part in re.findall(r"(?:\([^()]*\)|[^|()])+", plain):
        group = re.search(r"\(\?:([^()]*)\)", part)
        words = [re.findall("[a-z0-9]+", x) for x in (group[1].split("|") if group else [part])]
        found |= {max(w, key=len) for w in words if w}
    return sorted(found)


RULES = [
    (number, label, priority, keyword, f"(?<= )(?:{pattern})(?= )", names)
    for number, (label, pattern, keyword, priority, names) in enumerate(itertools.chain(
        ((label, wording.format(name), keyword, priority, name_words(name)) for (wording, keyword, priority), (label, name) in itertools.product(WORDINGS, FAMILIES)),
        ((*statement, [statement[2]]) for statement in STATEMENTS),
    ))
]
WEIGHT = {1: 0.6, 2: 0.8, 3: 0.95}


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(RAW_WORD)), F.lit(0)).cast("bigint")


def base_places() -> Column:
    """Start words of the base phrases in the array column ``words``."""
    tests = []
    for phrase, _ in BASE:
        tests.append(" and ".join(f"get(words, i + {k}) = '{w}'" if k else f"words[i] = '{w}'" for k, w in enumerate(phrase)))
    return F.expr(f"filter(sequence(0, size(words) - 1), i -> {' or '.join(f'({t})' for t in tests)})")


def label_of_place() -> str:
    return "case " + " ".join(f"when words[i] = '{phrase[0]}' then '{label}'" for phrase, label in BASE) + " end"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row.

    Words are runs of 0-9, a-z and characters beyond ASCII. NULL and empty texts have no words and no labels. Labels are
    distinct, sorted and joined by commas, an empty string if there are none; ``labels`` holds the base's as well.
    ``score`` is the weight of the strongest rule that detected something, 0.6 at least where the base did, else 0. Rows
    that repeat each get the same result.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    row = [F.xxhash64("k", "t").alias("r1"), F.xxhash64("t", F.lit(1), "k").alias("r2")]
    counted = rows.select("k", n_words(F.col("t")).alias("n_words"), *row)

    hits = rows.where(F.col("t").rlike(GATE)).select(*row, F.regexp_extract_all(F.translate("t", UPPER, LOWER), F.lit(RAW_WORD), F.lit(0)).alias("words"))
    hits = landed(hits.dropDuplicates(["r1", "r2"]).where(F.size("words") > 0), "license-texts")
    base = hits.select("r1", "r2", "words", base_places().alias("places")).where(F.size("places") > 0)
    base = base.select(
        "r1", "r2", F.size("places").cast("bigint").alias("n_base"), F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        F.expr(f"array_distinct(transform(places, i -> {label_of_place()}))").alias("base"),
    )

    spark = df.sparkSession
    rules = F.broadcast(spark.createDataFrame(RULES, "rule int, label string, priority int, keyword string, pattern string, names array<string>"))  # a fixed table
    named = F.array(*(F.lit(w) for w in sorted({w for r in RULES for w in r[5]})))
    keywords = sorted({r[3] for r in RULES})
    held = F.array(*(F.lit(k) for k in keywords))
    # 'license' also stands for 'licence' and 'licensed'
    joined = hits.select("r1", "r2", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("s"))
    joined = joined.select("r1", "r2", "s", F.filter(named, lambda w: F.col("s").contains(w)).alias("held"))
    gated = joined.select("r1", "r2", "s", "held", F.explode(F.filter(held, lambda k: F.col("s").contains(k) | ((k == "license") & F.col("s").contains("licence")))).alias("keyword"))
    scanned = gated.join(rules, "keyword").where(F.arrays_overlap("names", "held") & F.expr("s rlike pattern"))
    found = scanned.select("r1", "r2", "rule", "label", "priority", F.expr("regexp_extract_all(s, pattern, 0)").alias("m"), F.expr("split(s, pattern, -1)").alias("between"))
    # a hit's start is the length of all before it: running sums, so that a text's work grows with its hits
    parts = F.posexplode(F.expr("transform(m, (x, i) -> struct(length(between[i]) as gap, length(x) as n))")).alias("at", "part")
    found = found.select("r1", "r2", "rule", "label", "priority", parts)
    so_far = Window.partitionBy("r1", "r2", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("part.gap") + F.col("part.n")).over(so_far)
    found = found.select("r1", "r2", "rule", "label", "priority", (end - F.col("part.n")).alias("start"), end.alias("end")).dropDuplicates(["r1", "r2", "start", "end", "label", "priority"])
    up_to = Window.partitionBy("r1", "r2").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("r1", "r2", "priority").orderBy("start", F.desc("end"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    higher = F.lit(None).cast("int")
    for p in sorted(WEIGHT):
        higher = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") > p, F.col("end"))).over(up_to)).otherwise(higher)
    kept = found.withColumn("above", higher).withColumn("beside", F.max("end").over(before)).where(
        ~F.coalesce(F.col("above") >= F.col("end"), F.lit(False)) & ~F.coalesce(F.col("beside") >= F.col("end"), F.lit(False))
    )
    weight = F.element_at(F.create_map(*(F.lit(x) for p, w in WEIGHT.items() for x in (p, w))), F.col("priority"))
    labels = kept.groupBy("r1", "r2").agg(F.collect_set("label").alias("method"), F.max(weight).alias("weight"))

    none = F.array().cast("array<string>")
    out = counted.join(base.join(labels, ["r1", "r2"], "full"), ["r1", "r2"], "left")
    base_set, method = F.coalesce("base", none), F.coalesce("method", none)
    return out.select(
        F.col("k").alias(key), "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_set, method)), ",").alias("labels"),
        F.coalesce(F.greatest("weight", F.when(F.size(base_set) > 0, F.lit(0.6))), F.lit(0.0)).alias("score"),
    )
