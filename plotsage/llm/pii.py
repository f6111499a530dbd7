"""Personal data by bootstrapped contextual extraction. Built-in functions only.

Seeds are what the base patterns recognise. The words before a seed are a lexical pattern; patterns and instances form
a graph that is scored in rounds: a pattern by its instances that are believed against those that also stand behind
doubted patterns, an instance by the other patterns that are believed of it. Patterns of high confidence then discover identifiers of other shapes behind the same words.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotsage.llm.common import cut, discard

KINDS = ("email", "ip", "card", "phone")

# Each finds what the plain pattern finds. A run that cannot match is not tried again from its later characters, and
# nothing backtracks through a group, so that time stays in proportion to the text and no stack grows with it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A word with a digit or an @: where unseen identifiers are looked for.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
CORE = r"[\p{L}0-9+].*[\p{L}0-9]"
CONTEXT = "context"
ROUNDS, SUPPORT, CONFIDENCE = 3, 5, 0.8


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches in order as structs of kind, value, the length of what lies between it and the match before, and the
    end of that. Where they stand is summed up later, so that a text with very many matches takes no quadratic time."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.length(g).alias("gap"), F.substring(g, -64, 64).alias("before")))
    return F.filter(both, lambda x: x["value"].isNotNull())


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    turned = F.reverse(number)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(digits(value)).between(13, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


NOTHING = "array<struct<kind:string,value:string,gap:int,before:string>>"
ORDER = {kind: i for i, kind in enumerate((*KINDS, CONTEXT))}


def all_matches(text: Column) -> Column:
    """Matches of every kind, valid or not, and of words that may be identifiers, those of each kind in order."""
    hint = lambda k: F.contains(text, F.lit("@")) if k == "email" else text.rlike(HINTS[k])
    some = lambda test, found: F.when(test, found).otherwise(F.array().cast(NOTHING))
    return F.concat(*[some(hint(k), matches(text, PATTERNS[k], k)) for k in KINDS], some(text.rlike("[0-9@]"), matches(text, CANDIDATE, CONTEXT)))


def located(found: DataFrame) -> DataFrame:
    """row, kind, start, end, value and before of the valid matches among those of found (row, matches).

    Candidates lose their outer punctuation; they have 6 characters at least, and 4 digits or an @ among them."""
    each = found.filter(F.size("matches") > 0).select("row", F.posexplode("matches").alias("nth", "m")).select("row", "nth", "m.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(before).cast("int")
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    placed = placed.filter(functools.reduce(operator.or_, [(F.col("kind") == k) & valid(k, F.col("value")) for k in KINDS], F.col("kind") == CONTEXT))
    is_candidate = F.col("kind") == CONTEXT
    core = F.when(is_candidate, F.regexp_extract("value", CORE, 0)).otherwise(F.col("value"))
    lead = F.when(is_candidate, F.length(F.regexp_extract("value", r"^[^\p{L}0-9+]*", 0))).otherwise(0)
    placed = placed.select("row", "kind", (F.col("start") + lead).alias("start"), core.alias("value"), "before").withColumn("end", F.col("start") + F.length("value"))
    return placed.filter((F.col("kind") != CONTEXT) | (F.length("value") >= 6) & ((F.length(digits(F.col("value"))) >= 4) | F.contains("value", F.lit("@")))).select("row", "kind", "start", "end", "value", "before")


def without_met(spans: DataFrame) -> DataFrame:
    """Base spans, and the candidates that meet none of their row. Spans are read in order of their starts, and once backwards: base spans
    may end behind a candidate's start, or begin before its end."""
    upto = lambda order: Window.partitionBy("row").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    is_base = F.col("kind") != CONTEXT
    reach = F.max(F.when(is_base, F.col("end"))).over(upto(F.asc("start")))
    later = F.min(F.when(is_base, F.col("start"))).over(upto(F.desc("start")))
    met = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("end"), F.lit(False))
    return spans.withColumn("met", met).filter(is_base | ~F.col("met")).drop("met")


def context(before: Column) -> Column:
    """The last two words before, in lower case and without digits and punctuation; null where there are not two."""
    two = F.regexp_extract(F.lower(before), r"(?<![\p{L}])(\p{L}+)[^\p{L}]+(\p{L}+)[^\p{L}]*$", 0)
    return F.nullif(F.trim(F.regexp_replace(two, r"[^\p{L}]+", " ")), F.lit(""))


def believed_patterns(pairs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Patterns (context) of the graph of pairs (context, value, seed) that reach confidence with support different values.

    A value that is no seed speaks for a pattern as far as other patterns are believed of it, and against it if it also
    stands behind another pattern that is doubted: one of at least support values of which few are believed. Values of
    which nothing else is known speak neither way, so that a pattern may have any number of unseen ones.
    """
    pairs = cut(pairs.groupBy("context", "value").agg(F.max("seed").alias("seed")), "pii-pairs")
    # a value that is a seed anywhere is one everywhere
    seeds = pairs.groupBy("value").agg(F.max("seed").alias("seed"))
    pairs = cut(pairs.select("context", "value").join(seeds, "value"), "pii-instances")
    few = (F.col("n") >= support) & (F.col("mass") <= (1 - confidence) * F.col("n"))
    counted = pairs.groupBy("context").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("double")).alias("mass"))
    patterns = cut(counted.select("context", F.lit(0.0).alias("belief"), few.alias("doubted")), "pii-patterns")
    for _ in range(rounds):
        each = pairs.join(patterns, "context").select("context", "value", "seed", F.log(F.greatest(1 - F.col("belief"), F.lit(1e-9))).alias("left"), F.col("doubted").cast("int").alias("doubt"))
        values = each.groupBy("value").agg(F.sum("left").alias("all_left"), F.sum("doubt").alias("all_doubts"))
        score = F.when(F.col("seed"), 1.0).otherwise(1 - F.exp(F.col("all_left") - F.col("left")))
        scored = each.join(values, "value").select("context", score.alias("score"), (F.col("all_doubts") > F.col("doubt")).alias("against"))
        summed = scored.groupBy("context").agg(F.count("*").alias("n"), F.sum("score").alias("mass"), F.sum(F.when(F.col("against"), 1 - F.col("score")).otherwise(0.0)).alias("against"))
        belief = F.col("mass") / (F.col("mass") + F.col("against"))
        believed = (F.col("mass") >= support) & (belief >= confidence)
        last, patterns = patterns, cut(summed.select("context", F.when(believed, belief).otherwise(0.0).alias("belief"), (few & ~F.coalesce(believed, F.lit(False))).alias("doubted")), "pii-patterns")
        discard(last)
    return patterns.filter("belief > 0").select("context")


def find(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: row (a number), doc_id and spans, an array of kind, start, end and value.

    Spans stand by kind (base kinds, then context), then start; positions are code points, the end exclusive. Null and
    empty texts have no spans; null doc_ids and repeated rows are kept; other columns are left out; an empty table gives
    an empty result. Whole texts are searched; a context is made of the 64 characters before a value, words cut off there
    included. A discovered span never overlaps a base span of its text.
    """
    text = F.coalesce("text", F.lit(""))
    found = cut(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), all_matches(text).alias("matches")), "pii-found")
    spans = cut(without_met(located(found.select("row", "matches"))).withColumn("context", context(F.col("before"))).drop("before"), "pii-spans")
    patterns = believed_patterns(spans.filter("context IS NOT NULL").select("context", F.lower("value").alias("value"), (F.col("kind") != CONTEXT).alias("seed")))
    base, fresh = spans.filter(F.col("kind") != CONTEXT).drop("context"), spans.filter(F.col("kind") == CONTEXT).join(patterns, "context").drop("context")
    place = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])[F.col("kind")]
    rows = base.unionByName(fresh).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind", "value"))).alias("spans"))
    told = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return found.select("row", "doc_id").join(rows.select("row", told.alias("spans")), "row", "left").withColumn("spans", F.coalesce("spans", none))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (text), of what find() returns."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != CONTEXT)
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each found span replaced by its kind in angle brackets; of spans that overlap the first counts.

    All columns stay, whatever their names; n_chars (where it is there) becomes the new length. Null texts stay null.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    text_name = columns[docs.columns.index("text")]
    text = F.col(text_name)
    kept = cut(docs.toDF(*columns).withColumn("row", F.monotonically_increasing_id()), "pii-docs")
    spans = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    found = find(kept.select(F.col("row").alias("doc_id"), text.alias("text"))).filter(F.size("spans") > 0).select(F.col("doc_id").alias("row"), spans.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        more = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), x["kind"], F.lit(">")).alias("out"), x["end"].alias("at"))
        return F.when(x["start"] >= acc["at"], more).otherwise(acc)

    last = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, last)
    out = kept.join(found, "row", "left").withColumn(text_name, F.when(F.col("spans").isNull(), text).otherwise(clean))
    if "n_chars" in docs.columns:
        n_chars = columns[docs.columns.index("n_chars")]
        out = out.withColumn(n_chars, F.when(F.col("spans").isNull(), F.col(n_chars)).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(*columns).toDF(*docs.columns)
