"""Document fingerprints by SpotSigs, of built-in functions only.

A signature is a common word (an anchor) and the next content words that follow it; what stands between content words is
skipped, so that navigation, lists and names without running prose leave few signatures. The anchors are the words that make
up a fixed share of all words of the corpus, which bounds their number whatever its size. A fingerprint is the set of a
text's signatures. Sets are compared by their Jaccard similarity, from which lengths alone rule most pairs out: sets are
partitioned by length so that similar ones lie in the same partition or the next, and within partitions they meet by their
rarest signatures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotsage.llm.columns import let
from plotsage.llm.common import cut, id_column

#: A word is an anchor if it is one of so many words of the corpus at least; there are no more anchors than that.
ANCHOR_SHARE = 400
#: Content words of a signature, and hex digits that tell signatures apart.
CHAIN, DIGITS = 3, 12
SIMILARITY = 0.8
#: Ranges of doc_id are this large, in bytes of text, while there are no more than so many of them.
RANGE_BYTES, MOST_RANGES = 32 << 20, 1 << 14
NO_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def anchors(docs: DataFrame, share: int = ANCHOR_SHARE, total: int | None = None) -> list[str]:
    """The words of which there are at least one in share words of all texts (total words), in order: share words at most."""
    each = docs.select(words(F.col("text")).alias("w"))
    total = measured(docs)[0] if total is None else total
    counts = each.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return sorted(r["w"] for r in counts.filter(F.col("n") * share >= max(total, 1)).select("w").collect())


def signed(words_: Column, common: list[str], chain: int = CHAIN) -> Column:
    """The distinct signatures of an array of words, in order.

    Each anchor starts one, of itself and the next chain content words. Texts whose anchors start none have their runs of
    chain words instead, and texts of fewer words themselves; texts without words have the empty signature."""
    is_content = lambda w: ~w.isin(common) if common else F.lit(True)
    hashed = lambda parts: F.substring(F.md5(F.array_join(parts, " ")), 1, DIGITS)

    def by_anchor(w: Column, content: Column) -> Column:
        """Content word k and those after it, led by each word between it and the content word before, all of them anchors."""

        def of(k: Column) -> Column:
            before = F.when(k > 0, F.get(content, k - 1)).otherwise(-1)
            tail = F.transform(F.slice(content, k + 1, F.lit(chain)), lambda i: F.get(w, i))
            return F.when(F.get(content, k) - before > 1, F.transform(F.sequence(before + 1, F.get(content, k) - 1), lambda i: hashed(F.concat(F.array(F.get(w, i)), tail))))

        last = F.size(content) - chain
        return F.when(last >= 0, F.flatten(F.filter(F.transform(F.sequence(F.lit(0), last), of), lambda x: x.isNotNull()))).otherwise(F.array().cast("array<string>"))

    def by_run(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - chain, F.lit(0))), lambda i: hashed(F.slice(w, i + 1, F.lit(chain))))

    def of(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda v, i: F.when(is_content(v), i)), lambda i: i.isNotNull())
        found = let(places, lambda content: by_anchor(w, content))
        return let(found, lambda f: F.array_sort(F.array_distinct(F.when(F.size(f) > 0, f).otherwise(by_run(w)))))

    return let(words_, of)


def fingerprint(text: Column, common: list[str]) -> Column:
    return signed(words(text), common)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets of signatures; null, without their being compared, if their lengths rule out that it reaches least."""
    shared = F.size(F.array_intersect(a, b))
    share = shared / (F.size(a) + F.size(b) - shared)
    return F.when(F.least(F.size(a), F.size(b)) >= least * F.greatest(F.size(a), F.size(b)), share)


def length_bounds(longest: int, similarity: float) -> list[int]:
    """Where partitions of set lengths begin: one that begins at p ends before p / similarity is passed."""
    found = [1]
    while found[-1] <= longest:
        found.append(math.floor(found[-1] / similarity + 1e-9) + 1)
    return found


def linked(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """u, v (u < v), size_u, size_v and shared of each pair of rows of sets (node, sigs: distinct signatures, not empty) whose Jaccard similarity
    is that high. node must be unique.

    A pair lies in one partition of lengths or in neighbouring ones. Every set is held in its own, and asks in its own and
    the one below; it is held and asks by its rarest signatures, of which a similar one must share one. Each pair is
    compared once, in the partition of the shorter set."""
    longest = sets.agg(F.max(F.size("sigs"))).first()[0] or 0
    bounds = length_bounds(longest, similarity)
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("size")))
    sized = sets.select("node", F.size("sigs").alias("size"), "sigs").withColumn("part", part)
    each = sized.select("node", "size", "part", F.explode("sigs").alias("sig"))
    rare = each.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    # signatures that only one set has are the rarest, and lead to nothing: they count, but need not be joined by
    placed = each.join(rare, "sig", "left").groupBy("node", "size", "part").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "sig"))).alias("ranked"))
    kept = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9).cast("int") + 1
    prefix = F.filter(F.slice("ranked", F.lit(1), kept), lambda x: x["n"] > 1)
    probes = placed.select("node", "size", "part", F.explode(F.transform(prefix, lambda x: x["sig"])).alias("sig"))
    held = probes.select(F.col("node").alias("u"), F.col("size").alias("size_u"), F.col("part").alias("at"), "sig")
    asks = probes.select(F.col("node").alias("v"), F.col("size").alias("size_v"), F.explode(F.array("part", F.col("part") - 1)).alias("at"), "sig")
    order = (F.col("size_u") < F.col("size_v")) | ((F.col("size_u") == F.col("size_v")) & (F.col("u") < F.col("v")))
    met = held.join(asks, ["at", "sig"]).filter(order & (F.col("size_u") >= similarity * F.col("size_v") - 1e-9)).select("u", "v").distinct()
    full = met.join(sets.select(F.col("node").alias("u"), F.col("sigs").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("sigs").alias("b")), "v")
    counted = full.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.size(F.array_intersect("a", "b")).alias("shared"))
    return counted.filter(F.col("shared") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("shared")) - 1e-9).select("u", "v", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("likeness"))


def near_documents(docs: DataFrame, similarity: float = SIMILARITY, common: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints, and links between them: (doc_id, class), and (a, b, likeness) with a < b of all classes
    whose fingerprints are that similar. A class is named by its least doc_id.

    Copies are one class and need no pairs. Null ids take no part; see fingerprint tables for other cases."""
    kept = docs.select(id_column(docs)[0].alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    common = anchors(kept) if common is None else common
    done = cut(kept.select("doc_id", fingerprint(F.col("text"), common).alias("sigs")).withColumn("print", F.sha2(F.array_join("sigs", ","), 256)), "spotsigs-prints")
    classes = cut(done.groupBy("print").agg(F.min("doc_id").alias("class"), F.first("sigs").alias("sigs")), "spotsigs-classes")
    members = done.select("doc_id", "print").join(classes.select("print", "class"), "print").select("doc_id", "class")
    pairs = linked(classes.select(F.col("class").alias("node"), "sigs"), similarity)
    return members, pairs.select(F.col("u").alias("a"), F.col("v").alias("b"), "likeness")


def measured(docs: DataFrame) -> tuple[int, int]:
    """Words and bytes of all texts."""
    found = docs.agg(F.sum(F.size(words(F.col("text")))), F.sum(F.octet_length("text"))).first()
    return found[0] or 0, found[1] or 0


def followed(docs: DataFrame, n_ranges: int) -> DataFrame:
    """doc_id and text, in ranges: range, ghost, doc_id, text, so that within a range, in falling order of doc_id (nulls last; of equal ids
    by text), each row but ghosts is followed by the document after it; after the last document comes the first.

    The first row of each range stands, as a ghost, at the end of the range before it as well. Only bounds and first ids of
    ranges are gathered."""
    fractions = [i / n_ranges for i in range(1, n_ranges)]
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, fractions)), F.lit(max(10_000, 10 * n_ranges)))).first()[0] if fractions else None
    bounds = sorted(set(cuts or []), reverse=True)
    if bounds:  # by halving steps: how many bounds are greater than the id
        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        all_bounds = F.array(*map(F.lit, bounds))
        deeper = lambda at, step: (at + step <= len(bounds)) & (F.get(all_bounds, at + step - 1) > F.col("doc_id"))
        place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(deeper(at, step), at + step).otherwise(at))
        place = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(place)
    else:
        place = F.lit(0)
    ranged = docs.withColumns({"range": place, "order": F.xxhash64("text")})
    falling = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "order")
    heads = sorted((r["range"], r["head"]["down"], r["head"]["order"]) for r in ranged.groupBy("range").agg(F.min(falling).alias("head")).collect())
    # each range with rows, and the one before it
    before = [(heads[i - 1][0], None if down is None else ~down, order) for i, (_, down, order) in enumerate(heads)]
    kind = dict(docs.dtypes)["doc_id"]
    told = docs.sparkSession.createDataFrame(before, f"into int, head {kind}, head_order long")
    ghosts = ranged.join(F.broadcast(told), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("order") == F.col("head_order")), "left")
    places = F.array_compact(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost")), F.when(F.col("into").isNotNull(), F.struct(F.col("into").alias("range"), F.lit(True).alias("ghost")))))
    return ghosts.select(F.explode(places).alias("place"), "doc_id", "order", "text").select("place.*", "doc_id", "order", "text")


def edits(docs: DataFrame, common: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, text, edited, sigs, edited_sigs and next_sigs of each row of docs.

    edited: the text whose last half (of its code points, rounded down) is replaced by as many of the first ones of the next
    document, in falling order of doc_id; or by all of them, if there are fewer. sigs: fingerprints, as sorted arrays. doc_id must be a whole number; null ids come last, rows of equal ids go by
    their texts. Null texts are empty; the only document is its own next. Very long texts are read whole. Other columns are
    left out; an empty table gives an empty result."""
    kept = docs.select(id_column(docs)[0].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_words, n_bytes = measured(kept)
    common = anchors(kept, total=n_words) if common is None else common
    rows = followed(kept, min(MOST_RANGES, max(1, -(-n_bytes // range_bytes))))
    rows = rows.repartition("range").sortWithinPartitions("range", "ghost", F.desc_nulls_last("doc_id"), "order", "text").withColumn("sigs", fingerprint(F.col("text"), common))
    ahead = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), "order", "text")
    rows = rows.withColumn("next", F.lead(F.struct("text", "sigs")).over(ahead)).filter("not ghost")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next.text", F.lit(1), half))
    rows = rows.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sigs", F.col("next.sigs").alias("next_sigs"))
    return rows.withColumn("edited_sigs", fingerprint(F.col("edited"), common))


def digest(edited: DataFrame) -> DataFrame:
    """Fingerprints as text, and how alike they are."""
    text = lambda c: F.array_join(c, ",")
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text("sigs").alias("fingerprint"), text("edited_sigs").alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def digest_sql() -> str:
    """The same in DuckDB's SQL, word by word."""
    content = ", ".join(f"lead(v, {i}) OVER follow AS v{i}" for i in range(1, CHAIN))
    joined = " || ' ' || ".join(["v", *(f"v{i}" for i in range(1, CHAIN))])
    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS r, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT r, doc_id, t, length(t) AS n_chars, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS nt FROM d),
e AS (SELECT r, doc_id, n_chars, t, left(t, n_chars - n_chars // 2) || left(nt, n_chars // 2) AS et FROM n),
x AS (SELECT 2 * r AS r, t FROM e UNION ALL SELECT 2 * r + 1, et FROM e),
w AS MATERIALIZED (SELECT r, list_filter(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda v: v <> '') AS w FROM x),
c AS MATERIALIZED (SELECT v FROM (SELECT unnest(w) AS v FROM w WHERE r % 2 = 0) GROUP BY v HAVING count(*) * {ANCHOR_SHARE} >= (SELECT greatest(sum(len(w)), 1) FROM w WHERE r % 2 = 0)),
u AS MATERIALIZED (SELECT r, i, v, v IN (SELECT v FROM c) AS a FROM (SELECT r, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM w)),
k AS (SELECT r, i, v, {content} FROM u WHERE NOT a WINDOW follow AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, v, i, a, min(CASE WHEN NOT a THEN i END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ci FROM u),
led AS MATERIALIZED (SELECT s.r, left(md5(s.v || ' ' || {joined.replace("v", "k.v")}), {DIGITS}) AS sig FROM s JOIN k ON s.r = k.r AND s.ci = k.i WHERE s.a AND k.v{CHAIN - 1} IS NOT NULL),
run AS (SELECT r, left(md5({joined}), {DIGITS}) AS sig FROM (SELECT r, i, v, {content} FROM u WINDOW follow AS (PARTITION BY r ORDER BY i)) WHERE v{CHAIN - 1} IS NOT NULL UNION ALL SELECT r, left(md5(array_to_string(w, ' ')), {DIGITS}) FROM w WHERE len(w) < {CHAIN}),
g AS MATERIALIZED (SELECT DISTINCT r, sig FROM led UNION SELECT DISTINCT r, sig FROM run WHERE r NOT IN (SELECT r FROM led)),
f AS MATERIALIZED (SELECT r, count(*) AS n, string_agg(sig, ',' ORDER BY sig) AS print FROM g GROUP BY r),
pr AS (SELECT r, 2 * r AS a, 2 * r + 1 AS b, 2 * (CASE WHEN r = (SELECT max(r) FROM e) THEN 1 ELSE r + 1 END) AS nx FROM e),
sh AS (SELECT p.a, p.b, count(*) AS n FROM (SELECT a, b FROM pr UNION SELECT a, nx FROM pr) p JOIN g g1 ON g1.r = p.a JOIN g g2 ON g2.r = p.b AND g1.sig = g2.sig GROUP BY p.a, p.b)
SELECT e.doc_id, e.n_chars, sha256(e.et) AS edited_sha256, fa.print AS fingerprint, fb.print AS edited_fingerprint,
  coalesce(s1.n, 0) / CAST(fa.n + fb.n - coalesce(s1.n, 0) AS DOUBLE) AS near_edited, coalesce(s2.n, 0) / CAST(fa.n + fn.n - coalesce(s2.n, 0) AS DOUBLE) AS near_next
FROM e JOIN pr USING (r) JOIN f fa ON fa.r = pr.a JOIN f fb ON fb.r = pr.b JOIN f fn ON fn.r = pr.nx LEFT JOIN sh s1 ON s1.a = pr.a AND s1.b = pr.b LEFT JOIN sh s2 ON s2.a = pr.a AND s2.b = pr.nx"""
