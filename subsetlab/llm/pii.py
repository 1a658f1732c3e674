"""Sanitisation: personal data by pattern, and terms that give a protected entity away by corpus co-occurrence.

Base spans are the leftmost non-overlapping matches of four patterns that also pass their number checks. Each distinct value is a
protected entity. Terms are words near a mention of it. Over the whole corpus, a term's disclosure of an entity is the share of the
entity's information that the term carries: pointwise mutual information of term and entity over the information content of the entity,
1 when the term never occurs without it. Terms at or above the threshold, seen with the entity in enough different contexts, are spans of
kind ``term`` wherever they stand, near a mention or not: ``sanitise`` replaces base spans by their kind and generalises or removes terms.

Everything is DataFrame functions. Texts are matched where they are read; what is shuffled are spans with a bounded context, hashes of
words with counts added up beforehand, and, for ``sanitise`` alone, the texts.

Defined results: a null text is empty; rows that repeat id and text get the same spans once; ties in start go by kind; spans of different
kinds may overlap, a term that overlaps a base span is left out; an empty table gives an empty table; other columns stay as they are.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.llm.common import content_key
from subsetlab.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "term")

# The patterns of the four kinds. A start is tried only where the run of leading characters begins or the last match ended,
# and repeats are possessive; neither changes a match, both keep long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[\p{L}\p{N}_]++"

REACH = 80              # code points of context on each side of a mention
TERMS_PER_SIDE = 5      # words of it that count as near
THRESHOLD = 0.9         # share of the entity's information
MIN_CONTEXTS = 3        # different contexts in which term and entity meet
BROADCAST_TERMS = 50_000   # disclosing terms that are broadcast, under 2 MB
REMOVE_AT = 1.0         # disclosure from which a term is removed rather than generalised


def matches(docs: DataFrame, patterns, reach: int) -> DataFrame:
    """(doc, content, kind_no, start, end, value, before, after): matches of (kind_no, pattern, hint) triples with the text around them.

    A text is read once for all kinds; a pattern runs where its hint, a cheaper test, holds. ``before`` and ``after`` have up to ``reach`` + 1
    code points, so that one of at most ``reach`` is known to end with the text. They go on over other matches: a match has two code points
    at least, so a bounded number of pieces, each cut to the same length, holds them.
    """
    most, pieces = reach + 1, reach // 2 + 1
    none = F.array().cast("array<string>")
    texts = docs.select("doc", "content", *[F.when(hint, F.split("text", pattern, -1)).otherwise(none).alias(f"gaps{k}") for k, pattern, hint in patterns],
                        *[F.when(hint, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"found{k}") for k, pattern, hint in patterns])

    def cut(k, side):
        """Each gap with the match behind it, or the match before it and the gap, as far as a context may need it."""
        gaps, found = F.col(f"gaps{k}"), F.col(f"found{k}")
        return F.when(F.size(found) > 0, F.zip_with(gaps, found, lambda gap, value: side(F.concat(gap, F.coalesce(value, F.lit(""))), F.lit(most)))).otherwise(none)

    texts = texts.select("*", *[cut(k, F.right).alias(f"tails{k}") for k, _, _ in patterns], *[cut(k, F.left).alias(f"heads{k}") for k, _, _ in patterns])

    def placed(k):
        gaps, tails, heads = (F.col(f"{name}{k}") for name in ("gaps", "tails", "heads"))

        def one(value, i):
            first = F.greatest(i - pieces, F.lit(0))
            before = F.concat(F.array_join(F.slice(tails, first + 1, i - first), ""), F.right(F.get(gaps, i), F.lit(most)))
            after = F.array_join(F.slice(heads, i + 2, F.lit(pieces)), "")
            return F.struct(F.lit(k).alias("kind_no"), i.alias("i"), F.length(F.get(gaps, i)).alias("skip"), value.alias("value"),
                            F.when(passes(k, value), F.right(before, F.lit(most))).alias("before"), F.when(passes(k, value), F.left(after, F.lit(most))).alias("after"))

        return F.transform(F.col(f"found{k}"), one)

    found = texts.select("doc", "content", F.inline(F.concat(*[placed(k) for k, _, _ in patterns])))
    # repeated rows go in the one shuffle that the running sum of lengths needs anyway
    once = found.repartition("doc", "content").dropDuplicates(["doc", "content", "kind_no", "i"])
    in_order = Window.partitionBy("doc", "content", "kind_no").orderBy("i")
    end = F.sum(F.col("skip") + F.length("value")).over(in_order)
    placed_once = once.select("doc", "content", "kind_no", (end - F.length("value")).cast("int").alias("start"), end.cast("int").alias("end"), "value", "before", "after")
    return placed_once.filter("before is not null")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum of card numbers."""
    values = F.reverse(F.split(digits, ""))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind_no: int, value: Column) -> Column:
    """Whether a match of the kind's pattern passes its number check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind_no == 1:
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind_no == 2:
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15) if kind_no == 3 else F.lit(True)


def base_spans(df: DataFrame, id_col="doc_id", text_col="text", reach=REACH) -> DataFrame:
    """Spans of personal data: (doc, content, kind_no, start, end, value, before, after), positions in code points, end exclusive."""
    docs = df.select(F.col(id_col).alias("doc"), content_key(F.col(text_col)).alias("content"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    return matches(docs, [(0, EMAIL, F.contains("text", F.lit("@"))), (1, IP, digit & F.contains("text", F.lit("."))), (2, CARD, digit), (3, PHONE, F.contains("text", F.lit("+")))], reach)


def near_terms(spans: DataFrame, terms_per_side=TERMS_PER_SIDE, reach=REACH) -> DataFrame:
    """Words near mentions: (entity, context, term). Words cut by the reach or glued to the mention do not count; where the text ends nothing is cut."""

    def words(side, base):
        """Array of (word, start) of a context string; the string is bounded, so are these sums over its pieces."""
        found, gaps = F.regexp_extract_all(side, F.lit(WORD), F.lit(0)), F.split(side, WORD, -1)
        lengths = F.zip_with(gaps, found, lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0)))
        return F.transform(found, lambda w, i: F.struct(w.alias("word"), (base + F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) - F.length(w)).alias("start")))

    before, after = F.col("before"), F.col("after")
    left = F.filter(words(before, F.col("start") - F.length(before)), lambda w: ((w["start"] > F.col("start") - F.length(before)) | (F.length(before) <= reach)) & (w["start"] + F.length(w["word"]) < F.col("start")))
    right = F.filter(words(after, F.col("end")), lambda w: (w["start"] > F.col("end")) & ((w["start"] + F.length(w["word"]) < F.col("end") + F.length(after)) | (F.length(after) <= reach)))
    near = F.concat(F.slice(F.reverse(left), 1, terms_per_side), F.slice(right, 1, terms_per_side))
    rows = spans.select(F.xxhash64("kind_no", "value").alias("entity"), F.xxhash64("before", "after").alias("context"), F.explode(near).alias("w"))
    return rows.filter(F.col("w.word").rlike(r"^\p{L}[\p{L}\p{N}_]{2,}$")).select("entity", "context", F.xxhash64(F.lower("w.word")).alias("term"))


def disclosures(near: DataFrame, spans: DataFrame, df: DataFrame, text_col="text", threshold=THRESHOLD, min_contexts=MIN_CONTEXTS) -> DataFrame:
    """(entity, term, disclosure) at or above the threshold, from counts over all words of all texts.

    The corpus counts words by hash and only the terms near some entity are kept; both sides of the join have one row per key.
    """
    pairs = (near.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("contexts"))
             .filter(F.col("contexts") >= min_contexts))
    counted_words = df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).alias("word")).groupBy(F.xxhash64(F.lower("word")).alias("term")).agg(F.count(F.lit(1)).alias("occurrences"))
    words = cut_lineage(counted_words)   # read for the total and for the join
    mentions = spans.groupBy(F.xxhash64("kind_no", "value").alias("entity")).agg(F.count(F.lit(1)).alias("mentions"))
    total = words.agg(F.sum("occurrences").alias("total"))   # one row
    counted = pairs.join(words, "term").join(mentions, "entity").join(F.broadcast(total))
    information = F.log2(F.col("total") / F.col("mentions"))
    joint = F.least(F.col("together"), F.col("occurrences"))
    return (counted.withColumn("disclosure", F.least(F.lit(1.0), 1 + F.log2(joint / F.col("occurrences")) / F.greatest(information, F.lit(1e-9))))
            .filter(F.col("disclosure") >= threshold).select("entity", "term", "disclosure"))


def occurrences(df: DataFrame, terms: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc, content, start, end, disclosure) of every word of every text that is one of the terms (term, disclosure), one row per term.

    Different words of a text are looked up first; places are counted in the texts that hold a term. A short table of terms is broadcast, a
    long one is joined by a shuffle.
    """
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    texts = df.select(F.col(id_col).alias("doc"), content_key(F.col(text_col)).alias("content"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    held = texts.select("doc", "content", F.explode(F.array_distinct(words)).alias("word")).select("doc", "content", F.xxhash64(F.lower("word")).alias("term"))
    holders = cut_lineage(held.join(terms, "term", "left_semi").select(F.col("doc").alias("held_doc"), F.col("content").alias("held_content")).distinct())
    chosen = texts.join(holders.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("held_doc")) & (F.col("content") == F.col("held_content")), "left_semi")
    gaps = F.split("text", WORD, -1)
    placed = chosen.select("doc", "content", F.inline(F.zip_with(words, F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda gap, i: F.struct(F.length(gap).alias("skip"), i.alias("i"))),
                                                                 lambda word, at: F.struct(at["i"].alias("i"), at["skip"].alias("skip"), F.length(word).alias("size"), F.xxhash64(F.lower(word)).alias("term")))))
    once = placed.repartition("doc", "content").dropDuplicates(["doc", "content", "i"])
    end = F.sum(F.col("skip") + F.col("size")).over(Window.partitionBy("doc", "content").orderBy("i"))
    return (once.select("doc", "content", "term", (end - F.col("size")).cast("int").alias("start"), end.cast("int").alias("end"))
            .join(terms, "term").select("doc", "content", "start", "end", "disclosure"))


def all_spans(df: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD, min_contexts=MIN_CONTEXTS) -> DataFrame:
    """Base spans and disclosing terms: (doc, content, kind_no, start, end, disclosure, reached); ``reached`` is the furthest end of earlier spans."""
    spans = cut_lineage(base_spans(df, id_col, text_col))   # used three times, matched once
    near = near_terms(spans)
    found = disclosures(near, spans, df, text_col, threshold, min_contexts)
    flagged = cut_lineage(found.groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    terms = occurrences(df, flagged, id_col, text_col).select("doc", "content", F.lit(4).alias("kind_no"), "start", "end", "disclosure")
    both = spans.select("doc", "content", "kind_no", "start", "end", F.lit(None).cast("double").alias("disclosure")).unionByName(terms)
    in_order = Window.partitionBy("doc", "content").orderBy("start", "kind_no")
    is_base = F.col("kind_no") < 4
    past = F.max(F.when(is_base, F.col("end"))).over(in_order)
    coming = F.min(F.when(is_base, F.col("start"))).over(in_order.rowsBetween(1, Window.unboundedFollowing))
    clear = (both.withColumn("past", past).withColumn("coming", coming)
             .filter(is_base | ((F.coalesce("past", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("coming"), F.col("end")) >= F.col("end"))))
             .drop("past", "coming"))
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return clear.withColumn("reached", F.coalesce(before, F.lit(0)))


def with_spans(df: DataFrame, id_col="doc_id", text_col="text", **limits) -> DataFrame:
    """All columns and ``pii_spans``, an ordered array of (start, kind_no, end, disclosure, reached); empty where there are none."""
    spans = (all_spans(df, id_col, text_col, **limits).groupBy("doc", "content")
             .agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "disclosure", "reached"))).alias("_spans"))
             .select(F.struct("doc", "content").alias("_held"), "_spans"))
    rows = df.drop("_held", "_spans", "_row").withColumn("_row", F.struct(F.col(id_col).alias("doc"), content_key(F.col(text_col)).alias("content")))
    joined = rows.join(spans.hint("shuffle_hash"), F.col("_row.doc").eqNullSafe(F.col("_held.doc")) & (F.col("_row.content") == F.col("_held.content")), "left")
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int,disclosure:double,reached:int>>")
    return joined.withColumn("pii_spans", F.coalesce("_spans", empty)).drop("_held", "_spans", "_row")


def sanitise(df: DataFrame, id_col="doc_id", text_col="text", remove_at=REMOVE_AT, **limits) -> DataFrame:
    """All columns with the text's spans replaced: ``[EMAIL]`` and so on, disclosing terms by ``[TERM]`` or, from ``remove_at`` on, by nothing.

    What overlaps an earlier span only lengthens the replaced part.
    """
    rows = with_spans(df, id_col, text_col, **limits)
    text = F.col(text_col)

    def piece(s):
        name = F.when((s["kind_no"] == 4) & (s["disclosure"] >= remove_at), F.lit("")).otherwise(F.get(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind_no"]))
        return F.when(s["start"] < s["reached"], F.lit("")).otherwise(F.concat(F.substring(text, s["reached"] + 1, s["start"] - s["reached"]), name))

    last = F.array_max(F.transform("pii_spans", lambda s: s["end"]))
    clean = F.concat(F.array_join(F.transform("pii_spans", piece), ""), F.substring(text, last + 1, F.length(text)))
    return rows.withColumn(text_col, F.when(F.size("pii_spans") > 0, clean).otherwise(text)).drop("pii_spans")
