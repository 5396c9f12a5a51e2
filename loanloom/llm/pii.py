"""Personal data: fixed patterns as seeds, then bootstrapped contextual extraction.

Matches of four patterns are the seed entities.  The words around an entity are its lexical patterns: the two words
before it, the word before and the word after, and, backing off, the word before alone and that word with the entity's
shape (digits as 9, runs of letters as a).  All words of the corpus with a digit, whatever their length, without the
quotes and stops at their edges, all runs of two or more such words joined by single blanks, and the seeds make a graph
of patterns and distinct instances.  Each round scores a pattern by how many of its instances are known, keeps patterns
that enough distinct known instances support and that hardly anything else fills, scores unknown instances by the
patterns around them (noisy or), and makes the confident ones known for the next round, until neither instances nor
scores rise.  The words found this way are added as spans of kind ``context``; seed spans stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.llm.common import SPACE, cut, dealt_join, heavy_keys, text_or_empty
from loanloom.llm.spans import kept, listed, of_kind, with_matches

LOCAL = "A-Za-z0-9._%+-"
#: Kind, pattern (possessive where nothing is to be given back, so that no text makes matching deep or slow), hint.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?=[^0-9\x20\x09-\x0D]*+[0-9])[^\x20\x09-\x0D]++"
#: Words with a digit, of any length, joined by single blanks: numbers written in groups.
RUN = r"(?<![^\x20\x09-\x0D])(?=[^0-9\x20\x09-\x0D]*+[0-9])[^\x20\x09-\x0D]++(?:\x20(?=[^0-9\x20\x09-\x0D]*+[0-9])[^\x20\x09-\x0D]++)++"
KINDS = ("email", "ip", "card", "phone")
#: A pattern needs so many distinct known instances, and such a share of known ones among all of its instances.
SUPPORT, PATTERN_CONFIDENCE = 5, 0.8
#: An unknown instance needs this score from the patterns around it.
INSTANCE_CONFIDENCE = 0.9
#: Rounds end when no score rises by more than this.
TOLERANCE = 1e-6
#: Code points on either side in which the words of a pattern are looked for first; where they may be cut, in the next.
WINDOWS = (60, 4096)
#: Quotes, brackets and stops that are no part of an instance at its edges.
OPENING, CLOSING = "\"'<[{", "\"'>]}.,;:!?"
ROW = ("k", "absent", "h")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def small_parts(ip: Column) -> Column:
    """Every part is 255 at most, whatever zeros it starts with."""

    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.char_length(bare) < 3) | ((F.char_length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(ip, r"\."), small)


def luhn(card: Column) -> Column:
    """13 to 19 digits whose Luhn sum ends in 0."""
    number = F.reverse(digits(card))
    length = F.char_length(number)
    value = lambda i: F.substring(number, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        F.sequence(F.lit(1), length), F.lit(0), lambda sum_, i: sum_ + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i))
    )
    return F.when(length.between(13, 19), total % 10 == 0).otherwise(False)


def with_base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the passing matches of each kind, in columns named after the kinds."""
    df = with_matches(df, text, "email", EMAIL, "@")
    df = with_matches(df, text, "ip", IP, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
    df = with_matches(df, text, "card", CARD, r"[0-9](?:[\x20-]?+[0-9]){12}")
    df = with_matches(df, text, "phone", PHONE, r"\+[0-9]")
    checks = {
        "email": lambda hit: F.lit(True),
        "ip": small_parts,
        "card": luhn,
        "phone": lambda hit: F.char_length(digits(hit)).between(9, 15),
    }
    for order, kind in enumerate(KINDS):
        df = df.withColumn(kind, of_kind(kept(kind, checks[kind]), kind, order))
    return df


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _last_words(source: Column, start: Column) -> Column:
    """The two words before ``start``, empty where there are fewer, lower-cased; quotes that open there are no words."""

    def words(width: Column | None) -> Column:
        size = start if width is None else F.least(start, width)
        before = F.rtrim(F.substring(source, start - size + 1, size), F.lit(OPENING))
        return F.filter(F.split(F.lower(before), SPACE), lambda w: w != "")

    def within(width: int, wider: Column) -> Column:
        # of three words, or at the start of the text, none of the last two is cut
        return _let(words(F.lit(width)), lambda w: F.when((F.size(w) > 2) | (start <= width), w).otherwise(wider))

    found = words(None)
    for width in reversed(WINDOWS):
        found = within(width, found)
    return F.slice(F.concat(F.array(F.lit(""), F.lit("")), found), -2, 2)


def _first_word(source: Column, end: Column) -> Column:
    """The first word after ``end``, lower-cased."""

    def word(width: int | None) -> Column:
        rest = F.substring(source, end + 1, F.char_length(source) if width is None else F.lit(width))
        return F.lower(F.regexp_extract(rest, rf"^[{re.escape(CLOSING)}]*+[\x20\x09-\x0D]*([^\x20\x09-\x0D]+" + ("" if width is None else r"(?=[\x20\x09-\x0D])") + ")", 1))

    def within(width: int, wider: Column) -> Column:
        return _let(word(width), lambda w: F.when(w != "", w).otherwise(wider))

    found = word(None)
    for width in reversed(WINDOWS):
        found = within(width, found)
    return found


def shape(instance: Column) -> Column:
    """The instance with digits as 9 and runs of letters as a."""
    return F.regexp_replace(F.regexp_replace(instance, r"\p{L}+", "a"), "[0-9]", "9")


def bare(spans: Column) -> Column:
    """Spans without the quotes and stops at their edges; what has nothing else goes."""

    def trimmed(s: Column) -> Column:
        tail = F.rtrim(s["hit"], F.lit(CLOSING))
        hit = F.ltrim(tail, F.lit(OPENING))
        start = s["start"] + F.char_length(tail) - F.char_length(hit)
        return F.struct(start.alias("start"), (start + F.char_length(hit)).alias("end"), hit.alias("hit"))

    return F.filter(F.transform(spans, trimmed), lambda s: s["hit"] != "")


def _occurrences(text: str, spans: Column, known: bool, runs: Column | None = None) -> Column:
    """Instances with the patterns around them; before a run of ``runs``, the instance of what stands before is the run, not its first word."""
    source = F.col(text)

    def patterns(s: Column, words: Column, first: Column) -> Column:
        one = F.element_at(words, 2)
        both = F.concat(F.lit("LR "), one, F.lit(" _ "), first)
        alone = F.when(one != "", F.concat(F.lit("B "), one))
        shaped = F.when(one != "", F.concat(F.lit("S "), one, F.lit(" "), shape(s["hit"])))
        every = F.array(F.trim(F.concat(F.lit("L "), F.element_at(words, 1), F.lit(" "), one)), both, alone, shaped)
        if runs is not None:
            every = F.when(F.exists(runs, lambda r: r["start"] == s["start"]), F.array(both, shaped)).otherwise(every)
        return F.filter(every, lambda p: p.isNotNull() & ~p.isin("L", "LR  _ "))

    def occurrence(s: Column) -> Column:
        around = _let(_last_words(source, s["start"]), lambda words: _let(_first_word(source, s["end"]), lambda first: patterns(s, words, first)))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("instance"), around.alias("patterns"), F.lit(known).alias("known"))

    return F.transform(spans, occurrence)


def scanned(docs: DataFrame) -> DataFrame:
    """One row a document: its key, base spans, and seeds and candidates with their contexts; stored."""
    text = text_or_empty()
    base = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    base = base.withColumn("k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))).withColumn("absent", F.col("doc_id").isNull())
    found = with_matches(with_base_spans(base), "text", "word", CANDIDATE, "[0-9]")
    found = with_matches(found, "text", "run", RUN, "[0-9]")
    found = found.withColumn("base", F.concat(*KINDS))
    clear = lambda spans: F.filter(spans, lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"])))
    found = found.withColumn("clear", clear(bare(F.col("word")))).withColumn("runs", clear(bare(F.col("run"))))
    seen = F.concat(
        _occurrences("text", F.col("base"), True),
        _occurrences("text", F.col("clear"), False, F.col("runs")),
        _occurrences("text", F.col("runs"), False),
    )
    counts = [F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return cut(found.select("doc_id", *ROW, *counts, "base", seen.alias("seen")))


def confident_instances(edges: DataFrame) -> DataFrame:
    """Distinct unknown instances that the graph of ``pattern, instance, known`` makes known.

    Scores never fall from one round to the next and are 1 at most, so the rounds end.
    """
    graph = cut(edges.groupBy("pattern", "instance").agg(F.max(F.col("known").cast("double")).alias("seed")))
    unknown = graph.where("seed = 0")
    by_instance, by_pattern = cut(heavy_keys(graph, "instance")), cut(heavy_keys(unknown, "pattern"))
    believed = graph.where("false").select("instance", F.col("seed").alias("score"))
    while True:
        old = believed.withColumnRenamed("score", "old")
        scored = dealt_join(graph, old, "instance", "left", by_instance).withColumn("belief", F.greatest("seed", "old"))
        patterns = scored.groupBy("pattern").agg(
            F.sum("belief").alias("support"), (F.sum("belief") / F.count(F.lit(1))).alias("confidence")
        )
        good = patterns.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= PATTERN_CONFIDENCE)).select("pattern", "confidence")
        miss = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999))))
        scores = dealt_join(unknown, good, "pattern", heavy=by_pattern).groupBy("instance").agg((1 - F.exp(miss)).alias("score"))
        # the order of a sum may move a score by its last bits; what is known stays so
        risen = scores.where(F.col("score") >= INSTANCE_CONFIDENCE).join(old, "instance", "full")
        found = cut(risen.select("instance", F.greatest("score", "old").alias("score"), F.coalesce("old", F.lit(0.0)).alias("old")))
        rise = found.agg(F.max(F.col("score") - F.col("old"))).first()[0]
        believed = found.drop("old")
        if rise is None or rise <= TOLERANCE:
            return believed.select("instance")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, the row's key ``k, absent, h``, counts of base spans, ``base`` and ``spans`` (base and context spans)."""
    rows = scanned(docs)
    seen = rows.where(F.size("seen") > 0).select(*ROW, F.explode("seen").alias("s")).select(*ROW, "s.*")
    edges = seen.select("instance", "known", F.explode("patterns").alias("pattern"))
    unknown = seen.where("not known").select(*ROW, "start", "end", "instance")
    more = dealt_join(unknown, confident_instances(edges), "instance").select(*ROW, "start", "end", "instance").distinct()
    # words inside a found run are part of its span
    inside = W.partitionBy(*ROW).orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    more = more.withColumn("reach", F.max("end").over(inside)).where("reach is null or end > reach")
    span = F.struct("start", F.lit(len(KINDS)).alias("order"), "end", F.lit("context").alias("kind"), F.col("instance").alias("hit"))
    more = more.groupBy(*ROW).agg(F.array_sort(F.collect_list(span)).alias("more"))
    joined = rows.join(more, list(ROW), "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return joined.select("doc_id", *ROW, *[f"n_{kind}" for kind in KINDS], "base", spans.alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context`` for every row of ``docs``.

    Null and empty texts have no spans and the digest of the empty string.  Rows that repeat id and text get equal
    rows and count once as support, as instances are distinct; null ids are rows of their own; an empty table gives
    no rows.  Counts and digest are those of the base patterns; ``spans`` lists base spans by kind and start, then
    context spans by start.
    """
    found = find(docs)
    return found.select(
        "doc_id",
        *[f"n_{kind}" for kind in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("bigint").alias("n_context"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by the kind in brackets; overlapping spans give one mark, that of the first.

    Null texts stay null; the columns are those of ``docs``.
    """
    found = find(docs).where(F.size("spans") > 0).select(*[F.col(c).alias(f"_{c}") for c in ROW], F.col("spans").alias("_spans")).dropDuplicates([f"_{c}" for c in ROW])
    same = (
        (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)) == F.col("_k"))
        & (F.col("doc_id").isNull() == F.col("_absent"))
        & (F.xxhash64(text_or_empty()) == F.col("_h"))
    )
    joined = docs.join(found, same, "left")
    spans = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def mask(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        marked = F.concat(state["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = F.struct(s["end"].alias("at"), marked.alias("out"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out")))

    rest = lambda state: F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, F.char_length("text")))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.aggregate(spans, begin, mask, rest))
    return joined.withColumn("text", text).select(*docs.columns)
