"""Spot signatures: chains of content words that follow common-word anchors.

A text is lower-cased and cut at everything but letters and digits.  At each anchor, the next two words that are not
stop words make a chain.  The fingerprint is the set of hashed (anchor, word, word) chains.  As some texts have few
anchors, a sample of anchor-free pairs of a word and the word after it joins the set at every length: those whose hash
is 0 modulo ``SAMPLE``, and the one with the least hash, so that every text with a word has a signature.  Whether a
pair is taken depends on the pair alone, so an edit changes the set in proportion and no bound of size exists.
Everything is array functions on columns: no Python runs on the executors.

``near_pairs`` searches a corpus: sets are partitioned by their size so that only the same and the next partition can
hold a partner, candidates share one of a set's rarest signatures, and the Jaccard comparison is pruned by size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import cut, numbered, text_or_empty

#: Anchors and stop words of four languages.
ANCHORS = ("the", "is", "that", "was", "die", "und", "ist", "das", "la", "et", "est", "les", "el", "que", "los", "una")
STOP_WORDS = (
    *ANCHORS, "of", "and", "to", "in", "a", "for", "it", "with", "as", "by", "on", "be", "at", "are", "this", "from", "or", "an",
    "der", "den", "von", "zu", "mit", "sich", "des", "auf", "ein", "eine", "im", "dem", "nicht", "als", "auch",
    "le", "de", "un", "une", "du", "en", "dans", "qui", "par", "pour", "au", "sur", "pas",
    "y", "se", "del", "las", "por", "con", "para", "su", "es", "al", "lo",
)
#: One in so many anchor-free pairs is a signature.
SAMPLE = 16
ANCHOR_END, WORD_END = "\x01", "\x02"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _places(words: Column) -> Column:
    """Content words, each glued to the anchors before it; other stop words are gone.  The last place has no word."""
    ended = lambda w: F.when(~w.isin(*STOP_WORDS), F.concat(w, F.lit(WORD_END))).when(w.isin(*ANCHORS), F.concat(w, F.lit(ANCHOR_END)))
    return F.split(F.concat_ws("", F.transform(words, ended)), WORD_END)


def _anchored(places: Column) -> Column:
    """Hashes of (anchor, word, word); the second word is empty at the end of a text."""
    following = F.slice(places, F.lit(2), F.size(places))
    spots = F.filter(
        F.arrays_zip(places.alias("here"), following.alias("next")), lambda s: F.contains(s["here"], F.lit(ANCHOR_END))
    )

    def chains(spot: Column) -> Column:
        parts = F.split(spot["here"], ANCHOR_END)
        first, second = F.element_at(parts, -1), F.substring_index(spot["next"], ANCHOR_END, -1)
        anchors = F.slice(parts, F.lit(1), F.size(parts) - 1)
        return F.when(first != "", F.transform(anchors, lambda a: F.xxhash64(a, first, second))).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(spots, chains))


def _pairs(words: Column) -> Column:
    following = F.slice(F.concat(words, F.array(F.lit(""))), F.lit(2), F.size(words))
    return F.zip_with(words, following, lambda a, b: F.xxhash64(F.lit("*"), a, b))


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the sorted set of signatures of a non-null text column; texts without words have none."""
    # columns of their own, as each is used more than once
    tokens, places, pairs = (f"_{name}_{part}" for part in ("words", "places", "pairs"))
    found = df.withColumn(tokens, words_of(F.col(text))).withColumn(places, _places(F.col(tokens))).withColumn(pairs, _pairs(F.col(tokens)))
    sampled = F.filter(pairs, lambda h: F.pmod(h, F.lit(SAMPLE)) == 0)
    least = F.filter(F.array(F.array_min(pairs)), lambda h: h.isNotNull())
    chosen = F.array_distinct(F.concat(_anchored(F.col(places)), sampled, least))
    return found.withColumn(name, F.array_sort(chosen)).drop(tokens, places, pairs)


def shown(signatures: Column) -> Column:
    """A set as text: hexadecimal hashes in ascending order."""
    return F.concat_ws("", F.transform(signatures, lambda s: F.lower(F.lpad(F.hex(s), 16, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id, taken_chars``.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document in ascending id, of the first after the last.  Null text counts as empty; a null id comes first;
    documents of one id follow each other in the order of a text hash; rows that repeat id and text count as one
    document and get equal rows.  A single document is its own next.  An empty table gives no rows.
    """
    text = text_or_empty()
    base = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"), F.char_length(text).cast("bigint").alias("n_chars"))
    key = ["k", "absent", "h"]
    base = base.withColumn("k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))).withColumn("absent", F.col("doc_id").isNull())
    order = base.select(~F.col("absent"), *key, "n_chars").toDF("present", *key, "n_chars").distinct()
    units = cut(numbered(order, ["present", "k", "h"]).drop("present"))
    wanted = [F.col(c).alias(f"to_{c}") for c in key]
    needs = units.select(((F.col("row") + 1) % F.col("rows")).alias("row"), F.expr("n_chars div 4").alias("need"), *wanted)
    givers = cut(units.select("row", *key).join(needs, "row").drop("row"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # each text's set is made once, before the one shuffle that both sides of the join read
    dealt = with_signatures(base, "text", "own").repartition(parts, *key)
    head = F.expr("substring(text, 1, cast(need as int))").alias("head")
    heads = dealt.join(givers, key).select(*[F.col(f"to_{c}").alias(c) for c in key], F.struct(head, "own", "doc_id", "n_chars").alias("next"))
    heads = heads.groupBy(*key).agg(F.first("next").alias("next"))
    joined = dealt.join(heads, key)
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"), F.col("next.head"))
    changed = with_signatures(joined.withColumn("edited", edited), "edited", "edited_own")
    return changed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next.own")).alias("near_next"),
        F.col("next.doc_id").alias("next_id"),
        F.least(F.expr("n_chars div 4"), F.col("next.n_chars")).alias("taken_chars"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members ``doc_id, class_id`` and links ``left_id, right_id, likeness`` between classes of equal fingerprints.

    A class goes by its smallest id.  Sets of sizes n and m can only reach ``threshold`` if min/max does, so a set of
    partition floor(log(size) / log(1 / threshold)) has partners in that partition and its neighbours only; each set
    is looked up by its size - ceil(threshold * size) + 1 rarest signatures.  Texts without words and rows without an
    id are linked with nothing; every link is given once, the smaller id left.
    """
    prints = with_signatures(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")), "text", "own")
    prints = cut(prints.where(F.col("doc_id").isNotNull()).select("doc_id", "own", shown(F.col("own")).alias("print")))
    known = prints.where(F.size("own") > 0)
    classes = known.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.first("own").alias("own"))
    classes = cut(classes.select("class_id", "own", "print").dropDuplicates(["class_id"]))
    members = prints.join(classes.select("print", "class_id"), "print", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    size = F.size("own")
    spots = classes.select("class_id", size.alias("n"), F.explode("own").alias("spot"))
    often = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("often"))
    ranked = spots.join(often, "spot").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "spot"))).alias("spots"))
    prefix = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    rare = ranked.select("class_id", "n", F.explode(F.slice("spots", F.lit(1), prefix)).alias("s")).where("s.often > 1")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    rare = cut(rare.select("class_id", "n", F.col("s.spot").alias("spot"), band.alias("band")))
    lower = rare.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), "spot", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    upper = rare.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), "spot", "band")
    fits = (F.col("n_a") >= F.col("n_b") * threshold) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    pairs = lower.join(upper, ["spot", "band"]).where(fits).select("a", "b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("class_id").alias(end), F.col("own").alias(f"own_{end}")), end)
    links = pairs.withColumn("likeness", likeness(F.col("own_a"), F.col("own_b"))).where(F.col("likeness") >= threshold)
    return members, links.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "likeness")
