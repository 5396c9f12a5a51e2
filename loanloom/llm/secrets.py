"""Secret scans by corpus-wide ownership.

Three fixed patterns give the base spans.  Their secrets, and other long mixed tokens, are candidates: each is hashed
and the whole corpus counts in how many distinct repositories and of how many distinct owners a hash occurs.  What
many owners share is a copied example; what few own and looks random is a live-looking credential.  Candidates of
that second kind are added as spans of kind ``owned`` where no base span covers them; base spans stay.

A repository is a document's ``source``, its owner the part before the first slash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import cut, text_or_empty
from loanloom.llm.spans import kept, listed, of_kind, with_matches

KINDS = ("assign", "access", "hex")
ASSIGN_NAME = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?"
ASSIGN = ASSIGN_NAME + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Long tokens with a digit, a letter and nothing but key characters.
LONG = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
#: Hashes of so many owners are copied examples; bits a character that a live-looking secret has at least.
WIDE_OWNERS, LEAST_BITS = 3, 3.0
ROW = ("k", "absent", "h", "repository")


def bits(text: Column) -> Column:
    """Shannon entropy of a short text in bits a character."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    length = F.size(letters).cast("double")
    sums = F.aggregate(
        F.array_distinct(letters),
        F.lit(0.0),
        lambda total, c: total + F.size(F.filter(letters, lambda x: x == c)) * F.log2(F.size(F.filter(letters, lambda x: x == c)) / length),
    )
    return F.when(length > 0, -sums / length).otherwise(0.0)


def secret_of(kind: Column, hit: Column) -> Column:
    """The secret within a match: without the name and quotes before it in an assignment."""
    return F.when(kind == "assign", F.regexp_replace(hit, "^" + ASSIGN_NAME, "")).otherwise(hit)


def with_base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``base``: the passing matches of all kinds by start, then kind as listed."""
    df = with_matches(df, text, "assign", ASSIGN, r"(?i:word|passwd|secret|token|key)[\"']?\x20*[:=]")
    df = with_matches(df, text, "access", ACCESS, "AKIA")
    df = with_matches(df, text, "hex", HEX, "[0-9a-f]{24}")
    long_enough = lambda hit: F.char_length(secret_of(F.lit("assign"), hit)) >= 6
    df = df.withColumn("assign", kept("assign", long_enough))
    return df.withColumn("base", F.array_sort(F.concat(*[of_kind(F.col(kind), kind, order) for order, kind in enumerate(KINDS)])))


def scanned(docs: DataFrame) -> DataFrame:
    """One row a document: its key and its base and candidate spans; stored."""
    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"), F.coalesce("source", F.lit("")).alias("repository"))
    rows = rows.withColumn("k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))).withColumn("absent", F.col("doc_id").isNull())
    found = with_matches(with_base_spans(rows), "text", "long", LONG, "[A-Za-z0-9+/_=-]{20}")
    clear = F.filter("long", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"])))
    found = found.withColumn("clear", of_kind(clear, "owned", len(KINDS)))
    return cut(found.select("doc_id", *ROW, *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in KINDS], "base", "clear"))


def ownership(occurrences: DataFrame) -> DataFrame:
    """``digest, n_repositories, n_owners`` from ``digest, repository``; a hash of any number of rows comes down to its owners first."""
    owners = occurrences.select("digest", "repository", F.substring_index("repository", "/", 1).alias("owner")).distinct()
    return owners.groupBy("digest").agg(F.count(F.lit(1)).alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))


def find(docs: DataFrame) -> DataFrame:
    """The rows of ``scanned`` with ``spans``, ``n_live`` and ``n_copied``."""
    rows = scanned(docs)
    each = rows.select(*ROW, F.explode(F.concat("base", "clear")).alias("s"))
    secret = secret_of(F.col("s.kind"), F.col("s.hit"))
    each = each.select(*ROW, "s", F.sha2(secret, 256).alias("digest"), (bits(secret) >= LEAST_BITS).alias("random"))
    judged = each.join(ownership(each), "digest")
    copied = F.col("n_owners") >= WIDE_OWNERS
    live = ~copied & F.col("random")
    by_row = judged.groupBy(*ROW, "s").agg(F.first(live).alias("live"), F.first(copied).alias("copied")).groupBy(*ROW).agg(
        F.array_sort(F.collect_list(F.when(F.col("live") & (F.col("s.kind") == "owned"), F.col("s")))).alias("more"),
        F.count_if("live").alias("n_live"),
        F.count_if("copied").alias("n_copied"),
    )
    joined = rows.join(by_row, list(ROW), "left")
    nothing = F.coalesce("more", F.array().cast(joined.schema["more"].dataType))
    return joined.withColumn("spans", F.array_sort(F.concat("base", nothing))).fillna(0, ["n_live", "n_copied"])


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied`` for every row of ``docs``.

    Null and empty texts have no spans and the digest of the empty string; a null source is a repository of its own
    that owns what it has.  Rows that repeat id, text and source get equal rows; null ids are rows of their own; an
    empty table gives no rows.  Counts and digest are those of the base patterns, ``spans`` lists base and owned
    spans by start, ``n_live`` and ``n_copied`` count the spans by the verdict on their secret.
    """
    found = find(docs)
    return found.select(
        "doc_id",
        *[f"n_{kind}" for kind in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
    )
