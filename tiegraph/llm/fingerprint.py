"""Document fingerprints: a Merkle tree over sections, paragraphs and spans, with DataFrame functions only.

A text is cut into sections at empty lines, a section into paragraphs at line ends, a paragraph into spans at blanks
that the text itself marks (SPAN_EDGE), so that an edit moves no other edge. A paragraph's hash covers its characters,
a section's hash the hashes of its paragraphs, the root those of its sections. Cuts lose nothing, so equal roots mean
equal texts. The fingerprint is ``root|section hashes|paragraph hashes|span hashes``: comparing level by level finds
the branches that differ (``differing``), and the share of common spans is the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiegraph.llm import common

#: A line end, or a blank after and before certain characters: every four to six words in Latin scripts.
SPAN_EDGE = r"\n|(?<=[etyo.,;:!?]|[^\x00-\x7F]) (?=[a-hA-H0-9]|[^\x00-\x7F])"
MAX_BUCKETS = 16_384
ROWS_PER_BUCKET = 2_000


def span_hashes(text: Column) -> Column:
    """Distinct 32-bit hashes of the spans of a text."""
    return F.array_distinct(F.transform(F.split(text, SPAN_EDGE, -1), lambda s: F.hash(s)))


def tree(text: Column) -> Column:
    """struct(root, sections, paragraphs) of a text: hex strings."""
    sections = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.md5(p)))
    hashes = F.transform(sections, lambda ps: F.md5(F.concat_ws(",", ps)))
    return F.struct(
        F.sha2(F.concat_ws(",", hashes), 256).alias("root"),
        F.transform(hashes, lambda h: F.substring(h, 1, 8)).alias("sections"),
        F.transform(sections, lambda ps: F.concat_ws(".", F.transform(ps, lambda p: F.substring(p, 1, 8)))).alias("paragraphs"),
    )


def rendered(tree_: Column, spans: Column) -> Column:
    """The fingerprint as a string."""
    return F.concat_ws("|", tree_["root"], F.concat_ws(".", tree_["sections"]), F.concat_ws("/", tree_["paragraphs"]), F.concat_ws(".", F.transform(spans, lambda s: F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF))))))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column; a missing text is empty."""
    text = F.coalesce(text, F.lit(""))
    return rendered(tree(text), span_hashes(text))


def span_likeness(a: Column, b: Column) -> Column:
    """Twice the common spans over the spans of both (0 to 1)."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, as strings: 1 if the roots are equal."""
    level = lambda x: F.split(F.element_at(F.split(x, r"\|"), 4), r"\.")
    same = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    return F.when(same, 1.0).otherwise(span_likeness(level(a), level(b)))


def differing(a: Column, b: Column) -> Column:
    """Positions (from 0) of the paragraphs of fingerprint ``a`` that fingerprint ``b`` has nowhere; none if roots are equal."""
    level = lambda x: F.split(F.element_at(F.split(x, r"\|"), 3), "[./]")
    own, other = level(a), level(b)
    at = F.filter(F.transform(own, lambda p, i: F.when(~F.array_contains(other, p), i)), lambda i: i.isNotNull())
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.array().cast("array<int>")).otherwise(at)


def _edges(docs: DataFrame, rows_per_bucket: int) -> list[int]:
    """The least ids of about equal ranges of doc_id: ids of the table, at most MAX_BUCKETS."""
    rows = docs.count()
    n = min(MAX_BUCKETS, max(1, rows // rows_per_bucket))
    cut = F.percentile_approx("_ord", [k / n for k in range(1, n)], min(20 * n, 10**6)) if n > 1 else F.array().cast("array<long>")
    got = docs.agg(F.min("_ord").alias("least"), cut.alias("cut")).head()
    return sorted({got["least"], *(got["cut"] or [])}) if rows else []


def with_next_text(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add next_text: the text of the next row by doc_id (after the last: the first), with one shuffle of the texts.

    Rows are dealt into ranges of doc_id whose least ids are known. A row with such an id goes to the range before
    as well, as the row that follows its last one; rows of the least id go to the last range. Rows without an id
    come last; rows of one id follow each other by text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    docs = docs.withColumn("_ord", F.coalesce("doc_id", F.lit(2**63 - 1)))
    edges = _edges(docs.select("_ord"), rows_per_bucket)
    n = len(edges)
    if not n:
        return docs.select("doc_id", "text", F.lit("").alias("next_text"))
    listed = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<bigint>")
    steps = [F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)]
    # binary search in the sorted edges: how many of them aren't above the row's place
    found = F.aggregate(F.array(*steps), F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(listed, at + s - 1) <= F.col("_ord")), at + s).otherwise(at))
    placed = docs.withColumn("_bucket", found)
    first = F.get(listed, F.col("_bucket") - 1) == F.col("_ord")
    homes = F.when(first, F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g")), F.struct(F.when(F.col("_bucket") == 1, n).otherwise(F.col("_bucket") - 1).alias("b"), F.when(F.col("_bucket") == 1, 2).otherwise(1).alias("g"))))
    homes = homes.otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g"))))
    dealt = placed.withColumn("_home", F.explode(homes)).select("doc_id", "text", "_ord", F.col("_home.b").alias("_b"), F.col("_home.g").alias("_g"))
    after = Window.partitionBy("_b").orderBy("_g", "_ord", "text")
    return dealt.withColumn("next_text", F.lead("text").over(after)).where("_g = 0").select("doc_id", "text", "next_text")


def fingerprint_pairs(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per row of ``docs``: its fingerprint, that of its edited text (the second half replaced by the start of the next
    document), and the likeness of the first to the second and to the next document's.

    Missing texts are empty. Two empty texts have likeness 1. Repeated rows give repeated results.
    """
    both = with_next_text(docs, rows_per_bucket)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    # a Generate between them keeps Catalyst from computing the arrays again wherever they are used
    cuts = F.explode(F.array(F.struct(*[F.struct(tree(F.col(c)).alias("tree"), span_hashes(F.col(c)).alias("spans")).alias(c) for c in ("text", "edited")], F.struct(span_hashes(F.col("next_text")).alias("spans")).alias("next"))))
    cut = both.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), (F.col("text") == F.col("next_text")).alias("same_next"), cuts.alias("c"))
    own, edited, following = F.col("c.text"), F.col("c.edited"), F.col("c.next")
    return cut.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        rendered(own["tree"], own["spans"]).alias("fingerprint"),
        rendered(edited["tree"], edited["spans"]).alias("edited_fingerprint"),
        F.when(own["tree"]["root"] == edited["tree"]["root"], 1.0).otherwise(span_likeness(own["spans"], edited["spans"])).alias("near_edited"),
        F.when(F.col("same_next"), 1.0).otherwise(span_likeness(own["spans"], following["spans"])).alias("near_next"),
    )
