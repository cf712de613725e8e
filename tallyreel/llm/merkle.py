"""Document fingerprints: a Merkle tree over sections, paragraphs and blocks, in DataFrame functions.

Two line breaks in a row end a section, one a paragraph. Blocks of up to four words, counted from
the paragraph's start and with the white space around them, are the leaves: every character of a
paragraph is in one. A leaf's node is its SHA-256; a paragraph's node, a section's and the root are
the SHA-256 of the nodes below them. Joining leaves, paragraphs and sections gives the text again,
so roots are equal exactly if texts are. Where they differ, walking down finds the paragraphs.

Two trees are alike in the leaves that both have, weighted by their characters. A word put in or
taken out changes leaves of its own paragraph only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyreel.llm import storage

SECTION, PARAGRAPH = r"\n\n", r"\n"
# Every character of a paragraph belongs to one leaf; the quantifiers never give back what they took.
LEAF = r"[ \t\x0B\f\r]*+(?:[^ \t\x0B\f\r]++[ \t\x0B\f\r]*+){1,4}+|[ \t\x0B\f\r]++"


def leaves(text: Column) -> Column:
    """The blocks of a text by section and paragraph: array of arrays of arrays."""

    def of_paragraph(paragraph: Column) -> Column:
        return F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0))

    return F.transform(F.split(text, SECTION), lambda s: F.transform(F.split(s, PARAGRAPH), of_paragraph))


def _over(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def paragraphs(tree: Column) -> Column:
    """Nodes of the paragraphs, by section: array of arrays."""
    return F.transform(tree, lambda s: F.transform(s, lambda p: _over(F.transform(p, lambda b: F.sha2(b, 256)))))


def root(nodes: Column) -> Column:
    """The root over paragraph nodes, hexadecimal."""
    return _over(F.transform(nodes, _over))


def blocks(tree: Column) -> Column:
    """The distinct leaves of a tree."""
    return F.array_distinct(F.flatten(F.flatten(tree)))


def _characters(own: Column) -> Column:
    return F.aggregate(own, F.lit(0).cast("long"), lambda n, b: n + F.char_length(b))


def likeness(root_a: Column, blocks_a: Column, root_b: Column, blocks_b: Column) -> Column:
    """1 for equal roots, else the share of characters in leaves that both trees have (Dice)."""
    common = _characters(F.array_intersect(blocks_a, blocks_b))
    both = _characters(blocks_a) + _characters(blocks_b)
    return F.when(root_a == root_b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2.0 * common / both)


def changes(nodes_a: Column, nodes_b: Column) -> Column:
    """Numbers of the paragraphs (from 1, over all sections) whose nodes differ, in order."""
    differ = F.zip_with(F.flatten(nodes_a), F.flatten(nodes_b), lambda a, b: ~a.eqNullSafe(b))
    numbered = F.transform(differ, lambda d, i: F.when(d, i + 1))
    return F.filter(numbered, lambda i: i.isNotNull())


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_chars, fingerprint`` of each row; a null text is an empty one."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.char_length(text).cast("long").alias("n_chars"),
        root(paragraphs(leaves(text))).alias("fingerprint"),
    )


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row with its id, text and the text of the next row by descending id.

    After the last row comes the first. Rows of one id are ordered by their texts' hash,
    rows without id come last. Ranges of ids are sorted by themselves, so no task sees all
    rows; the ends of the ranges, two rows each, are then put together.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    ranges = storage.chunk_count(rows, "text")
    order = [F.col("id").desc_nulls_last(), F.col("tie").desc()]
    placed = storage.settle_ranges(rows, ranges, order, "ranges")
    row = F.struct(F.col("id").isNotNull().alias("known"), "id", "tie", "text")
    ends = storage.settle(placed.groupBy("range").agg(F.max(row).alias("head"), F.min(row).alias("tail")), "ends")
    along = W.orderBy("range")  # one number for each range; texts are joined to them afterwards
    after = F.coalesce(F.lead("range").over(along), F.first("range").over(along))
    steps = ends.select("range").withColumn("after", after)
    heads = ends.select(F.col("range").alias("after"), "head")
    last = steps.join(ends.select("range", "tail"), "range").join(heads, "after")
    last = last.select("tail.id", "tail.text", F.col("head.text").alias("next_text"))
    inside = W.partitionBy("range").orderBy(*order)
    main = placed.select("id", "text", F.lead("text").over(inside).alias("next_text")).filter("next_text IS NOT NULL")
    return main.union(last)


def edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of texts and of edited texts, and how alike texts are.

    The edited text has its last third (floor of n_chars / 3 code points) replaced by the first
    as many of the next row's text, or all of it. ``near_edited`` and ``near_next`` are the
    likeness to the edited text and to the next text; ``edited_paragraphs`` are the numbers of
    the paragraphs that the edit changed, in order.
    """
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    texts = with_next(docs, id_column, text_column).withColumn("edited", edited)
    kinds = ("text", "edited", "next_text")
    trees = texts.select(
        "id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        *[leaves(F.col(c)).alias(c) for c in kinds],
    )
    noded = trees.select(
        "id",
        "n_chars",
        "edited_sha256",
        *[paragraphs(F.col(c)).alias(f"{c}_nodes") for c in kinds],
        *[blocks(F.col(c)).alias(f"{c}_blocks") for c in kinds],
    )
    rooted = noded.select("*", *[root(F.col(f"{c}_nodes")).alias(f"{c}_root") for c in kinds])

    def near(other: str) -> Column:
        return likeness(
            F.col("text_root"), F.col("text_blocks"), F.col(f"{other}_root"), F.col(f"{other}_blocks")
        )

    return rooted.select(
        "id",
        "n_chars",
        "edited_sha256",
        F.col("text_root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        near("edited").alias("near_edited"),
        near("next_text").alias("near_next"),
        changes(F.col("text_nodes"), F.col("edited_nodes")).alias("edited_paragraphs"),
    )


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Per document: fingerprints of its text and of an edited one, and likenesses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    changed = F.col("edited_paragraphs")
    found = edits(docs).withColumnRenamed("id", "doc_id").withColumn("n_edited", F.size(changed).cast("long"))
    return found.withColumn("edited_from", F.coalesce(F.get(changed, F.lit(0)), F.lit(0)).cast("long")).drop(changed)
