"""Removal of lines that stand, or nearly stand, earlier in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.simhash import text_key
from eventloom.session import stage_once

#: Edits within which an earlier line makes a line go.
EDITS = 1
#: Characters of a block: a variant deletes within one block and hashes what is before and after it once.
BLOCK = 128
#: Size of the broadcast filters: at most this many integers, whatever the input's size.
SLOTS = 1 << 20


def blank(line: Column) -> Column:
    return F.length(F.trim(line)) == 0


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, place, line) for every line that is not blank."""
    return docs.select(
        "doc_id", text_key("text").alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"),
    ).filter(~blank(F.col("line")))


def _hash(line: str) -> list[Column]:
    return [F.xxhash64(line).alias("line_a"), F.xxhash64(F.lit("second"), line).alias("line_b")]


def _half_keys(line: str) -> Column:
    """Hashes of both halves of a line; two lines one edit apart share a half.

    The edit leaves at least floor(n/2) characters in common on one side of it, n being the shorter length; the
    longer line also offers the half that belongs to its length less one.
    """
    size = F.length(line)
    keys = []
    for n in (size, size - 1):
        half = F.floor(n / 2).cast("int")
        keys.append(F.xxhash64(F.lit("head"), half, F.substring(line, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("tail"), half, F.substring(line, size - half + 1, half)))
    return F.array_distinct(F.array(*keys))


def _blocks(line: str) -> Column:
    """Blocks of a line: number, hash of what is before it, its text, hash of what follows, and ``whole``, the key of
    the line as it is, cut as a line with one more character in this block is cut after its deletion."""
    column = F.col(line)

    def block(b: Column) -> Column:
        start = b * BLOCK
        before = F.xxhash64(F.substring(column, F.lit(1), start))
        rest = F.xxhash64(F.substring(column, start + BLOCK, F.length(column)))
        return F.struct(
            b.alias("b"), before.alias("before"), F.substring(column, start + 1, F.lit(BLOCK)).alias("block"),
            F.xxhash64(F.substring(column, start + BLOCK + 1, F.length(column))).alias("after"),
            F.xxhash64(b, before, F.substring(column, start + 1, F.lit(BLOCK - 1)), rest).alias("whole"),
        )

    return F.transform(F.sequence(F.lit(0), F.floor(F.length(line) / BLOCK).cast("int")), block)


def _variants(p: str) -> Column:
    """(variant, place): hashed keys of a line itself (place 0) and of the line without the character at ``place`` of block ``p``.

    A key is made of the block's number, the hash of what is before it, the block's text without the character,
    and the hash of what follows.
    """
    block = F.col(f"{p}.block")
    places = F.when(F.length(block) > 0, F.sequence(F.lit(1), F.length(block))).otherwise(F.array().cast("array<int>"))
    deleted = F.transform(places, lambda i: F.struct(F.xxhash64(
        F.col(f"{p}.b"), F.col(f"{p}.before"), F.concat(F.substring(block, F.lit(1), i - 1), F.substring(block, i + 1, F.lit(BLOCK))),
        F.col(f"{p}.after"),
    ).alias("variant"), i.alias("place")))
    return F.concat(F.array(F.struct(F.col(f"{p}.whole").alias("variant"), F.lit(0).alias("place"))), deleted)


def _deletions(line: str, edits: int) -> Column:
    """All strings that up to ``edits`` deletions leave of a line; as many as its length to that power."""
    found = F.array(F.col(line))
    for _ in range(edits):
        places = lambda s: F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
        shorter = F.flatten(F.transform(found, lambda s: F.transform(places(s), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
        found = F.array_distinct(F.concat(found, shorter))
    return found


def _slot(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit(SLOTS - 1))


def _among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``key`` is in ``wanted`` (one column of the same name): a broadcast of at most SLOTS slot numbers
    passes all of them and few others, which the join then leaves out."""
    slots = F.broadcast(wanted.select(_slot(key).alias("_slot")).distinct())
    passed = rows.withColumn("_slot", _slot(key)).join(slots, "_slot", "left_semi").drop("_slot")
    return passed.join(wanted, key, "left_semi")


def _met_within_one(texts: DataFrame) -> DataFrame:
    """(x, y): a line y and the earliest line x that stands before it and shares a variant so that one edit parts them.

    Lines of one length are one edit apart if they agree without the character at the same place; a line and a longer one
    if the longer one agrees with the whole shorter one after a deletion. So the earliest line of a variant, by place and
    as a whole, decides, and no two lines of a variant are paired. Only distinct lines come here: a variant of n
    characters has at most n + 1 places for each character of the alphabet.
    """
    cut = texts.select(F.struct("first", "line_a", "line_b").alias("y"), F.explode(_blocks("line")).alias("p"))
    keyed = cut.select("y", F.explode(_variants("p")).alias("k")).select("y", "k.variant", "k.place")
    whole, some = F.col("place") == 0, Window.partitionBy("variant")
    seen = keyed.select(
        "y", "place", F.min(F.when(whole, F.col("y"))).over(some).alias("as_whole"), F.min(F.when(~whole, F.col("y"))).over(some).alias("as_part"),
        F.min("y").over(Window.partitionBy("variant", "place")).alias("as_same"),
    )
    earlier = F.when(F.col("place") == 0, F.col("as_part")).otherwise(F.least("as_whole", "as_same"))
    return seen.select(earlier.alias("x"), "y").filter(F.col("x.first") < F.col("y.first"))


def _met_within(texts: DataFrame, edits: int) -> DataFrame:
    """(x, y): lines y and x before it that have a string in common after up to ``edits`` deletions each."""
    keyed = texts.select(F.struct("first", "line_a", "line_b").alias("y"), F.explode(F.transform(_deletions("line", edits), lambda v: F.xxhash64(v))).alias("variant"))
    return keyed.withColumnRenamed("y", "x").join(keyed, "variant").filter(F.col("x.first") < F.col("y.first")).select("x", "y")


def near_lines(docs: DataFrame, firsts: DataFrame, edits: int = EDITS) -> DataFrame:
    """(line_a, line_b) of distinct lines that have an earlier line within the edit bound.

    ``firsts``: (line_a, line_b, first, keys) per distinct line, of any length. All variants within the bound are emitted
    as hashed keys, lines with equal variants joined and their edit distance verified. With a bound of one edit only
    lines that share a half with another emit variants, as no other line can be near. Larger bounds are for short lines:
    the variants of a line grow with its length to the power of the bound.
    """
    if edits < 1:
        return firsts.select("line_a", "line_b").limit(0)
    hashed = _lines(docs).select(F.xxhash64("line").alias("line_a"), "line")
    if edits == 1:
        halves = firsts.select("line_a", F.explode("keys").alias("key"))
        shared = halves.groupBy("key").agg(F.min("line_a").alias("low"), F.max("line_a").alias("high")).filter("low <> high").select("key")
        shared = stage_once(shared, "shared-halves")
        hashed = _among(hashed, "line_a", stage_once(_among(halves, "key", shared).select("line_a").distinct(), "near-candidates"))
    texts = hashed.groupBy("line_a", F.xxhash64(F.lit("second"), "line").alias("line_b")).agg(F.first("line").alias("line"))
    texts = stage_once(texts.join(firsts.select("line_a", "line_b", "first"), ["line_a", "line_b"]), "near-texts")
    met = stage_once((_met_within_one(texts) if edits == 1 else _met_within(texts, edits)).distinct(), "near-pairs")
    named = lambda side: texts.select(
        F.col("line_a").alias(f"{side}_a"), F.col("line_b").alias(f"{side}_b"), F.col("line").alias(f"{side}_line"),
    )
    pairs = met.select(*[F.col(f"{s}.line_{k}").alias(f"{s}_{k}") for s in "xy" for k in "ab"])
    pairs = pairs.join(named("x"), ["x_a", "x_b"]).join(named("y"), ["y_a", "y_b"])
    close = pairs.filter(F.levenshtein("x_line", "y_line", edits) >= 0)
    return close.select(F.col("y_a").alias("line_a"), F.col("y_b").alias("line_b")).distinct()


def dedup_lines(docs: DataFrame, carried: str | None = None, edits: int = EDITS) -> DataFrame:
    """(doc_id, text_key, text, n_lines, n_kept) for every row of ``docs`` (columns ``doc_id``, ``text``): the lines to keep.

    Lines are what stands between line feeds. A line goes if an equal line stands earlier, by ascending
    ``doc_id`` (NULL last, then a hash of the text) and place, or if a line within ``edits`` edits (a character more,
    less or changed) stands earlier; lines of any length count, so one-character lines are all near each other. Both
    are judged on the input: a line that goes can still be what another is near to. Blank lines stay; a text that loses lines and has
    only blank ones left becomes empty. Kept lines are joined by line feeds. ``n_lines`` and ``n_kept`` count
    lines that are not blank.

    NULL texts stay NULL, with no lines. Rows with the same id and text are the same document: they come out
    alike, as often as they went in. Lines of any length are compared whole. Other columns are not read, but
    the column named ``carried`` comes out too; an empty table gives no rows.
    """
    extra = [carried] if carried else []
    whole, docs = docs.select("doc_id", "text", *extra), docs.select("doc_id", "text")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "place")
    lines = _lines(docs).select(*_hash("line"), order.alias("at"), _half_keys("line").alias("keys"))
    firsts = stage_once(lines.groupBy("line_a", "line_b").agg(F.min("at").alias("first"), F.first("keys").alias("keys")), "first-lines")
    late = stage_once(near_lines(docs, firsts, edits), "late-lines")
    kept = firsts.select("line_a", "line_b", "first").join(late, ["line_a", "line_b"], "left_anti")
    kept = kept.groupBy(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key")).agg(F.collect_list("first.place").alias("kept"))
    kept = stage_once(kept, "kept-lines")
    rows = whole.withColumn("text_key", text_key("text"))
    joined = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["text_key"] == kept["_key"]), "left")
    parts = F.split("text", "\n", -1)
    blanks = F.filter(F.transform(F.col("parts"), lambda line, i: F.when(blank(line), i)), lambda i: i.isNotNull())
    places = F.array_sort(F.concat(F.coalesce("kept", F.array().cast("array<int>")), F.col("blanks")))
    joined = joined.withColumn("parts", parts).withColumn("blanks", blanks).withColumn("places", places)
    n_lines = F.size("parts") - F.size("blanks")
    n_kept = F.coalesce(F.size("kept"), F.lit(0))
    text = F.when((n_kept == 0) & (n_lines > 0), F.lit("")).otherwise(
        F.array_join(F.transform("places", lambda p: F.get(F.col("parts"), p)), "\n"),
    )
    is_text = F.col("text").isNotNull()
    return joined.select(
        "doc_id", "text_key", F.when(is_text, text).alias("text"), F.when(is_text, n_lines).otherwise(0).cast("long").alias("n_lines"),
        F.when(is_text, n_kept).otherwise(0).cast("long").alias("n_kept"),
        *extra,
    )


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` with all its columns and rows, each text without the lines that ``dedup_lines`` removes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_others"))
    out = dedup_lines(whole, carried="_others", edits=edits)
    return out.select(*[f"`{c}`" if c in ("doc_id", "text") else F.col("_others")[c].alias(c) for c in docs.columns])
