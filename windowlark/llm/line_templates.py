"""Line deduplication by a log-template tree, in DataFrame operations only.

The tree has fixed depth: a line goes to the leaf of its token count and its first LEAD tokens, tokens with a digit read
as a variable field. In a leaf a token without a digit is constant at its position if at least ``min_docs`` lines (one per
document and wording) have it there. Of the constants of a line only those count that are at least half as frequent as
its ``min_constant`` most frequent ones, so that values of a variable field stay variable in however many documents each of
them is; with their positions they are its template. Digit tokens are no part of the share of constants, of which a
line needs one at least; a line that has too few is its own template. Lines of more than LONG tokens recur from LONG_DOCS
documents on, by their wording, or by a template with as many constants as one of LONG words must have. Of a recurring
template the first line (smallest document, then line) stays, all others are dropped.

Nothing depends on an order of arrival, so the tree is built by counting: leaves and lines are counted as hashes, and
tokens are only taken apart for lines, each wording once, whose leaf is common enough to recur and holds another
wording: alone in its leaf a wording can only recur as it stands, which its count decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.llm.support import fresh, small_enough, whole
from windowlark.session import discard, materialize

MIN_DOCS = 10
MIN_CONSTANT = 0.8
LEAD = 3
#: Lines of more tokens do not repeat by chance: they recur from LONG_DOCS documents on.
LONG, LONG_DOCS = 50, 2

FIELD = "<*>"
#: Row of a leaf, as a hash relation holds it.
LEAF_ROW_BYTES = 32


def _spaced(line: Column) -> Column:
    """The line with one space between tokens and none around; empty for a blank line."""
    plain = F.trim(F.translate(line, "\t\n\x0b\x0c\r", " " * 5))
    # most lines have no run of spaces, and a look for one is cheaper than a pattern
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain)


def _leaf(spaced: Column, n_tokens: Column) -> Column:
    lead = F.substring_index(spaced, " ", LEAD)
    return F.xxhash64(n_tokens, F.regexp_replace(lead, "[^ ]*[0-9][^ ]*", FIELD))


def _row_key(id_col: str, text_col: str) -> Column:
    """Names a row by 128 bits of id and text; rows alike in both are treated alike."""
    named = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(named, F.lit("\0"), whole(text_col)).cast("binary")))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per non-blank line: doc, row, line_no, line, spaced, n_tokens and leaf. Blank lines are never dropped."""
    cut = docs.select(
        F.col(id_col).alias("doc"), _row_key(id_col, text_col).alias("row"),
        F.posexplode(F.split(whole(text_col), "\n", -1)).alias("line_no", "line"),
    )
    kept = cut.where(F.col("line").rlike(r"[^ \x09-\x0D]")).withColumn("spaced", _spaced(F.col("line")))
    # tokens are counted by their spaces, without taking the line apart
    counted = kept.withColumn("n_tokens", F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1)
    return counted.withColumn("leaf", _leaf(F.col("spaced"), F.col("n_tokens")))


def _two_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def recurring_lines(
    docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT
) -> DataFrame:
    """(row, line_no) of the lines to drop."""
    # every line as hashes: narrow, written once, read by each count below
    seen = materialize(
        _lines(docs, id_col, text_col).select("doc", "row", "line_no", "leaf", (F.col("n_tokens") > LONG).alias("long"), *_two_hashes(F.col("line")))
    )
    need = F.when(F.col("long"), F.lit(min(LONG_DOCS, min_docs))).otherwise(F.lit(min_docs))
    line = ["leaf", "h1", "h2"]
    per_doc = seen.select(*line, "long", "row").distinct()
    wordings = materialize(per_doc.groupBy(*line, "long").agg(F.count("*").alias("docs")))
    per_leaf = wordings.groupBy("leaf", "long").agg(F.sum("docs").alias("docs"), F.count("*").alias("n"))
    leaves = materialize(per_leaf.where((F.col("docs") >= need) & (F.col("n") > 1)).select("leaf"))

    # each wording in such a leaf once; lines travel as they are and are taken apart where they arrive
    sent = F.broadcast(leaves) if small_enough(leaves, LEAF_ROW_BYTES) else leaves
    common = _lines(docs, id_col, text_col).select("leaf", "line", *_two_hashes(F.col("line"))).join(sent, "leaf", "left_semi")
    texts = common.groupBy(*line).agg(F.any_value("line").alias("line"))
    fixed = F.transform(F.split(_spaced(F.col("line")), " "), lambda t: F.when(~t.rlike("[0-9]"), F.xxhash64(t)))
    words = materialize(texts.join(wordings, line).select(*line, "long", "docs", fixed.alias("tokens")))
    placed = words.select(
        *line, "long", "docs", F.size(F.filter("tokens", lambda t: t.isNotNull())).alias("size"), F.posexplode("tokens").alias("at", "token")
    ).where("token IS NOT NULL")
    place = ["leaf", "at", "token"]
    counted = placed.groupBy(*place, "long").agg(F.sum("docs").alias("seen_in")).where(F.col("seen_in") >= need)
    constants = materialize(counted.select(*place, "seen_in"))
    # most frequent first; the last of the share that is asked for sets the level
    part = F.xxhash64("at", "token")
    held = placed.select(*line, "long", "size", "at", "token").join(constants, place)
    listed = held.groupBy(*line, "long", "size").agg(F.sort_array(F.collect_list(F.struct("seen_in", part.alias("part"))), asc=False).alias("held"))
    least = F.greatest(F.ceil(F.col("size") * min_constant), F.lit(1)).cast("int")
    level = F.element_at("held", least)["seen_in"]
    kept = F.filter("held", lambda c: c["seen_in"] * 2 >= F.col("level"))
    named = listed.where(F.size("held") >= least).withColumn("level", level).withColumn("held", kept)
    # a template is the set of (position, constant): two order-free sums of hashes name it
    one = lambda of: F.aggregate("held", F.lit(0).cast("long"), lambda x, c: x.bitwiseXOR(of(c["part"])))
    few = F.when(F.size("held") < LONG * min_constant, F.lit(min_docs)).otherwise(need)
    shared = materialize(
        named.select(*line, one(lambda p: p).alias("t1"), one(lambda p: F.xxhash64(p, F.lit(5))).alias("t2"), few.alias("need"))
    )
    # wordings without a template of constants, or with one that needs more documents, recur by themselves
    asks = shared.select(*line, F.col("need").alias("asks"))
    own = wordings.where(F.col("docs") >= need).join(asks, line, "left").where(F.col("asks").isNull() | (F.col("asks") > need))
    templates = shared.unionAll(own.select(*line, F.col("h1").alias("t1"), F.col("h2").alias("t2"), need.alias("need")))
    hits = materialize(seen.join(templates, line).select("leaf", "t1", "t2", "need", "doc", "row", "line_no"))
    key = ["leaf", "t1", "t2"]
    enough = hits.select(*key, "need", "row").distinct().groupBy(*key, "need").count().where(F.col("count") >= F.col("need")).select(*key)
    at = F.struct(F.col("doc").isNull().alias("n"), "doc", "row", "line_no")
    first = hits.groupBy(*key).agg(F.min(at).alias("first"))
    recurring = materialize(first.join(enough, key).select(*key, F.col("first.row").alias("first_row"), F.col("first.line_no").alias("first_no")))
    stays = (F.col("row") == F.col("first_row")) & (F.col("line_no") == F.col("first_no"))
    dropped = materialize(hits.join(recurring, key).where(~stays).select("row", "line_no").distinct())
    discard(seen, wordings, leaves, words, constants, shared, hits, recurring)
    return dropped


def drop_recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_constant: float = MIN_CONSTANT,
    counts: bool = False,
    names: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with the recurring lines taken out of the text; all rows and columns stay.

    Lines end at newlines; what is left is joined by newlines. A text without dropped lines is returned as it was, null
    included. Blank lines stay and count for nothing. Rows that repeat id and text count as one document and get the
    same result, so ids need not be unique or non-null. Documents are counted once per template however often
    they repeat it; repeats inside one document are dropped as well once it recurs. ``counts`` adds two columns called
    ``names``, the lines of the text and those dropped, which replace columns of these names. Others may have any name.
    An empty table stays empty.
    """
    drops = recurring_lines(docs, id_col, text_col, min_docs, min_constant)
    key, row, gone = fresh(docs, "key", "row", "gone")
    # at most one number per line of a document
    by_row = materialize(drops.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list("line_no")).alias(gone)))
    discard(drops)
    lines = F.split(whole(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")
    joined = docs.withColumn(key, _row_key(id_col, text_col)).join(by_row, F.col(key) == F.col(row), "left")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    if not counts:
        return joined.select(*[text if c == text_col else F.col(c) for c in docs.columns])
    found = (F.size(lines), F.coalesce(F.size(gone), F.lit(0)))
    extra = [n.cast("bigint").alias(name) for n, name in zip(found, names, strict=True)]
    replaced = {c.lower() for c in names}
    return joined.select(*[text if c == text_col else F.col(c) for c in docs.columns if c.lower() not in replaced], *extra)
