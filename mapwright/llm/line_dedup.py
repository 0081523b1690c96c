"""Lines that recur across documents, found as log templates in a fixed-depth tree.

A line's tokens with digits are variable fields. The tree has a level for the
token count and one for each of ``depth`` leading tokens; a leaf holds the
lines that agree on them. Within a leaf, a token at a place is constant if it is in
at least ``share`` of the leaf's lines there, counted once a document; all
other tokens are variable. What is left is the line's template. Lines whose
template is in at least ``min_docs`` documents, and is constant in at least half
of its places, are dropped, as are lines that recur as they are (up to digits).
Lines of more than ``long_words`` tokens that recur as they are go from two documents
on, if the documents' texts differ: mere copies of one text keep them.

Leaves that fewer than ``min_docs`` documents reach, and long lines' leaves that one
text reaches, can hold none of these, so only the others' lines are looked at further. A leaf has at most 1 / share
constant tokens at each place, so its row of constants is bounded by its token count.

Defined results: a null text has no lines; blank lines are kept and never counted;
rows that repeat identifier and text count as one document, but each has its
row in the result; a null identifier is an identifier; an empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.llm.common import WORD, Scratch

FIELD = "<*>"
SPACE = WORD.replace("^", "").rstrip("+")
#: Leaf keys are 8 bytes; a list of at most this many is sent to all tasks.
MOST_SENT = 500_000


def _key() -> Column:
    return F.xxhash64("id", F.coalesce("text", F.lit("")))


def _masked(line: Column) -> Column:
    """Tokens with single spaces between them, fields as such; possessive, so in time of the line's length."""
    plain = F.trim(F.regexp_replace(line, SPACE + "+", " "))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(plain)


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def _leaf(tokens: Column, depth: int, long_words: int) -> Column:
    """Leaf of a line that isn't blank, odd where its lines are long, as all of a leaf are or none."""
    lead = F.transform(F.slice(tokens, 1, depth), lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))
    leaf = F.xxhash64(F.size(tokens), F.array_join(lead, " "))
    return leaf.bitwiseAND(F.lit(-2)).bitwiseOR(F.when(F.size(tokens) > long_words, 1).otherwise(0))


def _lines(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, depth: int = 3, share: float = 0.25, long_words: int = 50
) -> DataFrame:
    """One row per input row: identifier, n_lines, n_dropped, kept (the text left)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parsed = base.select(_key().alias("key"), F.xxhash64("text").alias("body"), F.array_distinct(_lines(F.col("text"))).alias("lines"))
    leaves = F.transform(F.transform("lines", _tokens), lambda t: F.when(F.size(t) > 0, _leaf(t, depth, long_words)))
    seen = parsed.select("body", F.explode(F.array_distinct(leaves)).alias("leaf")).where("leaf is not null")
    varied = (F.col("leaf").bitwiseAND(F.lit(1)) == 1) & (F.min("body") < F.max("body"))
    reached = seen.groupBy("leaf").agg(F.count("*").alias("n"), varied.alias("varied"))
    open_leaves = scratch.keep(reached.where((F.col("n") >= min_docs) | F.col("varied")).select(F.col("leaf").alias("open")), "leaves")
    if open_leaves.count() <= MOST_SENT:
        open_leaves = F.broadcast(open_leaves)
    each = parsed.select("key", "body", F.explode(F.arrays_zip(leaves.alias("leaf"), F.col("lines").alias("line"))).alias("x"))
    each = each.select("key", "body", "x.leaf", "x.line").where("leaf is not null")
    lines = each.join(open_leaves, F.col("leaf") == F.col("open"), "left_semi")
    lines = scratch.keep(lines.select("key", "body", "leaf", _masked(F.col("line")).alias("masked")).distinct(), "candidates")

    forms = scratch.keep(lines.groupBy("leaf", "masked").agg(F.count("*").alias("n"), (F.min("body") < F.max("body")).alias("varied")), "forms").withColumn("tokens", F.split("masked", " "))
    total = forms.groupBy("leaf").agg(F.sum("n").alias("total"))
    at = forms.select("leaf", "n", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "place", "token").agg(F.sum("n").alias("n"))
    # All lines of a leaf have all its places, so their rows of constants are dense.
    often = F.when((F.col("token") != FIELD) & (F.col("n") >= share * F.col("total")), F.col("token"))
    places = at.join(total, "leaf").groupBy("leaf", "place").agg(F.collect_list(often).alias("tokens"))
    constant = places.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "tokens"))), lambda x: x["tokens"]).alias("constant"))
    template = F.zip_with("tokens", "constant", lambda t, c: F.when(F.array_contains(c, t), t).otherwise(FIELD))
    placed = forms.join(constant, "leaf").withColumn("t", template)
    fixed = F.size(F.filter("t", lambda x: x != FIELD))
    named = scratch.keep(placed.select("leaf", "masked", "n", (F.col("varied") & (F.size("t") > long_words)).alias("passage"), F.array_join("t", " ").alias("template"), (2 * fixed >= F.size("t")).alias("firm")), "templates")
    spread = lines.join(named.where("firm"), ["leaf", "masked"]).groupBy("leaf", "template").agg(F.count_distinct("key").alias("docs")).where(F.col("docs") >= min_docs)
    by_template = named.join(spread, ["leaf", "template"], "left_semi").where("firm").select("leaf", "masked")
    gone = by_template.unionByName(named.where((F.col("n") >= min_docs) | F.col("passage")).select("leaf", "masked")).distinct()
    # What a document loses is at most its own lines.
    per_doc = scratch.keep(lines.join(gone, ["leaf", "masked"]).groupBy("key").agg(F.collect_set("masked").alias("gone")).withColumnRenamed("key", "lost_by"), "gone")
    # Texts move, their lines don't: those that lose some are masked again behind the join.
    out = base.withColumn("text_key", _key()).join(per_doc, F.col("text_key") == F.col("lost_by"), "left").drop("text_key")
    out = out.withColumn("lines", _lines(F.col("text")))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda s: ~F.array_contains("gone", _masked(s))))
    out = out.select("id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select(F.col("id").alias(id_col), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept"))
