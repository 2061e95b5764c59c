"""Operator 10: line dedup with a log-template tree.

A line's tokens are its runs of non-blanks; tokens with a digit are variable.  The tree has a fixed depth: a line goes
to the leaf of its token count and first ``LEAD`` tokens.  Within a leaf, a token behind the lead is fixed at its place
if at least ``MIN_DOCS`` of the leaf's lines, and at least a share of them, have it there; other places become variable.
Each share of ``SHARES`` gives a line one template; the one with the fewest fixed places counts that keeps enough of
them and recurs in at least ``MIN_DOCS`` documents, down to the line itself.  So a template depends on the counts of a
leaf, not on an order of its lines: a leaf of any size spreads over tasks.  Recurring templates are dropped everywhere
but at their first occurrence, so that no content is lost altogether.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import free, settle

LEAD, ALIKE, MIN_DOCS = 3, 0.7, 5
SHARES = (4, 16, 64)  # a fixed token is held by at least one in so many lines of its leaf; fewest fixed places first
VARIABLE = "<*>"
BROADCAST_LEAVES = 100_000


def needed(width: Column) -> Column:
    """Fixed places that a generalised template keeps: ``ALIKE`` of all, half of those behind the lead."""
    return F.greatest(F.ceil(width * ALIKE), LEAD + F.ceil((width - LEAD) / 2)).cast("int")


def masked_lines(text: Column) -> Column:
    """All lines of a text with their tokens one blank apart, variable ones still to be masked."""
    odd = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\f")
    plain = F.when(odd, F.regexp_replace(text, "[\\t\\r\\x0B\\f]", " ")).otherwise(text)
    return F.split(F.when(plain.contains("  "), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain), "\n")


def _mask(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ 0-9]*+[0-9][^ ]*+", VARIABLE)).otherwise(line)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, at, line: the masked lines with a constant token, a written table."""
    cut = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(masked_lines(F.col(text_col))).alias("at", "raw"))
    constant = F.col("raw").rlike("(?:^| )[^ 0-9]+(?: |$)")  # asked of the raw line, so that masks are made once
    return settle(cut.filter(constant).withColumn("line", _mask(F.btrim("raw"))).drop("raw"), "lines")


def _leaf() -> list[Column]:
    width = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return [width.alias("width"), F.substring_index("line", " ", LEAD).alias("lead")]


def _names(value: Column, *more: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.struct(F.xxhash64(*more, value).alias("a"), F.xxhash64(F.lit("b"), *more, value).alias("b"))


def _templates(lines: DataFrame, least: int) -> DataFrame:
    """line, tier, template of all lines that might recur; the line itself is the last tier.

    A leaf with under ``least`` lines can't hold a recurring template.  A place has at most the greatest of ``SHARES``
    fixed tokens, so what is known of a leaf is bounded by its width; all work on a line is linear in its tokens."""
    leaf = ["width", "lead"]
    lines = lines.select("line", *_leaf())
    totals = settle(lines.groupBy(leaf).agg(F.count("*").alias("total")).filter(F.col("total") >= least), "leaves")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_LEAVES else totals
    busy = settle(lines.join(totals, leaf).groupBy(*leaf, "line").agg(F.count("*").alias("n"), F.max("total").alias("total")), "busy")
    several = busy.filter((F.col("n") < F.col("total")) & (F.col("width") > LEAD))
    tokens = several.select(*leaf, "total", "n", F.posexplode(F.split("line", " ")).alias("at", "token")).filter(F.col("at") >= LEAD)
    held = tokens.groupBy(*leaf, "at", "token").agg(F.sum("n").alias("held"), F.max("total").alias("total"))
    held = held.filter((F.col("held") >= least) & (F.col("held") * SHARES[-1] >= F.col("total")))
    # a leaf's fixed tokens by place: an array with a gap where a place has none, so that a place is looked up at once
    by_place = held.groupBy(*leaf, "at").agg(F.collect_list(F.struct("token", "held", "total")).alias("tokens"))
    places = by_place.groupBy(leaf).agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("places"))
    none = F.lit(None).cast(by_place.schema["tokens"].dataType)
    before = lambda i: F.when(i > 0, F.get("places", i - 1)["at"]).otherwise(-1)
    filled = F.transform("places", lambda e, i: F.concat(F.array_repeat(none, e["at"] - before(i) - 1), F.array(e["tokens"])))
    fixed = settle(places.select(*leaf, F.flatten(filled).alias("fixed")), "fixed")
    general = several.join(fixed, leaf).withColumn("tokens", F.split("line", " "))

    def generalised(tier: int) -> Column:
        keeps = lambda t, i: (i < LEAD) | F.exists(F.get("fixed", i), lambda f: (f["token"] == t) & (f["held"] * SHARES[tier] >= f["total"]))
        kept = F.transform("tokens", lambda t, i: F.when(keeps(t, i), t))
        return F.struct(F.lit(tier).alias("tier"), kept.alias("kept"))

    tried = general.select("line", "n", "width", F.explode(F.array(*map(generalised, range(len(SHARES))))).alias("made"))
    enough = F.size(F.array_compact("made.kept")) >= needed(F.col("width"))
    masked = F.array_join(F.transform("made.kept", lambda t: F.coalesce(t, F.lit(VARIABLE))), " ")
    tried = tried.filter(enough).select("line", "n", F.col("made.tier").alias("tier"), masked.alias("template"))
    itself = busy.filter(F.col("n") >= least).select("line", "n", F.lit(len(SHARES)).alias("tier"), F.col("line").alias("template"))
    both = settle(tried.union(itself).select("line", "n", "tier", _names(F.col("template"), F.col("tier")).alias("template")), "tried")
    some = both.groupBy("template").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("template")
    return both.join(some, "template").select(_names(F.col("line")).alias("line"), "tier", "template")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, drop (positions, ascending): a row for each document that loses a line.

    Identical lines are counted before anything is compared, so a line on a third of all rows is one row of the tree,
    and lines, leaves and templates meet again in joins whose large partitions Spark splits."""
    lines = _lines(docs, id_col, text_col)
    named = settle(_templates(lines, min_docs), "templates")
    # what may recur is few against all lines, so it thins them out before anything else is done with them
    seen = settle(lines.select("doc_id", "text_hash", "at", _names(F.col("line")).alias("line")).join(named, "line").select("doc_id", "text_hash", "at", "tier", "template"), "seen")
    per_doc = seen.groupBy("template", "doc_id", "text_hash").agg(F.min("at").alias("at"))
    first = F.min(F.struct("doc_id", "text_hash", "at"))
    often = settle(per_doc.groupBy("template").agg(F.count("*").alias("docs"), first.alias("first")).filter(F.col("docs") >= min_docs).select("template", "first"), "often")
    # lines of one template agree in all templates with fewer fixed places, so each line goes to the first that recurs
    own = seen.join(often, "template").groupBy("doc_id", "text_hash", "at").agg(F.min_by("first", "tier").alias("first"))
    lost = own.filter(~F.struct("doc_id", "text_hash", "at").eqNullSafe(F.col("first")))
    return lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("at")).alias("drop"))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lost_col: str = "__lost") -> DataFrame:
    """All columns of ``docs``, with recurring lines taken out of the text, and ``lost_col``, the number of them.

    Blank lines, lines of variable tokens alone, null and empty texts stay as they are.  A document keeps its row even
    if no line is left.  Repeated rows (same identifier and text) count as one document and lose the same lines; a
    null identifier is a value like any other; an empty input gives no row; a column ``lost_col`` of the input is
    replaced, any other keeps its values whatever its name."""
    k, h, drop = (free(docs, c) for c in ("k", "h", "drop"))
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))  # noqa: E731  # a null identifier must find its row
    gone = dropped_lines(docs, min_docs, id_col, text_col).select(key("doc_id").alias(k), F.col("text_hash").alias(h), F.col("drop").alias(drop))
    joined = docs.drop(lost_col).withColumn(k, key(id_col)).withColumn(h, F.xxhash64(text_col)).join(gone, [k, h], "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col(drop), i)), "\n")
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != lost_col], F.coalesce(F.size(drop), F.lit(0)).alias(lost_col))
