"""Line dedup by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line descends by its number of tokens, then by
its leading tokens, where a token with a digit counts as a variable field.
In a leaf, a token keeps its place in the template if enough documents have
it there; the others are generalised to a variable field.  Templates that
recur in enough documents, and keep enough tokens to be called the same line,
are dropped from all documents but the first that has them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logpipe.llm.common import store

#: Leading tokens that the tree branches on.
DEPTH = 3
#: Documents a template (and a token at its place) must occur in.
MIN_DOCS = 10
#: Share of a template's tokens that must not be variable.
SIMILARITY = 0.7
#: Rows (of at most 40 bytes) up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000
#: What stands for a variable field.
FIELD = "<*>"
_BLANKS = r"[ \t\r\x0B\f]+"
_VARIABLE = r"[^ ]*[0-9][^ ]*"


def single_blanks(text: Column) -> Column:
    """The text with single blanks inside its lines; only texts that need it are rewritten."""
    odd = reduce(Column.__or__, (text.contains(x) for x in ("\t", "\r", "\x0B", "\f", "  ")))
    return F.when(odd, F.regexp_replace(text, _BLANKS, " ")).otherwise(text)


def fields(line: Column) -> Column:
    """Digit-bearing tokens as variable fields; only lines that have some are rewritten."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, FIELD)).otherwise(line)


def _small(df: DataFrame) -> DataFrame:
    """A stored table as a broadcast side if it has few rows, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _leaves(lines: DataFrame, depth: int) -> DataFrame:
    """``lines(line)`` without blank ones, with ``n_tokens`` and ``leaf``, which need the leading tokens' fields only."""
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    n_tokens = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    lead = fields(F.substring_index("line", " ", depth))
    return lines.withColumn("n_tokens", n_tokens).withColumn("leaf", F.xxhash64("n_tokens", lead))


def _in_documents(found: DataFrame, keys: list[str], rows: DataFrame, min_docs: int) -> DataFrame:
    """(keys, keeper): the keys of ``found(leaf, line, docs, first_id, *keys)`` in ``min_docs`` different documents.

    Lines of one key may share documents.  As many different first documents
    are enough; only where they are too few, but the lines' documents together
    are not, are the documents themselves counted.
    """
    sums = found.groupBy(*keys, "first_id").agg(F.sum("docs").alias("docs"))
    sums = store(sums.groupBy(*keys).agg(F.sum("docs").alias("at"), F.count("first_id").alias("firsts"),
                                         F.min("first_id").alias("keeper")).where(F.col("at") >= min_docs))
    sure, unsure = sums.where(F.col("firsts") >= min_docs), sums.where(F.col("firsts") < min_docs)
    lines = found.select(*dict.fromkeys([*keys, "leaf", "line"])).join(_small(unsure.select(*keys)), keys, "left_semi")
    counted = (lines.join(rows.select("leaf", "line", "row"), ["leaf", "line"]).select(*keys, "row").distinct()
               .groupBy(*keys).agg(F.count(F.lit(1)).alias("in")).where(F.col("in") >= min_docs))
    return sure.select(*keys, "keeper").union(unsure.join(counted, keys, "left_semi").select(*keys, "keeper"))


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
            min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: ``doc`` (its columns but the text, as a struct), ``kept`` (the text), ``n_lines``, ``n_dropped``.

    See ``line_dedup``; here the table's columns may be called anything.
    """
    text = F.col(text_col)
    norm = single_blanks(text)
    # a leaf on fewer lines than documents are needed cannot hold a recurring template
    lines = _leaves(docs.select(F.explode(F.split(norm, "\n")).alias("line")), depth)
    leaves = store(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf"))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("key"),
                      F.length(text).alias("size"), norm.alias("norm"))
    rows = own.select("row", "id", "key", "size", F.explode(F.array_distinct(F.split("norm", "\n"))).alias("line"))
    rows = _leaves(rows, depth).join(_small(leaves), "leaf", "left_semi").withColumn("m", fields(F.col("line")))
    rows = store(rows.withColumn("line", F.xxhash64("m")).dropDuplicates(["row", "line"]))
    shared = store(rows.groupBy("leaf", "line", "n_tokens", "m")
                   .agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first_id")))
    tokens = shared.select("leaf", "line", "docs", "first_id", F.posexplode(F.split("m", " ")).alias("pos", "token"))
    tokens = tokens.where(F.col("token") != FIELD)
    held = _in_documents(tokens, ["leaf", "pos", "token"], rows, min_docs)
    kept = (tokens.join(held, ["leaf", "pos", "token"], "left_semi").groupBy("leaf", "line")
            .agg(F.count(F.lit(1)).alias("n_fixed"), F.bit_xor(F.xxhash64("pos", "token")).alias("template"),
                 F.bit_xor(F.xxhash64("token", "pos")).alias("template2")))
    kept = store(shared.drop("m").join(kept, ["leaf", "line"])
                 .where(F.col("n_fixed") >= F.lit(similarity) * F.col("n_tokens")))
    template = ["leaf", "template", "template2"]
    recurring = _in_documents(kept, template, rows, min_docs)
    dropped = store(kept.join(recurring, template).select("line", "keeper"))
    # what goes from a text, put beside every document that has this text
    going = (rows.select("key", "size", "line").join(_small(dropped), "line").distinct()
             .groupBy("key", "size")
             .agg(F.map_from_entries(F.collect_list(F.struct("line", "keeper"))).alias("going")))
    going = store(going)  # so that the join with many copies of one text can be split
    # the document stays in one piece: its columns may be called anything
    own = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("doc"),
                      F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("key"), F.length(text).alias("size"))
    out = own.join(going, ["key", "size"], "left")
    lines = F.split("t", "\n")
    keys = F.transform(F.split(single_blanks(F.col("t")), "\n"), lambda x: F.xxhash64(fields(F.trim(x))))
    hashed = F.zip_with(lines, keys, lambda x, k: F.struct(x.alias("line"), k.alias("k")))
    stay = F.filter(hashed, lambda x: ~F.coalesce(_goes(x["k"]), F.lit(False)))
    out = out.withColumn("stay", F.when(F.col("going").isNotNull(), stay.getField("line")))
    n_all = F.size(F.filter(lines, lambda x: x.rlike(r"[^ \t\r\x0B\f]")))
    return out.select(
        "doc", F.coalesce(F.array_join("stay", "\n"), F.col("t")).alias("kept"),
        F.when(F.col("t").isNull(), 0).otherwise(n_all).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("stay"), F.lit(0)).cast("long").alias("n_dropped"))


def _goes(key: Column) -> Column:
    return F.map_contains_key("going", key) & ~F.element_at("going", key).eqNullSafe(F.col("id"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
               min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """Every column of ``docs``, with recurring lines out of the text, and _n_lines, _n_dropped.

    Lines end at newlines; lines without tokens are kept and count for
    nothing.  What must recur is a number of different documents, however
    many variants of a line each has.  A template's lines stay in the
    document with the smallest id among those that have it; everywhere else
    all of them go, repeats within a document too (templates found only in
    documents without id stay).  A text without dropped lines is returned
    byte for byte; NULL texts stay NULL, with 0 lines.  Rows repeat as they
    come and each counts as a document; an empty table gives an empty one.
    Columns called _n_lines or _n_dropped are replaced by the counts.
    """
    out = deduped(docs, id_col, text_col, depth, min_docs, similarity)
    counts = {"_n_lines": F.col("n_lines"), "_n_dropped": F.col("n_dropped")}
    columns = [F.col("kept").alias(c) if c == text_col else F.col("doc").getField(c).alias(c)
               for c in docs.columns if c not in counts]
    return out.select(*columns, *(n.alias(c) for c, n in counts.items()))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         length_col: str | None = None) -> DataFrame:
    """``docs`` with the same columns and without recurring lines; ``length_col``, if given, follows a text that changed."""
    out = deduped(docs, id_col, text_col)

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("kept")
        own = F.col("doc").getField(c)
        if c == length_col:
            return F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(own).cast(docs.schema[c].dataType)
        return own

    return out.select(*(column(c).alias(c) for c in docs.columns))
