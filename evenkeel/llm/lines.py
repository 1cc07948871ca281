"""Line dedup by a log-template tree, in DataFrame expressions only.

The tree has a fixed depth: a line goes to the leaf named by its token count
and its first ``DEPTH`` tokens, where a token with a digit counts as a variable
field. A leaf may hold many templates. A token that fewer than ``MIN_DOCS`` of
the leaf's lines have at its place cannot be constant in a template that counts
and becomes a field. Then, round by round, templates that are alike in all but
one place are held against each other: a token stays constant where at least
``CONSTANT`` of their lines agree on it, else the place becomes a field. At
least ``SIMILAR`` of the tokens and ``LEAST_CONSTANTS`` of them must stay
constant (else the line is its own template). A line that is left over and has
all constants of a template that counts joins it. A template found in
``MIN_DOCS`` documents or more is dropped from all of them but the first (smallest ``doc_id``), so that a
text that was copied many times is not lost altogether.

Only leaves that recur are opened: a template has at most as many documents as
its leaf, so this loses nothing. Leaves, lines and templates are named by 64-bit
hashes, lines by two of them.

Cases: a null text stays null and an empty one empty; lines without a token are
never dropped; a long line has a leaf like any other; repeated rows get the same
answer and count as one document; an empty table stays empty; all columns stay,
``n_chars`` (where it is there) follows the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.text import WORD, row_hash, row_id
from evenkeel.session import write_scratch

DEPTH = 3
MIN_DOCS = 10
CONSTANT = 0.3
SIMILAR = 0.75
LEAST_CONSTANTS = 4
FIELD = "<*>"
#: Leaves (8 bytes each) up to which they are sent to the lines; more are joined by document.
BROADCAST_LEAVES = 1_000_000
ROW = ["__id", "__h"]


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _leaf(tokens: Column) -> Column:
    """Branches of the tree: token count, then the leading tokens."""
    return F.when(F.size(tokens) > 0, F.xxhash64(
        F.size(tokens), *[_masked(F.get(tokens, F.lit(i))) for i in range(DEPTH)]))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.withColumn(
        "__id", row_id()).withColumn(
        "__h", row_hash())


def _tokens() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.transform(F.split(text, "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))


def _opened(rows: DataFrame, min_docs: int) -> DataFrame:
    """Lines of recurring leaves: document, line number, leaf and masked tokens."""
    leaves = rows.select(*ROW, F.explode(F.array_distinct(F.filter(
        F.transform(_tokens(), _leaf), lambda x: x.isNotNull()))).alias("leaf")).distinct()
    often = write_scratch(leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_docs).select("leaf"), "leaves")
    if often.count() <= BROADCAST_LEAVES:
        cut = rows.select(*ROW, F.posexplode(_tokens()).alias("line", "tokens")).withColumn(
            "leaf", _leaf(F.col("tokens"))).join(F.broadcast(often), "leaf", "left_semi")
    else:
        asked = leaves.join(often, "leaf", "left_semi").groupBy(*ROW).agg(
            F.collect_list("leaf").alias("__leaves"))
        cut = rows.select(*ROW, "text").join(asked, ROW).select(
            *ROW, "__leaves", F.posexplode(_tokens()).alias("line", "tokens")).withColumn(
            "leaf", _leaf(F.col("tokens"))).filter(F.array_contains("__leaves", F.col("leaf")))
    return write_scratch(cut.select(*ROW, "line", "leaf", F.transform("tokens", _masked).alias("tokens")), "lines")


def _kinds(lines: DataFrame) -> DataFrame:
    """Each different line: ``leaf``, ``body`` (hash), rows ``n``, ``size`` and ``marks``.

    A mark is the hash of a place and its token; fields have none. A template
    is named by all its marks xored, so that one mark less is one xor.
    """
    return write_scratch(lines.groupBy("leaf", "tokens").agg(F.count(F.lit(1)).alias("n")).select(
        "leaf", F.xxhash64("tokens").alias("body"), "n", F.size("tokens").alias("size"),
        F.transform(F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("i"), t.alias("t"))),
                             lambda x: x["t"] != FIELD), lambda x: F.xxhash64(x["i"], x["t"])).alias("marks")), "kinds")


def _enough(stays: Column) -> Column:
    return (stays >= LEAST_CONSTANTS) & (stays >= SIMILAR * F.col("size"))


def _name(marks: str = "marks") -> Column:
    return F.aggregate(marks, F.lit(0).cast("long"), lambda x, m: x.bitwiseXOR(m))


def _several(rows: DataFrame) -> DataFrame:
    """Rows of leaves that have more than one."""
    return rows.join(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds")).filter(
        "kinds > 1").select("leaf"), "leaf", "left_semi")


def _moves(rows: DataFrame) -> DataFrame:
    """For each template (``leaf``, ``name``) the ``mark`` that becomes a field.

    Templates that are alike in all other places form a group; a token that
    fewer than ``CONSTANT`` of the group's lines have there is variable. The
    largest such group decides.
    """
    now = rows.groupBy("leaf", "name").agg(
        F.sum("n").alias("n"), F.first("size").alias("size"), F.first("marks").alias("marks"))
    now = _several(now)
    less = now.filter(_enough(F.size("marks") - 1)).select(
        "leaf", "name", "n", F.explode("marks").alias("mark")).withColumn(
        "rest", F.col("name").bitwiseXOR(F.col("mark")))
    groups = less.select("leaf", "rest", "n").unionByName(
        now.select("leaf", F.col("name").alias("rest"), "n")).groupBy("leaf", "rest").agg(F.sum("n").alias("all"))
    return less.join(groups, ["leaf", "rest"]).filter(F.col("n") < CONSTANT * F.col("all")).groupBy(
        "leaf", "name").agg(F.max(F.struct("all", "mark"))["mark"].alias("mark"))


def _fitting(rows: DataFrame, seen: DataFrame, min_docs: int) -> DataFrame:
    """Lines outside the counted templates that have all constants of one: ``leaf``, ``body`` and its ``fit``."""
    sizes = rows.groupBy("leaf", "name").agg(F.sum("n").alias("held"), F.first("marks").alias("constant"))
    counted = _several(rows).select("leaf", "name").distinct().join(
        sizes.filter(F.col("held") >= min_docs), ["leaf", "name"])
    # found by its rarest constant
    asked = counted.select("*", F.explode("constant").alias("mark")).join(seen, ["leaf", "mark"]).groupBy(
        "leaf", "name").agg(F.min(F.struct("seen", "mark"))["mark"].alias("mark")).join(counted, ["leaf", "name"])
    others = rows.join(sizes.filter(F.col("held") < min_docs), ["leaf", "name"], "left_semi")
    return others.select("leaf", "body", "whole", F.explode("whole").alias("mark")).join(
        asked.select("leaf", "mark", "held", "constant", F.col("name").alias("fit")), ["leaf", "mark"]).filter(
        F.size(F.array_except("constant", "whole")) == 0).groupBy("leaf", "body").agg(
        F.max(F.struct("held", "fit"))["fit"].alias("fit"))


def _templates(lines: DataFrame, min_docs: int) -> DataFrame:
    """Template of each different line: ``leaf``, ``body`` (hash) and ``template`` (hash)."""
    kinds = _kinds(lines)
    # a leaf with one kind of line is its own template
    mixed = _several(kinds).filter(_enough(F.size("marks")))
    places = mixed.select("leaf", "body", "n", F.explode("marks").alias("mark"))
    seen = write_scratch(places.groupBy("leaf", "mark").agg(F.sum("n").alias("seen")), "marks")
    rare = places.join(seen.filter(F.col("seen") < min_docs), ["leaf", "mark"], "left_semi").groupBy(
        "leaf", "body").agg(F.collect_list("mark").alias("rare"))
    left = F.when(F.col("rare").isNull(), F.col("marks")).otherwise(F.array_except("marks", "rare"))
    rows = mixed.join(rare, ["leaf", "body"], "left").select(
        "leaf", "body", "n", "size", F.col("marks").alias("whole"), left.alias("marks")).filter(
        _enough(F.size("marks"))).withColumn("name", _name())
    rows = write_scratch(rows, "templates")
    while True:
        moves = write_scratch(_moves(rows), "moves")
        if moves.isEmpty():
            break
        gone = F.col("mark")
        rows = write_scratch(rows.join(moves, ["leaf", "name"], "left").select(
            "leaf", "body", "n", "size", "whole",
            F.when(gone.isNull(), F.col("marks")).otherwise(F.array_except("marks", F.array(gone))).alias("marks"),
            F.when(gone.isNull(), F.col("name")).otherwise(F.col("name").bitwiseXOR(gone)).alias("name")), "templates")
    found = rows.select("leaf", "body", "name").join(_fitting(rows, seen, min_docs), ["leaf", "body"], "left").select(
        "leaf", "body", F.coalesce("fit", "name").alias("template"))
    return kinds.select("leaf", "body").join(found, ["leaf", "body"], "left").select(
        "leaf", "body", F.coalesce("template", "body").alias("template"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, by_text: bool = False) -> DataFrame:
    """Lines to drop: document (``__id``, ``__h``) and ``line``, counted from 0.

    With ``by_text`` copies of one text are one document, so all of them keep what the first keeps.
    """
    lines = _opened(_rows(docs.select("doc_id", "text")), min_docs)
    placed = lines.select(*ROW, "line", "leaf", F.xxhash64("tokens").alias("body")).join(
        _templates(lines, min_docs), ["leaf", "body"]).select(*ROW, "line", "leaf", "template")
    unit = ["__h"] if by_text else ROW
    spread = placed.groupBy("leaf", "template", *unit).agg(F.min("__id").alias("least")).groupBy(
        "leaf", "template").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("least", "__h")).alias("first"))
    often = spread.filter(F.col("docs") >= min_docs)
    first = (F.col("__h") == F.col("first.__h")) if by_text else (F.col("__id") == F.col("first.least"))
    return placed.join(often, ["leaf", "template"]).filter(~first).select(*ROW, "line")


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, by_text: bool = False) -> DataFrame:
    """The documents without recurring lines; ``__n_dropped`` counts them."""
    gone = recurring_lines(docs, min_docs, by_text).groupBy(*ROW).agg(F.collect_set("line").alias("__gone"))
    df = _rows(docs).join(gone, ROW, "left")
    gone = F.col("__gone")
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.filter(
        F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n"))
    df = df.withColumn("text", text).withColumn("__n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(gone.isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return df.select(*docs.columns, "__n_dropped")
