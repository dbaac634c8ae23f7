"""Published claims against what a reproduction wrote: locate, classify, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

MAX_TEXT = 8 * 1024 * 1024


def _result(df: DataFrame, observed, reason) -> DataFrame:
    return df.select("run_id", "claim_id", observed.alias("observed"), reason.alias("reason"))


def observe_flat(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claim id looked up in a run's flat results object (run_id, json); other than a number is unverified.

    Each object is parsed once and its entries meet the claims by run and id, so the cost follows entries and claims, not their product.
    An object too large for one variant is read entry by entry.
    """
    entries = F.when(F.octet_length("json") <= MAX_TEXT, F.try_variant_get(F.try_parse_json("json"), "$", "map<string,variant>")).otherwise(_entries("json"))
    found = results.select("run_id", F.explode(entries).alias("claim_id", "v"))
    kind, value = _kind_and_value(F.col("v"))
    return _judged(claims.join(found.select("run_id", "claim_id", kind.alias("__k"), value.alias("__v")), ["run_id", "claim_id"], "left"))


def _entries(json: str) -> Column:
    """The entries of a JSON object of any size; NULL if a key stands twice, as for parse_json."""
    found = F.from_json(json, "map<string,variant>")
    return F.when(F.size(F.array_distinct(F.map_keys(found))) == F.size(found), found)


def _kind_and_value(v: Column) -> tuple[Column, Column]:
    kind = F.schema_of_variant(v)
    return kind, F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, "$", "double"))


def _number(df: DataFrame, v) -> DataFrame:
    kind, value = _kind_and_value(v)
    return _judged(df.withColumn("__v", value).withColumn("__k", kind))


def _judged(df: DataFrame) -> DataFrame:
    return _result(df, F.col("__v"), F.when(F.col("__v").isNotNull(), "ok").when(F.col("__k").isNull(), "missing").otherwise("not a number"))


def observe_json(claims: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A JSON path (column pointer) in an artifact's text; only finite numbers count."""
    df = claims.join(artifacts.select("run_id", "path", "text"), ["run_id", "path"], "left")
    return _number(df, F.try_variant_get(F.try_parse_json("text"), F.col("pointer"), "variant"))


def observe_table(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """A cell by column name and key; none or several rows are unverified. rows: run_id, path, key, column, value."""
    found = rows.groupBy("run_id", "path", "key", "column").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    df = claims.join(found, ["run_id", "path", "key", "column"], "left")
    value = F.when(F.col("n") == 1, S.number(F.col("value")))
    return _result(df, value, F.when(F.col("n").isNull(), "no row").when(F.col("n") > 1, "several rows").when(value.isNull(), "not a number").otherwise("ok"))


def numbered(lines: DataFrame) -> DataFrame:
    """``n``: the place of each line in its file, from 0, without sorting a file in one task.

    lines: run_id, path, line (a struct of the block's start and an id that rises within the block), value. Lines of a block are
    counted; the sums of the blocks before (a file's blocks are few) are added to the place within the block, which a window
    over one block gives.
    """
    block = F.col("line.file_block_start")
    sizes = lines.groupBy("path", block.alias("__block")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("path", "__block", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("path", "__block").orderBy("line.id")) - 1
    placed = lines.withColumn("__block", block).withColumn("__inside", inside).join(offsets, ["path", "__block"])
    return placed.select(*lines.columns, (F.col("__before") + F.col("__inside")).alias("n"))


def observe_cell(claims: DataFrame, lines: DataFrame, sep: str = "\t") -> DataFrame:
    """A cell of a table file by row and column, each by place or by name.

    claims: run_id, claim_id, path, header (whether the first line names the columns), column (a name) or column_at (a place from 0), row_at (a place from 0, below the
    header) or key_column and key (the one row whose trimmed cell in that column is the trimmed key); with no header only
    places are addresses. lines: see ``numbered``. Names must stand once in the header. What can't be resolved has a reason and no
    value. Rows meet claims by place or by key, so a claim reads one row of its file; claims are never multiplied by lines.
    """
    n = numbered(lines).withColumn("cells", F.split("value", sep))
    c = claims.withColumn("header", F.coalesce("header", F.lit(True)))
    heads = n.where("n = 0").select("run_id", "path", F.col("cells").alias("names"))
    total = n.groupBy("run_id", "path").agg((F.max("n") + 1).alias("lines"))
    c = c.join(heads, ["run_id", "path"], "left").join(total, ["run_id", "path"], "left")
    times = lambda name: F.size(F.filter("names", lambda x: x == F.col(name)))
    place = lambda name: F.array_position("names", F.col(name)).cast("int") - 1
    named, keyed = F.col("column").isNotNull(), F.col("key").isNotNull()
    first = F.col("header").cast("int")
    wrong = (
        F.when(F.col("lines").isNull(), "no rows").when(~F.col("header") & (named | keyed), "name without a header").when(F.col("lines") <= first, "no rows")
        .when(named & (times("column") == 0), "no column").when(named & (times("column") > 1), "several columns").when(~named & (F.col("column_at").isNull() | (F.col("column_at") < 0) | (F.col("header") & (F.col("column_at") >= F.size("names")))), "no column")
        .when(keyed & (F.coalesce(times("key_column"), F.lit(0)) == 0), "no key column").when(keyed & (times("key_column") > 1), "several key columns")
        .when(~keyed & (F.col("row_at").isNull() | (F.col("row_at") < 0) | (F.col("row_at") >= F.col("lines") - first)), "no row")
    )
    c = c.select("run_id", "claim_id", "path", wrong.alias("wrong"), F.when(named, place("column")).otherwise(F.col("column_at")).cast("int").alias("at"), (F.col("row_at") + first).cast("long").alias("n"), F.when(keyed, place("key_column")).alias("key_at"), F.trim("key").alias("key"))
    ok = c.where("wrong IS NULL")
    value = F.get("cells", F.col("at"))
    by_place = ok.where("key_at IS NULL").join(n.select("run_id", "path", "n", "cells"), ["run_id", "path", "n"]).select("run_id", "claim_id", value.alias("value"), F.lit(True).alias("there"))
    # only the cells of columns that are some claim's key leave their line
    wanted = ok.where("key_at IS NOT NULL").groupBy("run_id", "path").agg(F.collect_set("key_at").alias("keys"))
    cells = n.where("n > 0").join(wanted, ["run_id", "path"]).select("run_id", "path", "cells", F.explode("keys").alias("key_at")).withColumn("key", F.trim(F.get("cells", F.col("key_at"))))
    by_key = ok.where("key_at IS NOT NULL").join(cells, ["run_id", "path", "key_at", "key"]).select("run_id", "claim_id", value.alias("value"), F.lit(True).alias("there"))
    found = by_place.unionByName(by_key).groupBy("run_id", "claim_id").agg(F.count("*").alias("rows"), F.min("value").alias("value"))
    df = c.join(found, ["run_id", "claim_id"], "left")
    number = F.when(F.col("wrong").isNull() & (F.col("rows") == 1), S.number(F.col("value")))
    reason = F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.col("rows").isNull(), "no row").when(F.col("rows") > 1, "several rows").when(F.col("value").isNull(), "short row").when(number.isNull(), "not a number").otherwise("ok")
    return _result(df, number, reason)


def _groups(pattern: Column) -> Column:
    """Whether a pattern has a capturing group: a parenthesis that is no escape, stands in no class and opens no other construct."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"\\.", ""), r"\[\^?\]?[^\]]*\]", "")
    return bare.rlike(r"\((?!\?)|\(\?<[A-Za-z]")


def _captured(text: Column, pattern: Column) -> Column:
    """Group 1 of the only match, or the whole of it for a pattern without a group."""
    whole = F.regexp_extract_all(text, pattern, F.lit(0))[0]
    return F.when(_groups(pattern), F.regexp_extract_all(text, F.when(_groups(pattern), pattern).otherwise(F.lit("()")), F.lit(1))[0]).otherwise(whole)


def observe_pattern(claims: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """A pattern that must match exactly once: its group 1 if it has one, else the whole match. Texts over 8 MiB are refused.

    Patterns come with the claims; those that Java can't compile must be rejected before (``valid_patterns``).
    """
    df = claims.join(texts, ["run_id", "path"], "left")
    n = F.when(F.octet_length(text) <= MAX_TEXT, F.regexp_count(F.col(text), F.col("pattern")))
    value = F.when(n == 1, S.number(_captured(F.col(text), F.col("pattern"))))
    return _result(df, value, F.when(F.col(text).isNull(), "no text").when(n.isNull(), "too large").when(n == 0, "no match").when(n > 1, "several matches").when(value.isNull(), "not a number").otherwise("ok"))


def _text_of(v: Column) -> Column:
    """A string, or the strings of a list joined, of a variant; '' for anything else."""
    kind = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    strings = F.filter(F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull())
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), F.coalesce(F.array_join(strings, ""), F.lit(""))).otherwise("")


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """run_id, path, cell, source, text: one row for each cell; text is what it wrote, NULL if nothing.

    Cells are variants, as sources and outputs are strings or lists and notebooks differ. Text is the standard output of streams and the
    plain text of results and displays, in order; errors and the error stream are left out.
    """
    doc = F.try_parse_json("text")
    cells = notebooks.select("run_id", "path", F.posexplode(F.try_variant_get(doc, "$.cells", "array<variant>")).alias("cell", "c"))
    get = lambda v, at, kind="string": F.try_variant_get(v, at, kind)

    def piece(o: Column) -> Column:
        kind = get(o, "$.output_type")
        stream = (kind == "stream") & (get(o, "$.name") == "stdout")
        shown = kind.isin("execute_result", "display_data") & F.startswith(F.schema_of_variant(get(o, "$.data", "variant")), F.lit("OBJECT"))
        return F.when(stream, _text_of(get(o, "$.text", "variant"))).when(shown, _text_of(get(o, "$.data['text/plain']", "variant")))

    pieces = F.filter(F.transform(get(F.col("c"), "$.outputs", "array<variant>"), piece), lambda t: t.isNotNull())
    text = F.when(F.size(pieces) > 0, F.array_join(pieces, ""))
    return cells.select("run_id", "path", "cell", _text_of(get(F.col("c"), "$.source", "variant")).alias("source"), text.alias("text"))


def observe_notebook(claims: DataFrame, notebooks: DataFrame) -> DataFrame:
    """The pattern in the outputs of one cell of a notebook, by its place from 0 (cell) or as the only one whose source holds a text (contains)."""
    out = notebook_cells(notebooks)
    if "contains" not in claims.columns:
        claims = claims.withColumn("contains", F.lit(None).cast("string"))
    by_text = claims.where(F.col("contains").isNotNull())
    holds = by_text.join(out, ["run_id", "path"]).where(F.contains("source", F.col("contains"))).groupBy("run_id", "claim_id").agg(F.count("*").alias("cells"), F.min("text").alias("text"))
    searched = by_text.drop("cell").join(holds, ["run_id", "claim_id"], "left")
    placed = claims.where(F.col("contains").isNull()).drop("contains").join(out.select("run_id", "path", "cell", "text").withColumn("cells", F.lit(1).cast("long")), ["run_id", "path", "cell"], "left")
    both = placed.select("run_id", "claim_id", "pattern", "text", "cells").unionByName(searched.select("run_id", "claim_id", "pattern", "text", "cells"))
    n = F.when(F.col("cells") == 1, F.regexp_count(F.col("text"), F.col("pattern")))
    value = F.when(n == 1, S.number(_captured(F.col("text"), F.col("pattern"))))
    reason = F.when(F.col("cells").isNull(), "no cell").when(F.col("cells") > 1, "several cells").when(F.col("text").isNull(), "no output").when(n == 0, "no match").when(n > 1, "several matches").when(value.isNull(), "not a number").otherwise("ok")
    return _result(both, value, reason)


def classify(claims: DataFrame, observed: DataFrame) -> DataFrame:
    """Status and relative delta of each claim."""
    df = claims.join(observed, ["run_id", "claim_id"], "left")
    delta = F.when(F.col("observed").isNotNull(), S.relative_delta(F.col("observed"), F.col("claimed")))
    return df.select("run_id", "claim_id", "claimed", "observed", delta.alias("delta"), S.claim_status(F.col("claimed"), F.col("observed"), F.col("tolerance")).alias("status"))


def claim_summary(results: DataFrame) -> DataFrame:
    names = ["reproduced", "within_tolerance", "diverged", "unverified"]
    a = results.groupBy("run_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == n).alias(n) for n in names])
    return a.withColumn("summary", F.format_string("%d of %d claims hold", F.col("reproduced") + F.col("within_tolerance"), "total"))


def freshness(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether an artifact is older than its run's start."""
    return artifacts.join(runs.select("run_id", "started"), "run_id").select("run_id", "path", F.coalesce(F.col("mtime") < F.col("started"), F.lit(True)).alias("stale"))


def claim_errors(claims: DataFrame) -> DataFrame:
    """Claims that can't be used: repeated id, no finite value, tolerance not above 0, other than one locator."""
    seen = claims.groupBy("run_id", "claim_id").agg(F.count("*").alias("__n"))
    df = claims.join(seen, ["run_id", "claim_id"])
    locators = sum(F.col(c).isNotNull().cast("int") for c in ("pointer", "column", "pattern"))
    reason = F.when(F.col("__n") > 1, "repeated id").when(F.col("claimed").isNull() | F.isnan("claimed"), "no value").when(F.col("tolerance") <= 0, "tolerance").when(locators > 1, "several locators")
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("run_id", "claim_id", "reason")
