"""Posts from Markdown files with front matter.

Front matter is read by expressions, field by field, in the subset of YAML that posts use: plain, quoted
and block (`|`, `>`) scalars, `[a, b]` and block lists, null, comments after a space. Unknown keys are left
out. A known key whose value is something else (anchors, aliases, tags, maps, nested lists) makes a post
invalid: see problem().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.dates import coerced
from folio.functions.blocks import let, unix_lines
from folio.schema import TEXTS, conform, rejected, strict

_FRONT = r"(?s)\A﻿?---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|\z)"
_ITEM = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^,\[\]\s](?:[^,\[\]]*[^,\[\]\s])?"


def _raw(front: Column, key: str) -> Column:
    """The value of a top-level key with its continuation lines; null without the key."""
    pattern = rf"(?m)^{key}:[ \t]*(.*(?:\n(?:[ \t]+.*|-[ \t]+.*))*)$"
    return F.when(front.rlike(pattern), F.regexp_replace(F.regexp_extract(front, pattern, 1), r"^\s+|\s+\z", ""))


def block_scalar(front: Column, key: str) -> Column:
    """The text of `key: |` or `key: >` (with - or + and an indentation, if given); null for other values.

    An ordered fold over the lines: of a folded scalar a line end between two lines becomes a space, unless
    one of them is indented further; empty lines stay, but for one between two lines of text.
    """
    pattern = rf"(?m)^{key}:[ \t]*([|>])([-+]?)(\d?)([-+]?)[ \t]*(?:#.*)?$((?:\n(?:[ \t]+.*|[ \t]*(?=\n|\z)))*)"
    part = lambda n: F.regexp_extract(front, pattern, n)
    empty = lambda line: F.trim(line) == ""

    def read(lines: Column) -> Column:
        first = F.coalesce(F.get(F.filter(lines, lambda x: ~empty(x)), F.lit(0)), F.lit(""))
        indent = F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.length(first) - F.length(F.ltrim(first)))
        own = F.transform(lines, lambda x: F.when(empty(x), F.lit("")).otherwise(F.substring(x, indent + 1, F.length(x))))
        state = lambda out, gap, kind: F.struct(out.alias("out"), gap.alias("gap"), kind.alias("kind"))

        def step(s: Column, x: Column) -> Column:
            kind = F.when(x.rlike(r"^[ \t]"), "more").otherwise("text")
            folds = (part(1) == ">") & (s["kind"] == "text") & (kind == "text")
            between = F.when(s["kind"] == "", F.repeat(F.lit("\n"), s["gap"])).when(folds & (s["gap"] == 0), " ").when(folds, F.repeat(F.lit("\n"), s["gap"])).otherwise(F.repeat(F.lit("\n"), s["gap"] + 1))
            return F.when(x == "", state(s["out"], s["gap"] + 1, s["kind"])).otherwise(state(F.concat(s["out"], between, x), F.lit(0), kind))

        def end(s: Column) -> Column:
            chomp = F.concat(part(2), part(4))
            return F.when(chomp == "-", s["out"]).when(chomp == "+", F.concat(s["out"], F.repeat(F.lit("\n"), s["gap"] + F.when(s["kind"] == "", 0).otherwise(1)))).when(s["out"] == "", "").otherwise(F.concat(s["out"], F.lit("\n")))

        return F.aggregate(own, state(F.lit(""), F.lit(0), F.lit("")), step, end)

    return F.when(part(1) != "", let(F.slice(F.split(part(5), "\n"), 2, 1 << 30), read))


def problem(front: Column, keys: tuple[str, ...]) -> Column:
    """Which of the keys has a value beyond what is read here; null if none has."""
    beyond = rf"^(?:[&*!%@`{{?]|\[[^\n]*[\[{{]|-[ \t]+(?:[&*!{{\[]|-[ \t])|[\"'](?!.*[\"'][ \t]*(?:#.*)?\z))"
    found = F.coalesce(*[F.when(_raw(front, k).rlike("(?s)" + beyond), F.lit(k)) for k in keys])
    return F.when(found.isNotNull(), F.concat(F.lit("front matter: the form of "), found, F.lit(" is not read")))


def scalar(raw: Column) -> Column:
    """A YAML scalar as text; null for null, ~ and nothing."""
    folded = lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]*\n[ \t]*\n[ \t]*", "\n"), r"(?<!\n)[ \t]*\n(?!\n)[ \t]*(?=\S)", " ")
    double = F.regexp_replace(F.regexp_replace(folded(F.regexp_extract(raw, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)), r"\\n", "\n"), r'\\(["\\/])', "$1")
    single = F.replace(folded(F.regexp_extract(raw, r"(?s)^'((?:[^']|'')*)'", 1)), F.lit("''"), F.lit("'"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(^|[ \t])#.*$", ""), r"\s*\n\s*", " "))
    return F.when(F.startswith(raw, F.lit('"')), double).when(F.startswith(raw, F.lit("'")), single).when(F.lower(plain).isin("", "~", "null"), F.lit(None)).otherwise(plain)


def items(raw: Column) -> Column:
    """A YAML list of scalars; empty for null, null for what is no list."""
    flow = F.regexp_extract_all(F.regexp_extract(raw, r"(?s)^\[(.*)\]", 1), F.lit(_ITEM), F.lit(0))
    block = F.regexp_extract_all(raw, F.lit(r"(?m)^[ \t]*-[ \t]+(.*)$"), F.lit(1))
    parts = F.when(F.startswith(raw, F.lit("[")), flow).when(raw.rlike(r"^[ \t]*-[ \t]"), block)
    return F.when(scalar(raw).isNull(), F.array().cast("array<string>")).otherwise(F.transform(parts, lambda p: scalar(F.trim(p))))


def slug_of(name: Column) -> Column:
    """A file's address: lower case without ending and marks, spaces as hyphens; index files have their folder's."""
    plain = F.regexp_replace(F.lower(name), r"\.(md|mdx)\z", "")
    plain = F.replace(F.regexp_replace(plain, r"[^\p{L}\p{M}\p{N}\p{Pc}\-/ ]", ""), F.lit(" "), F.lit("-"))
    return F.regexp_replace(plain, r"/index\z", "")


def _read(files: DataFrame) -> DataFrame:
    """The fields of files (name, value) and `problem`."""
    text = files.select("name", unix_lines(F.col("value")).alias("t"))
    text = text.select("name", F.coalesce(F.regexp_extract("t", _FRONT, 1), F.lit("")).alias("front"), F.regexp_replace("t", _FRONT, "").alias("body"))
    front = F.col("front")
    value = lambda c: F.when(_raw(front, c).rlike("^[|>]"), block_scalar(front, c)).otherwise(scalar(_raw(front, c)))
    fields = {c: value(c) for c in ("title", "category", *TEXTS)}
    fields |= {c: coerced(scalar(_raw(front, c))) for c in ("published", "updated")}
    fields["category"] = F.when(_raw(front, "category").isNull(), F.lit("")).otherwise(fields["category"])
    fields["draft"] = F.lower(scalar(_raw(front, "draft"))).eqNullSafe("true")
    fields["tags"] = items(_raw(front, "tags"))
    known = (*fields,)
    return text.select(F.col("name").alias("id"), slug_of(F.col("name")).alias("slug"), "body", *[v.alias(k) for k, v in fields.items()], problem(front, known).alias("problem"))


def parsed(files: DataFrame) -> DataFrame:
    """(id, slug, body and the schema's fields) of files (name, value); invalid dates are null. Works on streams too."""
    return conform(_read(files))


def relative_name(root: str) -> Column:
    """The path of a row's file below root."""
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    tail = root.split("://")[-1].rstrip("/")
    return F.element_at(F.split(path, F.concat(F.lit(r"\Q"), F.lit(tail), F.lit(r"\E/")), 2), -1)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, value): whole Markdown files below a folder. Only the folder is listed by the driver."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return found.select(relative_name(path).alias("name"), "value")


def read_posts(spark: SparkSession, path: str, invalid: str = "fail") -> DataFrame:
    """A collection of posts from a folder. invalid: `fail` stops the query at a post without title or date or with a problem(), `drop` leaves it out, `keep` gives nulls and what could be read."""
    read = _read(read_files(spark, path))
    if invalid == "fail":
        told = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat("problem", F.lit(" in "), "id"))).otherwise(F.col("title"))
        return strict(conform(read.withColumn("title", told)))
    return conform(read.where("problem is null")).where("title is not null and published is not null") if invalid == "drop" else conform(read)


def rejected_posts(spark: SparkSession, path: str) -> DataFrame:
    read = _read(read_files(spark, path))
    odd = conform(read.where("problem is not null")).withColumn("error", F.lit("front matter beyond the subset that is read"))
    return rejected(conform(read.where("problem is null"))).unionByName(odd)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, body) of a collection without a schema."""
    return parsed(read_files(spark, path)).select(F.col("slug").alias("id"), "body")


def entry(df: DataFrame, key: str, column: str = "id") -> DataFrame:
    """The one row of that key; the query fails if there is none or more than one."""
    found = df.where(F.col(column) == key)
    n = found.agg(F.count("*").alias("n")).select("n").scalar()
    checked = df.sparkSession.range(1).select(F.when(n == 1, True).otherwise(F.raise_error(F.format_string(f"%d entries of {column} %s", n, F.lit(key)))).alias("__one"))
    return checked.where("__one").join(found, F.lit(True), "left").drop("__one")
