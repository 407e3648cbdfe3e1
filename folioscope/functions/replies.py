"""Model replies to typed answers: the first JSON object, its schema, and what is tidied on the way.

A reply is salvaged where it is unambiguous (fences, prose around the object, trailing
commas, missing claim ids) and else gets an error; one that is cut off is never completed.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: the fields of an answer
ANSWER = (
    "summary array<struct<text:string,claim_ids:array<string>>>, "
    "claims array<struct<id:string,text:string,tickers:array<string>,period_end:string,period_kind:string,citations:array<string>,quote:string>>, "
    "table array<struct<dimension:string,cells:array<struct<column:string,text:string,claim_ids:array<string>>>>>, "
    "not_comparable array<struct<dimension:string,tickers:array<string>,reason:string>>, "
    "gaps array<string>"
)
FIELDS = ("summary", "claims", "table", "not_comparable", "gaps")
#: A string, closed or cut off, or a brace: what nesting depends on.
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z)|[{}]', re.S)


def object_of(text: str) -> str | None:
    """The first balanced JSON object: "" where none begins, None where it is cut off."""
    begin = text.find("{")
    if begin < 0:
        return ""
    open_ = 0
    for token in _TOKENS.finditer(text, begin):
        open_ += {"{": 1, "}": -1}.get(token[0], 0)
        if not open_:
            return text[begin : token.end()]
    return None


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """Balanced braces aren't a regular language, so this is the one step outside the JVM."""
    return texts.map(lambda t: object_of(t or ""))


def without_fences(c: Column) -> Column:
    return F.regexp_replace(c, r"```(?:[A-Za-z0-9_-]*[ \t]*\n)?", "")


def citation(x: Column) -> Column:
    """The excerpt id of a citation, with or without brackets; null if it isn't one."""
    bare = F.regexp_replace(F.trim(x), r"^\[\s*|\s*\]$", "")
    return F.when(bare.rlike("^C[0-9]+$"), bare)


def tidied(claims: Column) -> Column:
    """Claims with ids (K1, K2, ... by place, where missing) and only excerpt ids as citations."""
    def one(c: Column, i: Column) -> Column:
        own = F.when(F.trim(F.coalesce(c["id"], F.lit(""))) == "", F.concat(F.lit("K"), i + 1)).otherwise(c["id"])
        cited = F.filter(F.transform(c["citations"], citation), lambda x: x.isNotNull())
        return c.withField("id", own).withField("citations", cited)

    return F.transform(claims, one)


def answers(replies: DataFrame, text_col: str) -> DataFrame:
    """Adds ``answer`` (struct of :data:`ANSWER`) and ``error``, of which one is null.

    Errors: ``no JSON object``, ``truncated``, ``invalid JSON`` (also a field of another type than the
    schema's), ``<field> is missing``.  Numbers given for text are taken as text.
    """
    kept = replies.columns
    rows = replies.withColumn("__body", first_object(without_fences(F.coalesce(F.col(text_col), F.lit("")))))
    schema = f"{ANSWER}, __bad string"
    read = lambda c: F.from_json(c, schema, {"columnNameOfCorruptRecord": "__bad"})
    rows = rows.withColumn("__first", read(F.col("__body"))).withColumn("__second", read(F.regexp_replace("__body", r",(\s*[}\]])", "$1")))
    rows = rows.withColumn("__read", F.when(F.col("__first.__bad").isNull(), F.col("__first")).otherwise(F.col("__second")))
    missing = F.coalesce(*(F.when(F.col(f"__read.{f}").isNull(), F.lit(f"{f} is missing")) for f in FIELDS))
    error = F.when(F.col("__body").isNull(), "truncated").when(F.col("__body") == "", "no JSON object").when(F.col("__read.__bad").isNotNull(), "invalid JSON").otherwise(missing)
    fields = [tidied(F.col("__read.claims")).alias(f) if f == "claims" else F.col(f"__read.{f}").alias(f) for f in FIELDS]
    return rows.withColumn("error", error).select(*kept, F.when(F.col("error").isNull(), F.struct(*fields)).alias("answer"), "error")


def canned(excerpt: Column) -> Column:
    """A reply for tests without a model: one claim that quotes the first twelve words of the first excerpt, C1."""
    quote = F.array_join(F.slice(F.split(F.trim(excerpt), r"\s+"), 1, 12), " ")
    claim = F.struct(F.lit("K1").alias("id"), quote.alias("text"), F.array().cast("array<string>").alias("tickers"), F.lit("").alias("period_end"), F.lit("").alias("period_kind"), F.array(F.lit("C1")).alias("citations"), quote.alias("quote"))
    summary = F.struct(quote.alias("text"), F.array(F.lit("K1")).alias("claim_ids"))
    none = F.array().cast("array<string>")
    return F.to_json(F.struct(F.array(summary).alias("summary"), F.array(claim).alias("claims"), none.alias("table"), none.alias("not_comparable"), none.alias("gaps")))


def replayed(questions: DataFrame, store: DataFrame, excerpt: str, key: str = "question_key") -> DataFrame:
    """Adds raw_text and ``replayed``: the stored reply of the question's key (the smallest, of several), else a canned one.

    ``store``: (key, raw_text).
    """
    known = store.groupBy(F.col(key).alias("__key")).agg(F.min("raw_text").alias("__raw"))
    found = questions.join(known, F.col(key) == F.col("__key"), "left")
    return found.withColumn("replayed", F.col("__raw").isNotNull()).withColumn("raw_text", F.coalesce("__raw", canned(F.col(excerpt)))).drop("__key", "__raw")
