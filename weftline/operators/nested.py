"""Nested JSON of unknown shape: error text out of error text, secrets at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.dedup import ensure_checkpoints

# How much of an error is kept; what a credential looks like, and which parts of a key's name tell of one.
ERROR_CHARS = 800
CREDENTIAL = r"sk-or-[A-Za-z0-9_-]{8,}|\bhf_[A-Za-z0-9]{16,}|\bsk-[A-Za-z0-9]{20,}"
SECRET_KEYS = ("key", "token", "secret", "password")


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _said(v: Column) -> Column:
    """A part of a document as text: a string as it is, anything else as JSON; null, empty, zero and false are null."""
    text = F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    return F.when(~text.isin("", "null", "false", "0", "{}", "[]"), text)


def _inner(raw: Column) -> Column:
    """The message of the error that a provider's own answer holds, a string of JSON or an object; null if it has none."""
    parsed = F.when(_is(raw, "STRING"), F.try_parse_json(F.try_variant_get(raw, "$", "string"))).when(_is(raw, "OBJECT"), raw)
    error = _part(F.when(_is(parsed, "OBJECT"), parsed), "$.error")
    return F.when(_is(error, "OBJECT"), _said(_part(error, "$.message")))


def described(error: Column) -> Column:
    """What an error object says: its message, and in brackets the provider, and after a colon what the provider itself said.

    A missing message is the whole object; a provider's answer that is no error is shown as it is; ERROR_CHARS characters at most.
    """
    message = F.coalesce(_said(_part(error, "$.message")), F.to_json(error))
    meta = _part(error, "$.metadata")
    meta = F.when(_is(meta, "OBJECT"), meta)
    provider, raw = _said(_part(meta, "$.provider_name")), _part(meta, "$.raw")
    own = F.nullif(F.trim(F.try_variant_get(F.when(_is(raw, "STRING"), raw), "$", "string")), F.lit(""))
    detail = F.coalesce(_inner(raw), own, F.when(_is(raw, "OBJECT"), F.to_json(raw)))
    whole = F.when(detail.isNotNull(), F.concat(message, F.lit(" ("), F.coalesce(provider, F.lit("provider")), F.lit("): "), detail))
    return F.substring(F.coalesce(whole, F.concat(message, F.lit(" ("), provider, F.lit(")")), message), 1, ERROR_CHARS)


def error_text(body: Column | str, otherwise: Column | str) -> Column:
    """The error that a response body (JSON) tells of: its ``error`` object, else the body if it has a message, else ``otherwise``."""
    v = F.try_parse_json(F.col(body) if isinstance(body, str) else body)
    v = F.when(_is(v, "OBJECT"), v)
    error = _part(v, "$.error")
    other = F.col(otherwise) if isinstance(otherwise, str) else otherwise
    return F.when(_is(error, "OBJECT"), described(error)).when(_said(_part(v, "$.message")).isNotNull(), described(v)).otherwise(other)


def deepest_error(docs: DataFrame, body: str, out: str = "root_cause", rounds: int = 32) -> DataFrame:
    """``docs`` with the innermost error message of ``body``: errors within the JSON text of errors, however often wrapped.

    A round unwraps one level of every body that still holds one; rounds end when none does (after ``rounds`` at the latest,
    when the message found so far stays). A body without an error has a null.
    """
    step = docs.withColumns({"_v": F.col(body), out: F.lit(None).cast("string")})
    for _ in range(rounds):
        v = F.try_parse_json("_v")
        error = F.coalesce(F.when(_is(_part(v, "$.error"), "OBJECT"), _part(v, "$.error")), F.when(_is(v, "OBJECT"), v))
        said = F.when(F.col("_v").isNotNull(), _said(_part(error, "$.message")))
        raw = _part(error, "$.metadata.raw")
        deeper = F.when(_is(raw, "STRING"), F.try_variant_get(raw, "$", "string")).when(_is(raw, "OBJECT"), F.to_json(raw))
        deeper = F.coalesce(deeper, said)
        more = F.when(_is(F.try_parse_json(deeper), "OBJECT"), deeper)
        step = step.withColumns({out: F.coalesce(F.when(more.isNull(), F.coalesce(F.nullif(F.trim(deeper), F.lit("")), said)), said, F.col(out)), "_v": more}).checkpoint()
        if step.where("_v IS NOT NULL").isEmpty():
            break
    return step.drop("_v")


def walked(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Every value in the JSON ``body`` of every document, at any depth: ``key``, path, name, kind and text.

    path is dotted, with positions for arrays; name is the nearest key; kind is STRING, OBJECT, ARRAY or another type; text
    is the value of a leaf. Levels are unpacked one by one, each from the containers of the last, until there are none.
    A body that is no JSON gives no rows.
    """
    spark = docs.sparkSession
    ensure_checkpoints(spark)
    top = docs.select(F.col(key).alias("_key"), F.try_parse_json(body).alias("_v")).where("_v IS NOT NULL")
    level = top.select("_key", F.lit("").alias("path"), F.lit(None).cast("string").alias("name"), "_v")
    kind = F.regexp_extract(F.schema_of_variant("_v"), "^[A-Z]+", 0)
    found = None
    while True:
        level = level.withColumn("kind", kind).checkpoint()
        leaf = F.when(~F.col("kind").isin("OBJECT", "ARRAY"), F.try_variant_get("_v", "$", "string"))
        here = level.select(F.col("_key").alias(key), "path", "name", "kind", leaf.alias("text"))
        found = here if found is None else found.unionByName(here)
        inner = level.where(F.col("kind").isin("OBJECT", "ARRAY"))
        if inner.isEmpty():
            return found.where("path <> '' OR kind NOT IN ('OBJECT', 'ARRAY')")
        down = inner.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        step = F.coalesce("key", F.col("pos").cast("string"))
        level = down.select("_key", F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), step).alias("path"), F.coalesce("key", "name").alias("name"), F.col("value").alias("_v"))


def secret_findings(docs: DataFrame, key: str, body: str) -> DataFrame:
    """``key``, path and reason of what must not be stored: keys that name a secret, values that look like a credential."""
    rows = walked(docs, key, body)
    last = F.element_at(F.split("path", r"\."), -1)
    named = F.when(last.eqNullSafe(F.col("name")) & F.lower("name").rlike("|".join(SECRET_KEYS)), "key")
    reason = F.explode(F.array_compact(F.array(named, F.when((F.col("kind") == "STRING") & F.col("text").rlike(CREDENTIAL), "value"))))
    return rows.select(key, "path", reason.alias("reason"))


def redacted_json(body: Column | str) -> Column:
    """JSON text whose string values, at any depth, have no credentials; keys and all else stay byte for byte.

    A match counts if the string that it stands in does not end in a key's colon. Text that is no JSON is redacted as one string.
    """
    text = F.col(body) if isinstance(body, str) else body
    in_value = rf"(?:{CREDENTIAL})(?=(?:[^\"\\]|\\.)*\"(?!\s*:))"
    return F.when(F.try_parse_json(text).isNull(), F.regexp_replace(text, CREDENTIAL, "[redacted]")).otherwise(F.regexp_replace(text, in_value, "[redacted]"))
