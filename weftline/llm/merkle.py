"""Merkle trees of documents (DataFrame functions only): root, sections, paragraphs, pieces.

A section is what blank lines separate, a paragraph a line of it, a piece at most 32 code points of a
sentence. Pieces are the leaves; a paragraph is hashed from its pieces' hashes, a section from its
paragraphs and the root from its sections, so equal roots mean equal texts. A fingerprint is the root
and the shortened hashes of all branches under it; two of them are compared branch by branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import text_or_empty

PIECE = r"[^.!?\n]{1,32}[.!?]*|[.!?]+"
#: Hexadecimal digits that a fingerprint has of the hash of a paragraph or section, and of a piece.
BRANCH, LEAF = 16, 8


def leaves(paragraph: Column) -> Column:
    return F.transform(F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(0)), lambda p: F.sha2(p, 256))


def paragraphs(section: Column) -> Column:
    """One string a paragraph: its hash, a colon and its pieces' hashes, shortened."""
    short = lambda x: F.array_join(F.transform(x, lambda h: F.left(h, F.lit(LEAF))), ",")
    return F.transform(F.transform(F.split(section, "\n"), leaves), lambda x: F.concat(F.left(F.sha2(F.concat(F.lit("paragraph:"), F.array_join(x, ",")), 256), F.lit(BRANCH)), F.lit(":"), short(x)))


def sections(text: Column) -> Column:
    """One struct a section: its hash and its paragraphs."""
    return F.transform(
        F.transform(F.split(text, "\n\n"), paragraphs),
        lambda p: F.struct(F.sha2(F.concat(F.lit("section:"), F.array_join(p, "|")), 256).alias("hash"), p.alias("paragraphs")),
    )


def root(tree: Column) -> Column:
    return F.sha2(F.concat(F.lit("root:"), F.array_join(F.transform(tree, lambda s: s["hash"]), ",")), 256)


def fingerprint(tree: Column) -> Column:
    """The root, then each section's shortened hash with its paragraphs in braces."""
    return F.concat_ws(" ", root(tree), F.array_join(F.transform(tree, lambda s: F.concat(F.left(s["hash"], F.lit(BRANCH)), F.lit("{"), F.array_join(s["paragraphs"], "|"), F.lit("}"))), " "))


def _pieces(some: Column) -> Column:
    """Distinct pieces under some paragraphs."""
    return F.array_remove(F.array_distinct(F.flatten(F.transform(some, lambda p: F.split(F.substr(p, F.lit(BRANCH + 2)), ",")))), "")


def with_likeness(df: DataFrame, a: str, b: str, same: Column, name: str) -> DataFrame:
    """``df`` with the likeness of two trees, 1 for equal roots, 0 where only one has pieces.

    Paragraphs that both have are alike, pieces and all; of the branches that differ, the pieces in
    common count. The share (Dice) is over distinct pieces.
    """
    under = lambda c: F.flatten(F.transform(c, lambda s: s["paragraphs"]))
    step = df.withColumns({"_pa": under(F.col(a)), "_pb": under(F.col(b))})
    step = step.withColumns({"_both": _pieces(F.array_intersect("_pa", "_pb")), "_da": _pieces(F.array_except("_pa", "_pb")), "_db": _pieces(F.array_except("_pb", "_pa"))})
    step = step.withColumns({"_da": F.array_except("_da", "_both"), "_db": F.array_except("_db", "_both")})
    total = 2 * F.size("_both") + F.size("_da") + F.size("_db")
    share = 2.0 * (F.size("_both") + F.size(F.array_intersect("_da", "_db"))) / F.nullif(total, F.lit(0))
    return step.withColumn(name, F.when(same, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0)))).drop("_pa", "_pb", "_both", "_da", "_db")


def differing(a: Column, b: Column) -> Column:
    """Where two trees part: (section, paragraph) numbers from 0 whose hashes differ or that one lacks."""
    longest = F.greatest(F.size(a), F.size(b))
    empty = F.array().cast("array<string>")

    def within(k: Column) -> Column:
        x, y = F.coalesce(F.get(a, k)["paragraphs"], empty), F.coalesce(F.get(b, k)["paragraphs"], empty)
        most = F.greatest(F.size(x), F.size(y))
        at = F.filter(F.sequence(F.lit(0), most - 1), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))
        return F.when(F.get(a, k)["hash"].eqNullSafe(F.get(b, k)["hash"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.transform(at, lambda i: F.struct(k.alias("section"), i.alias("paragraph"))))

    return F.flatten(F.transform(F.sequence(F.lit(0), longest - 1), within))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint and tree of every whole text; null counts as empty."""
    step = docs.select("doc_id", text_or_empty().alias("_text")).select("doc_id", "_text", sections(F.col("_text")).alias("tree"))
    return step.select("doc_id", F.length("_text").cast("long").alias("n_chars"), fingerprint(F.col("tree")).alias("fingerprint"), "tree")


def _range_of(key: Column, splits: list[int]) -> Column:
    """How many of the ascending ``splits`` are at most ``key``, by bisection."""
    if not splits:
        return F.lit(0)
    held = F.array(*[F.lit(s).cast("long") for s in splits])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        over = (s["lo"] < s["hi"]) & (F.get(held, mid) <= key)
        return F.struct(F.when(over, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(over | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(splits).bit_length() + 1)), start, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, key: str, value: str, rows_a_range: int = 1000, many_ranges: int = 4096) -> DataFrame:
    """``key``, ``value`` and ``next_value``: the value of the next row by ``key``; after the last, the first.

    Rows are dealt by ranges of the key, so no task sees all of them; the first row of each range
    also goes to the range before it. The driver learns one key a range; beyond ``many_ranges`` a
    range has a hundred times the rows.
    Null keys come first; rows with equal keys follow one another by value.
    """
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col(key), F.col(value), F.coalesce(F.col(key).cast("long"), least).alias("_k"))
    ids = rows.select("_k")
    n = ids.count()
    k = max(1, min(many_ranges, n // rows_a_range), n // (100 * rows_a_range))
    found = ids.agg(F.percentile_approx("_k", [i / k for i in range(1, k)], 20 * k).alias("q")).first()["q"] if k > 1 else []
    splits = sorted(set(found or []))
    placed = ids.select("_k", _range_of(F.col("_k"), splits).alias("_r"))
    firsts = {r["_r"]: r["first"] for r in placed.groupBy("_r").agg(F.min("_k").alias("first")).collect()}
    order = sorted(firsts)
    before = F.lit(None).cast("int")
    if order:
        # By range: the range before it, from which the last row looks on to this range's first.
        prior = F.array(*[F.lit(order[order.index(r) - 1] if r in firsts else None).cast("int") for r in range(order[-1] + 1)])
        heads = F.array(*[F.lit(firsts.get(r)).cast("long") for r in range(order[-1] + 1)])
        before = F.when(F.get(heads, F.col("_r")) == F.col("_k"), F.get(prior, F.col("_r")))
    rows = rows.withColumn("_r", _range_of(F.col("_k"), splits))
    own = F.struct(F.col("_r").alias("r"), F.lit(0).alias("guest"))
    guest = F.struct(before.alias("r"), F.lit(1).alias("guest"))
    dealt = rows.select(key, value, "_k", F.explode(F.when(before.isNotNull(), F.array(own, guest)).otherwise(F.array(own))).alias("_at"))
    dealt = dealt.select(key, value, "_k", F.col("_at.r").alias("_r"), F.col("_at.guest").alias("_guest"))
    ahead = F.lead(value).over(Window.partitionBy("_r").orderBy("_guest", "_k", value))
    return dealt.select(key, value, ahead.alias("next_value"), "_guest").where("_guest = 0").drop("_guest")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every text against its edited text and the next document's, by fingerprint.

    Null texts count as empty, repeated rows each have a result, an empty table has none. A sole
    document is its own next one.
    """
    step = with_next(docs.select("doc_id", text_or_empty().alias("_text")), "doc_id", "_text")
    n = F.length("_text")
    half = F.shiftright(n, 1)
    step = step.select("doc_id", n.cast("long").alias("n_chars"), "_text", F.col("next_value").alias("_next"), F.concat(F.left("_text", n - half), F.left("next_value", half)).alias("_edited"))
    kinds = ("_text", "_edited", "_next")
    trees = step.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), *[sections(F.col(c)).alias(f"_tree{c}") for c in kinds])
    trees = trees.select("*", *[root(F.col(f"_tree{c}")).alias(f"_root{c}") for c in kinds])
    for c, name in (("_edited", "near_edited"), ("_next", "near_next")):
        trees = with_likeness(trees, "_tree_text", f"_tree{c}", F.col("_root_text") == F.col(f"_root{c}"), name)
    return trees.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("_tree_text")).alias("fingerprint"), fingerprint(F.col("_tree_edited")).alias("edited_fingerprint"), "near_edited", "near_next")


def op7_merkle(spark, sf_dir: str) -> DataFrame:
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
         n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS next FROM d),
         e AS (SELECT doc_id, t, next, left(t, length(t) - length(t) // 2) || left(next, length(t) // 2) AS edited FROM n),
         k AS (SELECT doc_id, [t, edited, next] AS texts, length(t) AS n_chars FROM e),
         p AS (SELECT doc_id, n_chars, texts,
                      list_transform(texts, lambda x: list_transform(string_split(x, chr(10) || chr(10)), lambda y: list_transform(string_split(y, chr(10)),
                          lambda z: list_transform(regexp_extract_all(z, '[^.!?\n]{1,32}[.!?]*|[.!?]+'), lambda w: sha256(w))))) AS leaves FROM k),
         t AS (SELECT doc_id, n_chars, texts, leaves, list_transform(leaves, lambda x: list_transform(x, lambda y: list_transform(y,
                          lambda z: left(sha256('paragraph:' || array_to_string(z, ',')), 16) || ':' || array_to_string(list_transform(z, lambda w: left(w, 8)), ',')))) AS nodes FROM p),
         f AS (SELECT doc_id, n_chars, texts, list_transform(nodes, lambda x: sha256('root:' || array_to_string(list_transform(x, lambda y: sha256('section:' || array_to_string(y, '|'))), ','))) AS roots,
                      list_transform(nodes, lambda x: array_to_string(list_transform(x, lambda y: left(sha256('section:' || array_to_string(y, '|')), 16) || '{' || array_to_string(y, '|') || '}'), ' ')) AS branches,
                      list_transform(leaves, lambda x: list_distinct(list_transform(flatten(flatten(x)), lambda w: left(w, 8)))) AS pieces FROM t),
         l AS (SELECT *, list_transform([2, 3], lambda j: CASE WHEN roots[1] = roots[j] THEN 1.0::DOUBLE WHEN len(pieces[1]) + len(pieces[j]) = 0 THEN 0.0::DOUBLE
                      ELSE 2.0::DOUBLE * len(list_intersect(pieces[1], pieces[j])) / (len(pieces[1]) + len(pieces[j])) END) AS near FROM f)
    SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(texts[2]) AS edited_sha256, roots[1] || ' ' || branches[1] AS fingerprint,
           roots[2] || ' ' || branches[2] AS edited_fingerprint, near[1] AS near_edited, near[2] AS near_next
    FROM l
"""
