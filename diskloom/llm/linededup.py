"""Cross-site line deduplication by distinct-site spread, in DataFrame functions only.

A line is boilerplate if it stands on at least `min_sites` distinct sites. Lines are keyed by a 128-bit hash. Per
key, partial aggregation counts occurrences; only keys that occur often enough, on more than one site, get a
HyperLogLog sketch of their sites, merged by aggregation; keys whose estimate is within the band around the
threshold get an exact distinct count. A boilerplate line stays in the document with the smallest id that holds
it and is removed from all others.

Scale: text is read twice, to hash its lines and to cut them; every shuffle but the last carries hashes only and is aggregated before it; a line that stands in a third
of all documents is met by a broadcast of heavy keys (at most 10,000 by construction, see common.spread_join).
The last join moves each text once, by document id.

Defined results: null text has 0 lines and stays null; empty text is one empty line; empty lines, and those
shorter than `min_chars` characters, are never boilerplate; texts of any length are taken whole; of documents with the same line the
smallest id keeps it; a null site counts as no site; rows with a null id count towards spread but are never edited; repeated rows are
edited alike; an empty table gives no rows. A row travels as one column, so other columns keep their values whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diskloom.llm.common import materialize, spread_join

MIN_SITES = 3
#: Every line that is not empty is judged: the spread over sites protects ordinary short lines, not their length.
MIN_CHARS = 1
#: Of the sketch: 2**12 registers, a standard error of 1.04 / 64.
LG_K = 12


def spread(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(boilerplate: k, sites, first; occurrences: id, k, first, n) for lines that may be boilerplate."""
    lines = materialize(
        docs.where(F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.explode(F.split(F.col(text_col), "\n")).alias("line"))
        .where(F.length("line") >= min_chars)
        .select("id", F.when(F.col("site").isNotNull(), F.xxhash64("site")).alias("site"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), F.col("line")).alias("b")),
        "line-hashes",
    )
    keys = materialize(
        lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("site").alias("lo"), F.max("site").alias("hi")).where((F.col("n") >= min_sites) & ((F.col("lo") != F.col("hi")) | F.lit(min_sites <= 1))).select("a", "b", "n", "first"),
        "line-keys",
    )
    total = keys.agg(F.sum("n")).first()[0] or 0
    # b decides within equal a: two keys with one a are told apart after the join
    by_a = keys.groupBy("a").agg(F.sum("n").alias("n"), F.collect_list(F.struct("b", "first", F.col("n").alias("own"))).alias("found"))
    met = spread_join(lines, by_a, "a", "n", total)
    met = met.withColumn("found", F.filter("found", lambda x: x["b"] == F.col("b"))).where(F.size("found") > 0)
    occurrences = materialize(met.select("id", "site", "a", "b", F.col("found")[0]["first"].alias("first"), F.col("found")[0]["own"].alias("n")), "line-occurrences")
    band = max(2, -(-min_sites * 5 * 104 // (100 * 64)))
    sketched = materialize(occurrences.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"), F.first("first").alias("first"), F.first("n").alias("n")).where(F.col("estimate") >= min_sites - band), "line-sketches")
    near = sketched.where(F.abs(F.col("estimate") - min_sites) <= band).select("a", "b")
    pairs = occurrences.where(F.col("site").isNotNull()).groupBy("a", "b", "site").agg(F.count("*").alias("times"))
    exact = pairs.join(near, ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("sites"))
    known = sketched.join(exact, ["a", "b"], "left").withColumn("sites", F.coalesce("sites", "estimate"))
    return known.where(F.col("sites") >= min_sites).select("a", "b", "n", "sites", "first"), occurrences


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row: all columns of docs, text: what is left of it, n_lines, n_removed) of every row."""
    boiler, occurrences = spread(docs, id_col, text_col, site_col, min_sites, min_chars)
    boiler = materialize(boiler, "line-boilerplate")
    total = boiler.agg(F.sum("n")).first()[0] or 0
    by_a = boiler.groupBy("a").agg(F.sum("n").alias("weight"), F.collect_list("b").alias("bs"))
    others = occurrences.where(F.col("id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).select("id", "a", "b")
    gone = spread_join(others, by_a, "a", "weight", total).where(F.array_contains("bs", F.col("b")))
    per_doc = gone.groupBy(F.col("id").alias("of")).agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    # the lists are the small side: hashing them spares sorting the texts
    joined = rows.join(per_doc.hint("shuffle_hash"), F.col("id") == F.col("of"), "left")
    text = F.col("row")[text_col]
    lines = F.split(text, "\n")
    left = F.filter(lines, lambda x: ~((F.length(x) >= min_chars) & F.array_contains("gone", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))))
    touched = joined.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    n = F.when(text.isNull(), 0).otherwise(F.size(lines))
    return touched.select("row", F.when(F.col("left").isNotNull(), F.array_join("left", "\n")).otherwise(text).alias("text"), n.cast("long").alias("n_lines"), F.coalesce(n - F.size("left"), F.lit(0)).cast("long").alias("n_removed"))


def free_name(name: str, taken: list[str]) -> str:
    """name, or with as many more underscores before it as it takes to be none of the others."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with boilerplate lines cut from the text, plus _n_lines and _n_removed, with more underscores where docs has such columns."""
    found = judge(docs, id_col, text_col, site_col, min_sites, min_chars)
    columns = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*columns, F.col("n_lines").alias(free_name("_n_lines", docs.columns)), F.col("n_removed").alias(free_name("_n_removed", docs.columns)))
