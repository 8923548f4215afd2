"""Language of a document by character n-gram rank profiles: the out-of-place distance of a text's commonest trigrams to each language's.

Profiles are learned from labelled documents, EACH of a language at most, and have RANKS rows a language, so they are broadcast. A text is
judged by its first SAMPLE characters, as the operator says; shorter texts than LEAST have no language. No Python, one shuffle by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.language import NAMES

SAMPLE, LEAST, RANKS, EACH = 2000, 20, 300, 200


def trigrams(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, gram, n``: trigrams of the start of a text, letters in lower case and one blank for anything else."""
    plain = F.regexp_replace(F.lower(F.substring(F.trim(text), 1, SAMPLE)), r"[^\p{L}]+", " ")
    grams = F.regexp_extract_all(F.concat(F.lit(" "), F.trim(plain), F.lit(" ")), F.lit("(?s)(?=(.{3}))"), F.lit(1))
    long = docs.where(F.length(F.substring(F.trim(text), 1, SAMPLE)) >= LEAST)
    return long.select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def ranked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The RANKS commonest grams of each key with their rank from 0; ties by the gram."""
    order = W.partitionBy(*keys).orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < RANKS).drop("n")


def labelled_sample(docs: DataFrame, key: str, lang: str = "lang", each: int = EACH) -> DataFrame:
    """Of each language the documents whose id has the smallest hashes, ``each`` at most."""
    order = W.partitionBy(lang).orderBy(F.md5(F.col(key).cast("string")), key)
    return docs.where(F.col(lang).isNotNull()).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= each).drop("_k")


def profiles(docs: DataFrame, key: str, lang: str = "lang", text: str = "text", each: int = EACH) -> DataFrame:
    """``lang, gram, rank`` of a bounded sample of labelled documents."""
    chosen = labelled_sample(docs.select(key, lang), key, lang, each)
    rows = docs.select(key, text).join(chosen, key)
    return ranked(trigrams(rows, [lang], text), [lang]).withColumnRenamed(lang, "lang")


def detect(docs: DataFrame, known: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, language, distance``: the nearest profile, ties by the code; a gram that a profile lacks is RANKS out of place."""
    own = ranked(trigrams(docs, [key], text), [key])
    sizes = own.groupBy(key).agg((F.count("*") * RANKS).alias("_far"))
    met = own.join(F.broadcast(known.withColumnRenamed("rank", "_at")), "gram").groupBy(key, "lang").agg(F.sum(F.abs(F.col("rank") - F.col("_at")) - RANKS).alias("_near"))
    best = met.groupBy(key).agg(F.min(F.struct("_near", "lang")).alias("_b"))
    return sizes.join(best, key).select(key, F.col("_b.lang").alias("language"), (F.col("_far") + F.col("_b._near")).alias("distance"))


def with_language(docs: DataFrame, found: DataFrame, key: str, metadata: str = "metadata") -> DataFrame:
    """``docs`` whose metadata map gets the code and display name; documents without a language keep theirs as it is."""
    names = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    told = F.create_map(F.lit("language"), F.col("language"), F.lit("language_name"), F.coalesce(F.try_element_at(names, F.col("language")), F.col("language")))
    known = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(known, lambda k, _: ~k.isin("language", "language_name"))
    return docs.join(found.select(key, "language"), key, "left").withColumn(metadata, F.when(F.col("language").isNotNull(), F.map_concat(kept, told)).otherwise(F.col(metadata))).drop("language")
