"""The queries of the problems and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import canonical, defects, frequency, garble, leaks, packing, pieces, sentences, truncation
from quirelake.operators.delivery import latest
from quirelake.session import table


def setting(spark: SparkSession, folder: str, name: str) -> str:
    """One of the ten run settings (a fixed, tiny table)."""
    return table(spark, folder, "run_settings").filter(F.col("setting") == name).first()["value"]


def _units(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    read = ["unit_id", *columns, "loaded_at"]
    return latest(table(spark, folder, "manifest_units").select(*read), ["unit_id"], tie=["original_text"])


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "term_candidates"), ["cand_id"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "eval_pairs")).filter("truncated").select("pair_id")


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.rates(table(spark, folder, "eval_pairs"))


def p1_hazards(spark: SparkSession, folder: str) -> DataFrame:
    """The lengths at which a system's texts break off more often than at neighbouring ones."""
    return truncation.hazards(truncation.looked_at(table(spark, folder, "eval_pairs"))).filter("significant").drop("significant")


def _pieces(spark: SparkSession, folder: str, long_only: bool) -> DataFrame:
    limit, overlap = int(setting(spark, folder, "llm_chunk_chars")), int(setting(spark, folder, "llm_chunk_overlap_chars"))
    return pieces.split_units(table(spark, folder, "manifest_units"), limit, overlap, long_only)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = _pieces(spark, folder, long_only=True)
    return cut.filter("piece_no = 1").select("unit_id", "segment_no")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces with their place in the text and their line within the unit."""
    return _pieces(spark, folder, long_only=False)


def p2_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The new number of lines of each unit; one without text keeps its own."""
    cut = _pieces(spark, folder, long_only=False).groupBy("unit_id").agg(F.count("*").cast("int").alias("new"))
    units = latest(table(spark, folder, "manifest_units").select("unit_id", "lines", "loaded_at"), ["unit_id"])
    return units.join(cut, "unit_id", "left").select("unit_id", F.coalesce("new", "lines").alias("lines"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "manifest_units")
    return sentences.sentences(units, sentences.train(sentences.sample(units)))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    terms, units = table(spark, folder, "term_candidates"), table(spark, folder, "manifest_units")
    sources = canonical.same_look_pairs(terms, "cand_id", "source", "source", by="loaded_at")
    return sources.unionByName(canonical.same_look_pairs(units, "unit_id", "original_text", "original_text", by="loaded_at"))


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its one form."""
    sources = _candidates(spark, folder).select(F.lit("source").alias("field"), F.col("cand_id").alias("id"), canonical.canonical_column("source").alias("form"))
    units = _units(spark, folder, "original_text").select(F.lit("original_text").alias("field"), F.col("unit_id").alias("id"), canonical.canonical_column("original_text").alias("form"))
    return sources.unionByName(units)


def term_values(spark: SparkSession, folder: str) -> DataFrame:
    """(value, book_id) rows of term_candidates with summed count, lines, number of records, least cand_id."""
    value = F.translate(canonical.canonical_column("source", fold=True), "\x01\x02\x03", "\ufffd\ufffd\ufffd")
    rows = _candidates(spark, folder).filter(F.col("source").isNotNull()).select("cand_id", "book_id", "count", "lines", value.alias("value"))
    rows = rows.filter(F.length(F.regexp_replace("value", r"[\s]+", "")) > 0)
    return rows.groupBy("value", "book_id").agg(F.sum("count").alias("count"), F.sum("lines").alias("lines"), F.count("*").alias("rows"), F.min("cand_id").alias("cand_id"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return defects.defects(table(spark, folder, "eval_pairs"))


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    """All n-grams and whole values of the sources; blanks part their tokens, so several of them give empty ones."""
    values = term_values(spark, folder).withColumn("tokens", F.split("value", " "))
    return frequency.term_counts(values, "tokens", ["count", "lines", "rows"], "cand_id", "book_id")


def p6_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct value: its name (least cand_id), totals of count and lines, number of records and books, and mark."""
    least = int(setting(spark, folder, "term_min_total"))
    share = float(setting(spark, folder, "term_max_book_share"))
    books = table(spark, folder, "term_candidates").agg(F.countDistinct("book_id")).first()[0]
    counted = _counted(spark, folder).filter("whole")
    mark = F.when(F.col("count") < least, "rare").when(F.col("records") > share * books, "common")
    return counted.select("cand_id", F.col("ngram").alias("value"), "count", "lines", F.col("rows").alias("records"), F.col("records").alias("books"), mark.alias("mark"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_values(spark, folder).filter(F.col("mark").isNotNull()).select("cand_id", "mark")


def p6_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every n-gram of words of the sources: its records (candidates), occurrences, totals of count and lines of these, and books."""
    grams = _counted(spark, folder).filter("not whole").filter(~F.col("ngram").rlike("^ | $|  ") & (F.col("ngram") != ""))
    return grams.select("ngram", "n", "count", "lines", F.col("rows").alias("occurrences"), F.col("records").alias("books"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(table(spark, folder, "documents"), int(setting(spark, folder, "llm_input_max_length")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with leaks, without the leaked stretches; those that are mostly test material are dropped."""
    return leaks.cleaned(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return garble.garbled(documents, garble.language(documents))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_restored(spark, folder).filter("restored is not null").select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p1_hazards": p1_hazards, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_lines": p2_lines, "p3_found": p3_found, "p4_found": p4_found, "p4_forms": p4_forms, "p5_found": p5_found, "p6_found": p6_found, "p6_values": p6_values, "p6_terms": p6_terms, "p7_containers": p7_containers, "p8_found": p8_found, "p8_cleaned": p8_cleaned, "p9_found": p9_found, "p9_restored": p9_restored}
ORACLE: dict[str, str] = {
    "p2_found": """WITH u AS (SELECT * FROM manifest_units QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY loaded_at DESC NULLS LAST, original_text DESC NULLS LAST) = 1),
t AS (SELECT unit_id, 0 AS segment_no, original_text AS x FROM u WHERE segments IS NULL
  UNION ALL SELECT unit_id, CAST(i AS INTEGER), segments[i].original_text FROM (SELECT unit_id, segments, unnest(range(1, len(segments) + 1)) i FROM u WHERE segments IS NOT NULL))
SELECT unit_id, CAST(segment_no AS INTEGER) AS segment_no FROM t WHERE length(x) > (SELECT CAST(value AS INTEGER) FROM run_settings WHERE setting = 'llm_chunk_chars')""",
}
