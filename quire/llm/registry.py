"""Queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.chunking import limit_of, reassembled, split_oversized
from quire.llm.confusables import consistent_form, look_alike_classes, look_alike_pairs
from quire.llm.leakage import leaked_items
from quire.llm.mixing import mix, shares, token_counts
from quire.llm.mojibake import repair_encoding
from quire.llm.names import entities, link_names
from quire.llm.repair import repair_pages
from quire.llm.residue import fit_model, residue_units, without_residue
from quire.llm.scanfix import page_noise
from quire.llm.sentences import sentence_units
from quire.runtime import ensure_importable
from quire.views import records_once


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ensure_importable(spark).read.parquet(f"{d}/{name}.parquet")


def _once(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """A table with each record once; no text is shuffled for it."""
    return records_once(ensure_importable(spark), d, name, key)


def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every final paper with their places and text; copies of a paper are told by keys and row positions, so no text is shuffled."""
    return sentence_units(_once(spark, d, "paper_md", "paper_id"), "paper_id", "md_content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, end_pos) of every sentence unit."""
    return p4_sentences(spark, d).select("paper_id", "end_pos")


def _p5_texts(spark: SparkSession, d: str) -> DataFrame:
    raw = _once(spark, d, "paper_raw", "paper_id").select(F.lit("paper_raw").alias("tbl"), F.col("paper_id").alias("id"), F.col("md_content").alias("text"))
    fig = _once(spark, d, "figure_info", "fig_key").select(F.lit("figure_info").alias("tbl"), F.col("fig_key").alias("id"), F.col("caption").alias("text"))
    return raw.unionByName(fig)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, id_a, id_b): records that read the same but differ in characters."""
    return look_alike_pairs(_p5_texts(spark, d), ["tbl"], "id", "text")


def p5_consistent(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, id, text): every raw paper and caption in its consistent form; a record without text keeps its null."""
    return _p5_texts(spark, d).select("tbl", "id", consistent_form(F.col("text")).alias("text"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, id, class_id, spelling): the records that read like another, with their class."""
    return look_alike_classes(_p5_texts(spark, d), ["tbl"], "id", "text")


def _p1_units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(records, residue found in them) of raw papers and figure descriptions under one model, which is fitted on all of them and on the final papers."""
    raw, fig, final = _once(spark, d, "paper_raw", "paper_id"), _once(spark, d, "figure_info", "fig_key"), _t(spark, d, "paper_md")
    records = raw.select(F.lit("paper_raw").alias("tbl"), F.col("paper_id").alias("rec_id"), F.col("md_content").alias("text")).unionByName(
        fig.select(F.lit("figure_info").alias("tbl"), F.col("fig_key").alias("rec_id"), F.col("description").alias("text"))
    )
    prose = records.select(F.col("text").alias("_t")).unionByName(final.select(F.col("md_content").alias("_t")))
    return records, residue_units(records, ["tbl", "rec_id"], "text", fit_model(prose))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, rec_id) of the records with residue in place of content."""
    return _p1_units(spark, d)[1].select("tbl", "rec_id").distinct()


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, rec_id, text): the records with text that are left once those with residue are excluded."""
    records, found = _p1_units(spark, d)
    return without_residue(records.where("text is not null and text <> ''"), ["tbl", "rec_id"], found)


def _p2_names(spark: SparkSession, d: str) -> DataFrame:
    pub = _t(spark, d, "publication")
    authors = pub.select(F.lit("authors").alias("field"), F.explode("authors").alias("name"))
    return authors.unionByName(pub.select(F.lit("venue").alias("field"), F.col("venue").alias("name")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(field, name_a, name_b): spellings of one person, organisation or venue series."""
    return link_names(_p2_names(spark, d))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """(field, name, entity): every spelling that could be read, with its entity, named by its first spelling."""
    member = entities(_p2_names(spark, d))
    first = member.groupBy("field", "entity").agg(F.min("name").alias("first"))
    return member.join(first, ["field", "entity"]).select("field", "name", F.col("first").alias("entity"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every final paper under its limit, with their places and text; each repeats the end of the one before."""
    size, overlap = limit_of(_t(spark, d, "chunk_limit"), "paper_md")
    return split_oversized(_once(spark, d, "paper_md", "paper_id"), "paper_id", "md_content", size, overlap)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id) of the papers that come out in several pieces."""
    return p3_pieces(spark, d).where("piece_no > 1").select("paper_id").distinct()


def p3_reassembled(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, text, fits, overlaps): the text of each paper as its pieces make it up, and whether they keep to limit and overlap."""
    size, overlap = limit_of(_t(spark, d, "chunk_limit"), "paper_md")
    return reassembled(p3_pieces(spark, d), "paper_id", size, overlap)


def _p6_texts(spark: SparkSession, d: str) -> DataFrame:
    raw = _once(spark, d, "paper_raw", "paper_id").select(F.lit("paper_raw").alias("tbl"), F.col("paper_id").alias("rec_id"), F.col("md_content").alias("text"))
    code = _once(spark, d, "code_block", "block_key").select(F.lit("code_block").alias("tbl"), F.col("block_key").alias("rec_id"), F.col("context").alias("text"))
    return raw.unionByName(code)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, rec_id, line_no, noise) of raw papers and code contexts from scanned pages."""
    return page_noise(_p6_texts(spark, d), ["tbl", "rec_id"], "text")[0]


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, rec_id, repaired_text) of the texts with page noise."""
    return repair_pages(_p6_texts(spark, d), ["tbl", "rec_id"], "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id): documents and the test items they hold."""
    return leaked_items(_t(spark, d, "documents"), "doc_id", "text", _t(spark, d, "eval_item"), "item_id", "passage")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, tokens, copies) of the mixed data set."""
    counts = token_counts(_t(spark, d, "documents"), "doc_id", "source", "text")
    return mix(counts, _t(spark, d, "mix_target")).withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    counts, targets = token_counts(_t(spark, d, "documents"), "doc_id", "source", "text"), _t(spark, d, "mix_target")
    return shares(counts, targets, mix(counts, targets))


def _p8_chars(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = _t(spark, d, "documents").select(F.col("doc_id").alias("key"), "source", F.col("n_chars").alias("tokens")).where("source is not null and tokens > 0").distinct()
    return sized, _t(spark, d, "mix_target")


def p8_mix_by_length(spark: SparkSession, d: str) -> DataFrame:
    """The mixed data set with characters for tokens, which SQL can count."""
    return mix(*_p8_chars(spark, d)).withColumnRenamed("key", "doc_id")


def p8_shares_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source with characters for tokens."""
    counts, targets = _p8_chars(spark, d)
    out = shares(counts, targets, mix(counts, targets))
    return out.withColumns({c: F.round(c, 9) for c in ("actual_share", "share_of_wanted")})


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id) of the documents with wrongly decoded text."""
    return repair_encoding(_t(spark, d, "documents"), "doc_id", "text").where("garbled").select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, restored_text, fully_restored) of the documents with wrongly decoded text."""
    return repair_encoding(_t(spark, d, "documents"), "doc_id", "text").where("garbled").drop("garbled")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Training-data queries by name."""
    found = (p1_found, p1_kept, p2_found, p2_entities, p3_found, p3_pieces, p3_reassembled, p4_found, p4_sentences, p5_found, p5_consistent, p5_classes, p6_found, p6_repaired, p7_found, p8_mix, p8_shares, p8_mix_by_length, p8_shares_by_length, p9_found, p9_restored)
    return {f.__name__: f for f in found}


#: Systematic sampling along the digests of the keys.
_MIX = """
    WITH c AS (SELECT DISTINCT doc_id, source, n_chars AS tokens FROM documents WHERE source IS NOT NULL AND n_chars > 0),
    t AS (SELECT source, sum(tokens) AS st, count(*) AS docs FROM c GROUP BY source),
    rated AS (SELECT m.source, target_share, max_repeats, coalesce(docs, 0) AS docs, coalesce(st, 0) AS source_tokens,
        CASE WHEN st > 0 THEN least(target_share * cast(sum(coalesce(st, 0)) OVER () AS double) / st, cast(max_repeats AS double)) ELSE 0.0 END AS rate FROM mix_target m LEFT JOIN t USING (source)),
    placed AS (SELECT doc_id, c.source, tokens, rate, row_number() OVER (PARTITION BY c.source ORDER BY md5(doc_id || '-17'), doc_id) AS k,
        list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(md5(c.source || '-17'), i, 1)) - 1) * cast(pow(16, 8 - i) AS bigint))) / 4294967296.0 AS o
        FROM c JOIN rated USING (source) WHERE rate > 0),
    mixed AS (SELECT doc_id, source, tokens, cast(floor(rate * k + o) - floor(rate * (k - 1) + o) AS int) AS copies FROM placed WHERE floor(rate * k + o) > floor(rate * (k - 1) + o)) """


def oracle_sql() -> dict[str, str]:
    """SQL of the training-data queries by name."""
    return {
        "p8_mix_by_length": _MIX + "SELECT doc_id, source, tokens, copies FROM mixed",
        "p8_shares_by_length": _MIX
        + """, used AS (SELECT source, sum(copies * tokens) AS mixed_tokens, sum(copies) AS mixed_docs, max(copies) AS most_copies FROM mixed GROUP BY source),
            a AS (SELECT r.*, coalesce(docs, 0) AS docs, coalesce(mixed_tokens, 0) AS mt, coalesce(mixed_docs, 0) AS md, coalesce(most_copies, 0) AS mc FROM rated r LEFT JOIN used USING (source))
            SELECT source, target_share, max_repeats, docs AS source_docs, source_tokens, md AS mixed_docs, mt AS mixed_tokens, mc AS most_copies, round(mt / sum(mt) OVER (), 9) AS actual_share,
            round(mt / sum(source_tokens) OVER (), 9) AS share_of_wanted, target_share * sum(source_tokens) OVER () > source_tokens * max_repeats AS cap_binding FROM a""",
        "p3_reassembled": "SELECT DISTINCT paper_id, md_content AS text, true AS fits, true AS overlaps FROM paper_md WHERE md_content <> ''",
        "p3_found": """
            SELECT DISTINCT paper_id FROM paper_md
            WHERE length(md_content) > (SELECT max(max_chars) FROM chunk_limit WHERE item_type = 'paper_md')""",
    }
