"""Deterministic inputs of the core queries: Spark plans and, for DuckDB, SQL with the same rows.

``papers`` puts the patterns that the operators act on around the whole text of
every document; a paper and the names of its image files are one row, so nothing
has to be joined.  ``manuscripts`` are the raw and final papers as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import broadcast_if_small, cut_lineage
from quire.tables import table

#: Portable SQL; every text is whole.
PAPERS = """
select doc_id, concat(
 '# Paper ', cast(doc_id as string), chr(10), chr(10),
 case doc_id % 3 when 0 then 'Abstract -' when 1 then 'Abstract—' else '## ABSTRACT – ' end, coalesce(text, ''), chr(10), chr(10),
 'Index Terms -', coalesce(source, ''), ', ', coalesce(lang, ''), chr(10), chr(10), chr(10), chr(10),
 cast(doc_id % 9 + 1 as string), '.', cast(doc_id % 4 + 1 as string), ' Background', chr(10),
 'The ﬁrst ofﬁce ﬂow [', cast(doc_id % 7 + 1 as string), ']-[', cast(doc_id % 7 + 3 as string), '] and [2][3], [', cast(doc_id % 5 + 1 as string), '].  ', chr(10),
 cast(doc_id % 9 + 1 as string), '.1.1 Design overview. ', coalesce(slug, 'The design'), ' is described in this part', chr(10), chr(10), 'and in the next one.', chr(10), chr(10),
 '- 1) Scope:', chr(10), chr(10), 'Some docu-', chr(10), 'ment text as Figure ', cast(doc_id % 3 + 1 as string), ' shows', chr(10), chr(10), 'and continues.', chr(10),
 '- 2) item', chr(10), '- 3) last:', chr(10), '- 4) end', chr(10), chr(10), 'throughput', chr(10), case when doc_id % 2 = 0 then concat('0 20 40', chr(10)) else '' end,
 'Fig. ', cast(doc_id % 3 + 1 as string), '. Caption', chr(10), chr(10), 'Fig. 2: other', chr(10), '<!-- image -->', chr(10), 'A. Background', chr(10), chr(10),
 case when doc_id % 7 = 0 then concat('References', chr(10), chr(10), '[4] D. Author', chr(10)) else '' end,
 case doc_id % 5 when 0 then 'References' when 1 then '# References' when 2 then '## REFERENCES' else '## References' end, chr(10), chr(10),
 '- [1] A. Author', chr(10), '- [2] B. Author', chr(10), 'continued', chr(10), case when doc_id % 4 = 0 then concat('<a id="ref-3"></a>', chr(10)) else '' end, '[3] C. Author', chr(10)) as md
from documents"""

# What the rows of the small views are made of.
FILES = ("figure1.png", "fig_2.png", "logo.png", "Figure2.png", "figure-3.jpg")
PICTURES_OF_A_PAPER = 4

_FILE_ROWS = "(values " + ",".join(f"({i},'{f}')" for i, f in enumerate(FILES, 1)) + ") v(ord, filename)"
IMAGES = f"select d.doc_id, v.ord, v.filename from {{papers}} d cross join {_FILE_ROWS} where (hash_of + v.ord) % 4 <> 0"
TEXTS = """
select doc_id, cast(p - 1 as int) as idx, l as text,
 case when (doc_id + p - 1) % 4 = 0 then 'python' when (doc_id + p - 1) % 4 = 1 then '' else null end as code_language, cast((p - 1) // 2 + 1 as int) as page_no
from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as p from documents)"""
PICTURES = """
select d.doc_id, v.idx, cast(100 + (d.doc_id * 37 + v.idx * 91) % 300 as int) as width, cast(100 + (d.doc_id * 53 + v.idx * 29) % 250 as int) as height,
 case when (d.doc_id + v.idx) % 5 = 0 then null else case v.idx % 3 when 0 then 'bar_chart' when 1 then 'line_chart' else 'other' end end as class_name,
 cast((d.doc_id * 7 + v.idx) % 100 as double) / 100 as confidence,
 case when (d.doc_id + v.idx) % 6 = 1 then 'photo' end as later_class,
 concat('#/', case when (d.doc_id + v.idx) % 7 = 0 then 'tables' else 'texts' end, '/', cast((d.doc_id + v.idx) % 6 as string)) as caption_cref,
 case when (d.doc_id + v.idx) % 3 = 0 then concat('Picture ', cast(v.idx as string)) end as description,
 case when (d.doc_id + v.idx) % 4 = 0 then null else cast(v.idx + 1 as int) end as page_no
from documents d cross join (values (0),(1),(2),(3)) v(idx)"""
MANUSCRIPTS = """
select 'paper_raw/' || paper_id as doc_id, paper_id, coalesce(md_content, '') as md from (select distinct on (paper_id) * from paper_raw)
union all select 'paper_md/' || paper_id, paper_id, coalesce(md_content, '') from (select distinct on (paper_id) * from paper_md)"""
#: SQL of the views for DuckDB, by name; images_of_... list the files of a view's papers.
DUCK = {
    "papers": PAPERS.replace("select doc_id,", "select doc_id, doc_id as hash_of,"),
    "manuscripts": MANUSCRIPTS.replace("as doc_id, paper_id,", "as doc_id, paper_id as hash_of,"),
    "images_of_papers": IMAGES.replace("{papers}", "papers"),
    "images_of_manuscripts": IMAGES.replace("{papers}", "manuscripts"),
    "texts": TEXTS,
    "pictures": PICTURES,
}


def records_once(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table with each key once: only keys and row positions are shuffled, never the texts.

    Rows of a key are exact copies, so its first row stays.  The keys that occur
    more than once are looked up in the rows: sent along where their number is
    small, joined otherwise."""
    df = table(spark, sf_dir, name)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    repeated = df.select(F.col(key).alias("_key"), at.alias("_at")).groupBy("_key").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = df.select("*", at.alias("_at"))
    return rows.join(broadcast_if_small(cut_lineage(repeated)), F.col(key) == F.col("_key"), "left").where("_first is null or _at = _first").drop("_key", "_first", "_at")


def _files(number: str) -> F.Column:
    listed = F.array(*map(F.lit, FILES))
    return F.filter(listed, lambda f, i: (F.col(number) + i + 1) % 4 != 0)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, md, files) of every document."""
    rows = spark.sql(PAPERS.replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents"))
    return rows.withColumn("files", _files("doc_id"))


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, md, files) of every raw and final paper, each once; doc_id is the table's name and the key."""
    parts = [
        records_once(spark, sf_dir, t, "paper_id").select(F.concat(F.lit(f"{t}/"), F.col("paper_id").cast("string")).alias("doc_id"), F.coalesce("md_content", F.lit("")).alias("md"), _files("paper_id").alias("files"))
        for t in ("paper_raw", "paper_md")
    ]
    return parts[0].unionByName(parts[1])


def images(rows: DataFrame) -> DataFrame:
    """(doc_id, ord, filename): one row per file of papers."""
    return rows.select("doc_id", F.posexplode("files").alias("ord", "filename"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, texts): the lines of a document's whole text as items."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    at = lambda i: (F.col("doc_id") + i) % 4
    language = lambda i: F.when(at(i) == 0, "python").when(at(i) == 1, "")
    page = lambda i: F.array(F.struct((F.floor(i / 2) + 1).cast("int").alias("page_no")))
    item = lambda l, i: F.struct(l.alias("text"), language(i).alias("code_language"), page(i).alias("prov"), F.lit(None).cast("int").alias("page"))
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(lines, item).alias("texts"))


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested parsed documents: items, pictures, formulas, tables and metadata on one row; nothing is shuffled."""
    from quire.operators.enrich import EQUATION, TABLE

    d, null = F.col("doc_id"), F.lit(None).cast("string")

    def picture(v) -> F.Column:
        name = F.when((d + v) % 5 == 0, null).otherwise(F.when(v % 3 == 0, "bar_chart").when(v % 3 == 1, "line_chart").otherwise("other"))
        confidence = ((d * 7 + v) % 100).cast("double") / 100
        classes = lambda n, c: F.when(n.isNotNull(), F.array(F.struct(n.alias("class_name"), c.alias("confidence"))))
        note = lambda kind, text, cl: F.struct(F.lit(kind).alias("kind"), text.alias("text"), cl.alias("predicted_classes"))
        later = F.when((d + v) % 6 == 1, F.lit("photo"))
        notes = F.array(
            note("classification", null, classes(name, confidence)),
            note("description", F.when((d + v) % 3 == 0, F.concat(F.lit("Picture "), v.cast("string"))), classes(null, F.lit(None).cast("double"))),
            note("classification", null, classes(later, F.lit(None).cast("double"))),
        )
        cref = F.concat(F.lit("#/"), F.when((d + v) % 7 == 0, "tables").otherwise("texts"), F.lit("/"), ((d + v) % 6).cast("string"))
        page = F.when((d + v) % 4 == 0, F.lit(None).cast("int")).otherwise((v + 1).cast("int"))
        return F.struct(
            F.lit(b"x").alias("image"), (100 + (d * 37 + v * 91) % 300).cast("int").alias("width"), (100 + (d * 53 + v * 29) % 250).cast("int").alias("height"), null.alias("caption_text"), F.array(F.struct(cref.alias("cref"))).alias("captions"),
            notes.alias("annotations"), F.when(page.isNotNull(), F.array(F.struct(page.alias("page_no")))).alias("prov"), F.lit(None).cast("int").alias("page"), null.alias("markdown"), F.lit(None).cast("double").alias("area_share"),
        )

    formula = lambda t: F.struct(null.alias("latex"), t["text"].alias("original"), t["text"].alias("text"), t["prov"].alias("prov"), t["page"].alias("page"))
    tables = F.transform("texts", lambda t: F.struct(null.alias("text"), F.concat(F.lit("| "), t["text"]).alias("markdown"), t["prov"].alias("prov"), t["page"].alias("page")))
    return (
        texts(spark, sf_dir)
        .withColumn("pictures", F.transform(F.sequence(F.lit(0), F.lit(PICTURES_OF_A_PAPER - 1)), lambda v: picture(v.cast("bigint"))))
        .withColumn("tables", tables.cast(f"array<{TABLE}>"))
        .withColumn("source", F.concat(F.lit("/in/paper-"), d.cast("string"), F.lit(".pdf")))
        .withColumn("title", F.when(d % 2 == 0, F.concat(F.lit("Title "), d.cast("string"))))
        .withColumn("num_pages", (d % 30).cast("int"))
        .withColumn("equations", F.array().cast(f"array<{EQUATION}>"))
        .withColumn("formulas", F.transform("texts", formula))
    )


def with_views(sql: str, *names: str) -> str:
    """SQL for DuckDB with the views it uses in front."""
    return "with " + ",\n".join(f"{n} as ({DUCK[n]})" for n in names) + "\n" + sql
