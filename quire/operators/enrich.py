"""Code blocks, equations, figures and metadata from parsed documents.

A parsed document is a nested row; every attribute may be null.  Items carry
``prov ARRAY<STRUCT<page_no INT>>`` and ``page INT``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import lit

ITEM = "struct<text: string, code_language: string, prov: array<struct<page_no: int>>, page: int>"
EQUATION = "struct<latex: string, original: string, text: string, prov: array<struct<page_no: int>>, page: int>"
ANNOTATION = "struct<kind: string, text: string, predicted_classes: array<struct<class_name: string, confidence: double>>>"
TABLE = "struct<text: string, markdown: string, prov: array<struct<page_no: int>>, page: int>"
PICTURE = f"struct<image: binary, width: int, height: int, caption_text: string, captions: array<struct<cref: string>>, annotations: array<{ANNOTATION}>, prov: array<struct<page_no: int>>, page: int, markdown: string, area_share: double>"
DOCUMENT = f"doc_id bigint, source string, status string, errors array<string>, title string, num_pages int, md string, texts array<{ITEM}>, equations array<{EQUATION}>, formulas array<{EQUATION}>, tables array<{TABLE}>, pictures array<{PICTURE}>"
#: Conversion outcomes that count as a document.
CONVERTED = ("SUCCESS", "PARTIAL_SUCCESS")
MIN_WIDTH, MIN_HEIGHT, MIN_AREA = 200, 150, 40_000


def page_number(item: Column) -> Column:
    """Page of the first provenance, else the item's own page."""
    return F.coalesce(F.try_element_at(item["prov"], F.lit(1))["page_no"], item["page"])


def code_blocks(texts: Column) -> Column:
    """Items with a code language."""
    return F.transform(
        F.filter(texts, lambda t: t["code_language"] != ""),
        lambda t: F.struct(t["text"].alias("text"), t["code_language"].alias("language"), page_number(t).alias("page"), lit("").alias("context")),
    )


def equations(of_equations: Column, of_formulas: Column) -> Column:
    """Equations, or formulas where there are none; LaTeX falls back to the original, a missing text to the original and the LaTeX."""
    source = F.when(F.size(of_equations) > 0, of_equations).otherwise(of_formulas)
    latex = lambda e: F.coalesce(e["latex"], e["original"], lit(""))
    text = lambda e: F.coalesce(e["text"], e["original"], e["latex"], lit(""))
    return F.transform(source, lambda e: F.struct(latex(e).alias("latex"), text(e).alias("text"), page_number(e).alias("page"), lit("").alias("context")))


def collections_of_document() -> dict[str, tuple[Column, Callable[[Column], Column]]]:
    """The collections of a parsed document that references may name, each with the text of an item: its own, else its markdown."""
    text, either, markdown = lambda i: i["text"], lambda i: F.coalesce(i["text"], i["markdown"]), lambda i: i["markdown"]
    return {"texts": (F.col("texts"), text), "tables": (F.col("tables"), either), "pictures": (F.col("pictures"), markdown), "equations": (F.col("equations"), text), "formulas": (F.col("formulas"), text)}


def resolve_reference(cref: Column, collections: dict[str, tuple[Column, Callable[[Column], Column]]]) -> Column:
    """Text of the item that '#/collection/N' names, null where there is none."""
    out = F.lit(None).cast("string")
    for name, (items, text) in collections.items():
        at = F.regexp_extract(cref, rf"^#/{name}/([0-9]+)(?:/|$)", 1).try_cast("int")
        out = F.when(at.isNotNull(), text(F.try_element_at(items, at + 1))).otherwise(out)
    return out


def caption(picture: Column, collections: dict[str, tuple[Column, Callable[[Column], Column]]]) -> Column:
    """The caption text, else the referenced texts joined by spaces."""
    found = F.filter(F.transform(picture["captions"], lambda c: resolve_reference(c["cref"], collections)), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(picture["caption_text"], F.array_join(found, " "), lit(""))


def classification(annotations: Column) -> Column:
    """Top class of the last annotation that names one, with the last confidence given, to two places.

    A later annotation without a name or a confidence keeps the earlier one.
    Confidences with midpoint third decimals round half up here."""
    tops = F.transform(F.filter(annotations, lambda a: F.size(a["predicted_classes"]) > 0), lambda a: F.element_at(a["predicted_classes"], 1))
    last = lambda field: F.try_element_at(F.filter(F.transform(tops, lambda t: t[field]), lambda v: v.isNotNull()), F.lit(-1))
    name = F.nullif(last("class_name"), lit(""))
    return F.when(last("confidence") > 0, F.concat(name, lit(" ("), F.format_string("%.2f", last("confidence")), lit(")"))).otherwise(name)


def description(annotations: Column) -> Column:
    """Text of the last description."""
    return F.try_element_at(F.filter(annotations, lambda a: (a["kind"] == "description") & a["text"].isNotNull()), F.lit(-1))["text"]


def large_enough(width: Column, height: Column, min_width: int = MIN_WIDTH, min_height: int = MIN_HEIGHT, min_area: int = MIN_AREA) -> Column:
    """Size filter of figure files."""
    return (width >= min_width) & (height >= min_height) & (width.cast("bigint") * height >= min_area)


def kept_pictures(pictures: Column, *sizes: int) -> Column:
    """Pictures with an image that are large enough, numbered from 1 without gaps; ``sizes`` are least width, height and area."""
    kept = F.filter(pictures, lambda p: p["image"].isNotNull() & large_enough(p["width"], p["height"], *sizes))
    return F.transform(kept, lambda p, i: F.struct((i + 1).alias("num"), p["image"].alias("image"), F.concat(lit("figure"), (i + 1).cast("string"), lit(".png")).alias("filename")))


def figures(pictures: Column, collections: dict[str, tuple[Column, Callable[[Column], Column]]], *sizes: int, classify: bool = True, described: Column | None = None) -> Column:
    """One record per picture; ``image_path`` counts all pictures, ``image_path_filtered`` names the file that was kept, if it was.

    ``described`` holds a description for each picture, which counts where the annotations have none."""

    def one(p: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(pictures, F.lit(1), (i + 1).cast("int")), lambda q: q["image"].isNotNull() & large_enough(q["width"], q["height"], *sizes)))
        kept = p["image"].isNotNull() & large_enough(p["width"], p["height"], *sizes)
        path = lambda n: F.concat(lit("./img/figure"), n.cast("string"), lit(".png"))
        told = description(p["annotations"])
        return F.struct(
            (i + 1).cast("int").alias("figure_id"),
            caption(p, collections).alias("caption"),
            (classification(p["annotations"]) if classify else F.lit(None).cast("string")).alias("classification"),
            (told if described is None else F.coalesce(told, F.try_element_at(described, (i + 1).cast("int")))).alias("description"),
            page_number(p).alias("page"),
            path(i + 1).alias("image_path"),
            F.when(kept, path(before)).alias("image_path_filtered"),
        )

    return F.transform(pictures, one)


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def enrichments(*sizes: int, code: bool = True, formulas: bool = True, classify: bool = True, described: Column | None = None) -> Column:
    """Struct (code_blocks, equations, figures, metadata) of a parsed document's columns; what is switched off is empty or null."""
    c = F.col
    blocks, eqs = code_blocks(c("texts")), equations(c("equations"), c("formulas"))
    blocks, eqs = blocks if code else F.slice(blocks, 1, 0), eqs if formulas else F.slice(eqs, 1, 0)
    n = lambda a: F.greatest(F.size(a), F.lit(0))
    metadata = F.struct(
        c("source").alias("source"), F.coalesce(c("title"), file_stem(c("source"))).alias("title"), c("num_pages").alias("num_pages"), n(blocks).alias("num_code_blocks"), n(eqs).alias("num_equations"), n(c("pictures")).alias("num_figures")
    )
    pictures = figures(c("pictures"), collections_of_document(), *sizes, classify=classify, described=described)
    return F.struct(metadata.alias("metadata"), blocks.alias("code_blocks"), eqs.alias("equations"), pictures.alias("figures"))


def converted() -> Column:
    """Whether a document came through the conversion."""
    return F.col("status").isin(*CONVERTED)


def failure_message() -> Column:
    """What went wrong with a document that did not."""
    return F.coalesce(F.nullif(F.array_join("errors", "; "), lit("")), lit("Unknown error"))
