"""Figure files and their places in a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import D, S, let, lines, lit, unlines

FILE_NUMBER = r"(?i)(?:figure|fig)[_-]?([0-9]+)"
CAPTION = rf"(?diu)(?:^|{S})(Fig(?:ure)?\.?{S}*({D}+))[.:\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
EMBEDDED = r"!\[Figure ([0-9]+)\]"


def file_number(name: Column) -> Column:
    """Figure number in a file name, null without one."""
    return F.regexp_extract(name, FILE_NUMBER, 1).try_cast("int")


def figure_map(files: Column) -> Column:
    """Map of figure number to file name; of several files with a number the last one counts."""
    numbered = F.filter(F.transform(files, lambda f: F.struct(file_number(f).alias("key"), f.alias("value"))), lambda e: e["key"].isNotNull())
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, (i + 2).cast("int"), F.greatest(F.size(es) - i - 1, F.lit(0)).cast("int")), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(let(numbered, last))


def _may_name_a_figure(c: Column) -> Column:
    """Cheap necessary condition of CAPTION: 'ig' in any case, with and without a dot."""
    out = F.contains(c, lit("ig"))
    for part in ("Ig", "iG", "IG", "ıg", "ıG", "İg", "İG"):
        out = out | F.contains(c, lit(part))
    return out


def embed_figures(c: Column, by_number: Column) -> Column:
    """An image line before the first line that names a figure with a file."""

    def placed(ls: Column, numbers: Column) -> Column:
        def each(l: Column, i: Column) -> Column:
            n = F.element_at(numbers, (i + 1).cast("int"))
            file = F.try_element_at(by_number, n)
            here = F.when(n.isNotNull() & file.isNotNull(), F.array_position(numbers, n) == i + 1).otherwise(F.lit(False))
            image = F.concat(lit("![Figure "), n.cast("string"), lit("](./img/"), file, lit(")\n\n"), l)
            return F.when(here, image).otherwise(l)

        return unlines(F.transform(ls, each))

    number = lambda l: F.when(_may_name_a_figure(l), F.regexp_extract(l, CAPTION, 2).try_cast("int"))
    named = let(lines(c), lambda ls: let(F.transform(ls, number), lambda ns: F.when(F.exists(ns, lambda n: n.isNotNull()), placed(ls, ns)).otherwise(c)))
    return F.when(_may_name_a_figure(c), named).otherwise(c)


def process_figures(c: Column, files: Column) -> Column:
    """Figures embedded; without files or numbers the text stays."""
    return let(figure_map(F.coalesce(files, F.array().cast("array<string>"))), lambda m: F.when(F.size(m) > 0, embed_figures(c, m)).otherwise(c))


def figure_files(images: DataFrame, document: str, order: str, name: str) -> DataFrame:
    """(document, num, filename) of an image listing: the last file of each number."""
    return images.withColumn("num", file_number(F.col(name))).where("num is not null").groupBy(document, "num").agg(F.max_by(name, order).alias("filename"))


def unembedded(text: Column, files: Column) -> Column:
    """Array of (num, filename), by number, of the figures with a file that the text does not embed."""
    embedded = F.transform(F.regexp_extract_all(text, lit(EMBEDDED), F.lit(1)), lambda n: n.try_cast("int"))
    entries = F.array_sort(F.transform(F.map_entries(figure_map(files)), lambda e: F.struct(e["key"].alias("num"), e["value"].alias("filename"))))
    return F.filter(entries, lambda e: ~F.array_contains(embedded, e["num"]))


def unembedded_figures(docs: DataFrame, document: str, text: str, files: DataFrame) -> DataFrame:
    """The same as rows: those of ``files`` (document, num, filename) whose figure the text does not embed."""
    embedded = docs.select(document, F.explode(F.array_distinct(F.regexp_extract_all(text, lit(EMBEDDED), F.lit(1)))).alias("num")).select(document, F.col("num").try_cast("int").alias("num"))
    return files.join(embedded, [document, "num"], "left_anti")
