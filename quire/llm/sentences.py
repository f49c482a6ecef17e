"""Problem 4: sentence units of documents in any language and script.

Everything is a SQL expression.  A document is cut into blocks at blank lines;
in prose blocks, full stops that end no sentence (decimals, URLs, initials,
abbreviations, ordinals, ellipses, quotations) are replaced by a private-use
placeholder, other terminators inside quotations get a private-use guard, and
script-specific patterns then put a boundary mark after each unit.  Splitting at
the mark and undoing the placeholders restores the text.

Places come from running sums within the row: the lengths of a document's blocks
and of a block's pieces are added up in array expressions, so nothing is shuffled.

Defined results: null and empty documents have no units; whitespace between
units belongs to none; a document of any length is handled with one pass per
pattern; copies of a row give copies of its units.
Private-use characters already in a text are set aside as noncharacters
U+FDD0..U+FDD3 and restored; a text that holds those noncharacters itself gets
private-use ones back in their place (positions are unaffected).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let

BOUNDARY, DOT, GUARD = "\ue000", "\ue001", "\ue002"
_RESERVED, _ASIDE = "\ue000\ue001\ue002", "\ufdd0\ufdd1\ufdd2"
#: Blocks that begin so hold no prose.
NO_PROSE = r"^\s*(?:#|\||```|!\[|<a)"
#: A block that begins so is one unit.
ONE_UNIT = r"^\s*Fig(?:ure)?(?!\p{L})"

# Abbreviations by what may follow them.
ALWAYS = "Dr|Dra|Prof|Gen|Col|Lt|Sgt|Capt|Rev|Gov|Sen|Mr|Mrs|Ms|St|Sr|Sra|Jr|Mme|Mlle|Hr|Fr|cf|vs|approx|incl|resp|al|ca|bzw|vgl|bldg|esp|viz|ej|ex|env|ver|ed|eds|dept|univ|ดร|डॉ|श्री|им|ул|см|рис|табл|гл|стр"
BEFORE_NUMBER = "Fig|Figs|fig|figs|Eq|Eqs|Sec|Secs|Sect|Tab|Tabs|Ref|Refs|No|Nos|no|Nr|Abb|Art|Bd|Vol|vol|Ch|ch|pp|núm|n|Kap|S|v|p|Def|Thm|Alg|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
BEFORE_LETTER = "App|Appx|Appendix|Sect|Fig"
MAY_END = "etc|usw|ff"
FUNCTION_WORDS = "and|or|but|which|that|in|on|at|for|to|with|is|are|was|were|as|by|from|of|und|oder|für|mit|y|o|et|ou|en|de|des|der|die|das|con|para"
#: Words that begin a sentence after a short form such as U.S.
OPENING_WORDS = r"(?:The|This|That|These|Those|It|In|We|An?|He|She|They|But|However|For|On|At|As|If|When|While|Its|Our|By|To|And|Each|No|Most|Some|There)(?!\p{L})"
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"

_TERMINATORS = ".!?。！？।؟"
_CLOSERS = "”»’」』）)\"'\\]"
_QUOTES = '"“”„«»「」『』()（）'
#: Openers of a quotation or bracket that closes within its block; the search ends at the next mark of its kind, so all searches together are linear.
_OPENER = (
    rf'(?:(?<![^\s(\[])"(?=[^\s"][^"]*+")|[“„](?=[^“”„]++[”“])|«(?=[^«»]++»)'
    rf"|「(?=[^「」]++」)|『(?=[^『』]++』)|\((?=[^()]++\))|（(?=[^（）]++）))"
)

_WORD_START = rf"(?<![\p{{L}}\p{{M}}\p{{N}}.{DOT}])"
#: Full stops that end no sentence.  First those of a short word (kept as group 1), then decimals, URLs, ellipses, ordinals of dates.
MASKED_DOT = (
    rf"{_WORD_START}(?=\p{{L}}[\p{{L}}\p{{M}}]{{0,5}}\.\s)("
    rf"(?:{ALWAYS})(?=\.)"
    rf"|(?:{BEFORE_NUMBER})(?=\.\s*[\d№\[])"
    rf"|(?:{BEFORE_LETTER})(?=\.\s+\p{{Lu}}(?![\p{{L}}\p{{M}}]))"
    r"|[\p{Lu}\p{Lo}](?=\.\s+\p{L})"  # initials
    r"|\p{Ll}(?=\.\s+(?:\p{Ll}|\p{Lu}\.))"  # letters of an abbreviation such as z. B.
    rf"|(?:{MAY_END})(?=\.\s+(?:{FUNCTION_WORDS})(?!\p{{L}})))\."
    r"|\.(?:(?=[\p{L}\p{N}_/@&=?%#~.-])"
    r"|(?<=\.\.\.)(?=\s+\p{Ll})"
    rf"|(?<=\d\.)(?=\s+(?:{MONTHS})(?!\p{{L}}))"
    r"|(?<=(?<!\p{L})(?:i\.e|e\.g|d\.h|z\.B)\.)(?=\s)"
    rf"|(?<=(?<!\p{{L}})[ap]\.m\.)(?=\s+(?:{FUNCTION_WORDS})(?!\p{{L}}))"
    rf"|(?<=\b\p{{Lu}}\.\p{{Lu}}\.)(?=\s+(?:(?:{FUNCTION_WORDS})(?!\p{{L}})|(?!{OPENING_WORDS})\p{{Lu}})))"
)
#: Terminators inside a quotation or bracket, but not its last character: from the opener on, one after the other.
QUOTED = rf"((?:(?=[\"“„«「『(（]){_OPENER}|\G(?!\A))[^{_QUOTES}{_TERMINATORS}]*+[{_TERMINATORS}]++)(?![{_CLOSERS}])"
_THAI = r"\u0E00-\u0E7F"
BOUNDARY_AFTER = (
    r"(?=[.!?।؟…。！？\n])(?:[.!?।؟]+(?=\s)"
    r"|[.!?।؟…]+\s?[”\"“»’')\]」』]+(?=\s+[^\s\p{Ll}])"
    r"|…+(?=\s+[\p{Lu}\p{Lo}\d\"“«„¿¡])"
    rf"|[。！？]+(?![。！？」』”）)\s{GUARD}])"
    r"|[。！？]+[」』”）)]*(?=\s)"
    r"|\n(?=(?:[-*•]|\d{1,3}[.)])\s))"
)
#: Thai: a space between Thai letters, or after the number of a percentage.
THAI_BOUNDARY_AFTER = rf"ร้อยละ [\d.,{DOT}]+(?=\s+[{_THAI}])|[{_THAI}](?=\s+[{_THAI}])"


def _lit(s: str) -> Column:
    return F.lit(s)


#: Elements that are added up one after the other; longer arrays are added up run by run.
_RUN = 256


def running_starts(lengths: Column) -> Column:
    """For an array of lengths, where each element starts: the sum of those before it."""
    zero = F.array().cast("array<int>")

    def starts(a: Column) -> Column:
        return F.aggregate(a, F.struct(F.lit(0).alias("at"), zero.alias("starts")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])

    total = lambda a: F.aggregate(a, F.lit(0), lambda x, n: x + n)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN).cast("int")), lambda k: F.slice(lengths, k * _RUN + 1, F.lit(_RUN)))
    by_runs = let(runs, lambda rs: let(starts(F.transform(rs, total)), lambda at: F.flatten(F.transform(rs, lambda r, i: F.transform(starts(r), lambda x: x + F.element_at(at, i + 1))))))
    return F.when(F.size(lengths) <= _RUN, starts(lengths)).otherwise(by_runs)


def _restored(piece: Column) -> Column:
    return F.translate(F.replace(piece, _lit(DOT), _lit(".")), _ASIDE, _RESERVED)


def sentence_units(df: DataFrame, record: str, text: str) -> DataFrame:
    """Rows (record, block_no, start_pos, end_pos, unit): positions are counts of code points, end_pos inclusive; blocks count from 0.

    One narrow stage.  Each pattern is a step of its own, as the next one reads its
    result more than once."""
    ws = _lit(" \t\n\r\f\u000b\u00a0\u3000")
    rows = df.select(F.col(record).alias("_id"), F.col(text).alias("_t")).where("_t is not null and _t <> ''")
    blocks = rows.select("_id", F.split("_t", r"(?=\n[ \t]*\n)").alias("_bs"))
    blocks = blocks.select("_id", F.posexplode(F.arrays_zip("_bs", running_starts(F.transform("_bs", F.length)).alias("_at"))).alias("_b", "_z"))
    # Only prose meets the patterns.
    prose = blocks.select("_id", "_b", F.col("_z._at").alias("_at"), F.col("_z._bs").alias("_m")).where(~F.col("_m").rlike(NO_PROSE))
    m = F.col("_m")
    prose = prose.withColumn("_one", m.rlike(ONE_UNIT))
    prose = prose.withColumn("_m", F.when(m.rlike(f"[{_RESERVED}]"), F.translate(m, _RESERVED, _ASIDE)).otherwise(m))
    prose = prose.withColumn("_m", F.regexp_replace(m, _lit(MASKED_DOT), _lit("$1" + DOT)))
    prose = prose.withColumn("_m", F.when(m.rlike('["“«„「『(（]'), F.regexp_replace(m, _lit(QUOTED), _lit("$1" + GUARD))).otherwise(m))
    prose = prose.withColumn("_m", F.when(F.col("_one"), m).otherwise(F.regexp_replace(m, _lit(BOUNDARY_AFTER), _lit("$0" + BOUNDARY))))
    prose = prose.withColumn("_m", F.when(m.rlike(f"[{_THAI}]") & ~F.col("_one"), F.regexp_replace(m, _lit(THAI_BOUNDARY_AFTER), _lit("$0" + BOUNDARY))).otherwise(m))
    # placeholders of full stops have their length, guards have none
    pieces = prose.select("_id", "_b", "_at", F.split(F.replace(m, _lit(GUARD), _lit("")), BOUNDARY).alias("_ps"))
    pieces = pieces.withColumn("_starts", F.when(F.size("_ps") > 1, running_starts(F.transform("_ps", F.length))).otherwise(F.array(F.lit(0))))
    units = pieces.select("_id", "_b", "_at", F.explode(F.arrays_zip("_ps", "_starts")).alias("_z"))
    units = units.select("_id", "_b", (F.col("_at") + F.col("_z._starts")).alias("_from"), F.col("_z._ps").alias("_piece"))
    units = units.withColumn("_rest", F.ltrim("_piece", ws)).withColumn("_unit", F.rtrim("_rest", ws)).where("_unit <> ''")
    start = F.col("_from") + F.length("_piece") - F.length("_rest")
    return units.select(F.col("_id").alias(record), F.col("_b").alias("block_no"), start.cast("int").alias("start_pos"), (start + F.length("_unit")).cast("int").alias("end_pos"), _restored(F.col("_unit")).alias("unit"))
