"""Text folding and cleaning with built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with accents and what they fold to.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


#: Tags after which a line ends, the mark of a list item, and the entities that occur.
LINE_ENDS, BULLET = r"(?i)<br\s*/?>|</(?:li|p|div|rules|maintext)>", "• "
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
_NO_TEXT = r"<[^>]+>|(?i:%i:[a-z0-9_]+%)"
_BLANK = " \t\n\x0b\f\r"


def plain_text(html: Column) -> Column:
    """Readable text of simple markup: lines with single spaces, at most one empty line between two others."""
    lined = F.regexp_replace(F.coalesce(html, F.lit("")), LINE_ENDS, "\n")
    text = F.regexp_replace(F.regexp_replace(lined, "(?i)<li>", BULLET), _NO_TEXT, "")
    text = reduce(lambda t, e: F.replace(t, F.lit(e), F.lit(ENTITIES[e])), ENTITIES, text)
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    shown = F.filter(lines, lambda x, i: (x != "") | (F.get(lines, i - 1) != ""))
    return F.btrim(F.array_join(shown, "\n"), F.lit(_BLANK))


def number(x: Column) -> Column:
    """A number with two places at most, written without needless zeros."""
    hundredths = F.floor(x * 100 + 0.5)
    return F.when(hundredths % 100 == 0, (hundredths / 100).cast("long").cast("string")).otherwise(F.rtrim((hundredths / 100).cast("decimal(38,2)").cast("string"), F.lit("0")))


_MARK = r"@[A-Za-z0-9_]+(?:\*[0-9.]+)?@"


def with_values(text: Column, values: Column) -> Column:
    """``text`` with @name@ and @name*factor@ replaced by the first of a map's values,
    rounded to two places; names in lower case, unknown ones stay."""

    def shown(mark: Column) -> Column:
        part = F.split(F.btrim(mark, F.lit("@")), r"\*")
        value = F.try_element_at(F.try_element_at(values, F.lower(part[0])), F.lit(1))
        return F.coalesce(number(value * F.coalesce(F.get(part, 1).try_cast("double"), F.lit(1.0))), mark)

    between, marks = F.split(text, _MARK), F.regexp_extract_all(text, F.lit(f"({_MARK})"), 1)
    return F.array_join(F.zip_with(between, F.transform(marks, shown), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def resolved_lines(text: Column) -> Column:
    """``text`` without the lines that still hold an @name@."""
    return F.btrim(F.regexp_replace(text, r"(?m)^.*@[^@\n]+@.*$\n?", ""), F.lit(_BLANK))


def riot_id(text: Column, tag: str = "EUW") -> Column:
    """struct(name, tag) of ``name#tag``: the first # parts them, an empty tag is the default one, without a name it is null."""
    t = F.btrim(text, F.lit(_BLANK))
    name = F.btrim(F.substring_index(t, "#", 1), F.lit(_BLANK))
    rest = F.btrim(F.when(F.instr(t, "#") > 0, F.substring(t, F.instr(t, "#") + 1, F.length(t))), F.lit(_BLANK))
    return F.when(F.length(name) > 0, F.struct(name.alias("name"), F.when(F.length(rest) > 0, rest).otherwise(F.lit(tag)).alias("tag")))
