"""Splitting of cells that hold several values.

A cell's *skeleton* is the cell with its ordinary characters masked. It is
folded to what the splitting depends on: which separators occur, which quotes
occur, and whether the cell is written as a bracketed list. There are at most
2^7 * 2^2 * 2 folded skeletons, whatever the size of the table, so the rules
resolved for them are a small dimension with a proven bound and are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = {"pipe": "|", "comma": ",", "semicolon": ";", "slash": "/", "newline": "\n", "return": "\r", "tab": "\t"}
QUOTES = {"double": '"', "single": "'"}
_BLANK = r"[\s\p{Z}\x{0085}\x{FEFF}]"
#: blanks that are no separators
_GAP = r"[\x0B\f\p{Zs}\x{0085}\x{FEFF}]"
#: one rule per folded skeleton
MAX_SKELETONS = 2 ** (len(SEPARATORS) + len(QUOTES) + 1)


def _strip(column: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(column, f"^{_BLANK}++|(?<!{_BLANK}){_BLANK}++$", "")


def _quoted(quote: str) -> str:
    """A regular expression for one quoted value; a doubled quote inside stands for one."""
    return f"{quote}[^{quote}]*+(?:{quote}{quote}[^{quote}]*+)*+{quote}"


def skeleton(cell: Column) -> Column:
    """The cell with every run of ordinary characters masked by ``x``."""
    return F.regexp_replace(cell, r"[^|,;/\n\r\t\"'\[\]]++", "x")


def folded_skeleton(cell: Column) -> Column:
    """The part of the skeleton that splitting depends on, as a short string.

    Quoted values are masked as a whole first, so that what they hold decides
    nothing.
    """
    edge = rf"(?:^|(?<=[|,;/\n\r\t\[])){_GAP}*+"
    end = rf"(?={_GAP}*+(?:[|,;/\n\r\t\]]|\z))"
    bare = F.regexp_replace(cell, rf"({edge}){_quoted(chr(34))}{end}", '$1"')
    bare = F.regexp_replace(bare, rf"({edge}){_quoted(chr(39))}{end}", "$1'")
    marks = skeleton(_strip(bare))
    listed = marks.rlike(r"^\[[^\[\]]*+\]$")
    parts = [F.when(listed, F.lit("L")).otherwise(F.lit("-"))]
    parts += [F.when(F.contains(marks, F.lit(c)), F.lit(name[0:2])).otherwise(F.lit("--")) for name, c in {**SEPARATORS, **QUOTES}.items()]
    return F.concat(*parts)


def splitting_rule(folded: Column) -> list[Column]:
    """``is_list`` and ``pattern`` (a regular expression matching one value) for a folded skeleton."""
    names = [*SEPARATORS, *QUOTES]
    has = {name: F.substring(folded, 2 + 2 * i, 2) == name[0:2] for i, name in enumerate(names)}
    escapes = {"\n": r"\n", "\r": r"\r", "\t": r"\t"}
    separators = F.concat(*[F.when(has[n], F.lit(escapes.get(c, c))).otherwise(F.lit("")) for n, c in SEPARATORS.items()])
    # without any separator the whole cell is one value
    plain = F.when(separators == "", F.lit(r"[\s\S]++")).otherwise(F.concat(F.lit("[^"), separators, F.lit("]++")))
    end = F.when(separators == "", F.lit(rf"{_GAP}*+\z")).otherwise(F.concat(F.lit(rf"{_GAP}*+(?=["), separators, F.lit("]|\\z)")))
    quoted = [F.when(has[n], F.concat(F.lit(rf"{_GAP}*+{_quoted(q)}"), end, F.lit("|"))).otherwise(F.lit("")) for n, q in QUOTES.items()]
    return [(F.substring(folded, 1, 1) == "L").alias("is_list"), F.concat(*quoted, plain).alias("pattern")]


def _value(raw: Column) -> Column:
    """The value of a raw item: without outer blanks and one pair of outer quotes."""
    text = _strip(raw)

    def unquoted(quote: str) -> Column:
        return F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(quote * 2), F.lit(quote))

    return _strip(F.when(text.rlike(f"^{_quoted(chr(34))}$"), unquoted('"')).when(text.rlike(f"^{_quoted(chr(39))}$"), unquoted("'")).otherwise(text))


def split_packed(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per value of the packed ``fields``.

    Result: the keys, ``field`` (name of the column), ``item_no`` (place of the
    value in its cell, from 1) and ``item_text``.

    * Text in quotes is one value whatever it holds; a doubled quote inside
      stands for one. Brackets around a whole cell are list brackets, others
      belong to their value.
    * Null, blank and valueless cells give no row; empty values don't count and
      take no place; repeated values keep their places. Repeated rows give their
      values again, as separate rows.
    * Keys may be null. Other columns are ignored, whatever their names. An empty
      table gives an empty result.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    wide = df.select(
        *[df[k].alias(n) for k, n in zip(keys, names)],
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), df[f].cast("string").alias("cell")) for f in fields])).alias("__c"),
    )
    cells = wide.select(*names, F.col("__c.field").alias("field"), F.col("__c.cell").alias("cell")).filter(F.col("cell").rlike(r"\S"))
    cells = cells.withColumn("folded", folded_skeleton(F.col("cell")))
    rules = cells.select("folded").distinct().select("folded", *splitting_rule(F.col("folded")))
    # bounded by MAX_SKELETONS rows, so the broadcast can't grow with the data
    ruled = cells.join(F.broadcast(rules), "folded")
    inner = F.when(F.col("is_list"), F.regexp_replace("cell", rf"^{_BLANK}*+\[|\]{_BLANK}*+\z", "")).otherwise(F.col("cell"))
    items = F.filter(F.transform(F.regexp_extract_all(inner, F.col("pattern"), F.lit(0)), _value), lambda v: v != "")
    return ruled.select(*names, "field", F.posexplode(items).alias("__at", "item_text")).select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)],
        "field",
        (F.col("__at") + 1).cast("int").alias("item_no"),
        "item_text",
    )


def split_tables(parts: Sequence[tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """The union of :func:`split_packed` over several tables with equal keys."""
    return reduce(DataFrame.unionByName, [split_packed(*p) for p in parts])
