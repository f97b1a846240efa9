"""Text expressions. All are built-in Spark functions, so they stay in codegen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Columns tried, in this order, when the mapped keywords are blank.
KEYWORD_FALLBACKS = ["Author Keywords", "Keywords Plus", "DE", "ID", "关键词"]


def quoted(name: str) -> Column:
    """Column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def check_names(names: Iterable[str]) -> None:
    """Refuse names that differ in case only: Spark columns are case-insensitive."""
    seen: dict[str, str] = {}
    for name in names:
        other = seen.setdefault(name.lower(), name)
        if other != name:
            raise ValueError(f"columns {other!r} and {name!r} differ in case only; rename one of them")


def clean_text(col: Column) -> Column:
    """Text without surrounding white space; null becomes the empty string."""
    return F.coalesce(F.trim(col.cast("string"), F.lit(WHITESPACE)), F.lit(""))


def longest_of(cols: Sequence[Column]) -> Column:
    """Longest non-blank of several columns after cleaning; ties go to the first."""
    ranked = F.array(
        *[
            F.struct(F.length(clean_text(c)).alias("chars"), F.lit(-i).alias("first"), clean_text(c).alias("value"))
            for i, c in enumerate(cols)
        ]
    )
    return F.array_max(ranked)["value"]


def keyword_fallback(keywords: Column | None, columns: Iterable[str]) -> Column:
    """The mapped keywords, or the first non-blank of the fallback columns that exist."""
    present = set(columns)
    tried = [] if keywords is None else [keywords]
    tried += [quoted(c) for c in KEYWORD_FALLBACKS if c in present]
    return F.coalesce(*[F.nullif(clean_text(c), F.lit("")) for c in tried], F.lit(""))


def paper_text(title: Column, abstract: Column, keywords: Column) -> Column:
    """Three labelled lines describing one paper."""
    return F.concat(
        F.lit("Title: "), clean_text(title),
        F.lit("\nAbstract: "), clean_text(abstract),
        F.lit("\nKeywords: "), clean_text(keywords),
    )


def split_list(col: Column, sep: str = ",") -> Column:
    """Items of a separated list, cleaned, without blanks."""
    items = F.transform(F.split(col, F.lit("\\Q" + sep + "\\E")), clean_text)
    return F.filter(items, lambda x: x != "")


def split_argument(value: str | Iterable[str] | None) -> list[str]:
    """The same rule for an argument given by the caller."""
    if value is None:
        return []
    items = value.split(",") if isinstance(value, str) else value
    return [i.strip() for i in items if i.strip()]
