"""Column expressions on cells, names and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blank at either end of a cell; fixed values.
BLANKS = " \t\n\r\0\x0b"

#: Of a quoted cell: the blanks before its opening quote, and what stands up to the closing one.
LEAD = r"[ \t\x0B\f\r]*+"
BODY = '[^"]*+(?:""[^"]*+)*+'

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def trim_cell(cell: Column) -> Column:
    """The cell without blanks at either end."""
    return F.btrim(cell, F.lit(BLANKS))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, any other character kept."""
    return F.translate(text, _UPPER, _UPPER.lower())


def is_blank(cells: Column) -> Column:
    """Whether every cell of a record is blank."""
    return F.forall(cells, lambda c: F.coalesce(trim_cell(c), F.lit("")) == "")


def split_cells(record: Column) -> Column:
    """Cells of a comma-separated record.

    A quote that only blanks stand before opens quotes (the blanks go), doubled quotes inside stand for one, and
    what follows the closing one is kept as it is; a quote anywhere else is a letter.
    """
    # the comma in front makes a leading empty cell visible to the pattern; possessive, so long cells need no stack
    cell = f'(?s),({LEAD}"{BODY}(?:"[^,]*+)?+|[^,]*+)'
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(cell), F.lit(1))
    quoted = f'(?s)^{LEAD}"({BODY})"?+(.*+)\\z'
    plain = lambda c: F.concat(F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, quoted, 2))
    return F.transform(found, lambda c: F.when(F.contains(c, F.lit('"')) & c.rlike(f'^{LEAD}"'), plain(c)).otherwise(c))


def join_cells(cells: Column) -> Column:
    """A record of these cells; cells with a quote, comma, blank or line break are quoted."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.array_join(F.transform(cells, lambda c: F.when(c.rlike('[",\\s\\\\]'), quoted(c)).otherwise(F.coalesce(c, F.lit("")))), ",")


def limited(message: Column, most: int = 1000) -> Column:
    """A message of at most ``most`` characters, with dots where it was cut."""
    return F.when(F.length(message) > most, F.concat(F.rtrim(F.substring(message, 1, most)), F.lit("..."))).otherwise(message)


def file_size(size: Column) -> Column:
    """Bytes in the largest unit that gives at least 1, rounded: ``512 MB``."""
    units = ("B", "KB", "MB", "GB", "TB", "PB", "EB")
    out = F.lit(None).cast("string")
    for k in reversed(range(len(units))):
        text = F.concat(F.format_number(F.round(size / F.lit(1024.0**k)), 0), F.lit(f" {units[k]}"))
        # the next unit starts at nine tenths of it
        out = F.when(size / F.lit(1024.0**k) <= 0.9 * 1024, text).otherwise(out) if k < len(units) - 1 else text
    return out


def extension(name: Column) -> Column:
    """What follows the last dot of a file name; empty without one."""
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./\\]*)$", 1)


def download_name(name: Column, suffix: str) -> Column:
    """Stem of the uploaded file's name (``import`` where it has none) and ``-suffix.csv``."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("import")), F.lit(f"-{suffix}.csv"))


def folder_of(key: Column, levels: int = 1) -> Column:
    """The key without its last ``levels`` parts."""
    return F.regexp_replace(key, "(/[^/]*){%d}$" % levels, "")


def chunk_key(source_key: Column, sequence: Column) -> Column:
    """Where a chunk of the source lies: beside the source's folder, numbered with six digits."""
    return F.format_string("%s/chunks/chunk-%06d.csv", folder_of(source_key, 2), sequence)


def error_key(chunk: Column) -> Column:
    """Where the rejected rows of a chunk lie."""
    return F.regexp_replace(chunk, "/chunks/([^/]*)$", "/errors/$1")


def output_key(source_key: Column, name: str) -> Column:
    """Where an output of the import lies: ``result.csv`` or ``errors.csv``."""
    return F.concat(folder_of(source_key, 2), F.lit(f"/output/{name}"))
