"""String functions: positions count from 0 and ranges end before their end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._args import as_col

_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def upper(s) -> Column:
    return F.upper(as_col(s))


def lower(s) -> Column:
    return F.lower(as_col(s))


def trim(s) -> Column:
    return F.regexp_replace(as_col(s), f"^{_SPACE}+|{_SPACE}+$", "")


def trim_left(s) -> Column:
    return F.regexp_replace(as_col(s), f"^{_SPACE}+", "")


def trim_right(s) -> Column:
    return F.regexp_replace(as_col(s), f"{_SPACE}+$", "")


def starts_with(s, prefix) -> Column:
    return F.startswith(as_col(s), _text(prefix))


def ends_with(s, suffix) -> Column:
    return F.endswith(as_col(s), _text(suffix))


def contains(x, y, kind: str = "string") -> Column:
    """A substring, an element of an array, or a key of a map."""
    if kind == "array":
        return F.array_contains(as_col(x), y)
    if kind == "map":
        return F.map_contains_key(as_col(x), y)
    return F.contains(as_col(x), _text(y))


def replace(s, old: str, new: str) -> Column:
    return F.replace(as_col(s), F.lit(old), F.lit(new))


str_replace = replace


def split(s, sep: str) -> Column:
    return F.split(as_col(s), _quoted(sep), -1)


def join(items, sep: str = "") -> Column:
    return F.array_join(as_col(items).cast("array<string>"), sep)


def substr(s, start: int, end: int | None = None) -> Column:
    s = as_col(s)
    return F.substring(s, start + 1, F.lit(2**31 - 1) if end is None else F.lit(max(0, end - start)))


def char_at(s, i: int) -> Column:
    return F.nullif(F.substring(as_col(s), i + 1, 1), F.lit(""))


def index_of(s, part: str) -> Column:
    return (F.instr(as_col(s), part) - 1).cast("long")


def str_len(s) -> Column:
    return F.char_length(as_col(s)).cast("long")


def byte_len(s) -> Column:
    return F.octet_length(as_col(s)).cast("long")


def str_repeat(s, n: int) -> Column:
    return F.repeat(as_col(s), n)


def pad_left(s, width: int, fill: str) -> Column:
    """Pads with the first character of fill; never cuts."""
    s = as_col(s)
    return F.when(F.char_length(s) < width, F.lpad(s, width, fill[:1])).otherwise(s)


def pad_right(s, width: int, fill: str) -> Column:
    s = as_col(s)
    return F.when(F.char_length(s) < width, F.rpad(s, width, fill[:1])).otherwise(s)


def code_point(s) -> Column:
    return F.ascii(as_col(s)).cast("long")


def chr_(n) -> Column:
    """The character of a code point (UTF-32 bytes decoded, as char() only knows 256 of them)."""
    return F.decode(F.unhex(F.lpad(F.hex(as_col(n).cast("long")), 8, "0")), "UTF-32")


def format_(template: str, *args) -> Column:
    """{} and {0} placeholders."""
    import re

    out, nth, at = [], 0, 0
    for m in re.finditer(r"\{(\d*)\}", template):
        out.append(F.lit(template[at : m.start()]))
        k = int(m[1]) if m[1] else nth
        nth += not m[1]
        out.append(as_col(args[k]).cast("string"))
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def lines(s) -> Column:
    return F.split(as_col(s), r"\r?\n", -1)


def cut(s, sep: str, fields: list[int]) -> Column:
    """Fields of each line, joined by the same separator."""
    return F.transform(lines(s), lambda line: F.array_join(F.array(*[F.coalesce(F.get(F.split(line, _quoted(sep), -1), F.lit(i)), F.lit("")) for i in fields]), sep))


def paste(a, b, sep: str = "\t") -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: F.concat(F.coalesce(x.cast("string"), F.lit("")), F.lit(sep), F.coalesce(y.cast("string"), F.lit(""))))


def wc(s) -> Column:
    s = as_col(s)
    words = F.size(F.filter(F.split(s, r"\s+", -1), lambda w: w != ""))
    n_lines = F.when(s == "", 0).otherwise(F.size(F.split(F.regexp_replace(s, r"\r?\n$", ""), r"\r?\n", -1)))
    return F.struct(n_lines.cast("long").alias("lines"), words.cast("long").alias("words"), str_len(s).alias("chars"), byte_len(s).alias("bytes"))


def grep(s, pattern: str, invert: bool = False, ignore_case: bool = False) -> Column:
    """The lines that a pattern matches."""
    p = f"(?i){pattern}" if ignore_case else pattern
    return F.filter(lines(s), lambda x: ~x.rlike(p) if invert else x.rlike(p))


def grep_count(s, pattern: str, **options) -> Column:
    return F.size(grep(s, pattern, **options)).cast("long")


def regex_match(s, pattern: str) -> Column:
    return as_col(s).rlike(pattern)


def regex_find(s, pattern: str) -> Column:
    return F.regexp_extract_all(as_col(s), F.lit(pattern), F.lit(0))


regex_find_all = regex_find


def regex_replace(s, pattern: str, new: str) -> Column:
    return F.regexp_replace(as_col(s), pattern, new)


regex_replace_all = regex_replace


def regex_split(s, pattern: str) -> Column:
    return F.split(as_col(s), pattern, -1)


def regex_captures(s, pattern: str, groups: int) -> Column:
    s = as_col(s)
    return F.when(s.rlike(pattern), F.array(*[F.regexp_extract(s, pattern, k) for k in range(groups + 1)]))


def edit_distance(a, b) -> Column:
    return F.levenshtein(as_col(a), as_col(b)).cast("long")


def hamming_distance(a, b) -> Column:
    """Places that differ; null for strings of unlike length."""
    a, b = as_col(a), as_col(b)
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("long"))
    return F.when(F.char_length(a) == F.char_length(b), F.aggregate(differ, F.lit(0).cast("long"), lambda n, x: n + x))


def _quoted(sep: str) -> str:
    import re

    return re.escape(sep)


def _text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
