"""Secret scan with DataFrame functions only.

Three kinds follow fixed patterns (assign, access, hex).  A fourth, random, comes from a battery of randomness tests: each
long run of key characters is taken for hexadecimal, base 32, 36, 62 or 64 by its characters; chi-squared tests the
uniformity of that alphabet, a runs test (above and below the alphabet's middle) and the serial correlation of neighbours
test independence.  A run that passes them is a candidate; its p-value is its likelihood as text (pairs of letters, changes
of character class, in one case or in both) over its likelihood as a random string of its encoding, which under the text
model is at most p with probability p (Markov's inequality).  Of a document's candidates those stay that the
Benjamini-Hochberg procedure keeps at FALSE_RATE, with the level of each test shared among the run's length.

Only documents that a plain pattern match finds are taken apart; the others pass by.  Null texts are empty; texts of any length
are searched whole; spans count code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs of key characters that the battery looks at: with a digit and a letter, of a length at which its tests have power.
LEAST_RUN = 16
RUN = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{{LEAST_RUN},}}={{0,2}}(?![A-Za-z0-9+/_-])"
KINDS = ["assign", "access", "hex", "random"]
FALSE_RATE = 0.001
#: Two-sided level of a randomness test for a run of LEAST_RUN characters.
LEVEL = 0.01
#: -2 log2 of a letter's probability in text, in base 36: a row of letters that follow no letter, then a row for each letter before.
LETTERS = """
    7ca95cba7gf9b78bf8889dehef ba9a9dce9je695caj685cdffci 7fdc6ffd5aj6eb7dj89b7hhk9j 7ecd6ed78kc8eb5ej9a6ahidcj
    6cb94ede5ei9ea8eja899fhidj 8e978cceaji9b6cbb668dce9ei 7fcc78fe4kjaeb5eh8b99hhjdj 8f9d4db77kjad8aej7aa9gfkdg
    6fed3gfe7kjcdb6fj9b8cheldj 9c898aaebkh8a56bia77dbigic 8fdd3gfebjecdb7ejb6b6ghkhi 9dec2ccd7khba8cdja7bbhgkgj
    7fda4efe6ki7da7ejc989ggl9i 5aec4gfe7kicab76jc9b9hhlfj 8f876c7e9jfcda8djb75behldi bcb999bebic885aaj5988caghi
    6gcc5ffc8kh6db7ai5a89ehgaj bf9d9gfebkjbebcedaab2hhkhi 7faa4fce6kccaa6dj989acggbj 9gad5ffa6kecdb9afc758cgldj
    7fcd5gf56kjbdb8dg78aahdjaj 8bab6fbe9kj786c9j776dhikij 4gbd3gbe6kjdebafjcabdhhlhj 7edd6gf64kibe97fi99bdhdlhj
    8g8d7gfd8kjccba5jcb3dhhhdi bfbc8gde9kj9a946ja57dgclhe 6fed2ffd9kjdebbejbbbdhhkai
"""
#: Probability in text of the next class (lower case, upper case, digit, sign) after each class, and of the first one; letters of
#: a run in one case all count as lower case.
ONE_CASE = [[0.9, 0, 0.06, 0.04], [0, 0, 0, 0], [0.15, 0, 0.68, 0.17], [0.6, 0, 0.33, 0.07]]
TWO_CASES = [[0.87, 0.05, 0.04, 0.04], [0.5, 0.38, 0.06, 0.06], [0.1, 0.08, 0.66, 0.16], [0.36, 0.26, 0.3, 0.08]]
FIRST = [0.5, 0.25, 0.15, 0.1]

SPAN = "struct<start:int,end:int,kind:int>"
#: Matches that are placed together.
RUN_OF = 256


def _found(text: Column, pattern: str, kind: int, least: int, group: int) -> Column:
    """Spans (start, end, kind) of a pattern's matches whose group has at least so many characters.  Each match is read
    with the gap before it, so running sums of lengths give its place."""
    whole = rf"\G(?s)(.*?)({pattern})"  # \G: no second search of what follows the last match
    gaps, hits = F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    parts = F.regexp_extract_all(text, F.lit(whole), F.lit(group)) if group != 2 else hits
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), parts.alias("part"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        span = F.struct(a.alias("start"), b.alias("end"), F.lit(kind).alias("kind"))
        keep = F.when(F.length(x["part"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(b.alias("at"), keep.alias("spans"))

    # runs of RUN_OF matches, each from 0 on, and then moved to their places: appending copies no more than RUN_OF spans
    def placed(rows: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN_OF).cast("int")), lambda i: F.aggregate(F.slice(rows, i * RUN_OF + 1, F.lit(RUN_OF)), zero, step))
        return _let(runs, moved)

    def moved(runs: Column) -> Column:
        offsets = F.aggregate(runs, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
        shift = lambda r, by: F.transform(r["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["kind"].alias("kind")))
        return F.flatten(F.zip_with(runs, F.slice(offsets, F.lit(1), F.size(runs)), shift))

    return _let(rows, lambda r: F.when(F.size(r) > 0, placed(r)).otherwise(none))


def _once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind a generator of one row, so that they are not worked out anew wherever they are used."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    return rows.select(*rest, F.explode(F.array(made)).alias("__made")).select(*rest, *[F.col("__made")[n].alias(n) for n in columns])


def _two_sided(z: Column) -> Column:
    """p of a standard normal score, by a rational approximation of the error function (error below 2e-7)."""
    x = F.abs(z) / F.lit(2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _constants(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is worked out once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def battery(run: Column) -> Column:
    """Struct (encoding, p_uniform, p_runs, p_serial, p_text) of a string column."""
    return _let(F.regexp_replace(run, "=+$", ""), lambda body: _let(_encoding(body), lambda e: _let(_coded(body, e), lambda x: _tests(e, x))))


def _encoding(body: Column) -> Column:
    is_hex = body.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    is_32 = body.rlike("^([A-Z2-7]+|[a-z2-7]+)$")
    is_36 = body.rlike("^([0-9a-z]+|[0-9A-Z]+)$")
    is_62 = body.rlike("^[0-9A-Za-z]+$")
    of = lambda *x: F.when(is_hex, x[0]).when(is_32, x[1]).when(is_36, x[2]).when(is_62, x[3]).otherwise(x[4])
    mixed = body.rlike("[a-z]") & body.rlike("[A-Z]")
    return F.struct(of("hex", "base32", "base36", "base62", "base64").alias("encoding"), of(16.0, 32.0, 36.0, 62.0, 64.0).alias("size"), mixed.alias("mixed"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _coded(body: Column, e: Column) -> Column:
    """Struct of each character's place in the encoding's alphabet, and of four times its letter's number and its class."""
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    code = F.when(e["size"] == 16, F.transform(chars, lambda c: F.instr(F.lit("0123456789abcdef"), F.lower(c))))
    code = code.when(e["size"] == 32, F.transform(chars, lambda c: F.instr(F.lit(_UPPER + "234567"), F.upper(c))))
    code = code.when(e["size"] == 36, F.transform(chars, lambda c: F.instr(F.lit(_UPPER + "0123456789"), F.upper(c))))
    code = code.otherwise(F.transform(chars, lambda c: F.instr(F.lit(_UPPER + _UPPER.lower() + "0123456789+/"), F.translate(c, "-_", "+/"))))
    kind = lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), e["mixed"].cast("int")).when(c.between("0", "9"), 2).otherwise(3)
    spelt = F.transform(chars, lambda c: F.instr(F.lit(_UPPER), F.upper(c)) * 4 + kind(c))
    return F.struct(F.transform(code, lambda v: (v - 1).cast("double")).alias("values"), spelt.alias("spelt"))


def _neighbours(x: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), fn)


def _total(x: Column, zero: int | float) -> Column:
    return F.aggregate(x, F.lit(zero), lambda a, v: a + v)


def _tests(e: Column, x: Column) -> Column:
    values, size = x["values"], e["size"]
    n = F.size(values).cast("double")
    # chi-squared over the alphabet, to a normal score after Wilson and Hilferty
    squares = F.aggregate(F.array_distinct(values), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(values, lambda w: w == v)).cast("double"), F.lit(2.0)))
    chi = squares * size / n - n
    df = size - 1
    z_uniform = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # runs above and below the middle
    above = F.transform(values, lambda v: (v >= size / 2).cast("int"))
    ups = _total(above, 0).cast("double")
    downs = n - ups
    runs = 1 + _total(_neighbours(above, lambda a, b: (a != b).cast("int")), 0).cast("double")
    mean = 2 * ups * downs / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = F.when((ups == 0) | (downs == 0), F.lit(50.0)).otherwise((runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9))))
    # correlation of neighbours
    off = _let(_total(values, 0.0) / n, lambda avg: F.transform(values, lambda v: v - avg))
    z_serial = _let(off, lambda o: _let(F.aggregate(o, F.lit(0.0), lambda a, v: a + v * v), lambda spread: F.when(spread <= 0, F.lit(50.0)).otherwise((_total(_neighbours(o, lambda a, b: a * b), 0.0) / spread + 1 / n) * F.sqrt(n))))
    # likelihood as text over that as a random string
    changes = lambda table: _constants([math.log(p) if p else 0.0 for row in table for p in row])
    letters = _constants([-int(v, 36) * math.log(2) / 2 for v in "".join(LETTERS.split())])

    def spelt(before: Column, c: Column) -> Column:
        letter = F.get(letters, F.shiftright(before, 2) * 26 + F.shiftright(c, 2) - 1)
        return F.when(c >= 4, letter).when(c == 2, -math.log(10)).otherwise(-math.log(4))

    def as_text(a: Column, b: Column) -> Column:
        return F.get(changes(ONE_CASE + TWO_CASES), e["mixed"].cast("int") * 16 + a % 4 * 4 + b % 4) + spelt(a, b)

    likely = _let(F.get(x["spelt"], F.lit(0)), lambda c: F.get(changes([FIRST]), c % 4) + spelt(F.lit(0), c)) + _total(_neighbours(x["spelt"], as_text), 0.0)
    p_text = F.exp(F.least(likely + n * F.log(size), F.lit(0.0)))
    return F.struct(e["encoding"].alias("encoding"), _two_sided(F.greatest(z_uniform, F.lit(0.0))).alias("p_uniform"), _two_sided(z_runs).alias("p_runs"), _two_sided(z_serial).alias("p_serial"), p_text.alias("p_text"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "found") -> DataFrame:
    """Adds found, an array of (start, kind number, end) in that order, under this or another name, to the columns keep (the
    id alone if not given).  Kept columns travel as one struct, so none of their names can clash with the scan's own; one
    that has the result's name raises a ValueError.  Narrow: nothing is shuffled."""
    kept = list(keep or [id_col])
    _shared.with_results(docs, kept, f"{_shared.quoted(name)} int")
    text = F.coalesce(F.col(_shared.quoted(text_col)).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(_shared.quoted(c)) for c in kept]).alias("__kept"), text.alias("__text"))
    none = F.array().cast(f"array<{SPAN}>")
    t = F.col("__text")
    seen = lambda quick, pattern, kind, least, group: F.when(t.rlike(quick), _found(t, pattern, kind, least, group)).otherwise(none)
    base = F.concat(
        seen(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", ASSIGN, 0, 8, 3),
        seen("AKIA[A-Z0-9]{12}", ACCESS, 1, 16, 2),
        seen("[0-9a-f]{32}", HEX + "(?<=[0-9a-f]{32})", 2, 32, 2),
    )
    runs = seen(RUN, RUN, 3, LEAST_RUN, 2)
    rows = _once(rows, {"__base": base, "__runs": runs})
    apart = F.filter("__runs", lambda r: ~F.exists("__base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    rows = _once(rows, {"__runs": F.when(F.size("__runs") > 0, apart).otherwise(none)})
    tested = F.transform("__runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind"), F.substring(F.col("__text"), r["start"] + 1, r["end"] - r["start"]).alias("run")))
    rows = _once(rows, {"__tested": F.when(F.size("__runs") > 0, F.transform(tested, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind"), battery(r["run"]).alias("t"))))})

    def random_enough(r: Column) -> Column:
        level = F.lit(LEVEL) * LEAST_RUN / (r["end"] - r["start"])
        return (r["t"]["p_uniform"] >= level) & (r["t"]["p_runs"] >= level) & (r["t"]["p_serial"] >= level)

    fit = F.filter("__tested", random_enough)
    order = F.sort_array(F.transform(fit, lambda r: r["t"]["p_text"]))
    many = F.size(order)
    passed = F.filter(F.transform(order, lambda p, i: F.struct(p.alias("p"), (p <= FALSE_RATE * (i + 1) / many).alias("ok"))), lambda x: x["ok"])
    cut = F.coalesce(F.array_max(F.transform(passed, lambda x: x["p"])), F.lit(-1.0))
    rows = _once(rows, {"__cut": F.when(F.col("__tested").isNotNull(), cut).otherwise(F.lit(-1.0))})
    random = F.transform(F.filter("__tested", lambda r: random_enough(r) & (r["t"]["p_text"] <= F.col("__cut"))), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind")))
    found = F.concat("__base", F.coalesce(random, none))
    by_place = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    rows = _once(rows, {"__found": F.sort_array(by_place)})
    return rows.select("__kept.*", F.col("__found").alias(name))


def masked(found: DataFrame, text_col: str, mark: str, name: str = "found") -> DataFrame:
    """Replaces the spans in the column name by a mark; spans that overlap get one mark together."""
    text, spans = F.col(_shared.quoted(text_col)), F.col(_shared.quoted(name))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of each row of documents."""
    found = scan_secrets(docs)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), count(3).alias("n_random"))
