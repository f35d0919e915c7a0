"""Document codes and search texts: keys, variants, fragments and patterns, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of codes and of white space that searches must accept.
SPACE = r"(?U)[\s\x1c-\x1f]"
DASHES = "-－—"
CODE_FRAGMENT = r"(?i)([A-Za-z]{1,6}(?:\s*/\s*[A-Za-z])?\s*[0-9]+(?:\.[0-9]+)*(?:\s*[-－—]\s*[0-9]{2,4})?)"
CODE_CORE = r"(?i)^([A-Z]{1,6}(?:/[A-Z])?)\s*([0-9]+(?:\.[0-9]+)*)\s*[-－—]?\s*([0-9]{2,4})?\s*$"
SPLIT_LETTERS = "TZX"

#: What sanitizing puts right, for columns and for texts of the driver alike: several slashes, and what stands for the space between prefix and number.
SLASHES = "[/／]+"
GAP = r"(^(?:[A-Za-z]{1,6}/[A-Za-z]|[A-Za-z]{2,5}[TZXtzx])(?=\d))|(?<=[A-Za-z]/[A-Za-z])\s*/\s*(?=\d)"
CJK = r"[一-鿿]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once a row: a lambda variable stays one value where the optimizer would inline a column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(x: Column) -> Column:
    """Stripped, with runs of white space as one space; null as empty."""
    return F.regexp_replace(strip(F.coalesce(x, F.lit(""))), f"{SPACE}+", " ")


def norm_key(x: Column) -> Column:
    """Upper case without white space; slashes and dashes stay."""
    return F.regexp_replace(F.upper(x), f"{SPACE}+", "")


def compact_key(x: Column) -> Column:
    """Upper case without white space, slashes and dashes."""
    return F.regexp_replace(F.upper(x), r"(?U)[\s\x1c-\x1f/／－—-]+", "")


def stored_compact(x: Column) -> Column:
    """The compact form that ranking compares: only plain spaces, slashes and dashes go."""
    return F.translate(F.upper(x), " /-—－／", "")


def sanitize(x: Column) -> Column:
    """Code input with stray slashes and missing spaces put right."""
    return collapse(F.regexp_replace(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), SLASHES, "/"), GAP, "$1 "))


def cjk_core(x: Column) -> Column:
    """All CJK characters joined if there are two at least, else empty."""
    only = F.regexp_replace(F.coalesce(x, F.lit("")), r"[^一-鿿]", "")
    return F.when(F.length(only) >= 2, only).otherwise("")


def looks_like_code(x: Column) -> Column:
    """No CJK character, but a letter and a digit."""
    return ~x.rlike(CJK) & x.rlike("[A-Za-z]") & x.rlike("[0-9]")


def first_by(values: Column, key) -> Column:
    """Array without entries whose key came before; the order stays."""

    def of(vs: Column, keys: Column) -> Column:
        kept = F.filter(F.transform(vs, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: F.array_position(keys, key(s["v"])) == s["i"] + 1)
        return F.transform(kept, lambda s: s["v"])

    return let(values, lambda vs: let(F.transform(vs, key), lambda keys: of(vs, keys)))


def fragments(x: Column) -> Column:
    """Codes in a text, each spelling once without regard to case; else the whole if it looks like a code."""

    def of(clean: Column, found: Column) -> Column:
        return F.when(F.size(found) > 0, first_by(found, F.upper)).when(looks_like_code(clean), F.array(clean)).otherwise(F.array().cast("array<string>"))

    pieces = lambda clean: F.transform(F.regexp_extract_all(clean, F.lit(CODE_FRAGMENT), F.lit(1)), collapse)
    return let(sanitize(x), lambda clean: let(pieces(clean), lambda found: of(clean, found)))


def text_keywords(x: Column) -> Column:
    """Search words besides the codes: CJK runs of two or more and Latin words of four or more, each once."""
    raw = strip(F.coalesce(x, F.lit("")))
    rest = F.aggregate(fragments(raw), raw, lambda a, f: F.regexp_replace(a, F.concat(F.lit("(?i)"), F.regexp_replace(f, r"([^A-Za-z0-9\s])", r"\\$1")), F.lit(" ")))
    runs = lambda s: F.regexp_extract_all(s, F.lit(r"([一-鿿]{2,})"), F.lit(1))
    words = F.regexp_extract_all(rest, F.lit("([A-Za-z]{4,})"), F.lit(1))
    every = F.concat(F.array(cjk_core(raw)), runs(raw), F.array(cjk_core(rest)), runs(rest), words)
    fit = F.filter(F.transform(every, collapse), lambda k: (F.length(k) >= 2) & ~looks_like_code(k) & ~k.rlike("^[A-Za-z]{1,3}$"))
    return first_by(fit, F.lower)


def lookup_variants(x: Column) -> Column:
    """Spellings of a code to look up: as given, upper case, without spaces, slashes or dashes, and with the slash put back."""
    dashed = lambda s: F.array(s, F.replace(s, F.lit("-"), F.lit("—")), F.replace(s, F.lit("-"), F.lit("－")), F.regexp_replace(s, "-+", ""))

    def put_back(source: Column) -> Column:
        return let(F.regexp_extract(source, CODE_CORE, 1), lambda prefix: F.when(prefix.rlike(f"^[A-Z]{{2,}}[{SPLIT_LETTERS}]$"), let(slashed(source, prefix), lambda s: F.array(s, F.replace(s, F.lit(" "), F.lit(""))))))

    def slashed(source: Column, prefix: Column) -> Column:
        number, year = (F.regexp_extract(source, CODE_CORE, k) for k in (2, 3))
        return F.concat(F.regexp_replace(prefix, "(.)$", "/$1"), F.lit(" "), number, F.coalesce(F.concat(F.lit("-"), F.nullif(year, F.lit(""))), F.lit("")))

    def of(raw: Column, upper: Column, dense: Column, bare: Column) -> Column:
        source = let(F.replace(bare, F.lit("-"), F.lit(" ")), lambda spaced: F.when(spaced.rlike(CODE_CORE), spaced).otherwise(dense))
        plain = F.array(raw, upper, F.regexp_replace(upper, f"{SPACE}+", " "))
        return F.concat(plain, dashed(dense), dashed(bare), F.coalesce(let(source, put_back), F.array().cast("array<string>")))

    squeezed = lambda raw, upper: let(F.regexp_replace(upper, f"{SPACE}+", ""), lambda dense: let(F.replace(dense, F.lit("/"), F.lit("")), lambda bare: of(raw, upper, dense, bare)))
    every = let(strip(x), lambda raw: let(F.upper(raw), lambda upper: squeezed(raw, upper)))
    return F.filter(F.array_distinct(F.transform(every, strip)), lambda v: v != "")


def leading_int(x: Column) -> Column:
    """The longest integer a text begins with, 0 if none, null for null: how the catalogue's SQL reads text as a number."""
    digits = F.nullif(F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1), F.lit(""))
    return F.when(x.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(0)))


def like(x: Column, pattern: str) -> Column:
    """LIKE without regard to case; the user's % and _ are wildcards, a backslash is itself."""
    return x.ilike(pattern.replace("\\", "\\\\"))


def begins(x: Column, key: str) -> Column:
    """An upper-case column begins with an upper-case key, as LIKE has it. A key without wildcards reaches the scan as a range."""
    return like(x, f"{key}%") if "%" in key or "_" in key else x.startswith(key)


def contains_code(file_name: Column, code: Column) -> Column:
    """A file name holds the code, whatever the separators; codes of under four characters never match."""
    stem = F.regexp_replace(F.upper(F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")), "_[FTZX]_", "_")
    return (F.length(compact_key(code)) >= 4) & compact_key(stem).contains(compact_key(code))


def clean_company(x: Column) -> Column:
    """A company name without the punctuation that trails it."""
    return F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"(?U)[。，,;；.·\s]+$", "")


def cell_text(x: Column) -> Column:
    """A cell's number as text: whole numbers without a fraction; null as empty."""
    return F.when(x.isNull(), "").when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def name_variants(file_name: Column, code: Column) -> Column:
    """File names under which a document may lie: without slashes or spaces, in capitals, by its compact code; all end in .pdf."""
    base = F.regexp_extract(F.replace(file_name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    dense = F.regexp_replace(base, f"{SPACE}+", "")
    every = F.array(base, dense, collapse(base), F.upper(dense), F.when(F.length(compact_key(code)) >= 4, compact_key(code)).otherwise(""))
    named = F.transform(F.filter(F.transform(every, strip), lambda v: v != ""), lambda v: F.when(F.lower(v).endswith(".pdf"), v).otherwise(F.concat(v, F.lit(".pdf"))))
    return F.array_distinct(named)
