"""Scalar functions over text, as Column expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as web browsers define it (Java's \s knows only the ASCII part), amounts, labels of totals.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MONEY = r"^\$[\t\n\x0B\f\r ]?-?[0-9,]+\.[0-9]{2}$"
BARE_MONEY = r"^-?[0-9,]+\.[0-9]{2}$"
TOTAL_LABEL = r"(?i)\b(total|amount due|balance|subtotal|grand total)\b"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def money(c: Column) -> Column:
    """An amount such as $1,234.50 or 1,234.50 as a decimal; null for anything else."""
    return F.when(c.rlike(MONEY) | c.rlike(BARE_MONEY), F.regexp_replace(c, r"[$,\s]", "").try_cast("decimal(18,2)"))


def money_text(c: Column) -> Column:
    return F.format_string("$%.2f", c.cast("double"))


def chrome_key(c: Column) -> Column:
    """What a header or footer line has in common from page to page: numbers become #, 80 characters at most."""
    return F.substring(F.regexp_replace(c, "[0-9]+", "#"), 1, 80)


def prefix_key(c: Column) -> Column:
    """The first three words of a longer line, if they have ten characters or more, else an empty text."""
    words = F.split(collapsed(F.regexp_replace(c, "[0-9]+", "#")), " ")
    first = F.array_join(F.slice(words, 1, 3), " ")
    return F.when((F.size(words) > 3) & (F.length(first) >= 10), first).otherwise("")


def folio(c: Column, pages: Column | None = None) -> Column:
    """A page number that stands alone, in brackets or dashes perhaps: of four digits at most, in a document of 1,000 `pages` or more of one digit more than their number has."""
    digits = F.regexp_extract(c, r"^[\s\[(–—-]*([0-9]{1,9})[\s\])–—-]*$", 1)
    most = F.lit(4) if pages is None else F.greatest(F.lit(4), F.length(pages.cast("string")) + 1)
    return F.when((digits != "") & (F.length(digits) <= most), digits).cast("int")


def heading_key(c: Column) -> Column:
    return F.lower(collapsed(c))


def yaml_scalar(c: Column) -> Column:
    """A text as a YAML scalar: plain where that is safe, else in double quotes."""
    flat = F.trim(F.regexp_replace(c, r"\r?\n", " "))
    plain = flat.rlike(r"^[0-9A-Za-z_][0-9A-Za-z_ .,:/@+-]*$") & ~flat.contains(": ")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(flat, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(plain, flat).otherwise(quoted)


def csv_cell(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a 0-based column: A ... Z, AA ... ZZ, AAA ...; as many as an index has, seven for the largest."""
    letter = lambda n: F.chr(((n - 1) % 26 + 65).cast("long"))
    n, out = index.cast("long") + 1, F.lit("")
    for _ in range(7):
        out = F.concat(F.when(n > 0, letter(n)).otherwise(""), out)
        n = F.floor((n - 1) / 26)
    return F.when(index.isNotNull(), out)


def is_date_format(code: Column) -> Column:
    """Whether a spreadsheet's format code holds a part of a date or time outside quotes, escapes and brackets."""
    return F.regexp_replace(code, r'"[^"]*"|\\.|\[[^\]]*\]', "").rlike("(?i)[ymdhs]")


def trimmed_number(n: Column) -> Column:
    """A double with twelve significant digits and no trailing zeros; -0 is 0."""
    digits = F.floor(F.log10(F.abs(n))).cast("int")
    text = F.format_number(F.abs(n), 11)
    plain = F.regexp_replace(F.regexp_replace(F.round(n.cast("decimal(38,18)"), 11).cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(n == 0, "0").when(digits.between(-1, 11) & text.isNotNull(), plain).otherwise(F.regexp_replace(F.format_string("%.11e", n), r"\.?0*e", "e"))


def column_number(ref: Column) -> Column:
    """0-based column of a cell reference such as AB12; 0 without letters."""
    letters = F.regexp_extract(ref, "^([A-Z]+)", 1)
    n = F.aggregate(F.split(letters, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))
    return F.greatest(n - 1, F.lit(0))


def serial_date(serial: Column, date1904: bool = False, code: Column | None = None) -> Column:
    """Spreadsheet serial as yyyy-MM-dd, HH:mm:ss or both, as the format code says; without one the date, with the time where it has one."""
    epoch = -2082844800000 if date1904 else -2209161600000
    at = F.timestamp_millis((F.lit(epoch) + F.floor(serial * 86400000 + 0.5)).cast("long"))
    code = F.regexp_replace(F.coalesce(code, F.lit("")), '"[^"]*"', "") if code is not None else F.lit("")
    date, time = (code == "") | code.rlike("(?i)[ymd]"), code.rlike("(?i)[hs]") | (serial % 1 != 0)
    return F.when(date & time, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(time, F.date_format(at, "HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def pdf_date(raw: Column) -> Column:
    """D:YYYYMMDDhhmmss... as an ISO time; parts that are missing count as the first; null without a year."""
    pattern = r"^D:([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?"
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(raw, pattern, i), F.lit("")), F.lit(default))
    iso = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), F.lit("Z"))
    return F.when(raw.rlike(r"^D:[0-9]{4}"), iso)


def tokens_estimate(characters: Column) -> Column:
    return F.floor(characters / 4.0 + 0.5).cast("long")


def brackets_balanced(c: Column) -> Column:
    """Whether ( ) and [ ] each close what they open, in order."""
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("s"), F.lit(True).alias("ok"))

    def step(a, x):
        r = a["r"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)
        s = a["s"] + F.when(x == "[", 1).when(x == "]", -1).otherwise(0)
        return F.struct(r.alias("r"), s.alias("s"), (a["ok"] & (r >= 0) & (s >= 0)).alias("ok"))

    return F.aggregate(F.split(F.regexp_replace(c, r"[^()\[\]]", ""), ""), start, step, lambda a: a["ok"] & (a["r"] == 0) & (a["s"] == 0))


def dictionary_candidate(token: Column, sentence_initial: Column) -> Column:
    """Whether a dictionary can judge a token: letters only, four or more, not all capitals, no inner capital, a vowel, and a capital only at a sentence's start."""
    return token.rlike("^[A-Za-z][a-z]{3,}$") & token.rlike("(?i)[aeiouy]") & (token.rlike("^[a-z]") | sentence_initial)


def longest_tick_run(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))


def cue_clock(time: Column) -> Column:
    """A cue's time (mm:ss or hh:mm:ss, with a fraction) as hh:mm:ss."""
    parts = F.split(F.regexp_replace(time, "[.,][0-9]+$", ""), ":")
    three = F.when(F.size(parts) == 2, F.concat(F.array(F.lit("00")), parts)).otherwise(parts)
    return F.array_join(F.transform(three, lambda p: F.lpad(p, 2, "0")), ":")


def clock_seconds(clock: Column) -> Column:
    return F.aggregate(F.split(clock, ":"), F.lit(0), lambda a, p: a * 60 + p.cast("int"))


def without_tags(c: Column) -> Column:
    """Text of a cue without tags and style overrides."""
    return F.regexp_replace(F.regexp_replace(c, r"\{\\[^}]*\}", ""), "<[^>]+>", "")


def without_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1B?\[[0-9;]*m", "")


def resolved_part(base: Column, target: Column) -> Column:
    """Path of a part that a part at `base` names: .. goes up, a leading / starts at the root."""
    start = F.when(target.startswith("/"), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(base, "[^/]*$", ""), "/"))
    step = lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(p.isin("", "."), a).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(F.concat(start, F.split(target, "/")), F.array().cast("array<string>"), step), "/")


def safe_file_name(c: Column) -> Column:
    """A file name without what file systems refuse."""
    name = F.btrim(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1F]+', "-"), r"\s+", " "), F.lit(" ."))
    return F.when(name == "", "document").otherwise(name)


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def data_url_bytes(url: Column) -> Column:
    """Content of a data URL; null for anything else or content that can't be decoded."""
    body = F.regexp_extract(url, r"(?s)^data:[^,]*,(.*)$", 1)
    return F.when(url.rlike(r"(?s)^data:[^,]*;base64,"), F.try_to_binary(body, F.lit("base64"))).when(url.startswith("data:"), F.try_url_decode(body).cast("binary"))


def data_url_type(url: Column) -> Column:
    return F.when(url.startswith("data:"), F.coalesce(F.nullif(F.regexp_extract(url, "^data:([^;,]+)", 1), F.lit("")), F.lit("application/octet-stream")))


def cell_lines(c: Column) -> Column:
    """Text of a table cell whose line breaks are written as elements: they become "; "."""
    text = F.regexp_replace(collapsed(F.regexp_replace(F.regexp_replace(c, "(?i)<br */?>", " ; "), "<[^>]+>", "")), r"\s*;\s*", "; ")
    return F.trim(F.regexp_replace(text, r"^;\s*|;\s*$", ""))


def clamped(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def fence(code: Column, language: Column) -> Column:
    """Code in a fence longer than any run of backticks in it."""
    ticks = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_tick_run(code) + 1))
    return F.concat(ticks, language, F.lit("\n"), F.regexp_replace(code, r"\n$", ""), F.lit("\n"), ticks)
