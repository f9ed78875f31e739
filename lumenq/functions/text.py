"""Text functions from Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip and \s mean by white space.
SPACES = r"[\s\x1c-\x1f\x85]"
PUNCTUATION = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)^{SPACES}+|{SPACES}+$", "")


def normalize_text(x: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.regexp_replace(strip(x.cast("string")), rf"(?U){SPACES}+", " ")


def normalize_key(x: Column) -> Column:
    """Normalised, lower case, without punctuation at the edges."""
    return F.regexp_replace(F.lower(normalize_text(x)), rf"^[ {PUNCTUATION}]+|[ {PUNCTUATION}]+$", "")


def parse_text_response(x: Column) -> Column:
    """The first of text, content, response, answer of a JSON object; other text as it is."""
    found = F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in ("text", "content", "response", "answer")])
    return normalize_text(F.when(x.rlike(r"^\s*\{"), F.coalesce(found, x)).otherwise(x))


def normalize_aliases(x: Column) -> Column:
    """Aliases normalised, blank and null ones dropped; null gives an empty array."""
    return F.coalesce(F.filter(F.transform(x, normalize_text), lambda a: a.isNotNull() & (a != "")), F.array().cast("array<string>"))


def single_alias(x: Column) -> Column:
    """A lone string as an alias list."""
    return normalize_aliases(F.when(x.isNotNull(), F.array(x)))


def boxed_content(x: Column) -> Column:
    r"""What the last \boxed{ holds up to its matching brace; null if there is none or it never closes."""
    parts = F.split(x, r"\\boxed\{", -1)
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))

    def take(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.when(s["depth"] == 0, s).otherwise(F.struct(depth.alias("depth"), F.when(depth == 0, s["out"]).otherwise(F.concat(s["out"], c)).alias("out")))

    end = F.aggregate(F.split(F.element_at(parts, -1), ""), start, take)
    return F.when((F.size(parts) > 1) & (end["depth"] == 0), strip(end["out"]))


def parse_math_response(x: Column) -> Column:
    """The tail after the first ####, else boxed content, else the last line that is not blank; label and dots removed."""
    text = strip(x)
    marked = F.when(text.contains("####"), strip(F.regexp_extract(text, r"(?s)####(.*)$", 1)))
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda line: line != "")
    found = F.coalesce(marked, boxed_content(text), F.try_element_at(lines, F.lit(-1)), text)
    return F.regexp_replace(strip(F.regexp_replace(found, r"(?i)^(?:answer|final answer)\s*:\s*", "")), r"^\.+|\.+$", "")


def extract_last_number(x: Column) -> Column:
    """The last number of the parsed response, without thousands commas; empty if none."""
    numbers = F.regexp_extract_all(F.replace(parse_math_response(x), F.lit(","), F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.when(x.isNotNull(), F.lit("")))


def marked_number(x: Column) -> Column:
    """The first number of the last #### line, without commas; empty if none."""
    lines = F.regexp_extract_all(x, F.lit(r"####\s*([^\r\n]*)"), F.lit(1))
    return F.when(x.isNotNull(), F.regexp_extract(F.replace(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), F.lit(","), F.lit("")), NUMBER, 0))


def judge_score(x: Column) -> Column:
    """True or false from the first 0 or 1 that no digit touches; null if there is none."""
    found = F.regexp_extract(F.coalesce(x, F.lit("")), r"(?<![0-9])([01])(?![0-9])", 1)
    return F.when(found != "", found == "1")


def is_valid_text(x: Column) -> Column:
    return x.isNotNull() & (x != "") & (x != "None")


def fixed(x: Column, places: int) -> Column:
    """x with a fixed number of decimals, rounded by its exact binary value, as printf and Python do.

    The product with the power of ten is split into its rounded value and its exact error, which decides near a half.
    """
    scale = 10.0**places
    v = F.abs(x.cast("double"))
    c = v * 134217729.0
    high = c - (c - v)
    p = v * scale
    error = (high * scale - p) + (v - high) * scale
    k = F.floor(p).cast("double")
    over = (p - (k + 0.5)) + error
    whole = F.when(over > 0, k + 1).when(over < 0, k).otherwise(k + k % 2)
    digits = F.format_string(f"%.{places}f", whole / scale)
    return F.when((x < 0) & (whole > 0), F.concat(F.lit("-"), digits)).otherwise(digits)


def format_mean_std(mean: Column, std: Column) -> Column:
    """0.123 (0.045), or the mean alone; null without a mean."""
    return F.when(mean.isNotNull(), F.when(std.isNotNull(), F.concat(fixed(mean, 3), F.lit(" ("), fixed(std, 3), F.lit(")"))).otherwise(fixed(mean, 3)))


def performance_fill(value: Column, low: Column, high: Column) -> Column:
    """RGB between light red and light green by where value lies from low to high; a flat range is green."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(high > low, F.try_divide(value - low, high - low)).otherwise(F.lit(1.0))))
    # fixed values: the two ends of the scale
    channel = lambda a, b: F.lpad(F.hex(F.bround(F.lit(a) + (b - a) * ratio, 0).cast("bigint")), 2, "0")
    return F.concat(channel(244, 217), channel(204, 234), channel(204, 211))


def normalize_answer(x: Column) -> Column:
    """Lower case without articles, punctuation and underscores, white space folded."""
    plain = F.regexp_replace(F.lower(F.replace(x, F.lit("_"), F.lit(" "))), rf"[{PUNCTUATION}‘’´`]", " ")
    return normalize_text(F.regexp_replace(plain, r"\b(a|an|the)\b", " "))


def short_answer(x: Column) -> Column:
    """The first line, without a leading "answer is" phrase and a trailing ".0"."""
    line = F.try_element_at(F.filter(F.transform(F.split(strip(x), "\n"), strip), lambda s: s != ""), F.lit(1))
    cut = F.regexp_replace(line, r"(?i)^(?:the\s+)?(?:final\s+)?answer\s*(?:is|:)\s*:?\s*", "")
    return F.regexp_replace(F.regexp_replace(strip(cut), r"\.+$", ""), r"^(-?[0-9]+)\.0+$", "$1")


def parse_response(x: Column) -> Column:
    """The number after the last mark, else the last number of the text, else an empty text; without a trailing ".0"."""
    number = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
    marked = F.try_element_at(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(rf"####\s*({number})"), F.lit(1)), F.lit(-1))
    last = F.try_element_at(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(rf"({number})"), F.lit(1)), F.lit(-1))
    found = F.replace(F.coalesce(marked, last, F.lit("")), F.lit(","), F.lit(""))
    return F.regexp_replace(found, r"^(-?[0-9]+)\.0+$", "$1")
