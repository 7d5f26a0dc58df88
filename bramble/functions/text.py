"""Column functions that clean and tokenise text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

END_OF_LINE = "</s>"
LABEL_PREFIX = "__label__"
# Fixed value: the symbols that survive symbol removal are letters, digits, underscore, and the range from space to slash.
SYMBOLS = r"[^a-zA-Z_0-9 -/]+"
PART_CATEGORIES = {"h": "hardware", "o": "operating_system"}


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body names it (also inside loops over arrays)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number(x: Column, places: int = 6) -> Column:
    """A number as text with at most `places` decimals and no trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{places}f", x.cast("double")), r"\.?0+$", "")


def words(text: Column) -> Column:
    """Lower-case tokens between white space, commas dropped."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), ",", ""), r"\s+"), lambda w: w != "")


def tokens_with_end(text: Column) -> Column:
    """Tokens between white space and control separators; each newline gives an end-of-line token."""
    marked = F.regexp_replace(text, "\n", f" {END_OF_LINE} ")
    return F.filter(F.split(marked, "[ \n\r\t\u000b\f\u0000]+"), lambda w: w != "")


def without_symbols(text: Column) -> Column:
    return F.regexp_replace(text, SYMBOLS, "")


def without_quotes(text: Column) -> Column:
    return F.translate(text, "'\",", "")


def identifier_parts(identifier: Column) -> Column:
    """(vendor, product, category, name) of a colon-delimited identifier; an escaped colon does not delimit."""
    parts = F.split(identifier, r"(?<!\\):")
    vendor, product = F.element_at(parts, 4), F.element_at(parts, 5)
    category = F.when(F.element_at(parts, 3) == "h", "hardware").when(F.element_at(parts, 3) == "o", "operating_system").otherwise("application")
    return F.struct(vendor.alias("vendor"), product.alias("product"), category.alias("category"), F.when(vendor == product, vendor).otherwise(F.concat_ws(" ", vendor, product)).alias("name"))


def spaced_punctuation(text: Column) -> Column:
    """Lower case; quotes and . , ( ) ! ? set apart by spaces; semicolons and colons become spaces; spaces squeezed."""
    out = F.regexp_replace(F.lower(text), r"(['\".,()!?])", " $1 ")
    out = F.regexp_replace(out, "[;:]", " ")
    return F.trim(F.regexp_replace(out, " +", " "))


def plain_text(text: Column) -> Column:
    """Like spaced_punctuation, with typographic quotes made plain, digits to spaces, and = * | and guillemets dropped."""
    out = F.translate(text, "’‘`´“”„", "''''\"\"\"")
    out = F.regexp_replace(out, "[0-9]", " ")
    return spaced_punctuation(F.regexp_replace(out, "[=*|«»]", " "))


def markup_to_text(markup: Column) -> Column:
    """Markup with tags, comments, character references and template calls dropped and links reduced to their anchor;
    digits spelled out; what is left is lower-case a-z words parted by one space."""
    out = F.regexp_replace(markup, r"(?s)<!--.*?-->|<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\{\{[^}]*\}\}|<[^>]*>|&[#\w]+;", " ")
    out = F.lower(out)
    for digit, name in enumerate("zero one two three four five six seven eight nine".split()):
        out = F.regexp_replace(out, str(digit), f" {name} ")
    return F.trim(F.regexp_replace(out, "[^a-z]+", " "))


def is_redirect(markup: Column) -> Column:
    """Whether a page only points at another one."""
    return F.coalesce(F.lower(markup).contains("#redirect"), F.lit(False))


def markup_to_lines(markup: Column) -> Column:
    """The variant that keeps digits and other scripts: an array of lines, tags, comments, references and template calls
    dropped, links reduced to their anchor, lower case, white space runs made one space, lines of one token left out."""
    out = F.regexp_replace(markup, r"(?s)<!--.*?-->|<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    out = F.lower(F.regexp_replace(out, r"\{\{[^}]*\}\}|<[^>]*>|&[#\w]+;", " "))
    lines = F.transform(F.split(out, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    return F.filter(lines, lambda x: x.contains(" "))


def first_words(text: Column, n: int, empty: str = "filling empty") -> Column:
    """The first n tokens; a text without tokens becomes `empty`."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.when(F.size(found) == 0, empty).otherwise(F.array_join(F.slice(found, 1, n), " "))


def word_ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of an array of words, words joined by a space; none if there are fewer than n."""
    return let(tokens, lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))))


def windows(tokens: Column, width: int) -> Column:
    """All runs of `width` consecutive tokens; one window if there are no more tokens than that, none without tokens."""
    last = lambda w: F.greatest(F.lit(1), F.size(w) - width + 1)
    return let(tokens, lambda w: F.when(F.size(w) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), last(w)), lambda i: F.slice(w, i, F.lit(width)))))


def char_ngrams(word: Column, least: int, most: int) -> Column:
    """Character n-grams of <word> by code point; a boundary mark alone is left out."""
    def of_length(m: Column, n: int) -> Column:
        return F.when(F.length(m) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(m) - n + 1), lambda i: F.substr(m, i, F.lit(n))))

    grams = let(F.concat(F.lit("<"), word, F.lit(">")), lambda m: F.concat(*[of_length(m, n) for n in range(least, most + 1)]))
    return F.filter(grams, lambda g: ~g.isin("<", ">"))


def label_line(labels: Column, text: Column, prefix: str = LABEL_PREFIX) -> Column:
    """'__label__a __label__b text'; spaces inside labels become underscores."""
    return F.concat_ws(" ", F.array_join(F.transform(labels, lambda x: F.concat(F.lit(prefix), F.replace(F.trim(x), F.lit(" "), F.lit("_")))), " "), text)


def parse_label_line(line: Column, prefix: str = LABEL_PREFIX) -> Column:
    """(labels, words with weights, row weight, tags) of a labelled line: tokens are typed by prefix, `token:w` weighs."""
    tokens = tokens_with_end(line)
    typed = lambda p: F.transform(F.filter(tokens, lambda t: t.startswith(p)), lambda t: F.substr(t, F.lit(len(p) + 1)))
    plain = F.filter(tokens, lambda t: ~t.startswith(prefix) & ~t.startswith("__weight__:") & ~t.startswith("__tag__") & (t != END_OF_LINE))
    split = lambda t: F.struct(F.regexp_extract(t, r"^(.*?)(?::([0-9.]+))?$", 1).alias("word"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, r"^(.*?)(?::([0-9.]+))?$", 2), F.lit("")), F.lit("999999D999999")).cast("double"), F.lit(1.0)).alias("value"))
    return F.struct(typed(prefix).alias("labels"), F.transform(plain, split).alias("words"), F.coalesce(F.get(typed("__weight__:"), F.lit(0)).cast("double"), F.lit(1.0)).alias("weight"), typed("__tag__").alias("tags"))


def parse_list_column(text: Column) -> Column:
    """A stringified list "['a', 'b']" as an array; a comma after a backslash does not split."""
    inner = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, r"(?<!\\),"), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")), lambda x: x != "")


def labels_in_text(text: Column, prefix: str = LABEL_PREFIX) -> Column:
    """(labels, rest) of a text that holds labels anywhere."""
    pattern = rf"(?<!\w){prefix}\S*"
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, pattern, ""), r"\s+", " "))
    return F.struct(F.transform(F.regexp_extract_all(text, F.lit(rf"({pattern})"), F.lit(1)), lambda x: F.replace(x, F.lit(prefix), F.lit(""))).alias("labels"), rest.alias("rest"))
