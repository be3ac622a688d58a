"""Column functions on strings: keys, languages, skeletons, n-grams, hashes and check digits. All stay in the JVM but sequence_ratio."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of languages; * stands for all.
LANGUAGES = {
    "*": "*", "all": "*", "any": "*", "eng": "en", "english": "en", "spa": "es", "spanish": "es", "swe": "sv", "swedish": "sv", "deu": "de", "ger": "de", "german": "de",
    "ita": "it", "italian": "it", "fra": "fr", "fre": "fr", "france": "fr", "french": "fr", "nld": "nl", "dut": "nl", "dutch": "nl",
}


def strip(x: Column) -> Column:
    """Without white space around, Unicode white space too."""
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def label_key(x: Column) -> Column:
    """Runs of blanks, hyphens, dots and slashes made one _, none around, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(x), r"[\s\-./]+", "_"), "^_+|_+$", ""))


def taxonomy_name(x: Column) -> Column:
    return F.upper(label_key(x))


def closed_aliases(aliases: dict[str, str]) -> dict[str, str]:
    """Every alias with the end of its chain; a cycle ends where it is entered."""
    out = {}
    for start in aliases:
        seen, at = {start}, start
        while at in aliases and aliases[at] not in seen:
            at = aliases[at]
            seen.add(at)
        out[start] = at
    return out


def mapped(x: Column, values: dict[str, str]) -> Column:
    """values[x], else x."""
    if not values:
        return x
    pairs = F.create_map(*[F.lit(v) for kv in values.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, x), x)


def canonical_label(x: Column, aliases: dict[str, str]) -> Column:
    return mapped(taxonomy_name(x), closed_aliases({k.upper(): v.upper() for k, v in aliases.items()}))


def language(x: Column) -> Column:
    """Lower case, _ as -, the part before the first -, spellings replaced; null where blank."""
    short = F.element_at(F.split(F.regexp_replace(F.lower(strip(x)), "_", "-"), "-"), 1)
    return F.nullif(mapped(short, LANGUAGES), F.lit(""))


def filled(x: Column) -> Column:
    """Whether there is anything but white space."""
    return F.coalesce(F.length(strip(x)) > 0, F.lit(False))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def markdown_cell(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\|", r"\\|"), r"[\r\n]+", " ")


def skeleton(x: Column) -> Column:
    """Placeholders <<A>>, [[A]], {{A}} and {A} made one token, lower case, white space collapsed."""
    for form in (r"<<[^<>]+>>", r"\[\[[^\[\]]+\]\]", r"\{\{[^{}]+\}\}", r"(?<!\{)\{[^{}]+\}(?!\})"):
        x = F.regexp_replace(x, form, "<placeholder>")
    return strip(F.regexp_replace(F.lower(x), r"\s+", " "))


def blank_spans(text: Column, spans: Column) -> Column:
    """Text with the spans (span_start, span_end) made <placeholder>, the last first; spans outside of it or within one already replaced are left."""
    ordered = F.array_sort(spans, lambda a, b: F.coalesce(b["span_start"], F.lit(-1)) - F.coalesce(a["span_start"], F.lit(-1)))

    def step(acc: Column, s: Column) -> Column:
        fits = (s["span_start"] >= 0) & (s["span_end"] > s["span_start"]) & (s["span_end"] <= acc["low"])
        put = F.concat(F.substring(acc["t"], F.lit(1), s["span_start"]), F.lit("<placeholder>"), F.substring(acc["t"], s["span_end"] + 1, F.length(acc["t"])))
        return F.when(F.coalesce(fits, F.lit(False)), F.struct(put.alias("t"), s["span_start"].alias("low"))).otherwise(acc)

    return F.aggregate(F.coalesce(ordered, F.array()), F.struct(text.alias("t"), F.length(text).alias("low")), step)["t"]


def token_trigrams(x: Column) -> Column:
    """Distinct runs of three tokens [a-z0-9]+ of the skeleton of a text, without its placeholders."""
    tokens = F.regexp_extract_all(F.regexp_replace(skeleton(x), "<placeholder>", " "), F.lit("([a-z0-9]+)"), F.lit(1))
    last = F.size(tokens) - 2
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(tokens, i, F.lit(3)))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of distinct elements in common; 1 for two empty arrays."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity without the junk heuristic."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def stable_seed(*parts: Column) -> Column:
    """First eight bytes of the SHA-256 of the parts, each followed by a zero byte, as an unsigned number."""
    joined = F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\0"))])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def digits(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit("([0-9])"), F.lit(1)), lambda d: d.cast("int"))


def luhn_valid(x: Column) -> Column:
    """Whether the digits of x end in their Luhn check digit; false without digits."""
    d = F.reverse(digits(x))
    total = F.aggregate(F.transform(d, lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2))), F.lit(0), lambda a, v: a + v)
    return F.coalesce((F.size(d) > 0) & (total % 10 == 0), F.lit(False))


def luhn_check_digit(prefix: Column) -> Column:
    d = F.reverse(digits(prefix))
    total = F.aggregate(F.transform(d, lambda v, i: F.when(i % 2 == 1, v).otherwise(F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2))), F.lit(0), lambda a, v: a + v)
    return (10 - total % 10) % 10


def routing_valid(x: Column) -> Column:
    """Whether x is nine digits whose sum weighted 3, 7, 1 is a multiple of ten."""
    d = digits(x)
    weight = F.array(*[F.lit(w) for w in (3, 7, 1) * 3])
    total = F.aggregate(F.zip_with(d, weight, lambda a, b: a * b), F.lit(0), lambda a, v: a + v)
    return F.coalesce(x.rlike("^[0-9]{9}$") & (total % 10 == 0), F.lit(False))


def mod97(x: Column) -> Column:
    """Remainder of a number of any length, letters counted as A = 10 to Z = 35."""
    chars = F.regexp_extract_all(F.upper(x), F.lit("([0-9A-Z])"), F.lit(1))

    def step(a: Column, c: Column) -> Column:
        number = c.try_cast("int")
        return F.when(number.isNotNull(), (a * 10 + number) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars, F.lit(0), step)


def iban_valid(x: Column) -> Column:
    bare = F.regexp_replace(F.upper(x), r"\s", "")
    return F.coalesce(bare.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$") & (mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1), F.lit(False))
