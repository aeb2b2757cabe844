"""Text expressions: all are Catalyst expressions, but for the few functions that have no built-in form."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing value, by profile.
MISSING = {
    "record": ("", "na", "n/a", "none", "null", "nan", "missing", "unknown", "not applicable", "not available", "not collected", "not provided", "unspecified", "-"),
    "answer": ("", "na", "n/a", "none", "unknown"),
    "empty": ("",),
}


def is_missing(value: Column, profile: str = "record") -> Column:
    """Null, or trimmed and lower-cased one of the profile's words."""
    return value.isNull() | F.lower(F.trim(value)).isin(*MISSING[profile])


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_text(text: Column, keywords: bool = False) -> Column:
    """Trimmed; for keywords without outer braces (both must be there), commas as spaces, white space squeezed."""
    out = F.trim(text)
    if not keywords:
        return out
    bare = F.when(out.startswith("{") & out.endswith("}"), F.substring(out, F.lit(2), F.char_length(out) - 2)).otherwise(out)
    return squeeze(F.replace(bare, F.lit(","), F.lit(" ")))


def brace_keywords(text: Column) -> Column:
    """``{a, b}`` to a list of trimmed, lower-cased keywords."""
    bare = F.regexp_replace(F.trim(text), r"^\{|\}$", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def slugify(text: Column, default: str = "group") -> Column:
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s_-]", ""), r"[\s_-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def sanitise(text: Column, runs: bool = True) -> Column:
    """Characters outside letters, digits, dot, underscore and hyphen become hyphens, each run or each one."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]" + ("+" if runs else ""), "-")


def lenient_match(a: Column, b: Column, null_is_text: bool = False) -> Column:
    """One contains the other, case and outer spaces aside. With ``null_is_text`` a null reads as "nan" and may match."""
    def fold(c: Column) -> Column:
        return F.lower(F.trim(F.coalesce(c, F.lit("nan" if null_is_text else ""))))

    x, y = fold(a), fold(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))


def token_set(text: Column, longer_than: int = 2) -> Column:
    return F.array_distinct(F.filter(F.transform(tokens(text), F.lower), lambda t: F.char_length(t) > longer_than))


def canonical(word: Column, synonyms: dict[str, str]) -> Column:
    """Synonyms folded, then one trailing s dropped."""
    folded = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in synonyms.items() for x in kv)), word), word) if synonyms else word
    return F.regexp_replace(folded, "s$", "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def annotated(value: Column) -> tuple[Column, Column, Column]:
    """``label [PREFIX:id]`` to label, id and prefix (upper case); nulls where there is no code."""
    found = r"^(.*?)\s*\[([A-Za-z]+)[:_](\d+)\]"
    prefix = F.nullif(F.upper(F.regexp_extract(value, found, 2)), F.lit(""))
    return F.nullif(F.regexp_extract(value, found, 1), F.lit("")), F.concat(prefix, F.lit(":"), F.regexp_extract(value, found, 3)), prefix


def split_values(value: Column) -> Column:
    """Split at semicolons where there are any, else at double bars; trimmed, empty ones dropped."""
    parts = F.when(F.contains(value, F.lit(";")), F.split(value, ";")).otherwise(F.split(value, r"\|\|"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def term_text(label: Column, synonyms: Column) -> Column:
    return F.concat(label, F.lit("; "), F.array_join(synonyms, "; "))


def place_names(text: Column) -> Column:
    """Literal replacements in this order, so that USA becomes United StatesA."""
    for old, new in ((":", " "), ("US", "United States"), ("USA", "United States of America"), ("Viet Nam", "Vietnam"), ("Czech Republic", "Czechia")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def location_matches(place: Column, location: Column) -> Column:
    """Any separated part of ``place`` occurs in ``location``; an empty part always does."""
    return F.exists(F.split(F.lower(place), r"[,\-\s:]\s*"), lambda t: F.contains(F.lower(location), t))


def key_values(text: Column, between: str = ";", sign: str = "=") -> Column:
    """``k=v`` parts to a map; the last value of a key wins."""
    pairs = F.filter(F.transform(F.split(text, between), lambda x: F.trim(x)), lambda p: F.contains(p, F.lit(sign)))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.split_part(p, F.lit(sign), F.lit(1))).alias("k"), F.trim(F.substring(p, F.instr(p, sign) + 1, F.char_length(p))).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["k"] == e["k"]))
    return F.map_from_entries(last)


def normalise_key(key: Column) -> Column:
    """Lower case, brackets and sample or experiment prefixes dropped, other signs as one underscore."""
    low = F.lower(key)
    out = F.regexp_replace(F.regexp_replace(low, r"\([^)]*\)", ""), "^(sample|experiment)_", "")
    out = F.trim(F.regexp_replace(out, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(out, F.lit("")), low)


def inline_answer(line: Column) -> Column:
    """Fields of ``ID__class__place__{keywords}__sub`` lines, between two to four underscores; null without an id."""
    return F.when(F.regexp_like(line, F.lit(r"^(ERS|SRS|DRS)\d+_{2,4}")), F.split(line, "_{2,4}"))


def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity, case aside; no built-in computes it."""
    return F.pandas_udf(_ratio, "double")(F.lower(a), F.lower(b))


def _folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def fold_accents(text: Column) -> Column:
    """NFKD without combining marks, then lower case, bars and underscores as spaces, other signs dropped."""
    out = F.lower(F.pandas_udf(_folded, "string")(text))
    return squeeze(F.regexp_replace(F.regexp_replace(out, r"[_/|]+", " "), "[^a-z0-9 -]", ""))


def part_fields(line: Column, sign: str = "___", least: int = 5) -> Column:
    """Fields of a line between ``sign``, white space squeezed; the first one's last word is the id. Null with too few."""
    parts = F.transform(F.split(line, sign), squeeze)
    return F.when(F.size(parts) >= least, F.concat(F.array(F.element_at(F.split(parts[0], " "), -1)), F.slice(parts, 2, 1 << 20)))


def folded(value: Column) -> Column:
    """Null as the empty string; trimmed and lower-cased."""
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def has_number(number: Column, text: Column) -> Column:
    """The number stands in the text, not as a part of a longer number or decimal."""
    return F.array_contains(numbers(text), number)


#: Kinds of likeness, the first that holds.
VARIANTS = ("same", "reordered", "same_set", "near_spelling", "shares_a_word", "different")


def variant_kind(a: Column, b: Column, near: float = 0.8) -> Column:
    """Why two strings are alike: equal when folded to words, the same words in another order, the same set of words, nearly
    the same spelling, a common word, or nothing of that.
    """
    x, y = (F.transform(tokens(c), F.lower) for c in (a, b))
    spelled = levenshtein_similarity(F.array_join(x, " "), F.array_join(y, " ")) >= near
    return (
        F.when(x == y, VARIANTS[0])
        .when(F.array_sort(x) == F.array_sort(y), VARIANTS[1])
        .when(F.array_sort(F.array_distinct(x)) == F.array_sort(F.array_distinct(y)), VARIANTS[2])
        .when(spelled, VARIANTS[3])
        .when(F.size(F.array_intersect(x, y)) > 0, VARIANTS[4])
        .otherwise(VARIANTS[5])
    )


def plain_quotes(text: Column) -> Column:
    """Lower case, typographic apostrophes as plain ones."""
    return F.translate(F.lower(text), "‘’ʼ", "'''")


def hyphenated_tokens(text: Column, stop: tuple[str, ...] = (), longer_than: int = 1) -> Column:
    """Lower-cased words of letters that hyphens may join, without stop words and short ones."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+(?:-[a-z]+)*)"), F.lit(1))
    return F.filter(found, lambda t: (F.char_length(t) > longer_than) & ~t.isin(*stop)) if stop else F.filter(found, lambda t: F.char_length(t) > longer_than)


def without_punctuation(text: Column) -> Column:
    """Lower case, everything but letters, digits, underscores and white space dropped, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", ""))


def without_markup(text: Column) -> Column:
    """Addresses, tags and punctuation as spaces, then squeezed and lower-cased."""
    out = F.regexp_replace(F.regexp_replace(text, r"https?://\S+|www\.\S+", " "), r"<[^>]*>", " ")
    return squeeze(F.lower(F.regexp_replace(out, r"[^A-Za-z0-9\s]", " ")))


#: English contractions, in the order in which they are replaced.
CONTRACTIONS = (("won't", "will not"), ("can't", "can not"), ("n't", " not"), ("'re", " are"), ("'s", " is"), ("'d", " would"), ("'ll", " will"), ("'t", " not"), ("'ve", " have"), ("'m", " am"))


def expanded(text: Column) -> Column:
    """Contractions spelled out."""
    for short, long in CONTRACTIONS:
        text = F.replace(text, F.lit(short), F.lit(long))
    return text


def phrase_match(phrase: Column, text: Column) -> Column:
    """full: the phrase stands in the text between word boundaries; any: one of its words does; else none."""
    words, all_words = (F.array_join(F.transform(tokens(c), F.lower), " ") for c in (phrase, text))
    full = F.contains(F.concat(F.lit(" "), all_words, F.lit(" ")), F.concat(F.lit(" "), words, F.lit(" ")))
    return F.when((words != "") & full, "full").when(F.arrays_overlap(F.split(words, " "), F.split(all_words, " ")) & (words != ""), "any").otherwise("none")


def dois(text: Column) -> Column:
    """All ``doi:`` references, case aside, up to white space and without signs at their end."""
    return F.regexp_extract_all(text, F.lit(r"(?i)\b(doi:[^\s]+)\b"), F.lit(1))


def literature_ids(text: Column, kind: str) -> Column:
    """Digits of PMID or PMC references, distinct, in order."""
    sign = {"pmid": r"(?i)\bpmid:?\s*(\d+)", "pmcid": r"(?i)\bpmc(?:id)?:?\s*(\d+)"}[kind]
    return F.array_distinct(F.regexp_extract_all(text, F.lit(sign), F.lit(1)))


def project_ids(text: Column) -> Column:
    """Bioproject ids, distinct; ones given as digits alone get the prefix PRJNA."""
    full = F.regexp_extract_all(F.upper(text), F.lit(r"\b(PRJ[EDN][A-Z]\d+)\b"), F.lit(1))
    bare = F.regexp_extract_all(F.upper(text), F.lit(r"BIOPROJECT[:=\s]+(\d+)\b"), F.lit(1))
    return F.array_distinct(F.concat(full, F.transform(bare, lambda d: F.concat(F.lit("PRJNA"), d))))


def without_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]", "")


def without_digit_tokens(text: Column) -> Column:
    """Words between spaces that have no digit."""
    return F.array_join(F.filter(F.split(text, " "), lambda t: ~t.rlike("[0-9]")), " ")


def token_ngrams(words: Column, n: int) -> Column:
    """All n consecutive elements of a column, joined by spaces."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))


def swapped_words(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Each word of a pair becomes the other one: the same call gives the text back."""
    other = F.create_map(*(F.lit(x) for a, b in pairs for x in (a, b, b, a)))
    return F.array_join(F.transform(F.split(text, " "), lambda t: F.coalesce(F.try_element_at(other, t), t)), " ")


#: The texts of a term that are compared.
TERM_TEXTS = ("label", "label_synonyms", "label_definition", "label_parents", "label_synonyms_definition", "all")


def term_texts(label: Column, synonyms: Column, definition: Column, parents: Column) -> Column:
    """Six texts of a term as a map, parts joined by bars; empty parts are left out."""
    syn, par = F.array_join(synonyms, "; "), F.array_join(parents, "; ")
    kinds = ((label,), (label, syn), (label, definition), (label, par), (label, syn, definition), (label, syn, definition, par))
    joined = [F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in k)) for k in kinds]
    return F.map_from_arrays(F.array(*map(F.lit, TERM_TEXTS)), F.array(*joined))


def whitelisted(pairs: Column, keys: tuple[str, ...]) -> Column:
    """Values of some keys of a map, in the keys' order, joined."""
    return F.concat_ws("; ", *(F.try_element_at(pairs, F.lit(k)) for k in keys))
