"""Names, ids, markup and links as Column expressions; pandas only where Spark has no such function."""

from __future__ import annotations

import ipaddress
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that say what a place is but not which one it is.
GENERIC_WORDS = [
    "campsite", "campground", "camp", "camping", "site", "ground", "shelter", "hut", "caravan", "park", "holiday", "rest", "area", "reserve", "trackhead", "trailhead",
    "walk", "in", "group", "the", "kiosk", "closed", "np", "national", "hike", "bushcamp", "canoe", "gow", "gsww",
]
# The words that all say "a place to camp".
CAMP_WORDS = ["campsite", "campground", "camp", "camping", "site", "ground", "bushcamp"]
# Words that tell two places of one name apart.
DISTINGUISHING_WORDS = ["old", "new", "upper", "lower", "north", "south", "east", "west"]
# Abbreviations in names and what they stand for; single letters only at either end of a name.
ABBREVIATIONS = {"mt": "mount", "nth": "north", "sth": "south"}
COMPASS_LETTERS = {"n": "north", "s": "south", "e": "east", "w": "west"}
# What list keepers write before a name, and what may follow one.
NAME_PREFIX = r"^(closed\s*c?\s*-?\s*|c\?\s*|r:\s*|kiosk:\s*)"
NAME_QUALIFIER = r"\s+-\s+.*$"


def _folds() -> tuple[str, str]:
    """The composed letters whose decomposition is a plain Latin letter and accents, and those letters."""
    pairs = []
    for code in range(0xC0, 0x2200):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and all("\u0300" <= c <= "\u036f" for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(text: Column) -> Column:
    """Text whose Latin letters have lost their accents, composed or not."""
    return F.regexp_replace(F.translate(text, *_folds()), r"[\u0300-\u036f]", "")


def _map_of(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def all_tokens(name: Column) -> Column:
    """Words of a name for comparison: accents, case, apostrophes, a list keeper's prefix and a trailing qualifier are
    gone, abbreviations are written out (STR_01). A null name has none."""
    text = F.regexp_replace(F.lower(fold_accents(name)), NAME_PREFIX, "")
    text = F.regexp_replace(text, NAME_QUALIFIER, "")
    text = F.regexp_replace(F.regexp_replace(text, r"\b([a-z])['‘’]\s*", "$1"), r"['‘’]", "")
    words = F.filter(F.split(F.regexp_replace(text, r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    words = F.coalesce(words, F.array().cast("array<string>"))
    n = F.size(words)

    def written_out(word, k):
        beside = F.try_element_at(words, F.when(k == 0, F.lit(2)).otherwise(n - 1))
        alone = ((k == 0) | (k == n - 1)) & ~F.coalesce((n > 1) & (F.length(beside) == 1), F.lit(False))
        return F.coalesce(F.try_element_at(_map_of(ABBREVIATIONS), word), F.when(alone, F.try_element_at(_map_of(COMPASS_LETTERS), word)), word)

    return F.transform(words, written_out)


def without_generic(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(GENERIC_WORDS))


def name_tokens(name: Column, keep_generic: bool = False) -> Column:
    """The words that tell which place a name means, or all of them (STR_01)."""
    return all_tokens(name) if keep_generic else without_generic(all_tokens(name))


def kind_tokens(tokens: Column) -> Column:
    """All words of a name with those for camps folded into one."""
    return F.array_distinct(F.transform(tokens, lambda w: F.when(w.isin(CAMP_WORDS), F.lit("camp")).otherwise(w)))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of an integer."""
    at: dict[str, int] = {}
    for k, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over both lengths (STR_03); 0 if either is null or empty."""
    pairs = zip(a.fillna(""), b.fillna(""))
    return pd.Series([(1.0 if x == y else 2 * _lcs(x, y) / (len(x) + len(y))) if x and y else 0.0 for x, y in pairs], dtype="float64")


def contained_names(all_a: Column, all_b: Column) -> Column:
    """Whether one name's words hold the other's, and more than a single shared word says so (the set part of STR_02)."""
    a, b = without_generic(all_a), without_generic(all_b)
    na, nb, both = F.size(F.array_distinct(a)), F.size(F.array_distinct(b)), F.size(F.array_intersect(a, b))
    leads = (F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(1))) & (F.size(F.array_intersect(kind_tokens(all_a), kind_tokens(all_b))) >= 2)
    return (na > 0) & (nb > 0) & (both == F.least(na, nb)) & ((both >= 2) | (na == nb) | F.coalesce(leads, F.lit(False)))


def set_score(all_a: Column, all_b: Column) -> Column:
    """1 for names that contain one another, else the Jaccard similarity of their words."""
    a, b = without_generic(all_a), without_generic(all_b)
    either = F.size(F.array_union(a, b))
    share = F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).when(contained_names(all_a, all_b), F.lit(1.0)).otherwise(share)


def name_score(all_a: Column, all_b: Column) -> Column:
    """Similarity of two names given as ``all_tokens``: containment, else the better of Jaccard and letters in order (STR_02)."""
    written = lambda t: F.array_join(F.array_sort(F.array_distinct(without_generic(t))), " ")
    sets = set_score(all_a, all_b)
    open_ = sets < 1
    return F.greatest(sets, lcs_ratio(F.when(open_, written(all_a)), F.when(open_, written(all_b))))


def names_distinguished(all_a: Column, all_b: Column) -> Column:
    """Whether a word like "upper" that only one has, or different numbers of both, tell two names apart (STR_04)."""
    marks = lambda t: F.array_sort(F.array_distinct(F.filter(t, lambda w: w.isin(DISTINGUISHING_WORDS))))
    numbers = lambda t: F.array_sort(F.array_distinct(F.filter(t, lambda w: w.rlike(r"^\d+$"))))
    a, b = numbers(all_a), numbers(all_b)
    return (marks(all_a) != marks(all_b)) | ((F.size(a) > 0) & (F.size(b) > 0) & (a != b))


def is_unnamed(name: Column, tokens: Column) -> Column:
    """Whether a name is none, blank or made of generic words alone; one in another script is a name."""
    blank = name.isNull() | (F.trim(name) == "")
    return blank | (~name.rlike(r"[\p{L}&&[^\p{IsLatin}]]") & (F.size(tokens) > 0) & (F.size(without_generic(tokens)) == 0))


def keyword_type(name: Column, rules: list[tuple[str, str]], default: str = "waypoint") -> Column:
    """Type by the first keyword that stands in the name as a word, plurals included (STR_05, STR_06)."""
    out = F.lit(default)
    for word, kind in reversed(rules):
        out = F.when(F.lower(name).rlike(rf"(?<![\p{{L}}\p{{N}}]){word}(?:e?s)?(?![\p{{L}}\p{{N}}])"), kind).otherwise(out)
    return out


def classify_waypoint(
    name: Column, folder: Column, folders: dict[str, str], towns: list[str], prefixes: list[tuple[str, str]], keywords: list[tuple[str, str]], default: str = "waypoint"
) -> Column:
    """Type of a waypoint by the first that says one: its folder, a known town, a prefix that leaves text, a keyword (STR_05)."""
    low = F.lower(F.trim(name))
    out = F.coalesce(F.try_element_at(_map_of(folders), F.lower(F.trim(folder))), F.when(low.isin(towns), "town"))
    for prefix, kind in prefixes:
        rest = F.trim(F.substring(low, len(prefix) + 1, 1_000_000))
        out = F.coalesce(out, F.when(low.startswith(prefix.lower()) & (rest != ""), kind))
    return F.coalesce(out, keyword_type(name, keywords, default))


def clean_prefix(name: Column, prefixes: list[str]) -> Column:
    """Name without the first of the prefixes that leaves any text (STR_07)."""
    out = name
    for prefix in reversed(prefixes):
        rest = F.trim(F.substring(name, len(prefix) + 1, 1_000_000))
        out = F.when(F.lower(name).startswith(prefix.lower()) & (rest != ""), rest).otherwise(out)
    return out


def escape_xml(text: Column) -> Column:
    """(STR_11)"""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_html(text: Column) -> Column:
    """(STR_10)"""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def slug(name: Column, most: int = 60) -> Column:
    """(STR_14)"""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most)


def trail_slug(own_id: Column, name: Column) -> Column:
    """A trail's own id unless a traveller made it, else a slug of its name (STR_14)."""
    return F.when(own_id.isNotNull() & (own_id != "") & ~own_id.startswith("u_"), own_id).otherwise(slug(name))


def poi_key(kind: Column, number: Column) -> Column:
    """(STR_16)"""
    return F.concat_ws("/", kind, number.cast("string"))


def mint_id(trail: Column, kind: Column, lat: Column, lon: Column, length: int = 8) -> Column:
    """A short id from what a waypoint is and where it lies (STR_15)."""
    key = F.concat_ws("|", trail, kind, F.format_string("%.5f", lat), F.format_string("%.5f", lon))
    return F.concat(F.lit("w_"), F.substring(F.sha1(key), 1, length))


def csv_quote(value: Column) -> Column:
    """A CSV cell, quoted where it has to be (SNK03)."""
    text = value.cast("string")
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def safe_http_url(value: Column) -> Column:
    """The URL if it is one of the web, else null (STR_13)."""
    text = F.trim(value)
    return F.when(text.rlike(r"^(?i)https?://[^\s/?#]+(?:[/?#]\S*)?$"), text)


def links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"https?://[^\s]+"), F.lit(0))


_LINK, _EMAIL, _PHONE = r"https?://[^\s,]+", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"\+?\d[\d ()-]{6,}\d"


def split_links(said: Column) -> Column:
    """``(kind, text)`` parts of a text in order: links, addresses, phone numbers and what stands between (STR_08)."""
    mark = "\u0001"
    cut = F.regexp_replace(said, f"({_LINK}|{_EMAIL}|{_PHONE})", f"{mark}$1{mark}")
    kind = lambda t: F.when(t.rlike(f"^{_LINK}$"), "link").when(t.rlike(f"^{_EMAIL}$"), "email").when(t.rlike(f"^{_PHONE}$"), "phone").otherwise("text")
    return F.transform(F.filter(F.split(cut, mark), lambda t: t != ""), lambda t: F.struct(kind(t).alias("kind"), t.alias("text")))


def join_distinct(texts: Column, between: str) -> Column:
    """Texts joined in order, each once; empty ones go (ARR02)."""
    return F.array_join(F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & (F.trim(t) != ""))), between)


def format_age(days: Column) -> Column:
    """(DAT06)"""
    part = lambda n, unit: F.concat(F.floor(days / n).cast("string"), F.lit(unit))
    return F.when(days < 7, part(1, "d")).when(days < 30, part(7, "w")).otherwise(part(30, "mo"))


def monotone_stamp(now_ms: Column, before: Column) -> Column:
    """Now, or a millisecond after the stamp before if that is not earlier; an unreadable one counts for nothing (DAT08)."""
    last = before.try_cast("long")
    return F.when(last.isNull() | (now_ms > last), now_ms).otherwise(last + 1)


def token_state(now: Column, expires: Column, revoked: Column, renew_days: int) -> Column:
    """Whether a token is revoked, expired, to be renewed as its end is near, or valid (DAT10)."""
    left = F.unix_micros(expires) - F.unix_micros(now)
    return F.when(revoked, "revoked").when(left < 0, "expired").when(left < renew_days * 86_400_000_000, "renew").otherwise("valid")


def mostly_links(text: Column) -> Column:
    """Whether URLs make up more than half of what is not white space (STR_21)."""
    urls = F.aggregate(links(text), F.lit(0), lambda n, u: n + F.char_length(u))
    rest = F.char_length(F.regexp_replace(text, r"\s+", ""))
    return F.coalesce(urls / F.nullif(rest, F.lit(0)) > 0.5, F.lit(False))


def target_kind(target: Column) -> Column:
    """What a comment is on, by the shape of the id (STR_19)."""
    osm = target.rlike(r"^(node|way|relation)/[1-9]\d{0,15}$")
    return F.when(target.rlike(r"^w_[0-9a-f]{8}(?:[0-9a-f]{4})?$"), "curated").when(target.startswith("u_"), "community").when(target.startswith("s_"), "shared").when(osm, "osm")


def format_distance(km: Column, unit: str = "km", digits: int = 1) -> Column:
    """(STR_20)"""
    from trekframe.functions.hiking import convert_distance

    return F.format_string(f"%.{digits}f {unit}", convert_distance(km, unit))


@F.pandas_udf(T.StringType())
def first_sentence(texts: pd.Series) -> pd.Series:
    """First sentence of the last "|" part; a stop after an initial or abbreviation ends none (STR_09)."""
    import re

    short = re.compile(r"(?:\b(?:[A-Z]|Mt|St|Dr|Rd|approx|e\.g|i\.e)\.)$")

    def one(text):
        if text is None:
            return None
        part = text.split("|")[-1].strip()
        for m in re.finditer(r"[.!?](?=\s|$)", part):
            if not short.search(part[: m.end()]):
                return part[: m.end()]
        return part

    return texts.map(one)


@F.pandas_udf(T.StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """XML character references decoded; those to characters that XML forbids stay as written (STR_12)."""
    import re

    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

    def one(m):
        body = m[1]
        if not body.startswith("#"):
            return named.get(body, m[0])
        n = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        fine = n in (9, 10, 13) or 0x20 <= n <= 0xD7FF or 0xE000 <= n <= 0xFFFD or 0x10000 <= n <= 0x10FFFF
        return chr(n) if fine else m[0]

    pattern = re.compile(r"&(#[xX][0-9a-fA-F]+|#\d+|\w+);")
    return texts.map(lambda t: None if t is None else pattern.sub(one, t))


@F.pandas_udf(T.StringType())
def rate_key(addresses: pd.Series) -> pd.Series:
    """The key that an address counts under: itself for IPv4 (mapped ones too), the /64 network for IPv6 (STR_18)."""

    def one(raw):
        try:
            a = ipaddress.ip_address((raw or "").strip())
        except ValueError:
            return raw
        if a.version == 6 and a.ipv4_mapped:
            a = a.ipv4_mapped
        return str(a) if a.version == 4 else str(ipaddress.ip_network(f"{a}/64", strict=False).network_address) + "/64"

    return addresses.map(one)


@F.pandas_udf(T.StringType())
def short_hash(texts: pd.Series) -> pd.Series:
    """A 12-character base-36 fingerprint (STR_17): any fixed 62-bit hash serves, as it is only compared with itself."""
    import hashlib

    def one(text):
        if text is None:
            return None
        n, out = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") >> 2, ""
        for _ in range(12):
            n, d = divmod(n, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out

    return texts.map(one)
