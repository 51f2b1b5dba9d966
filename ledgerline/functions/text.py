"""Text functions over columns. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for "not known" (fixed values).
UNKNOWN_TRIM_VALUES = ("N A", "NA", "NONE", "NULL", "UNKNOWN", "NOT APPLICABLE")
UNKNOWN_VEHICLE_VALUES = ("", "N A", "NA", "NONE", "NULL", "UNKNOWN", "NOT APPLICABLE", "OTHER")
#: Trims by precedence (fixed values).
KNOWN_TRIMS = (
    "TRD OFF ROAD", "TRD SPORT", "HIGH COUNTRY", "KING RANCH", "BIG HORN",
    "M SPORT", "AMG", "PLATINUM", "LIMITED", "PREMIUM", "TOURING", "DENALI",
    "LARIAT", "RAPTOR", "LARAMIE", "LONGHORN", "RUBICON", "OVERLAND",
    "ALTITUDE", "GT350", "GT500", "PRO 4X", "TRD PRO", "RTL E", "EX L",
    "330I", "340I", "430I", "440I", "530I", "540I", "M340I", "M440I",
    "M3", "M4", "M5", "RS3", "RS5", "RS7", "S3", "S4", "S5", "S6", "S7",
    "2LT", "1LT", "3LT", "2SS", "1SS", "Z71", "LTZ", "RST", "SLT", "SLE",
    "SEL", "XLE", "XSE", "SR5", "SPORT", "BASE", "RTL", "SXT", "SRT",
    "XLT", "WILLYS", "SAHARA", "REBEL", "SV", "SR", "SL", "SE", "LE",
    "EX", "LX", "SI", "LT", "LS", "XL", "GT", "R T",
)
#: Words of a title that are no trim (fixed values).
TITLE_STOPWORDS = (
    "NEW", "USED", "CERTIFIED", "CPO", "SEDAN", "COUPE", "SUV", "TRUCK",
    "VAN", "WAGON", "HATCHBACK", "CONVERTIBLE", "AWD", "FWD", "RWD", "4WD",
    "4X4", "AUTO", "AUTOMATIC", "MANUAL", "GAS", "GASOLINE", "HYBRID",
    "ELECTRIC", "DIESEL", "TURBO", "LOCAL", "CARFAX", "CLEAN", "TITLE",
    "NAVIGATION", "SUNROOF", "LEATHER", "BACKUP", "CAMERA", "LOW", "MILES",
)
#: Trims by precedence, and words that are none, of the older title rule (fixed values).
PROXY_TRIMS = (
    "PLATINUM", "LIMITED", "PREMIUM", "SEL", "SE", "LE", "XLE", "XSE", "SR5",
    "TRD PRO", "TRD OFF ROAD", "TRD SPORT", "SPORT", "TOURING", "EX L", "EX",
    "LX", "SI", "RTL E", "RTL", "LTZ", "LT", "LS", "RST", "Z71",
    "HIGH COUNTRY", "DENALI", "SLT", "SLE", "LARIAT", "KING RANCH", "RAPTOR",
    "XL", "XLT", "BIG HORN", "LARAMIE", "LONGHORN", "REBEL", "WILLYS",
    "SAHARA", "RUBICON", "OVERLAND", "ALTITUDE", "SXT", "GT", "R T", "SRT",
    "SV", "SR", "SL", "PRO 4X", "2LT", "1LT", "3LT", "2SS", "1SS", "BASE",
)
PROXY_STOPWORDS = (
    "NEW", "USED", "CERTIFIED", "CPO", "SEDAN", "COUPE", "SUV", "TRUCK",
    "VAN", "WAGON", "AWD", "FWD", "RWD", "4WD", "AUTO", "AUTOMATIC",
    "MANUAL", "GAS", "HYBRID", "ELECTRIC", "DIESEL",
)
#: Phrases and words that sellers add to titles (fixed values).
MARKETING_PHRASES = ("FOR SALE", "LOW MILES", "ONE OWNER", "CLEAN CARFAX", "CLEAN TITLE", "NO ACCIDENTS", "SEE VIDEO", "FULLY LOADED", "WELL MAINTAINED", "GREAT CONDITION")
#: Words of a title that are no part of a trim's remainder (fixed values).
NON_TRIM_TOKENS = (
    "NEW", "USED", "CERTIFIED", "CPO", "SEDAN", "COUPE", "SUV", "TRUCK",
    "VAN", "WAGON", "HATCHBACK", "CONVERTIBLE", "CABRIOLET", "ROADSTER",
    "AWD", "FWD", "RWD", "4WD", "4X4", "AUTO", "AUTOMATIC", "MANUAL",
    "GAS", "GASOLINE", "HYBRID", "ELECTRIC", "DIESEL", "TURBO", "LOCAL",
    "CARFAX", "CLEAN", "TITLE", "NAVIGATION", "SUNROOF", "LEATHER",
    "BACKUP", "CAMERA", "LOADED", "MILE", "MILES", "PACKAGE", "PKG",
)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once; what a lambda names is computed anew
    for each entry that it goes over."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(c: Column) -> Column:
    """Upper case, anything but A-Z and 0-9 to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))


def _known_trim(s: Column, fallback: str = "") -> Column:
    """A squeezed text, or the fallback for null, empty and unknown ones."""
    return F.when((s != "") & ~s.isin(*UNKNOWN_TRIM_VALUES), s).otherwise(F.lit(fallback))


def normalize_trim(c: Column, fallback: str = "", keep_null: bool = False) -> Column:
    """squeeze(), or the fallback for empty and unknown values; nulls become
    the fallback too, or stay null for columns that mark absence (keep_null)."""
    return F.when(c.isNull(), F.lit(None if keep_null else fallback)).otherwise(_known_trim(squeeze(c), fallback))


def normalize_vehicle(c: Column) -> Column:
    """squeeze(), '' for null and unknown values."""
    s = squeeze(c)
    return F.when(c.isNull() | s.isin(*UNKNOWN_VEHICLE_VALUES), "").otherwise(s)


def canonical_token(c: Column) -> Column:
    return F.replace(normalize_vehicle(c), F.lit(" "), F.lit("_"))


def has_phrase(text: Column, phrase: Column | str) -> Column:
    """Whether blank-separated text holds the phrase as whole words."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return (phrase != "") & F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def remove_phrase(text: Column, phrase: Column | str) -> Column:
    """Text without the first whole-word occurrence of the phrase."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    at = F.position(F.concat(F.lit(" "), phrase, F.lit(" ")), padded)
    cut = F.concat(F.substring(padded, F.lit(1), at), F.substring(padded, at + F.length(phrase) + 1, F.length(padded)))
    return F.when((phrase != "") & (at > 0), F.trim(F.regexp_replace(cut, " +", " "))).otherwise(text)


def clean_trim_remainder(c: Column) -> Column:
    """What may be a trim: marketing phrases (longest first), words that are no
    trim and numbers of five or more digits are taken out."""
    text = normalize_vehicle(c)
    for phrase in sorted(MARKETING_PHRASES, key=lambda p: (-len(p), p)):
        text = F.trim(F.regexp_replace(F.regexp_replace(text, rf"\b{phrase}\b", " "), " +", " "))
    words = F.filter(F.split(text, " "), lambda w: (w != "") & ~w.isin(*NON_TRIM_TOKENS) & ~w.rlike("^[0-9]{5,}$"))
    return F.array_join(words, " ")


def title_year(c: Column, last: str = "3") -> Column:
    """First year 1980 to 20x9 in a text, x up to `last`; null without one."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, rf"\b(19[89]\d|20[0-{last}]\d)\b", 1), F.lit("")), F.lit("9999")).cast("int")


def extract_clean_trim(make: Column, model: Column, year: Column, title: Column, trims: tuple[str, ...] = KNOWN_TRIMS, stopwords: tuple[str, ...] = TITLE_STOPWORDS) -> Column:
    """First known trim, in list order, that the title holds as whole words;
    else its first two words that are neither identity nor stop words, numbers
    or single characters, at most 40 characters; '' without any. Words are
    joined by underscores."""
    own = F.split(F.concat_ws(" ", squeeze(make), squeeze(model), year.cast("string")), " ")

    def rest(text: Column) -> Column:
        words = once(own, lambda o: F.filter(F.split(text, " "), lambda w: (F.length(w) > 1) & ~w.isin(*stopwords) & ~F.array_contains(o, w) & ~w.rlike("^[0-9]+$")))
        return F.substring(F.array_join(F.slice(words, 1, 2), "_"), 1, 40)

    def found(text: Column) -> Column:
        return once(F.concat(F.lit(" "), text, F.lit(" ")), lambda padded: F.coalesce(*[F.when(padded.contains(f" {t} "), t.replace(" ", "_")) for t in trims], rest(text)))

    return once(once(squeeze(title), lambda s: _known_trim(s)), found)


def title_trim_proxy(title: Column, make: Column, model: Column, year: Column) -> Column:
    """extract_clean_trim() by the older lists; UNKNOWN_TRIM without a trim."""
    found = extract_clean_trim(make, model, year, title, PROXY_TRIMS, PROXY_STOPWORDS)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("UNKNOWN_TRIM"))


def combine_trims(*cs: Column) -> Column:
    """Distinct normalised values in order, each with underscores for its blanks,
    joined by blanks; UNKNOWN_TRIM without any, which counts as no value."""
    tokens = [F.replace(normalize_trim(c), F.lit(" "), F.lit("_")) for c in cs]
    values = F.array_distinct(F.filter(F.array(*tokens), lambda v: ~v.isin("", "UNKNOWN_TRIM")))
    return F.when(F.size(values) > 0, F.array_join(values, " ")).otherwise("UNKNOWN_TRIM")


def normalize_label(c: Column, fallback: str = "UNKNOWN") -> Column:
    """Trimmed, blanks squeezed, upper case; the fallback for null or empty."""
    s = F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(c.isNull() | (s == ""), fallback).otherwise(s)


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null or blank."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))


def flag(c: Column, pattern: str) -> Column:
    """1 if the text matches the pattern in any case, else 0 (null: 0)."""
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False)).cast("int")


def zero_fill(c: Column, width: int) -> Column:
    """Left-filled with zeros; longer values stay whole."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def joined_key(*cs: Column, sep: str = "|", missing: str = "UNKNOWN") -> Column:
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit(missing)) for c in cs])


def transmission(style: Column, speeds: Column) -> Column:
    """style / speeds, the one that is there, or null."""
    return F.nullif(F.concat_ws(" / ", F.nullif(F.trim(style), F.lit("")), F.nullif(F.trim(speeds), F.lit(""))), F.lit(""))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin("1", "true", "yes"), F.lit(False)).cast("int")


def currency(c: Column, decimals: int = 0) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.concat(F.lit("$"), F.format_number(c, decimals)))


def number(c: Column, decimals: int = 0) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.format_number(c, decimals))


def percent(c: Column, decimals: int = 1) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.concat(F.format_number(c * 100, decimals), F.lit("%")))


def horizon_months(target: Column) -> Column:
    """Horizon of a target column's name: 3m is 3 months, 91d the months in 91 days."""
    months = F.try_to_number(F.nullif(F.regexp_extract(target, r"(\d+)m\b", 1), F.lit("")), F.lit("999999")).cast("double")
    days = F.try_to_number(F.nullif(F.regexp_extract(target, r"(\d+)d\b", 1), F.lit("")), F.lit("999999")).cast("double")
    return F.coalesce(months, days / 30.4375)


def api_error_kind(status: Column, reason: Column) -> Column:
    """quota, comments_disabled or other, by HTTP status and reason text."""
    r = F.lower(F.coalesce(reason, F.lit("")))
    quota = (status == 403) & (r.contains("quota") | r.contains("dailylimit") | r.contains("daily limit") | r.contains("ratelimit") | r.contains("rate limit"))
    return F.when(quota, "quota").when(r.contains("commentsdisabled") | r.contains("disabled comments"), "comments_disabled").otherwise("other")


def valid_vin(c: Column) -> Column:
    """At least three characters, no asterisk, not marked invalid."""
    return F.coalesce((F.length(F.trim(c)) >= 3) & ~c.contains("*") & ~F.lower(c).contains("invalid"), F.lit(False))
