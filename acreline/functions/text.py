"""Addresses, keys and free-text results as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of an address and their short forms, applied in this order.
ABBREVIATIONS = (
    ("STREET", "ST"), ("AVENUE", "AVE"), ("BOULEVARD", "BLVD"), ("DRIVE", "DR"), ("LANE", "LN"), ("ROAD", "RD"), ("COURT", "CT"), ("CIRCLE", "CIR"),
    ("PLACE", "PL"), ("TERRACE", "TER"), ("WAY", "WAY"), ("TRAIL", "TRL"), ("PARKWAY", "PKWY"), ("HIGHWAY", "HWY"), ("NORTH", "N"), ("SOUTH", "S"),
    ("EAST", "E"), ("WEST", "W"), ("NORTHEAST", "NE"), ("NORTHWEST", "NW"), ("SOUTHEAST", "SE"), ("SOUTHWEST", "SW"), ("APARTMENT", "APT"),
    ("SUITE", "STE"), ("UNIT", "UNIT"), ("BUILDING", "BLDG"), ("FLOOR", "FL"),
)
#: Owner names that mark a company.
CORPORATE = ("LLC", "INC", "TRUST", "HOLDINGS", "BANK", "PROPERTIES", "CORP", "COMPANY")


def normal_address(c: Column) -> Column:
    """Upper case without points, commas and number signs, words shortened.

    One split, a look-up a word and a join: signs inside a word (a hyphen, a stroke) end it as blanks do.
    """
    out = F.regexp_replace(F.regexp_replace(F.trim(F.upper(c)), "[.,#]", ""), r"\s+", " ")
    short = F.create_map(*[F.lit(x) for w, s in ABBREVIATIONS if w != s for x in (w, s)])
    words = F.split(out, r"\b(?=\W)|(?<=\W)(?=\w)|(?<=\w)(?=\W)")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), "")


def zip5(c: Column) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "00000").otherwise(F.substring(F.trim(c), 1, 5))


def hash_normal(address: Column, zip_: Column) -> Column:
    return F.concat_ws("|", normal_address(address), zip5(zip_))


def hash_upper(address: Column, zip_: Column) -> Column:
    return F.concat_ws("|", F.upper(F.trim(address)), zip5(zip_))


def hash_sha256(address: Column, city: Column, zip_: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.upper(F.trim(address)), F.upper(F.trim(city)), zip5(zip_)), 256)


def hash_md5(address: Column) -> Column:
    return F.substring(F.md5(F.upper(F.trim(address))), 1, 16)


def hash_base64(address: Column) -> Column:
    """The first 16 letters and digits of the base64 form."""
    return F.substring(F.regexp_replace(F.base64(F.encode(address, "UTF-8")), "[^A-Za-z0-9]", ""), 1, 16)


def hash_dashed(address: Column, zip_: Column) -> Column:
    return F.concat_ws("-", F.regexp_replace(F.lower(F.trim(address)), "[^a-z0-9]+", "-"), zip5(zip_))


def house_number(c: Column) -> Column:
    digits = F.regexp_extract(F.trim(c), r"^(\d{1,9})\s+", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(0)


def street_name(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\d+\s+\S"), F.regexp_extract(F.trim(c), r"^\d+\s+(.*)$", 1)).otherwise(F.trim(c))


def street_key(c: Column) -> Column:
    """Lower case without suffix, directions and signs."""
    out = F.regexp_replace(F.lower(F.trim(c)), r"\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|court|ct|circle|cir|place|pl|boulevard|blvd|way)\.?$", "")
    out = F.regexp_replace(out, r"\b(n|s|e|w|north|south|east|west)\b\.?", "")
    return F.regexp_replace(out, "[^a-z0-9]", "")


def street_key_upper(c: Column) -> Column:
    """Upper case without a final stop and the last word if it is a suffix; directions stay."""
    out = F.regexp_replace(F.upper(F.trim(c)), r"\.$", "")
    return F.trim(F.regexp_replace(out, r"\s+(STREET|ST|AVENUE|AVE|ROAD|RD|DRIVE|DR|LANE|LN|COURT|CT|CIRCLE|CIR|PLACE|PL|BOULEVARD|BLVD|WAY)$", ""))


def zip_of_hash(c: Column) -> Column:
    piped = F.regexp_extract(c, r"\|(\d{5})(-\d{4})?$", 1)
    return F.nullif(F.when(piped != "", piped).otherwise(F.regexp_extract(c, r"[-,\s](\d{5})$", 1)), F.lit(""))


def full_address(*parts: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def is_corporate(names: Column) -> Column:
    return F.coalesce(F.exists(names, lambda n: F.upper(n).rlike("|".join(CORPORATE))), F.lit(False))


def amount(c: Column) -> Column:
    """A number written with currency sign and group commas; NULL if it is none."""
    return F.try_to_number(F.nullif(F.regexp_replace(c, r"[$,\s]", ""), F.lit("")), F.lit("999999999999.99")).cast("double")


def emails(html: Column) -> Column:
    """Distinct addresses in a page, in order, none that starts with a digit."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), 1), F.lower))
    return F.filter(found, lambda e: ~e.rlike(r"^\d"))


def key_name(c: Column) -> Column:
    """A column's name as files spell it: lower case, without blanks, lines and dashes."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]", "")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.lit("dm_"), F.array_join(F.array_sort(F.array(F.lower(a), F.lower(b))), "_"))


def result_status(text: Column) -> Column:
    """The short rules, in their order: sold, nobody there, refusal, call back, else still open."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.rlike("sold|closed|signed|deal"), "SOLD").when(t.rlike("nh|n/h|no answer|nobody"), "NO_ANSWER")
        .when(t.rlike(r"not interested|go away|dni|\bno\b"), "HARD_NO").when(t.rlike("back|return|later|tomorrow"), "CALLBACK").otherwise("ELIGIBLE")
    )


def result_status_wide(text: Column) -> Column:
    """The wider rules, in their order: "interested" is met before "not interested" can be."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.contains("sold"), "SOLD").when(t.rlike("qualified|interested|hot lead"), "QUALIFIED").when(t.rlike("back|return"), "CALLBACK")
        .when(t.rlike("not moved in|haven't moved|hasnt moved|nmi"), "NOT_MOVED_IN").when(t.rlike("decision maker|dm not home|husband not home|wife not home|spouse"), "DM_NOT_HOME")
        .when(t.rlike("no answer|not home|nh|nobody"), "NO_ANSWER").when(t.rlike("not interested|dni|do not|go away") | (t == "no"), "HARD_NO").otherwise("OTHER")
    )


def import_status(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(s.rlike("sold|closed|purchase"), "SOLD")
        .when(s.rlike("call|click"), "CALLBACK")
        .when(s.rlike("answer|home|view"), "NO_ANSWER")
        .when(s.rlike("qualif|signup"), "QUALIFIED")
        .when(s.rlike("hard|refus|error"), "HARD_NO")
        .otherwise("ELIGIBLE")
    )


def portal_status(c: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(s.isin("SOLD", "CLOSED", "F"), "SOLD").when(s.isin("ACTIVE", "FOR SALE", "O"), "ACTIVE").when(s.isin("PENDING", "CONTINGENT", "P"), "PENDING")
        .when(s.isin("OFF MARKET", "WITHDRAWN", "EXPIRED"), "OFF_MARKET").otherwise("UNKNOWN")
    )
