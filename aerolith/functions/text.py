"""Codes, names and numbers as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.geo import col

FLIGHT_NUMBER = r"^[A-Z]{3}\d{1,4}[A-Z]{0,2}$"
MIRROR = r"^([A-Z]{3})0*(\d+)[A-Z]{0,2}$"

# Words in a field's name that tell a military base.
MILITARY_WORDS = (" air base", " airbase", " air force", " afb", " raf ", " naval air", " nas ", " army air", " military", " marine corps", " air station", " air national guard")
# Manufacturers whose names have more than one word.
MAKERS = ("De Havilland Canada", "De Havilland", "McDonnell Douglas", "British Aerospace", "Sukhoi Superjet")
# Who flies under an airline's numbers besides itself.
AFFILIATES = {
    "AAL": ("JIA", "ENY", "PDT", "SKW", "RPA", "ASH", "MQ"), "DAL": ("EDV", "SKW", "RPA"), "UAL": ("SKW", "RPA", "ASH", "GJS", "AWI", "UCA"),
    "ASA": ("QXE", "SKW"), "ACA": ("JZA", "ROU", "SKV"), "WJA": ("WEN", "WSW"), "EZY": ("EJU", "EZS"), "DLH": ("CLH", "OCN", "EWG", "LHA"),
    "AFR": ("HOP", "FPO", "TVF"), "KLM": ("KLC", "TRA"), "BAW": ("CFE", "SHT", "EFW"), "IBE": ("IBS", "ANE", "VLG"), "SAS": ("SZS", "CNL", "LNK"),
    "FIN": ("NRC",), "AUA": ("AUA",), "SWR": ("EDW", "HES"), "QFA": ("JST", "QLK", "NWK"), "ANZ": ("MCA",), "RYR": ("RUK", "MAY", "RYS", "BCS"),
    "WZZ": ("WUK", "WMT", "WAZ"), "NAX": ("NSZ", "NOZ", "NRS"),
}
# Still-air range in km by type designator.
RANGE_KM = {
    "A318": 5700, "A319": 6900, "A320": 6100, "A321": 5900, "A19N": 6900, "A20N": 6300, "A21N": 7400, "A306": 7500, "A310": 9600, "A332": 13400,
    "A333": 11700, "A338": 15000, "A339": 13300, "A342": 13800, "A343": 13500, "A345": 16000, "A346": 14400, "A359": 15000, "A35K": 16000, "A388": 15000,
    "B712": 3800, "B733": 4400, "B734": 4200, "B735": 4400, "B736": 5600, "B737": 6300, "B738": 5700, "B739": 5900, "B37M": 7000, "B38M": 6500,
    "B39M": 6500, "B3XM": 6100, "B744": 13400, "B748": 14300, "B752": 7200, "B753": 6400, "B762": 7300, "B763": 11000, "B764": 10400, "B772": 9700,
    "B773": 11000, "B77L": 15800, "B77W": 14000, "B788": 13600, "B789": 14000, "B78X": 11900, "MD11": 12000, "MD82": 3800, "MD83": 4600, "MD88": 4100,
    "E170": 3900, "E175": 4000, "E75L": 4000, "E190": 4500, "E195": 4200, "E290": 5300, "E295": 4900, "CRJ2": 3000, "CRJ7": 3600, "CRJ9": 2900,
    "CRJX": 3000, "AT72": 1500, "AT75": 1500, "AT76": 1500, "DH8D": 2000, "DH8C": 1700, "DH8B": 1700, "DH8A": 1700, "BCS1": 6400, "BCS3": 6300,
    "SU95": 4600, "C919": 5500,
}


def clean(value, limit: int) -> Column:
    """Trimmed and cut; empty is null."""
    return F.nullif(F.substring(F.trim(col(value)), 1, limit), F.lit(""))


def coarse(value, digits: int = 1) -> Column:
    return F.bround(col(value), digits)


def is_flight_number(callsign) -> Column:
    return F.coalesce(col(callsign).rlike(FLIGHT_NUMBER), F.lit(False))


def is_hex24(value) -> Column:
    return F.coalesce(col(value).rlike("^[0-9a-f]{6}$"), F.lit(False))


def normalize_uuid(value) -> Column:
    """32 lower-case hex digits, or null."""
    v = F.regexp_replace(F.lower(F.trim(col(value))), "-", "")
    return F.when(v.rlike("^[0-9a-f]{32}$"), v)


def is_anonymous(value) -> Column:
    v = normalize_uuid(value)
    return v.isNull() | v.endswith("0" * 16)


def hash_uuid(value) -> Column:
    return F.sha2(normalize_uuid(value), 256)


def half_id(value) -> Column:
    return F.substring(normalize_uuid(value), 1, 16)


def public_id(digest, prefix: str = "st-") -> Column:
    return F.concat(F.lit(prefix), F.substring(col(digest), 1, 10))


def airport_role(kind, scheduled, name) -> Column:
    """closed, commercial (scheduled service), military (by its name) or general."""
    lower = lambda c: F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), "[^a-z ]", " "), F.lit(" "))
    military = padded.contains(MILITARY_WORDS[0])
    for w in MILITARY_WORDS[1:]:
        military = military | padded.contains(w)
    return F.when(lower(kind) == "closed", "closed").when(lower(scheduled) == "yes", "commercial").when(military, "military").otherwise("general")


@lru_cache
def fold_table() -> tuple[str, str]:
    """Letters with a mark and the plain capital for each, one for one, from Unicode's decompositions."""
    bare = {"Ø": "O", "ø": "O", "Đ": "D", "đ": "D", "Ł": "L", "ł": "L", "Ħ": "H", "ħ": "H", "Ŧ": "T", "ŧ": "T", "ı": "I"}
    for code in range(0xC0, 0x234):
        c = chr(code)
        plain = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
        if c not in bare and len(plain) == 1 and plain[0].isascii() and plain[0].isalpha() and plain[0] != c:
            bare[c] = plain[0].upper()
    return "".join(bare), "".join(bare.values())


def fold(value) -> Column:
    """Upper case without accents."""
    return F.translate(F.upper(col(value)), *fold_table())


def fold_words(value) -> Column:
    """Lower-case words without marks; ligatures opened; everything else separates."""
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.translate(col(value), *fold_table())), "ß", "ss"), "æ", "ae"), "œ", "oe")
    return F.filter(F.split(F.regexp_replace(v, r"\p{M}+", ""), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def phrase(value) -> Column:
    return F.array_join(fold_words(value), " ")


def norm_query(value) -> Column:
    """Trimmed, one space between words, upper case."""
    return F.upper(F.trim(F.regexp_replace(col(value), r"\s+", " ")))


def compact(value) -> Column:
    """A code as letters and digits only, upper case."""
    return F.upper(F.regexp_replace(col(value), "[^A-Za-z0-9]", ""))


def whole_word(text, word) -> Column:
    return F.coalesce(F.concat(F.lit(" "), col(text), F.lit(" ")).contains(F.concat(F.lit(" "), col(word), F.lit(" "))), F.lit(False))


def lift(n) -> Column:
    """Traffic as a tie-breaker inside a match class."""
    return F.log10(F.coalesce(col(n), F.lit(0)) + 1) * 4


def flight_label(callsign, iata, flight) -> Column:
    """The marketed number, else the airline's IATA code with the number bare of leading zeros, else the callsign."""
    tail = F.ltrim(F.substring(col(callsign), 4, 20), F.lit("0"))
    return F.coalesce(col(flight), F.when(col(iata).isNotNull() & (tail != ""), F.concat(col(iata), tail)), col(callsign))


def digits(value) -> Column:
    return F.ltrim(F.regexp_replace(F.coalesce(col(value), F.lit("")), r"[^0-9]", ""), F.lit("0"))


def same_number(callsign, flight) -> Column:
    return (digits(callsign) != "") & (digits(callsign) == digits(flight))


def designator(flight) -> Column:
    """The airline designator a number is written under: three letters before a digit, else two characters before one."""
    three, two = F.regexp_extract(col(flight), r"^([A-Z]{3})\d", 1), F.regexp_extract(col(flight), r"^([A-Z0-9]{2})\d", 1)
    return F.when(three != "", three).otherwise(two)


def airline_of(boards: DataFrame, airlines: DataFrame, flight: str = "flight") -> DataFrame:
    """Add `prefix` and `icao` (empty if the registry does not know the designator)."""
    codes = airlines.where("iata is not null").groupBy(F.col("iata").alias("_iata")).agg(F.max("icao").alias("_icao"))
    joined = boards.withColumn("prefix", designator(flight)).join(codes, F.col("prefix") == F.col("_iata"), "left")
    return joined.withColumn("icao", F.when(F.length("prefix") == 3, F.col("prefix")).otherwise(F.coalesce("_icao", F.lit("")))).drop("_iata", "_icao")


def same_carrier(icao, prefix, service_icao, number_agrees) -> Column:
    """Whether a service of one airline code may fly a board's number."""
    want = F.coalesce(F.nullif(col(icao), F.lit("")), col(prefix))
    friends = F.create_map(*[x for k, v in AFFILIATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.nullif(col(service_icao), F.lit(""))
    friend = F.coalesce(F.array_contains(F.try_element_at(friends, col(icao)), own), F.lit(False))
    return F.when(own.isNull(), col(number_agrees)).otherwise((own == want) | friend)


def board_stop(counterpart, kind) -> Column:
    """The next stop of a departure (first listed), the previous one of an arrival (last listed); null if not a code."""
    stops = F.filter(F.transform(F.split(F.coalesce(col(counterpart), F.lit("")), ","), lambda s: F.upper(F.trim(s))), lambda s: s != "")
    code = F.when(col(kind) == "dep", F.try_element_at(stops, F.lit(1))).otherwise(F.try_element_at(stops, F.lit(-1)))
    return F.when(code.rlike("^[A-Z0-9]{3,4}$"), code)


def mirror_numbers(callsign) -> Column:
    """The flight numbers one below and one above; empty for anything but a number."""
    airline, n = F.regexp_extract(col(callsign), MIRROR, 1), F.regexp_extract(col(callsign), MIRROR, 2).try_cast("long")
    both = F.filter(F.array(n - 1, n + 1), lambda x: x > 0)
    return F.when(n.isNull(), F.array().cast("array<string>")).otherwise(F.transform(both, lambda x: F.concat(airline, x.cast("string"))))


def parse_date8(value) -> Column:
    return F.when(F.trim(col(value)).rlike(r"^\d{8}$"), F.try_to_date(F.trim(col(value)), "yyyyMMdd"))


def parse_year(value) -> Column:
    y = F.trim(col(value))
    n = F.when(y.rlike(r"^\d+$"), y.try_cast("int"))
    return F.when(n.between(1900, 2100), n)


def norm_reg(value) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(col(value), F.lit("")), "[- ]", ""))


def occurrence_registration(domestic, foreign) -> Column:
    """A domestic mark gets its national prefix if it lacks it; else the foreign one as written."""
    d = F.upper(F.trim(F.coalesce(col(domestic), F.lit(""))))
    return F.when(d == "", F.upper(F.trim(F.coalesce(col(foreign), F.lit(""))))).when(d.startswith("C-"), d).otherwise(F.concat(F.lit("C-"), d))


def occurrence_when(day, time) -> Column:
    """Timestamp of a date and a messy HHMM; midnight when the time says nothing; null without a date."""
    d = F.try_to_date(F.substring(col(day), 1, 10), "yyyy-MM-dd")
    n = F.substring(F.regexp_replace(F.coalesce(col(time), F.lit("")), r"[^0-9]", ""), 1, 4)
    h, m = F.substring(n, 1, 2).try_cast("int"), F.substring(n, 3, 2).try_cast("int")
    good = (F.length(n) == 4) & (h < 24) & (m < 60)
    return F.to_timestamp(d) + F.make_dt_interval(hours=F.when(good, h).otherwise(0), mins=F.when(good, m).otherwise(0))


def track_point(token) -> Column:
    """54/20 as (54, -20), 5630/40 as (56.5, -40), inside the ocean's box; else null."""
    part = lambda i: F.regexp_extract(col(token), r"^(\d{2})(\d{2})?/(\d{2,3})$", i).try_cast("double")
    lat, lon = part(1) + F.coalesce(part(2), F.lit(0.0)) / 60, -part(3)
    return F.when(lat.between(40, 80) & lon.between(-80, 0), F.struct(lat.alias("lat"), lon.alias("lon")))


def levels(text) -> Column:
    """Flight levels of a line; none for NIL."""
    t = F.trim(col(text))
    return F.when((t == "") | t.startswith("NIL"), F.array().cast("array<int>")).otherwise(F.transform(F.filter(F.split(t, r"\s+"), lambda w: w.rlike(r"^\d+$")), lambda w: w.cast("int")))


def strip_country(name) -> Column:
    return F.regexp_replace(col(name), r"\s*\(\w\w\)$", "")


def city_name(airports: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add `city`: an override by code(code, city), or of another code at the same place, else the name without "(XX)"."""
    listed = airports.select(F.col("code"), "lat", "lon").join(overrides, "code")
    spots = listed.groupBy("lat", "lon").agg(F.min_by("city", "code").alias("_spot"))
    named = airports.join(overrides.withColumnRenamed("city", "_own"), "code", "left").join(spots, ["lat", "lon"], "left")
    return named.withColumn("city", F.coalesce("_own", "_spot", strip_country("name"))).drop("_own", "_spot")


def manufacturer(name) -> Column:
    """The maker: known names of several words, else the first word."""
    out = F.try_element_at(F.split(F.trim(col(name)), r"\s+"), F.lit(1))
    for maker in reversed(MAKERS):
        out = F.when(col(name).startswith(maker), F.lit(maker)).otherwise(out)
    return F.nullif(out, F.lit(""))


def military(flags, db_flags=None) -> Column:
    """Bit 0 of the registry's flag text, or of the receiver's database flags."""
    first = F.substring(F.coalesce(col(flags), F.lit("")), 1, 1) == "1"
    return first if db_flags is None else first | (F.coalesce(col(db_flags), F.lit(0)).bitwiseAND(1) == 1)


def source_of(kind) -> Column:
    k = F.coalesce(col(kind), F.lit(""))
    return F.when(k.isin("mlat", "mode_s", "adsc"), k).when(k.startswith("adsb"), "adsb").when(k.startswith("tisb"), "tisb").when(k.startswith("adsr"), "adsr").otherwise("other")


def operator_code(callsign) -> Column:
    """Three letters before a digit, else null."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(col(callsign))), r"^([A-Z]{3})\d", 1), F.lit(""))


def operator_of_callsign(df: DataFrame, airlines: DataFrame, operators: DataFrame | None = None, callsign: str = "callsign") -> DataFrame:
    """Add `operator`: the airline's name by the callsign's three letters, else the registry's operator name."""
    out = df.withColumn("_code", operator_code(callsign)).join(airlines.select(F.col("icao").alias("_code"), F.col("name").alias("_airline")), "_code", "left")
    if operators is None:
        return out.withColumn("operator", F.col("_airline")).drop("_code", "_airline")
    other = operators.select(F.col("icao").alias("_code"), F.col("name").alias("_other"))
    return out.join(other, "_code", "left").withColumn("operator", F.coalesce("_airline", "_other")).drop("_code", "_airline", "_other")


def type_range_km(type_code, table: dict[str, int] | None = None) -> Column:
    pairs = [x for k, v in (table or RANGE_KM).items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(col(type_code), F.lit("")))


def catalog_route(origin, via, dest) -> Column:
    return F.concat(F.array(col(origin)), F.coalesce(col(via), F.array().cast("array<string>")), F.array(col(dest)))


def edits_allowed(word) -> Column:
    """First ranking: one edit for four letters, two from five."""
    return F.when(F.length(col(word)) == 4, 1).otherwise(2)


def edits_allowed_swaps(word) -> Column:
    """Second ranking: none below four letters, one for four or five, two from six."""
    n = F.length(col(word))
    return F.when(n < 4, 0).when(n < 6, 1).otherwise(2)


def compact_flight(query) -> Column:
    """"SQ 322" as "SQ322"; a purely numeric code is left alone."""
    m = r"^([A-Z0-9]{2,3}) ([0-9]{1,4}[A-Z]?)$"
    return F.when(col(query).rlike(m) & ~F.regexp_extract(col(query), m, 1).rlike(r"^\d+$"), F.regexp_replace(col(query), " ", "")).otherwise(col(query))


def flight_number(query) -> Column:
    """struct(code, number) of a flight number typed with or without a space; null if it is none."""
    q = F.upper(F.trim(col(query)))
    spaced, whole = r"^([A-Z0-9]{2}|[A-Z]{3}) (\d{1,4}[A-Z]?)$", r"^([A-Z]{3}|[A-Z0-9]{2})(\d{1,4}[A-Z]?)$"
    pick = lambda p: F.struct(F.regexp_extract(q, p, 1).alias("code"), F.regexp_extract(q, p, 2).alias("number"))
    lettered = lambda p: q.rlike(p) & F.regexp_extract(q, p, 1).rlike("[A-Z]")
    return F.when(lettered(spaced), pick(spaced)).when(~q.contains(" ") & lettered(whole), pick(whole))


JOINS = ("TO", "FROM", "→")


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(query) -> Column:
    """"SIN LHR", "SIN-LHR", "A to B", "from A to B", "flights to B from A" as struct(origin, dest), upper case; null if it is none."""
    dashed = r"^\s*(\p{L}+\s+)*\p{L}{3,}\s*-\s*\p{L}{3,}(\s+\p{L}+)*\s*$"

    def sides(w: Column) -> Column:
        """struct(one, two): the words of either place."""
        first, size = F.get(w, F.lit(0)), F.size(w)
        at = lambda mark: F.array_position(w, mark).cast("int")
        before = lambda mark, start: F.slice(w, start, F.greatest(at(mark) - start, F.lit(0)))
        after = lambda mark: F.slice(w, at(mark) + 1, size)
        pair = lambda one, two: F.struct(one.alias("one"), two.alias("two"))
        arrow = pair(F.when(first == "FROM", before("→", 2)).otherwise(before("→", 1)), after("→"))
        from_to, to_from, to = pair(before("TO", 2), after("TO")), pair(after("FROM"), before("FROM", 2)), pair(before("TO", 1), after("TO"))
        return F.when(at("→") > 0, arrow).when((first == "FROM") & (at("TO") > 0), from_to).when((first == "TO") & (at("FROM") > 0), to_from).when(at("TO") > 0, to).when(size == 2, pair(F.slice(w, 1, 1), F.slice(w, 2, 1)))

    def named(f: Column) -> Column:
        fits = (F.size(f["one"]) > 0) & (F.size(f["two"]) > 0) & ~F.arrays_overlap(F.concat(f["one"], f["two"]), F.array(*map(F.lit, JOINS)))
        return F.when(fits, F.struct(F.array_join(f["one"], " ").alias("origin"), F.array_join(f["two"], " ").alias("dest")))

    bare = lambda w: F.when((F.size(w) > 1) & (F.get(w, F.lit(0)) == "FLIGHTS"), F.slice(w, 2, F.size(w))).otherwise(w)
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda x: x != "")
    undashed = lambda t: F.when(t.rlike(dashed), F.replace(t, F.lit("-"), F.lit(" → "))).otherwise(t)
    text = F.regexp_replace(F.upper(col(query)), "->|[→–—>]", " → ")
    return _let(_let(_let(_let(_let(text, undashed), words), bare), sides), named)


def address_block(address: str | None) -> str | None:
    """An IPv4 address as it is, an IPv6 address as its /64; null if it is none."""
    import ipaddress

    try:
        ip = ipaddress.ip_address((address or "").strip())
    except ValueError:
        return None
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    return str(ip) if ip.version == 4 else str(ipaddress.ip_network((ip, 64), strict=False).network_address)


def _address_blocks(addresses: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in addresses:
        listed = batch.dictionary_encode()  # each address of a batch is read once
        yield pa.array([address_block(a) for a in listed.dictionary.to_pylist()], pa.string()).take(listed.indices)


def address_key(address, salt: str) -> Column:
    """Hash of an IPv4 address or an IPv6 /64 after a salt; the address itself goes no further."""
    return F.sha2(F.concat(F.lit(salt), F.arrow_udf(_address_blocks, "string")(col(address))), 256)
