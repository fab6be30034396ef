"""Second search: one table of documents with an inverted index, queries read as intents through phrase tables.

Documents: kind, id, label, codes[], phrases[] (names), airline, airports[], pairs[], types[], legs[], lat, lon, pop.
A query is split into phrases; phrase tables say what each may mean; readings are ranked, scored by equi joins, and
joined by whole codes and by a text pass over the index. Everything is per query, for all queries at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.functions import text as tx
from aerolith.functions import timeutil as tu
from aerolith.operators.aggregates import airport_codes, airport_traffic
from aerolith.operators.records import flying_order
from aerolith.operators.search import prefixed, without_letters
from aerolith.operators.windows import interleave, top_k
from aerolith.sources import commits

# Fixed values of the ranking.
CODE, INTENT, STEP, WHOLE, WHOLE_NAME, PREFIX = 1000.0, 900.0, 40.0, 600.0, 60.0, 500.0
TYPO1, TYPO2, SOME, SECONDARY = 470.0, 380.0, 150.0, 200.0
# Words an airline's name may end with and still be meant without.
GENERIC = ("airlines", "airline", "airways", "air", "lines", "international", "aviation", "aero", "aerolineas")
ORDER = ("flight", "route", "fleet", "registration", "airline_place", "type", "city")


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _texts(*columns) -> Column:
    return F.array_compact(F.array(*columns))


EMPTY = "array<string>"
SHAPE = {"codes": EMPTY, "phrases": EMPTY, "airline": "string", "airports": EMPTY, "pairs": EMPTY, "route": EMPTY, "types": EMPTY, "legs": "array<struct<org:string,dst:string,flights:bigint,block_min:int>>", "lat": "double", "lon": "double", "pop": "bigint"}


def _document(df: DataFrame, kind: str, id_: Column, label: Column, **parts: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), id_.alias("id"), label.alias("label"), *[parts.get(k, _none(t)).cast(t).alias(k) for k, t in SHAPE.items()])


def docs_airline(airlines: DataFrame, schedule: DataFrame) -> DataFrame:
    n = schedule.groupBy(F.col("airline_icao").alias("icao")).agg(F.sum("n_flights").alias("pop"))
    a = airlines.join(n, "icao", "left")
    return _document(a, "airline", F.col("icao"), F.col("name"), codes=_texts("icao", "iata"), phrases=_texts(tx.phrase("name")), airline=F.col("icao"), pop=F.coalesce("pop", F.lit(0)))


def docs_airport(airports: DataFrame, schedule: DataFrame, cities: DataFrame) -> DataFrame:
    """Large and medium fields and all that are served, with their city's other names. cities(name, alternates, codes)."""
    a = airports.withColumn("code", F.coalesce("iata", "ident")).join(airport_traffic(schedule), "code", "left")
    a = a.where("kind in ('large_airport', 'medium_airport') or traffic > 0")
    names = cities.select(F.explode("codes").alias("code"), F.concat(F.array("name"), "alternates").alias("n")).groupBy("code").agg(F.flatten(F.collect_list("n")).alias("other"))
    a = a.join(names, "code", "left")
    other = F.transform(F.coalesce("other", F.array().cast(EMPTY)), lambda s: tx.phrase(s))
    return _document(a, "airport", F.col("code"), F.col("name"), codes=F.array_distinct(_texts("iata", "ident")), phrases=F.array_distinct(F.concat(_texts(tx.phrase("name"), tx.phrase("municipality")), other)), airports=F.array("code"), lat=F.col("lat"), lon=F.col("lon"), pop=F.coalesce("traffic", F.lit(0)))


def docs_type(types: DataFrame, ref: DataFrame, families: DataFrame) -> DataFrame:
    """Types with their family's names; how many airframes as popularity. families(name, alternates, codes)."""
    n = ref.groupBy(F.col("type_code").alias("designator")).agg(F.count(F.lit(1)).alias("pop"))
    f = families.select(F.explode("codes").alias("designator"), F.concat(F.array("name"), "alternates").alias("n")).groupBy("designator").agg(F.flatten(F.collect_list("n")).alias("family"))
    t = types.join(n, "designator", "left").join(f, "designator", "left")
    fam = F.transform(F.coalesce("family", F.array().cast(EMPTY)), lambda s: tx.phrase(s))
    return _document(t, "type", F.col("designator"), F.coalesce("name", "designator"), codes=F.array("designator"), phrases=F.array_distinct(F.concat(_texts(tx.phrase("name"), F.lower("designator")), fam)), types=F.array("designator"), pop=F.coalesce("pop", F.lit(0)))


def docs_flight(schedule: DataFrame, airports: DataFrame, day: Column) -> DataFrame:
    """Numbers of the timetable: legs in flying order with block minutes, every pair of stops, the marketed number as a code."""
    z = airport_codes(airports).select("code", "tz")
    s = schedule.join(z.select(F.col("code").alias("org"), F.col("tz").alias("_o")), "org", "left").join(z.select(F.col("code").alias("dst"), F.col("tz").alias("_d")), "dst", "left")
    s = s.withColumn("block_min", tu.block_minutes(day, "dep_min", "_o", "arr_min", "_d"))
    order = flying_order(s.select("callsign", "org", "dst", "dep_min", F.col("n_flights").alias("n")))
    per = s.groupBy("callsign").agg(F.max("airline_icao").alias("airline"), F.array_sort(F.collect_list(F.struct("org", "dst", F.col("n_flights").alias("flights"), "block_min"))).alias("legs"), F.collect_set("flight").alias("numbers"), F.sum("n_flights").alias("pop"))
    j = per.join(order, "callsign")
    return _document(j, "flight", F.col("callsign"), F.col("callsign"), codes=F.array_distinct(F.concat(F.array("callsign"), "numbers")), airline=F.col("airline"), airports=F.array_distinct("route"), pairs=F.col("pairs"), route=F.col("route"), legs=F.col("legs"), pop=F.col("pop"))


def docs_flight_log_only(legs: DataFrame, schedule: DataFrame, airlines: DataFrame) -> DataFrame:
    """Airline callsigns that only the log knows, seen twice or more, with their most-flown leg."""
    n = legs.where("org <> dst and callsign rlike '[0-9]'").groupBy("callsign", "org", "dst").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("callsign").agg(F.sum("n").alias("pop"), F.max_by(F.struct("org", "dst", "n"), F.struct("n", "org", "dst")).alias("l")).where("pop >= 2")
    new = per.join(schedule.select("callsign"), "callsign", "left_anti").withColumn("airline", F.substring("callsign", 1, 3)).join(airlines.select(F.col("icao").alias("airline")), "airline", "left_semi")
    return _document(new, "flight", F.col("callsign"), F.col("callsign"), codes=F.array("callsign"), airline=F.col("airline"), airports=F.array("l.org", "l.dst"), pairs=F.array(F.concat_ws(">", "l.org", "l.dst")), route=F.array("l.org", "l.dst"), legs=F.array(F.struct(F.col("l.org").alias("org"), F.col("l.dst").alias("dst"), F.col("l.n").alias("flights"), F.lit(None).cast("int").alias("block_min"))), pop=F.col("pop"))


def docs_airframe(ref: DataFrame) -> DataFrame:
    """Airframes by address, registration and bare registration."""
    return _document(ref, "aircraft", F.col("hex"), F.coalesce("registration", F.upper("hex")), codes=F.array_distinct(_texts(F.upper("hex"), "registration", tx.compact("registration"))), airline=F.col("operator_icao"), types=_texts("type_code"), pop=F.lit(0))


def build_search_docs(*, schedule: DataFrame, legs: DataFrame, airports: DataFrame, airlines: DataFrame, types: DataFrame, airframes_ref: DataFrame, cities: DataFrame, families: DataFrame, day: Column) -> DataFrame:
    parts = (docs_airline(airlines, schedule), docs_airport(airports, schedule, cities), docs_type(types, airframes_ref, families), docs_flight(schedule, airports, day), docs_flight_log_only(legs, schedule, airlines), docs_airframe(airframes_ref))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NAMED = "kind in ('airport', 'airline', 'type')"


def inverted_index(docs: DataFrame) -> DataFrame:
    """(word, kind, id, tf, size, impact) over the names of named documents.

    impact: what the word adds to the relevance of the document (tf-idf with length normalisation). It depends on the
    documents alone, so it is worked out here once; a batch of queries reads and adds the postings of its own words."""
    w = docs.where(NAMED).select("kind", "id", F.flatten(F.transform("phrases", lambda p: F.split(p, " "))).alias("ws"))
    posts = w.select("kind", "id", F.size("ws").alias("size"), F.explode("ws").alias("word")).where("word <> ''").groupBy("word", "kind", "id", "size").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.where(NAMED).agg(F.count(F.lit(1)).alias("_n"))
    size = posts.select("kind", "id", "size").distinct().agg(F.avg("size").alias("_avg"))
    df = posts.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    j = posts.join(df, "word").join(F.broadcast(total)).join(F.broadcast(size))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    return j.select("word", "kind", "id", "tf", "size", (idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("size") / F.col("_avg")))).alias("impact"))


def spellings(index: DataFrame) -> DataFrame:
    """(word, key): every word of the index and what is left of it without one or two letters."""
    return index.select("word").distinct().select("word", F.explode(without_letters(F.col("word"), 2)).alias("key"))


def publish_index(spark: SparkSession, root: str, docs: DataFrame) -> int:
    """Keep documents, postings and spellings in a store, all three changed at once; returns the version. Postings and
    spellings lie in the order of what they are looked up by, so that a batch's words find their row groups."""
    by = lambda df, c: df.repartitionByRange(c).sortWithinPartitions(c)
    index = inverted_index(docs)
    return commits.publish(spark, root, {"documents": docs, "postings": by(index, "word"), "spellings": by(spellings(index), "key")})


def open_index(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, postings, spellings) of a kept index, all of one version."""
    number = commits.current(spark, root).version if version is None else version
    return tuple(commits.read_table(spark, root, name, number) for name in ("documents", "postings", "spellings"))


def airline_phrases(docs: DataFrame) -> DataFrame:
    """(phrase, airline): codes, whole names, and names without generic last words; the busiest of several."""
    a = docs.where("kind = 'airline'").select("id", "pop", "codes", F.get("phrases", F.lit(0)).alias("name"))
    tail = r"( (" + "|".join(GENERIC) + r"))+$"
    texts = F.concat(F.transform("codes", lambda c: F.struct(F.lit(0).alias("r"), F.lower(c).alias("p"))), F.array(F.struct(F.lit(1).alias("r"), F.col("name").alias("p")), F.struct(F.lit(2).alias("r"), F.regexp_replace("name", tail, "").alias("p"))))
    e = a.select("id", "pop", F.explode(texts).alias("t")).where("t.p <> ''")
    return top_k(e.select(F.col("t.p").alias("phrase"), "t.r", "id", "pop"), ["phrase"], [F.col("r"), F.desc("pop"), F.col("id")], 1, "_k").select("phrase", F.col("id").alias("airline"))


def place_phrases(docs: DataFrame, cities: DataFrame) -> DataFrame:
    """(phrase, how, airports): a code, a listed city, a municipality's fields, or a word or more of a large field's name (up to three)."""
    a = docs.where("kind = 'airport'")
    code = a.select(F.explode("codes").alias("p"), F.array("id").alias("airports")).select(F.lower("p").alias("phrase"), F.lit(0).alias("r"), F.lit("code").alias("how"), "airports")
    city = cities.select(F.explode(F.concat(F.array("name"), "alternates")).alias("p"), F.col("codes").alias("airports")).select(tx.phrase("p").alias("phrase"), F.lit(1).alias("r"), F.lit("city").alias("how"), "airports")
    named = a.where("pop > 0 or true").select(F.explode(F.slice("phrases", 2, 1)).alias("phrase"), "pop", "id")
    town = named.groupBy("phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("pop")).alias("n"), "id"))), lambda s: s["id"]).alias("airports")).select("phrase", F.lit(2).alias("r"), F.lit("city").alias("how"), "airports")
    words = a.where("pop > 0").select(F.split(F.get("phrases", F.lit(0)), " ").alias("w"), "pop", "id")
    runs = words.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size("w") - i + 1)), lambda k: F.array_join(F.slice("w", i, k), " "))))).alias("phrase"), "pop", "id").where("length(phrase) >= 4 and phrase not in ('international', 'airport', 'international airport')")
    field = runs.groupBy("phrase").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("pop")).alias("n"), "id"))), lambda s: s["id"]), 1, 3).alias("airports")).select("phrase", F.lit(3).alias("r"), F.lit("airport").alias("how"), "airports")
    every = code.unionByName(city).unionByName(town).unionByName(field).where("phrase <> ''")
    return top_k(every, ["phrase"], [F.col("r")], 1, "_k").select("phrase", "how", "airports")


def family_phrases(types: DataFrame, families: DataFrame) -> DataFrame:
    """(phrase, types): family names and designators."""
    f = families.select(F.explode(F.concat(F.array("name"), "alternates")).alias("p"), F.col("codes").alias("types")).select(tx.phrase("p").alias("phrase"), F.lit(0).alias("r"), "types")
    d = types.select(F.lower("designator").alias("phrase"), F.lit(1).alias("r"), F.array("designator").alias("types"))
    return top_k(f.union(d).where("phrase <> ''"), ["phrase"], [F.col("r")], 1, "_k").select("phrase", "types")


def readings(queries: DataFrame, docs: DataFrame, types: DataFrame, cities: DataFrame, families: DataFrame) -> DataFrame:
    """(q, place, reading, callsigns, bare, airline, froms, tos, types): what each query may mean, likeliest first."""
    q = queries.select(tx.norm_query("q").alias("q")).distinct().withColumn("ws", tx.fold_words("q")).withColumn("n", F.size("ws"))
    whole = q.withColumn("phrase", F.array_join("ws", " "))
    al, pl, fa = airline_phrases(docs), place_phrases(docs, cities), family_phrases(types, families)
    one_place = whole.join(pl, "phrase").select("q", F.col("airports").alias("own"), "how")
    blank = {"callsigns": EMPTY, "bare": "string", "airline": "string", "froms": EMPTY, "tos": EMPTY, "types": EMPTY}
    row = lambda df, kind, **c: df.select("q", F.lit(kind).alias("reading"), *[c.get(k, _none(t)).alias(k) for k, t in blank.items()])
    # flight numbers of known airlines
    f = q.withColumn("f", tx.flight_number("q")).where("f is not null")
    codes = docs.where("kind = 'airline'").select("id", F.explode("codes").alias("code"), "codes", "pop")
    known = f.join(codes, F.col("f.code") == F.col("code"))
    ranked = top_k(known, ["q"], [F.desc("pop"), F.col("id")], 3, "_k")
    flight = ranked.groupBy("q").agg(F.first("f").alias("f"), F.flatten(F.collect_list("codes")).alias("c"))
    flight = row(flight, "flight", callsigns=F.array_distinct(F.concat(F.array(F.concat("f.code", "f.number")), F.transform("c", lambda c: F.concat(c, F.col("f.number"))))))
    # a registration typed with a space
    registration = row(q.where("q rlike '^[A-Z0-9]{1,2} [A-Z0-9]{2,5}$'"), "registration", bare=tx.compact("q"))
    # two places
    p = q.withColumn("p", tx.places("q")).where("p is not null").select("q", tx.phrase("p.origin").alias("a"), tx.phrase("p.dest").alias("b"))
    joined = F.col("q").rlike(r" TO |FROM |-|>|→|–|—")
    route = p.join(pl.select(F.col("phrase").alias("a"), F.col("airports").alias("froms")), "a").join(pl.select(F.col("phrase").alias("b"), F.col("airports").alias("tos")), "b").where(~F.arrays_overlap("froms", "tos"))
    route = route.join(one_place.select("q", F.lit(True).alias("_one")), "q", "left").where(joined | F.col("_one").isNull())
    route = row(route, "route", froms=F.col("froms"), tos=F.col("tos"))
    # every cut of the words into two phrases, either order
    cuts = q.where("n between 2 and 8").select("q", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.array(F.struct((2 * i).alias("k"), F.array_join(F.slice("ws", F.lit(1), i), " ").alias("x"), F.array_join(F.slice("ws", i + 1, F.col("n")), " ").alias("y")), F.struct((2 * i + 1).alias("k"), F.array_join(F.slice("ws", i + 1, F.col("n")), " ").alias("x"), F.array_join(F.slice("ws", F.lit(1), i), " ").alias("y")))))).alias("c")).select("q", "c.*")
    who = cuts.join(al.withColumnRenamed("phrase", "x"), "x")
    with_family = who.join(fa.withColumnRenamed("phrase", "y"), "y")
    fleet = row(top_k(with_family, ["q"], [F.col("k")], 1, "_k"), "fleet", airline=F.col("airline"), types=F.col("types"))
    there = who.join(fa.select(F.col("phrase").alias("y")), "y", "left_anti").join(pl.select(F.col("phrase").alias("y"), "airports"), "y").join(one_place.select("q"), "q", "left_anti")
    airline_place = row(top_k(there, ["q"], [F.col("k")], 1, "_k"), "airline_place", airline=F.col("airline"), tos=F.col("airports"))
    alone = row(whole.join(fa, "phrase"), "type", types=F.col("types"))
    city = row(one_place.where("how = 'city'"), "city", tos=F.col("own"))
    every = flight.unionByName(route).unionByName(fleet).unionByName(registration).unionByName(airline_place).unionByName(alone).unionByName(city)
    # "SQ 777" is a fleet before a flight number; a family's own name is a type before one
    second = q.where("n = 2").select("q", F.get("ws", F.lit(1)).alias("phrase")).join(fa, "phrase").select("q", F.lit(1).alias("late"))
    is_type = alone.select("q", F.lit(2).alias("late2"))
    order = F.array_position(F.array(*map(F.lit, ORDER)), F.col("reading")).cast("double")
    j = every.join(second, "q", "left").join(is_type, "q", "left")
    slot = F.when((F.col("reading") == "flight") & F.col("late2").isNotNull(), 6.5).when((F.col("reading") == "flight") & F.col("late").isNotNull(), 3.5).otherwise(order)
    return j.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(slot)) - 1).drop("late", "late2")


def _lift(weight: float, n: str | Column = "pop") -> Column:
    return weight * F.log10(F.coalesce(geo.col(n), F.lit(0)) + 1.0)


def _best(df: DataFrame, k: int) -> DataFrame:
    """The k most popular documents of each query's branch."""
    return top_k(df, ["q"], [F.desc("pop"), F.col("kind"), F.col("id")], k, "_k").drop("_k")


def _offer(df: DataFrame, score: Column, reading: Column | None = None) -> DataFrame:
    """Scores to six places: what scores the same is told apart by kind and id, not by the order of a sum."""
    return df.select("q", "kind", "id", "label", F.round(score.cast("double"), 6).alias("score"), (reading if reading is not None else _none("string")).alias("reading"))


def _at(codes: str | Column, value: str | Column) -> Column:
    """Place of a value in a list, from 0; the list's length if it is not there."""
    p = F.array_position(codes, value)
    return F.when(p > 0, p - 1).otherwise(F.size(codes))


def route_fit(j: DataFrame) -> DataFrame:
    """Add direct, whole, at and leg_flights of flights for a route (froms, tos)."""
    ok = F.filter("legs", lambda l: F.array_contains("froms", l["org"]) & F.array_contains("tos", l["dst"]))
    ends = F.array_contains("froms", F.get("route", F.lit(0))) & F.array_contains("tos", F.try_element_at("route", F.lit(-1)))
    sums = F.flatten(F.transform("froms", lambda a, i: F.transform(F.filter("tos", lambda b: F.array_contains("pairs", F.concat(a, F.lit(">"), b))), lambda b: i + F.array_position("tos", b) - 1)))
    return j.withColumns({"direct": F.size(ok) > 0, "whole": ends, "at": F.coalesce(F.array_min(sums), F.lit(0)), "leg_flights": F.array_max(F.transform(ok, lambda l: l["flights"]))})


def place_fit(j: DataFrame) -> DataFrame:
    """Add ends, at and leg_flights of flights for a place (tos)."""
    places = F.transform(F.filter("route", lambda c: F.array_contains("tos", c)), lambda c: F.array_position("tos", c) - 1)
    ends = F.array_contains("tos", F.get("route", F.lit(0))) | F.array_contains("tos", F.try_element_at("route", F.lit(-1)))
    there = F.filter("legs", lambda l: F.array_contains("tos", l["org"]) | F.array_contains("tos", l["dst"]))
    return j.withColumns({"ends": ends, "at": F.coalesce(F.array_min(places), F.lit(0)), "leg_flights": F.array_max(F.transform(there, lambda l: l["flights"]))})


def score_readings(read: DataFrame, docs: DataFrame) -> DataFrame:
    """Offers of every reading: seven equi joins."""
    base = INTENT - STEP * F.col("place")
    d = {k: docs.where(F.col("kind") == k) for k in ("flight", "aircraft", "type", "airport")}
    of = lambda kind: read.where(F.col("reading") == kind)
    by_code = lambda df, kind, code: df.join(d[kind].withColumn(code, F.explode("codes")).drop("airline", "types"), code)
    exact = F.when(F.col("place") == 0, CODE + 30).otherwise(base)
    out = []
    f = of("flight").withColumn("c", F.explode("callsigns"))
    out.append(_offer(_best(by_code(f, "flight", "c").dropDuplicates(["q", "id"]), 10), exact + _lift(2.0), F.col("reading")))
    heads = d["flight"].withColumn("_c", F.explode("codes")).drop("airline", "types").withColumn("_h", F.substring("_c", 1, 3))
    starts = f.withColumn("_h", F.substring("c", 1, 3)).join(heads, "_h").where(F.col("_c").startswith(F.col("c"))).dropDuplicates(["q", "id"])
    out.append(_offer(_best(starts, 10), PREFIX + _lift(12.0), F.col("reading")))
    out.append(_offer(_best(by_code(of("registration"), "aircraft", "bare"), 3), exact, F.col("reading")))
    pairs = of("route").withColumn("pair", F.explode(F.flatten(F.transform("froms", lambda a: F.transform("tos", lambda b: F.concat(a, F.lit(">"), b))))))
    flown = route_fit(_best(pairs.join(d["flight"].withColumn("pair", F.explode("pairs")).drop("airline", "types"), "pair").dropDuplicates(["q", "id"]), 40))
    out.append(_offer(flown, base + F.when(F.col("direct"), 20).otherwise(0) + F.when(F.col("whole"), 10).otherwise(0) - 3.0 * F.col("at") + _lift(6.0, F.coalesce("leg_flights", "pop")), F.col("reading")))
    frames = d["aircraft"].select("kind", "id", "label", "pop", F.col("airline").alias("airline"), F.explode("types").alias("t"))
    owned = _best(of("fleet").withColumn("t", F.explode("types")).join(frames, ["airline", "t"]).dropDuplicates(["q", "id"]), 20)
    out.append(_offer(owned, base + 10 - F.least(_at("types", F.col("t")), F.lit(10)), F.col("reading")))
    kinds = d["type"].select("kind", "id", "label", "pop", F.col("id").alias("t"))
    fleet_types = of("fleet").withColumn("t", F.explode("types")).join(kinds, "t").dropDuplicates(["q", "id"])
    out.append(_offer(_best(fleet_types, 3), base - 100 + _lift(6.0)))
    there = of("airline_place").withColumn("a", F.explode("tos")).join(d["flight"].withColumn("a", F.explode("airports")).drop("types"), ["a", "airline"]).dropDuplicates(["q", "id"])
    out.append(_offer(place_fit(_best(there, 40)), base + F.when(F.col("ends"), 10).otherwise(0) - 3.0 * F.col("at") + _lift(6.0, F.coalesce("leg_flights", "pop")), F.col("reading")))
    typed = _best(of("type").withColumn("t", F.explode("types")).join(kinds, "t").dropDuplicates(["q", "id"]), 20)
    out.append(_offer(typed, base + 10 - F.least(_at("types", F.col("id")), F.lit(10)) + _lift(1.0), F.col("reading")))
    fields = _best(by_code(of("city").withColumn("a", F.explode("tos")), "airport", "a").dropDuplicates(["q", "id"]), 20)
    out.append(_offer(fields, base + 20 - 3.0 * F.least(_at("tos", F.col("id")), F.lit(6)) + _lift(1.0), F.col("reading")))
    main = of("city").withColumn("a", F.explode(F.slice("tos", 1, 2))).join(d["flight"].withColumn("a", F.explode("airports")).drop("types", "airline"), "a").dropDuplicates(["q", "id"])
    out.append(_offer(_best(main, 3), SECONDARY + _lift(6.0)))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def score_codes(queries: DataFrame, docs: DataFrame, about: DataFrame, words_known: DataFrame) -> DataFrame:
    """Whole codes typed without a space, with a bonus by kind; registrations that start so.

    about(q, about): the kind of the query's first reading; words_known(q): queries that are a place's or an airline's name."""
    q = queries.select(tx.norm_query("q").alias("q")).distinct().where(~F.col("q").contains(" ")).withColumn("c", tx.compact("q"))
    q = q.join(about, "q", "left").join(words_known.select("q", F.lit(True).alias("is_word")).distinct(), "q", "left")
    typed = q.withColumn("code", F.explode(F.array_distinct(F.array("q", "c"))))
    hit = typed.join(docs.withColumn("code", F.explode("codes")), "code").where("kind <> 'flight' or id rlike '[0-9]'").dropDuplicates(["q", "kind", "id"])
    hit = _best(hit, 20)
    digit, n, kind = F.col("q").rlike("[0-9]"), F.length("c"), F.col("kind")
    bonus = F.when(digit & (kind == "flight"), 30).when(digit & (kind == "aircraft"), 25).when(digit & (kind == "type"), 20).when(~digit & (kind == "airline") & (n == 2), 30).when(~digit & (kind == "airport") & n.isin(3, 4), 30).when(~digit & (kind == "airline") & (n == 3), 25).when(~digit & (kind == "type") & (n == 4), 25).when(~digit & (kind == "aircraft"), 20).otherwise(10)
    letters = F.col("c").rlike("^[A-Z]*$")
    score = F.when((kind == "aircraft") & letters & F.coalesce("is_word", F.lit(False)), TYPO1 - 20).when(F.col("about").isNotNull() & (F.col("about") != kind), INTENT - 3 * STEP + bonus / 10 + _lift(2.0)).otherwise(CODE + bonus + _lift(2.0))
    # by the whole of what is typed, not its head: a registry's marks begin alike, and all of them would meet all of them
    frames = docs.where("kind = 'aircraft'").select("kind", "id", "label", "pop", F.explode("codes").alias("_c"))
    begun = typed.where(F.col("q").rlike("[0-9]") & (F.length("c") >= 3)).select("q", "code")
    starts = prefixed(begun, F.col("code"), frames, "_c").dropDuplicates(["q", "id"])
    ordered = top_k(starts, ["q"], [F.col("label"), F.col("id")], 50, "_n")
    return _offer(hit, score).unionByName(_offer(ordered, PREFIX + 20 - 0.1 * (F.col("_n") - 1)))


def edits(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of pairs of words, a swap of neighbours being one edit; all pairs are worked out together, cell by cell."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, columns = int(n.max(initial=0)), int(m.max(initial=0))
    letters = lambda words, width: np.array([[ord(c) for c in w.ljust(width, "\0")] for w in words], np.int64).reshape(len(words), width)
    x, y = letters(a, rows), letters(b, columns)
    table = np.zeros((rows + 1, columns + 1, len(a)), np.int64)
    table[:, 0] = np.arange(rows + 1)[:, None]
    table[0] = np.arange(columns + 1)[:, None]
    for i in range(1, rows + 1):
        for j in range(1, columns + 1):
            best = np.minimum(np.minimum(table[i - 1, j], table[i, j - 1]) + 1, table[i - 1, j - 1] + (x[:, i - 1] != y[:, j - 1]))
            if i > 1 and j > 1:
                swap = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                best = np.where(swap, np.minimum(best, table[i - 2, j - 2] + 1), best)
            table[i, j] = best
    return table[n, m, np.arange(len(a))]


def within_edits(a, b) -> Column:
    """The distance over Arrow batches of pairs that letters in common have brought together; null if either is."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = list(zip(x.to_pylist(), y.to_pylist(), strict=True))
        known = [k for k, p in enumerate(pairs) if None not in p]
        out: list[int | None] = [None] * len(pairs)
        for at in range(0, len(known), 2000):
            some = known[at : at + 2000]
            for k, d in zip(some, edits([pairs[k][0] for k in some], [pairs[k][1] for k in some]).tolist(), strict=True):
                out[k] = d
        return pa.array(out, pa.int32())

    return F.arrow_udf(run, "int")(geo.col(a), geo.col(b))


def text_fit(queries: DataFrame, docs: DataFrame, index: DataFrame, strong: DataFrame, most: int = 60, known: DataFrame | None = None) -> DataFrame:
    """Offers by names: every word whole, the last a prefix, some within their edits, or only some.

    Typos count only for queries that match nothing whole and have no strong reading (`strong`(q)).
    index and known: from `inverted_index` and `spellings`, worked out here or read from a kept index."""
    q = queries.select(tx.norm_query("q").alias("q")).distinct().withColumn("ws", tx.fold_words("q")).where(F.exists("ws", lambda w: w.rlike(r"\p{L}")))
    w = q.select("q", F.size("ws").alias("n"), F.posexplode("ws").alias("i", "w"))
    whole = w.join(index, w["w"] == index["word"]).select("q", "n", "i", "kind", "id", "word", "impact", F.lit(0).alias("edits"), F.lit(False).alias("prefix"))
    last = w.where((F.col("i") == F.col("n") - 1) & ((F.length("w") >= 2) | (F.col("n") > 1))).withColumn("_h", F.substring("w", 1, 2))
    heads = index.withColumn("_h", F.explode(F.array_distinct(F.array(F.substring("word", 1, 2), F.substring("word", 1, 1)))))
    begun = last.join(heads, "_h").where(F.col("word").startswith(F.col("w")) & (F.col("word") != F.col("w"))).select("q", "n", "i", "kind", "id", "word", "impact", F.lit(0).alias("edits"), F.lit(True).alias("prefix"))
    hits = whole.unionByName(begun)
    done = whole.groupBy("q", "n", "kind", "id").agg(F.countDistinct("i").alias("m")).where("m = n").select("q").union(strong.select("q")).distinct()
    budget = tx.edits_allowed_swaps("w")
    loose = w.join(done, "q", "left_anti").withColumn("_b", budget).where("_b > 0")
    typed = loose.select("w", "_b").distinct().withColumn("key", F.explode(F.when(F.col("_b") == 1, without_letters(F.col("w"), 1)).otherwise(without_letters(F.col("w"), 2))))
    pairs = typed.join(known if known is not None else spellings(index), "key").where("word <> w").select("w", "_b", "word").distinct()
    # plain edits bound the distance with swaps from above by twice; drop the hopeless before the exact test
    pairs = pairs.where(F.levenshtein("word", "w") <= 2 * F.col("_b")).withColumn("edits", within_edits("w", "word")).where(F.col("edits") <= F.col("_b"))
    near = loose.join(pairs.drop("_b"), "w").join(index, "word").select("q", "n", "i", "kind", "id", "word", "impact", "edits", F.lit(False).alias("prefix"))
    hits = hits.unionByName(near)
    best = top_k(hits, ["q", "kind", "id", "i"], [F.col("edits"), F.col("prefix"), F.desc("impact"), F.col("word")], 1, "_k")
    fit = best.groupBy("q", "n", "kind", "id").agg(F.count(F.lit(1)).alias("m"), F.max("edits").alias("worst"), F.bool_or("prefix").alias("begun"), F.sum("impact").alias("bm25"))
    fit = fit.join(docs.select("kind", "id", "label", "pop", "phrases"), ["kind", "id"])
    fit = top_k(fit, ["q"], [F.desc(F.round(F.col("bm25") + 0.6 * F.log1p("pop"), 9)), F.col("kind"), F.col("id")], most, "_k")
    rel = 3.0 * F.col("bm25") / F.max("bm25").over(Window.partitionBy("q"))
    name = F.array_contains("phrases", tx.phrase("q"))
    score = F.when(F.col("m") < F.col("n"), SOME + 150 * F.col("m") / F.col("n") + _lift(6.0)).when(F.col("worst") == 1, TYPO1 + _lift(12.0)).when(F.col("worst") > 1, TYPO2 + _lift(12.0)).when(F.col("begun"), PREFIX + _lift(12.0)).otherwise(WHOLE + F.when(name, WHOLE_NAME).otherwise(0) + _lift(6.0))
    return _offer(fit, score + rel)


def nearness(lat, lon, near_lat, near_lon) -> Column:
    """Up to 15 within 300 km of the asker."""
    km = geo.haversine(lat, lon, near_lat, near_lon)
    return F.coalesce(15.0 * F.greatest(F.lit(0.0), 1 - km / 300), F.lit(0.0))


def best_per_document(offers: DataFrame) -> DataFrame:
    return offers.groupBy("q", "kind", "id").agg(F.max("score").alias("score"), F.first("label").alias("label"))


ABOUT = {"flight": "flight", "route": "flight", "fleet": "aircraft", "registration": "aircraft", "airline_place": "flight", "type": "type", "city": "airport"}


def search(queries: DataFrame, docs: DataFrame, types: DataFrame, cities: DataFrame, families: DataFrame, limit: int = 20, checkpoint=lambda df: df, index: DataFrame | None = None, known_words: DataFrame | None = None) -> DataFrame:
    """(q, rank, kind, id, label, score) of every query; queries(q[, lat, lon]) may say where the asker is. `index` and
    `known_words`: postings and spellings of a kept index (`open_index`), else made from the documents."""
    read = checkpoint(readings(queries, docs, types, cities, families))
    offers = score_readings(read, docs)
    kind = F.create_map(*[x for k, v in ABOUT.items() for x in (F.lit(k), F.lit(v))])
    first = offers.where("reading is not null").join(read.select("q", "reading", "place"), ["q", "reading"]).groupBy("q").agg(F.min_by("reading", "place").alias("r")).select("q", F.try_element_at(kind, F.col("r")).alias("about"))
    named = queries.select(tx.norm_query("q").alias("q")).distinct().withColumn("phrase", F.array_join(tx.fold_words("q"), " "))
    known = named.join(place_phrases(docs, cities).select("phrase").union(airline_phrases(docs).select("phrase")).distinct(), "phrase", "left_semi")
    so_far = checkpoint(offers.drop("reading").unionByName(score_codes(queries, docs, first, known).drop("reading")))
    strong = so_far.where(F.col("score") >= INTENT - 2 * STEP).select("q").distinct()
    every = so_far.unionByName(text_fit(queries, docs, index if index is not None else checkpoint(inverted_index(docs)), strong, known=known_words).drop("reading"))
    if {"lat", "lon"} <= set(queries.columns):
        asker = queries.select(tx.norm_query("q").alias("q"), F.col("lat").alias("_la"), F.col("lon").alias("_lo")).dropDuplicates(["q"])
        every = every.join(asker, "q").join(docs.select("kind", "id", "lat", "lon"), ["kind", "id"]).withColumn("score", F.col("score") + nearness("lat", "lon", "_la", "_lo")).select("q", "kind", "id", "label", "score")
    return fused(every, limit)


def fused(offers: DataFrame, limit: int = 20) -> DataFrame:
    """(q, rank, kind, id, label, score): the best offer of each document, in the order of the page."""
    return interleave(best_per_document(offers)).where(F.col("rank") <= limit).select("q", "rank", "kind", "id", "label", "score")
