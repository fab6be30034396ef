"""First search: a table of queries against schedule, registries, airports and airlines, branch by branch.

Every branch is an equi join with the exact test after it, on a code, on a typed prefix that the other side's values
have among theirs, or, for near misses, on what is left of a word without some of its letters; results are ranked per
query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import text as tx
from aerolith.operators.aggregates import airport_traffic, fleet_members
from aerolith.operators.filters import query_shape
from aerolith.operators.windows import top_k

# Fixed values of the ranking.
EXACT, PREFIX, WORD, NEAR, PER_KIND = 100, 60, 40, 20, 5
KIND_ORDER = {"flight": 0, "aircraft": 1, "airport": 2, "airline": 3}
HEAD, REACH = 2, 12


def normalized(queries: DataFrame) -> DataFrame:
    """queries(q) with `term` (canonical, spaced flight numbers joined), `folded` and the kinds it may mean; one row a spelling."""
    n = queries.select(tx.norm_query("q").alias("q")).where(F.length("q") >= 2).distinct()
    t = n.withColumn("term", tx.compact_flight("q")).withColumn("folded", tx.fold("term"))
    return query_shape(t, "term")


def item(kind: str, id_: Column, label: Column, detail: Column, score: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), id_.alias("id"), label.alias("label"), detail.alias("detail"), score.cast("double").alias("score")]


def prefixed(queries: DataFrame, q: Column, table: DataFrame, value: str) -> DataFrame:
    """Pairs where `value` starts with q: of each value every prefix from HEAD to REACH characters meets the queries that are one; a longer query meets by its first REACH."""
    left = queries.withColumns({"_q": q}).where(F.length("_q") >= HEAD).withColumn("_h", F.substring("_q", 1, REACH))
    sizes = F.sequence(F.lit(HEAD), F.least(F.length(value), F.lit(REACH)))
    right = table.where(F.length(value) >= HEAD).withColumn("_h", F.explode(F.transform(sizes, lambda n: F.substring(F.col(value), F.lit(1), n))))
    return left.join(right, "_h").where(F.col(value).startswith(F.col("_q"))).drop("_h")


def _identity(rows: DataFrame, types: DataFrame, airlines: DataFrame) -> DataFrame:
    j = rows.join(types.select(F.col("designator").alias("type_code"), F.col("name").alias("type_name")), "type_code", "left").join(airlines.select(F.col("icao").alias("operator_icao"), F.col("name").alias("airline")), "operator_icao", "left")
    detail = F.nullif(F.concat_ws(" · ", F.coalesce("type_name", "type_code"), F.coalesce("airline", "operator_name")), F.lit(""))
    return j.withColumns({"_detail": detail, "_label": F.coalesce("registration", F.upper("hex"))})


def match_registration(queries: DataFrame, ref: DataFrame) -> DataFrame:
    """(q, hex, ..., score, step): registrations that start with the term, or without dashes once the term has a digit."""
    plain = prefixed(queries.where("is_aircraft"), F.col("term"), ref, "registration").withColumns({"score": F.when(F.col("registration") == F.col("term"), EXACT).otherwise(PREFIX), "step": F.lit(0)})
    bare = ref.withColumn("_bare", F.regexp_replace("registration", "-", ""))
    typed = queries.where("is_aircraft and not contains(term, '-') and term rlike '[0-9]'")
    loose = prefixed(typed, F.col("term"), bare, "_bare").drop("_bare").withColumns({"score": F.lit(PREFIX), "step": F.lit(1)})
    return plain.unionByName(loose)


def match_hex(queries: DataFrame, ref: DataFrame) -> DataFrame:
    """Addresses that start with a term of three or more hex digits."""
    typed = queries.where("is_aircraft and term rlike '^[0-9A-F]{3,}$'")
    return prefixed(typed, F.lower("term"), ref, "hex").withColumns({"score": F.when(F.col("hex") == F.lower("term"), EXACT).otherwise(PREFIX), "step": F.lit(2)})


def match_aircraft(queries: DataFrame, ref: DataFrame, types: DataFrame, airlines: DataFrame) -> DataFrame:
    """Registrations first, then those without dashes, then addresses; five in all."""
    rows = match_registration(queries, ref).unionByName(match_hex(queries, ref))
    first = top_k(rows, ["q", "hex"], [F.col("step")], 1, "_r")
    kept = top_k(first, ["q"], [F.col("step"), F.col("registration"), F.col("hex")], PER_KIND, "place")
    return _identity(kept, types, airlines).select("q", "place", *item("aircraft", F.col("hex"), F.col("_label"), F.col("_detail"), F.col("score")))


def match_fleet(queries: DataFrame, ref: DataFrame, types: DataFrame, airlines: DataFrame) -> DataFrame:
    """An operator and a type in either order; five airframes by registration."""
    w = F.split("term", " ")
    both = queries.where("is_pair").select("q", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.get(w, F.lit(0)).alias("a"), F.get(w, F.lit(1)).alias("t")), F.struct(F.lit(1).alias("turn"), F.get(w, F.lit(1)).alias("a"), F.get(w, F.lit(0)).alias("t")))).alias("o")).select("q", "o.*")
    al = airlines.withColumn("_n", tx.fold("name"))
    codes = both.join(al.select(F.explode(F.array_compact(F.array("icao", "iata"))).alias("a"), "icao", "name"), "a")
    names = prefixed(both, tx.fold("a"), al, "_n").select("q", "turn", "a", "t", "icao", "name")
    who = top_k(codes.select("q", "turn", "a", "t", "icao", "name").union(names), ["q", "turn"], [F.col("name"), F.col("icao")], 1, "_r").drop("_r")
    ty = types.select("designator", F.explode(F.array_distinct(F.concat(F.array("designator"), F.split(F.upper("name"), r"[^A-Z0-9]+")))).alias("t"))
    fits = who.join(ty, "t").select("q", "turn", "icao", "designator").distinct()
    turn = fits.groupBy("q").agg(F.min("turn").alias("turn"))
    members = fleet_members(ref, airlines)
    m = fits.join(turn, ["q", "turn"]).join(members.withColumnRenamed("type_code", "designator"), ["icao", "designator"]).join(ref, "hex")
    kept = top_k(m.select("q", *ref.columns).distinct(), ["q"], [F.col("registration"), F.col("hex")], PER_KIND, "place")
    return _identity(kept, types, airlines).select("q", "place", *item("aircraft", F.col("hex"), F.col("_label"), F.col("_detail"), F.lit(WORD)))


def flight_prefixes(queries: DataFrame, airlines: DataFrame) -> DataFrame:
    """(q, p): the number as typed, and an IATA number as its ICAO callsign."""
    f = queries.where("is_flight").select("q", F.regexp_replace("term", " ", "").alias("p"))
    codes = airlines.where("iata is not null").groupBy(F.col("iata").alias("_c")).agg(F.max("icao").alias("_icao"))
    other = f.where("substring(p, 3, 1) rlike '[0-9]'").withColumn("_c", F.substring("p", 1, 2)).join(codes, "_c").select("q", F.concat("_icao", F.expr("substring(p, 3)")).alias("p"))
    return f.union(other).distinct()


def match_flight(queries: DataFrame, schedule: DataFrame, airlines: DataFrame) -> DataFrame:
    """Callsigns of the timetable by prefix: of each spelling the exact one and the busiest five."""
    per = schedule.groupBy("callsign").agg(F.sum("n_flights").alias("n"), F.min("org").alias("org"), F.min("dst").alias("dst"), F.count(F.lit(1)).alias("legs"))
    j = prefixed(flight_prefixes(queries, airlines), F.col("p"), per, "callsign").withColumn("exact", F.col("callsign") == F.col("p"))
    best = top_k(j, ["q", "p"], [F.desc("exact"), F.desc("n"), F.col("callsign")], PER_KIND, "_r").where("callsign rlike '[0-9]'")
    score = F.when(F.col("exact"), EXACT).otherwise(PREFIX) + tx.lift("n")
    route = F.when(F.col("legs") == 1, F.concat_ws(" → ", "org", "dst")).otherwise(F.concat(F.col("legs"), F.lit(" legs")))
    rows = best.select("q", *item("flight", F.col("callsign"), F.col("callsign"), F.concat(route, F.lit(" · "), F.col("n"), F.lit(" flights")), score))
    return top_k(rows, ["q", "id"], [F.desc("score")], 1, "_r").drop("_r")


def match_flight_log(queries: DataFrame, legs: DataFrame, schedule: DataFrame, airlines: DataFrame) -> DataFrame:
    """Numbers that only the flight log knows, a point below; asked only of terms with a digit."""
    per = legs.where("callsign is not null").groupBy("callsign").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last")).join(schedule.select("callsign"), "callsign", "left_anti")
    j = prefixed(flight_prefixes(queries.where("term rlike '[0-9]'"), airlines), F.col("p"), per, "callsign")
    best = top_k(j, ["q", "p"], [F.desc("n"), F.col("callsign")], PER_KIND, "_r")
    score = F.when(F.col("callsign") == F.col("p"), EXACT).otherwise(PREFIX) + tx.lift("n") - 1
    return best.select("q", *item("flight", F.col("callsign"), F.col("callsign"), F.concat(F.col("n"), F.lit(" flights, last "), F.col("last").cast("string")), score))


def searchable(airports: DataFrame, schedule: DataFrame) -> DataFrame:
    """Large and medium fields with their code, folded names and traffic; a table that has them already stays as it is."""
    if "busy" in airports.columns:
        return airports
    a = airports.where("kind in ('large_airport', 'medium_airport')").withColumn("code", F.coalesce("iata", "ident"))
    a = a.join(airport_traffic(schedule), "code", "left").withColumn("traffic", F.coalesce("traffic", F.lit(0)))
    return a.withColumns({"_name": tx.fold("name"), "_city": tx.fold("municipality"), "busy": (F.col("kind") == "large_airport") & (F.col("traffic") > 0)})


def _name_starts(table: DataFrame, columns: list[str], codes: list[str]) -> DataFrame:
    """Every text a query may begin: whole names (starts) and names from a later word on (word), and codes (exact)."""
    starts = [F.struct(F.lit("starts").alias("how"), F.col(c).alias("text")) for c in columns]
    exact = [F.struct(F.lit("exact").alias("how"), F.col(c).alias("text")) for c in codes]
    words = F.split(columns[0], " ")
    later = F.transform(F.when(F.size(words) > 1, F.sequence(F.lit(2), F.size(words))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit("word").alias("how"), F.array_join(F.slice(words, i, F.size(words)), " ").alias("text")))
    return table.withColumn("_e", F.explode(F.concat(F.array(*starts, *exact), later))).select("*", "_e.how", "_e.text").drop("_e").where("text is not null")


def _classed(queries: DataFrame, table: DataFrame, key: str, columns: list[str], codes: list[str]) -> DataFrame:
    """(q, row, cls): the best way in which each row fits each query."""
    parts = _name_starts(table, columns, codes)
    names = prefixed(queries, F.col("folded"), parts.where("how <> 'exact'"), "text")
    exact = queries.withColumn("text", F.col("term")).join(parts.where("how = 'exact'"), "text").withColumn("_q", F.col("text"))
    busy = F.col("busy") if "busy" in table.columns else F.lit(False)
    score = F.when(F.col("how") == "exact", EXACT).when(F.col("how") == "starts", PREFIX).when(busy, PREFIX).otherwise(WORD)
    j = names.unionByName(exact.select(*names.columns)).withColumn("cls", score)
    return top_k(j, ["q", key], [F.desc("cls")], 1, "_r").drop("_r", "how", "text", "_q")


def match_airport(queries: DataFrame, airports: DataFrame, schedule: DataFrame) -> DataFrame:
    """Exact codes, then names and cities that start so (or a word of a busy large field), then words; busiest first. `whole`: a whole code or word."""
    a = searchable(airports, schedule)
    j = _classed(queries.where("is_airport"), a, "ident", ["_name", "_city"], ["iata", "ident"])
    kept = top_k(j, ["q"], [F.desc("cls"), F.desc("traffic"), F.col("iata").isNull(), F.col("name"), F.col("ident")], PER_KIND, "place")
    whole = (F.col("cls") == EXACT) | tx.whole_word("_name", "folded") | tx.whole_word("_city", "folded")
    return kept.select("q", "place", whole.alias("whole"), *airport_item("cls"))


def airport_item(cls: str) -> list[Column]:
    detail = F.nullif(F.concat_ws(" · ", "municipality", "iso_country"), F.lit(""))
    score = F.col(cls) + tx.lift("traffic") + F.when(F.col("iata").isNotNull(), 2).otherwise(0)
    return item("airport", F.col("code"), F.concat(F.coalesce("name", "code"), F.lit(" ("), F.col("code"), F.lit(")")), detail, score)


def match_airline(queries: DataFrame, airlines: DataFrame) -> DataFrame:
    a = airlines.withColumn("_name", tx.fold("name"))
    j = _classed(queries.where("is_airline"), a, "icao", ["_name"], ["icao", "iata"])
    kept = top_k(j, ["q"], [F.desc("cls"), F.col("iata").isNull(), F.col("name"), F.col("icao")], PER_KIND, "place")
    whole = (F.col("cls") == EXACT) | tx.whole_word("_name", "folded")
    return kept.select("q", "place", whole.alias("whole"), *airline_item("cls"))


def airline_item(cls: str) -> list[Column]:
    return item("airline", F.col("icao"), F.col("name"), F.concat_ws(" · ", "icao", "iata"), F.col(cls) + F.when(F.col("iata").isNotNull(), 2).otherwise(0))


def place_to_airport(words: DataFrame, airports: DataFrame, schedule: DataFrame) -> DataFrame:
    """(word, code): the field a code, city or name stands for; exact codes first, then the busiest."""
    q = words.select(F.col("word").alias("q"), F.col("word").alias("term"), tx.fold("word").alias("folded"))
    j = _classed(q, searchable(airports, schedule), "ident", ["_name", "_city"], ["iata", "ident"]).where((F.col("cls") > WORD))
    return top_k(j, ["q"], [F.col("cls") != EXACT, F.desc("traffic"), F.col("ident")], 1, "_r").select(F.col("q").alias("word"), "code")


def match_route(queries: DataFrame, airports: DataFrame, schedule: DataFrame) -> DataFrame:
    """Two places as the flight numbers between them, the busiest five."""
    p = queries.withColumn("_p", tx.places("term")).where("_p is not null").select("q", F.col("_p.origin").alias("a"), F.col("_p.dest").alias("b"))
    codes = place_to_airport(p.select(F.explode(F.array("a", "b")).alias("word")).distinct(), airports, schedule)
    j = p.join(codes.select(F.col("word").alias("a"), F.col("code").alias("org")), "a").join(codes.select(F.col("word").alias("b"), F.col("code").alias("dst")), "b").where("org <> dst")
    rows = top_k(j.join(schedule, ["org", "dst"]), ["q"], [F.desc("n_flights"), F.col("callsign")], PER_KIND, "place")
    detail = F.concat(F.concat_ws(" → ", "org", "dst"), F.lit(" · "), F.col("n_flights"), F.lit(" flights"))
    return rows.select("q", "place", *item("flight", F.col("callsign"), F.col("callsign"), detail, WORD + tx.lift("n_flights")))


def without_letters(word: Column, most: int) -> Column:
    """The word and what is left of it without one letter, or (most = 2) two. Words within that many edits, swaps of neighbours counted as one, have one of these in common."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = less(word)
    two = F.flatten(F.transform(one, less)) if most > 1 else F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(word), one, two))


def _near(queries: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a word of four letters or more within the edit budget."""
    words = F.array_distinct(F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), r"\s+") for c in columns])))
    w = table.withColumn("_w", F.explode(words)).where(F.length("_w") >= 4)
    budget = tx.edits_allowed("folded")
    typed = queries.select("folded").distinct().withColumn("_k", F.explode(F.when(budget == 1, without_letters(F.col("folded"), 1)).otherwise(without_letters(F.col("folded"), 2))))
    known = w.select("_w").distinct().withColumn("_k", F.explode(without_letters(F.col("_w"), 2)))
    pairs = typed.join(known, "_k").select("folded", "_w").distinct().where(F.levenshtein("_w", "folded") <= budget)
    return queries.join(pairs, "folded").join(w, "_w").drop("_w")


def near_airport(queries: DataFrame, airports: DataFrame, schedule: DataFrame) -> DataFrame:
    j = _near(queries, searchable(airports, schedule), ["_name", "_city"]).dropDuplicates(["q", "ident"]).withColumn("cls", F.lit(NEAR))
    return top_k(j, ["q"], [F.desc("traffic"), F.col("ident")], PER_KIND, "place").select("q", "place", *airport_item("cls"))


def near_airline(queries: DataFrame, airlines: DataFrame) -> DataFrame:
    j = _near(queries, airlines.withColumn("_name", tx.fold("name")), ["_name"]).dropDuplicates(["q", "icao"]).withColumn("cls", F.lit(NEAR))
    return top_k(j, ["q"], [F.col("name"), F.col("icao")], PER_KIND, "place").select("q", "place", *airline_item("cls"))


def rank_results(results: DataFrame) -> DataFrame:
    """Score, then kind, then each branch's own order; scores to one digit."""
    order = F.create_map(*[x for k, v in KIND_ORDER.items() for x in (F.lit(k), F.lit(v))])
    by = Window.partitionBy("q").orderBy(F.desc("score"), F.try_element_at(order, F.col("kind")), F.col("place").asc_nulls_last(), F.col("id"))
    return results.select("q", F.row_number().over(by).alias("rank"), "kind", "id", "label", "detail", F.bround("score", 1).alias("score"))


def search(queries: DataFrame, *, schedule: DataFrame, airports: DataFrame, airlines: DataFrame, types: DataFrame, airframes_ref: DataFrame, legs: DataFrame, checkpoint=lambda df: df) -> DataFrame:
    """Ranked results of every query; near misses only where nothing matched a whole code or word.

    `checkpoint` cuts the plan after each branch, which later ones read again."""
    q = checkpoint(normalized(queries))
    airports = checkpoint(searchable(airports, schedule))
    fl = checkpoint(match_flight(q, schedule, airlines))
    counted = q.join(fl.groupBy("q").agg(F.count(F.lit(1)).alias("_n")), "q", "left").where(F.coalesce("_n", F.lit(0)) < PER_KIND).drop("_n")
    flights = top_k(fl.unionByName(match_flight_log(counted, legs, schedule, airlines)), ["q"], [F.desc("score"), F.col("id")], PER_KIND, "place")
    ap, al = checkpoint(match_airport(q, airports, schedule)), checkpoint(match_airline(q, airlines))
    out = None
    for part in (match_route(q, airports, schedule), match_fleet(q, airframes_ref, types, airlines), match_aircraft(q, airframes_ref, types, airlines), flights, ap.drop("whole"), al.drop("whole")):
        part = checkpoint(part)
        out = part if out is None else out.unionByName(part)
    whole = ap.where("whole").select("q").union(al.where("whole").select("q")).union(out.where(F.col("score") >= EXACT).select("q")).distinct()
    missed = q.where("length(term) >= 4").where(F.col("term").rlike(r"^\p{L}+$")).join(whole, "q", "left_anti")
    near = near_airport(missed.where("is_airport").join(ap.select("q"), "q", "left_anti"), airports, schedule).unionByName(near_airline(missed.where("is_airline").join(al.select("q"), "q", "left_anti"), airlines))
    return rank_results(out.unionByName(near))
