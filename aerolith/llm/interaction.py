"""Filter interaction audit: what each filter removes in every order in which they can be applied.

Five conditions give each document a mask of five bits. All that any order can do to a
document depends on its mask alone, so documents are counted once by (part, mask); at
most 32 cells a part are left, whatever the input. A recursive common table expression
then extends the empty order by each unused letter, joins the cells of the part and
carries the bits applied so far; every level of the recursion emits the figures of its
step. The 120 full orders take the figures of their five beginnings.

Conditions (null text: the empty text; a word is a maximal run of ``[^\\x20\\x09-\\x0D]``):
A under 100 words; B 100 * distinct words < 80 * words; C 100 * ``[A-Z]`` > 10 * code
points; D holds any of ``#$%&*|``; E the same text as a row with a smaller id, table-wide.

Equal texts are told by SHA-256; only digests that more than one row has are joined back,
over `SALTS` copies, so a text that many rows hold is dealt over as many tasks.

Defined results: a null part is the empty string; a null id is not larger than any id, and
none is larger than it; rows that repeat an id and its text are not copies of each other
(no id is smaller) and count as often as they occur; an id labelled more than once counts
as good or toxic if any of its labels says so; labels of unknown ids, null labels and other
values count for nothing; an empty table has no parts and gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import dropped, stored

SALTS = 16
LETTERS = "ABCDE"
BLANKS = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def text_mask(text: Column) -> Column:
    """Bits of the conditions A to D, which a text decides alone."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, BLANKS), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(t) - F.length(F.translate(t, UPPER, ""))
    tests = (n < 100, 100 * different < 80 * n, 100 * upper > 10 * F.length(t), t.rlike("[#$%&*|]"))
    return sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)), F.lit(0))


def _marked(docs: DataFrame, folders: list[str], id: str, text: str, part: str) -> DataFrame:
    """(id, part, mask) of every row, with all five bits."""
    t = F.coalesce(F.col(text), F.lit(""))
    slim = stored(docs.select(F.col(id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_mask(F.col(text)).alias("mask"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest")), folders)
    first = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salted = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = slim.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    return rows.select("id", "part", F.when(F.col("id") > F.col("first"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, folders: list[str], *, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, cells: array of (mask, n, good, toxic)); the written tables' folders are added to `folders`."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    known = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = _marked(docs, folders, id, text, part)
    named = rows.where("id is not null").join(known, "id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rest = rows.where("id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))  # they can have no label
    each = named.unionByName(rest).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    return stored(each.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), folders)


def _total(field: str, where: str) -> str:
    return f"aggregate(filter(c.cells, x -> {where}), 0L, (a, x) -> a + x.{field})"


_BITS = ", ".join(f"('{letter}', {1 << k})" for k, letter in enumerate(LETTERS))
_HERE = "(x.mask & r.applied) = 0 AND (x.mask & l.bit) <> 0"

RECURSION = f"""
WITH RECURSIVE letters(letter, bit) AS (SELECT * FROM VALUES {_BITS}),
r(part, prefix, letter, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT c.part, CAST('' AS STRING), CAST('' AS STRING), 0, 0, {_total("n", "true")}, 0L, 0L, 0L, 0L, 0L FROM {{cells}} c
  UNION ALL
  SELECT r.part, concat(r.prefix, l.letter), l.letter, r.applied | l.bit, r.step + 1,
    {_total("n", "(x.mask & (r.applied | l.bit)) = 0")},
    {_total("n", _HERE)},
    {_total("n", "(x.mask & r.applied) <> 0 AND (x.mask & l.bit) <> 0")},
    {_total("n", "x.mask = l.bit")},
    {_total("good", _HERE)},
    {_total("toxic", _HERE)}
  FROM r JOIN letters l ON (r.applied & l.bit) = 0 JOIN {{cells}} c ON c.part = r.part)
SELECT * FROM r WHERE step > 0
"""


def prefixes(found: DataFrame, folders: list[str]) -> DataFrame:
    """The figures of each beginning of an order (325 a part), from `cells`, written once."""
    conf = found.sparkSession.conf
    was = conf.get(ROW_LIMIT)
    conf.set(ROW_LIMIT, "-1")  # it counts rows of all parts together; the recursion ends at five letters anyway
    try:
        return stored(found.sparkSession.sql(RECURSION, cells=found), folders)
    finally:
        conf.set(ROW_LIMIT, was)


def interaction_audit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per part, order and step: filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    folders: list[str] = []
    steps = prefixes(cells(docs, labels, folders, id=id, text=text, part=part), folders)
    dropped(docs.sparkSession, folders[:-1])
    # a letter's removals over all orders: a beginning of k letters stands in (5 - k)! of them
    orders = F.element_at(F.array(*[F.lit(n) for n in (24, 6, 2, 1, 1)]), F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    whole = steps.where("step = 5").select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    whole = whole.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    out = whole.join(steps.drop("step", "applied"), ["part", "prefix"]).join(shapley, ["part", "letter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
y AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
  (len(ws) < 100)::INT + 2 * (100 * list_unique(ws) < 80 * len(ws))::INT + 4 * (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, false)::INT AS mask FROM w LEFT JOIN y USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM m GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1 : i - 1]), 0)::INT AS applied FROM (SELECT *, unnest(range(1, 6))::INT AS i FROM o)),
f AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE mask & (applied | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & applied = 0 AND mask & bit > 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE mask & applied > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & applied = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE mask & applied = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM f
"""
