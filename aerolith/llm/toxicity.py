"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insults and verbs of harm (with a weight), words for those who are
addressed or spoken of, negations, reporting verbs, quotes and commas. Three transducers
are composed into one (see `transducer`): negation marks what stands within `SCOPE` words
after a negation; reported speech marks what follows a reporting verb or stands in
quotes; the target transducer tells aimed insults ("you ...", "... you") from others, and
takes a verb of harm for a threat only where a target follows. A clause's strength in a
kind of match is the largest weight of its words of that kind, and a little for further ones. A document's score is
a logistic function of its strongest clause in each kind, the number of further clauses
and its length.

Learned from labelled rows: the weights of words, the weights of the kinds, nothing else.
A word, or a beginning that several words share (`LEAST_WORDS`, 3 to 12 characters), is
taken for an insult if it is found in toxic documents far more often than in others. The
evidence is the number of documents or, if less, of different neighbourhoods (by a bitmap
of 64), as all copies of a text have the same. The weight is the lower end of the log
odds' range. The kinds' weights are fitted on one half of the sample with words learned
from the other, by ridge regression toward `PRIOR`.

Bounds, all parameters: each class gives about `sample_bytes` of text and `sample_docs`
documents, by the hashes of ids and texts; at most `max_candidates` words and beginnings are
looked at and `max_entries` kept, those with most evidence. Every text is scored whole.

Defined results: null and empty texts have the features of no words and get a score like
any other; rows without a label, or with one other than 0 and 1, teach nothing; a
document labelled twice with one label counts once, with both for both; repeated rows
each get the same score; without toxic labels only the fixed words count; words of any
length are read in linear time; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import dropped, give_back, rows_udf, stored
from aerolith.llm.transducer import Transducer, compose, transducer

# Fixed words, in English, German, French and Spanish.
TARGETS = "you your yours yourself he him she her they them these those du dich dir euch ihr sie ihn ihm tu toi te vous il elle ils elles eux tú usted ustedes vosotros él ella ellos ellas"
NEGATIONS = "not no never none nobody isn't aren't wasn't weren't don't doesn't didn't won't can't cannot nicht kein keine keinen nie niemals pas jamais aucun aucune ni nunca jamás ningún ninguna"
REPORTING = "said says say saying told tells called calls wrote writes quoted quotes claimed claims reported according alleged sagte sagt nannte schrieb laut dit disait écrit selon appelé dijo dice llamó escribió según"
HARM = "kill killing murder hurt strangle stab shoot beat töten umbringen schlagen erschießen tuer tuerai frapper égorger matar mataré golpear"
SEEDS = "idiot moron scum loser arschloch trottel connard salaud imbécile gilipollas cabrón"
SEED_WEIGHT, HARM_WEIGHT = 2.0, 3.0

SCOPE, NEAR, AFTER, HARM_AFTER = 4, 4, 2, 3  # words that a negation, a target before, a target after and a victim reach
MORE = 0.5  # for the logarithm of a clause's words of one kind
LEAST_WORDS, OWED = 4, 0.7
SHORTEST, LONGEST = 3, 12
KINDS = "panrtux"  # insult: plain, aimed, negated, reported; threat: plain, negated or reported; x: no match
FEATURES = len(KINDS) - 1 + 2
PRIOR = np.array([1.0, 1.2, 0.2, 0.3, 1.0, 0.2, 0.3, 0.0, -3.5])  # of the features and the constant

FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 or c == 0x27 else 0x20 for c in range(256))
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
CLAUSE_END = regex.compile(rb"[.!?;\n\r]")
TOKEN = regex.compile(rb"[a-z'\x80-\xff]+|[,:()]|\"")
PLAIN = (("“", '"'), ("”", '"'), ("„", '"'), ("«", '"'), ("»", '"'), ("’", "'"), ("‘", "'"), (" ", " "), ("…", "."), ("—", ","), ("–", ","))


def folded(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and typographic marks as plain ones."""
    text = text or ""
    if not text.isascii():
        for a, b in PLAIN:
            text = text.replace(a, b)
    return text.encode().translate(LOWER)


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(b"'") for w in text.translate(FOLD).split()] if b"'" in text else text.translate(FOLD).split()


# --- the grammar ------------------------------------------------------------------------------------------------------
# symbols: o other word, i insult, h harm, t target, n negation, r reporting verb, q quote, c comma


def _negation() -> Transducer:
    def step(left: int, s: str):
        if s == "n":
            return SCOPE, (("o", 1.0),)
        if s in "qc":
            return (0 if s == "c" else left), ((s, 1.0),)
        return max(0, left - 1), (((s.upper() if left and s in "ih" else s), 1.0),)

    return transducer(0, "oihtnrqc", step, lambda _: ())


def _reported() -> Transducer:
    """Writes J and K for reported insults and harm, negated or not."""
    marks = {"i": "J", "I": "J", "h": "K", "H": "K"}

    def step(state: str, s: str):
        if s == "q":
            return ("" if state == "quoted" else "quoted"), ()
        if s == "r":
            return state or "told", (("o", 1.0),)
        return state, ((marks.get(s, s) if state else s, 1.0),)

    return transducer("", "oihIHtrqc", step, lambda _: ())


def _targets(weights: tuple[float, ...]) -> Transducer:
    """Writes one kind for each insult or harm word, in their order, with the kind's weight."""
    weight = dict(zip(KINDS, (*weights, 0.0), strict=True))
    alone = {"i": "p", "I": "n", "J": "r", "h": "x", "H": "x", "K": "x"}
    aimed = {"i": "a", "I": "n", "J": "r", "h": "t", "H": "u", "K": "u"}

    def write(kind: str):
        return ((kind, weight[kind]),)

    def step(state: tuple[int, str, int], s: str):
        near, held, left = state
        if s == "c":
            return state, ()
        if s == "t":
            return (NEAR, "", 0), write(aimed[held]) if held else ()
        out = ()
        if held and (s in "iIJhHK" or left == 0):
            out, held = write(alone[held]), ""
        near, left = max(0, near - 1), max(0, left - 1)
        if s in "iIJ" and near:
            return (near, "", 0), (*out, *write(aimed[s]))
        if s in "iIJhHK":
            return (near, s, AFTER if s in "iIJ" else HARM_AFTER), out
        return (near, held, left if held else 0), out

    return transducer((0, "", 0), "oihIHJKtc", step, lambda state: write(alone[state[1]]) if state[1] else ())


@lru_cache(maxsize=8)
def grammar(weights: tuple[float, ...] = (1.0,) * (len(KINDS) - 1)) -> Transducer:
    """Negation, then reported speech, then targets, as one transducer."""
    return compose(compose(_negation(), _reported()), _targets(weights))


# --- the lexicon ------------------------------------------------------------------------------------------------------


@dataclass
class Lexicon:
    words: dict[bytes, float] = field(default_factory=dict)
    starts: dict[bytes, float] = field(default_factory=dict)  # weights of beginnings, cut between characters

    def __post_init__(self) -> None:
        self.fixed = {w.encode(): s for s, of in (("t", TARGETS), ("n", NEGATIONS), ("r", REPORTING), ("h", HARM)) for w in of.split()}
        self.heads = {k[:SHORTEST] for k in self.starts}
        self.known: dict[bytes, float] = {}

    def weight(self, word: bytes) -> float:
        """0 for a word that is no insult."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.words.get(word, 0.0)
            if word[:SHORTEST] in self.heads:
                found = max(found, max((self.starts.get(word[:k], 0.0) for k in range(SHORTEST, min(len(word), 4 * LONGEST) + 1)), default=0.0))
            self.known[word] = found
        return found


def clauses(text: bytes, lexicon: Lexicon, machine: Transducer) -> Iterator[tuple[int, int, list[tuple[str, float]]]]:
    """(start, end, matches) of each clause that holds an insult or a verb of harm; a match is a kind and the product of the word's and the kind's weight."""
    hits = {w for w in set(words_of(text)) if lexicon.weight(w) or lexicon.fixed.get(w) == "h"}
    if not hits:
        return
    at = 0
    for stop in [*(m.start() for m in CLAUSE_END.finditer(text)), len(text)]:
        part, start, at = text[at:stop], at, stop + 1
        if hits.isdisjoint(words_of(part)):
            continue
        symbols, weights = [], []
        for m in TOKEN.finditer(part):
            word = m.group().strip(b"'")
            if not word:
                continue
            w = lexicon.weight(word)
            symbol = "q" if word == b'"' else "c" if word in b",:()" else "i" if w else lexicon.fixed.get(word, "o")
            if symbol in "ih":
                weights.append(w or HARM_WEIGHT)
            symbols.append(symbol)
        found = [(kind, w * v) for (kind, w), v in zip(machine.run(symbols), weights, strict=True)]
        if found := [(k, w) for k, w in found if k != "x"]:
            yield start, stop, found


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The strongest clause in each kind of match, the clauses with a match, and the length."""
    raw = folded(text)
    best, n = [0.0] * (len(KINDS) - 1), 0
    for _, _, found in clauses(raw, lexicon, grammar()):
        n += 1
        here = defaultdict(list)
        for kind, w in found:
            here[kind].append(w)
        for kind, of in here.items():
            k = KINDS.index(kind)
            best[k] = max(best[k], max(of) + MORE * math.log(len(of)))
    return [*best, math.log1p(max(0, n - 1)), math.log1p(raw.count(b" "))]


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray  # of the features and the constant

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.beta[:-1], features(text, self.lexicon)) + self.beta[-1])
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, z))))


# --- learning ---------------------------------------------------------------------------------------------------------


def _characters(word: bytes) -> list[bytes]:
    """Beginnings of SHORTEST to LONGEST characters, shorter than the word."""
    text = word.decode(errors="ignore")
    return [text[:k].encode() for k in range(SHORTEST, min(len(text) - 1, LONGEST) + 1)]


def _evidence(entries: Callable[[bytes], list[bytes]], least_words: int = 0):
    """Partial (entry, docs, bitmap of neighbourhoods, bitmap of words) over texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[bytes, int] = defaultdict(int)
        near: dict[bytes, int] = defaultdict(int)
        kinds: dict[bytes, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            signed = lambda of: pa.array(np.array([of[k] for k in docs], np.uint64).view(np.int64))
            part = pa.RecordBatch.from_arrays([pa.array(docs.keys(), pa.binary()), pa.array(docs.values(), pa.int64()), signed(near), signed(kinds)], names=["entry", "docs", "near", "words"])
            for of in (docs, near, kinds):
                of.clear()
            return part

        for batch in batches:
            for text in batch.column(0):
                words = words_of(folded(text.as_py()))
                seen = set()
                for before, word, after in zip([b"", *words[:-1]], words, [*words[1:], b""]):
                    for e in entries(word):
                        seen.add(e)
                        near[e] |= 1 << (xxhash.xxh3_64_intdigest(before + b" " + after) & 63)
                        kinds[e] |= 1 << (xxhash.xxh3_64_intdigest(word) & 63)
                for e in seen:
                    docs[e] += 1
                if len(docs) > 300_000:
                    yield out()
        yield out()
        give_back()

    return run


def _counted(texts: DataFrame, entries: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(entry, n, words): documents or, if less, neighbourhoods, and about how many words."""
    many = lambda c: F.when(F.bit_count(c) == 64, F.lit(1e18)).otherwise(-64 * F.log(1 - F.bit_count(c) / 64))
    parts = texts.select("text").mapInArrow(_evidence(entries), "entry binary, docs long, near long, words long")
    whole = parts.groupBy("entry").agg(F.sum("docs").alias("docs"), F.bit_or("near").alias("near"), F.bit_or("words").alias("words"))
    return whole.select("entry", F.least(F.col("docs").cast("double"), many(F.col("near"))).alias("n"), many(F.col("words")).alias("words"))


def _own(word: bytes) -> list[bytes]:
    return [word + b"$", *_characters(word)]


def lexicon(sample: DataFrame, *, least: float = 3.0, strength: float = 1.5, z: float = 1.64, max_candidates: int = 200_000, max_entries: int = 50_000) -> Lexicon:
    """sample(label, text). A whole word is an entry with `$` behind it."""
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    counted = _counted(sample.where("label = 1"), _own).where((F.col("n") >= least) & (F.col("entry").endswith(F.lit(b"$")) | (F.col("words") >= LEAST_WORDS)))
    found = {bytes(r["entry"]): r["n"] for r in counted.orderBy(F.desc("n"), "entry").limit(max_candidates).collect()}
    shared = sample.sparkSession.sparkContext.broadcast(set(found))

    def known(word: bytes) -> list[bytes]:
        return [e for e in _own(word) if e in shared.value]

    other = {bytes(r["entry"]): r["n"] for r in _counted(sample.where("label = 0"), known).collect()} if found else {}
    shared.destroy()
    longer: dict[bytes, float] = defaultdict(float)
    for e, n in found.items():
        whole = e.removesuffix(b"$")
        for p in _characters(whole if whole != e else e + b"  "):
            if p != e:
                longer[p] = max(longer[p], n)
    # a beginning that owes its evidence to one longer entry is left to that
    weights = {e: odds(n, other.get(e, 0.0), bad, good, z) for e, n in found.items() if longer[e] < OWED * n}
    best = sorted(((w, e) for e, w in weights.items() if w >= strength), reverse=True)[:max_entries]
    words = {w.encode(): SEED_WEIGHT for w in SEEDS.split() if weights.get(w.encode() + b"$", SEED_WEIGHT) > 0}
    words |= {e[:-1]: w for w, e in best if e.endswith(b"$")}
    return Lexicon(words, {e: w for w, e in best if not e.endswith(b"$")})


def odds(a: float, b: float, bad: int, good: int, z: float) -> float:
    """The lower end of the range of the log odds of a in `bad` against b in `good`."""
    return math.log((a + 0.5) / (bad + 1)) - math.log((b + 0.5) / (good + 1)) - z * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def ridge(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, drawn toward `prior`; x has the constant as its last column."""
    beta = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - strength * (beta - prior)
        bend = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def features_column(text: Column, words: Lexicon) -> Column:
    plain = (words.words, words.starts)
    return rows_udf(lambda: (lambda lex: lambda t: (features(t, lex),))(Lexicon(*plain)), "x array<double>")(text)["x"]


def sample_of(docs: DataFrame, known: DataFrame, sample_bytes: int, sample_docs: int, folders: list[str]) -> DataFrame:
    """(label, text, half) of about `sample_bytes` and `sample_docs` rows a class. docs(id, text), known(id, label).

    Texts are not shuffled: rows are chosen by (id, hash), and the chosen ones, whose number is bounded and looked at, are
    sent to the texts."""
    hashed = F.xxhash64("id", "text").alias("h")
    slim = docs.select("id", hashed, F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(known.where(F.col("label").isin(0, 1)).distinct(), "id")
    slim = stored(slim.select("id", "h", F.col("label").cast("int").alias("label"), "size"), folders)
    share = {0: 1.0, 1: 1.0}
    for r in slim.groupBy("label").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("docs")).collect():
        share[r["label"]] = min(1.0, sample_bytes / max(1, r["bytes"]), sample_docs / r["docs"])
    steps = 1_000_000
    most = F.when(F.col("label") == 1, math.ceil(steps * share[1])).otherwise(math.ceil(steps * share[0]))
    chosen = stored(slim.where(F.pmod(F.xxhash64("h"), F.lit(steps)) < most).select("id", "h", "label").distinct(), folders)
    if chosen.count() <= 3 * sample_docs:
        chosen = F.broadcast(chosen)
    texts = docs.select("id", hashed, "text").join(chosen, ["id", "h"])
    return stored(texts.select("label", F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2)).alias("half")), folders)


def fit(docs: DataFrame, labels: DataFrame, *, sample_bytes: int = 96_000_000, sample_docs: int = 60_000, max_candidates: int = 200_000, max_entries: int = 50_000) -> Model:
    """docs(id, text), labels(id, label)."""
    folders: list[str] = []
    sample = sample_of(docs, labels, sample_bytes, sample_docs, folders)
    bounds = {"max_candidates": max_candidates, "max_entries": max_entries}
    tried = lexicon(sample.where("half = 0"), **bounds)
    held = sample.where("half = 1").select("label", features_column(F.col("text"), tried).alias("x")).toArrow()
    x = np.array(held.column("x").to_pylist(), float).reshape(-1, FEATURES)
    y = held.column("label").to_numpy().astype(float)
    beta = ridge(np.column_stack([x, np.ones(len(x))]), y, PRIOR)
    model = Model(lexicon(sample, **bounds), beta)
    dropped(docs.sparkSession, folders)
    return model


def score_column(text: Column, model: Model) -> Column:
    plain = (model.lexicon.words, model.lexicon.starts, model.beta)

    def start():
        own = Model(Lexicon(*plain[:2]), plain[2])
        return lambda t: (own.score(t),)

    return rows_udf(start, "score double")(text)["score"]


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, *, id: str = "doc_id", text: str = "text", label: str = "toxic", **bounds) -> DataFrame:
    """One row per document: id, held_out, score, predicted. Labels of rows under `held_out` are not used."""
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where("label is not null")
    model = fit(docs.where(~held_out).select(F.col(id).alias("id"), F.col(text).alias("text")), known, **bounds)
    scored = docs.select(F.col(id).alias(id), held_out.alias("held_out"), score_column(F.col(text), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def spans_column(text: Column, model: Model) -> Column:
    """The matched clauses: byte offsets in the folded text, the kinds of match and the clause's weight."""
    plain, weights = (model.lexicon.words, model.lexicon.starts), tuple(model.beta[: len(KINDS) - 1].tolist())

    def start():
        own, machine = Lexicon(*plain), grammar(weights)
        return lambda t: ([{"start": a, "end": z, "kinds": "".join(k for k, _ in found), "weight": sum(w for _, w in found)} for a, z, found in clauses(folded(t), own, machine)],)

    return rows_udf(start, "clauses array<struct<start:int,end:int,kinds:string,weight:double>>")(text)["clauses"]
