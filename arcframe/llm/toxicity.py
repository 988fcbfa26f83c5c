"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause. A lexical step maps each word to a symbol: its class
(insult, threat, intent, wish, death, target, negation, report, other), its place in
multi-word phrases, and for insults a weight. Transducers, one for each kind of pattern, are
composed as far as texts reach:

* phrases turns the last word of a listed phrase into the symbol phrase;
* scope marks insults, phrases and words of threats in the reach of a negation (-) and
  behind a verb of reported speech (");
* threats finds a threat as a clause pattern: intent, verb and target, or wish and death,
  each within `near` words; a verb and a target alone are a weak one, a lone verb is none;
* attack scores what is left, higher where a target stands near.

A document's evidence is the sum over its clauses; a logistic curve turns it into a score.
Insult stems and the curve are learned from all labelled rows; everything else is a fixed list.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcframe.llm.common import lean, written

#: Labelled ids up to this number are broadcast to documents; beyond it they are joined by key.
BROADCAST_LABELS = 1_000_000
#: Steps of the evidence's logarithm that the curve tells apart, a unit; every row counts in its step.
CURVE_STEPS = 1_024
#: Stems that a fit keeps at most, those with the largest odds times toxic documents.
STEM_ROWS = 4_000
#: Learned stems need this many toxic documents, this share of them and this log-odds ratio.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 4, 0.01, 2.5
PREFIXES = (4, 5, 6, 7)
#: Longer words count by their first letters only.
WHOLE_CHARS = 40
#: Stems that a task holds before it sends its counts on.
HELD_STEMS = 1 << 17
#: Stems frequent in toxic rows that go to all tasks; beyond it every stem of clean rows is counted.
SENT_STEMS = 200_000

# Word classes and phrases of the grammar.
CLASSES = {
    "target": "you your yours u ur he she they them him her people du dich dir ihr euch sie tu te toi vous ton ta usted tú vosotros ustedes",
    "threat": "kill hurt destroy hunt beat burn töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    "intent": "will gonna going shall must i'll we'll werde werden wirst vais allons veux voy vamos quiero",
    "wish": "hope wish deserve deserves should hoffe sollst verdienst espère mérites devrais espero mereces deberías",
    "death": "die dead suffer rot sterben krepieren leiden mourir crever souffrir morir pudrirte sufrir",
    "negation": "not no never neither nor isn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás ningún",
    "report": "said says wrote claimed reported quoted called sagte schrieb behauptete dit écrit affirme dijo escribió afirma",
}
INSULTS = "idiot moron loser scum stupid pathetic worthless disgusting trash clown dumb fool"
PHRASES = (
    "piece of trash", "waste of space", "shut up", "go to hell", "drop dead", "get lost", "halt die klappe", "fahr zur hölle", "verpiss dich",
    "ferme ta gueule", "va au diable", "espèce de merde", "vete al infierno", "cierra la boca", "pedazo de basura",
)
MARKS = {"": 1.0, "-": 0.15, '"': 0.6, '-"': 0.1}

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
DEFAULT_WEIGHT = 2.0


@dataclass
class Transducer:
    """arcs[(state, symbol)] = (next state, output symbol, weight)."""

    first: object
    arcs: dict[tuple[object, str], tuple[object, str, float]] = field(default_factory=dict)


PLAIN = ("other", "insult", "end", *CLASSES)
SCOPED = ("insult", "phrase", "threat", "intent", "wish", "death")


def alphabet(phrases: tuple[str, ...] = PHRASES) -> list[str]:
    """Input symbols: a class, or class:word for words of phrases."""
    words = sorted({w for p in phrases for w in p.split()})
    return [*PLAIN, *(f"{word_class(w)}:{w}" for w in words)]


def word_class(word: str) -> str:
    if word in INSULTS.split():
        return "insult"
    return next((name for name, words in CLASSES.items() if word in words.split()), "other")


def phrase_transducer(phrases: tuple[str, ...] = PHRASES) -> Transducer:
    """Words of phrases become their class, the last word of a whole phrase becomes `phrase`."""
    listed = {tuple(p.split()) for p in phrases}
    heads = {p[:n] for p in listed for n in range(len(p))}
    symbols = [*alphabet(phrases), *(f"insult:{w}" for p in listed for w in p if word_class(w) != "insult")]
    out = Transducer(())
    for state in heads:
        for symbol in symbols:
            name, _, word = symbol.partition(":")
            seen = (*state, word) if word else ()
            tails = [seen[i:] for i in range(len(seen))]
            done = any(t in listed for t in tails)
            out.arcs[state, symbol] = (next((t for t in tails if t in heads), ()), "phrase" if done else name, 1.0)
    return out


def scope_transducer(reach: int = 3) -> Transducer:
    """Marks SCOPED symbols: - within `reach` words behind a negation, " behind a report in the clause."""
    out = Transducer((0, False))
    for left in range(reach + 1):
        for said in (False, True):
            for symbol in (*PLAIN, "phrase"):
                if symbol == "end":
                    after = (0, False)
                elif symbol == "negation":
                    after = (reach, said)
                else:
                    after = (max(left - 1, 0), said or symbol == "report")
                mark = ("-" * (left > 0) + '"' * said) if symbol in SCOPED else ""
                plain = "other" if symbol in ("negation", "report") else symbol
                out.arcs[(left, said), symbol] = (after, plain + mark, 1.0)
    return out


def threat_transducer(near: int = 3) -> Transducer:
    """Clause patterns of threats: menace at the target (or death) that completes one, weak without intent.

    A state is what was seen last and how many words it still reaches; a verb remembers
    whether an intent stood before it. The mark is that of the verb or of the death.
    """
    out = Transducer(("", "", 0))
    inputs = ["other", "target", "end", *(s + m for s in SCOPED for m in MARKS)]
    states = [("", "", 0), *((kind, mark, n) for kind in ("intent", "wish", "verb", "meant") for mark in MARKS for n in range(1, near + 1))]
    for kind, mark, n in states:
        later = (kind, mark, n - 1) if n > 1 else ("", "", 0)
        for symbol in inputs:
            name = symbol.rstrip('-"')
            own = symbol[len(name) :]
            after, output = later, symbol
            if name == "end":
                after = ("", "", 0)
            elif name in ("intent", "wish"):
                after, output = (name, own, near), "other"
            elif name == "threat":
                after, output = ("meant" if kind == "intent" else "verb", own, near), "other"
            elif name == "death":
                after, output = (("", "", 0), "menace" + own) if kind in ("wish", "intent") else (later, "other")
            elif name == "target" and kind in ("verb", "meant"):
                after, output = ("", "", 0), ("menace" if kind == "meant" else "weak") + mark
            out.arcs[(kind, mark, n), symbol] = (after, output, 1.0)
    return out


def attack_transducer(near: int = 4) -> Transducer:
    """Scores marked symbols; a target within `near` words before or after an insult raises it."""
    out = Transducer(("", 0))
    base = {"insult": 1.0, "phrase": 1.5, "menace": 2.0, "weak": 0.4}
    for state in (("", 0), *((kind, n) for kind in ("target", "insult") for n in range(1, near + 1))):
        after = (state[0], state[1] - 1) if state[1] > 1 else ("", 0)
        out.arcs[state, "other"] = (after, "", 0.0)
        out.arcs[state, "end"] = (("", 0), "", 0.0)
        out.arcs[state, "target"] = (("target", near), "", 0.3 if state[0] == "insult" else 0.0)
        for name, weight in base.items():
            for mark, factor in MARKS.items():
                aimed = 1.3 if state[0] == "target" and name == "insult" else 1.0
                hit = ("target", near) if name in ("menace", "weak") else ("insult", near)
                out.arcs[state, name + mark] = (hit, "", weight * factor * aimed)
    return out


class State(dict):
    """A state of the composed transducers: symbol -> (next state, weight), worked out when it is first met.

    What one transducer writes, the next one reads; weights are multiplied. Only the part of
    the product that texts reach is ever built.
    """

    def __init__(self, cascade: tuple[Transducer, ...], parts: tuple, known: dict[tuple, State]):
        super().__init__()
        self.cascade, self.parts, self.known = cascade, parts, known
        known[parts] = self

    def __missing__(self, symbol: str) -> tuple[State, float]:
        word, gain, after = symbol, 1.0, []
        for transducer, part in zip(self.cascade, self.parts):
            part, word, weight = transducer.arcs[part, word]
            after.append(part)
            gain *= weight
        state = self.known.get(tuple(after)) or State(self.cascade, tuple(after), self.known)
        self[symbol] = (state, gain)
        return state, gain


@cache
def transducers() -> tuple[Transducer, ...]:
    return phrase_transducer(), scope_transducer(), threat_transducer(), attack_transducer()


def composed() -> State:
    """The first state of all transducers in a row."""
    return State(transducers(), tuple(t.first for t in transducers()), {})


@dataclass
class Grammar:
    """Stems with weights (a trailing * marks a prefix) and the logistic curve."""

    stems: dict[str, float]
    slope: float = 1.5
    bias: float = -1.5

    def lexicon(self) -> "Lexicon":
        return Lexicon(self)


class Memo(dict):
    """word -> made(word), kept for words of WHOLE_CHARS at most.

    A full one takes no more, and starts anew after as many misses as say that the texts have changed.
    """

    LIMIT = 1 << 16

    def __init__(self):
        super().__init__()
        self.missed = 0

    def __missing__(self, word: str):
        found = self.made(word)
        if len(self) >= self.LIMIT:
            self.missed += 1
            if self.missed >= 4 * self.LIMIT:
                self.clear()
                self.missed = 0
        elif len(word) <= WHOLE_CHARS:
            self[word] = found
        return found


PLAIN_WORD = ("other", 0.0)


class Lexicon(Memo):
    """word -> (symbol, weight), filled as words are met."""

    def __init__(self, grammar: Grammar):
        super().__init__()
        self.stems = grammar.stems
        self.fixed = {c: "end" for c in ".!?;\n"} | {w: name for name, words in CLASSES.items() for w in words.split()}
        self.parts = {w for p in PHRASES for w in p.split()}
        self.heads = {w[: PREFIXES[0]] for w in (*self.stems, *self.fixed, *self.parts)}

    def made(self, word: str) -> tuple[str, float]:
        low = word.lower()
        if low[: PREFIXES[0]] not in self.heads:
            return PLAIN_WORD
        weight = max([self.stems.get(low, 0.0), *(self.stems.get(low[:n] + "*", 0.0) for n in PREFIXES if len(low) >= n)])
        name = "insult" if weight > 0 else self.fixed.get(low, "other")
        return (f"{name}:{low}" if low in self.parts else name, weight)


def evidence(texts: Iterable[str], lexicon: Lexicon, first: State) -> np.ndarray:
    """Summed clause scores of each text."""
    out = []
    for text in texts:
        state, total = first, 0.0
        for word in TOKEN.findall(text):
            symbol, weight = lexicon[word]
            state, gain = state[symbol]
            if gain:
                total += gain * (weight or 1.0)
        out.append(total)
    return np.array(out, np.float64)


def default_grammar() -> Grammar:
    return Grammar({w: DEFAULT_WEIGHT for w in INSULTS.split()})


#: Rows of a batch whose texts are Python strings at once.
SLICE_ROWS = 256


def _texts(column: pa.Array) -> Iterator[str]:
    for lo in range(0, len(column), SLICE_ROWS):
        yield from (t or "" for t in column.slice(lo, SLICE_ROWS).to_pylist())


class Stems(Memo):
    """word of four letters or more -> its stems: all, or those that are wanted."""

    def __init__(self, wanted: frozenset[str] | None):
        super().__init__()
        self.wanted = wanted
        self.heads = {stem[: PREFIXES[0]] for stem in wanted or ()}

    def made(self, word: str) -> tuple[str, ...]:
        low = word.lower()
        if self.wanted is not None and low[: PREFIXES[0]] not in self.heads:
            return ()
        whole = (low,) if len(low) <= WHOLE_CHARS else ()
        stems = (*whole, *(low[:n] + "*" for n in PREFIXES if len(low) >= n))
        return stems if self.wanted is None else tuple(filter(self.wanted.__contains__, stems))


def _stem_counts(wanted: frozenset[str] | None = None):
    """(text, label, half) -> documents that hold each (wanted) stem by half and label, summed over parts of the task; '' is in all."""

    def counted(cells: list[Counter]) -> Iterator[pa.RecordBatch]:
        stems = list(set().union(*cells))
        for lo in range(0, len(stems), 20_000):
            part = stems[lo : lo + 20_000]
            counts = (pa.array([cell[s] for s in part], pa.int64()) for cell in cells)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *counts], names=["stem", *CELLS])
        for cell in cells:
            cell.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, known = [Counter() for _ in CELLS], Stems(wanted)
        for batch in lean(batches):
            for text, label, half in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = {w for w in set(TOKEN.findall(text)) if len(w) >= 4}
                cells[2 * half + label].update({""}.union(*map(known.__getitem__, words)))
                if sum(map(len, cells)) >= HELD_STEMS:
                    yield from counted(cells)
        yield from counted(cells)

    return run


CELLS = ("clean0", "toxic0", "clean1", "toxic1")


def _counts(rows: DataFrame) -> DataFrame:
    """CELLS of all stems that _picked() can take, and of '' (all rows).

    Stems of toxic rows are counted first. Only those frequent enough there, in one half or in both, are
    counted in the others: they are few, as each is in LEAST_SHARE of the toxic rows of a half.
    """

    def summed(counts: DataFrame) -> DataFrame:
        return counts.groupBy("stem").agg(*(F.sum(c).alias(c) for c in CELLS))

    def counted(label: int, wanted: frozenset[str] | None = None) -> DataFrame:
        return rows.where(F.col("label") == label).select("text", "label", "half").mapInArrow(_stem_counts(wanted), form)

    form = "stem string, " + ", ".join(f"{c} long" for c in CELLS)
    toxic = written(summed(counted(1)).where(f"toxic0 + toxic1 >= {LEAST_DOCS} or stem = ''"), "toxic-stems")
    total = toxic.where("stem = ''").first()
    if total is None:
        return toxic
    least = [max(LEAST_DOCS, LEAST_SHARE * total[c]) for c in ("toxic0", "toxic1")]
    often = toxic.where((F.col("toxic0") >= least[0]) | (F.col("toxic1") >= least[1]) | (F.col("toxic0") + F.col("toxic1") >= max(LEAST_DOCS, LEAST_SHARE * (total["toxic0"] + total["toxic1"]))))
    often = often.where("stem != ''").select("stem").limit(SENT_STEMS + 1).toPandas()["stem"]
    wanted = frozenset(often) if len(often) <= SENT_STEMS else None
    return written(summed(toxic.unionByName(counted(0, wanted))).where(f"toxic0 + toxic1 >= {LEAST_DOCS} or stem = ''"), "toxicity-stems")


def _picked(counts: DataFrame, halves: tuple[int, ...]) -> dict[str, float]:
    """Weights of the stems that stand out in these halves of the rows: STEM_ROWS at most."""
    toxic, clean = (sum(F.col(f"{kind}{h}") for h in halves) for kind in ("toxic", "clean"))
    sums = counts.select("stem", toxic.alias("toxic"), clean.alias("clean"))
    total = sums.where("stem = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1))
    rows = (
        sums.where((F.col("toxic") >= max(LEAST_DOCS, total["toxic"] * LEAST_SHARE)) & (F.col("stem") != ""))
        .withColumn("odds", odds)
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc(F.col("odds") * F.col("toxic")), "stem")
        .limit(STEM_ROWS)
        .collect()
    )
    return {r["stem"]: r["odds"] * r["toxic"] / (r["toxic"] + 10.0) for r in rows}


def _with_stems(stems: dict[str, float]) -> Grammar:
    grammar = default_grammar()
    for stem, weight in stems.items():
        grammar.stems[stem] = max(weight, grammar.stems.get(stem, 0.0))
    return grammar


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Stems and curve from all rows of labelled.

    Equal texts count once; a text with both labels counts as toxic.

    The curve is fitted to evidence that the stems of the other half of the rows give;
    the stems kept are those of both halves. Rows without a label or text are left out.
    With no toxic row the fixed list stays. The driver gets counts by step of evidence.
    """
    half = F.pmod(F.shiftright(F.xxhash64(F.col(id_col).cast("string")), 7), F.lit(2)).cast("int")
    rows = written(
        labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), half.alias("half"))
        .groupBy("text")
        .agg(F.max("label").alias("label"), F.min("half").alias("half")),
        "toxicity-rows",
    )
    counts = _counts(rows)
    grammar = _with_stems(_picked(counts, (0, 1)))
    pairs = []
    for learned, judged in ((0, 1), (1, 0)):
        other = _with_stems(_picked(counts, (learned,)))
        pairs.append(rows.where(F.col("half") == judged).select("text", "label").mapInArrow(_evidence_map(other, 1), "x double, label int"))
    step = F.round(F.log1p("x") * CURVE_STEPS).cast("long").alias("step")
    points = pairs[0].unionByName(pairs[1]).groupBy(step, "label").count().toPandas().sort_values(["step", "label"])
    if points["label"].nunique() == 2:
        grammar.slope, grammar.bias = logistic(points["step"].to_numpy() / CURVE_STEPS, points["label"].to_numpy(), points["count"].to_numpy())
    return grammar


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and bias of a one-feature logistic regression over n rows of each point (Newton steps, slope kept positive)."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (n * (p - y)) + ridge * w
        hessian = (a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        w -= np.linalg.solve(hessian, gradient)
    return max(float(w[0]), 0.1), float(w[1])


def _evidence_map(grammar: Grammar, passed: int):
    """(text, *passed) -> (evidence, *passed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, first = grammar.lexicon(), composed()
        for batch in lean(batches):
            x = evidence(_texts(batch.column(0)), lexicon, first)
            yield pa.RecordBatch.from_arrays([pa.array(x), *batch.columns[1 : 1 + passed]], names=["x", *batch.schema.names[1 : 1 + passed]])

    return run


def _scored(grammar: Grammar, text: int):
    """A struct of a row, whose field at `text` is its text -> (evidence, the struct).

    The text goes to the worker once and the struct goes back as it came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, first = grammar.lexicon(), composed()
        for batch in lean(batches):
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.column(0).slice(lo, SLICE_ROWS)
                x = evidence(_texts(rows.field(text)), lexicon, first)
                yield pa.RecordBatch.from_arrays([pa.array(x), rows], names=["x", "__af_all"])

    return run


def _with_scores(docs: DataFrame, grammar: Grammar, text_col: str) -> DataFrame:
    """__af_all (a struct of the row of docs) and its score."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__af_all"))
    scored = rows.mapInArrow(_scored(grammar, docs.columns.index(text_col)), rows.select(F.lit(0.0).alias("x"), "__af_all").schema)
    curve = 1 / (1 + F.exp(-(F.lit(grammar.slope) * F.log1p("x") + F.lit(grammar.bias))))
    return scored.select("__af_all", curve.alias("score"))


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """docs with a column `score` from 0 to 1 (a former column of that name is replaced).

    Only the text is read for the score. A null or empty text has no evidence and gets the
    curve's lowest score.
    """
    others = [F.col(f"__af_all.`{c}`") for c in docs.columns if c != "score"]
    return _with_scores(docs, grammar, text_col).select(*others, "score")


def held_out(id_col: str = "doc_id"):
    """The rows that no fit may learn from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fitted(docs: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar from all labelled documents that are not held out.

    An id with both labels is toxic. Of documents that repeat an id the text with the smallest
    hash counts; texts are shuffled for that only where an id does repeat.
    """
    marked = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = written(marked, "labelled-ids")
    side = F.broadcast(marked) if marked.count() <= BROADCAST_LABELS else marked
    joined = docs.select("doc_id", "text").where("text is not null").join(side, "doc_id")
    if not joined.groupBy("doc_id").count().where("count > 1").isEmpty():
        one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
        joined = joined.groupBy("doc_id").agg(one["text"].alias("text"), F.max("toxic").alias("toxic"))
    return fit(joined)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fitted(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is below 0.5; columns as they were."""
    return _with_scores(docs, fitted(docs, labels), "text").where("score < 0.5").select("__af_all.*")
