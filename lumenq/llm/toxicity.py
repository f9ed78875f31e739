"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer rewrites the words of a text to symbols: insult, threat, target, negation, report, clause end.
Small transducers then rewrite symbols by what stands around them (reported speech weakens what follows it in its
clause, a negation cancels an insult or threat shortly after it, a target strengthens one near it), and a weighted
acceptor adds up a clause. They are composed into one machine, which reads each clause once; a document is scored by
its matched clauses, not by isolated words. Insult stems are learned from labelled rows; the grammar's other word
lists are the fixed values below.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm._shared import modest_batches, read_table, staged, text_of
from lumenq.llm.quality import remainder, training_sample
from lumenq.llm.shingles import Minima, shingle_hashes

TRAINING_ROWS = 12_000
THRESHOLD = 0.5
#: Words whose symbols a worker remembers.
MEMO_WORDS = 100_000
#: Lengths of word stems that may be learned.
STEMS = range(4, 8)
#: Seed words of the grammar in the four languages of the corpus.
#: Verbs of threats by stem and endings, a dash for none; forms that are common nouns too (shot, mata) are left out.
THREAT_VERBS = {
    "kill": "- s ed ing", "murder": "- s ed ing", "stab": "- s bed bing", "shoot": "- s ing", "strangl": "e es ed ing", "destroy": "- s ed ing",
    "tu": "er e es ez ent é és ée ées ant ait aient erai eras era erons erez eront",
    "töt": "en e est et ete eten end", "getötet": "-", "umbring": "en e st t end", "umgebracht": "-", "umzubringen": "-",
    "mat": "ar arte arlo arla arlos arlas aré arás ará aremos arán aría o as an amos é aste ó aron ado ada ados adas ando",
}
THREATS = [stem + ending.strip("-") for stem, endings in THREAT_VERBS.items() for ending in endings.split()]
TARGETS = "you your you're he she they them toi tu vous ton votre du dich dein ihr euch tú ti usted ustedes te".split()
NEGATIONS = "not no never don't isn't aren't wasn't without ne pas jamais sans nicht kein keine nie ohne nunca sin".split()
REPORTS = "said says reported reports claimed according quoted dit disait selon sagte sagt laut dijo dice según".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, DOUBTFUL = "oitpnrw"
NOTHING = (0.0, 0.0)
_MARKS = ".,;:!?\"'()[]{}|*%$&#<>«»„“”‘’¡¿-_/"
_END = re.compile(r"[.!?;:|]+[\"')\]»”]*$")


@dataclass
class Transducer:
    """A deterministic weighted transducer: arcs[state][symbol] = (output, weight, next state); absent symbols pass.

    A weight is a pair: what surely learned stems add, and what doubtful ones add.
    """

    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol: str):
        return self.arcs.get(state, {}).get(symbol, (symbol, NOTHING, self._rest(state)))

    @staticmethod
    def _rest(state):
        return max(0, state - 1)


def compose(*machines: Transducer):
    """The machine that runs every one on the output of the one before; its states are tuples, its weights add up."""
    table: dict = {}

    def step(states: tuple, symbol: str):
        key = (states, symbol)
        if key not in table:
            out, weight, after = symbol, NOTHING, []
            for machine, state in zip(machines, states, strict=True):
                out, w, state = machine.step(state, out)
                weight = (weight[0] + w[0], weight[1] + w[1])
                after.append(state)
            table[key] = (weight, tuple(after))
        return table[key]

    return step, (0,) * len(machines)


#: The transducers before the one that weighs, in their order.
PARTS = ("report", "negation", "target")


def grammar(parts: tuple[str, ...] = PARTS):
    """Reports, negations and targets rewrite the symbols that follow; the last transducer weighs insults and threats.

    A state counts the words that its rule still reaches: 8 after a report, 3 after a negation, 4 after a target.
    A target also strengthens an insult that stands up to 3 words before it. Without a part its symbols pass as they are;
    so the worth of each can be measured.
    """
    keep = lambda out, s: (out, NOTHING, max(0, s - 1))
    report = Transducer({s: {REPORT: (OTHER, NOTHING, 8), **({INSULT: keep("q", s), THREAT: keep("q", s), DOUBTFUL: keep(OTHER, s)} if s else {})} for s in range(9)})
    negation = Transducer({s: {NEGATION: (OTHER, NOTHING, 3), **({x: keep(OTHER, s) for x in (INSULT, THREAT, DOUBTFUL, "q")} if s else {})} for s in range(4)})
    target = Transducer({s: {TARGET: (TARGET, NOTHING, 4), **({INSULT: keep("I", s), THREAT: keep("T", s), DOUBTFUL: keep("D", s)} if s else {})} for s in range(5)})
    last = lambda sure, doubtful, state=0: (OTHER, (sure, doubtful), state)
    weights = {INSULT: last(1.0, 0.0, 3), "I": last(1.5, 0.0), THREAT: last(0.5, 0.0), "T": last(2.0, 0.0), "q": last(0.4, 0.0), DOUBTFUL: last(0.0, 1.0), "D": last(0.0, 1.25)}
    weigh = Transducer({s: weights | ({TARGET: last(0.5, 0.0)} if s else {}) for s in range(4)})
    return compose(*(m for name, m in zip(PARTS, (report, negation, target), strict=True) if name in parts), weigh)


class Lexicon:
    """Maps raw words to symbols; remembers what it has mapped, up to a bound."""

    def __init__(self, words: set[str], stems: set[str], doubtful: set[str] = frozenset()):
        self.words = {w: INSULT for w in words}
        for symbol, fixed in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.words |= {w: symbol for w in fixed if w not in self.words}
        self.stems = {s: DOUBTFUL for s in doubtful} | {s: INSULT for s in stems}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.memo: dict[str, str] = {}

    def symbol(self, raw: str) -> str:
        word = raw.lower().strip(_MARKS)
        found = self.words.get(word)
        if found is None:
            found = next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), OTHER)
        return found + "." if _END.search(raw) else found

    def symbols(self, text: str) -> str:
        words = text.split()
        got = list(map(self.memo.get, words))
        if None in got:
            room = len(self.memo) < MEMO_WORDS  # a full memory stays as it is: common words are met early
            for i, s in enumerate(got):
                if s is None:
                    got[i] = self.symbol(words[i])
                    if room:
                        self.memo[words[i]] = got[i]
        return "".join(got)


@dataclass
class Model:
    """Learned words and stems, and the logistic over logarithms of sure weight, doubtful weight and length."""

    words: set
    stems: set
    doubtful: set = field(default_factory=set)
    weights: tuple = (1.0, 0.0, 0.0, -1.0)
    parts: tuple = PARTS

    def reader(self):
        lexicon, (step, start) = Lexicon(self.words, self.stems, self.doubtful), grammar(self.parts)

        def totals(text: str) -> tuple[float, float, int]:
            """Sure and doubtful weight of all matched clauses, each counted by its own sum, and the words there are."""
            symbols = lexicon.symbols(text)
            sure = doubtful = 0.0
            if INSULT in symbols or THREAT in symbols or DOUBTFUL in symbols:
                for clause in symbols.split("."):
                    if INSULT in clause or THREAT in clause or DOUBTFUL in clause:
                        states, a, b = start, 0.0, 0.0
                        for symbol in clause:
                            w, states = step(states, symbol)
                            a, b = a + w[0], b + w[1]
                        sure, doubtful = sure + a, doubtful + b
            return sure, doubtful, len(symbols) - symbols.count(".")

        return totals

    def score(self, totals: tuple[float, float, int]) -> float:
        x = sum(w * math.log1p(v) for w, v in zip(self.weights, totals, strict=False)) + self.weights[3]
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def _terms(text: str) -> set[str]:
    """Distinct words of a text, and their stems marked with a star."""
    words = {w.lower().strip(_MARKS) for w in text.split()} - {""}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task that have each term: toxic ones, and all."""
    seen, bad = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            terms = _terms(text)
            seen.update(terms)
            if label:
                bad.update(terms)
    keys = list(seen)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], ["term", "bad", "seen"])


def _learned(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[set[str], set[str], set[str]]:
    """Words and stems that stand out in toxic texts far beyond chance.

    Those rare in clean texts are sure. Stems that clean texts have too are doubtful: one use says little, several do.
    Of stems that begin alike, the one that stands out most is taken, the longest of equals.
    """
    base = toxic / max(1, toxic + clean)
    sure, rest = [], []
    for term, in_toxic, in_all in counts:
        precision = (in_toxic + 0.5) / (in_all + 1)
        gain = in_toxic * math.log(precision / base) if precision > base else 0.0
        if precision >= 0.8 and gain >= 16:
            sure.append((gain, term))
        elif precision >= 2 * base and gain >= 25 and term.endswith("*"):
            rest.append((gain, term))
    words, stems = set(), set()
    for _, term in sorted(sure, key=lambda x: (-x[0], x[1])):
        (stems if term.endswith("*") else words).add(term.rstrip("*"))
    stems = {s for s in stems if not any(s[:n] in stems for n in STEMS if n < len(s))}
    doubtful: set[str] = set()
    for _, term in sorted(rest, key=lambda x: (-x[0], -len(x[1]), x[1])):
        stem = term.rstrip("*")
        if not any(stem.startswith(d) or d.startswith(stem) for d in doubtful | stems):
            doubtful.add(stem)
    return {w for w in words if not any(w[:n] in stems for n in STEMS)}, stems, doubtful


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 100) -> np.ndarray:
    """Logistic regression with a small ridge, by damped Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three hash minima of the shingles of each text."""
    minima = Minima(3, seed=5)
    for batch in batches:
        ids, found = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            shingles = shingle_hashes(text)
            if len(shingles):
                ids.append(doc_id)
                found.append(minima.of(shingles, np.array([0]))[0].astype(np.int64))
        columns = np.array(found, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(columns[:, k]) for k in range(3))], ["doc_id", "m0", "m1", "m2"])


def _without_copies(rows: list[tuple[int, ...]]) -> set[int]:
    """The smallest id of each group of documents that share a minimum, directly or through others."""
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for doc_id, *minima in sorted(rows):
        for k, m in enumerate(minima):
            a, b = find((0, doc_id)), find((k + 1, m))
            if a != b:
                low, high = sorted((a, b))
                root[high] = low
    groups: dict = {}
    for doc_id, *_ in sorted(rows):
        groups.setdefault(find((0, doc_id)), doc_id)
    return set(groups.values())


def _constant(toxic: int, rows: int) -> Model:
    """A model without terms: every text gets the share of label 1."""
    p = toxic / rows if rows else 0.0
    return Model(set(), set(), set(), (0.0, 0.0, 0.0, math.log((p + 1e-3) / (1 - p + 1e-3))))


def train(docs: DataFrame, labels: DataFrame, held_out, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", parts: tuple[str, ...] = PARTS) -> Model:
    """The grammar's stems and the score's logistic, from at most rows labelled documents that are not held out."""
    spark = docs.sparkSession
    modest_batches(spark)
    chosen = {r.doc_id: r.label for r in training_sample(labels, "toxic", ~held_out, rows).collect()}  # at most rows pairs
    sample = F.broadcast(spark.createDataFrame([(int(k), int(v)) for k, v in chosen.items()], "doc_id bigint, label int"))
    toxic = sum(chosen.values())
    if not 0 < toxic < len(chosen):
        return _constant(toxic, len(chosen))

    # one row of each sampled id: repeats of a row would break the sample's bound
    rows_of = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")).join(sample, "doc_id")
    texts = staged(rows_of.groupBy("doc_id", "label").agg(F.max("text").alias("text")), "toxicity-sample")
    # copies of one text say no more than the text: terms are counted in one of each group of copies
    single = _without_copies([tuple(r) for r in texts.mapInArrow(_minima, "doc_id bigint, m0 bigint, m1 bigint, m2 bigint").collect()])  # at most rows of four numbers
    toxic = sum(chosen[i] for i in single)
    clean = len(single) - toxic
    model = Model(set(), set(), parts=parts)
    if toxic and clean:  # else no class has words of its own to learn
        singles = texts.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted(single)], "doc_id bigint")), "doc_id", "left_semi")
        terms = singles.mapInArrow(_counted, "term string, bad bigint, seen bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
        # only the terms that may be learned come to the driver: each stands out in six toxic texts of the sample at least
        precision = (F.col("bad") + 0.5) / (F.col("seen") + 1)
        strong = terms.where((F.col("bad") >= 6) & (precision >= min(0.8, 2 * toxic / len(single))) & (F.col("bad") * F.ln(precision * (len(single) / toxic)) >= 16)).collect()
        model = Model(*_learned([(r.term, r.bad, r.seen) for r in strong], toxic, clean), parts=parts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = model.reader()
        for batch in batches:
            found = [totals(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array([f[k] for f in found], pa.float64()) for k in range(3))], ["label", "sure", "doubtful", "words"])

    got = texts.mapInArrow(read, "label int, sure double, doubtful double, words double").collect()  # at most rows of four numbers
    if len({r.label for r in got}) < 2:
        return _constant(sum(chosen.values()), len(chosen))
    model.weights = tuple(_logistic(np.log1p(np.array([r[1:] for r in got])), np.array([r.label for r in got])))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", parts: tuple[str, ...] = PARTS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; learned from labelled rows that are not held out.

    Null, empty and unmatched texts have the score of no matched clause. Very long texts are read whole, clause by
    clause. Repeated rows get a row each, but train once, by the greatest of their texts. A null doc_id is not held
    out and never trains. Without labels of both kinds, or where no labelled document of both kinds is there, every
    text gets the share of label 1. Other columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, remainder("doc_id", 5) == 0, rows, id_col, text_col, parts)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        total = model.reader()
        return pd.Series([model.score(total(t)) for t in texts], dtype="float64")

    scored = docs.select(F.col(id_col).alias("doc_id"), score(text_of(text_col)).alias("score"))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
