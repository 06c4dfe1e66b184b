"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# Cue words of the grammar, by language of the corpus.
NEGATION = ("not", "never", "no", "isn't", "aren't", "don't", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "sin")
REPORT = ("said", "says", "called", "wrote", "claims", "quote", "sagte", "schrieb", "nannte", "dit", "écrit", "appelle", "dijo", "escribe", "llama")
TARGET = ("you", "your", "they", "he", "she", "du", "ihr", "dich", "sie", "tu", "vous", "toi", "ils", "usted", "eres", "ellos")
THREAT = ("kill", "hurt", "die", "burn", "destroy", "töten", "sterben", "tuer", "mourir", "matar", "morir")

#: What ends a clause.
_ENDS = re.compile(r"[.!?;\n]")

#: Input classes of the transducers, and the states of their composition.
INSULT, THREATS, TARGETS, NEGATES, REPORTS, ENDS = range(6)

#: The features that a text's accepted paths add up to; models see ``_level`` of each.
FEATURES = ("plain", "aimed", "negated", "reported", "top", "clauses", "rate", "threat", "threat_aimed")



def _level(feature: str, total: float) -> float:
    """What models see of a total: each further path adds less, without any end."""
    return math.log1p(total) if feature in ("rate", "clauses") else 60 * math.log1p(total / 60)


_WORD = re.compile(r"\w+(?:'\w+)?")


@dataclass(frozen=True)
class Transducer:
    """A finite-state transducer over token classes: (state, class) to (state, output)."""

    start: str
    arcs: dict[tuple[str, int], tuple[str, str]]

    def step(self, state: str, token: int) -> tuple[str, str]:
        return self.arcs.get((state, token), (state, ""))


def compose(*parts: Transducer) -> dict:
    """The product of transducers that read the same tokens: states and outputs side by side."""
    start = tuple(p.start for p in parts)
    table, todo = {}, [start]
    while todo:
        state = todo.pop()
        for token in range(6):
            steps = [p.step(s, token) for p, s in zip(parts, state, strict=True)]
            to = tuple(s for s, _ in steps)
            if (state, token) not in table:
                table[state, token] = (to, frozenset(o for _, o in steps if o))
                todo.append(to)
    return {"start": start, "arcs": table}


#: A scope opens at its cue and lasts to the end of the clause; harm carries the scope it stands in.
_OPEN = {"negated": NEGATES, "reported": REPORTS}


def _scope(name: str) -> Transducer:
    cue = _OPEN[name]
    return Transducer("out", {("out", cue): ("in", ""), ("in", ENDS): ("out", ""), ("in", INSULT): ("in", name), ("in", THREATS): ("in", name)})


def _aim() -> Transducer:
    """Harm after a target is aimed at it; a target after harm aims what waits since the clause began ("kill you")."""
    harms = (INSULT, THREATS)
    arcs = {("out", TARGETS): ("in", ""), ("wait", TARGETS): ("in", "aims"), ("wait", ENDS): ("out", ""), ("in", ENDS): ("out", "")}
    return Transducer("out", arcs | {("out", h): ("wait", "") for h in harms} | {("in", h): ("in", "aimed") for h in harms})


def _harm() -> Transducer:
    return Transducer("none", {("none", INSULT): ("harm", "harm"), ("harm", INSULT): ("harm", "harm"), ("none", THREATS): ("harm", "threat"), ("harm", THREATS): ("harm", "threat"), ("harm", ENDS): ("none", "clause")})


GRAMMAR = compose(_harm(), _scope("negated"), _scope("reported"), _aim())


def _keys(text: str) -> set[str]:
    """What an insult may be known by: words (with ``$``) and their beginnings of 3 to 8 letters."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:n] for n in range(3, min(len(w), 8) + 1))
    return out


@dataclass
class Lexicon:
    """Entries with the labelled texts that have them: pos of the toxic and neg of the others."""

    entries: dict[str, tuple[int, int]]
    pos: int
    neg: int
    prior: float = 2.0

    def weight(self, entry: str, label: int | None = None) -> float:
        """Log-odds of an entry; with a label, as if that one text had not been seen."""
        p, n = self.entries[entry]
        p, n = p - (label == 1), n - (label == 0)
        rate = (self.pos + 1) / (self.neg + 1)
        return math.log((p + self.prior * rate / (1 + rate) + 0.01) / (n + self.prior / (1 + rate))) - math.log(rate)


def _count_keys(sample: DataFrame) -> DataFrame:
    def run(batches):
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                (pos if label else neg).update(_keys(text or ""))
                if len(pos) + len(neg) > 300_000:
                    yield from emit(pos, neg)
                    pos, neg = Counter(), Counter()
        yield from emit(pos, neg)

    def emit(pos, neg):
        keys = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["entry", "pos", "neg"])

    return sample.mapInArrow(run, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_lexicon(sample: DataFrame, most: int = 4000) -> Lexicon:
    """The entries of labelled texts (text, label) that toxic ones have far more often.

    At most ``most`` entries, the most frequent ones. A beginning of a word
    gives way to a longer one, or to a whole word, that nearly all its texts have.
    """
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    odds = (F.col("pos") + 0.5) / (pos + 1) / ((F.col("neg") + 0.5) / (neg + 1))
    least = 3 if pos < 400 else 5
    rows = _count_keys(sample).where((F.col("pos") >= least) & (odds > 20) & (F.col("pos") > 2 * F.col("neg"))).orderBy(F.desc("pos"), "entry").limit(most).collect()
    found = {r.entry: (r.pos, r.neg) for r in rows}
    longest: dict[str, int] = {}
    for e, (p, _) in found.items():
        w = e.rstrip("$")
        for k in range(3, len(w) + e.endswith("$")):
            longest[w[:k]] = max(longest.get(w[:k], 0), p)
    kept = {e: c for e, c in found.items() if e.endswith("$") or longest.get(e, 0) < 0.9 * c[0]}
    # A longer entry adds nothing to a beginning that is as telling by itself.
    return Lexicon({e: c for e, c in kept.items() if not any(e[:k] in kept for k in range(3, len(e.rstrip("$")) + e.endswith("$")))}, pos, neg)


class Matcher:
    """Reads a whole text once and runs the composed transducer over what it finds."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.find = ahocorasick.Automaton()
        # Threat words without an entry of their own are found too: they open clauses.
        for w in THREAT:
            self.find.add_word(w, (w, None, True))
        for e in lexicon.entries:
            w = e.rstrip("$")
            self.find.add_word(w, (w, e, w in THREAT))
        self.find.make_automaton()
        self.cues = {w: c for c, words in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATES, NEGATION), (REPORTS, REPORT)) for w in words}

    def hits(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
        """Start, end and entry of each insult, of entries at one word the longest; and the threat words' spans."""
        at: dict[int, tuple[int, str]] = {}
        threats = []
        for last, (word, e, threat) in self.find.iter(text):
            end = last + 1
            start = end - len(word)
            if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            whole = end == len(text) or not (text[end].isalnum() or text[end] == "_")
            if threat and whole:
                threats.append((start, end))
            if e and (whole or not e.endswith("$")) and (start not in at or end > at[start][0]):
                at[start] = (end, e)
        return [(s, e, name) for s, (e, name) in sorted(at.items())], threats

    def clauses(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Clauses with one of the sorted spans of insults and threats; the others have nothing to score."""
        out: list[tuple[int, int]] = []
        # Clause ends are met in one forward pass, so a text without any is read once too.
        ends = (m.start() for m in _ENDS.finditer(text))
        left, right = 0, next(ends, len(text))
        for start, end in spans:
            if out and start < out[-1][1]:
                continue
            while right < start:
                left, right = right + 1, next(ends, len(text))
            while right < end:
                right = next(ends, len(text))
            out.append((left, right))
        return out

    def features(self, text: str | None, label: int | None = None) -> list[float]:
        low = (text or "").lower()
        sums = dict.fromkeys(FEATURES, 0.0)
        n = 0
        found, threats = self.hits(low)
        hits = {s: e for s, _, e in found}
        insulting = set(self.clauses(low, [(s, e) for s, e, _ in found]))
        for left, right in self.clauses(low, sorted({(s, e) for s, e, _ in found} | set(threats))):
            state, score, waiting, threatened = GRAMMAR["start"], 0.0, 0.0, 0
            for m in _WORD.finditer(low, left, right):
                entry = hits.get(m.start())
                token = INSULT if entry else self.cues.get(m.group())
                if token is None:
                    continue
                state, out = GRAMMAR["arcs"][state, token]
                if "aims" in out:
                    sums["aimed"] += waiting
                    sums["threat_aimed"] += threatened
                if token not in (INSULT, THREATS):
                    continue
                if self.cues.get(m.group()) == THREATS and not out & {"negated", "reported"}:
                    sums["threat"] += 1
                    sums["threat_aimed"] += "aimed" in out
                    threatened += 1
                if (left, right) not in insulting:
                    continue
                weight = max(0.0, self.lexicon.weight(entry, label)) if entry else 1.0
                n += weight > 0
                score += weight
                waiting += weight
                for name in ("negated", "reported", "aimed"):
                    if name in out:
                        sums[name] += weight
                if not out & {"negated", "reported"}:
                    sums["plain"] += weight
            sums["clauses"] += score > 0
            sums["top"] = max(sums["top"], score)
        sums["rate"] = float(n)
        return [_level(f, sums[f]) for f in FEATURES]


def _featured(rows: DataFrame, matcher, keep: list[str], label: bool) -> DataFrame:
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in keep) + ", f array<double>"

    def run(batches):
        m = Matcher(matcher.value)
        for batch in batches:
            labels = batch.column("label").to_pylist() if label else [None] * batch.num_rows
            f = [m.features(t, y) for t, y in zip(batch.column("text").to_pylist(), labels, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(f, pa.list_(pa.float64()))], names=[*keep, "f"])

    return rows.mapInArrow(run, schema)


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: list[float]
    intercept: float


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """text, label of about ``most_rows`` labelled documents at most, drawn by a hash of the id.

    The ids are drawn before any text is read, so what is broadcast is as
    bounded as the sample, and texts are not shuffled.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    share = min(1.0, most_rows / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) < share * 1_000_000).select(id_col, F.col(label_col).alias("label"))
    return cut(docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(drawn), id_col).select("text", "label"))


def train(labelled: DataFrame, most_rows: int = 20_000, seed: int = 7) -> Model:
    """Fit lexicon and clause weights on ``labelled`` (text, label 0/1); rows with a null label are left out.

    At most about ``most_rows`` rows are used, drawn by a hash of the text. The
    weights of the grammar's outputs come from a logistic regression on the
    same rows, each of them scored as if the lexicon had not seen it. Threats
    have weights of their own, with and without a target, in any clause.
    """
    rows = labelled.where("label is not null").select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_000)) < min(1.0, most_rows / max(n, 1)) * 1_000_000)
    lexicon = learn_lexicon(sample)
    if not lexicon.pos or not lexicon.neg:
        return Model(lexicon, [0.0] * len(FEATURES), -4.0 if lexicon.neg else 0.0)
    shared = labelled.sparkSession.sparkContext.broadcast(lexicon)
    data = _featured(sample, shared, ["label"], True).select("label", array_to_vector("f").alias("features")).coalesce(8)
    fit = LogisticRegression(labelCol="label", regParam=0.001, maxIter=40).fit(data)
    return Model(lexicon, [float(x) for x in fit.coefficients], float(fit.intercept))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1, higher: more likely toxic) and insults, clauses: hits and clauses with one.

    A text's score is the logistic function of the weighted logarithms of what its
    clauses' accepted paths add up to; whole texts are read, of any length. Null and empty texts match nothing and get the score of such
    texts; repeated rows get the same score; other columns of ``docs`` are not
    used, whatever their names; an empty table gives an empty table.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model.lexicon)
    f = _featured(rows, shared, ["id"], False)
    z = F.aggregate(F.zip_with("f", F.array(*[F.lit(c) for c in model.coefficients]), lambda x, w: x * w), F.lit(model.intercept), lambda a, x: a + x)
    return f.select(F.col("id").cast(kind).alias(id_col), (1 / (1 + F.exp(-z))).alias("score"), F.round(F.expm1(F.element_at("f", 7))).cast("int").alias("insults"), F.round(F.expm1(F.element_at("f", 6))).cast("int").alias("clauses"))
