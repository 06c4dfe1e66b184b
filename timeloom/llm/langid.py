"""Language identification with error-correcting output codes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: N-grams of two and three bytes; those of three share this many places.
PAIRS, TRIPLES = 1 << 12, 1 << 14
PLACES = PAIRS + TRIPLES

#: Digits and signs of ASCII become blanks, so n-grams see letters and word ends only.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b" ", np.uint8)


def _ngrams(b: np.ndarray) -> np.ndarray:
    """The places of all n-grams with a letter, in the model's tables."""
    x = b.astype(np.uint32)
    two = x[:-1] * np.uint32(257) + x[1:]
    three = two[:-1] * np.uint32(263) + x[2:]
    two = (two * np.uint32(2654435761)) >> np.uint32(20)
    three = ((three * np.uint32(2246822519)) >> np.uint32(18)) + np.uint32(PAIRS)
    letter = b != 32
    return np.concatenate([two[letter[:-1] | letter[1:]], three[letter[1:-1]]])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def code_words(n: int) -> np.ndarray:
    """n rows of +1 and -1. Up to five languages get the exhaustive code of
    2**(n-1) - 1 bits; more get random bits that keep all rows well apart."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        bits = 2 ** (n - 1) - 1
        code = [[1] * bits] + [[-1 if (c // 2 ** (n - 1 - r)) % 2 == 0 else 1 for c in range(bits)] for r in range(1, n)]
        return np.array(code, np.int8)
    bits = max(15, 6 * math.ceil(math.log2(n)))
    rng, best = np.random.default_rng(5), None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(n, dtype=int)
        varied = np.abs(code.sum(0)).max() < n
        if varied and (best is None or apart.min() > best[0]):
            best = (apart.min(), code)
    return best[1] if best else code


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x PLACES: log-likelihood ratios
    trust: np.ndarray  # of each bit

    def margins(self, texts: list[str]) -> np.ndarray:
        """The evidence of each bit's classifier for each text, texts x bits."""
        out = np.zeros((len(texts), self.code.shape[1]), np.float64)
        for i, t in enumerate(texts):
            # Whole texts in pieces, so that memory does not follow their length.
            n = 0
            for at in range(0, len(t), 1 << 18):
                g = _ngrams(_bytes(t[at : at + (1 << 18)]))
                n += len(g)
                out[i] += self.weights @ np.bincount(g, minlength=PLACES).astype(np.float32) if len(g) > 4 * PLACES else self.weights[:, g].sum(1)
            out[i] /= math.sqrt(max(n, 1))
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Logistic loss of each code word, texts x languages: bits weigh as far as they can be trusted."""
        m = np.clip(margins, -30, 30)
        return np.stack([(np.log1p(np.exp(-m * c)) * self.trust).sum(1) for c in self.code], 1)


def _counts(labelled: DataFrame) -> DataFrame:
    """lang, place, n: n-grams of the labelled texts, added up in the tasks first."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                of = sums.setdefault(lang, np.zeros(PLACES, np.int64))
                for at in range(0, len(text), 1 << 18):
                    of += np.bincount(_ngrams(_bytes(text[at : at + (1 << 18)])), minlength=PLACES)
        for lang, of in sums.items():
            at = np.flatnonzero(of)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(of[at], pa.int64())], names=["lang", "place", "n"])

    return labelled.mapInArrow(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, per_lang: int = 4000, seed: int = 3) -> Model:
    """Fit the classifiers on ``labelled`` (text, lang), rows with a null in either left out.

    At most about ``per_lang`` texts of each language are used, drawn by a hash
    of the text, so copies of one text are drawn together. Each bit's binary
    classifier is a log-likelihood ratio of n-gram frequencies (naive Bayes)
    between the languages whose code word has the bit and the others; a bit's
    trust is the log-odds of being right on a part of the sample.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(per)
    if not langs:
        return Model([], np.ones((0, 1), np.int8), np.zeros((1, PLACES), np.float32), np.ones(1))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_lang / n))) for k, n in per.items()])
    sample = rows.where(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_000)) < share * 1_000_000)
    counts = np.zeros((len(langs), PLACES))
    for r in _counts(sample).toLocalIterator():  # at most languages x PLACES rows
        counts[langs.index(r.lang), r.place] = r.n
    rates = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * PLACES)
    code = code_words(len(langs))
    weights = np.zeros((code.shape[1], PLACES), np.float32)
    for b in range(code.shape[1]):
        one, other = rates[code[:, b] > 0], rates[code[:, b] < 0]
        if len(one) and len(other):
            weights[b] = np.log(one.mean(0)) - np.log(other.mean(0))
    model = Model(langs, code, weights, np.ones(code.shape[1]))
    small = rows.where(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_000)) < share * 50_000)

    def judge(batches):
        for batch in batches:
            keep = [i for i, t in enumerate(batch.column("text").to_pylist()) if has_letter(t)]
            texts, tags = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            right = (np.sign(model.margins([texts[i] for i in keep])) == model.code[[model.langs.index(tags[i]) for i in keep]]).sum(0) if keep else np.zeros(code.shape[1], int)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(right)), pa.int32()), pa.array(right, pa.int64()), pa.array([len(keep)] * len(right), pa.int64())], names=["bit", "right", "n"])

    for r in small.mapInArrow(judge, "bit int, right long, n long").groupBy("bit").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).collect():
        p = (r.right + 1) / (r.n + 2)
        model.trust[r.bit] = max(0.05, math.log(p / (1 - p)))
    model.trust /= model.trust.mean()
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.5) -> DataFrame:
    """The columns of ``docs`` without the text, and: lang_pred, score, ambiguous.

    lang_pred is the language of the code word nearest to the bits under the
    loss-weighted distance, score its share among all under exp(-distance), and
    ambiguous is true where the second nearest is less than ``ambiguous_below``
    further. Null texts and texts without a letter get ``und``, score 0, not
    ambiguous; so do all texts if nothing could be learned. Rows are judged one
    by one, so repeated ones get the same answer. Columns named like a result
    are overwritten.
    """
    result = ["lang_pred", "score", "ambiguous"]
    own = [c for c in docs.columns if c not in [text_col, *result]]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "__text") + ", lang_pred string, score double, ambiguous boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m: Model = shared.value
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            keep = [i for i, t in enumerate(texts) if m.langs and has_letter(t)]
            pred, score, unsure = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            if keep:
                loss = m.losses(m.margins([texts[i] for i in keep]))
                order = np.argsort(loss, 1, kind="stable")
                share = np.exp(loss.min(1, keepdims=True) - loss)
                share /= share.sum(1, keepdims=True)
                for k, i in enumerate(keep):
                    a = order[k, 0]
                    pred[i], score[i] = m.langs[a], float(share[k, a])
                    unsure[i] = len(m.langs) > 1 and bool(loss[k, order[k, 1]] - loss[k, a] < ambiguous_below)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=[*own, *result])

    return rows.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, in their own columns, whose language can be told.

    Those go that have no letter at all. An ambiguous text stays: it has a
    nearest language, and short texts are often ambiguous.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return predict(rows, model, "row", "text").where("lang_pred <> 'und'").select("row.*")
