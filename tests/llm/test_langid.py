import math
import random

import numpy as np

from timeloom.llm import langid

PARTS = {"aa": ["tho", "ing", "the"], "bb": ["sch", "ung", "ße"], "cc": ["eau", "èr", "que"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_rejects(spark, frame):
    rng = random.Random(3)
    docs = [(i, text(rng, lang, rng.randrange(3, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 150)]
    model = langid.train(frame(*docs[:300]).unionByName(frame((900, None, "aa"), (901, "the", None))))
    assert model.langs == ["aa", "bb", "cc"] and model.code.shape == (3, 3)
    odd = [(1000, None), (1001, ""), (1002, "123 -- !!"), (1003, "the " * 100_000)]
    got = {r.doc_id: r for r in langid.predict(frame(*docs[300:], *odd), model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in docs[300:])
    assert [got[i].lang_pred for i in range(1000, 1004)] == ["und", "und", "und", "aa"]
    kept = langid.keep_known(frame(*docs[300:305], *odd), model)
    assert kept.count() == 6 and kept.columns == frame(*docs[:1]).columns


def test_nothing_learned_and_empty(frame):
    model = langid.train(frame().limit(0))
    assert [r.lang_pred for r in langid.predict(frame((1, "words")), model).collect()] == ["und"]
    assert langid.predict(frame().limit(0), model).count() == 0
    one = langid.train(frame((1, "only one", "aa")))
    assert [(r.lang_pred, r.ambiguous) for r in langid.predict(frame((1, "words")), one).collect()] == [("aa", False)]


def test_code_words_are_apart():
    for n in (2, 3, 5, 9, 40):
        code = langid.code_words(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2 + 99 * np.eye(n, dtype=int)
        assert apart.min() >= (1 if n == 2 else 2 if n == 3 else 3)


def test_like_a_naive_decoder(frame):
    """N-grams, bits and code words one at a time, in plain numbers."""
    rng = random.Random(9)
    docs = [(i, text(rng, lang, rng.randrange(1, 30)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    model = langid.train(frame(*docs))

    def places(t):
        b = [32, *[c if 97 <= c <= 122 or c >= 128 else 32 for c in t.lower().encode()], 32]
        out = []
        for x, y in zip(b, b[1:], strict=False):
            if x != 32 or y != 32:
                out.append((((x * 257 + y) * 2654435761) % (1 << 32)) >> 20)
        for x, y, z in zip(b, b[1:], b[2:], strict=False):
            if y != 32:
                out.append((((((x * 257 + y) * 263 + z) * 2246822519) % (1 << 32)) >> 18) + langid.PAIRS)
        return out

    def decode(t):
        at = places(t)
        margins = [sum(float(model.weights[bit][p]) for p in at) / len(at) ** 0.5 for bit in range(model.code.shape[1])]
        loss = [sum(float(model.trust[k]) * math.log1p(math.exp(-max(-30, min(30, m)) * int(word[k]))) for k, m in enumerate(margins)) for word in model.code]
        share = [math.exp(min(loss) - x) for x in loss]
        return model.langs[loss.index(min(loss))], max(share) / sum(share)

    asked = [(i, t) for i, t, _ in docs[:40]] + [(900, "The tho 12 -- ING"), (901, "é"), (901, "é")]
    got = langid.predict(frame(*asked).withColumnRenamed("source", "score"), model).collect()
    assert len(got) == len(asked)
    want = {i: decode(t) for i, t in asked}
    assert all(r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3 for r in got)
