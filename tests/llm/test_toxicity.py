import math
import random
import re
import time

from timeloom.llm import toxicity as T

LABELLED = "text string, label int"


def corpus(rng, n):
    out = []
    for i in range(n):
        words = [rng.choice("the sun rose over hills and rivers while birds sang their songs".split()) for _ in range(rng.randrange(8, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "blurgh" + rng.choice("abc") * 3]))
        if i % 7 == 0:
            words.insert(2, "blur")
        out.append((" ".join(words), int(bad)))
    return out


def test_learns_and_scores_held_out_texts(spark, frame):
    rng = random.Random(4)
    data = corpus(rng, 500)
    model = T.train(spark.createDataFrame(data[:400] + [(None, 0), ("odd", None)], LABELLED))
    assert {"idiot$", "blurgh"} <= {e if e.endswith("$") or e == "blurgh" else e for e in model.lexicon.entries} or any(e.startswith("blurgh") for e in model.lexicon.entries)
    docs = [(i, t) for i, (t, _) in enumerate(data[400:])] + [(900, None), (901, ""), (902, "sun " * 50_000 + "idiot blurghaaa idiot blurghbbb")]
    got = {r.doc_id: r.score for r in T.score(frame(*docs), model).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= 0.7) == bool(y) for i, (_, y) in enumerate(data[400:]))
    assert right >= 98 and got[900] < 0.5 and got[901] < 0.5 and got[902] > 0.7


def test_clauses_not_words_are_scored():
    m = T.Matcher(T.Lexicon({"idiot$": (50, 0), "blurgh": (50, 0)}, 100, 1000))
    f = lambda t: dict(zip(T.FEATURES, m.features(t), strict=True))
    plain, negated, told, aimed = (f(t) for t in ("An idiot. Fine", "He is not an idiot. Fine", "They said idiot. Fine", "You idiot. Fine"))
    assert plain["plain"] > 0 and plain["negated"] == 0
    assert negated["negated"] > 0 and negated["plain"] == 0
    assert told["reported"] > 0 and told["plain"] == 0
    assert aimed["aimed"] > 0 and aimed["plain"] > 0
    two = f("not here. idiot! you blurghzz")
    assert two["clauses"] == math.log1p(2) and two["negated"] == 0
    assert f("idiotic superidiot my_idiot blur")["rate"] == 0


def test_no_labels_and_empty(spark, frame):
    model = T.train(spark.createDataFrame([], LABELLED))
    assert T.score(frame().limit(0), model).count() == 0
    assert [r.score for r in T.score(frame((1, "x")), model).collect()] == [0.5]


def test_sample_is_bounded_and_joined(spark, frame):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1000)] + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    docs = frame(*[(i, f"t{i}") for i in range(1200)])
    assert T.labelled_sample(docs, labels).count() == 1000
    assert 60 < T.labelled_sample(docs, labels, most_rows=100).count() < 150


def test_threats_count_without_an_insult(spark, frame):
    one = math.log1p(1)
    m = T.Matcher(T.Lexicon({"idiot$": (50, 0)}, 100, 1000))
    f = lambda t: dict(zip(T.FEATURES, m.features(t), strict=True))
    assert f("I will kill you. Fine")["threat"] == T._level("threat", 1) and f("You will die. Fine")["threat_aimed"] == T._level("threat_aimed", 1)
    for said, n in (("I will kill you", 1), ("kill and burn you and them", 2), ("You die, they kill", 2), ("We kill. You see", 0), ("never kill you", 0)):
        assert f(said)["threat_aimed"] == T._level("threat_aimed", n)
    assert f("idiot, you")["aimed"] == f("you idiot")["aimed"] > 0 == f("idiot. you")["aimed"]
    assert f("I will not kill you")["threat"] == 0 and f("skills, diesel and my_kill")["threat"] == 0
    assert f("An idiot. They burn it")["threat"] == T._level("threat", 1) and f("An idiot. They burn it")["clauses"] == one and f("They burn it")["rate"] == 0
    rng = random.Random(5)
    data = corpus(rng, 400)
    # As many clean texts have the words, negated: no word is learned as an insult.
    for i in range(120):
        data += [(f"the sun rose. you will {rng.choice(T.THREAT[:5])} soon {i}", 1), (f"the sun rose. you will not {rng.choice(T.THREAT[:5])} soon {i}", 0)]
    model = T.train(spark.createDataFrame(data, LABELLED))
    assert not {"kill", "kill$", "die", "die$"} & set(model.lexicon.entries)
    got = {r.doc_id: r.score for r in T.score(frame((1, "birds sang. you will kill again"), (2, "birds sang. you will sing again")), model).collect()}
    assert got[1] > 0.5 > got[2]


def test_the_composed_transducer_says_what_its_parts_say():
    rng, parts = random.Random(1), (T._harm(), *map(T._scope, ("negated", "reported")), T._aim())
    for _ in range(300):
        state, states = T.GRAMMAR["start"], [p.start for p in parts]
        for token in (rng.randrange(6) for _ in range(rng.randrange(1, 25))):
            state, out = T.GRAMMAR["arcs"][state, token]
            steps = [p.step(s, token) for p, s in zip(parts, states, strict=True)]
            states = [s for s, _ in steps]
            assert state == tuple(states) and out == {o for _, o in steps if o}


def test_scores_like_adding_up_clause_by_clause(spark, frame):
    """Clauses split first, words read one at a time, parts run side by side: the same scores."""
    rng = random.Random(8)
    model = T.train(spark.createDataFrame(corpus(rng, 300), LABELLED))
    words = ["sun", "You", "not", "said", "idiot", "blurghaaa", "kill", "hills", "they", "never", "idiotic"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "!\n"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    cues = {w: c for c, ws in ((T.THREATS, T.THREAT), (T.TARGETS, T.TARGET), (T.NEGATES, T.NEGATION), (T.REPORTS, T.REPORT)) for w in ws}

    def entry(w):
        fit = [e for e in model.lexicon.entries if (w == e[:-1] if e.endswith("$") else w.startswith(e))]
        return max(fit, key=lambda e: len(e.rstrip("$")), default=None)

    def score(text):
        sums, hits = dict.fromkeys(T.FEATURES, 0.0), 0
        for clause in re.split(r"[.!?;\n]", text.lower()):
            found, negated, reported, total = [(w, entry(w)) for w in re.findall(r"\w+", clause)], False, False, 0.0
            insulting, targets = any(e for _, e in found), [cues.get(w) == T.TARGETS and not e for w, e in found]
            aimed = any(targets)
            for w, e in found:
                token = T.INSULT if e else cues.get(w)
                negated, reported = negated or token == T.NEGATES, reported or token == T.REPORTS
                if token not in (T.INSULT, T.THREATS):
                    continue
                if cues.get(w) == T.THREATS and not (negated or reported):
                    sums["threat"] += 1
                    sums["threat_aimed"] += aimed
                if insulting:
                    weight = max(0.0, model.lexicon.weight(e)) if e else 1.0
                    hits, total = hits + (weight > 0), total + weight
                    for name, on in (("negated", negated), ("reported", reported), ("aimed", aimed), ("plain", not (negated or reported))):
                        sums[name] += weight * on
            sums["clauses"] += total > 0
            sums["top"] = max(sums["top"], total)
        sums["rate"] = float(hits)
        z = model.intercept + sum(c * T._level(f, sums[f]) for c, f in zip(model.coefficients, T.FEATURES, strict=True))
        return 1 / (1 + math.exp(-z))

    got = {r.doc_id: r.score for r in T.score(frame(*enumerate(texts), (100, texts[0]), (100, texts[0])).withColumnRenamed("lang", "f"), model).collect()}
    assert all(abs(got[i] - score(t)) < 1e-6 for i, t in enumerate(texts)) and abs(got[100] - got[0]) < 1e-12


def test_a_long_text_without_clause_ends_is_read_in_one_pass():
    m = T.Matcher(T.Lexicon({"idiot$": (50, 0)}, 100, 1000))
    begun = time.perf_counter()
    one = dict(zip(T.FEATURES, m.features("sun kill idiot hills " * 120_000), strict=True))
    many = dict(zip(T.FEATURES, m.features("sun kill idiot hills; " * 120_000), strict=True))
    assert time.perf_counter() - begun < 8
    assert one["clauses"] == math.log1p(1) and many["clauses"] == math.log1p(120_000)
    assert m.clauses("a. idiot b; kill c\nd", [(3, 8), (12, 16)]) == [(2, 10), (11, 18)]
