import random

import numpy as np
import pytest

from ledgerloom.llm import toxicity as tx


def test_spellings():
    assert [tx.normal(t) for t in ("ly1ng", "r@7", "s t u p i d", "STU­PID", "2019", "IDIOT!!!", "іdіоt", "i_d_i_o_t")] == ["lying", "rat", "stupid", "stupid", "#", "idiot", "idiot", "idiot"]
    assert tx.skeleton("scumbag") == tx.skeleton("sc*mb*g") == "scmbg"


def test_passages_cover_the_text():
    text = "One 3.5 two. Three!\nFour? 五。六\n\n last"
    spans = list(tx.passages(text))
    assert "".join(text[a:b] for a, b in spans).replace("\n", "") == text.replace("\n", "")
    assert len(spans) == 6


@pytest.mark.parametrize("cells", [1, 400_000])
def test_marginals_against_enumeration(monkeypatch, cells):
    monkeypatch.setattr(tx, "CELLS", cells)
    rng = np.random.default_rng(0)
    f = tx.Field()
    lengths = np.array([3, 1, 5])
    starts = np.array([0, 3, 4])
    e = rng.normal(size=9)
    p, moves, chance = f.marginals(e, starts, lengths)
    for s, n in zip(starts, lengths):
        total, mass = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            v = np.exp(sum(e[s + i] for i in range(n) if y[i]) + f.bias * y[0] + sum(f.move[y[i], y[i + 1]] for i in range(n - 1)))
            total += v
            mass += v * np.array(y)
        np.testing.assert_allclose(p[s : s + n], mass / total, rtol=1e-9)
        np.testing.assert_allclose(chance[starts == s], 1 - np.exp((n - 1) * f.move[0, 0]) / total, rtol=1e-9)
    least = float(np.median(chance))
    some, _, same = f.marginals(e, starts, lengths, least)
    np.testing.assert_allclose(same, chance)
    for s, n, c in zip(starts, lengths, chance):  # below the threshold nothing is lost: no token is above the passage's chance
        assert (some[s : s + n] == (p[s : s + n] if c >= least else 0)).all() and (p[s : s + n] <= c + 1e-12).all()


BAD = ["You are a {w} and everyone knows it.", "Shut up, {w}, nobody asked you.", "Only a {w} like you would write this.", "Get lost, you {w}."]
INSULTS = ["moron", "idiot", "stupid cow", "pathetic loser", "worthless clown"]
GOOD = ["The residual falls below {n} after {n} sweeps.", "Figure {n} shows the gap as a function of mu.", "The word 'moron' was removed from page {n}.", "We thank the members of group {n}.", "The table lists {n} records."]


def corpus(n, seed):
    rng = random.Random(seed)
    texts, truth = [], []
    for _ in range(n):
        parts = [rng.choice(GOOD).format(n=rng.randrange(999)) for _ in range(rng.randrange(2, 6))]
        bad = rng.random() < 0.25
        if bad:
            parts.insert(rng.randrange(len(parts)), rng.choice(BAD).format(w=rng.choice(INSULTS)))
        texts.append(" ".join(parts))
        truth.append(bad)
    return texts, np.array(truth)


def test_held_out():
    texts, truth = corpus(500, 1)
    rng = random.Random(2)
    flags = [float(t != (rng.random() < 0.05)) for t in truth]  # some flags are wrong
    field = tx.train(texts, flags)
    new, real = corpus(400, 3)
    scores, spans = tx.assess(field, tx.Reader(field.known), new)
    hit = scores > 0.2
    assert (hit == real).mean() > 0.95
    for t, s, r in zip(new, spans, real):
        for a, b, p in s:
            assert 0 <= a < b <= len(t) and p > 0.2


def test_spans_are_tokens():
    texts, truth = corpus(500, 1)
    field = tx.train(texts, [float(t) for t in truth])
    rng = random.Random(9)
    filler = " ".join(rng.choice(["the residual falls below", "we thank the members of the group", "the table lists records"]) for _ in range(300))
    long = filler + " you are a pathetic loser and everyone knows it " + filler  # no mark ends a passage
    scores, spans = tx.assess(field, tx.Reader(field.known), [long, filler, short := "We thank the members, shut up, idiot, nobody asked you."])
    at = long.index("pathetic loser")
    assert scores[0] >= 0.2 and any(a < at + 14 and b > at for a, b, _ in spans[0])
    assert sum(b - a for a, b, _ in spans[0]) < 200 and scores[1] < 0.2 and not spans[1]
    assert spans[2] and all(a >= short.index("members") for a, _, _ in spans[2])  # not the whole passage
    assert any(a <= short.index("idiot") < b for a, b, _ in spans[2])
    for s, x in zip(scores, spans):
        assert not x or s == max(p for *_, p in x)


def test_tags_say_nothing():
    texts, truth = corpus(500, 1)
    field = tx.train(texts, [float(t) for t in truth])
    plain = "Shut up, idiot, nobody asked you."
    page = f'<html><body class="a"><p>{plain}</p></body></html>'
    (a, b), (x, y) = tx.assess(field, tx.Reader(field.known), [plain, page])
    assert a == b >= 0.2 and [(s + page.index(plain), e + page.index(plain), p) for s, e, p in x] == y
    assert [t for t in tx.TAG.findall("a < b > c <- d <3 <p> <br/> </i>")] == ["<p>", "<br/>", "</i>"]


def test_tables(spark):
    texts, truth = corpus(120, 5)
    rows = [(i, t, "s" if i % 3 else None, "x") for i, t in enumerate(texts)] + [(900, None, "s", "x"), (901, "", "s", "x"), (902, " \n", "s", "x"), (903, "word " * 40000, "s", "x"), (904, "!" * 5000, "s", "x"), (905, "x " * 600000, "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score string")
    reviews = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)] + [(0, None), (777, 1)], "doc_id bigint, flagged int")
    got = {r.doc_id: r for r in tx.score(docs, reviews).collect()}
    assert len(got) == len(rows)
    assert all(got[i].score == 0 and got[i].spans == [] for i in (900, 901, 902))
    assert np.mean([got[i].offending == truth[i] for i in range(120)]) > 0.9
    none = tx.score(docs, reviews.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.offending for r in none)
    bounded = tx.reviewed(docs, reviews, max_chars=2000).toPandas()
    whole = tx.reviewed(docs, reviews).toPandas()
    assert 0 < bounded["text"].str.len().sum() <= 2000 < whole["text"].str.len().sum() and len(tx.reviewed(docs, reviews, max_reviews=9).toPandas()) <= 9
    assert tx.score(docs.limit(0), reviews.limit(0)).count() == 0
