import random

import numpy as np
import pytest

from ravelin.llm import language_mixture as L

LETTERS = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr", "dd": "stuvwx", "ee": "yzäöüß"}


@pytest.fixture(scope="module")
def made():
    """Made languages of letters of their own, texts of parts of them, and junk."""
    rng = random.Random(4)
    words = lambda lang, n: [("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(3, 8)))) for _ in range(n)]

    def text(**parts):
        out = [w for lang, n in parts.items() for w in words(lang, n)]
        rng.shuffle(out)
        return " ".join(out)

    train = [(1000 + i, text(**{lang: 400}), lang) for i, lang in enumerate([*LETTERS] * 8)]
    junk = " ".join("".join(rng.choice("абвгдежзийклмнопрст") for _ in range(6)) for _ in range(200))
    cases = {1: text(aa=200), 2: text(aa=80, bb=70, cc=50), 3: text(aa=50, bb=50, cc=50, dd=50), 4: text(aa=90, bb=50, cc=40, dd=20), 5: junk, 6: junk + " " + text(bb=50), 7: text(bb=150) + " " + junk[:350],
             8: text(aa=60, bb=60, cc=60, dd=60, ee=60)}
    return train, cases


def test_sets_grow_beyond_three(spark, made):
    train, cases = made
    model = L.train(spark.createDataFrame(train, "doc_id int, text string, lang string"), "text", "lang")
    found = {r["doc_id"]: {x["lang"]: x["share"] for x in r["languages"]} for r in L.identify(spark.createDataFrame(list(cases.items()), "doc_id int, text string"), model).collect()}
    near = lambda got, **want: got.keys() == want.keys() and all(abs(got[k] - v) < 0.03 for k, v in want.items())
    assert near(found[1], aa=1) and near(found[2], aa=0.4, bb=0.35, cc=0.25)
    assert near(found[3], aa=0.25, bb=0.25, cc=0.25, dd=0.25) and near(found[4], aa=0.45, bb=0.25, cc=0.2, dd=0.1)
    assert near(found[8], **dict.fromkeys(LETTERS, 0.2))


def test_known_languages_decide_not_one(spark, made):
    """Three clean languages stay; junk and an unseen script go, though one language fits them best."""
    train, cases = made
    docs = spark.createDataFrame(train + [(i, t, None) for i, t in cases.items()], "doc_id int, text string, lang string")
    kept = {r["doc_id"] for r in L.keep_identified(docs).collect()}
    assert kept & cases.keys() == {1, 2, 3, 4, 7, 8} and {d for d, _, _ in train} <= kept


def test_bound_is_above_every_fit():
    rng = np.random.default_rng(3)
    likely = np.exp(-rng.uniform(0, 8, (60, 5))).astype(np.float32)
    first, counts = np.array([0, 10, 40]), np.array([10, 30, 20])
    rows = np.repeat(np.arange(3), counts)
    share, value = L._fit(likely, np.full((3, 5), 0.2, np.float32), rows, first, counts, 2)
    most = L._most(likely, share, value, rows, first, counts)
    _, late = L._fit(likely, share, rows, first, counts, 500)
    assert (late <= most + 1e-3).all() and (value < late).all()
