import random
from collections import Counter
from zlib import crc32

import pytest

from evidentia.llm import language
from evidentia.llm.language import Profiles, grams, identify, ranked

WORDS = {"en": "the of and to in that is with for thing nation under other".split(), "de": "der die und nicht über schön größe auch sich eine straße".split(), "fr": "le la les élève être où garçon pour dans une leçon".split()}


def _plain(text):
    """n-grams by definition: letters, anything else a blank, blanks at the ends only."""
    found = Counter()
    padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and " " not in g.strip() and not (n == 3 and g[1] == " "):
                found[g] += 1
    return found


def _code(g):
    n = len(g)
    return sum((0 if c == " " else ord(c)) << 20 * (n - 1 - i) for i, c in enumerate(g)) | n << 60


@pytest.mark.parametrize("step", [4, 7, 1 << 20])
def test_grams_are_those_of_the_definition(step, monkeypatch):
    monkeypatch.setattr(language, "STEP", step)
    for text in ("", "a", "ab", "The quick, brown fox!! é", "İstanbul ẞ", "1 2 3", "日本語 テキスト" * 3, " a b  c "):
        codes, counts = grams(text)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {_code(g): n for g, n in _plain(text).items()}


def test_distance_is_the_sum_of_places_apart():
    def top(text):
        return [g for g, _ in sorted(_plain(text).items(), key=lambda x: (-x[1], _code(x[0])))][:50]

    profiles = {lang: top(" ".join(words)) for lang, words in WORDS.items()}
    known = Profiles({lang: ranked(*grams(" ".join(words)), 50) for lang, words in WORDS.items()}, 50)
    for text in ("the thing", "und nicht", "le garçon xyz", "q"):
        own = top(text)
        apart = {lang: sum(min(50, abs(p.index(g) - i)) if g in p else 50 for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        lang, score = known.predict(text)
        assert lang == best and score == pytest.approx(1 - apart[best] / (50 * len(own))) and 0 <= score <= 1


def test_held_out_accuracy_and_odd_rows(spark):
    rng, rows = random.Random(1), []
    for i in range(400):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(4, 40))), lang if i % 11 else None))
    truth = {r[0]: r[2] for r in rows}
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 !? 34", "de"), (None, "the of and that", "en"), (1003, "der die und " * 200_000, None), (1004, "le la", "fr"), (1004, "le la", "fr")]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows + odd], "doc_id long, text string, lang string, score double, lang_pred string")
    got = identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (1000, 1001, 1002))
    held = [r for r in got if r.held_out and truth.get(r.doc_id)]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert next(r for r in got if r.doc_id == 1003).lang_pred == "de"
    assert {r.lang_pred for r in identify(docs.withColumn("lang", docs.lang.substr(100, 0)).where("lang is null")).collect()} == {"und"}
    assert identify(docs.where("doc_id = -1")).count() == 0
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect())
