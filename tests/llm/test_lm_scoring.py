import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import words as words_module
from evidentia.llm.lm_scoring import score_documents
from evidentia.llm.words import ngram_hashes, word_hashes


def _words(text):
    return re.findall(r"[a-z0-9_\x80-\U0010ffff]+", (text or "").lower())


@pytest.mark.parametrize("step", [5, 1 << 18])
def test_equal_words_have_equal_hashes(step, monkeypatch):
    monkeypatch.setattr(words_module, "STEP", step)
    text = "The cat, the CAT! été naïve x_1 -- a " + "long" * 30 + " 日本 b " * 20
    plain, hashes = _words(text), word_hashes(text)
    assert len(plain) == len(hashes)
    assert len(set(zip(plain, hashes.tolist(), strict=True))) == len(set(plain)) == len(set(hashes.tolist()))
    for n in (1, 2, 5):
        grams = [tuple(plain[i : i + n]) for i in range(len(plain) - n + 1)]
        assert len(set(zip(grams, ngram_hashes(hashes, n).tolist(), strict=True))) == len(set(grams)) == len(np.unique(ngram_hashes(hashes, n)))
    assert len(word_hashes(None)) == len(word_hashes(" .,")) == len(ngram_hashes(hashes[:3], 5)) == 0


def _brute(rows, order, backoff):
    per = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)] for w in (_words(t) for _, t in rows)]
    total = [sum((p[n] for p in per), Counter()) for n in range(order)]
    size, out = sum(total[0].values()), []
    for (i, text), own in zip(rows, per, strict=True):
        w, logs, backed = _words(text), 0.0, 0

        def c(gram, own=own):
            return total[len(gram) - 1][gram] - own[len(gram) - 1][gram]

        for k in range(len(w)):
            factor, n = 1.0, min(k + 1, order)
            longest = n
            while n > 1 and c(tuple(w[k - n + 1 : k + 1])) == 0:
                factor, n = factor * backoff, n - 1
            gram = tuple(w[k - n + 1 : k + 1])
            s = c(gram) / c(gram[:-1]) if n > 1 else max(1, c(gram)) / max(1, size - len(w))
            backed += n == 1 < longest
            logs += math.log(factor * s)
        out.append((i, len(w), backed, logs))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_brute_force(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "dd", "éé", "Aa", "z"], k=rng.randrange(12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "never seen words"), (103, "a b c " * 3000), (104, "twin text"), (104, "twin text"), (None, "a b")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, n string")
    want = sorted(_brute(rows, order, 0.4), key=lambda r: str(r[:3]))
    for chunk_bytes in (1 << 20, 200):
        got = sorted(((r.doc_id, r.n_words, r.n_backed_off, r.log_score) for r in score_documents(docs, order=order, chunk_bytes=chunk_bytes).collect()), key=lambda r: str(r[:3]))
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert score_documents(docs.where("doc_id = -1")).count() == 0
    assert score_documents(docs.where("doc_id = 100")).first().mean_log_score is None
    assert score_documents(docs.where("doc_id = 102"), order=order).first().log_score == pytest.approx(_brute([rows[62]], order, 0.4)[0][3])
