"""Character models against interpolated Kneser-Ney worked out letter by letter."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

langid = pytest.importorskip("peptide_context.llm.langid")
MARK, ORDER, D = "\x02", 4, 0.75


class ByHand:
    def __init__(self, texts):
        words = [MARK + w + MARK for t in texts for w in t.lower().split()]
        grams = [Counter(w[i : i + n] for w in words for i in range(len(w) - n + 1)) for n in range(ORDER + 1)]
        self.use = [None] * (ORDER + 1)
        self.use[ORDER] = grams[ORDER]
        for n in range(1, ORDER):
            self.use[n] = Counter(g[1:] for g in grams[n + 1])  # different characters in front
            self.use[n] |= Counter({g: c for g, c in grams[n].items() if n > 1 and g[0] == MARK and g not in self.use[n]})
        self.use[1].setdefault(MARK, 1)
        self.uniform = 1 / (len(set(grams[1]) | {MARK}) + 64)

    def p(self, c, h):
        n = len(h) + 1
        lower = self.p(c, h[1:]) if n > 1 else self.uniform
        after = {g: k for g, k in self.use[n].items() if g[:-1] == h}
        total = sum(after.values())
        if not total:
            return lower
        return max(after.get(h + c, 0) - D, 0) / total + D * len(after) / total * lower

    def cross_entropy(self, text):
        bits = size = 0
        for w in text.lower().split():
            framed = MARK + w + MARK
            for i in range(1, len(framed)):
                bits -= math.log2(self.p(framed[i], framed[max(0, i - ORDER + 1) : i]))
                size += 1
        return bits / size


def test_models_by_hand(spark):
    rng = random.Random(2)
    make = lambda parts: [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(12)) for _ in range(6)]
    own = {"aa": make(["ka", "to", "é", "x"]), "bb": make(["schl", "ung", "b", "ß"])}
    rows = [(t, k) for k, ts in own.items() for t in ts]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ["aa", "bb"]
    texts = [own["aa"][0], own["bb"][1], "kato unseen ungschl", "q", "TO To", "katokatokato", "éé ßß"]
    got, size = model.cross_entropies(pa.array(texts))
    assert size.tolist() == [sum(len(w) + 1 for w in t.split()) for t in texts]
    for column, lang in enumerate(model.langs):
        hand = ByHand(own[lang])
        assert got[:, column].tolist() == pytest.approx([hand.cross_entropy(t) for t in texts], rel=1e-4)
