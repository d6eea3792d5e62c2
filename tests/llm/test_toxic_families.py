import numpy as np

from lodestrata.llm import toxicity


def test_word_families_that_clean_texts_also_use_are_found():
    rng = np.random.default_rng(7)
    syllables = ["ba", "co", "du", "fi", "ge", "hu", "ka", "lo", "mi", "nu"]
    member = lambda: "boment" + "".join(rng.choice(syllables, 4))

    def text(hits):
        words = ["".join(rng.choice(syllables, 3)) for _ in range(150)]
        return " ".join(words + [member() for _ in range(hits)])

    toxic = [i % 8 == 0 for i in range(800)]
    texts = [text(6 if t else int(i % 10 == 3)) for i, t in enumerate(toxic)]
    score = toxicity.fit(texts[:400], [int(t) for t in toxic[:400]]).scorer()
    said = [score(t)[1] >= toxicity.REJECT for t in texts[400:]]
    assert sum(s for s, t in zip(said, toxic[400:]) if t) >= 48 and sum(s for s, t in zip(said, toxic[400:]) if not t) <= 7
