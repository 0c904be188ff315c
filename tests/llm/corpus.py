"""A small corpus with the odd cases every operator has to stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, key int, cls int, tile int, row int"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_texts():
    """[(doc_id, text)]: null, empty, blank, tiny, long, copies, near copies, ties."""
    rng = random.Random(7)
    base = words(rng, 120)
    near = list(base)
    near[60] = "changed"
    far = base[:60] + words(rng, 60)
    passage = words(rng, 50)
    long = " ".join(words(rng, 30_000))
    plain = [" ".join(words(rng, rng.randrange(12, 90))) for _ in range(12)]
    texts = [None, "", "   \n\t ", "one", "two words", " ".join(base), " ".join(base), " ".join(near), " ".join(far),
             "Title\n" + " ".join(passage + words(rng, 30)), " ".join(words(rng, 20) + passage), long,
             long + " tail end", "a" * 70_000, "x" * 40_000 + " " + "é!" * 30_000 + " end", "   nbsp é ß 日本語 \U0001f600 words",
             "same line here\nsame line here\nsame line here", *plain]
    rows = list(enumerate(texts))
    rows += [(5, texts[5]), (None, texts[5]), (None, "no id at all"), (3, "another text under an id used before")]
    return rows


def listed(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
