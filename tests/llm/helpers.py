"""Small tables for the text operators, with what real ones hold: nulls, empty and long texts, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", _id long, _row long, size string, taken string, n_lines string, starts string, fp string"
WORDS = "river stone lamp cloud paper green seven house window road field winter Summer LIGHT bread".split()
SPACES = " \t\n\x0b\x0c\r"


def docs(spark, texts, schema=SCHEMA):
    """texts: list of texts, or of (doc_id, text), or of (doc_id, text, source)."""
    n = len(schema.split(", ")) - 5
    rows = []
    for k, t in enumerate(texts):
        i, t, s = (t + ("a",))[:3] if isinstance(t, tuple) else (k, t, "a")
        rows.append((i, t, "en", s, len(t) if t is not None else None, *[None] * n))
    return spark.createDataFrame(rows, schema)


def some_texts(seed, n=40, most=60, vocabulary=WORDS):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(most))]
        if out and rng.random() < 0.4:
            other = rng.choice(out).split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = other[rng.randrange(len(other) + 1) :]
        out.append("".join(w + rng.choice(SPACES) for w in words))
    return out


def by_id(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
