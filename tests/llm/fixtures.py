"""Small documents with copies, near copies, edge cases and columns with clashing names."""

import random

WORDS = [a + b for a in "ka lo mi ne pu ra so ti ve wo".split() for b in "ban dor fel gim hun jas kel lom nis pur".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(rng, words, edits):
    out = words.split()
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return " ".join(out)


def documents(seed=1, base=12):
    """(doc_id, text) rows."""
    rng, rows = random.Random(seed), []
    passage = text(rng, 60)
    for _ in range(base):
        t = text(rng, rng.choice([3, 8, 20, 60, 200]))
        rows.append(t)
        for _ in range(rng.randrange(5)):
            rows.append(near(rng, t, rng.randrange(1, 4)))
        rows += [t.upper()] * rng.randrange(2)
        rows.append(passage + " " + text(rng, rng.choice([5, 10, 30])))
    rows += ["", None, " \t\n", "one", "ONE", "one two", "a b c d", "a b c d e", "a b c d e f", "x" * 5000, "Ünï cödé " * 30, "a\x0bb\x0cc\x1cd"]
    chain = text(rng, 80).split()
    for _ in range(8):  # each links to the next, the ends don't
        rows.append(" ".join(chain))
        chain = chain[1:] + [rng.choice(WORDS)]
        chain[40] = rng.choice(WORDS)
    return [(i, t) for i, t in enumerate(rows)]


def frame(spark, rows):
    """Rows as documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "src", 0, "x", 1, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, score int, n string")
