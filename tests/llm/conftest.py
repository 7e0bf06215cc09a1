import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", ".", ","]) if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages and lines, edge cases; id -> text."""
    rng, out = random.Random(3), {}
    passage, line = prose(rng, 60), "A line that many documents repeat again and again, Always"
    for i in range(60):
        out[i] = prose(rng, rng.choice([3, 20, 80, 200])) + rng.choice(["\n", " ", "\n\n"]) + prose(rng, 30)
    for i in range(60, 90):
        w = out[rng.randrange(60)].split(" ")
        for _ in range(rng.choice([0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out[i] = rng.choice([" ", "  ", "\n"]).join(w) if i % 3 else " ".join(w)
    for i in range(90, 110):
        out[i] = prose(rng, 10) + " " + passage[rng.randrange(30) :] + "\n" + line + "\n" + prose(rng, 10) + "\n" + line.upper()
    base = prose(rng, 100).split(" ")
    for i in range(110, 140):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(1000)
        out[i] = " ".join(w)
    out |= {140: None, 141: "", 142: " \t\n\x0b\x0c\r ", 143: "One", 144: "one", 145: "ab" * 400, 146: "c" + "ab" * 300, 147: "é\U0001F600　ß" * 60, 148: "é\U0001F600　ß" * 50, 149: "no-break space  em", 150: "word " * 3000, 151: "z" * 30000}
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, "task", 7, "id", 1, 2) for i, t in corpus.items()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, task string, n int, id string, part int, component_id int").repartition(5)
